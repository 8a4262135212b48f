"""Reading levels of made-up documents, and the measures they rest on."""

import random

import numpy as np
import pyarrow as pa

from moltide.llm import reading as RD
from moltide.llm.tokens import character_classes
from moltide.llm.words import asides, slices, unbroken

PLAIN = ["The man went home.", "It was dark and wet.", "He did not pay the rent.", "The car was red.", "She kept the bill of May."]
ADULT = ["The insurance company paid the sum and then asked the owner to return the money.", "The witness remembered a van near the gate but could not give its number to the police.", "Nothing in the file shows that the tenant was warned about the risk of the work."]
LEGAL = ["The evidential burden of establishing causation remained with the respondent notwithstanding contrary submissions.", "The restitutionary claim advanced cannot be reconciled with the contractual allocation of commercial responsibility."]
EXPERT = ["Notwithstanding the contention pressed at the hearing, the proportionality of the sanction imposed requires independent examination by the appellate court, inasmuch as the underlying documentation had been communicated to the competent authority, whereas the correspondence exchanged demonstrates an unequivocal acknowledgement of indebtedness, so that the conclusion reached by the intermediate court is ultimately unimpeachable."]


def document(rng, level):
    s = (PLAIN, ADULT, LEGAL, EXPERT)[level - 1]
    n = (30, 12, 12, 5)[level - 1]
    return "COURT OF X\nHeadnote: " + rng.choice(LEGAL) + "\n" + "\n".join(f"[{k}] " + " ".join(rng.choice(s) for _ in range(max(1, n // 3))) for k in range(1, 4)) + "\nORDER\nThe appeal is dismissed."


def test_levels_with_wrong_labels_and_dirt(spark):
    rng = random.Random(4)
    truth = {i: rng.randint(1, 4) for i in range(200)}
    docs = [(i, document(rng, v), "x") for i, v in truth.items()] + [(900, None, "x"), (901, "", "x"), (902, "too short", "x"), (903, "1 " * 150, "x")]
    labels = [(i, truth[i] if i % 12 else 1 + truth[i] % 4, "r") for i in range(80)] + [(None, 1, "r"), (5, None, "r"), (9999, 2, "r")]
    d = spark.createDataFrame(docs, "doc_id long, text string, reading_level string")
    k = spark.createDataFrame(labels, "doc_id long, reading_level int, text string")
    got = {r["doc_id"]: r["reading_level"] for r in RD.levels(d, k).collect()}
    long = {i for i, t, _ in docs if t and len(t.split()) >= RD.MIN_WORDS}
    assert set(got) == long
    assert np.mean([got[i] == truth[i] for i in truth if i in got]) >= 0.9


def test_without_labels_or_documents(spark):
    d = spark.createDataFrame([(1, "word " * 120)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, reading_level int")
    assert [tuple(r) for r in RD.levels(d, none).collect()] == [(1, None)]
    assert RD.levels(d.limit(0), none).count() == 0


def test_coverage_rank(spark):
    rows = [("en", "the", 10), ("en", "of", 6), ("en", "a", 6), ("en", "rare", 1)]
    v = RD.vocabulary(spark.createDataFrame(rows, "lang string, word string, n long"))
    assert sorted((r["word"], r["rank"]) for r in v.collect()) == [("a", 3), ("of", 3), ("rare", 4), ("the", 1)]


def test_pieces():
    raw = np.frombuffer("inadm-\nissible so\xadft (see [1] there) x-\nY".encode(), "uint8")
    b, off = unbroken(raw, np.array([0, len(raw)]))
    assert b.tobytes().decode() == "inadmissible soft (see [1] there) x-\nY" and off[-1] == len(b)
    assert b[~asides(b, off)].tobytes().decode() == "inadmissible soft  x-\nY"
    texts = pa.array(["One two three. Four five six seven.", "", None, "été déjà vu."])
    r = RD.Reader(character_classes(), *next((x, o) for _, _, x, o in slices(texts)))
    sentence, word = r.measures()
    assert sentence.tolist() == [4.0, 0.0, 0.0, 3.0] and r.blank_words.tolist() == [7, 0, 0, 3]
    assert abs(word[3] - 3.0) < 1e-9


def test_line_ends():
    lf = "The man went home.\nIt was dark and very wet.\n\nThe quali-\nfied clerk saw it! He left then.\n"
    texts = [lf, lf.replace("\n", "\r\n"), lf.replace("\n", "\r"), "\nEnd of it all."]
    r = RD.Reader(character_classes(), *next((x, o) for _, _, x, o in slices(pa.array(texts))))
    sentence, word = r.measures()
    assert len(set(sentence[:3])) == 1 and len(set(word[:3])) == 1 and sentence[0] == 6.0
    b, off = unbroken(*next((x, o) for _, _, x, o in slices(pa.array(texts))))
    assert [b[i:j].tobytes().decode() for i, j in zip(off, off[1:])] == [unbroken_lf := lf.replace("-\n", ""), unbroken_lf, unbroken_lf, texts[3]]


def test_cover_is_the_same_for_any_broadcast_vocabulary(spark):
    """Texts whose words the broadcast ranks don't cover get their exact ranks by the join."""
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["the", "of", "and", "court"]) if rng.random() < 0.3 else f"{chr(97 + i % 5)}{'xyzuv'[rng.randint(0, 4)]}{'abcde'[rng.randint(0, 4)]}" for _ in range(150)) + ".") for i in range(30)] + [(77, None), (78, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    whole = sorted(map(tuple, RD.measured(d).collect()))
    for size in (1, 10, 60):
        assert [(r[0], *(round(x, 9) for x in r[3:])) for r in sorted(map(tuple, RD.measured(d, size).collect()))] == [(r[0], *(round(x, 9) for x in r[3:])) for r in whole]
