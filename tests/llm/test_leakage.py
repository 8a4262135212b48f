"""Leaked passages planted in made-up documents, and MinHash recall."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from moltide.llm import leakage as LK
from moltide.llm.tokens import character_classes
from moltide.llm.words import slices

NAMES = ["Kolbar", "Mirren", "Tasvel", "Ondrix", "Pelgan", "Surwick", "Hadlo", "Quenby", "Ystral", "Vorne"]


def passage(rng, n=60):
    return " ".join(rng.choice(["the", "of", "crates", "brought", "to", "yard", "lorry", "stood", "for", "minutes"]) if rng.random() < 0.5 else rng.choice(NAMES) + str(rng.randint(10, 9999)) for _ in range(n))


def noise(rng, n=200):
    return " ".join(rng.choice(["court", "appeal", "order", "costs", "judge", "witness", "said", "that", "it", "was"]) for _ in range(n))


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    return sorted((r["doc_id"], r["item_id"]) for r in LK.leaks(d, e, **kw).collect())


def test_planted(spark):
    rng = random.Random(5)
    items = [(i, passage(rng)) for i in range(30)]
    w = {i: t.split() for i, t in items}
    part = lambda i, a, b: " ".join(w[i][a:b])
    replaced = w[3][10:42]
    for k in (4, 13, 21, 29):
        replaced[k] = "█████"
    broken = part(4, 5, 40).upper().replace(" ", " \n", 3)
    header = f"{part(5, 0, 20)}\nPage 2 of 3 | A v B\n[7] {part(5, 20, 40)}"
    split = w[6][10:45]
    split[7] = split[7][:2] + " " + split[7][2:]
    hyphen = part(7, 10, 45)
    at = hyphen.index("crates") + 3 if "crates" in hyphen else len(hyphen) // 2
    hyphen = hyphen[:at] + "-\n" + hyphen[at:]
    docs = [
        (1, noise(rng) + " " + items[0][1] + " " + noise(rng)), (2, noise(rng, 3000) + " " + part(1, 20, 50) + " " + noise(rng, 10)), (3, " ".join(replaced)), (4, noise(rng) + "; " + broken), (5, header),
        (6, noise(rng) + " " + " ".join(split)), (7, hyphen + " " + noise(rng)), (8, noise(rng) + part(8, 0, 12) + noise(rng)), (9, noise(rng)), (10, None), (11, ""), (12, "short"), (13, items[2][1] + " " + items[0][1]), (13, items[2][1]),
    ]
    want = [(1, 0), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (13, 0), (13, 2)]
    assert found(spark, docs, items + [(99, None), (98, ""), (97, "a b c"), (None, "x")]) == want
    assert found(spark, docs, items, block_bytes=2000) == want


def test_empty(spark):
    assert found(spark, [], [(1, "a b")]) == []
    assert found(spark, [(1, "a b")], []) == []


def test_passage_of_many_items(spark):
    """A passage that several items share is found for each of them, whatever the blocks."""
    rng = random.Random(8)
    for many in (4, 10):
        shared = passage(rng, 40)
        items = [(i, passage(rng, 30) + " " + shared + " " + passage(rng, 30)) for i in range(many)] + [(50 + i, passage(rng)) for i in range(5)]
        docs = [(1, noise(rng) + " " + shared + " " + noise(rng)), (2, noise(rng))]
        want = [(1, i) for i in range(many)]
        assert found(spark, docs, items) == want
        if many == 4:
            assert found(spark, docs, items, block_bytes=1500) == want


def test_pattern_and_formula_are_no_passage(spark):
    """Sentences of one pattern with other names, with a formula of many items behind them."""
    rng = random.Random(3)
    name = lambda: rng.choice(NAMES) + str(rng.randint(10**4, 10**9))
    formula = "This copy is issued for the use of the parties only."
    one = lambda: f"{name()} delivered {rng.randint(2, 999)} crates of lamps to the depot at {name()} of which only {rng.randint(2, 999)} were unloaded before {rng.randint(2, 999)}. {formula}"
    items = [(i, passage(rng, 30) + ". " + one()) for i in range(8)]
    docs = [(i, noise(rng, 50) + ". " + one() + " " + noise(rng, 50)) for i in range(20)]
    docs.append((99, noise(rng, 50) + " " + items[3][1]))
    assert found(spark, docs, items) == [(99, 3)]


def test_very_long_item_takes_little_memory():
    rng = random.Random(1)
    text = passage(rng, 20_000)
    parts = LK.segments(text)
    assert len(parts) > 1 and all(len(p.split()) <= LK.SEGMENT for p in parts)
    classes = character_classes()
    tracemalloc.start()
    index = LK.Items([1] * len(parts), parts, [None] * len(parts), classes)
    w = text.split()
    docs = pa.array([" ".join(w[4000:4030]), " ".join(w), noise(rng), "a " * 30_000, " ".join(w[19_960:])], pa.large_string())
    reader, got = LK.Words(classes), set()
    for i, _, b, off in slices(docs):
        got |= {i + t for t, _ in index.pairs(reader, b, off)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {0, 1, 4} and peak < 500 << 20


def test_one_word_again_and_again():
    """Repeated shingles don't multiply."""
    classes = character_classes()
    index = LK.Items([1], ["la " * 4000], [None], classes)
    for _, _, b, off in slices(pa.array(["la " * 50_000, "la " * 20, "lo " * 100], pa.large_string())):
        assert index.pairs(LK.Words(classes), b, off) == [(0, 0)]


def test_search_meets_what_brute_force_meets():
    """Recall on passages at the limit: one word in eight blacked out, of 24 to 30 words, and in a third a header in between."""
    rng = random.Random(11)
    classes = character_classes()
    items = [passage(rng, 70) for _ in range(40)]
    docs = []
    for n in range(400):
        w = items[n % 40].split()
        at, size = rng.randint(0, 40), rng.randint(24, 30)
        part = w[at : at + size]
        for k in rng.sample(range(size), size // 8):
            part[k] = "█" * 5
        if n % 3 == 0:
            part.insert(rng.randint(8, 16), "Page 2 of 3")
        docs.append(noise(rng, 40) + " " + " ".join(part) + " " + noise(rng, 40))
    index = LK.Items(list(range(40)), items, [None] * 40, classes)
    reader, got = LK.Words(classes), set()
    for i, _, b, off in slices(pa.array(docs, pa.large_string())):
        got |= {(i + t, x) for t, x in index.pairs(reader, b, off)}
    assert sum((n, n % 40) in got for n in range(400)) >= 360 and not [p for p in got if p[0] % 40 != p[1]]


def test_rounds_meet_what_they_promise():
    rng = np.random.default_rng(1)
    missed, shared = 0, round(LK.CONTAINMENT * LK.PASSAGE)
    assert LK.rounds_needed(4) < LK.rounds_needed(24)
    for _ in range(2000):
        a = rng.integers(0, 2**63, LK.PASSAGE, dtype="uint64")
        b = np.concatenate((a[:shared], rng.integers(0, 2**63, LK.DOC_PASSAGE - shared, dtype="uint64")))
        zero = lambda h: np.zeros(len(h), "int64")
        missed += not any(set(LK.minima(a, zero(a), k)[1].tolist()) & set(LK.minima(b, zero(b), k)[1].tolist()) for k in range(LK.rounds_needed(24)))
    assert missed == 0
