"""Reading level of each document (problem 8).

Every language's words are ranked by how often they stand in the reasons of all documents. A document's coverage
rank is the size of the smallest frequency-ranked vocabulary that covers a fixed share of its words. With
sentence and word length it forms the measures, which are calibrated on a bounded sample of labelled
documents: SQL gives the spread of each measure within a language's levels, and a document takes the level of
its nearest labelled neighbours.

Two passes over the texts, neither with a shuffle of text: the first gives word counts, combined per partition
before the shuffle; the second gives one short row per document. The VOCABULARY most frequent words of each language are
broadcast; they cover nearly every text. The words of the other texts are counted and joined with the ranks of all words,
so every coverage rank is exact, whatever the vocabulary.

The one parameter that bounds what is used: SAMPLE labels fit the levels.

Defined results: null, empty and short texts (fewer than MIN_WORDS blank-separated words) are left out;
a text without any letters gets the measures 0; without labels the level is null; a language with fewer than
LEAST_LABELS labels is judged by all labels; null labels and labels of unknown documents are passed over; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moltide.llm.tokens import character_classes
from moltide.llm.words import LETTER, SPACE, asides, byte_kinds, coded, fold, slices, unbroken, word_spans
from moltide.session import written

MIN_WORDS = 100
SHARES = (0.6, 0.75)
VOCABULARY = 20_000
SAMPLE = 4000
NEIGHBOURS = 7
LEAST_LABELS = 16
#: Distinct words held before a partition passes on its counts.
HELD_WORDS = 150_000

#: Frequent short words by which a language is told.
FUNCTION_WORDS = {
    "en": "the of and to was that in is for with not",
    "de": "der die das und nicht ist zu den von dem des",
    "fr": "le la les des et du une est dans pour pas",
}
LANGUAGES = tuple(FUNCTION_WORDS)
FIRST_PARAGRAPH = re.compile(rb"(?m)^[ \t]*(?:\[1\]|\(1\)|\xc2\xa7 ?1\b|1[.\t])")
#: Headings after which the reasons are over.
CLOSING = (b"\nORDER", b"\nTENOR", b"\nDISPOSITIF")

MEASURES = ("sentence", "word", "cover_low", "cover_high")


def _median(v: np.ndarray, gid: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((v, gid))
    g, s = gid[order], np.append(v[order], 0.0)
    lo = np.searchsorted(g, np.arange(n))
    c = np.searchsorted(g, np.arange(n), "right") - lo
    return np.where(c > 0, s[np.where(c > 0, lo + c // 2, -1)], 0.0)


class Reader:
    """Words and sentences of the reasons of a piece of texts."""

    def __init__(self, classes: np.ndarray, b: np.ndarray, off: np.ndarray):
        b, off = unbroken(b, off)
        self.n = n = len(off) - 1
        kind, raw = byte_kinds(b, classes), b.tobytes()
        at_start = np.zeros(len(b) + 1, bool)
        at_start[off] = True
        ink = kind != SPACE
        begins = ink & ~(np.concatenate(([False], ink[:-1])) & ~at_start[:-1]) if len(b) else ink
        self.blank_words = np.diff(np.concatenate(([0], np.cumsum(begins)))[off])
        lo, hi = off[:-1].copy(), off[1:].copy()
        for k in range(n):
            if m := FIRST_PARAGRAPH.search(raw, off[k], off[k + 1]):
                lo[k] = m.start()
            end = max(raw.rfind(c, off[k], off[k + 1]) for c in CLOSING)
            if end > lo[k]:
                hi[k] = end
        start, end = word_spans(kind, off[:-1])
        doc = np.searchsorted(off, start, "right") - 1
        keep = (start >= lo[doc]) & (start < hi[doc]) & ~asides(b, off)[start] if len(start) else np.zeros(0, bool)
        self.start, self.end, self.doc = start[keep], end[keep], doc[keep]
        self.code, spelt = coded(b, self.start, self.end)
        self.words = [fold(w) for w in spelt]
        self.b, self.kind = b, kind
        votes = np.array([[w in f for f in (set(FUNCTION_WORDS[x].split()) for x in LANGUAGES)] for w in self.words], float).reshape(-1, len(LANGUAGES))
        self.language = np.stack([np.bincount(self.doc, votes[self.code, k], n) for k in range(len(LANGUAGES))], 1).argmax(1) if n else np.zeros(0, int)

    def measures(self) -> tuple[np.ndarray, np.ndarray]:
        """(median words per sentence, mean letters per word) of each text."""
        b, kind, start, end, doc, n = self.b, self.kind, self.start, self.end, self.doc, self.n
        letters = np.concatenate(([0], np.cumsum((kind == LETTER) & ((b & 0xC0) != 0x80))))
        size = (letters[end] - letters[start]).astype(float)
        words = np.bincount(doc, minlength=n)
        mean = np.bincount(doc, size, n) / np.maximum(words, 1)
        p = np.concatenate((b, np.zeros(3, "uint8")))
        stop = np.flatnonzero((b == 0x2E) | (b == 0x21) | (b == 0x3F))
        before, nxt, then = p[stop - 1], p[stop + 1], p[stop + 2]
        w = np.searchsorted(start, stop) - 1
        some = w >= 0
        w = np.maximum(w, 0)
        wide = some & ((end[w] - start[w] >= 3) if len(start) else False) | (before == 0x29)
        closes = ((kind[np.maximum(stop - 1, 0)] == LETTER) if len(b) else False) | (before == 0x29) | (before == 0x5D)
        apart = (nxt == 0x20) | (nxt == 0x0A) | (nxt == 0)
        opens = (then >= 0x41) & (then <= 0x5A) | (then >= 0xC0) | np.isin(then, (0, 0x0A, 0x28, 0x5B)) | (then >= 0x30) & (then <= 0x39) & (nxt == 0x0A)
        stops = stop[closes & apart & wide & opens]
        key = doc.astype("int64") * (len(stops) + 1) + np.searchsorted(stops, start)
        u, count = np.unique(key, return_counts=True)
        long = count >= 3
        return _median(count[long].astype(float), (u[long] // (len(stops) + 1)), n), mean

    def cover(self, rank: np.ndarray, share: float) -> np.ndarray:
        """The rank up to which words cover the share of each text's words; rank: of each distinct word and language."""
        r = rank[self.code, self.language[self.doc]]
        order = np.lexsort((r, self.doc))
        g, s = self.doc[order], np.append(r[order], 0)
        lo = np.searchsorted(g, np.arange(self.n))
        c = np.searchsorted(g, np.arange(self.n), "right") - lo
        at = lo + np.ceil(share * c).astype("int64") - 1
        return np.where(c > 0, s[np.where(c > 0, at, -1)], 0)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): how often each word stands in the reasons of the documents of a language."""
    shared = docs.sparkSession.sparkContext.broadcast(character_classes())

    def run(batches):
        held: dict[tuple[int, str], int] = {}

        def out():
            keys = list(held)
            return pa.RecordBatch.from_arrays([pa.array([LANGUAGES[k] for k, _ in keys]), pa.array([w for _, w in keys]), pa.array([held[k] for k in keys], pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for _, _, b, off in slices(batch.column(0)):
                r = Reader(shared.value, b, off)
                lang = r.language[r.doc]
                for k in range(len(LANGUAGES)):
                    count = np.bincount(r.code[lang == k], minlength=len(r.words))
                    for i in np.flatnonzero(count):
                        key = (k, r.words[i])
                        held[key] = held.get(key, 0) + int(count[i])
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """(lang, word, rank): equally frequent words share the rank of the last of them."""
    per_count = counts.groupBy("lang", "n").agg(F.count("*").alias("words"))
    # One row per distinct count: their number grows as the root of the corpus.
    ranks = per_count.withColumn("rank", F.sum("words").over(Window.partitionBy("lang").orderBy(F.desc("n"))))
    return counts.join(ranks.select("lang", "n", "rank"), ["lang", "n"]).select("lang", "word", "rank")


def measured(docs: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """(doc_id, lang, n_words, sentence, word, cover_low, cover_high) of each document, as logarithms but for the word length."""
    every = written(vocabulary(word_counts(docs)), "vocabulary")
    rows = every.where(F.col("rank") <= size).collect()  # at most size rows per language
    ranks = [{} for _ in LANGUAGES]
    for r in rows:
        ranks[LANGUAGES.index(r["lang"])][r["word"]] = r["rank"]
    shared = docs.sparkSession.sparkContext.broadcast((character_classes(), ranks))
    word = pa.struct([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        classes, ranks = shared.value
        for batch in batches:
            ids = batch.column(0)
            for i, j, b, off in slices(batch.column(1)):
                r = Reader(classes, b, off)
                sentence, length = r.measures()
                rank = np.array([[v.get(w, size + 1) for v in ranks] for w in r.words], "float64").reshape(-1, len(LANGUAGES))
                low, high = (r.cover(rank, s) for s in SHARES)
                # The words of texts that the ranks at hand don't cover go along.
                rest = [[] for _ in range(j - i)]
                for k in np.flatnonzero(high > size):
                    code, n = np.unique(r.code[r.doc == k], return_counts=True)
                    rest[k] = [{"word": r.words[c], "n": m} for c, m in zip(code.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(np.array(LANGUAGES, object)[r.language], pa.string()), pa.array(r.blank_words.astype("int64")), *map(pa.array, (np.log(np.maximum(sentence, 1.0)), length, np.log1p(low), np.log1p(high))), pa.array(rest, pa.list_(word))],
                    ["doc_id", "lang", "n_words", *MEASURES, "rest"],
                )

    m = written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang string, n_words long, " + ", ".join(f"{c} double" for c in MEASURES) + ", rest array<struct<word string, n long>>").withColumn("key", F.monotonically_increasing_id()), "measures")
    # Running sums of a text's words over the ranks of all words: one row per distinct word of these texts.
    rest = m.where(F.size("rest") > 0).select("key", "lang", F.explode("rest").alias("w")).select("key", "lang", "w.word", "w.n")
    rest = rest.join(every, ["lang", "word"]).groupBy("key", "rank").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("key")
    rest = rest.withColumn("upto", F.sum("n").over(own.orderBy("rank"))).withColumn("all", F.sum("n").over(own))
    exact = rest.groupBy("key").agg(*[F.log1p(F.min(F.when(F.col("upto") >= F.ceil(F.lit(s) * F.col("all")), F.col("rank"))).cast("double")).alias(f"exact_{k}") for k, s in enumerate(SHARES)])
    m = m.join(exact, "key", "left")
    return m.select("doc_id", "lang", "n_words", "sentence", "word", *[F.coalesce(f"exact_{k}", c).alias(c) for k, c in enumerate(("cover_low", "cover_high"))])


def levels(docs: DataFrame, labels: DataFrame, min_words: int = MIN_WORDS, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, reading_level) of each document of at least min_words words."""
    m = written(measured(docs), "reading")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("reading_level").isNotNull()).select("doc_id", "reading_level").orderBy(F.xxhash64("doc_id"), "doc_id", "reading_level").limit(sample)
    fitted = m.join(F.broadcast(known), "doc_id").select("doc_id", "lang", F.col("reading_level").cast("long").alias("level"), *MEASURES)
    every = fitted.unionByName(fitted.withColumn("lang", F.lit("")))
    # Spread of each measure within the levels of a language: the root mean square over levels of the median deviation.
    middle = every.groupBy("lang", "level").agg(*[F.percentile(c, F.lit(0.5)).alias(f"m_{c}") for c in MEASURES])
    near = every.join(F.broadcast(middle), ["lang", "level"]).groupBy("lang", "level").agg(F.count("*").alias("n"), *[F.percentile(F.abs(F.col(c) - F.col(f"m_{c}")), F.lit(0.5)).alias(c) for c in MEASURES])
    spread = {r["lang"]: r for r in near.groupBy("lang").agg(F.sum("n").alias("n"), *[(1.4826 * F.sqrt(F.avg(F.col(c) * F.col(c))) + 0.02).alias(c) for c in MEASURES]).collect()}
    points = fitted.orderBy("doc_id", "level").toPandas()  # at most `sample` labels
    model = {}
    for lang in ("", *LANGUAGES):
        p = points if lang == "" else points[points.lang == lang]
        if len(p) >= LEAST_LABELS or (lang == "" and len(p)):
            scale = np.array([spread[lang][c] for c in MEASURES])
            model[lang] = (p[list(MEASURES)].to_numpy() / scale, p.level.to_numpy("int64"), scale, p.doc_id.to_numpy("int64"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for pdf in batches:
            out = pd.Series(pd.NA, index=pdf.index, dtype="Int64")
            for lang, rows in pdf.groupby("lang"):
                if found := model.get(lang, model.get("")):
                    a, level, scale, own = found
                    kinds = np.unique(level)
                    k = min(NEIGHBOURS, len(a))
                    q, ids = rows[list(MEASURES)].to_numpy() / scale, rows.doc_id.to_numpy("int64")
                    for s in range(0, len(q), 1024):
                        d = (q[s : s + 1024] ** 2).sum(1)[:, None] - 2 * q[s : s + 1024] @ a.T + (a**2).sum(1)[None]
                        d[ids[s : s + 1024, None] == own[None]] = 1e9  # a document's own label may be one of the wrong ones
                        near = np.argpartition(d, k - 1, axis=1)[:, :k]
                        weight = 1 / (np.maximum(np.take_along_axis(d, near, 1), 0) + 0.5)
                        votes = np.stack([(weight * (level[near] == x)).sum(1) for x in kinds], 1)
                        out.loc[rows.index[s : s + 1024]] = kinds[votes.argmax(1)]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "reading_level": out})

    return m.where(F.col("n_words") >= min_words).select("doc_id", "lang", *MEASURES).mapInPandas(run, "doc_id long, reading_level long")
