"""Evaluation texts leaking into training text (problem 7).

Size-partitioned MinHash containment search. A text is the sequence of its blank-separated words without case,
compatibility forms, punctuation and line-end hyphens; words that are nothing but punctuation (blackenings, rules)
drop out. Its word shingles are hashed.

Query side: every item is cut into passages of MIN_WORDS words at a stride. Index side: every document is cut into
passages that overlap by half; shingles that no item has can't be in common and drop out before anything else is
done with them. What is left of a passage falls into a size class. The containment that must be found gives, with the
largest size of a class, the number of MinHash rounds the class needs to miss with a chance of at most MISS. A round
is a one-permutation MinHash: the shingles are dealt into BINS, and the least of each bin is kept. A document passage
and an item that agree in a bin's minimum are candidates.

Candidates are verified by exact shingle containment (the places of the item's shingles in the document, at least
the searched share of a passage), and then by aligning the words along them: at least MIN_WORDS words in a row of
the item, at most one in eight of them not matched. Words are matched in order; after a replaced word the next one
stands in its own place, and after an insertion (header, number, split word) the text goes on with REJOIN words in a
row of the item. A formula is no case as it is shorter than MIN_WORDS. A sentence of one pattern with other names and
numbers is another passage, which a formula behind it must not make long enough: of the words that stand in at most
CONTEXTS different contexts over all items, half must be met. None of this depends on the number of items or documents
that repeat a passage.

One pass over the documents without a shuffle. What is broadcast is bounded by BLOCK_BYTES of item text: longer texts
are cut into segments that overlap, and if there are more blocks, one pass writes the documents that have any
shingle of the items (by a bit table of fixed size), and blocks pass over these. Verification is linear in the words.
Each document is judged in whole, so neither copies nor long texts are cut or capped. The result doesn't depend on
blocks or segments. Shingles are of five words. A similarity of 0.8 would miss the cases: one replaced word in eight
leaves a quarter of a passage's shingles, and headers or numbers in between less.

Defined results: null, empty and short texts and items hold no passage; rows with null ids are left out;
equal pairs are given once. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltide.llm.tokens import SPACE, character_classes
from moltide.llm.words import byte_kinds, slices, unbroken
from moltide.session import written

SHINGLE, MIN_WORDS = 5, 24
#: Shingles of an item's passage, and between the starts of two; those of a document's passage.
PASSAGE, ITEM_STRIDE = MIN_WORDS - SHINGLE + 1, 6
DOC_PASSAGE, DOC_STRIDE = 24, 12
#: Size classes of document passages, by the shingles that some item has.
SIZES = (4, 8, 16, 24)
CONTAINMENT, MISS, BINS = 0.1, 1e-5, 64
#: Inserted words that are passed over, replaced words in a row, and words in a row with which a text goes on behind an insertion.
GAP, REPLACED, REJOIN = 40, 4, 3
#: Different contexts over all items in which a telling word may stand, and the words on either side that make one.
CONTEXTS, BESIDE = 3, 6
#: Item text in a block, and the words of a segment of a long item and those it shares with the next.
BLOCK_BYTES, SEGMENT, OVERLAP = 2 << 20, 4096, 256
SEED = 20240229

_PUNCTUATION = re.compile(r"[\W_]+")


def plain(word: bytes) -> str:
    return _PUNCTUATION.sub("", unicodedata.normalize("NFKC", word.decode("utf-8", "replace")).casefold())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the size-word sequences of word hashes; the last size - 1 places are missing."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, "uint64")
    h = np.zeros(n, "uint64")
    for k in range(size):
        h = _mix(h + words[k : k + n] * np.uint64(2 * k + 3))
    return h


def rounds_needed(size: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Rounds with which a passage of up to size shingles is met that holds the share of an item's passage."""
    shared = max(1, round(containment * PASSAGE))
    union = PASSAGE + size - shared
    # The chance of one of `union` shingles to be the least of its bin.
    least = (1 - (1 - 1 / BINS) ** union) * BINS / union
    return math.ceil(math.log(miss) / (shared * math.log(1 - least)))


ROUNDS = max(rounds_needed(s) for s in SIZES)
NEEDED = np.array([0] + [rounds_needed(next(u for u in SIZES if s <= u)) for s in range(1, DOC_PASSAGE + 1)])
MULTIPLIERS = np.random.default_rng(SEED).integers(1, 2**63, ROUNDS, dtype="uint64") * np.uint64(2) + np.uint64(1)


def minima(h: np.ndarray, passage: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(passage, value): the least of each bin of each passage in round k; a value tells its bin by its highest bits."""
    v = _mix(h * MULTIPLIERS[k])
    order = np.lexsort((v, passage))
    v, p = v[order], passage[order]
    bin_ = v >> np.uint64(64 - BINS.bit_length() + 1)
    first = np.ones(len(v), bool)
    first[1:] = (p[1:] != p[:-1]) | (bin_[1:] != bin_[:-1])
    return p[first], v[first]


def expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places lo, lo + 1, ... n of them for each entry, one after another."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def ends_of_repeats(h: np.ndarray, group: np.ndarray) -> np.ndarray:
    """False inside a stretch of one repeated shingle (one word again and again): its two ends stand for it."""
    keep = np.ones(len(h), bool)
    if len(h) > 2:
        same = (h[1:] == h[:-1]) & (group[1:] == group[:-1])
        keep[1:-1] = ~(same[:-1] & same[1:])
    return keep


class Words:
    """Hashes of plain words; remembers spellings from piece to piece."""

    def __init__(self, classes: np.ndarray):
        self.classes, self.known = classes, {}

    def of(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """(word hashes, text of each word, distinct plain words, number of each word in them), in order of the texts."""
        b, off = unbroken(b, off)
        if not len(b):
            return np.zeros(0, "uint64"), np.zeros(0, "int64"), [], np.zeros(0, "int64")
        ink = byte_kinds(b, self.classes) != SPACE
        edge = np.zeros(len(b) + 1, bool)
        edge[off] = True
        start = np.flatnonzero(ink & ~(np.concatenate(([False], ink[:-1])) & ~edge[:-1]))
        end = np.flatnonzero(ink & ~(np.concatenate((ink[1:], [False])) & ~edge[1:])) + 1
        size = end - start
        total = np.concatenate(([0], np.cumsum(size)))
        d = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(total.astype("int32")), pa.py_buffer(b[expand(start, size)])]).dictionary_encode()
        spelt, known = [], self.known
        if len(known) > 400_000:
            known.clear()
        for w in d.dictionary.to_pylist():
            if (p := known.get(w)) is None:
                s = plain(w)
                p = known[w] = (s, xxhash.xxh64_intdigest(s) if s else 0)
            spelt.append(p)
        code = d.indices.to_numpy()
        values = np.fromiter((h for _, h in spelt), "uint64", len(spelt))
        keep = values[code] != 0
        doc = np.searchsorted(off, start, "right") - 1
        return values[code[keep]], doc[keep], [s for s, _ in spelt], code[keep]


def placed_shingles(words: np.ndarray, text: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of its first word) of the shingles of texts laid end to end; none lies over the end of a text."""
    h = shingles(words, size)
    at = np.flatnonzero(text[: len(h)] == text[size - 1 :]) if len(h) else np.zeros(0, "int64")
    return h[at], at


class Region:
    """Words [lo, hi) of a piece of texts, with the places of their REJOIN-word sequences."""

    def __init__(self, words: np.ndarray, spelt: list[str], code: np.ndarray, lo: int, hi: int):
        self.lo, self.hi, self.array, self.names, self.code = lo, hi, words[lo:hi], spelt, code
        self.words, self.places = self.array.tolist(), None

    def spelt(self, at: int) -> str:
        return self.names[self.code[at]]

    def trigram(self, h: int) -> list[int]:
        if self.places is None:
            self.places = {}
            for k, v in enumerate(shingles(self.array, REJOIN).tolist()):
                self.places.setdefault(v, []).append(self.lo + k)
        return self.places.get(h, ())


class Items:
    """A block of items, indexed for the search. Its size is bounded by that of the block's text."""

    def __init__(self, ids: list[int], texts: list[str], telling: list[list[int] | None], classes: np.ndarray):
        reader = Words(classes)
        words, text, names, self.ids = [], [], [], ids
        for i, _, b, off in slices(pa.array(texts, pa.large_string())):
            w, t, spelt, code = reader.of(b, off)
            words.append(w)
            text.append(t + i)
            names += [spelt[c] for c in code]
        self.words, self.plain = np.concatenate(words or [np.zeros(0, "uint64")]), names
        text = np.concatenate(text or [np.zeros(0, "int64")])
        self.bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        self.telling = np.zeros(len(self.words), bool)
        for k, own in enumerate(telling):
            a, b = self.bounds[k : k + 2]
            self.telling[a:b] = np.isin(self.words[a:b].view("int64"), own or [])
        h, at = placed_shingles(self.words, text)
        item = text[at] if len(at) else at
        # Places of shingles, in order of their hashes.
        keep = ends_of_repeats(h, item)
        order = np.flatnonzero(keep)[np.argsort(h[keep], kind="stable")]
        self.h, self.place, self.item = h[order], at[order], item[order]
        self.bits = max(16, int(len(h) * 64).bit_length())
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self.slot(self.h)] = True
        # Passages: MIN_WORDS words from every ITEM_STRIDE-th on, the last of an item shorter.
        first = np.searchsorted(item, np.arange(len(texts) + 1))
        within = np.arange(len(h)) - first[item] if len(h) else at
        keys, of = [np.zeros(0, "uint64")], [np.zeros(0, "int64")]
        spread = [(within - k * ITEM_STRIDE) // ITEM_STRIDE for k in range(-(-PASSAGE // ITEM_STRIDE))]
        own = [(p >= 0) & (within - p * ITEM_STRIDE < PASSAGE) for p in spread]
        g = np.concatenate([np.flatnonzero(o) for o in own])
        p = np.concatenate([s[o] for s, o in zip(spread, own, strict=True)])
        passage = item[g] * (int(within.max(initial=0)) + 1) + p
        for k in range(ROUNDS if len(g) else 0):
            q, v = minima(h[g], passage, k)
            pair = np.unique(np.stack([v, (q // (int(within.max()) + 1)).astype("uint64")], 1), axis=0)
            keys.append(pair[:, 0])
            of.append(pair[:, 1].astype("int64"))
        self.keys, self.of = keys[1:], of[1:]
        self.trigrams = shingles(self.words, REJOIN)
        self.own, self.third = self.words.tolist(), self.trigrams.tolist()

    def slot(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)

    def known(self, h: np.ndarray) -> np.ndarray:
        """Places of the shingles that some item has."""
        at = np.flatnonzero(self.maybe[self.slot(h)])
        if not len(at):
            return at
        p = np.searchsorted(self.h, h[at])
        return at[self.h[np.minimum(p, len(self.h) - 1)] == h[at]]

    def candidates(self, h: np.ndarray, doc: np.ndarray, within: np.ndarray) -> np.ndarray:
        """Distinct doc * items + item of the documents' known shingles (at place `within` in their text) that share a minimum with an item."""
        p = within // DOC_STRIDE
        twice = np.flatnonzero(p > 0)
        h, doc, p = np.concatenate((h, h[twice])), np.concatenate((doc, doc[twice])), np.concatenate((p, p[twice] - 1))
        width = int(p.max()) + 1
        passage = doc * width + p
        every = np.unique(np.stack([passage.astype("uint64"), h], 1), axis=0)
        passage, h = every[:, 0].astype("int64"), every[:, 1]
        _, place, size = np.unique(passage, return_inverse=True, return_counts=True)
        need = NEEDED[np.minimum(size, DOC_PASSAGE)][place]
        found = [np.zeros(0, "int64")]
        for k, (keys, of) in enumerate(zip(self.keys, self.of, strict=True)):
            use = need > k
            q, v = minima(h[use], passage[use], k)
            lo, hi = np.searchsorted(keys, v), np.searchsorted(keys, v, "right")
            n = hi - lo
            found.append(np.unique(np.repeat(q // width, n) * len(self.bounds) + of[expand(lo, n)]))
        return np.unique(np.concatenate(found))

    def aligned(self, item: int, near: Region, i: int, j: int, step: int, out: dict[int, int]) -> None:
        """Match the item's words from i on (backwards with step -1) with the region's words from j on; out: item place -> word place."""
        a, b = int(self.bounds[item]), int(self.bounds[item + 1])
        own, name, words, lo, hi = self.own, self.plain, near.words, near.lo, near.hi
        ahead_of = (REJOIN - 1) if step < 0 else 0
        skipped = 0
        while a <= i < b and lo <= j < hi and skipped <= REPLACED:
            if own[i] == words[j - lo]:
                out[i] = j
                i, j, skipped = i + step, j + step, 0
                continue
            if joint := self._joint(name, near, a, b, i, j, step):
                x, y, mine = joint
                out |= dict.fromkeys(mine, j)
                i, j, skipped = x, y, 0
                continue
            x, y = i + step, j + step
            # Words that are blacked out or left out: on with two words of the item, perhaps with another one left out between them.
            if gone := next((d for d in range(1, REPLACED) if self._goes_on(own, words, a, b, i + d * step, j, lo, hi, step)), 0):
                i, skipped = i + gone * step, 0
                continue
            if not (a <= x < b and lo <= y < hi and own[x] == words[y - lo]):
                # Words put in between, perhaps beside replaced ones: on with REJOIN words of the item in a row.
                best = None
                for d in range(REPLACED):
                    p = i + d * step - ahead_of
                    if not a <= p <= b - REJOIN:
                        break
                    for q in near.trigram(self.third[p]):
                        e = (q + ahead_of - j) * step
                        if 0 <= e <= GAP + d and (best is None or d + e < best[0]):
                            best = (d + e, i + d * step, q + ahead_of)
                if not best:
                    # Behind a header a word may be left out at once: the word beside it, then REJOIN words in a row.
                    p = i + 2 * step - ahead_of
                    for q in near.trigram(self.third[p]) if a <= p <= b - REJOIN else ():
                        k = q + ahead_of - step
                        for m in (k, k - step):
                            if 0 < (m - j) * step <= GAP and lo <= m < hi and words[m - lo] == own[i] and best is None:
                                best = (0, i, m)
                if best:
                    _, i, j = best
                    skipped = 0
                    continue
            i, j, skipped = x, y, skipped + 1

    @staticmethod
    def _goes_on(own: list[int], words: list[int], a: int, b: int, i: int, j: int, lo: int, hi: int, step: int) -> bool:
        y = j + step
        return a <= i < b and lo <= y < hi and own[i] == words[j - lo] and any(a <= i + k * step < b and own[i + k * step] == words[y - lo] for k in (1, 2))

    @staticmethod
    def _joint(name: list[str], near: Region, a: int, b: int, i: int, j: int, step: int) -> tuple[int, int, range] | None:
        """The places behind a word of one side that stands in two or three parts on the other, and the item's places in it."""
        whole, there = name[i], near.spelt(j)
        starts = str.startswith if step > 0 else str.endswith
        if starts(whole, there):
            one = there
            for n in (2, 3):
                k = j + (n - 1) * step
                if not near.lo <= k < near.hi:
                    break
                one = one + near.spelt(k) if step > 0 else near.spelt(k) + one
                if one == whole:
                    return i + step, j + n * step, range(i, i + step, step)
        elif starts(there, whole):
            one = whole
            for n in (2, 3):
                k = i + (n - 1) * step
                if not a <= k < b:
                    break
                one = one + name[k] if step > 0 else name[k] + one
                if one == there:
                    return i + n * step, j + step, range(i, i + n * step, step)
        return None

    def long_enough(self, item: int, matched: dict[int, int]) -> bool:
        """Whether at least MIN_WORDS words in a row have no more than one in eight unmatched, and no more than half of their telling ones.

        For each last word the longest such stretch is looked at, which begins where the running maximum first reaches what it needs.
        """
        at = np.array(sorted(matched))
        if 8 * len(at) < 7 * MIN_WORDS:
            return False
        # Over places of matched words: 8 * matched - 7 * span from one to a later one.
        n = np.arange(len(at))
        before, end = np.maximum.accumulate(7 * at - 8 * n), 8 * (n + 1) - 7 * (at + 1)
        begin = np.searchsorted(before, -end)
        last = np.flatnonzero(begin <= n)
        # Unmatched words at its ends make a shorter stretch MIN_WORDS long, if the item has them.
        first, after = (int(x) for x in self.bounds[item : item + 2])
        last = last[(8 * (last - begin[last] + 1) >= 7 * MIN_WORDS) & (after - first >= MIN_WORDS)]
        met = np.concatenate(([0], np.cumsum(self.telling[at])))
        within = np.concatenate(([0], np.cumsum(self.telling[first : int(at[-1]) + 1])))
        return bool((2 * (met[last + 1] - met[begin[last]]) >= within[at[last] + 1 - first] - within[at[begin[last]] - first]).any())

    def hopeful(self, item: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, trigrams: np.ndarray) -> np.ndarray:
        """Whether matched runs (n words from i and j on) may be part of a long enough alignment.

        The run is long itself, or another one follows, or enough words in the same places around the run agree, or on
        one side REJOIN words in a row do behind an insertion.
        """
        least = MIN_WORDS * 7 // 8 - 1
        ok = n > MIN_WORDS // 2
        # Two runs of one document and item that follow each other.
        order = np.lexsort((i, item, lo))
        x, y = order[:-1], order[1:]
        gap_i, gap_j = i[y] - i[x] - n[x], j[y] - j[x] - n[x]
        near = (item[x] == item[y]) & (lo[x] == lo[y]) & (gap_i <= MIN_WORDS) & (gap_j > -MIN_WORDS) & (gap_j <= GAP + MIN_WORDS)
        ok[x[near]] = ok[y[near]] = True
        rest = np.flatnonzero(~ok)
        for r in np.array_split(rest, len(rest) // 20000 + 1):
            a, b, low, high = self.bounds[item[r]], self.bounds[item[r] + 1], lo[r], hi[r]
            agree = n[r].copy()
            ends = ((i[r] - 1, j[r] - 1, -1), (i[r] + n[r], j[r] + n[r], 1))
            for p, q, s in ends:
                for k in range(MIN_WORDS):
                    x, y = p + s * k, q + s * k
                    fine = (x >= a) & (x < b) & (y >= low) & (y < high)
                    agree += fine & (self.words[np.where(fine, x, 0)] == words[np.where(fine, y, 0)])
            hit = agree >= least
            for p, q, s in ends:
                left = np.flatnonzero(~hit)
                back = REJOIN - 1 if s < 0 else 0
                for d in range(REPLACED):
                    x = p[left] + s * d - back
                    fine = (x >= a[left]) & (x + REJOIN <= b[left])
                    want = self.trigrams[np.where(fine, x, 0)]
                    y = (q[left] - back)[:, None] + s * np.arange(GAP + d + 1)[None]
                    inside = fine[:, None] & (y >= low[left][:, None]) & (y + REJOIN <= high[left][:, None])
                    inside[:, d] = False  # in the same place: counted above
                    hit[left] |= (inside & (trigrams[np.where(inside, y, 0)] == want[:, None])).any(1)
            ok[r] = hit
        return ok

    def pairs(self, reader: Words, b: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) of a piece of texts."""
        w, doc, spelt, code = reader.of(b, off)
        if not len(self.h) or len(w) < SHINGLE:
            return []
        h, at = placed_shingles(w, doc)
        use = self.known(h)
        if not len(use):
            return []
        h, at = h[use], at[use]
        d = doc[at]
        first = np.searchsorted(doc, np.arange(len(off)))
        wanted = self.candidates(h, d, at - first[d])
        if not len(wanted):
            return []
        # Exact places of the candidates' shingles.
        keep = ends_of_repeats(h, d) | np.concatenate(([True], np.diff(at) != 1))
        h, at, d = h[keep], at[keep], d[keep]
        lo, hi = np.searchsorted(self.h, h), np.searchsorted(self.h, h, "right")
        n = hi - lo
        e = expand(lo, n)
        key = np.repeat(d, n) * len(self.bounds) + self.item[e]
        p = np.searchsorted(wanted, key)
        mine = wanted[np.minimum(p, len(wanted) - 1)] == key
        key, i, j = key[mine], self.place[e[mine]], np.repeat(at, n)[mine]
        # Runs along a diagonal.
        order = np.lexsort((i, j - i, key))
        key, i, j = key[order], i[order], j[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1)
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(key))) + SHINGLE - 1
        key, i, j = key[start], i[start], j[start]
        # Exact containment: the distinct shingles of the item that the document has.
        got = np.unique(key)
        total = np.bincount(np.searchsorted(got, key), length - SHINGLE + 1)
        enough = total[np.searchsorted(got, key)] >= CONTAINMENT * PASSAGE
        key, i, j, length = key[enough], i[enough], j[enough], length[enough]
        if not len(key):
            return []
        text, item = key // len(self.bounds), key % len(self.bounds)
        good = self.hopeful(item, i, j, length, w, first[text], first[text + 1], shingles(w, REJOIN))
        out, done, seen, last = [], -1, {}, -1
        for r in np.flatnonzero(good).tolist():
            if key[r] == done:
                continue
            if key[r] != last:
                last, seen = key[r], {}
            at_i, at_j = int(i[r]), int(j[r])
            if seen.get(at_i) == at_j:
                continue  # on the way of an alignment that was not long enough
            x = int(item[r])
            # Words around the run, as far as the item can reach.
            reach = 2 * int(self.bounds[x + 1] - self.bounds[x]) + 2 * GAP
            near = Region(w, spelt, code, max(int(first[text[r]]), at_j - reach), min(int(first[text[r] + 1]), at_j + reach))
            matched: dict[int, int] = {}
            self.aligned(x, near, at_i, at_j, 1, matched)
            self.aligned(x, near, at_i - 1, at_j - 1, -1, matched)
            if self.long_enough(x, matched):
                out.append((int(text[r]), x))
                done = key[r]
            else:
                seen |= matched
        return out


def segments(text: str) -> list[str]:
    """A text as it is, or a long one in segments that overlap."""
    words = text.split() if len(text) > SEGMENT else []
    if len(words) <= SEGMENT:
        return [text]
    return [" ".join(words[k : k + SEGMENT]) for k in range(0, len(words) - OVERLAP, SEGMENT - OVERLAP)]


def prepared(items: DataFrame, classes: np.ndarray, contexts: int = CONTEXTS) -> DataFrame:
    """(item_id, text, telling): the items' segments with the hashes of their telling words.

    A telling word stands in few different contexts (the words on either side) over all items: a name is one, however
    many items repeat its passage. Words of a pattern stand beside other names each time.
    """
    shared = items.sparkSession.sparkContext.broadcast(classes)
    known = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()

    def run(batches):
        reader = Words(shared.value)
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cut = segments(text)
                rows = []
                for t in cut:
                    w = np.concatenate([reader.of(b, off)[0] for _, _, b, off in slices(pa.array([t], pa.large_string()))] or [np.zeros(0, "uint64")])
                    # At the ends of a text the context is its own: a formula at the end of many items has as many contexts.
                    edge = np.full(BESIDE, xxhash.xxh64_intdigest(t), "uint64")
                    padded = np.concatenate((edge, w, edge))
                    rows.append([{"word": a, "context": b} for a, b in zip(w.view("int64").tolist(), shingles(padded, 2 * BESIDE + 1).view("int64").tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(cut), pa.int64()), pa.array(cut), pa.array(rows, pa.list_(pa.struct([("word", pa.int64()), ("context", pa.int64())])))], ["item_id", "text", "words"])

    cut = written(known.mapInArrow(run, "item_id long, text string, words array<struct<word long, context long>>"), "leak-items")
    words = cut.select("item_id", F.xxhash64("text").alias("segment"), F.explode("words").alias("w")).select("item_id", "segment", "w.word", "w.context")
    few = words.groupBy("word", "context").agg(F.lit(1)).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") <= contexts).select("word")
    # At most the words of one segment.
    telling = words.select("item_id", "segment", "word").distinct().join(few, "word").groupBy("item_id", "segment").agg(F.collect_list("word").alias("telling"))
    return cut.select("item_id", "text", F.xxhash64("text").alias("segment")).join(telling, ["item_id", "segment"], "left").select("item_id", "text", "telling")


def blocks(items: DataFrame, size: int = BLOCK_BYTES) -> Iterator[tuple[list[int], list[str], list]]:
    """Ids, texts and telling words of up to size bytes of text, streamed to the driver one partition at a time."""
    out, held = ([], [], []), 0
    for r in items.toLocalIterator():
        if held and held + len(r["text"]) > size:
            yield out
            out, held = ([], [], []), 0
        for part, v in zip(out, r, strict=True):
            part.append(v)
        held += len(r["text"])
    if held:
        yield out


def leaks(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id): the documents that hold a passage of an item."""
    sc = docs.sparkSession.sparkContext
    classes = character_classes()
    known = prepared(items, classes)
    d = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    part = blocks(known, block_bytes)
    head, second = next(part, None), next(part, None)
    if head is None:
        return d.select("doc_id", F.col("doc_id").alias("item_id")).where(F.lit(False))
    if second is None:
        return _search(d, sc.broadcast((Items(*head, classes), classes))).distinct()
    # More blocks: documents without any shingle of the items drop out in one pass; a block is held only while it is searched.
    known = written(known, "leak-prepared")
    d = written(_with_shingles(d, known, classes, block_bytes), "leak-documents")
    found = None
    for b in blocks(known, block_bytes):
        shared = sc.broadcast((Items(*b, classes), classes))
        one = written(_search(d, shared), "leaks")
        shared.unpersist()
        found = one if found is None else found.union(one)
    return found.distinct()


def _search(docs: DataFrame, shared) -> DataFrame:
    def run(batches):
        index, classes = shared.value
        reader = Words(classes)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, b, off in slices(batch.column(1)):
                got = index.pairs(reader, b, off)
                if got:
                    text, item = np.array(got).T
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + text], pa.int64()), pa.array([index.ids[x] for x in item], pa.int64())], ["doc_id", "item_id"])

    return docs.mapInArrow(run, "doc_id long, item_id long")


#: Bits of the table of all items' shingles.
TABLE = 27


def _with_shingles(docs: DataFrame, items: DataFrame, classes: np.ndarray, block_bytes: int) -> DataFrame:
    table = np.zeros(1 << TABLE, bool)
    reader = Words(classes)
    for _, texts, _ in blocks(items, block_bytes):
        for _, _, b, off in slices(pa.array(texts, pa.large_string())):
            w, text, _, _ = reader.of(b, off)
            table[placed_shingles(w, text)[0] >> np.uint64(64 - TABLE)] = True
    shared = docs.sparkSession.sparkContext.broadcast((np.packbits(table), classes))

    def run(batches):
        bits, classes = shared.value
        reader, table = Words(classes), np.unpackbits(bits).view(bool)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, _, b, off in slices(batch.column(1)):
                w, text, _, _ = reader.of(b, off)
                h, at = placed_shingles(w, text)
                keep[i + text[at[table[h >> np.uint64(64 - TABLE)]]]] = True
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, "doc_id long, text string")
