"""Words and sentences of Arrow batches of texts by array operations; shared by the text operators."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from moltide.llm.tokens import DIGIT, LETTER, OTHER, SPACE

#: Bytes of text that are worked at once.
SLICE_BYTES = 4 << 20


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, UTF-8 bytes, offsets of the texts in them and their end) for pieces of an array; null counts as empty."""
    texts = pa.array(texts.cast(pa.large_string()).fill_null(""))
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, "int64")[texts.offset : texts.offset + len(texts) + 1]
    every = np.frombuffer(data, "uint8") if data else np.zeros(0, "uint8")
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, every[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def byte_kinds(b: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of the character each byte belongs to."""
    kind = classes[b]
    lead = np.flatnonzero(b >= 0xC0)
    if len(lead):
        p = np.concatenate((b, np.zeros(3, "uint8"))).astype("uint32")
        b0, b1, b2, b3 = (p[lead + k] for k in range(4))
        own = classes[np.where(b0 < 0xE0, (b0 & 31) << 6 | b1 & 63, np.where(b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))]
        kind[lead] = own
        width = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        for k in (1, 2, 3):
            has = width > k
            kind[lead[has] + k] = own[has]
    return kind


def unbroken(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts without soft hyphens and without hyphens at the end of a line inside a word; every line end is LF."""
    cr = np.flatnonzero(b == 0x0D)
    if len(cr):
        b = b.copy()
        after = np.append(b, 0)[cr + 1]
        b[cr] = 0x0A
        drop = np.zeros(len(b), bool)
        drop[cr[(after == 0x0A) & ~np.isin(cr + 1, off)]] = True
        b, off = b[~drop], off - np.concatenate(([0], np.cumsum(drop)))[off]
    n = len(b)
    p = np.concatenate((b, np.zeros(2, "uint8")))
    low = (b >= 0x61) & (b <= 0x7A) | (b >= 0x80)
    drop = np.zeros(n, bool)
    h = np.flatnonzero((b == 0x2D) & (p[1 : n + 1] == 0x0A))
    h = h[(h > 0) & (h + 2 < n)]
    h = h[low[h - 1] & low[h + 2]]
    drop[h] = drop[h + 1] = True
    s = np.flatnonzero((b == 0xC2) & (p[1 : n + 1] == 0xAD))
    drop[s] = drop[s + 1] = True
    if not drop.any():
        return b, off
    gone = np.concatenate(([0], np.cumsum(drop)))
    return b[~drop], off - gone[off]


def asides(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mask of bytes in round brackets, each up to the next closing one of the same text; brackets that don't close hold nothing."""
    left, right = np.flatnonzero(b == 0x28), np.flatnonzero(b == 0x29)
    edge = np.zeros(len(b) + 1, "int32")
    if len(left) and len(right):
        to = right[np.minimum(np.searchsorted(right, left), len(right) - 1)]
        ok = (to > left) & (np.searchsorted(off, to, "right") == np.searchsorted(off, left, "right"))
        np.add.at(edge, left[ok], 1)
        np.add.at(edge, to[ok] + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def word_spans(kind: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of letters."""
    letter = kind == LETTER
    first = np.zeros(len(kind), bool)
    first[docs[docs < len(kind)]] = True
    prev = np.concatenate(([False], letter[:-1])) & ~first
    start = np.flatnonzero(letter & ~prev)
    nxt = np.concatenate((letter[1:], [False])) & ~np.concatenate((first[1:], [True]))
    return start, np.flatnonzero(letter & ~nxt) + 1


def fold(word: bytes) -> str:
    """A word without case and compatibility forms."""
    return unicodedata.normalize("NFKC", word.decode("utf-8")).casefold()


def coded(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each word's spelling, the distinct spellings with ASCII in lower case)."""
    size = (end - start).astype("int64")
    total = np.concatenate(([0], np.cumsum(size)))
    place = np.repeat(start - total[:-1], size) + np.arange(total[-1])
    text = b[place]
    text = np.where((text >= 0x41) & (text <= 0x5A), text + 32, text).astype("uint8")
    d = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(total.astype("int32")), pa.py_buffer(text)]).dictionary_encode()
    return d.indices.to_numpy(), d.dictionary.to_pylist()


__all__ = ["DIGIT", "LETTER", "OTHER", "SPACE", "asides", "byte_kinds", "coded", "fold", "slices", "unbroken", "word_spans"]
