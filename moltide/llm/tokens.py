"""Exact byte-pair encoding of a whole corpus with a public vocabulary, and decoding (problem 6).

A batch of texts is cut into pretokens by array operations on its UTF-8 bytes; each distinct pretoken of a
batch is encoded once by the backtracking encoder: it takes the longest token at each place (Aho-Corasick
trie), checks with the pair-compatibility table that merging would indeed keep the two tokens apart, and
backs up to a shorter token where not. That gives the ids of the merge procedure in linear time.
Decoding reads the tokens' bytes through a table of offsets.

The vocabulary file is a parameter; it is read on the driver and broadcast (of fixed size: one vocabulary).
There is no shuffle: texts stay in the partition they are read in. Batches are cut by bytes of text, so very long
texts take no more room than they need.

Defined results: null and empty texts give the empty list; texts are taken as they are; repeated rows give
repeated rows; an empty table gives an empty one; other columns than id and text are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text that are worked at once, and distinct pretokens remembered from batch to batch.
SLICE_BYTES, REMEMBERED = 4 << 20, 400_000

LETTER, DIGIT, OTHER, SPACE = 0, 1, 2, 3


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Token bytes by id."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    found = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [found[i] for i in range(len(found))]


def splits(tokens: list[bytes]) -> np.ndarray:
    """(n, 2): the two tokens whose merge made each token; a single byte is split into itself twice."""
    ids = {t: i for i, t in enumerate(tokens)}
    out = np.zeros((len(tokens), 2), "int32")
    for i, t in enumerate(tokens):
        if len(t) == 1:
            out[i] = i
            continue
        parts = [ids[t[k : k + 1]] for k in range(len(t))]
        while len(parts) > 2:
            ranks = [ids.get(tokens[a] + tokens[b], i) for a, b in zip(parts, parts[1:], strict=False)]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] >= i:
                raise ValueError(f"token {i} is not the merge of two earlier tokens")
            parts[k : k + 2] = [ranks[k]]
        out[i] = parts
    return out


class Encoder:
    """Backtracking encoder of single pretokens."""

    def __init__(self, tokens: list[bytes], split: np.ndarray):
        self.tokens, self.left, self.right = tokens, split[:, 0].tolist(), split[:, 1].tolist()
        self.length = [len(t) for t in tokens]
        self.widest = max(self.length)  # very long words are looked at in a window
        self.pairs = {(a, b): i for i, (a, b) in enumerate(split.tolist()) if self.length[i] > 1}
        self.trie = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.trie.add_word(t.decode("latin-1"), i)
        self.ids = {t: i for i, t in enumerate(tokens)}
        # The longest token that is a proper prefix of a token, -1 if there is none.
        self.shorter: dict[int, int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}

    def _shorter(self, t: int) -> int:
        if (s := self.shorter.get(t)) is None:
            b = self.tokens[t][:-1]
            n = self.trie.longest_prefix(b.decode("latin-1")) if b else 0
            while n and b[:n] not in self.ids:
                n -= 1
            s = self.shorter[t] = self.ids[b[:n]] if n else -1
        return s

    def _longest(self, text: str, at: int) -> int:
        n = self.trie.longest_prefix(text[at:])
        while (t := self.trie.get(text[at : at + n], -1)) < 0:
            n -= 1
        return t

    def _fit(self, a: int, b: int) -> bool:
        """Whether merging leaves b after a as they are: no earlier merge joins a part of a with a part of b."""
        if (known := self.compatible.get((a, b))) is not None:
            return known
        key, limit, left, right = (a, b), len(self.tokens), self.left, self.right
        while True:
            if self.pairs.get((a, b), limit) < limit:
                good = False
                break
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        good = True
                        break
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        good = True
                        break
        if len(self.compatible) > 1_000_000:
            self.compatible.clear()
        self.compatible[key] = good
        return good

    def encode(self, word: bytes) -> list[int]:
        if (whole := self.ids.get(word)) is not None:
            return [whole]
        text, out, at, n = word.decode("latin-1"), [], 0, len(word)
        open_ = bytearray(b"\1") * (n + 1)
        token = self._longest(text[: self.widest], 0)
        while True:
            end = at + self.length[token]
            if open_[end] and (not out or self._fit(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = self._longest(text[at : at + self.widest], 0)
            elif (s := self._shorter(token)) >= 0:
                token = s
            else:
                open_[at] = 0
                token = out.pop()
                at -= self.length[token]


def character_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space, other."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    table = np.full(0x110000, OTHER, "uint8")
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    return table


def pretoken_starts(b: np.ndarray, docs: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte positions at which pretokens begin, by the usual pattern of byte-level vocabularies:

    '(?:[sdmt]|ll|ve|re)| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    b: UTF-8 bytes of texts laid end to end; docs: the positions where texts begin. Empty input gives no positions.
    """
    n = len(b)
    kind = classes[b]  # right for ASCII, which is most
    head = (b & 0xC0) != 0x80
    lead = np.flatnonzero(b >= 0xC0)
    if len(lead):
        p = np.concatenate((b, np.zeros(3, "uint8"))).astype("uint32")
        b0, b1, b2, b3 = (p[lead + k] for k in range(4))
        point = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1 & 63, np.where(b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
        own = classes[point]
        kind[lead] = own
        width = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        for k in (1, 2, 3):
            has = width > k
            kind[lead[has] + k] = own[has]
    first = np.zeros(n, bool)
    first[docs] = True
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # A run after white space takes one plain blank with it; any other last white space stands alone.
    after = np.flatnonzero(start & (kind != SPACE) & ~first)
    after = after[kind[after - 1] == SPACE]
    blank = b[after - 1] == 0x20
    start[after[blank]] = False
    last = after - 1
    while (more := ~head[last]).any():
        last = last - more
    start[last] = True
    # 's 'd 'm 't 'll 've 're after anything but a blank.
    q = np.flatnonzero((b == 0x27) & start)
    q = q[q + 1 < n]
    q = q[(kind[q + 1] == LETTER) & ~first[q + 1]]
    if len(q):
        p = np.concatenate((b, np.zeros(2, "uint8")))
        fp = np.concatenate((first, np.ones(2, bool)))
        c1, c2 = p[q + 1], p[q + 2]
        one = np.isin(c1, np.frombuffer(b"sdmt", "uint8"))
        two = ~fp[q + 2] & (((c1 == 0x6C) & (c2 == 0x6C)) | ((c1 == 0x76) & (c2 == 0x65)) | ((c1 == 0x72) & (c2 == 0x65)))
        for hit, w in ((one, 2), (two & ~one, 3)):
            at = q[hit]
            start[at + 1] = False
            end = at + w
            end = end[end < n]
            start[end] |= kind[end] == LETTER
    return np.flatnonzero(start)


class BatchEncoder:
    """Encodes Arrow arrays of texts; remembers the ids of pretokens."""

    def __init__(self, tokens: list[bytes], split: np.ndarray, classes: np.ndarray):
        self.encoder, self.classes, self.known = Encoder(tokens, split), classes, {}

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, pa.ListArray]]:
        """(from, to, ids) for pieces of the array."""
        texts = pa.array(texts.cast(pa.large_string()).fill_null(""))
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, "int64")[texts.offset : texts.offset + len(texts) + 1]
        every = np.frombuffer(data, "uint8") if data else np.zeros(0, "uint8")
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
            yield i, j, self._piece(every[off[i] : off[j]], off[i : j + 1] - off[i])
            i = j

    def _piece(self, b: np.ndarray, off: np.ndarray) -> pa.ListArray:
        if not len(b):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(off), "int32")), pa.array([], pa.int32()))
        docs = off[:-1][np.diff(off) > 0]
        starts = pretoken_starts(b, docs, self.classes)
        ends = np.append(starts, len(b)).astype("int32")
        words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(b)])
        coded = words.dictionary_encode()
        ids, known = [], self.known
        for w in coded.dictionary.to_pylist():
            if (found := known.get(w)) is None:
                found = self.encoder.encode(w)
                if len(w) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = found
            ids.append(found)
        index = coded.indices.to_numpy()
        size = np.fromiter(map(len, ids), "int64", len(ids))
        flat = np.fromiter((t for x in ids for t in x), "int32", int(size.sum()))
        begin = np.cumsum(size) - size
        count = size[index]
        total = np.concatenate(([0], np.cumsum(count)))
        place = np.repeat(begin[index] - total[:-1], count) + np.arange(total[-1])
        lists = total[np.searchsorted(starts, off)].astype("int32")
        return pa.ListArray.from_arrays(pa.array(lists), pa.array(flat[place]))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids ARRAY<INT>) of each row."""
    tokens = read_vocabulary(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, splits(tokens), character_classes()))
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        work = BatchEncoder(*shared.value)
        for batch in batches:
            ids = batch.column(0)
            for i, j, found in work.encode(batch.column(1)):
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), found], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


class Decoder:
    """Ids to text through one string of all tokens' bytes and its offsets."""

    def __init__(self, tokens: list[bytes]):
        self.bytes = np.frombuffer(b"".join(tokens), "uint8")
        self.offset = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))

    def decode(self, lists: pa.ListArray) -> pa.Array:
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        size = self.offset[flat + 1] - self.offset[flat]
        total = np.concatenate(([0], np.cumsum(size)))
        place = np.repeat(self.offset[flat] - total[:-1], size) + np.arange(total[-1])
        ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
        data = self.bytes[place]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(total[ends].astype("int64")), pa.py_buffer(data)]).cast(pa.large_string())


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the texts of encoded rows; a null list gives the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = dict(encoded.dtypes)[id_col]

    def run(batches):
        work = Decoder(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), work.decode(batch.column(1)).cast(pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, text string")
