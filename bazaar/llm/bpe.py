"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding (operator 5).

A text becomes an array of code points and that an array of character classes. Where a contraction such as ``'s`` may begin
depends on the characters before it, so every character stands for a function of a four-state automaton; functions are
packed into one byte and composed by an associative doubling scan, which needs no regular expression and no loop over
characters. The slices between the boundaries go to a merge cache.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import chunks, keyed, unkeyed

LETTER, NUMBER, OTHER, BLANK, SPACE, SHORT, LONG, END = range(8)
# Fixed values: \s of the pattern, and letters and numbers newer than Python's own Unicode tables.
WHITE_SPACE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Pieces that a worker keeps merged; beyond it the cache starts anew.
CACHE = 250_000
CHUNK = 300_000
NONE = 2**31 - 1

# States before a character: 0 a contraction may begin, 1 an apostrophe would join what stands before it,
# 2 and 3: one or two letters of a contraction are left.
_STEP = np.zeros((8, 4), np.uint8)
_STEP[LETTER] = (0, 0, 0, 2)
_STEP[OTHER] = _STEP[BLANK] = 1
_STEP[SHORT] = (2, 1, 1, 1)
_STEP[LONG] = (3, 1, 1, 1)
_PACK = np.array([1, 4, 16, 64], np.uint16)
_FUNCTION = (_STEP * _PACK).sum(1).astype(np.uint8)


@lru_cache(None)
def _compositions() -> tuple[np.ndarray, np.ndarray]:
    """[later * 256 + earlier] -> composed function; [function] -> is it constant."""
    parts = (np.arange(256)[:, None] >> (2 * np.arange(4))) & 3
    composed = (parts[:, parts] * _PACK).sum(-1).astype(np.uint8)
    return composed.reshape(-1), (parts == parts[:, :1]).all(1)


@lru_cache(None)
def classes() -> np.ndarray:
    """Class of every code point; one more marks the end of a text."""
    kind = np.full(0x110001, OTHER, np.uint8)
    for i in range(0x110000):
        major = unicodedata.category(chr(i))[0]
        if major == "L":
            kind[i] = LETTER
        elif major == "N":
            kind[i] = NUMBER
    for ranges, value in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER), (WHITE_SPACE, SPACE)):
        for first, last in ranges:
            kind[first : last + 1] = value
    kind[0x20], kind[0x110000] = BLANK, END
    return kind


def boundaries(points: np.ndarray) -> np.ndarray:
    """True where a piece begins. points: code points; 0x110000 ends each text (and is a piece of its own)."""
    n = len(points)
    kind = classes()[points]
    after = np.full(n + 2, END, np.uint8)
    after[:n] = kind
    letter = np.full(n + 2, 0, np.uint32)
    letter[:n] = points
    quote = np.flatnonzero(points == 0x27)
    one, two = letter[quote + 1], letter[quote + 2]
    short = np.isin(one, np.array([ord(c) for c in "stmd"]))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    kind[quote[short]], kind[quote[long]] = SHORT, LONG
    composed, constant = _compositions()
    function, reach = _FUNCTION[kind], 1
    if n:
        function[0] = np.uint8(int(function[0] & 3) * 85)  # the first character meets state 0
    while reach < n and not constant[function].all():
        function[reach:] = composed[function[reach:].astype(np.uint16) * np.uint16(256) + function[:-reach]]
        reach *= 2
    before = np.zeros(n, np.uint8)
    before[1:] = function[:-1] & 3
    kind[(kind == SHORT) | (kind == LONG)] = OTHER
    white = (kind == BLANK) | (kind == SPACE)
    previous = np.full(n, END, np.uint8)
    previous[1:] = kind[:-1]
    ended = np.zeros(n, bool)  # the letter before closed a contraction
    ended[1:] = (kind[:-1] == LETTER) & (before[:-1] == 2)
    same = (kind == previous) | white & ((previous == BLANK) | (previous == SPACE))
    start = ~same | ended
    start &= (previous != BLANK) | white | (kind == END)
    start &= (before < 2) | (kind != LETTER)
    follows = after[1 : n + 1]
    start |= white & (follows != BLANK) & (follows != SPACE) & (follows != END)
    return start | (kind == END) | (previous == END)


class Pairs:
    """Which two tokens join into which: a hash table in arrays, probed linearly, for many pairs at once."""

    BITS = 20

    def __init__(self, ranks: dict[bytes, int]):
        found = {(x << 32) | y: r for t, r in ranks.items() for i in range(1, len(t)) if (x := ranks.get(t[:i])) is not None and (y := ranks.get(t[i:])) is not None}
        keys, values = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found))
        self.keys, self.values = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, NONE, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several, the last one stays
            set_ = self.keys[at] == keys
            self.values[at[set_]] = values[set_]
            keys, values, at = keys[~set_], values[~set_], (at[~set_] + 1) & ((1 << self.BITS) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the joined token, or NONE; a negative token joins nothing."""
        keys = (x.astype(np.int64) << 32) | y.astype(np.int64)
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((x >= 0) & (y >= 0))
        at = self._slot(keys[todo])
        while len(todo):
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (there >= 0)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.BITS) - 1)
        return out


class Merger:
    """Merges pieces by rank, many at a time; results are kept per piece, as the bytes of 32-bit ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pairs = Pairs(self.ranks)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The cache, which then has all these pieces."""
        new = list(set(pieces).difference(self.cache))
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            data = piece.encode()
            if data in self.ranks:
                self.cache[piece] = self.ranks[data].to_bytes(4, "little")
            else:
                by_size.setdefault(min(-(-len(data) // 8) * 8, 72), []).append((piece, data))
        for size, group in by_size.items():
            for i in range(0, len(group), 20_000):
                some = group[i : i + 20_000]
                found = self._short([d for _, d in some], size) if size <= 64 else [self._long(d) for _, d in some]
                self.cache.update(zip([p for p, _ in some], found))
        return self.cache

    def _short(self, data: list[bytes], size: int) -> list[bytes]:
        """One round merges the best pair of every piece; pieces are rows, padded to ``size`` bytes."""
        n, columns = len(data), np.arange(size)
        lengths = np.array([len(d) for d in data])
        rows = np.frombuffer(b"".join(d.ljust(size, b"\0") for d in data), np.uint8).reshape(n, size)
        tokens = np.full((n, size + 1), -1, np.int32)
        tokens[:, :size] = np.where(columns < lengths[:, None], self.byte[rows], -1)
        rank = self.pairs(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, size)
        rank = np.concatenate([rank, np.full((n, 1), NONE, np.int32)], axis=1)
        live = np.arange(n)
        while len(live):
            best = rank[live].argmin(1)
            live, best = (x[rank[live, best] < NONE] for x in (live, best))
            if not len(live):
                break
            t, r = tokens[live], rank[live]
            k = np.arange(len(live))
            joined = r[k, best]
            shift = np.minimum(np.arange(size + 1) + (np.arange(size + 1) > best[:, None]), size)
            t, r = np.take_along_axis(t, shift, 1), np.take_along_axis(r, shift, 1)
            t[k, best] = joined
            r[k, best] = self.pairs(joined, t[k, np.minimum(best + 1, size)])
            left = np.flatnonzero(best)
            r[left, best[left] - 1] = self.pairs(t[left, best[left] - 1], joined[left])
            tokens[live], rank[live] = t, r
        flat, ends = tokens[tokens >= 0].astype("<i4").tobytes(), np.cumsum(4 * (tokens >= 0).sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _long(self, data: bytes) -> bytes:
        """The same for one piece, with a heap and linked neighbours: n log n at any length."""
        parts: list = [data[i : i + 1] for i in range(len(data))]
        ranks, n = self.ranks, len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = right[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j], right[i] = None, right[j]
            if right[j] < n:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return np.array([ranks[p] for p in parts if p is not None], "<i4").tobytes()


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


def encode_texts(texts: list[str], path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, code point at which each piece of the text begins) for every text, in order."""
    merge = merger(path)
    for first, last in chunks(np.array([len(t) + 1 for t in texts]), CHUNK):
        some = texts[first:last]
        joined = "\0".join(some) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in some]) - 1
        points[ends] = 0x110000
        starts = np.flatnonzero(boundaries(points))
        stop = np.searchsorted(starts, ends)
        edge = starts.tolist()
        get, begin = merge.cache.get, 0
        found = [get(joined[x:y]) for x, y in zip(edge, edge[1:])]
        missing = [i for i, x in enumerate(found) if x is None]
        pieces = [joined[edge[i] : edge[i + 1]] for i in missing]
        learnt = merge.learn(pieces)
        for i, piece in zip(missing, pieces):
            found[i] = learnt[piece]
        for k, end in enumerate(stop.tolist()):
            ids = np.frombuffer(b"".join(found[begin:end]), "<i4")
            offset = 0 if k == 0 else int(ends[k - 1]) + 1
            yield ids, (starts[begin:end] - offset).astype(np.int32)
            begin = end + 1


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """key, ids array<int>, offsets array<int>: the tokens of each whole text and where its pieces begin (code points).

    path: a file of ranks that every executor has. A null text is empty and has no tokens. Repeated keys, ties and
    repeated rows give a row each; other columns are ignored. A text of any length is encoded whole. With ``decoded`` a
    column of that name holds the bytes that the ids stand for.
    """

    def run(batches):
        byte = decoder(path) if decoded else None
        for batch in batches:
            texts, keys = batch["text"].tolist(), batch["key"]
            for first, last in chunks(np.array([len(t) + 1 for t in texts]), CHUNK):
                out = list(encode_texts(texts[first:last], path))
                frame = {"key": keys.iloc[first:last], "ids": [x[0] for x in out], "offsets": [x[1] for x in out]}
                if decoded:
                    frame["decoded"] = [b"".join(map(byte, x[0].tolist())) for x in out]
                yield pd.DataFrame(frame)
        merger(path).cache = {}  # an idle worker keeps no more than the vocabulary

    schema = "key string, ids array<int>, offsets array<int>" + ", decoded binary" * decoded
    return unkeyed(keyed(docs, key, text).mapInPandas(run, schema), docs, key)


def decoder(path: str):
    """From an id to its bytes."""
    return {v: k for k, v in merger(path).ranks.items()}.__getitem__


def decode(ids: Column, path: str) -> Column:
    """The bytes that token ids stand for; null for null, empty for none. An id outside the vocabulary is an error."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        byte = decoder(path)
        for batch in batches:
            yield pd.Series([None if x is None else b"".join(map(byte, x.tolist())) for x in batch], index=batch.index, dtype=object)

    return run(ids)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_pieces of every document."""
    return encode(docs, path, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.size("offsets").cast("long").alias("n_pieces"),
    )
