"""Exact substring removal by distributed prefix doubling on sampled suffixes (operator 6).

Full prefix doubling sorts a rank pair for every byte in every round, dozens of times the input. Here only suffixes that every
long repeat must contain are sorted: a window of ``LENGTH`` bytes is represented by its anchor, the ``GRAM`` bytes in it with
the least hash, so equal windows have equal anchors. Ranks are names (96 to 128 bits of hash) of growing prefixes around an anchor:

1. GRAM bytes: positions whose name no other document has are unique and leave. In the same shuffle, where all windows of an
   anchor together (LENGTH to 2 * LENGTH - GRAM bytes) have the name of a smaller document's, all of them repeat: decided.
2. HALF more bytes to the left, and HALF more to the right: a window of LENGTH bytes holds one of the two, so an anchor whose
   both names are unique among the undecided leaves.
3. LENGTH bytes, the threshold: the windows of what is left, in the smallest document of each name.

The smallest document of every name decides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.llm.common import BROADCAST_ROWS, chunks, mix, written

LENGTH, GRAM = 50, 16
STARTS = LENGTH - GRAM + 1
HALF = (LENGTH - GRAM) // 2
CHUNK = 200_000
_TAG = (1 << 20) - 1


def words_at(data: bytes) -> np.ndarray:
    """The eight bytes from every position on, as a number; the last positions are padded with zeros."""
    n = len(data)
    padded = data + bytes(16)
    out = np.empty(n + 8, np.uint64)
    for k in range(8):
        part = np.frombuffer(padded, "<u8", count=(n + 8 - k + 7) // 8, offset=k)
        out[k::8] = part[: len(out[k::8])]
    return out[:n] if n else np.zeros(0, np.uint64)


def anchors(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first start, last start) of every run of windows with one anchor, as positions in the joined texts."""
    n = len(words)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 4
    name = mix(words[: n - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15) + mix(words[8 : 8 + n - GRAM + 1]))
    least = name & ~np.uint64(63)  # the low bits count how far behind the start the least name lies; the first one wins
    reach = 1
    while reach < STARTS:
        step = min(reach, STARTS - reach)
        least = np.minimum(least[: len(least) - step], least[step:] + np.uint64(step))
        reach += step
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - LENGTH + 1, 0))
    whole = np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(sizes - LENGTH + 1, 0)) - np.maximum(sizes - LENGTH + 1, 0), np.maximum(sizes - LENGTH + 1, 0)) + starts[text]
    at = whole + (least[whole] & np.uint64(63)).astype(np.int64)
    new = np.ones(len(whole), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(whole)) - 1
    return text[first], at[first], whole[first], whole[last]


def gram_names(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(words[at] * np.uint64(0x9E3779B97F4A7C15) + mix(words[at + 8]))


def range_names(words: np.ndarray, start: np.ndarray, stop: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Names of the bytes from start to stop (eight at least); equal bytes with equal salt have equal names."""
    out = mix(salt + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for k in range(0, int((stop - start).max(initial=0)), 8):
        out = mix(out * np.uint64(0xA0761D6478BD642F) + words[np.minimum(start + k, stop - 8)])
    return out


def side_names(words: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """16 bits of the name of the HALF bytes left of each anchor, and 16 of those right of it, in one number.

    Where the anchor's windows do not reach so far, no window holds those bytes and the name is of what they reach.
    """
    left = range_names(words, np.maximum(at - HALF, first), at + GRAM, np.full(len(at), 3, np.uint64))
    right = range_names(words, at, np.minimum(at + GRAM + HALF, last + LENGTH), np.full(len(at), 5, np.uint64))
    return ((left >> np.uint64(48)) << np.uint64(16) | right >> np.uint64(48)).astype(np.uint32).view(np.int32)


def tag(data: bytes) -> int:
    """Tells different texts of one id apart."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=3).digest(), "little") & _TAG


def _batches(batches):
    for batch in batches:
        data = [t.encode() for t in batch["text"]]
        for first, last in chunks(np.array([len(b) + 1 for b in data]), CHUNK):
            yield batch.iloc[first:last], data[first:last]


def _sampled(batches):
    for batch, data in _batches(batches):
        words, sizes = words_at(b"".join(data)), np.array([len(b) for b in data], np.int64)
        text, at, first, last = anchors(words, sizes)
        begin = (np.cumsum(sizes) - sizes)[text]
        tags = np.array([tag(b) for b in data], np.int64)
        where = ((at - first) << 8 | (last - first)).astype(np.uint64)
        yield pd.DataFrame(
            {
                "h": gram_names(words, at).view(np.int64),
                "u": range_names(words, first, last + LENGTH, where).view(np.int64),
                "sides": side_names(words, at, first, last),
                "doc": batch["doc"].to_numpy()[text],
                "at": (first - begin) << 32 | (at - first) << 26 | (last - first) << 20 | tags[text],
            }
        )


def _windows(batches):
    """Names of the windows of undecided anchors. A row: doc, text, its undecided places."""
    for batch, data in _batches(batches):
        words, sizes = words_at(b"".join(data)), np.array([len(b) for b in data], np.int64)
        begin = np.cumsum(sizes) - sizes
        counts = np.array([len(x) for x in batch["places"]])
        place = np.concatenate([np.asarray(x, np.int64) for x in batch["places"]])
        text = np.repeat(np.arange(len(data)), counts)
        mine = (place & _TAG) == np.array([tag(b) for b in data], np.int64)[text]
        place, text = place[mine], text[mine]
        many = ((place >> 24) & 0xFF) + 1
        own = np.repeat(np.arange(len(place)), many)
        start = (place >> 32)[own] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = start + begin[text[own]]
        first = range_names(words, at, at + LENGTH, np.zeros(len(at), np.uint64))
        yield pd.DataFrame(
            {"w": first.view(np.int64), "x": (range_names(words, at, at + LENGTH, np.ones(len(at), np.uint64)) >> np.uint64(33)).astype(np.int32), "doc": batch["doc"].to_numpy()[text[own]], "at": start << 32 | place[own] & _TAG}
        )


def spans(docs: DataFrame) -> DataFrame:
    """(doc, at): at packs start << 32 | (windows - 1) << 24 | tag of 20 bits; bytes start to start + windows - 1 + LENGTH repeat. Written.

    docs: doc (not null), text (not null).
    """
    rows = docs.mapInPandas(_sampled, "h long, u long, sides int, doc long, at long")
    several = lambda *by: F.min("u").over(Window.partitionBy("h", *by)) < F.max("u").over(Window.partitionBy("h", *by))
    ranked = rows.repartition("h").withColumn("repeats", F.min("doc").over(Window.partitionBy("h", "u")) < F.col("doc"))
    ranked = ranked.withColumn("several", several()).where("repeats or several")
    ranked = ranked.select("h", "u", "doc", "at", "repeats", F.shiftright("sides", 16).alias("left"), F.col("sides").bitwiseAND(65535).alias("right"))
    ranked = ranked.withColumn("in_left", several("left")).withColumn("in_right", several("right"))
    start, before, windows = F.shiftright("at", 32), F.shiftright("at", 26).bitwiseAND(63), F.shiftright("at", 20).bitwiseAND(63) + 1
    # Windows that begin HALF bytes or more before the anchor hold its left side, the others its right side.
    skip = F.when(F.col("repeats") | F.col("in_left"), F.lit(0)).otherwise(F.greatest(before - HALF + 1, F.lit(0)))
    some = F.when(F.col("repeats") | F.col("in_right"), windows).otherwise(F.least(before - HALF + 1, windows)) - skip
    packed = F.shiftleft(start + skip, 32) + F.shiftleft(some - 1, 24) + F.col("at").bitwiseAND(_TAG)
    told = ranked.where("repeats or in_left or in_right").where(some > 0).select("doc", packed.alias("at"), "repeats")
    told = written(told, "suffix-anchors")
    open_ = told.where("not repeats").groupBy("doc").agg(F.collect_list("at").alias("places"))
    few = told.where("not repeats").count() <= BROADCAST_ROWS // 4
    texts = docs.join(F.broadcast(open_) if few else open_, "doc")
    last = texts.mapInPandas(_windows, "w long, x int, doc long, at long")
    last = last.repartition("w").withColumn("least", F.min("doc").over(Window.partitionBy("w", "x"))).where("least < doc").select("doc", "at")
    return told.where("repeats").select("doc", "at").union(written(last, "suffix-windows"))


def kept_bytes(data: bytes, places) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the spans, and the removed runs."""
    mine = np.unique(np.asarray(places, np.int64)) if places is not None else np.zeros(0, np.int64)
    mine = mine[(mine & _TAG) == tag(data)] if len(mine) else mine
    if not len(mine):
        return data, []
    start = mine >> 32
    stop = np.maximum.accumulate(start + ((mine >> 24) & 0xFF) + LENGTH)
    new = np.append(True, start[1:] > stop[:-1])
    runs = list(zip(start[new].tolist(), stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)].tolist()))
    edges = [0, *[e for r in runs for e in r], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])), runs


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kept (binary: the text's bytes without repeats), removed array<struct<start, stop>>, n_bytes.

    A byte goes if a string of LENGTH bytes around it also starts in a document with a smaller key. A null text is empty. Rows
    with one key are not smaller than each other, so repeated rows lose the same bytes. Rows with a null key lose nothing and
    take nothing. Every row gets a row; other columns are ignored.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = spans(rows.where("doc is not null")).groupBy("doc").agg(F.collect_list("at").alias("places"))
    both = rows.join(found, "doc", "left").withColumn("doc", F.col("doc").cast("string"))  # pandas would make doubles of longs with nulls

    def run(batches):
        for batch, data in _batches(batches):
            out = [kept_bytes(b, p) for b, p in zip(data, batch["places"])]
            yield pd.DataFrame({"doc": batch["doc"], "kept": [k for k, _ in out], "removed": [[{"start": a, "stop": b} for a, b in r] for _, r in out], "n_bytes": [len(b) for b in data]})

    out = both.mapInPandas(run, "doc string, kept binary, removed array<struct<start:long,stop:long>>, n_bytes long")
    return out.select(F.col("doc").cast(kind).alias(key), "kept", "removed", "n_bytes")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    out = without_repeats(docs)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
