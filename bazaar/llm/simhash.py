"""SimHash near-duplicates by a self-join of the binary trie of fingerprints (operator 7).

Two fingerprints at most four bits apart differ in at most two of the upper 32 bits, or in at most one of the lower 32. So
the trie is joined with itself twice, once per half first: node pairs go down together, add up differing bits and die when
the budget of the half or of the whole is gone. Spark cuts the trie into blocks of at most ``BLOCK`` neighbouring
fingerprints; a pair of blocks is one row, so the work of a row is bounded however many documents resemble each other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import components, keyed, unkeyed, written

WORDS, SEED, BITS, HALF = 4, 42, 4, 32
BLOCK = 2048
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str) -> int:
    """Majority of every bit over the hashes of the text's word shingles, repeats included; 0 without words."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    size = min(WORDS, len(words))
    stops = ends[size - 1 :] - 1
    starts = np.concatenate([[0], ends])[: len(stops)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist())], np.uint64)
    lanes = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    ones = (lanes @ _BYTE_BITS).ravel() * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp long: the fingerprint's 64 bits as a signed number. A null text is empty: fingerprint zero."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"key": batch["key"], "fp": values.view(np.int64)})

    return unkeyed(keyed(docs, key, text).mapInPandas(run, "key string, fp long"), docs, key)


def fingerprint_of(text: str) -> Column:
    """The fingerprint as 16 hex digits, as a column of the text's own row."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([f"{fingerprint(t or ''):016x}" for t in texts], index=texts.index, dtype=object)

    return run(F.col(text))


def join_tries(a: np.ndarray, b: np.ndarray, half_bits: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of sorted a and b that are ``half_bits`` apart at most in the first half and ``bits`` in all.

    Pairs within ``bits`` whose first halves are further apart may come too. Node pairs are intervals of both arrays.
    """
    pairs = np.array([[0], [len(a)], [0], [len(b)], [0]])
    out_i, out_j = [], []
    for depth in range(65):
        small = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= 8 if depth < 64 else np.ones(pairs.shape[1], bool)
        leaf, pairs = pairs[:, small], pairs[:, ~small]
        if leaf.size:
            wide, tall = leaf[1] - leaf[0], leaf[3] - leaf[2]
            each = wide * tall
            own = np.repeat(np.arange(leaf.shape[1]), each)
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            i, j = leaf[0][own] + at // tall[own], leaf[2][own] + at % tall[own]
            near = np.bitwise_count(a[i] ^ b[j]) <= bits
            out_i.append(i[near])
            out_j.append(j[near])
        if not pairs.size:
            break
        bit = np.uint64(1 << (63 - depth))
        mask = np.uint64((0xFFFFFFFFFFFFFFFF << (64 - depth)) & 0xFFFFFFFFFFFFFFFF)
        cut_a = np.searchsorted(a, (a[pairs[0]] & mask) | bit)
        cut_b = np.searchsorted(b, (b[pairs[2]] & mask) | bit)
        budget = half_bits if depth < HALF else bits
        grown = []
        for side_a in (0, 1):
            for side_b in (0, 1):
                at = [cut_a if side_a else pairs[0], pairs[1] if side_a else cut_a, cut_b if side_b else pairs[2], pairs[3] if side_b else cut_b]
                child = np.stack([*at, pairs[4] + (side_a != side_b)])
                grown.append(child[:, (child[0] < child[1]) & (child[2] < child[3]) & (child[4] <= budget)])
        pairs = np.concatenate(grown, axis=1)
    if not out_i:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(out_i), np.concatenate(out_j)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the links (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return label


def _links(half_bits: int):
    """(a, b): for every fingerprint of a row of two blocks, one that it reaches within the row."""

    def run(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch["x"], batch["y"]):
                a, b = np.sort(np.asarray(x, np.int64).view(np.uint64)), np.sort(np.asarray(y, np.int64).view(np.uint64))
                i, j = join_tries(a, b, half_bits)
                both = np.concatenate([a, b])
                label = roots(len(both), i, j + len(a)) if len(i) else np.arange(len(both))
                moved = both[label] != both
                out.append(np.stack([both[moved], both[label][moved]]))
            found = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.uint64)
            yield pd.DataFrame({"a": found[0].view(np.int64), "b": found[1].view(np.int64)})

    return run


def _turned(column: str):
    """Both halves of a fingerprint exchanged."""
    c = F.col(column)
    return F.shiftleft(c, HALF).bitwiseOR(F.shiftrightunsigned(c, HALF))


def near_links(distinct: DataFrame, n: int) -> DataFrame:
    """Links (a, b) that connect all of the n distinct fingerprints ``fp`` that are at most BITS apart, directly or by a chain
    of such links; each row of two blocks gives a spanning forest, not all its pairs."""
    prefix = int(np.clip(np.ceil(np.log2(max(1, n) / BLOCK)), 2, 20))
    found = None
    for half_bits, turned in ((2, False), (1, True)):
        fps = distinct.select((_turned("fp") if turned else F.col("fp")).alias("fp"))

        def cut(batches):
            """Blocks of one partition, which is a sorted range."""
            rest = np.zeros(0, np.int64)
            for batch in batches:
                rest = np.concatenate([rest, batch["fp"].to_numpy(np.int64)])
                node = rest.view(np.uint64) >> np.uint64(64 - prefix)
                starts = np.flatnonzero(np.diff(node, prepend=~node[:1])) if len(node) else np.zeros(0, int)
                edges = sorted({e for s, t in zip(starts, [*starts[1:], len(rest)]) for e in range(s, t, BLOCK)})
                done = list(zip(edges, edges[1:]))  # the last block may go on in the next batch
                if done:
                    yield pd.DataFrame({"node": [int(node[s]) for s, _ in done], "block": [int(rest[s]) for s, _ in done], "fps": [rest[s:t] for s, t in done]})
                    rest = rest[edges[-1] :]
            if len(rest):
                node = int(rest.view(np.uint64)[0] >> np.uint64(64 - prefix))
                yield pd.DataFrame({"node": [node], "block": [int(rest[0])], "fps": [rest]})

        ranged = fps.repartitionByRange("fp").sortWithinPartitions("fp")
        blocks = written(ranged.mapInPandas(cut, "node long, block long, fps array<long>"), "simhash-blocks")
        masks = [sum(1 << i for i in c) for k in range(half_bits + 1) for c in combinations(range(prefix), k)]
        near = blocks.select(F.col("block").alias("p"), F.explode(F.array([F.col("node").bitwiseXOR(F.lit(m)) for m in masks])).alias("node"))
        pairs = near.join(blocks.select("node", F.col("block").alias("q")), "node").where("p <= q").select("p", "q")
        rows = pairs.join(blocks.select(F.col("block").alias("p"), F.col("fps").alias("x")), "p").join(blocks.select(F.col("block").alias("q"), F.col("fps").alias("y")), "q")
        rows = rows.select("x", "y").repartition(max(12, n >> 14))
        links = rows.mapInPandas(_links(half_bits), "a long, b long")
        if turned:
            links = links.select(_turned("a").alias("a"), _turned("b").alias("b"))
        found = links if found is None else found.union(links)
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", group: str | None = None) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id: the smallest key that links of at most BITS differing bits reach. group
    names one more column with a number of the component, also for those without a key.

    Every row gets a row. Null and empty texts have fingerprint zero and are linked like any other. Keys may repeat; null
    keys stay null and never are a component's id unless it has no other. Other columns are ignored; texts are read whole.
    """
    marks = written(fingerprints(docs, key, text), "simhash-fingerprints")
    distinct = written(marks.groupBy("fp").agg(F.min(key).alias("least")), "simhash-distinct")
    n = distinct.count()
    reach = components(near_links(distinct, n)) if n > 1 else distinct.select(F.col("fp").alias("node"), F.col("fp").alias("component"))
    reach = distinct.join(reach, distinct["fp"] == reach["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    reach = written(reach, "simhash-reach")
    best = reach.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = written(reach.join(best, "component").select("fp", "component_id", *[F.col("component").alias(g) for g in (group,) if g]), "simhash-components")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marks.join(ids, "fp").select(key, hexed, "component_id", *[g for g in (group,) if g])
