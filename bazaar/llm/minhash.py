"""MinHash near-duplicates with circulant signatures, banding and exact verification (operator 13).

A shingle is a position on a circle of 2^32. One permutation (sigma) scatters the positions of a set; a second one (pi),
turned by k positions for the k-th coordinate, gives every coordinate of the signature: the least pi((sigma(x) - k) mod 2^32).
Five coordinates make a band and forty bands a signature, so two sets at the wanted similarity of 0.8 share no band once in
eight million times. Sets that share a band are candidates, and a link is what exact sets confirm.

Candidates are never expanded to all pairs of a band's group. Each set is first compared with the smallest one it meets. From
then on a group only matters while it holds more than one component: the members outside its largest component are compared
with the best-linked members of that one (HUBS), since a single link settles a member, and those that are still outside, PIVOTS
of them and in every further round MORE times as many, with all members of other components, and leave the group; rounds grow
with the logarithm of a group. So copies of one text, however
many, cost a few comparisons each, and no candidates end in different components without having been compared. Pairs
whose parity sketches differ in more bits than similar sets can differ in shingles are not similar, and are settled without
their texts. Equal sets are one node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.llm.common import components, mix, written

WORDS, SIMILAR = 2, 80  # words of a shingle, percent
ROWS, BANDS = 5, 40
PIVOTS, MORE = 64, 4  # pivots of a group in the first round, and how many times as many in every further one
HUBS = (2, 8)  # of a group, in one round each, before the pivots
AT_ONCE = 1 << 16  # shingles of one vectorised step
SIGMA, PI = np.uint32(0x5BD1E995), np.uint32(0x27D4EB2F)
SKETCH_BITS = 10  # a sketch has 2^10 bits
MARK = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType())]
    + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("sketch", "bands")]
)
BATCH_SETTING, VERIFY_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 64


def shingles(text: str, size: int = WORDS) -> set[bytes]:
    """Distinct runs of ``size`` words; the whole sequence of fewer words; none without words."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(run) for run in zip(*(words[i:] for i in range(size)))}


def scatter(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit words."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def sigma(x: np.ndarray) -> np.ndarray:
    return scatter(x ^ SIGMA)


def pi(x: np.ndarray) -> np.ndarray:
    return scatter(scatter(x) ^ PI)


def signatures(sets: list[np.ndarray], size: int = ROWS * BANDS) -> np.ndarray:
    """A row per non-empty set of 32-bit positions: its least pi after every turn of the circle."""
    out, start = np.empty((len(sets), size), np.uint32), 0
    lengths = np.array([len(s) for s in sets], np.int64)
    while start < len(sets):
        stop = max(start + 1, start + int(np.searchsorted(np.cumsum(lengths[start:]), AT_ONCE, "right")))
        placed = sigma(np.concatenate(sets[start:stop]))
        first = np.cumsum(lengths[start:stop]) - lengths[start:stop]
        for k in range(size):
            out[start:stop, k] = np.minimum.reduceat(pi(placed - np.uint32(k)), first)
        start = stop
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit name for every band of every signature; the band's number is part of it."""
    cells = signature.reshape(len(signature), -1, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, cells.shape[1] + 1, dtype=np.uint64), cells.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, r])
    return key.view(np.int64)


def digest(found: list[bytes]) -> bytes:
    """A name for a sorted set; equal sets have equal names."""
    return hashlib.blake2b(b"\n".join(found), digest_size=16).digest()


def sketch(positions: np.ndarray) -> np.ndarray:
    """The parity of how many positions fall in each of 2^SKETCH_BITS arcs, as 64-bit words. What two sets share cancels out, so
    their sketches differ in no more bits than the sets have different members."""
    arcs = np.bincount(positions >> np.uint32(32 - SKETCH_BITS), minlength=1 << SKETCH_BITS)
    return np.packbits((arcs & 1).astype(bool)).view(np.int64)


@F.pandas_udf(T.BinaryType())
def _digests(texts: pd.Series) -> pd.Series:
    return pd.Series([digest(sorted(shingles(text))) for text in texts], dtype=object)


@F.pandas_udf(MARK)
def _marks(texts: pd.Series) -> pd.DataFrame:
    n, digests, positions = [], [], []
    for text in texts:
        found = sorted(shingles(text))
        n.append(len(found))
        digests.append(digest(found))
        positions.append(np.fromiter(map(xxhash.xxh32_intdigest, found), np.uint32, len(found)))
    bands = iter(band_keys(signatures([p for p in positions if len(p)])))
    sketches = list(map(sketch, positions))
    return pd.DataFrame({"n": n, "digest": digests, "sketch": sketches, "bands": [next(bands) if k else np.zeros(0, np.int64) for k in n]})


def similar(a: int, b: int, shared: int, percent: int = SIMILAR) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def _same_size(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * SIMILAR


def _may_be_similar(n: Column, sketch: Column, m: Column, other: Column) -> Column:
    """False only if sets of these sizes and sketches cannot be similar: of a + b members, similar sets differ in at most
    (100 - SIMILAR) / (100 + SIMILAR), a ninth."""
    apart = F.aggregate(F.zip_with(sketch, other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, bits: total + bits)
    return _same_size(n, m) & (apart * (100 + SIMILAR) <= (n + m) * (100 - SIMILAR))


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    for side, c in (("a", "x"), ("b", "y")):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(c)), side)
    return pairs.where(_may_be_similar(F.col("n_x"), F.col("x"), F.col("n_y"), F.col("y"))).select("a", "b")


def _confirm(batches):
    """Pairs whose full sets are similar; pairs come sorted by their first node, whose set is kept meanwhile."""
    node, kept = None, set()
    for batch in batches:
        right = []
        for a, x, y in zip(batch["a"], batch["text_a"], batch["text_b"]):
            if a != node:
                node, kept = a, shingles(x)
            other = shingles(y)
            right.append(similar(len(kept), len(other), len(kept & other)))
        yield batch.loc[np.array(right, bool), ["a", "b"]]


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The written pairs (a, b) whose texts are similar. The text of b goes to where its pair's a is; a row holds two texts."""
    spark = pairs.sparkSession
    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, VERIFY_ROWS)
    try:
        return written(both.sortWithinPartitions("a").mapInPandas(_confirm, "a long, b long"), "minhash-links")
    finally:
        spark.conf.set(BATCH_SETTING, before)


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) after the written links: components of the components."""
    if links.isEmpty():
        return comp
    ends = links.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a")
    ends = ends.join(comp.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return _relabelled(comp, ends)


def _relabelled(comp: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, comp) after links between components."""
    reach = components(ends, "minhash-components").withColumnsRenamed({"node": "comp", "component": "to"})
    return written(comp.join(reach, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "minhash-components")


def _open_groups(live: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, node, comp, main) of live (key, node) in the groups that still hold several components; main is the largest of its
    group."""
    rows = live.join(comp, "node")
    counts = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
    main = counts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1")
    return written(rows.join(main.select("key", F.col("m.comp").alias("main")), "key"), "minhash-live")


def _across(rows: DataFrame, chosen: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct pairs of rows with the chosen ones of their group that are of another component and may be similar."""
    sides = chosen.join(known, "node").select("key", *[F.col(c).alias(f"p_{c}") for c in ("node", "n", "comp", "sketch")])
    may = _may_be_similar(F.col("n"), F.col("sketch"), F.col("p_n"), F.col("p_sketch"))
    others = rows.join(known, "node").join(sides, "key").where((F.col("comp") != F.col("p_comp")) & may)
    return others.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()


def _calls(rows: DataFrame, links: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """Pairs of the members outside the largest component of an open group with those ``most`` members of it that have most links."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc_nulls_last("degree"), "node"))
    hubs = rows.where("comp = main").join(ends, "node", "left").withColumn("place", place).where(F.col("place") <= most)
    return _across(rows.where("comp <> main").select("key", "node", "comp"), hubs.select("key", "node", "comp"), known)


def _pivots(rows: DataFrame, most: int) -> DataFrame:
    """(key, node, comp) of up to ``most`` members of each open group outside its largest component."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("node"))
    return written(rows.where("comp <> main").withColumn("place", place).where(F.col("place") <= most).select("key", "node", "comp"), "minhash-pivots")


def node_components(nodes: DataFrame, texts_of) -> DataFrame:
    """(node, comp) of the nodes that share a band with another; nodes has node, n, sketch, bands.

    texts_of(candidates) gives (node, text) for the one-column table of these nodes.
    """
    banded = nodes.select("node", "n", F.explode("bands").alias("key"))
    firsts = banded.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("members")).where("members > 1")
    met = written(banded.join(firsts.select("key", "first"), "key"), "minhash-met")
    comp = written(met.select("node", F.col("node").alias("comp")).distinct(), "minhash-components")
    texts = written(texts_of(comp.select("node")), "minhash-texts")
    met_first = met.where(F.col("first.node") < F.col("node")).where(_same_size(F.col("n"), F.col("first.n")))
    pairs = met_first.groupBy("node").agg(F.min("first.node").alias("a")).select("a", F.col("node").alias("b"))
    live, tried = met.select("key", "node"), written(_plausible(pairs, nodes), "minhash-pairs")
    links = confirmed(tried, texts)
    comp = _relabelled(comp, links)  # as yet every node is its own component
    known = written(nodes.select("node", "n", "sketch").join(comp.select("node"), "node", "left_semi"), "minhash-known")
    for hubs in HUBS:
        rows = _open_groups(live, comp)
        if rows.isEmpty():
            return comp
        new = written(_calls(rows, links, known, hubs).join(tried, ["a", "b"], "left_anti"), "minhash-pairs")
        found = confirmed(new, texts)
        comp, links, tried, live = _merged(comp, found), links.union(found), tried.union(new), rows.select("key", "node")
    most = PIVOTS
    while not (rows := _open_groups(live, comp)).isEmpty():
        pivots, most = _pivots(rows, most), most * MORE
        new = written(_across(rows.select("key", "node", "comp"), pivots, known).join(tried, ["a", "b"], "left_anti"), "minhash-pairs")
        comp, tried = _merged(comp, confirmed(new, texts)), tried.union(new)
        live = rows.select("key", "node").join(pivots, ["key", "node"], "left_anti")
    return comp


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept: the smallest key that links of SIMILAR percent or more reach, and whether it is the
    row's own.

    Every row gets a row. Null texts are empty; texts without words have an empty set and are linked with nothing, not even
    with each other. A link holds between rows, whatever their keys: rows that repeat a key with another text are linked only
    if their texts are. Null keys stay null and never are a component's id unless it has no other; such a row is kept only if
    its component has no key at all. Repeated rows are equal sets. Other columns are ignored; texts are read whole.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marks = written(rows.withColumn("mark", _marks("text")).select("id", "mark.*"), "minhash-marks")
    sets = marks.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"), *[F.first(c).alias(c) for c in ("n", "sketch", "bands")])
    nodes = written(sets.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")

    def texts_of(candidates: DataFrame) -> DataFrame:
        """One of the rows with the least key of each node: equal sets stand for each other. Keys may repeat, so the rows that
        have such a key are marked again."""
        wanted = nodes.join(candidates, "node", "left_semi").select("node", F.col("digest").alias("d"), "least")
        some = rows.join(wanted, F.col("id").eqNullSafe(F.col("least")), "left_semi").withColumn("digest", _digests("text"))
        found = some.join(wanted, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("least")))
        return found.select("node", "text").dropDuplicates(["node"])

    reach = node_components(nodes.select("node", "n", "sketch", "bands"), texts_of)
    reach = nodes.select("node", "digest", "least").join(reach, "node", "left").select("digest", "least", F.coalesce("comp", "node").alias("comp"))
    reach = written(reach, "minhash-reach")
    best = reach.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = written(reach.join(best, "comp").select("digest", "component_id"), "minhash-ids")
    out = marks.select("id", "n", "digest").join(ids, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
