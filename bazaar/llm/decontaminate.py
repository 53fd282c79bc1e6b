"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly (operator 4).

A short item hides in a long document, so their Jaccard similarity says nothing; the share of the item that the document
contains does. Items are partitioned by size. The MinHash sketch of an item is the least hashes among its own shingles, and
its size is chosen per partition so that a document with the wanted share must hold at least one of them: n - ceil(t n) + 1.
Documents need no signature: their shingle hashes meet the sketches in one join. Whoever meets is verified on the shingles
themselves. An item of fewer words than a shingle has is one shingle as it stands; documents have shingles of that length too
where an item asks for it. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import BROADCAST_ROWS, written

SHINGLE, CONTAINED = 5, 0.8


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _windows(array: Column, size: int, make) -> Column:
    """make(i) for every position i of a run of ``size`` in an array; none in a shorter one."""
    n = F.size(array) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), make))


def shingle_hashes(array: Column, size: int = SHINGLE) -> Column:
    return _windows(array, size, lambda i: F.xxhash64(*[F.element_at(array, i + k) for k in range(size)]))


def shingle_texts(array: Column, size: int = SHINGLE) -> Column:
    return _windows(array, size, lambda i: F.concat_ws(" ", F.slice(array, i, size)))


def _of_sizes(make, array: Column, sizes: list[int], kind: str) -> Column:
    none = F.array().cast(f"array<{kind}>")
    return F.concat(*[F.coalesce(make(array, size), none) for size in sizes])


def _small(df: DataFrame, size: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table of counted rows (or bytes), broadcast only within the bound; beyond it Spark shuffles."""
    return F.broadcast(df) if size <= most else df


def sketches(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, n, shingle) of every distinct shingle, and (item_id, h) of every item's sketch; both written."""
    split = items.select("item_id", words(F.col("text")).alias("w"))  # a column of its own, else every shingle splits the text anew
    own = F.coalesce(shingle_texts(F.col("w")), F.when(F.size("w") > 0, F.array(F.concat_ws(" ", "w"))))
    rows = split.select("item_id", F.array_distinct(own).alias("s")).where("item_id is not null and s is not null")
    per_item = rows.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"))
    whole = written(per_item.select("item_id", F.size("s").alias("n"), F.explode("s").alias("shingle")), "decontaminate-items")
    hashed = whole.select("item_id", "n", _hash_of_text(F.col("shingle")).alias("h"))
    top = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1  # the largest size of the partition
    most = top - F.ceil(F.round(top * CONTAINED, 6)) + 1
    sorted_ = hashed.groupBy("item_id", "n").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    sketch = sorted_.select("item_id", F.explode(F.slice("hs", F.lit(1), most.cast("int"))).alias("h"))
    return whole, written(sketch, "decontaminate-sketches")


def _hash_of_text(shingle: Column) -> Column:
    """The hash that shingle_hashes gives to these words."""
    w = F.split(shingle, " ")
    word = F.transform(w, lambda x: F.xxhash64(x))
    of = lambda size: F.xxhash64(*[F.element_at(word, k + 1) for k in range(size)])
    out = of(SHINGLE)
    for size in range(1, SHINGLE):
        out = F.when(F.size(w) == size, of(size)).otherwise(out)
    return out


def short_sizes(whole: DataFrame) -> list[int]:
    """The lengths under SHINGLE that items have: at most SHINGLE - 1 numbers."""
    words_in = F.size(F.split("shingle", " "))
    return sorted(r[0] for r in whole.select(words_in.alias("size")).where(F.col("size") < SHINGLE).distinct().collect())


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, item_id, n_shared, n_item, containment: pairs in which the document has CONTAINED of the item's shingles or more.

    docs: key, text; items: item_id, text. Null keys, null texts and texts without words match nothing. An item of fewer than
    SHINGLE words is one shingle, which a document has or has not: n_item is 1. Rows with one key count as one document (or item): repeated rows change nothing. Other columns are ignored.
    """
    whole, sketch = sketches(items)
    size_whole, n_sketch = whole.agg(F.coalesce(F.sum(F.octet_length("shingle") + 16), F.lit(0))).first()[0], sketch.count()
    sizes = [*short_sizes(whole), SHINGLE]
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    hashes = docs.select("key", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    met = hashes.select("key", F.explode(_of_sizes(shingle_hashes, F.col("w"), sizes, "bigint")).alias("h"))
    candidates = written(met.join(_small(sketch, n_sketch), "h").select("key", "item_id").distinct(), "decontaminate-candidates")
    wanted = candidates.select("key").distinct()
    again = docs.join(_small(wanted, candidates.count()), "key", "left_semi")
    split = again.select("key", words(F.col("text")).alias("w"))
    shingles = split.select("key", F.explode(F.array_distinct(_of_sizes(shingle_texts, F.col("w"), sizes, "string"))).alias("shingle"))
    shared = shingles.join(_small(whole, size_whole, BROADCAST_ROWS * 16), "shingle").distinct()
    counted = shared.groupBy("key", "item_id", "n").agg(F.count("*").alias("n_shared")).join(candidates, ["key", "item_id"], "left_semi")
    found = counted.where(F.col("n_shared") >= F.col("n") * CONTAINED - 1e-9)
    return found.select(F.col("key").alias(key), "item_id", "n_shared", F.col("n").cast("long").alias("n_item"), (F.col("n_shared") / F.col("n")).alias("containment"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS s FROM d, k),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s
  FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN n USING (item_id) WHERE n_shared >= n_item * 0.8 - 1e-9
"""
