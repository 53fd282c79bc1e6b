"""Fill-in-the-middle: a document is cut at two line ends and its parts change places (operator 11).

A text is divided into fixed blocks of UTF-8 bytes. Two Fenwick trees over the blocks hold how many units (lines) end in a
block and how many code points begin in it. A cut after k units goes down the trees by binary lifting to the block in which
the k-th line ends, summing code points on the way, and is then located inside that one block. So the lines of a text never
become a list, and beside the text itself only two numbers per block are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, SLICE = 512, 2048 * 512
LINE_END = 10
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
CUT = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "prefix_chars", "middle_chars")])


def fenwick(counts: np.ndarray) -> np.ndarray:
    """Node i (from 1) holds the sum of counts over the blocks (i - lowest bit of i, i]."""
    total = np.concatenate([[0], np.cumsum(counts)])
    i = np.arange(len(total))
    return total - total[i & (i - 1)]


def _heads(raw: np.ndarray) -> np.ndarray:
    """True for bytes that begin a code point."""
    return (raw & 0xC0) != 0x80


class Lines:
    """Where the units of a text end: `[^\\n]*\\n|[^\\n]+` from left to right."""

    def __init__(self, text: str):
        self.raw = np.frombuffer(text.encode(), np.uint8)
        ends, points = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start in range(0, len(self.raw), SLICE):
            part = self.raw[start : start + SLICE]
            edges = np.arange(0, len(part), BLOCK)
            ends.append(np.add.reduceat(part == LINE_END, edges, dtype=np.int64))
            points.append(np.add.reduceat(_heads(part), edges, dtype=np.int64))
        ends, points = np.concatenate(ends), np.concatenate(points)
        self.ended, self.chars = int(ends.sum()), int(points.sum())
        self.n = self.ended + int(len(self.raw) > 0 and self.raw[-1] != LINE_END)
        self.ends, self.points = fenwick(ends), fenwick(points)

    def chars_before(self, k: int) -> int:
        """Code points of the first k units."""
        if k > self.ended:
            return self.chars
        if k == 0:
            return 0
        block, passed, chars = 0, 0, 0
        step = 1 << len(self.ends).bit_length()
        while step:
            if block + step < len(self.ends) and passed + self.ends[block + step] < k:
                block += step
                passed += int(self.ends[block])
                chars += int(self.points[block])
            step >>= 1
        inside = self.raw[block * BLOCK : (block + 1) * BLOCK]
        at = np.flatnonzero(inside == LINE_END)[k - passed - 1]
        return chars + int(np.count_nonzero(_heads(inside[: at + 1])))


def cut(text: str, first: int, second: int) -> tuple[int, int, int]:
    """Units, code points of the prefix, code points of the middle; first and second are random whole numbers."""
    lines = Lines(text)
    a, b = sorted((first % (lines.n + 1), second % (lines.n + 1)))
    before = lines.chars_before(a)
    return lines.n, before, lines.chars_before(b) - before


@F.pandas_udf(CUT)
def _cuts(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cut(*row) for row in zip(texts, first, second)], columns=CUT.names, dtype="int64")


def _draw(hashed: Column, k: int) -> Column:
    """The k-th group of eight hex digits as an unsigned number."""
    return F.conv(F.substr(hashed, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long")


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """key, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output text.

    rate: percent of the documents that are cut; spm_rate: percent of those that begin with the suffix. Draws depend on seed
    and key only: repeated keys are drawn alike, a null key counts as the empty text. Null and empty texts are plain with no
    units, and so are texts that hold one of the three marks. A text of one unit is cut before or after it. Rows may repeat;
    other columns are ignored, whatever their names; texts of any length are cut whole.
    """
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"), hashed.alias("__hash"))
    h = F.col("__hash")
    drawn = rows.select("__key", "__text", *[_draw(h, k).alias(f"__h{k + 1}") for k in range(4)])
    placed = drawn.withColumn("__cut", _cuts("__text", "__h1", "__h2"))
    whole = F.col("__text")
    marked = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    plain = (whole == "") | marked | (F.col("__h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("__h4") % 100 < spm_rate, "spm").otherwise("psm")
    formed = placed.select("__key", "__text", "__cut.*", form.alias("form"))
    a, m = F.col("prefix_chars"), F.col("middle_chars")
    prefix, middle = F.substr(whole, F.lit(1), a.cast("int")), F.substr(whole, (a + 1).cast("int"), m.cast("int"))
    suffix = F.substr(whole, (a + m + 1).cast("int"))
    marks = {x: F.lit(x) for x in (PREFIX, SUFFIX, MIDDLE)}
    output = (
        F.when(F.col("form") == "psm", F.concat(marks[PREFIX], prefix, marks[SUFFIX], suffix, marks[MIDDLE], middle))
        .when(F.col("form") == "spm", F.concat(marks[SUFFIX], suffix, marks[PREFIX], prefix, marks[MIDDLE], middle))
        .otherwise(whole)
    )
    parts = F.col("form") != "plain"
    return formed.select(
        F.col("__key").alias(key), "n", "form", F.when(parts, a).alias("prefix_chars"), F.when(parts, m).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output was made of: a cut text holds no mark, so the three marks of its output are its own."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return (
        F.when(form == "psm", F.concat(part(1), part(3), part(2)))
        .when(form == "spm", F.concat(part(2), part(3), part(1)))
        .otherwise(output)
    )


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n, form, prefix_chars, middle_chars and the hashes of the output and of the text rebuilt from it."""
    rows = transformed(docs, key, text)
    back = restored(F.col("output"), F.col("form"))
    return rows.select(
        key, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
    FROM documents),
r AS (
    SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x,
           CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                     OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
                WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM d),
p AS (
    SELECT doc_id, t, n, form, array_to_string(u[1:least(x, y)], '') AS a,
           array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:n], '') AS z
    FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m
                        WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
