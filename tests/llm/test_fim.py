import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from bazaar.llm import fim
from checks.compare import connect, difference
from tests.conftest import SF_DIR


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(key, text):
    """The contract, word for word."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{'' if key is None else key}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return key, len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 50
    return key, len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def cases():
    rng = random.Random(11)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "é\n\U0001f600\nb", "<", "<\n<S\nP>", "x <P> y", "a\n<M>", "<S>", "\r\n\r\n", "a b\x85c\n", "\x00\n"]
    texts += ["".join(rng.choice("aé\n\n\U0001f600<>PSM ") for _ in range(rng.randrange(4000))) for _ in range(60)]
    texts += ["\n" * 5000, "é" * 5000, ("x" * 511 + "\n") * 40, ("x" * 510 + "é\n") * 40, "long line " * 200_000 + "\n" + "é\n" * 300_000]
    return texts


def test_cuts():
    rng = random.Random(5)
    for text in cases():
        text = text or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        lines = fim.Lines(text)
        assert lines.n == len(units)
        for k in {0, len(units), *(rng.randrange(len(units) + 1) for _ in range(20))}:
            assert lines.chars_before(k) == sum(map(len, units[:k]))


def test_tree():
    import numpy as np

    counts = np.random.default_rng(1).integers(0, 9, 100)
    tree = fim.fenwick(counts)
    for i in range(1, 101):
        assert tree[i] == counts[i - (i & -i) : i].sum()


def test_frame(spark):
    rows = [(i, t) for i, t in enumerate(cases())] + [(None, "a\nb\nc"), (3, "same key\nsame draws\n"), (3, "same key\nsame draws\n")]
    docs = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in rows], "doc_id long, text string, form string, n int, __text string")
    out = fim.transformed(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = [plain(*row) for row in rows]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    back = out.select(fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(r["t"] for r in back) == sorted(t or "" for _, t in rows)
    digests = fim.digests(docs)
    assert sorted(map(tuple, digests.collect()), key=str) == sorted(((*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, rows)), key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fim.digests(docs.limit(0)).count() == 0
    assert str(out._jdf.queryExecution().executedPlan()).count("_cuts(") == 1


def test_rates(spark):
    docs = spark.createDataFrame([(i, "a\nb\n") for i in range(400)], "doc_id long, text string")
    forms = lambda **rates: {r["form"]: r["count"] for r in fim.transformed(docs, **rates).groupBy("form").count().collect()}
    assert forms(rate=0) == {"plain": 400} and forms(spm_rate=100) == {"spm": 400} and forms(spm_rate=0) == {"psm": 400}
    half = forms(rate=50)
    assert 140 < half["plain"] < 260 and set(half) == {"plain", "psm", "spm"}
    assert forms(seed=8) != forms()


@pytest.mark.parametrize("folder", [SF_DIR])
def test_query_equals_sql(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert difference(connect(folder), fim.SQL, fim.digests(docs)) is None
