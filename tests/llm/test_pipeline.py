import hashlib
import random

import pytest

import corpus_pipeline as P
from bazaar.llm import simhash
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(P.written(stage(spark, out[-1], SF_DIR), "test"))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash", "decontaminate", "pii", "byte_bpe"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and dict(df.dtypes) == dict(stages[0].dtypes)


def test_each_stage_takes_effect(spark, stages):
    ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in stages]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[3] == ids[4] == ids[5]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    assert len(clean - ids[1]) <= 0.02 * len(clean)
    texts = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    prints = {i: simhash.fingerprint(t or "") for i, t in texts.items()}
    kept = sorted(ids[2])
    assert all((prints[a] ^ prints[b]).bit_count() > 4 for i, a in enumerate(kept) for b in kept[:i])
    for i in ids[1] - ids[2]:
        assert any((prints[i] ^ prints[j]).bit_count() <= 4 for j in ids[1] if j != i)
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    after = {r["doc_id"]: r for r in stages[4].collect()}
    assert all(r["n_chars"] == len(r["text"] or "") for r in after.values())
    assert any(before[i] != r["text"] for i, r in after.items()) and any(before[i] == r["text"] for i, r in after.items())
    for r in stages[5].collect():
        assert r["decoded_sha256"] == hashlib.sha256((after[r["doc_id"]]["text"] or "").encode()).hexdigest()


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(str, P.run(spark, SF_DIR).collect())) == sorted(map(str, stages[-1].collect()))


def test_odd_rows(spark, stages):
    rng = random.Random(3)
    long = lambda: " ".join("w%d" % rng.randrange(500) for _ in range(60))
    a, b, c = long(), long(), long()
    rows = [(1, a), (1, a), (2, a), (3, b), (3, c), (None, b), (None, "lone text of a few words"), (None, "lone text of a few words"), (7, None), (8, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component int")
    one = sorted((str(r["doc_id"]), str(r["text"])) for r in P.one_of_each(spark, docs, SF_DIR).collect())
    assert one == sorted([("1", a), ("3", b), ("3", c), ("None", "lone text of a few words"), ("7", "None")])
    df = docs
    for _, stage in P.STAGES:
        df = P.written(stage(spark, df, SF_DIR), "test")
    assert df.count() == 5
    empty = stages[0].limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF_DIR)
        assert empty.count() == 0


def test_null_ids_are_searched_for_benchmark_items(spark):
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(None, "x " + item), (None, "clean"), (4, item), (5, None)], "doc_id long, text string")
    assert {r["text"] for r in P.not_in_benchmark(spark, docs, SF_DIR).collect()} == {"clean", None}
