import random

import numpy as np
import pytest

from bazaar.llm import quality as Q


def test_word_vectors_equal_a_plain_sum(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "cc", "d!", "é"]) for _ in range(rng.randrange(12))) for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    vectors, counts = Q.gather(docs)
    place, sign = Q.index_vectors()
    want, seen, known = np.zeros((Q.BUCKETS, Q.SIZE)), np.zeros(Q.BUCKETS), Q.Buckets()
    for t in texts:
        b = [known[w] for w in Q.TOKENS.findall(t or "")]
        for i, x in enumerate(b):
            seen[x] += 1
            for j in range(max(0, i - Q.REACH), min(len(b), i + Q.REACH + 1)):
                if j != i:
                    for k in range(Q.SIGNS):
                        want[x, place[b[j], k]] += sign[b[j], k]
    assert np.allclose(vectors, want) and np.array_equal(counts, seen)


def corpus(n=800):
    rng = random.Random(6)
    good = ["ab", "ac", "ad", "the", "of", "in", "es", "re"]
    bad = ["x", "***", "ZZ", "qq", "the"]
    rows = [(i, " ".join(rng.choice(bad if i % 6 == 0 else good) for _ in range(rng.randrange(8, 80)))) for i in range(n)]
    return rows, [(i, int(i % 6 != 0), 0) for i in range(n)]


def test_held_out(spark):
    rows, labels = corpus()
    docs, schema = spark.createDataFrame(rows, "doc_id long, text string"), "doc_id long, quality int, toxic int"
    out = {r["doc_id"]: r for r in Q.scored(docs, spark.createDataFrame(labels, schema)).collect()}
    held = [i for i, *_ in labels if out[i]["held_out"]]
    assert len(out) == len(rows) and np.mean([out[i]["predicted"] == dict(x[:2] for x in labels)[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    flipped = [(i, 1 - q if out[i]["held_out"] else q, t) for i, q, t in labels]
    again = {r["doc_id"]: r["score"] for r in Q.scored(docs, spark.createDataFrame(flipped, schema)).collect()}
    assert all(again[i] == pytest.approx(out[i]["score"], abs=1e-6) for i in out)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "a b", 3), (2, "x " * 9000, 4), (2, "x " * 9000, 4)], "doc_id long, text string, n int")
    marks = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 1)], "doc_id long, quality int")
    assert len(Q.scored(docs, marks).collect()) == 5
    assert Q.scored(docs.limit(0), marks).count() == 0 and Q.scored(docs, marks.limit(0)).count() == 5
