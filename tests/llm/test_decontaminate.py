import random

import pytest

from bazaar.llm import decontaminate as D


def brute(docs, items):
    def shingles(rows, sizes):
        out = {}
        for key, text in rows:
            if key is not None and text is not None:
                w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
                found = [tuple(w[i : i + n]) for n in sizes or [min(5, len(w))] if n for i in range(len(w) - n + 1)]
                out.setdefault(key, set()).update(found)
        return out

    b = shingles(items, None)
    a = shingles(docs, {len(x) for found in b.values() for x in found} or {5})
    return sorted((d, i, len(x & y), len(y)) for d, x in a.items() for i, y in b.items() if y and len(x & y) >= 0.8 * len(y) - 1e-9)


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "w%d" % rng.randrange(400)
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 3, 5, 6, 9, 30, 45])))) for i in range(40)]
    items += [(100, None), (101, ""), (None, "a b c d e f"), (5, items[5][1]), (102, items[5][1]), (103, "same same same same same same same")]
    docs = []
    for d in range(120):
        body = [word() for _ in range(rng.randrange(0, 300))]
        for _ in range(rng.randrange(3)):
            passage = (rng.choice(items)[1] or "").upper().split()
            for _ in range(rng.randrange(3)):
                if passage:
                    passage[rng.randrange(len(passage))] = word()
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        docs.append((d, ", ".join(body)))
    docs += [(500, None), (501, ""), (None, items[4][1]), (7, docs[7][1]), (502, "same " * 5000)]
    a = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, h int, shingle string")
    b = spark.createDataFrame([(k, t, 1, 2) for k, t in items], "item_id long, text string, doc_id int, n int")
    for most in (D.BROADCAST_ROWS, 0):
        monkeypatch.setattr(D, "BROADCAST_ROWS", most)
        monkeypatch.setattr(D._small, "__defaults__", (most,))
        out = D.contaminated(a, b)
        assert sorted(tuple(r)[:4] for r in out.collect()) == brute(docs, items)
    assert len(brute(docs, items)) > 20
    assert D.contaminated(a.limit(0), b).count() == 0 and D.contaminated(a, b.limit(0)).count() == 0


@pytest.mark.parametrize("n", range(1, 200))
def test_sketches_are_large_enough(n):
    import math

    top = 2 ** (int(math.log2(n)) + 1) - 1
    assert top - math.ceil(round(top * D.CONTAINED, 6)) + 1 >= n - math.ceil(n * D.CONTAINED - 1e-9) + 1


def test_short_items_and_sql(spark, tmp_path):
    """An item of one to four words is found where its words stand together; the SQL says the same."""
    import duckdb

    docs = [(1, "Say: forty-two!"), (2, "forty and two"), (3, "two forty two one"), (4, "yes"), (5, ""), (6, None), (7, "a b c d e f")]
    items = [(10, "Forty two"), (11, "yes"), (12, "..."), (13, None), (14, "b c d e f"), (15, "a b c d"), (15, "yes")]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = sorted(tuple(r)[:4] for r in D.contaminated(a, b).collect())
    assert found == [(1, 10, 1, 1), (3, 10, 1, 1), (4, 11, 1, 1), (7, 14, 1, 1)] == brute(docs, items)
    with duckdb.connect() as db:
        a.toPandas().to_parquet(tmp_path / "d.parquet")
        b.toPandas().to_parquet(tmp_path / "b.parquet")
        db.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/d.parquet'")
        db.execute(f"CREATE VIEW benchmark AS FROM '{tmp_path}/b.parquet'")
        assert sorted(r[:4] for r in db.execute(D.SQL).fetchall()) == found
