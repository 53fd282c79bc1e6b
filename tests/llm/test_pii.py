import hashlib
import random
import re

from pyspark.sql import functions as F

from bazaar.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            v = m.group()
            d = re.sub("[^0-9]", "", v)
            ok = {"email": True, "ip": all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


TEXTS = ["", " ", "a.b+c@x-y.co.uk, q@r", "a@b.c@d.e", "@x.y z@@w.v", "é1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.0255 1.2.3", "4111 1111-1111 1111 and 4111 1111 1111 1112", "😀 +49 (0)30.1234-5678 +1 2 + 3", "+1(((((", "4" * 5000, "1 " * 3000, "a" * 4000 + "@b.c", "tel 030 1234567, mail joe (at) site (dot) org", "1.2.3.4@x.y+12345678901 5500000000000004", "192.168.0.1." * 50, "x@y..z a@b.c.", "+" * 500, "1-2-3-4-5-6-7-8-9-0-1-2-3"]


def rows(seed=4):
    rng = random.Random(seed)
    some = ["".join(rng.choice("01259 -.+()@ab\né") for _ in range(rng.randrange(120))) for _ in range(300)]
    return list(enumerate(TEXTS + some)) + [(1, None), (None, "a@b.c"), (1, "a@b.c")]


def test_base_equals_plain_patterns(spark):
    data = rows()
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in data], "doc_id long, text string, spans int, kind string")
    got = sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.report(docs).collect())
    want = []
    for k, t in data:
        spans = plain(t or "")
        text = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        want.append((str(k), *[sum(s[2] == x for s in spans) for x in pii.KINDS], hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert pii.report(docs.limit(0)).count() == 0


def test_all_spans_hold_the_base_spans(spark):
    data = [(i, t) for i, t in rows(8)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for (k, t), r in zip(sorted(data, key=str), sorted(pii.report(docs).collect(), key=lambda r: str((r["doc_id"], None)))):
        assert r["spans"] is not None
    out = {(r["doc_id"], r["spans"]) for r in pii.report(docs).collect()}
    for k, t in data:
        base = {f"{kind}:{a}:{b}" for a, _, kind, b in plain(t or "")}
        assert any(i == k and base <= set(s.split(",")) | {""} for i, s in out)


def test_trees_as_expression_equal_the_model(spark):
    data = [(float(i % 7), float(i % 5), float((i % 7 > 3) ^ (i % 5 > 2))) for i in range(300)]
    df = spark.createDataFrame(data, "a double, b double, label double").select(pii.array_to_vector(F.array("a", "b")).alias("features"), "a", "b", "label")
    model = pii.GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(df)
    scorer = pii.Scorer([t.toDebugString for t in model.trees], list(model.treeWeights), [0.5] * 4)
    both = model.transform(df).select(pii.vector_to_array("probability")[1].alias("p"), scorer.score([F.col("a"), F.col("b")]).alias("q"))
    assert both.where("abs(p - q) > 1e-9").count() == 0


def test_redacted(spark):
    docs = spark.createDataFrame([(1, "é x@y.zz, 😀 +49 30 123456789 end", 9, "k"), (2, None, 3, None), (3, "", 0, None), (4, "no data", 7, None)], "doc_id long, text string, n_chars long, kind string")
    out = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert out[1]["text"] == "é <EMAIL>, 😀 <PHONE> end" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] is None and out[2]["n_chars"] == 3 and out[3]["text"] == "" and out[4]["text"] == "no data"
    assert pii.redacted(docs).columns == docs.columns


def test_looser_spans_are_selected(spark):
    found = {
        "login from 2001:db8:0:1:1:0:af3:1 today": "ip", "card 4111.1111.1111.1111 paid": "card", "please call 030 123 4567 soon": "phone",
        "Ask jane (at) site (dot) org for it": "email",
    }
    none = ["Come and look at this.Then we go", "numbers 4111.1111.1111.1112 here", "it had 123 456 7890 units"]
    docs = spark.createDataFrame(list(enumerate([*found, *none, "mail a@b.cc from 10.0.0.1"])), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.report(docs).collect()}
    for i, kind in enumerate(found.values()):
        assert [x.split(":")[0] for x in out[i]["spans"].split(",")] == [kind], out[i]
    assert all(out[len(found) + i]["spans"] == "" for i in range(len(none)))
    cut = docs.select(F.explode(pii.candidates(F.col("text"))).alias("s")).where("s.value = '10.0.0.1' and s.kind = 1")
    assert [r["s"]["base"] for r in cut.collect()] == [True]


def test_hints_do_not_hide_base_matches(spark):
    text = "+4 (9) - 1 (5) - 1 - 2 - 3 - 4 - 5"
    assert len(plain(text)) == 1
    row = spark.createDataFrame([(text,)], "text string").select(F.filter(pii.candidates(F.col("text")), lambda s: s["base"]).alias("s")).first()
    assert [(s["kind"], s["start"], s["stop"]) for s in row["s"]] == [(3, 0, len(text))]


def test_trees_and_thresholds_come_from_every_document(spark):
    """More documents and candidates than a sample of a few thousand would hold; equal candidates count as often as they occur."""
    n = 50_000
    call = F.concat(F.lit("call 030 123 "), F.lpad((F.col("id") % 10_000).cast("string"), 4, "0"), F.lit(" or a@b.cc, no. "), F.col("id").cast("string"))
    docs = spark.range(n).select(call.alias("text")).union(spark.createDataFrame([(None,), ("",)], "text string"))
    spans = lambda texts: texts.select(F.explode(pii.candidates(F.col("text")))).count()
    rows = pii.training_rows(docs)
    assert rows.agg(F.sum("n")).first()[0] == spans(docs) + spans(pii.examples(spark))
    assert rows.where("kind = 0 and base").agg(F.sum("n")).first()[0] == n
    assert rows.count() < n
