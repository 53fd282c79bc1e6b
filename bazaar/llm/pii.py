"""Personal data by candidate gradient boosting (operator 3), on DataFrame functions only.

Generators of high recall propose overlapping spans. Spans of the base patterns that pass their checks always count. The
looser ones are scored by boosted trees over format and context features; thresholds calibrated on held-out candidates select
what else is redacted. Everything happens inside a row: candidates are arrays, the trees become one expression, so texts are
neither shuffled nor joined.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.common import written

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that they find the same matches without backtracking: a run is entered at its
# start (or where the match before ended) and never given back.
_MAIL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The looser generators.
LOOSE = {
    "email": rf"(?<!{_MAIL})[A-Za-z0-9._%+-]{{1,64}}\x20?[\[({{]?(?:\x20at\x20|@|(?<=[\[({{])at(?=[\])}}]))[\])}}]?\x20?[A-Za-z0-9-]{{1,63}}(?:(?:\.|\x20?[\[({{]?(?:\x20dot\x20|(?<=[\[({{])dot(?=[\])}}]))[\])}}]?\x20?)[A-Za-z0-9-]{{1,63}}){{1,6}}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7})(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,2}[0-9]{4}){2}[\x20./_-]{1,2}[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[0-9]{1,3}[\x20./-]?)?\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}(?![0-9])",
}
# A cheap look that spares most texts the patterns.
_HINT = {"email": "(?i)@|[ (\\[{]at[ )\\]}]", "ip": "[0-9][.]|:[0-9A-Fa-f]", "card": "[0-9][^A-Za-z]?[0-9]", "phone": r"\+[0-9]|[0-9][^A-Za-z]?[0-9]"}
# Words before a span that speak for its kind.
CONTEXT = {
    "email": "(?i)(?:e-?mail|contact|write|reach|mailto|correo|courriel|kontakt)",
    "ip": r"(?i)(?:\bip\b|host|server|address|login|from|adresse)",
    "card": "(?i)(?:card|visa|master|amex|credit|pay|karte|tarjeta|carte)",
    "phone": "(?i)(?:tel|phone|call|mobile|fax|ring|anruf|llam|appel)",
}
NEAR = 40
FEATURES = ("kind", "length", "digits", "letters", "blanks", "marks", "distinct", "said", "before", "after", "leading_zero", "groups", "form", "abroad", "ending", "spelled")
#: The precision that a threshold must reach.
PRECISION = 0.95

Span = "struct<kind:int,start:int,stop:int,value:string,base:boolean>"


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, value>> of the leftmost non-overlapping matches, in code points."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda gap, v: F.struct(F.length(gap).alias("gap"), v.alias("value")))
    empty = F.expr("cast(array() as array<struct<start:int,stop:int,value:string>>)")

    def step(done, x):
        start = done["at"] + x["gap"]
        stop = start + F.length(x["value"])
        return F.struct(stop.alias("at"), F.concat(done["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["value"].alias("value")))).alias("out"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda done: done["out"])
    return F.when(F.size(values) > 0, found).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total, i):
        d = F.substr(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octet(part: Column) -> Column:
    rest = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(rest) <= 3, F.concat(F.lit("0"), rest).cast("int") <= 255).otherwise(False)


def valid(kind: str, value: Column) -> Column:
    """The check that a base match has to pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _octet)
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


_ENDING = r"(?:^|[^A-Za-z0-9-])(?:[a-z]{2,24}|[A-Z]{2,24})$"
_SPELLED = r"(?i)@|[\[({]at[\])}]|\x20dot\x20|[\[({]dot[\])}]"


def formed(kind: Column, value: Column) -> Column:
    """The check of a looser span by itself: Luhn on its digits, octets or the form of IPv6, the count of digits, an ending like
    that of a host name."""
    digits = _digits(value)
    ip = F.when(value.contains(":"), value.rlike(r"^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}$")).otherwise(valid("ip", value))
    return F.when(kind == 0, value.rlike(_ENDING)).when(kind == 1, ip).when(kind == 2, valid("card", value)).otherwise(valid("phone", value))


def labelled(kind: Column, value: Column, said: Column) -> Column:
    """Whether a looser span counts in training: it passes its own check and, where words or sums of any text do so too (at
    without any mark, digits in groups), its form or the words before it speak for its kind."""
    speaks = F.when(kind == 0, value.rlike(_SPELLED)).when(kind == 3, value.rlike("^00")).otherwise(True)
    return formed(kind, value) & (speaks | (said > 0))


# Texts with looser spans and with what only looks like them: # is a digit, ~ a hexadecimal one, ^ a letter, = the
# digit that makes Luhn's sum right. They let every kind be learned, whatever the documents hold.
EXAMPLES = (
    "login from ~~~~:~~~:~~~~:~~:~:~~~~:~~~~:~~~~ now", "it was ~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~, then", "~~~~:~~~:0:0:0:~~:~:~~~~", "host ~~~~:0:0:~:~:~~~~:~~~~:~~~~.", "part 9##.9##.9##.9## of it", "see 3##.#.#.# and more",
    "card ####.####.####.###= paid", "it is ####/####/####/###= here", "####_####_####_###=", "pay ####. ####. ####. ###=", "numbers ####.####.####.####", "rows ####/####/####/#### of the list", "visa ####_####_####_####",
    "call 0## ### #### or write", "phone 0###-###-#### now", "tel (0##) ### ####", "tel 0### ### ###", "mobile: 0###/####/###", "fax ### ### ####", "it was 0049-### ### ####.", "0033 ### ### ###", "it had ### ### #### units", "sum ##-##-#### of it", "rows ## ## ## ## ##", "page ###-###", "call ##-##", "0## ### #### came", "between #### and ####-#### it",
    "^^^^^ (at) ^^^^^^ (dot) org", "mail ^^^^ [at] ^^^^^^ [dot] com", "^^^.^^^^ at ^^^^^^ dot net", "write to ^^^^ at ^^^^^^.com", "^^^^ @ ^^^^^^.org", "^^^^^^{at}^^^^^{dot}de", "ask ^^^^ (at) ^^^^.^^^^^.org", "^^^^ at ^^^^.Then we", "we ^^^^ at ^^^^^^.It was", "^^^^ at ^^^^.^^^ came", "they ^^^^^ at ^^^^^^.^^ and", "he was at ^^^^.So it", "mail ^^^^ at ^^^^^.He said", "(^^^ at ^^^^^.The rest",
)
EXAMPLE_ROWS = 40


def examples(spark: SparkSession) -> DataFrame:
    """(text): EXAMPLE_ROWS of each of EXAMPLES."""
    rows = spark.range(EXAMPLE_ROWS * len(EXAMPLES)).select("id", F.element_at(F.array(*[F.lit(x) for x in EXAMPLES]), (F.col("id") % len(EXAMPLES) + 1).cast("int")).alias("t"))

    def filled(x, i):
        drawn = F.xxhash64(F.col("id"), i)
        pick = lambda signs: F.substr(F.lit(signs), (F.pmod(drawn, F.lit(len(signs))) + 1).cast("int"), F.lit(1))
        return F.when(x == "#", pick("0123456789")).when(x == "~", pick("0123456789abcdef")).when(x == "^", pick("abcdefghijklmnoprstuvwy")).otherwise(x)

    drawn = rows.select(F.array_join(F.transform(F.split("t", ""), filled), "").alias("t"))
    check = F.element_at(F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: _luhn(F.concat(_digits(F.col("t")), d))), 1)
    return drawn.select(F.when(F.col("t").contains("="), F.concat_ws("", F.substring_index("t", "=", 1), check, F.substring_index("t", "=", -1))).otherwise(F.col("t")).alias("text"))


def candidates(text: Column) -> Column:
    """array<Span>: base matches with ``base`` = passed its check, then looser ones (base false, never where a base one lies)."""

    def of_kind(k: int, kind: str) -> Column:
        def span(m, base):
            return F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), m["value"].alias("value"), base.alias("base"))

        base = F.transform(located(text, BASE[kind]), lambda m: span(m, valid(kind, m["value"])))
        loose = F.transform(located(text, LOOSE[kind]), lambda m: span(m, F.lit(False)))

        def both(s):
            held = F.filter(s["base"], lambda b: b["base"])
            return F.concat(s["base"], F.filter(s["loose"], lambda m: ~F.exists(held, lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"]))))

        once = F.transform(F.array(F.struct(base.alias("base"), loose.alias("loose"))), both)  # as a variable, each is made once
        return F.when(text.rlike(_HINT[kind]), F.element_at(once, 1)).otherwise(F.expr(f"cast(array() as array<{Span}>)"))

    return F.concat(*[of_kind(k, kind) for k, kind in enumerate(KINDS)])


def features(span: Column, text: Column) -> list[Column]:
    """Format and context of a span, in the order of FEATURES."""
    v = span["value"]
    size = lambda pattern: (F.length(v) - F.length(F.regexp_replace(v, pattern, ""))).cast("double")
    before = F.substr(text, F.greatest(span["start"] - NEAR + 1, F.lit(1)), F.least(span["start"], F.lit(NEAR)))
    after = F.substr(text, span["stop"] + 1, F.lit(1))
    said = reduce(lambda rest, k: F.when((span["kind"] == k) & before.rlike(CONTEXT[KINDS[k]]), 1.0).otherwise(rest), range(4), F.lit(0.0))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        span["kind"].cast("double"), F.length(v).cast("double"), size("[0-9]"), size("[A-Za-z]"), size(r"\x20"), size("[^0-9A-Za-z ]"),
        F.size(F.array_distinct(F.split(v, ""))).cast("double"), said, flag(before.rlike(r"[\w.+-]$")), flag(after.rlike(r"^[\w+-]")), flag(v.rlike("^0")),
        F.size(F.split(v, r"[^0-9A-Za-z]+")).cast("double"), flag(formed(span["kind"], v)), flag(v.rlike("^00")), flag(v.rlike(_ENDING)), flag(v.rlike(_SPELLED)),
    ]


def _parse(lines: list[str], at: list[Column]) -> Column:
    """The expression of one printed tree."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1]))
    feature, operator, value = re.fullmatch(r"If \(feature (\d+) (<=|in) (.+)\)", line).groups()
    if operator != "<=":
        raise ValueError("trees over categories are not expected")
    yes = _parse(lines, at)
    lines.pop(0)  # Else
    no = _parse(lines, at)
    return F.when(at[int(feature)] <= float(value), yes).otherwise(no)


class Scorer:
    """Boosted trees as an expression, and for each kind the score from which a span counts."""

    def __init__(self, trees: list[str], weights: list[float], thresholds: list[float | None]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def score(self, at: list[Column]) -> Column:
        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            lines = [x for x in tree.split("\n")[1:] if x.strip()]
            total = total + _parse(lines, at) * weight
        return 1 / (1 + F.exp(-2 * total))

    def accepts(self, kind: Column, at: Column) -> Column:
        """at: array of the features."""
        kinds = [k for k, t in enumerate(self.thresholds) if t is not None]
        if not kinds or not self.trees:
            return F.lit(False)
        least = reduce(lambda rest, k: F.when(kind == k, float(self.thresholds[k])).otherwise(rest), kinds, F.lit(2.0))
        return self.score([F.element_at(at, i + 1) for i in range(len(FEATURES))]) >= least


def training_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(f, label, kind, base, n): the candidates of all documents and of EXAMPLES, equal ones as one row with their number.

    The label of a base match is whether its check passes, that of a looser span is ``labelled``; a looser one where a valid base
    one lies is no candidate.
    """

    def rows_of(texts: DataFrame) -> DataFrame:
        spans = texts.select("text", F.explode(candidates(F.col("text"))).alias("span"))
        spans = spans.select("span", F.array(*features(F.col("span"), F.col("text"))).alias("f"))
        loose = labelled(F.col("span.kind"), F.col("span.value"), F.element_at("f", FEATURES.index("said") + 1))
        return spans.select("f", F.when(F.col("span.base"), 1.0).otherwise(loose.cast("double")).alias("label"), F.col("span.kind").alias("kind"), F.col("span.base").alias("base"))

    texts = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull())
    rows = rows_of(texts).union(rows_of(examples(docs.sparkSession)))
    return rows.groupBy("f", "label", "kind", "base").agg(F.count("*").cast("double").alias("n"))


def train(docs: DataFrame, text: str = "text") -> Scorer:
    """Boosted trees fitted on ``training_rows``, weighted by their numbers. A fifth of the rows, dealt by a hash of the features,
    is held out of the fit; the looser candidates among them calibrate the thresholds."""
    rows = written(training_rows(docs, text), "pii-candidates").withColumn("part", F.pmod(F.xxhash64("f"), F.lit(5)))
    if rows.where("part > 0").select("label").distinct().count() < 2:
        return Scorer([], [], [None] * len(KINDS))
    vectors = rows.select(array_to_vector("f").alias("features"), "label", "kind", "part", "base", "n")
    model = GBTClassifier(maxIter=8, maxDepth=4, seed=7, maxMemoryInMB=64, weightCol="n").fit(vectors.where("part > 0"))
    scored = model.transform(vectors.where("part = 0 and not base")).select("kind", "label", "n", F.round(vector_to_array("probability")[1], 2).alias("p"))
    table = scored.groupBy("kind", "p").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("good")).collect()
    thresholds: list[float | None] = []
    for k in range(len(KINDS)):
        at = None
        for p in sorted({r["p"] for r in table if r["kind"] == k}):
            above = [r for r in table if r["kind"] == k and r["p"] >= p]
            if 0 < sum(r["good"] for r in above) >= PRECISION * sum(r["n"] for r in above):
                at = max(0.5, p - 0.005)
                break
        thresholds.append(at)
    return Scorer([t.toDebugString for t in model.trees], [float(w) for w in model.treeWeights], thresholds)


def with_spans(docs: DataFrame, scorer: Scorer, text: str = "text", out: str = "spans") -> DataFrame:
    """docs and a column array<struct<start, kind, stop, base>>, sorted by start and kind; empty for a null or empty text.

    Every row keeps its row and its columns (one named like ``out`` is replaced). A looser span that overlaps a base span of
    its kind is left out.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn(out, candidates(body))
    base = F.filter(F.col(out), lambda s: s["base"])
    rated = F.transform(F.filter(F.col(out), lambda s: ~s["base"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["base"].alias("base"), F.array(*features(s, body)).alias("f")))
    more = F.filter(rated, lambda s: scorer.accepts(s["kind"], s["f"]))
    free = F.filter(more, lambda s: ~F.exists(base, lambda b: (b["kind"] == s["kind"]) & (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    slim = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["base"].alias("base")))
    return found.withColumn(out, F.when(F.size(out) > 0, F.array_sort(F.array_distinct(F.concat(slim(base), slim(free))))).otherwise(F.expr("cast(array() as array<struct<start:int,kind:int,stop:int,base:boolean>>)")))


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and all spans as text. A row for every row."""
    found = with_spans(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), train(docs, text))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(F.col("key").alias(key), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; overlapping spans become one, named by the first.

    Rows, other columns and null texts stay as they are; n_chars, if there is one, is counted anew for changed texts.
    """
    found = with_spans(docs, train(docs, text), text, "__spans")
    body = F.col(text)
    name = lambda k: F.element_at(F.array(*[F.lit(f"<{x.upper()}>") for x in KINDS]), k + 1)

    def step(done, s):
        inside = s["start"] < done["at"]
        piece = F.concat(F.substr(body, done["at"] + 1, s["start"] - done["at"]), name(s["kind"]))
        return F.struct(
            F.greatest(done["at"], s["stop"]).alias("at"),
            F.when(inside, done["out"]).otherwise(F.concat(done["out"], F.array(piece))).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    new = F.aggregate("__spans", start, step, lambda done: F.concat(F.array_join(done["out"], ""), F.substr(body, done["at"] + 1, F.length(body))))
    out = found.withColumn("__text", F.when(F.size("__spans") > 0, new).otherwise(body))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col("__text").alias(c))
        elif c == "n_chars":
            kind = dict(docs.dtypes)[c]
            columns.append(F.when(F.size("__spans") > 0, F.length("__text").cast(kind)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)
