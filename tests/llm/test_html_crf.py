import re

import numpy as np
import pytest

from bazaar.llm import html_crf as H
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def field():
    return H.trained()


def test_blocks():
    page = "<body><nav><ul><li><a href='#'>A</a><li>B</ul></nav><p>x<b>y</b> &amp;amp; z<p>t<br>u<script>if (a<b) '</p>'</script>v<!-- <p>no --><div hidden>w</div>tail"
    got = [(c[-1] if c else "", H.clean(r)) for c, r, _ in H.blocks(page)]
    assert got == [("li", "A"), ("li", "B"), ("p", "xy &amp; z"), ("p", "t u v"), (".hidden", "w"), ("body", "tail")]
    assert H.blocks("") == [] and H.blocks("<") == [((), "<", 0)] and H.blocks("<p") == [((), "<p", 0)]
    assert [H.clean(r) for _, r, _ in H.blocks("a < b & c")] == ["a < b & c"]


def test_viterbi_is_the_best_sequence(field):
    page = H.blocks(next(H.labelled_pages(1, 99))[0])[:9]

    def value(labels):
        total = 0.0
        for k, (cues, raw, linked) in enumerate(page):
            names = H.structure(cues) + [f"{n} {v}" for n, v in zip(H.LOOK, H.look(raw, linked))]
            total += sum(field.weights[field.names[f]][labels[k]] for f in names if f in field.names)
            total += field.moves[labels[k - 1]][labels[k]] if k else 0
        return total

    best = max((tuple(map(int, np.binary_repr(i, len(page)))) for i in range(2 ** len(page))), key=value)
    assert tuple(field.labels(page)) == best


def test_unseen_pages(field):
    right = total = 0
    for page, wanted in H.labelled_pages(150, 1234):
        found = H.blocks(page)
        for (_, raw, _), y in zip(found, field.labels(found)):
            right += y == (H.clean(raw) in wanted)
            total += 1
    assert right / total > 0.98


def test_comments_and_notices_inside_an_article_page(field):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><p>Site</p></header><nav><a href="/">Home</a></nav>
    <div class="cookie-notice"><p>We use cookies, many of them.</p></div><main><h1>Head&eacute;</h1><p>One two
    three, four.</p><aside class="sidebar"><p>Read also this.</p></aside><p>Five.</p></main>
    <section id="comments"><p>Great article, thanks a lot for it.</p></section><form><p>Leave a reply</p></form><footer>&copy; Me</footer>"""
    assert field.text(page) == "Headé\nOne two three, four.\nFive."


def test_table_pages(spark):
    """In these pages the article element holds the article: an independent way to say what must come out."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    got = {r["page_id"]: r for r in H.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [H.clean(re.sub(r"<[^>]*>", " ", x)) for x in re.split(r"<(?:p|h1)>", body)]
        want = "\n".join(p for p in parts if p)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_odd_rows(spark):
    rows = [(1, "u", None, 1), (1, "u", None, 1), (None, None, "", 2), (2, "v", "<article><p>" + "word " * 200_000, 3), (3, "w", "no tags at all", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = H.extract(pages).collect()
    assert len(out) == 5 and sorted(r["n_chars"] for r in out)[:3] == [0, 0, 0]
    assert max(r["n_chars"] for r in out) == 999_999
    assert H.extract(pages.limit(0)).count() == 0


def test_left_out_end_tags(field):
    body = "<body><article><h1>Head</h1><p>One two three, four five six.</p>{}<p>Seven eight nine, ten eleven.</p></article>"
    whole = "Head\nOne two three, four five six.\nSeven eight nine, ten eleven."
    for head in ("<head><title>t</title>", "<head><meta charset=utf-8><script>var a = '<p>';</script><title>a < b</title>\n<link rel=x>", "<head><title>t", "<head><noscript><p>no</p></noscript></head>", "<head>"):
        assert field.text(f"<html>{head}" + body.format("")) == whole
    assert [H.clean(r) for _, r, _ in H.blocks("<head><title>t</title><p>a<p>b")] == ["a", "b"]
    for tag in ("button", "select", "object", "noscript", "textarea", "svg", "iframe"):
        assert field.text(body.format(f"<{tag}>")) == whole
        assert field.text(body.format(f"<{tag} class=x>") + f"<footer><{tag}>no</{tag}></footer>") == whole
        assert field.text(body.format(f"<{tag}>no</{tag}>")) == whole
    assert H.blocks("<p>a<script>no") == [(("p",), "a ", 0)]


def test_titles_and_formulas(field):
    body = "<article><h1>Head</h1><p>One two three, so {} holds.</p></article>"
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding='tex'>x=\\frac{1}{1}</annotation></semantics></math>"
    for start in ("<!doctype html><title>My title here</title>", "<title>My title here</title><meta charset=utf-8>", "<html><title lang=en>My title here", "<body><title>a <b> c</title>", "<head><title>t</title></head>"):
        assert field.text(start + body.format(formula)) == "Head\nOne two three, so x=1 holds."
    assert [H.clean(r) for _, r, _ in H.blocks("<p>a <math><mi>b</mi></math> c")] == ["a b c"]
    assert H.blocks("<title>no") == []
