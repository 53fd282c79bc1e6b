import random

import pytest

from bazaar.llm import common, minhash
from tests.llm.test_minhash import brute, got, words


def plain(links):
    label = {n: n for pair in links if None not in pair and pair[0] != pair[1] for n in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


@pytest.fixture
def steps(monkeypatch):
    names, before = [], common.written
    for module in (common, minhash):
        monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or before(df, name))
    return names


def reached(spark, links):
    rows = common.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["component"] for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(None, 3), (4, None), (5, 5), (900, 900)]
    links += [(1000 + i, 1001 + i) for i in range(30)] + [(2030 - i, 2029 - i) for i in range(30)] + links[:20]
    assert reached(spark, links) == plain([(a, b) for a, b in links if None not in (a, b) and a != b])


def test_stars_need_no_round(spark, steps):
    links = [(i, i // 10 * 10) for i in range(60)] + [(0, i) for i in range(1, 5)]
    assert reached(spark, links) == plain([(a, b) for a, b in links if a != b])
    assert len(steps) == 1


def test_rounds_grow_with_the_logarithm(spark, steps, monkeypatch):
    monkeypatch.setattr(minhash, "PIVOTS", 1)
    rng = random.Random(6)
    shared = words(rng, 50)
    rows = [(i, " ".join(shared + words(rng, 12 + i % 5))) for i in range(60)]
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert steps.count("minhash-pivots") <= 4
