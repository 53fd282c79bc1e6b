import random

import numpy as np
import pytest

from bazaar.llm import minhash
from tests.conftest import SF_DIR


def plain_set(text):
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in text.split(" ") if w]
    return {(a, b) for a, b in zip(words, words[1:])} if len(words) > 1 else {tuple(words)} if words else set()


def brute(rows):
    """All pairs, one after the other."""
    sets = [plain_set(t or "") for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and 100 * shared >= 80 * (len(a) + len(sets[j]) - shared):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    ids = [least.get(root(i)) for i in range(len(rows))]
    return sorted((str(k), len(s), str(c), k == c) for (k, _), s, c in zip(rows, sets, ids))


def got(df):
    return sorted((str(k), n, str(c), kept) for k, n, c, kept in df.collect())


def test_permutations():
    some = np.unique(np.random.default_rng(1).integers(0, 2**32, 200_000, dtype=np.uint64).astype(np.uint32))
    assert len(np.unique(minhash.sigma(some))) == len(some) == len(np.unique(minhash.pi(some)))
    row = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(minhash.pi(row))) == len(row)


def test_signature_is_circulant_and_estimates():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**32, 3000, dtype=np.uint64).astype(np.uint32)
    a, b = pool[:2000], pool[500:2500]  # 1500 of 2500 shared
    sig = minhash.signatures([a, b, pool[:1]], 1024)
    for k in (0, 1, 7, 1023):
        assert sig[0, k] == min(minhash.pi(minhash.sigma(a) - np.uint32(k)))
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.08
    many = [rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) for n in (1, 100_000, 3, 70_000, 5)]
    whole = minhash.signatures(many, 8)
    assert all((whole[i] == minhash.signatures([m], 8)[0]).all() for i, m in enumerate(many))


def test_sketches_never_differ_more_than_the_sets():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**32, 4000, dtype=np.uint64).astype(np.uint32)
    for shared, own in ((0, 1), (300, 5), (300, 60), (3000, 500)):
        a, b = pool[: shared + own], np.concatenate([pool[:shared], pool[-own:]])
        apart = int(np.bitwise_count((minhash.sketch(a) ^ minhash.sketch(b)).view(np.uint64)).sum())
        assert apart <= 2 * own and (2 * own > 200 or apart > own)
    assert not minhash.sketch(pool[:0]).any() and len(minhash.sketch(pool)) == 16


def test_shingles():
    for text in ("", " \n", "A", "a b", "A B a b", "Ä ä\x1cx y\x85z", "a\tb\x0bc\x0cd\re"):
        assert {tuple(s.decode().split(" ")) for s in minhash.shingles(text)} == plain_set(text), text


def words(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def edited(rng, base, edits):
    out = base[:]
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def test_frame(spark):
    rng = random.Random(4)
    rows = [(100 + i, t) for i, t in enumerate([None, "", " ", "A", "a", "a b", "A\nB", "a b a b", "b a", "same same same"])]
    rows += [(None, "a b"), (None, "alone"), (None, None), (7, "a"), (7, "a"), (7, "other text here")]
    base = words(rng, 120)
    rows += [(1000 + i, " ".join(edited(rng, base, rng.randrange(14)))) for i in range(60)]  # links of 0.8 on both sides
    chain = words(rng, 100)
    for i in range(25):  # each links with the next, ends are far apart
        rows.append((2000 + (i * 7) % 25, " ".join(chain)))
        chain = edited(rng, chain, 3)
    rows += [(3000 + i, " ".join(base)) for i in range(50)] + [(4000 + i, " ".join(words(rng, rng.randrange(1, 80)))) for i in range(60)]
    shared = words(rng, 60)
    rows += [(5000 + i, " ".join(shared + words(rng, rng.randrange(5, 40)))) for i in range(60)]
    long = words(rng, 30_000)
    rows += [(6000, " ".join(long)), (6001, " ".join(edited(rng, long, 1500)))]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, t, 1, "x", 0) for k, t in rows], "doc_id long, text string, n int, digest string, node int")
    out = minhash.near_duplicates(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got(out) == brute(rows)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert got(minhash.near_duplicates(docs.where("doc_id is null and text = 'alone'"))) == [("None", 1, "None", True)]


@pytest.mark.parametrize("pivots", [1, 2])
def test_groups_are_compared_to_the_end(spark, monkeypatch, pivots):
    """A band of one coordinate puts texts that are not similar into one group, which takes many rounds."""
    monkeypatch.setattr(minhash, "PIVOTS", pivots)
    rng = random.Random(6)
    shared = words(rng, 50)
    rows = [(i, " ".join(shared + words(rng, 12 + i % 5))) for i in range(12)]
    rows += [(100 + i, " ".join(edited(rng, rows[i % 3][1].split(), 3))) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(docs)) == brute(rows)


def test_many_independent_edits_of_one_text(spark):
    rng = random.Random(8)
    base = words(rng, 200)
    rows = [(0, " ".join(base))] + [(1 + i, " ".join(edited(rng, base, 9))) for i in range(300)]  # 0.83 to the first, 0.7 to each other
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out) == brute(rows)
    assert out.select("component_id").distinct().count() == 1


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert got(minhash.near_duplicates(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
