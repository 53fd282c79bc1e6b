import hashlib
import random

import numpy as np
import pytest

from bazaar.llm import suffix_dedup as S


def brute(rows):
    out = []
    first = {}
    for key, text in rows:
        data = (text or "").encode()
        if key is not None:
            for i in range(len(data) - 49):
                w = data[i : i + 50]
                first[w] = min(first.get(w, key), key)
    for key, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        if key is not None:
            for i in range(len(data) - 49):
                if first[data[i : i + 50]] < key:
                    gone[i : i + 50] = [True] * 50
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(key), len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_words_at():
    for n in (0, 1, 7, 8, 9, 30):
        data = bytes(range(1, n + 1))
        assert S.words_at(data).tolist() == [int.from_bytes(data[i : i + 8].ljust(8, b"\0"), "little") for i in range(n)]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    data = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(200))) for _ in range(6)] + [b"a" * 120]
    words, sizes = S.words_at(b"".join(data)), np.array([len(d) for d in data])
    text, at, first, last = S.anchors(words, sizes)
    begin, seen, windows = np.cumsum(sizes) - sizes, {}, 0
    for t, p, a, b in zip(text, at, first, last):
        for s in range(a, b + 1):
            windows += 1
            w = data[t][s - begin[t] : s - begin[t] + 50]
            assert len(w) == 50 and 0 <= p - s <= 34 and seen.setdefault(w, p - s) == p - s
    assert windows == sum(max(0, n - 49) for n in sizes)


@pytest.mark.parametrize("seed,chunk", [(1, 1_000_000), (2, 300), (3, 1_000_000)])
def test_equals_brute_force(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rng = random.Random(seed)
    words = ["é", "ab", "the", "of", "x" * 7, "lorem", "\n", "日本"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(8, 40))) for _ in range(12)]
    rows = []
    for i in range(70):
        parts = [" ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 4))]
        for p in rng.sample(passages, rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), p[rng.randrange(10) :])
        rows.append((i * 3 % 71, " ".join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(8)] + [(300 + i, rows[i][1][3:-5] + "tail") for i in range(8)]
    rows += [(4, None), (5, ""), (None, rows[0][1]), (9, "a" * 400), (10, "a" * 99), (11, "a" * 50), (12, "a" * 49), (11, "a" * 50), (6, passages[0] * 2), (6, passages[0] + " other"), (-3, passages[1])]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, doc int, at string").repartition(4)
    assert sorted((str(r[0]), *r[1:]) for r in S.report(docs).collect()) == brute(rows)
    if seed == 1:
        assert S.report(docs.limit(0)).count() == 0
        monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
        assert sorted((str(r[0]), *r[1:]) for r in S.report(docs).collect()) == brute(rows)
