import random

import numpy as np
import xxhash

from bazaar.llm import simhash


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", "  ", "A", "Äb Á a b c", "a b c d", "a b c d e f g a b c d", "x y z\x1cw", "word " * 3000, "A\tB\nC\rD", "é" * 40]


def test_fingerprint():
    assert [simhash.fingerprint(t or "") for t in TEXTS] == [plain(t or "") for t in TEXTS]


def test_tries_find_all_pairs():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 7))) & (2**64 - 1) for b in base for _ in range(3)]
    a = np.array(sorted(set(base + near)), np.uint64)
    for first, (limit, low) in {0: (2, False), 1: (1, True)}.items():
        turned = np.sort((a << np.uint64(32)) | (a >> np.uint64(32))) if low else a
        i, j = simhash.join_tries(turned, turned, limit)
        got = {(x, y) for x, y in zip(i.tolist(), j.tolist())}
        want = {
            (x, y)
            for x in range(len(a))
            for y in range(len(a))
            if (int(turned[x]) ^ int(turned[y])).bit_count() <= 4 and ((int(turned[x]) ^ int(turned[y])) >> 32).bit_count() <= limit
        }
        assert want <= got and all((int(turned[x]) ^ int(turned[y])).bit_count() <= 4 for x, y in got), first


def brute(rows):
    fp = [plain(t or "") for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fp[i] ^ fp[j]).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for (k, _), c in zip(rows, label):
        if k is not None:
            least[c] = min(least.get(c, k), k)
    return sorted((str(k), f"{f:016x}", str(least.get(c))) for (k, _), f, c in zip(rows, fp, label))


def test_frame(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b c d"), (3, "A"), (3, "A")]
    for g in range(12):
        words = [rng.choice(vocabulary) for _ in range(150)]
        for _ in range(6):
            rows.append((len(rows) + 100, " ".join(words)))
            words = words[:]
            words[rng.randrange(150)] = rng.choice(vocabulary)
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, fp int, component int")
    out = simhash.near_duplicates(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((str(r[0]), r[1], str(r[2])) for r in out.collect()) == brute(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.where("doc_id = 4")).collect()[0][2] == 4
