import random

import numpy as np

from bazaar.llm import toxicity as T


def read(text, learned=None):
    return [[(w, s, set(tags), round(v, 3)) for w, s, tags, v in c] for c in T.Reader(learned or {}).clauses(text)]


def test_grammar():
    assert read("You are an idiot.") == [[("idiot", T.INSULT, {"aimed"}, 1.5)]]
    assert read("An idiot came. Fine.") == [[("idiot", T.INSULT, set(), 1.0)]]
    assert read("You are not an idiot") == [[("idiot", T.INSULT, {"aimed", "negated"}, 0.45)]]
    assert read("not one of the many idiots") == [[("idiots", T.INSULT, set(), 1.0)]]
    assert read("He said you idiot") == [[("idiot", T.INSULT, {"aimed", "reported"}, 0.75)]]
    assert read("he said no. Idiot") == [[("idiot", T.INSULT, set(), 1.0)]]
    assert read("we kill time. I will kill you") == [[("kill", T.THREAT, set(), 0.2)], [("kill", T.THREAT, set(), 0.2)]]
    assert read("you, I will kill") == [[("kill", T.THREAT, {"aimed"}, 1.5)]]
    assert read("") == read("nothing here") == []
    assert read("Zorgeln zorge", {"zorg": 0.9, "zor$": 0.1}) == [[("zorgeln", T.INSULT, set(), 0.9), ("zorge", T.INSULT, set(), 0.9)]]


def test_composition_reads_like_its_parts():
    machine = T.grammar()
    assert all(machine.arcs[s, a][0] in {x for x, _ in machine.arcs} for s, a in machine.arcs)
    assert {a for _, a in machine.arcs} == set(range(7))


def test_small_cache(monkeypatch):
    text = " ".join(random.Random(1).choice(["idiot", "you", "a", "b", "c", "not", "kill", "scum", "d."]) for _ in range(400))
    want = read(text)
    monkeypatch.setattr(T, "CACHE", 3)
    assert read(text) == want


def corpus(n=1500):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abdeg") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(5, 60))]
        y = int(i % 8 == 0)
        if y:
            words.insert(rng.randrange(len(words)), "qux" + rng.choice(["on", "eln", "ig", "er", "a", "ost"]))
        rows.append((i, " ".join(words)))
        labels.append((i, y, 1))
    return rows, labels


def test_learns_stems_and_holds_out(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    out = {r["doc_id"]: r for r in T.scored(docs, marks).collect()}
    truth = {i: y for i, y, _ in labels}
    held = [i for i in truth if out[i]["held_out"]]
    import zlib

    assert held == [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i]["predicted"] == truth[i] for i in held]) == 1.0
    flipped = [(i, 1 - y if out[i]["held_out"] else y, q) for i, y, q in labels]  # labels held out teach nothing
    again = {r["doc_id"]: r for r in T.scored(docs, spark.createDataFrame(flipped, "doc_id long, toxic int, quality int")).collect()}
    assert all(abs(again[i]["score"] - out[i]["score"]) < 1e-9 for i in out)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "idiot", 3), (2, "idiot " * 3000, 4), (2, "idiot " * 3000, 4)], "doc_id long, text string, score int")
    marks = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 1)], "doc_id long, toxic int")
    out = T.scored(docs, marks).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert T.scored(docs.limit(0), marks).count() == 0
    assert T.scored(docs, marks.limit(0)).count() == 5
