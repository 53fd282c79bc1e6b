import hashlib
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest

from bazaar.llm import conversations as C
from tests.conftest import SF_DIR

BLANK = " \t\n\x0b\x0c\r"
GOAL = re.compile(r"(s?(ua)+)?\Z")
EMPTY = hashlib.sha256(b"").hexdigest()


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        spell = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{spell(conv)}:{spell(turn)}".encode()) % 20
        role, text = spell(role), spell(text)
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def tie(row):
    _, turn, role, text = row
    return turn is not None, turn or 0, role[:64], text[:64], hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()


def faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        said = text.strip(BLANK)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repair(rows, bad):
    """(cost, audit, turns) by plain recursion from the back; audits are compared as strings."""
    def after(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))

    best = {}
    for at in range(len(rows), -1, -1):
        for inserted in range(3):  # after two turns put in, after one, none
            for state in "", "s", "u", "a":
                options = [(0, "", [])] if at == len(rows) and state in ("", "a") else []
                new, role = ("a", "assistant") if state == "u" else ("u", "user")
                if inserted:
                    cost, audit, turns = best[at, inserted - 1, new]
                    options.append((cost + 5, "I" + audit, [f"{role}:"] + turns))
                if at < len(rows):
                    cost, audit, turns = best[at + 1, 2, state]
                    options.append((cost + 2, "D" + audit, turns))
                    if bad[at] not in ("blank", "duplicate"):
                        extra, (_, _, said, text) = 5 * (bad[at] == "truncated"), rows[at]
                        keep = after(state, said[:1])
                        if keep:
                            cost, audit, turns = best[at + 1, 2, keep]
                            options.append((cost + extra, "K" + audit, [f"{said}:{text}"] + turns))
                        cost, audit, turns = best[at + 1, 2, new]
                        options.append((cost + extra + 1, "R" + audit, [f"{role}:{text}"] + turns))
                best[at, inserted, state] = min(options) if options else (10**9, "", [])
    return best[0, 2, ""]


def plain(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted(after_damage([r for r in rows if r[0] == conv]), key=tie)
        if not mine:
            out.append((conv, 0, 0, 0, 0, 0, 0, "", EMPTY))
            continue
        turns = [t for _, t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        bad, initials = faults(mine), [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = repair(mine, bad)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=str)


def test_recursion_is_the_least_of_all_edits():
    rng = random.Random(2)
    for _ in range(60):
        rows = [(1, i, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b", "", "c!"])) for i in range(rng.randrange(1, 4))]
        bad, found = faults(rows), []
        for edits in product("KuaD", repeat=len(rows)):
            if any(e != "D" and b in ("blank", "duplicate") for e, b in zip(edits, bad)):
                continue
            for places in product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
                emitted, audit, cost = "", "", 0
                for put, edit, row, b in zip(places, [*edits, ""], [*rows, None], [*bad, ""]):
                    emitted, audit, cost = emitted + put, audit + "I" * len(put), cost + 5 * len(put)
                    if edit:
                        audit += edit if edit in "KD" else "R"
                        cost += {"K": 0, "D": 2}.get(edit, 1) + 5 * (edit != "D" and b == "truncated")
                        emitted += {"K": row[2][:1], "D": ""}.get(edit, edit)
                if GOAL.match(emitted):
                    found.append((cost, audit))
        assert min(found) == repair(rows, bad)[:2]


ROLES, TEXTS = ["system", "user", "assistant", "tool", "", "user", "assistant", "User"], ["Yes.", "no", "Why?", " \n", "", "Stop! ", "Ä", "Yes.", "x" * 90 + ".", "x" * 90 + "!"]


def conversation(rng, conv, n, roles=ROLES, texts=TEXTS):
    return [(conv, t if rng.random() < 0.97 else None, rng.choice(roles), rng.choice(texts) + (str(t) + "." if rng.random() < 0.6 else "")) for t in range(n)]


def cases():
    rng = random.Random(7)
    rows = [r for c in range(150) for r in conversation(rng, c, rng.randrange(1, 12))]
    rows += [(1000, 5, "user", "same."), (1000, 5, "user", "same."), (1000, 5, "user", "other."), (1001, None, None, None), (1002, None, "user", "a."), (1002, None, "assistant", "b.")]
    rows += [(None, i, rng.choice(ROLES), f"{i}.") for i in range(9)] + [(1003, 10**17, "user", "a."), (1003, -(10**17), "assistant", "b.")]
    rows += [(2000 + c, 1, "user", "only.") for c in range(40)]  # some lose their one row
    rows += conversation(rng, 3000, 400) + conversation(rng, 3001, 300, ["user", "assistant"]) + conversation(rng, 3002, 60, texts=["", " "])
    rows += [(3003, i, "user", "again") for i in range(200)] + [(3004, i, ["user", "assistant"][i % 2], f"{i}.") for i in range(250)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def wanted():
    return plain(cases())


@pytest.mark.parametrize("size", [4096, 7, 1])
def test_frame(spark, wanted, size):
    rows = [(*r, "x", 1, b"y") for r in cases()]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, chunk int, code binary").repartition(5)
    out = C.report(given, chunk_rows=size)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == wanted
    assert C.report(given.limit(0)).count() == 0


def test_given_conversations(spark):
    given = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in given.collect()]
    assert sorted(map(tuple, C.report(given).collect()), key=str) == plain(rows)


def test_costs_of_a_long_chunk_converge():
    rng = np.random.default_rng(3)
    codes = [rng.choice(np.array([0, 1, 2, 3, 5, 6, 8, 16], np.uint8), 500)]
    one, _ = C.backward(codes, C.END)
    other, _ = C.backward(codes, np.zeros((1, 4)))
    assert len(set((one - other).ravel().tolist())) == 1
    whole, kept = C.backward([codes[0], codes[0][:3]], np.stack([C.END, C.END]), keep=True)
    assert (kept[0][0] == whole[0]).all() and (kept[1][0] == whole[1]).all() and (kept[1][3] == C.END).all()
    assert (whole[0] == one[0]).all()
