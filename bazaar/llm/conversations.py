"""Conversation structure repair by a rank-convergence parallel Viterbi (operator 12).

Deleting, keeping, re-roling and inserting turns, at least cost, until the role initials read ``(s?(ua)+)?`` is a shortest path
through four states (nothing yet, after s, after u, after a). A conversation is sorted over range partitions and cut into
chunks, so that a long one is many rows. Costs run backwards: every chunk but the last starts from a speculative cost vector;
a fix-up pass runs those chunks again whose true vector, now known from the chunk behind, differs from the one they used by
more than a constant. Min-plus products of such steps soon have rank one, so passes are few. Chunks of nothing but forced
deletions pass vectors through and are skipped. With the backward costs in place, the least audit is traced forwards letter by
letter; the state in which a chunk begins comes from the exits of the chunks before it, one small number per chunk.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.llm.common import written

CHUNK, CHUNK_CHARS, FLUSH_CHARS = 4096, 1 << 20, 1 << 22
RANGE_CHARS = 64
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER, CUT_OFF, BLANK, REPEATED = 3, 4, 8, 16  # a row's code: its initial, and what is wrong with it
LEGAL = {(0, 1), (1, 2), (2, 1)}
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])  # what a new turn makes of a state
KEPT = {(START, 0): AFTER_S, (START, 1): AFTER_U, (AFTER_S, 1): AFTER_U, (AFTER_A, 1): AFTER_U, (AFTER_U, 2): AFTER_A}
FAR = 1 << 40
BATCH_SETTING, FEW = "spark.sql.execution.arrow.maxRecordsPerBatch", 64
CHUNKS = (
    "conv string, chunk long, n long, low long, high long, turns long, first int, last int, illegal long, code binary, open boolean, "
    "digests array<binary>, roles array<string>, texts array<string>"
)


# --- damage ---------------------------------------------------------------------------------------------------------


def _fate(conv: str, turn: str) -> Column:
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    return F.crc32(key.cast("binary")) % 20


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text after a damage that depends on conversation and turn: some rows are lost, emptied, robbed of
    their closing signs, doubled, or given to the user. Null roles and texts are one space."""
    space, fate = F.lit(" "), F.col("fate")
    rows = conversations.select(
        F.col(conv).cast("string").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"), _fate(conv, turn).alias("fate"),
    ).where("fate <> 0")
    said = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), copies.alias("copy")).drop("copy")


# --- chunks ---------------------------------------------------------------------------------------------------------


def _code(role: str, text: str) -> int:
    said = text.rstrip(BLANKS)
    return INITIALS.get(role[:1], OTHER) + (0 if said and said[-1] in ".!?" else CUT_OFF if said else BLANK)


def _chunk(conv, rows, chunk: int) -> tuple:
    seen, codes, digests = set(), bytearray(), []
    for _, role, text in rows:
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        codes.append(_code(role, text) | (REPEATED if digest in seen else 0))
        seen.add(digest)
        digests.append(digest)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [c & 3 for c in codes]
    illegal = sum(pair not in LEGAL for pair in zip(initials, initials[1:]))
    ends = (min(turns), max(turns), len(set(turns))) if turns else (None, None, 0)
    is_open = any(c < BLANK for c in codes)
    return (conv, chunk, len(rows), *ends, initials[0], initials[-1], illegal, bytes(codes), is_open, digests, [r for _, r, _ in rows], [t for _, _, t in rows])


def _cut(batches, size: int = CHUNK):
    """Rows of a sorted range partition as chunks of one conversation each, of bounded rows and characters."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    number = TaskContext.get().partitionId() << 32
    now, rows, chars, out, waiting = None, [], 0, [], 0

    def frame():
        df = pd.DataFrame(out, columns=names)
        return df.astype({c: "Int64" for c in ("low", "high")})

    for batch in batches:
        turns = [None if t is None else int(t) for t in batch["turn"]]
        convs = [None if c is None else str(c) for c in batch["conv"]]
        for conv, turn, role, text in zip(convs, turns, batch["role"], batch["text"]):
            if rows and (conv != now or len(rows) == size or chars >= CHUNK_CHARS):
                out.append(_chunk(now, rows, number))
                number, waiting, rows, chars = number + 1, waiting + chars, [], 0
                if waiting >= FLUSH_CHARS:
                    yield frame()
                    out, waiting = [], 0
            now = conv
            rows.append((turn, role, text))
            chars += len(role) + len(text)
    if rows:
        out.append(_chunk(now, rows, number))
    if out:
        yield frame()


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """conv, turn, role, text as written chunks whose number gives the order: by conversation and turn (nulls first), ties by the
    first RANGE_CHARS characters of role and text and then by a hash of both. Equal rows may come to lie in several partitions."""
    keys = [
        F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substr("role", F.lit(1), F.lit(RANGE_CHARS)),
        F.substr("text", F.lit(1), F.lit(RANGE_CHARS)), F.md5(F.concat_ws(":", F.length("role"), "role", "text")), F.col("row"),
    ]
    placed = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    as_text = placed.select("conv", F.col("turn").cast("string").alias("turn"), "role", "text")  # pandas would make long turns with nulls doubles
    return written(as_text.mapInPandas(partial(_cut, size=size), CHUNKS), "conversations-chunks")


def _in_order() -> Window:
    return Window.partitionBy("conv").orderBy("chunk")


def _later_repeats(light: DataFrame, whole: DataFrame) -> DataFrame:
    """(chunk, again): positions of rows of conversations of several chunks that an earlier chunk has too."""
    many = whole.join(light.where("number > 1 or not final").select("chunk"), "chunk", "left_semi")
    rows = many.select("conv", "chunk", F.posexplode("digests").alias("at", "digest"))
    firsts = rows.groupBy("conv", "digest").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last")).where("first < last")
    firsts = firsts.select(F.col("conv").alias("c"), "digest", "first")
    again = rows.join(firsts, (F.col("conv").eqNullSafe(F.col("c"))) & (rows["digest"] == firsts["digest"])).where("chunk > first")
    return again.groupBy("chunk").agg(F.collect_list("at").alias("again"))


# --- costs ----------------------------------------------------------------------------------------------------------


def _closed(v: np.ndarray) -> np.ndarray:
    """Costs if turns may be inserted first."""
    v[:, AFTER_U] = np.minimum(v[:, AFTER_U], INSERT + v[:, AFTER_A])
    for state in (START, AFTER_S, AFTER_A):
        v[:, state] = np.minimum(v[:, state], INSERT + v[:, AFTER_U])
    return v


END = _closed(np.array([[0, FAR, FAR, 0]], np.int64))[0]


def _step(v: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Costs before a row from the costs behind it, for many chunks at once."""
    new = DELETE + v
    extra = np.where(code >= BLANK, FAR, np.where(code & CUT_OFF, TRUNCATED, 0))[:, None]
    new = np.minimum(new, extra + REROLE + v[:, NEXT])
    for (state, initial), to in KEPT.items():
        is_it = (code & 3) == initial
        new[:, state] = np.where(is_it, np.minimum(new[:, state], extra[:, 0] + v[:, to]), new[:, state])
    return _closed(new)


def backward(codes: list[np.ndarray], right: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list[np.ndarray] | None]:
    """Cost vectors before the first rows, given those behind the last; with ``keep`` also all in between."""
    v = np.array(right, np.int64).reshape(-1, 4)
    longest = max(map(len, codes), default=0)
    kept = [np.empty((len(c) + 1, 4), np.int64) for c in codes] if keep else None
    for i, c in enumerate(codes if keep else ()):
        kept[i][len(c)] = v[i]
    lengths = np.array([len(c) for c in codes])
    order = np.argsort(-lengths, kind="stable")
    padded = np.zeros((len(codes), longest), np.uint8)
    for i, c in enumerate(codes):
        padded[i, :len(c)] = c[::-1]
    for back in range(longest):
        live = order[: np.searchsorted(-lengths[order], -back, "left")]
        v[live] = _step(v[live], padded[live, back])
        if keep:
            for i in live:
                kept[i][lengths[i] - 1 - back] = v[i]
    return v, kept


def trace(codes: np.ndarray, costs: np.ndarray, state: int, final: bool) -> tuple[str, int]:
    """The least audit of a chunk from a state on, and the state in which it ends. At every step the least letter that keeps
    the cheapest cost; each letter leads to one state."""
    audit, at, n = [], 0, len(codes)
    while at < n or (final and not (state in (START, AFTER_A) and costs[n][state] == 0)):
        now, to = costs[at][state], int(NEXT[state])
        if at < n and DELETE + costs[at + 1][state] == now:
            audit.append("D")
            at += 1
        elif INSERT + costs[at][to] == now:
            audit.append("I")
            state = to
        else:
            code = int(codes[at])
            extra, kept = TRUNCATED if code & CUT_OFF else 0, KEPT.get((state, code & 3))
            if kept is not None and extra + costs[at + 1][kept] == now:
                audit.append("K")
                state = kept
            else:
                audit.append("R")
                state = to
            at += 1
    return "".join(audit), state


def _lefts(batches):
    for batch in batches:
        codes = [np.frombuffer(c, np.uint8) for c in batch["code"]]
        left, _ = backward(codes, np.array(batch["right"].tolist(), np.int64))
        left -= left.min(axis=1, keepdims=True)
        yield pd.DataFrame({"chunk": batch["chunk"], "left": list(left)})


def _exits(batches):
    """The state after a chunk for each of the four before it."""
    for batch in batches:
        codes = [np.frombuffer(c, np.uint8) for c in batch["code"]]
        _, kept = backward(codes, np.array(batch["right"].tolist(), np.int64), keep=True)
        out = [[trace(c, k, s, False)[1] for s in range(4)] for c, k in zip(codes, kept)]
        yield pd.DataFrame({"conv": batch["conv"], "chunk": batch["chunk"], "exits": out})


def _entries(batches):
    """The state before each chunk, from chunks that come sorted by conversation and number."""
    now, state, begun = None, START, False
    for batch in batches:
        out = []
        for conv, exits in zip(batch["conv"], batch["exits"]):
            if not begun or conv != now:
                now, state, begun = conv, START, True
            out.append(state)
            state = int(exits[state])
        yield pd.DataFrame({"chunk": batch["chunk"], "entry": out})


def solved(whole: DataFrame) -> DataFrame:
    """Per chunk: number, final, code, right (the cost vector behind it) and entry (the state before it); written."""
    light = whole.select("conv", "chunk", "code", "open", F.row_number().over(_in_order()).alias("number"), F.lead("chunk").over(_in_order()).isNull().alias("final"))
    light = written(light, "conversations-light")
    end, guess = F.array(*map(F.lit, END.tolist())), F.array(*[F.lit(0).cast("long")] * 4)
    single = light.where("number = 1 and final").select("chunk", "number", "final", "code", end.alias("right"), F.lit(0).alias("entry"))
    many = light.where("number > 1 or not final").join(_later_repeats(light, whole), "chunk", "left")
    marked = written(many.mapInPandas(_with_repeats, "conv string, chunk long, number int, final boolean, code binary, open boolean"), "conversations-many")
    passes = marked.withColumn("right", F.when(F.col("final"), end).otherwise(guess))
    lefts = written(passes.select("chunk", "code", "right").mapInPandas(_lefts, "chunk long, left array<long>"), "conversations-pass")
    state = written(passes.join(lefts, "chunk"), "conversations-pass")
    behind = _in_order().rowsBetween(1, Window.unboundedFollowing)
    while True:
        known = F.when(F.col("open") | F.col("final"), F.col("left"))
        true = F.when(F.col("final"), end).otherwise(F.first(known, ignorenulls=True).over(behind))
        seen = state.withColumn("true", true)
        wrong = written(seen.where(_shape("true") != _shape("right")).select("chunk", "code", F.col("true").alias("right")), "conversations-wrong")
        if wrong.isEmpty():
            break
        again = wrong.mapInPandas(_lefts, "chunk long, left array<long>").join(wrong.select("chunk", "right"), "chunk")
        again = again.select("chunk", F.col("left").alias("l"), F.col("right").alias("r"))
        fixed = state.join(again, "chunk", "left").withColumns({"left": F.coalesce("l", "left"), "right": F.coalesce("r", "right")}).drop("l", "r")
        state = written(fixed, "conversations-pass")
    exits = state.select("conv", "chunk", "code", "right").mapInPandas(_exits, "conv string, chunk long, exits array<long>")
    entries = exits.repartition("conv").sortWithinPartitions("conv", "chunk").mapInPandas(_entries, "chunk long, entry int")
    return written(single.union(state.join(entries, "chunk").select(*single.columns)), "conversations-solved")


def _shape(vector: str) -> Column:
    """A cost vector without its constant."""
    return F.transform(vector, lambda x: x - F.array_min(vector))


def _with_repeats(batches):
    for batch in batches:
        codes = []
        for code, again in zip(batch["code"], batch["again"]):
            marked = np.frombuffer(code, np.uint8).copy()
            if again is not None:
                marked[np.asarray(again, int)] |= REPEATED
            codes.append(marked.tobytes())
        out = batch.drop(columns="again").assign(code=codes)
        yield out.assign(open=[bool((np.frombuffer(c, np.uint8) < BLANK).any()) for c in codes])


# --- repair ---------------------------------------------------------------------------------------------------------


def _rows(audit: str, state: int, codes: np.ndarray, roles, texts) -> tuple[list[str], list[str], int]:
    """Roles and texts after the edits, and what these cost."""
    out_roles, out_texts, cost, at = [], [], 0, 0
    for edit in audit:
        if edit == "D":
            cost += DELETE
            at += 1
            continue
        new = "assistant" if state == AFTER_U else "user"
        if edit == "I":
            out_roles.append(new)
            out_texts.append("")
            cost += INSERT
            state = int(NEXT[state])
            continue
        code = int(codes[at])
        cost += (TRUNCATED if code & CUT_OFF else 0) + (REROLE if edit == "R" else 0)
        out_roles.append(new if edit == "R" else roles[at])
        out_texts.append(texts[at])
        state = int(NEXT[state]) if edit == "R" else KEPT[state, code & 3]
        at += 1
    return out_roles, out_texts, cost


def _pieces(batches):
    for batch in batches:
        codes = [np.frombuffer(c, np.uint8) for c in batch["code"]]
        _, kept = backward(codes, np.array(batch["right"].tolist(), np.int64), keep=True)
        out = []
        for c, k, entry, final, roles, texts in zip(codes, kept, batch["entry"], batch["final"], batch["roles"], batch["texts"]):
            audit, _ = trace(c, k, int(entry), bool(final))
            faults = [int(x) for x in ((c & BLANK > 0).sum(), ((c & REPEATED > 0) & (c & BLANK == 0)).sum(), ((c & CUT_OFF > 0) & (c & REPEATED == 0)).sum())]
            out.append((*faults, audit, *_rows(audit, int(entry), c, roles, texts)))
        made = pd.DataFrame(out, columns=["blank", "duplicate", "truncated", "audit", "roles", "texts", "cost"])
        yield pd.concat([batch[["conv", "chunk", "number", "final"]].reset_index(drop=True), made], axis=1)


def repaired(whole: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired turns, chunk by chunk: conv, chunk, number, final, faults, audit, roles, texts, cost."""
    rows = plan.join(whole.select("conv", "chunk", "roles", "texts"), "chunk")
    schema = (
        "conv string, chunk long, number int, final boolean, blank long, duplicate long, truncated long, audit string, roles array<string>, "
        "texts array<string>, cost long"
    )
    return rows.mapInPandas(_pieces, schema)


def _assembled(batches):
    """One row per conversation from pieces that come sorted; a text is hashed as it passes and never gathered."""
    now, begun, audits, costs, faults, digest, any_yet = None, False, [], 0, np.zeros(3, np.int64), None, False
    names = ["conv", "blank", "duplicate", "truncated", "cost", "audit", "repaired_sha256"]
    done = lambda: (now, *map(int, faults), costs, "".join(audits), digest.hexdigest())
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if not begun or row.conv != now:
                if begun:
                    out.append(done())
                now, begun, audits, costs, faults, digest, any_yet = row.conv, True, [], 0, np.zeros(3, np.int64), hashlib.sha256(), False
            audits.append(row.audit)
            costs += int(row.cost)
            faults += [row.blank, row.duplicate, row.truncated]
            for role, text in zip(row.roles, row.texts):
                digest.update((("\n" if any_yet else "") + f"{role}:{text}").encode())
                any_yet = True
        yield pd.DataFrame(out, columns=names)
    if begun:
        yield pd.DataFrame([done()], columns=names)


def report(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_rows: int = CHUNK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, after damage.

    Null ids are one conversation; null turns come first and count for no gap; null roles and texts are one space. Repeated
    rows are duplicates of the first. Turns that tie are ordered by role and text (see ``chunks``). Roles of other initials than
    s, u, a can only be deleted or re-roled. A conversation whose rows are all lost, or all deleted, has the hash of the empty
    text; no rows give no rows. Other columns are ignored. The audit of a conversation is one string, a letter per edit.
    """
    spark = conversations.sparkSession
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, FEW)
    try:
        whole = chunks(damaged(conversations, conv, turn, role, text), chunk_rows)
        plan = solved(whole)
        pieces = lambda rows: repaired(whole, plan.where(rows))
        line = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"]))
        figures = ["conv", "blank", "duplicate", "truncated", "cost", "audit"]
        single = pieces("number = 1 and final").select(*figures, F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256"))
        parts = pieces("number > 1 or not final").repartition("conv").sortWithinPartitions("conv", "chunk")
        many = parts.mapInPandas(_assembled, "conv string, blank long, duplicate long, truncated long, cost long, audit string, repaired_sha256 string")
        results = written(single.unionByName(many), "conversations-results")
    finally:
        spark.conf.set(BATCH_SETTING, before)
    earlier = lambda c: F.lag(c).over(_in_order())
    high = F.last("high", ignorenulls=True).over(_in_order().rowsBetween(Window.unboundedPreceding, -1))
    legal = F.lit(False)
    for a, b in sorted(LEGAL):
        legal |= (earlier("last") == a) & (F.col("first") == b)
    ends = whole.select(
        "conv", "low", "high", F.col("turns") - F.when(high == F.col("low"), 1).otherwise(0),
        F.col("illegal") + F.when(earlier("last").isNotNull() & ~legal, 1).otherwise(0),
    ).toDF("conv", "low", "high", "turns", "illegal")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    ends = ends.groupBy("conv").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"), F.sum("illegal").alias("illegal"))
    gaps = F.coalesce((wide("high") - wide("low") + 1 - wide("turns")).try_cast("long"), F.lit(0).cast("long"))
    ends = ends.select(F.col("conv").alias("c"), gaps.alias("gaps"), "illegal")
    full = results.join(ends, F.col("conv").eqNullSafe(F.col("c")))
    lost = conversations.groupBy(F.col(conv).cast("string").alias("conv")).agg(F.count_if(_fate(conv, turn) != 0).alias("left")).where("left = 0")
    zero = F.lit(0).cast("long")
    lost = lost.select("conv", *[zero.alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    out = full.select(lost.columns).union(lost)
    return out.select(F.col("conv").cast(conversations.schema[conv].dataType).alias("conv_id"), *out.columns[1:])
