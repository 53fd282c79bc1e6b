"""Toxicity by a weighted finite-state pattern grammar (operator 2).

Words become symbols (insult, threat, target, negation, report) by a lexicon of words and word beginnings. Three transducers
are composed into one machine: the first marks what a negation reaches, the second what is reported speech, the third what is
aimed at somebody. It reads clauses that hold an insult or a threat and gives each match a weight; a document's clause scores
feed a logistic model. Lexicon weights and the model are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import held_out, keyed, unkeyed, written

WORD, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK = range(7)

# Seed words (a trailing * stands for any ending), in English, German, French and Spanish.
SEEDS = {
    INSULT: "idiot* moron* stupid* loser* scum trash worthless pathetic disgusting clown* dumm* blöd* trottel abschaum wertlos* widerlich* imbécile* crétin* débile* ordure* minable* dégoûtant* imbécil* estúpid* basura asqueros* patétic* inútil*",
    THREAT: "kill* hurt* destroy* beat punch töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours he she they them him her du dich dir ihr euch sie tu toi te vous vos ton eux usted ustedes tú ti te ellos",
    NEGATION: "not no never neither nor isn aren wasn don doesn didn won kein* nicht nie niemals pas ne jamais aucun* nunca jamás ningún ninguna",
    REPORT: "said says wrote claimed called reported quoted sagte schrieb behauptete nannte dit écrit appelé dijo escribió llamó",
}
# Log weights of the grammar.
NEGATED, REPORTED, AIMED, UNAIMED_THREAT = math.log(0.3), math.log(0.5), math.log(1.5), math.log(0.2)
SCOPE = 3
TOKENS = re.compile(r"[^\W\d_]+|[.!?;:\n]")
#: Labelled documents that may train, entries that the lexicon may learn, and the share of toxic documents (a lower bound at
#: this many standard deviations) from which a word beginning is an insult.
TRAINING_DOCS, LEXICON, SURE, DEVIATIONS = 10_000, 5_000, 0.5, 3.0
SHORTEST, LONGEST = 3, 7
CACHE = 150_000


class Transducer:
    """A deterministic weighted transducer: arcs[state, symbol] = (state, symbol, log weight)."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def then(self, other: Transducer) -> Transducer:
        """The composition: the other one reads what this one writes."""
        first, arcs = (self.start, other.start), {}
        todo, done = [first], set()
        while todo:
            here = todo.pop()
            if here in done:
                continue
            done.add(here)
            for (state, symbol), (to, middle, weight) in self.arcs.items():
                if state == here[0]:
                    end, out, more = other.arcs[here[1], middle]
                    arcs[here, symbol] = ((to, end), out, weight + more)
                    todo.append((to, end))
        return Transducer(first, arcs)


def _tagged(symbol, *tags):
    return (symbol[0], symbol[1] | frozenset(tags)) if isinstance(symbol, tuple) else (symbol, frozenset(tags))


def grammar() -> Transducer:
    """Negation, then reported speech, then aim; an insult or threat comes out with the tags that it met."""
    hot = (INSULT, THREAT)
    tags = [frozenset(t) for k in range(3) for t in ((), ("negated",), ("reported",), ("negated", "reported"))[k : k + 2]]
    marked = [(h, t) for h, t in product(hot, set(tags))]
    plain = [TARGET, NEGATION, REPORT, WORD, BREAK]
    arcs = {}
    for left in range(SCOPE + 1):
        for s in (*plain, *hot):
            to = SCOPE if s == NEGATION else 0 if s == BREAK else max(0, left - 1)
            out = _tagged(s, "negated") if s in hot and left else _tagged(s) if s in hot else s
            arcs[left, s] = (to, out, NEGATED if s in hot and left else 0.0)
    negation = Transducer(0, arcs)
    arcs = {}
    for inside in (0, 1):
        for s in (*plain, *marked):
            to = 1 if s == REPORT else 0 if s == BREAK else inside
            arcs[inside, s] = (to, _tagged(s, "reported") if inside and s in marked else s, REPORTED if inside and s in marked else 0.0)
    report = Transducer(0, arcs)
    arcs = {}
    for seen in (0, 1):
        for s in (*plain, *marked):
            to = 1 if s == TARGET else 0 if s == BREAK else seen
            if s in marked:
                arcs[seen, s] = (to, _tagged(s, "aimed") if seen else s, AIMED if seen else UNAIMED_THREAT if s[0] == THREAT else 0.0)
            else:
                arcs[seen, s] = (to, s, 0.0)
    return negation.then(report).then(Transducer(0, arcs))


class Lexicon(dict):
    """Word -> symbol; ``weight`` has the weight of those that are insults or threats. Beginnings are walked like a trie."""

    def __init__(self, learned: dict[str, float]):
        super().__init__()
        self.whole, self.beginning = {}, {}
        for symbol, words in SEEDS.items():
            for w in words.split():
                (self.beginning if w[-1] == "*" else self.whole)[w.rstrip("*")] = (symbol, 1.0)
        for entry, value in learned.items():
            (self.whole if entry[-1] == "$" else self.beginning)[entry.rstrip("$")] = (INSULT, value)
        self.lengths = sorted({len(b) for b in self.beginning}, reverse=True)
        self.weight: dict[str, float] = {}

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
            self.weight.clear()
        if word in ".!?;:\n":
            symbol, value = BREAK, 0.0
        else:
            symbol, value = self.whole.get(word) or max((self.beginning[word[:n]] for n in self.lengths if word[:n] in self.beginning), key=lambda x: x[1], default=(WORD, 0.0))
        if symbol in (INSULT, THREAT):
            self.weight[word] = value
        self[word] = symbol
        return symbol


FEATURES = ("best", "total", "clauses", "density", "aimed", "softened", "threats")


class Reader:
    """Runs the composed machine over the clauses of a text that matter."""

    def __init__(self, learned: dict[str, float]):
        self.lexicon, self.machine = Lexicon(learned), grammar()

    def clauses(self, text: str) -> list[list[tuple[str, int, frozenset, float]]]:
        """For every clause with a match: its matches as (word, symbol, tags, score)."""
        words = TOKENS.findall(text.lower())
        symbols = list(map(self.lexicon.__getitem__, words))
        present = set(symbols)
        if INSULT not in present and THREAT not in present:
            return []
        arcs, found = self.machine.arcs, []
        hot = [i for i, s in enumerate(symbols) if s in (INSULT, THREAT)]
        done = -1
        for i in hot:
            if i <= done:
                continue
            first = i
            while first and symbols[first - 1] != BREAK:
                first -= 1
            state, at, matches = self.machine.start, first, []
            while at < len(symbols) and symbols[at] != BREAK:
                state, out, weight = arcs[state, symbols[at]]
                if isinstance(out, tuple):
                    value = self.lexicon.weight.get(words[at])
                    if value is None:  # the cache began anew meanwhile
                        self.lexicon.pop(words[at], None)
                        self.lexicon[words[at]]
                        value = self.lexicon.weight[words[at]]
                    matches.append((words[at], out[0], out[1], value * math.exp(weight)))
                at += 1
            done = at
            found.append(matches)
        return found

    def features(self, text: str) -> tuple[float, ...]:
        found = self.clauses(text)
        if not found:
            return (0.0,) * len(FEATURES)
        scores = [sum(m[3] for m in matches) for matches in found]
        flat = [m for matches in found for m in matches]
        share = sum(len(m[0]) for m in flat) / len(text)
        aimed = sum(m[3] for m in flat if "aimed" in m[2])
        softened = sum(m[3] for m in flat if m[2] & {"negated", "reported"})
        threats = sum(m[3] for m in flat if m[1] == THREAT)
        return (max(scores), math.log1p(sum(scores)), math.log1p(len(found)), share, math.log1p(aimed), math.log1p(softened), math.log1p(threats))


def entries(text: str) -> set[str]:
    """What the lexicon may learn from a text: beginnings of its words, and short whole words (with a trailing $)."""
    out = set()
    for w in set(re.findall(r"[^\W\d_]{%d,}" % SHORTEST, text.lower())):
        out.update(w[:n] for n in range(SHORTEST, min(LONGEST, len(w)) + 1))
        if len(w) <= LONGEST:
            out.add(w + "$")
    return out


def lower_bound(good: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Wilson's lower bound of a share."""
    z, share = DEVIATIONS, good / n
    return (share + z * z / (2 * n) - z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        bend = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(bend, slope), -5, 5)
    return w


class Model:
    def __init__(self, learned: dict[str, float], weights: np.ndarray):
        self.learned, self.weights = learned, weights


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, y) of at most ``most`` labelled documents that are not held out, picked by a hash of their id; written."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    one = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return written(texts.join(F.broadcast(some), "doc_id").select("text", "y"), f"labelled-{label}")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from at most TRAINING_DOCS labelled documents. Only counts of entries and a feature row for each come back."""
    rows = labelled(docs, labels, "toxic", TRAINING_DOCS)

    def count(batches):
        seen, toxic = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                found = entries(text)
                seen.update(found)
                if y:
                    toxic.update(found)
            if len(seen) > CACHE:
                yield pd.DataFrame({"entry": list(seen), "n": list(seen.values()), "bad": [toxic[e] for e in seen]})
                seen, toxic = Counter(), Counter()
        if seen:
            yield pd.DataFrame({"entry": list(seen), "n": list(seen.values()), "bad": [toxic[e] for e in seen]})

    counted = rows.mapInPandas(count, "entry string, n long, bad long").groupBy("entry").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    often = counted.where(F.col("bad") > DEVIATIONS**2 * SURE / (1 - SURE) - 1).where("bad * 2 > n").orderBy(F.desc("bad"), "entry").limit(LEXICON).toPandas()
    learned: dict[str, float] = {}
    if len(often):
        bound = lower_bound(often["bad"].to_numpy(float), often["n"].to_numpy(float))
        learned = {e: float(b) for e, b in zip(often["entry"], bound) if b >= SURE}

    def read(batches):
        reader = Reader(learned)
        for batch in batches:
            yield pd.DataFrame([(*reader.features(t), float(y)) for t, y in zip(batch["text"], batch["y"])], columns=[*FEATURES, "y"])

    table = rows.mapInPandas(read, ", ".join(f"{f} double" for f in (*FEATURES, "y"))).toPandas()
    table = table.sort_values([*FEATURES, "y"])  # so that no order of tasks shows in the sums
    if not len(table):
        return Model(learned, np.array([2.0] + [0.0] * (len(FEATURES) - 1) + [-2.0]))
    return Model(learned, logistic(table[list(FEATURES)].to_numpy(), table["y"].to_numpy()))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1), n_clauses (clauses with a match), worst (the words of the highest clause, joined by blanks).

    Every row gets a row, whole texts are read; null and empty texts have no clause and get the model's constant. Keys may
    repeat or be null; other columns are ignored.
    """
    learned, weights = model.learned, model.weights

    def run(batches):
        reader = Reader(learned)
        for batch in batches:
            rows = []
            for t in batch["text"]:
                x = reader.features(t)
                found = reader.clauses(t) if x[0] else []
                worst = max(found, key=lambda c: sum(m[3] for m in c), default=[])
                z = float(np.dot(weights[:-1], x) + weights[-1])
                rows.append((1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), len(found), " ".join(m[0] for m in worst)))
            out = pd.DataFrame(rows, columns=["score", "n_clauses", "worst"])
            out.insert(0, "key", batch["key"].to_numpy())
            yield out

    out = keyed(docs, key, text).mapInPandas(run, "key string, score double, n_clauses int, worst string")
    return unkeyed(out, docs, key)


def probability(model: Model):
    """From a column of texts that are not null to their scores, in the rows they stand in."""
    learned, weights = model.learned, model.weights

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(learned)
        for texts in batches:
            z = np.array([np.dot(weights[:-1], reader.features(t)) + weights[-1] for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and what the grammar matched, for every document."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses", "worst")
