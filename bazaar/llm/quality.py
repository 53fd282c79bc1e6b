"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated (operator 10).

Every word has a sparse random index vector. The vector of a word is the sum of the index vectors of its neighbours over the
whole corpus; words share ``BUCKETS`` rows by a hash, so the table has a fixed size and may go to every executor. A document
is the frequency-weighted mean of its words' vectors with a few pooled counts; a small numpy network on top gives a
probability whose temperature is fitted on documents that did not train.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import chunks, held_out, keyed, mix, unkeyed
from bazaar.llm.toxicity import labelled

BUCKETS, SIZE, SIGNS, REACH = 1 << 14, 32, 2, 2
TOKENS = re.compile(r"\w+|[^\w\s]+")
#: Labelled documents that may train (a fifth of them sets the temperature), hidden units, passes.
TRAINING_DOCS, HIDDEN, EPOCHS = 10_000, 32, 60
RARE = 1e-3
CHUNK, CACHE = 4_000_000, 200_000
EXTRAS = 7


class Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = out = zlib.crc32(word.encode()) % BUCKETS
        return out


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero entries of each bucket's random index vector."""
    bits = mix(np.arange(1, BUCKETS * SIGNS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(BUCKETS, SIGNS)
    return (bits % np.uint64(SIZE)).astype(np.int64), 1.0 - 2.0 * ((bits >> np.uint64(40)) & np.uint64(1)).astype(float)


def tokens(texts: list[str], buckets: Buckets) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Buckets of all words of the texts, and how many each text has."""
    words = [TOKENS.findall(t) for t in texts]
    at = buckets.__getitem__
    return np.array([b for w in words for b in map(at, w)], np.int64), np.array([len(w) for w in words], np.int64), words


def gather(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Word vectors (BUCKETS x SIZE) and word counts of the buckets, from every word of every document.

    Each task adds up a table of its own; the tables are summed by bucket. What comes to the driver has a fixed size.
    """
    names = [f"c{i}" for i in range(SIZE)]

    def run(batches):
        place, sign = index_vectors()
        total, seen, known = np.zeros(BUCKETS * SIZE), np.zeros(BUCKETS), Buckets()
        for batch in batches:
            texts = [t for t in batch["text"] if t]
            for first, last in chunks(np.array([len(t) for t in texts]), CHUNK):
                b, n, _ = tokens(texts[first:last], known)
                doc = np.repeat(np.arange(last - first), n)
                seen += np.bincount(b, minlength=BUCKETS)
                for step in range(1, REACH + 1):
                    same = doc[step:] == doc[:-step]
                    left, right = b[:-step][same], b[step:][same]
                    for word, near in ((left, right), (right, left)):
                        for k in range(SIGNS):
                            total += np.bincount(word * SIZE + place[near, k], sign[near, k], BUCKETS * SIZE)
        full = np.flatnonzero(seen)
        yield pd.DataFrame(total.reshape(BUCKETS, SIZE)[full], columns=names).assign(bucket=full, n=seen[full])

    schema = ", ".join(f"{c} double" for c in names) + ", bucket long, n double"
    parts = docs.select(F.col(text).alias("text")).mapInPandas(run, schema)
    summed = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).toPandas()
    vectors, counts = np.zeros((BUCKETS, SIZE)), np.zeros(BUCKETS)
    vectors[summed["bucket"]], counts[summed["bucket"]] = summed[names], summed["n"]
    return vectors, counts


def word_table(vectors: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What pooling adds up: centred unit vectors times a weight that frequent words have less of, then the weight itself."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    total = max(counts.sum(), 1.0)
    unit = unit - (counts[:, None] * unit).sum(0) / total
    weight = RARE / (RARE + counts / total)
    return np.hstack([unit * weight[:, None], weight[:, None]]).astype(np.float32)


def pooled(texts: list[str], table: np.ndarray, known: Buckets) -> np.ndarray:
    """A row for each text: mean vector, its length, and counts; an empty text is all zeros."""
    out = np.zeros((len(texts), SIZE + EXTRAS))
    for first, last in chunks(np.array([len(t) + 1 for t in texts]), CHUNK // 4):
        b, n, words = tokens(texts[first:last], known)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        starts = (np.cumsum(n) - n)[full]
        sums = np.add.reduceat(table[b], starts, axis=0, dtype=np.float64)
        mean = sums[:, :SIZE] / np.maximum(sums[:, SIZE:], 1e-9)
        rows = first + full
        out[rows, :SIZE] = mean
        for i, k, m, s in zip(rows, full, mean, sums[:, SIZE]):
            t, w = texts[i], words[k]
            shout = sum(map(str.isupper, w))
            letters = sum(map(str.isalnum, w))
            out[i, SIZE:] = (np.linalg.norm(m), np.log(len(w)) / 10, len(set(w)) / len(w), shout / len(w), letters / len(w), len(t) / len(w) / 10, s / len(w))
    return out


class Network:
    """Two layers, trained by Adam on standardised rows; ``temperature`` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = self.prepared(x)
        tune = rng.random(len(x)) < 0.2 if len(x) >= 50 else np.zeros(len(x), bool)
        n = x.shape[1]
        p = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
        rows, step = np.flatnonzero(~tune), 0
        for epoch in range(EPOCHS):
            for part in np.array_split(rng.permutation(rows), max(1, len(rows) // 128)):
                step += 1
                a = np.maximum(x[part] @ p[0] + p[1], 0)
                d = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -30, 30))) - y[part]) / len(part)
                back = np.outer(d, p[2]) * (a > 0)
                grads = [x[part].T @ back + 1e-4 * p[0], back.sum(0), a.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
                for i, g in enumerate(grads):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    p[i] = p[i] - 3e-3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if tune.any():
            z = self.logit(x[tune], ready=True)
            loss = lambda t: np.mean(np.logaddexp(0, z / t) - y[tune] * z / t)
            self.temperature = float(min(np.geomspace(0.5, 5, 61), key=loss))

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x: np.ndarray, ready: bool = False) -> np.ndarray:
        x = x if ready else self.prepared(x)
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, table: np.ndarray) -> Network:
    """Fits on at most TRAINING_DOCS labelled documents; their pooled rows come to the driver."""

    def run(batches):
        known = Buckets()
        for batch in batches:
            x = pooled(batch["text"].tolist(), table, known)
            yield pd.DataFrame({"x": list(x), "y": batch["y"].astype(float)})

    rows = labelled(docs, labels, "quality", TRAINING_DOCS).mapInPandas(run, "x array<double>, y double").toPandas()
    if not len(rows):
        rows = pd.DataFrame({"x": [np.zeros(SIZE + EXTRAS)], "y": [1.0]})
    x, y = np.stack(rows["x"].to_list()), rows["y"].to_numpy()
    order = np.lexsort((y, *x.T))  # so that no order of tasks shows in the fit
    return Network(x[order], y[order])


def score(docs: DataFrame, table: np.ndarray, network: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (probability of label 1), n_tokens. A row for every row; null and empty texts are pooled to zeros and scored.

    Keys may repeat or be null; other columns are ignored; whole texts are read.
    """

    def run(batches):
        known = Buckets()
        for batch in batches:
            texts, keys = batch["text"].tolist(), batch["key"]
            for first, last in chunks(np.array([len(t) + 1 for t in texts]), CHUNK):
                some = texts[first:last]
                yield pd.DataFrame({"key": keys.iloc[first:last], "score": network.probability(pooled(some, table, known))})

    return unkeyed(keyed(docs, key, text).mapInPandas(run, "key string, score double"), docs, key)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    table = word_table(*gather(docs))
    out = score(docs, table, train(docs, labels, table))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
