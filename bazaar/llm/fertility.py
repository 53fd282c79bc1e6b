"""Quality rules from tokeniser fertility (operator 9).

A public vocabulary with byte fallback tells how well a text is made of pieces it knows: characters per token, the share of
tokens that are single bytes, and the entropy of the tokens. Ordinary text of a script lies in a band of each; texts outside
are rejected. Plain counts (words, symbols, repeated lines and windows) go along.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame

from bazaar.llm.common import chunks, keyed, mix, unkeyed

WHITE, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
WINDOW, FEWEST, MOST_REPEATED = 5, 10, 20
#: Words that a worker keeps tokenised; beyond it the cache starts anew.
CACHE, CHUNK = 200_000, 1_000_000

# Scripts told apart by the first word of a letter's Unicode name, and the band of each measure:
# characters per token, share of byte tokens, and least bits of token entropy for texts of so many tokens or more (shorter
# texts cannot reach much, longer ones that stay below repeat a few tokens). A script that is not listed is "other".
BANDS = {
    "latin": {"chars_per_token": (1.35, 7.5), "byte_share": (0.0, 0.20), "entropy": ((200, 5.6), (1000, 6.2))},
    "cyrillic": {"chars_per_token": (1.1, 7.0), "byte_share": (0.0, 0.25), "entropy": ((200, 4.0), (1000, 5.0))},
    "greek": {"chars_per_token": (0.8, 5.0), "byte_share": (0.0, 0.50), "entropy": ((200, 3.5), (1000, 4.0))},
    "other": {"chars_per_token": (0.2, 8.0), "byte_share": (0.0, 1.0), "entropy": ((200, 3.5), (1000, 4.0))},
}
_SCRIPTS = ("latin", "cyrillic", "greek", "other")


class Words:
    """Token ids of words: one row of a ragged array for each word met."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        get = self.index.get
        found = [get(w) for w in words]
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = list(dict.fromkeys(words[i] for i in missing))
            if len(self.index) and len(self.index) + len(new) > CACHE:
                self.clear()
                return self.look_up(words)
            base = len(self.index)
            self.index.update(zip(new, range(base, base + len(new))))
            tokens = self.model.encode([w.decode() for w in new], num_threads=1)
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            flat = np.fromiter((t for row in tokens for t in row), np.int32, int(sizes.sum()))
            self.ids = np.concatenate([self.ids, flat])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            for i in missing:
                found[i] = self.index[words[i]]
        return np.array(found, np.int64)

    def tokens(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        first, sizes = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.ids[np.repeat(first, sizes) + at], sizes


@lru_cache(2)
def words_of(path: str) -> Words:
    return Words(path)


@lru_cache(4096)
def _script(character: str) -> int:
    name = unicodedata.name(character, "").split(" ")[0].lower()
    return _SCRIPTS.index(name) if name in _SCRIPTS else 3


def script(text: str) -> int:
    """The script of most letters; latin without letters."""
    if text.isascii():
        return 0
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    values, counts = np.unique(points[points >= 128], return_counts=True)
    totals = np.zeros(4, np.int64)
    totals[0] = sum(text.count(c) for c in "etaoinsr")  # a part of the Latin letters is enough to tell
    for v, c in zip(values.tolist(), counts.tolist()):
        if (character := chr(v)).isalpha():
            totals[_script(character)] += c
    return int(totals.argmax())


def _alike(rows: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For every window but the last: does the next one hold the same words of the same document."""
    same = doc[starts[1:]] == doc[starts[:-1]]
    for k in range(WINDOW):
        same &= rows[starts[1:] + k] == rows[starts[:-1] + k]
    return same


def repeated(rows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For every word: is it in a window of WINDOW words that its document has twice or more. doc is sorted."""
    n, out = len(rows) - WINDOW + 1, np.zeros(len(rows), bool)
    if n < 2:
        return out
    whole = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    if len(whole) < 2:
        return out
    key = mix(doc[whole].astype(np.uint64))
    for k in range(WINDOW):
        key = mix(key + rows[whole + k].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = _alike(rows, doc, whole[order])
    if (same != (key[order][1:] == key[order][:-1])).any():  # two different windows have one key: sort by the words themselves
        order = np.lexsort([*(rows[whole + k] for k in range(WINDOW)), doc[whole]])
        same = _alike(rows, doc, whole[order])
    hit = whole[order][np.r_[same, False] | np.r_[False, same]]
    for k in range(WINDOW):
        out[hit + k] = True
    return out


def measure(texts: list[str], path: str) -> pd.DataFrame:
    """Counts and measures of whole texts, a row each, in order."""
    known, n = words_of(path), len(texts)
    data = [t.encode() for t in texts]
    split = [b.split() for b in data]
    n_words = np.array([len(w) for w in split], np.int64)
    doc = np.repeat(np.arange(n), n_words)
    rows = known.look_up([w for words in split for w in words])
    again = repeated(rows, doc)
    ids, sizes = known.tokens(rows)
    owner = np.repeat(doc, sizes)
    tokens = np.bincount(owner, minlength=n)
    bytes_ = np.bincount(owner, known.is_byte[ids], n)
    pair, counts = np.unique(owner * np.int64(1 << 20) + ids, return_counts=True)
    whose = pair >> 20
    share = counts / tokens[whose]
    entropy = np.bincount(whose, -share * np.log2(share), n)
    chars = np.array([len(t) - len(b) + len(b.translate(None, WHITE)) for t, b in zip(texts, data)], np.int64)
    lines = []
    for b in data:
        full = [line for line in b.split(b"\n") if line.strip(WHITE)]
        lines.append(len(full) - len(set(full)))
    some = np.maximum(tokens, 1)
    return pd.DataFrame(
        {
            "n_words": n_words,
            "word_chars": chars,
            "n_symbols": [len(b) - len(b.translate(None, SYMBOLS)) for b in data],
            "n_dup_lines": lines,
            "n_repeat_words": np.bincount(doc, again, n).astype(np.int64),
            "n_tokens": tokens.astype(np.int64),
            "chars_per_token": chars / some,
            "byte_share": bytes_ / some,
            "entropy": entropy,
            "script": [_SCRIPTS[script(t)] for t in texts],
        }
    )


def in_bands(m: pd.DataFrame) -> np.ndarray:
    """False for texts outside a band of their script."""
    ok, tokens = np.ones(len(m), bool), m["n_tokens"].to_numpy()
    of_script = lambda value: m["script"].map({s: value(b) for s, b in BANDS.items()}).to_numpy(float)
    for name in ("chars_per_token", "byte_share"):
        values = m[name].to_numpy()
        ok &= (tokens == 0) | (values >= of_script(lambda b: b[name][0])) & (values <= of_script(lambda b: b[name][1]))
    for k in (0, 1):
        long = tokens >= of_script(lambda b: b["entropy"][k][0])
        ok &= ~long | (m["entropy"].to_numpy() >= of_script(lambda b: b["entropy"][k][1]))
    return ok


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double, script string"


def quality_rules(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the measures of the whole text, base_failed, kept. path: a sentencepiece model that every executor has.

    A null or empty text has no words: every measure is 0, base_failed is true. Every row gets a row; repeated keys too.
    Other columns are ignored. Very short texts are judged by characters per token and byte share only.
    """

    def run(batches):
        for batch in batches:
            texts, keys = batch["text"].tolist(), batch["key"]
            for first, last in chunks(np.array([len(t) + 1 for t in texts]), CHUNK):
                m = measure(texts[first:last], path)
                m.insert(0, "key", keys.iloc[first:last].to_numpy())
                failed = (m["n_words"] < FEWEST) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
                yield m.assign(base_failed=failed, kept=in_bands(m) & ~failed)
        words_of(path).clear()  # an idle worker keeps no more than the vocabulary

    out = keyed(docs, key, text).mapInPandas(run, f"key string, {MEASURES}, base_failed boolean, kept boolean")
    return unkeyed(out, docs, key)
