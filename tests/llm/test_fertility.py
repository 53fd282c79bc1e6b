import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from bazaar.llm import fertility

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = ["", " \n\t", "a", "one two three four five " * 4, "x\ny\nx\n\n\n y\n\ty\n", "#*$%&|<> a#b", "日本語 の 文章 です", "é à ü\xa0b ñ", "привет мир как дела " * 3, "word " * 30, "\x00 \x1c a\x85b", "😀 " * 12]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, marked = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            marked.update(i + k for i in at for k in range(5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tokens = [t for w in words for t in MODEL.encode(w)]
    counts = np.array(list(Counter(tokens).values())) / max(1, len(tokens))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), len(tokens), sum(map(MODEL.is_byte, tokens)), round(float(-(counts * np.log2(counts)).sum()), 9))


def test_measures(monkeypatch):
    monkeypatch.setattr(fertility, "CACHE", 9)
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(90))) for _ in range(40)]
    m = fertility.measure(texts, PATH)
    got = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_tokens, round(r.byte_share * max(1, r.n_tokens)), abs(round(r.entropy, 9))) for r in m.itertuples()]
    assert got == [(*p[:-1], abs(p[-1])) for p in map(plain, texts)]


def test_frame(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, None), (None, "a"), (1, "a")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, script string")
    out = fertility.quality_rules(docs, PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert fertility.quality_rules(docs.limit(0), PATH).count() == 0


def test_scripts():
    assert [fertility.script(t) for t in ("abc", "é", "привет", "αβγδ", "日本語", "")] == [0, 0, 1, 2, 3, 0]


def test_windows_of_one_key(monkeypatch):
    """Keys of few values: different windows meet, and what counts are the words."""
    rng = np.random.default_rng(3)
    rows, doc = rng.integers(0, 3, 900), np.sort(rng.integers(0, 4, 900))
    want = fertility.repeated(rows, doc)
    assert 0 < want.sum() < 900
    monkeypatch.setattr(fertility, "mix", lambda x: x % np.uint64(5))
    assert (fertility.repeated(rows, doc) == want).all()
