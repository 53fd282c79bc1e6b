import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from bazaar.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
OTHER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
HARD = ["", " ", "  ", "a", "it's", " it's", "''s", "'s's's", "they'rex 'll'v've", "a  b\n\n c\t\td ", "\n's", "　x　 y", "1'2's", "Ünï'd ñ ½ Ⅷ", "don't 'tis ’s", "x" * 5000, "ab" * 3000, "'", "'r", "'re", " 're", "\x1c\x1d", "a\0b", "😀😀'm", "\U0001e5d0a1", " \n", "!!!'s"]


def ids(texts):
    return [x[0].tolist() for x in bpe.encode_texts(texts, PATH)]


def test_hard_texts_equal_the_library():
    assert ids(HARD) == [OTHER.encode_ordinary(t) for t in HARD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'strevmld \n\t a1!é 　"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_any_text_equals_the_library(texts):
    assert ids(texts) == [OTHER.encode_ordinary(t) for t in texts]


def test_every_code_point_has_the_library_class():
    rest = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    random.Random(1).shuffle(rest)
    texts = ["a".join(rest[i : i + 5000]) for i in range(0, 200_000, 5000)]
    assert ids(texts) == [OTHER.encode_ordinary(t) for t in texts]


def test_chunks_of_texts(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 7)
    monkeypatch.setattr(bpe, "CACHE", 3)
    assert ids(HARD) == [OTHER.encode_ordinary(t) for t in HARD]


def test_frame(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(2**60 + 1, "big key"), (1, None), (1, None), (None, "x y")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, ids int, key int")
    got = sorted(map(str, bpe.digests(docs, PATH).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        tokens = OTHER.encode_ordinary(t or "")
        want.append((i, len(tokens), sha(",".join(map(str, tokens)).encode()), sha((t or "").encode())))
    from pyspark.sql import Row

    assert got == sorted(str(Row(doc_id=a, n_tokens=b, ids_sha256=c, decoded_sha256=d)) for a, b, c, d in want)
    assert bpe.digests(docs.limit(0), PATH).count() == 0
    assert bpe.encode(docs.where("doc_id = 2"), PATH).first().asDict()["offsets"] == [0]
    tokens = bpe.encode(docs, PATH)
    assert {bytes(r[0]).decode() for r in tokens.select(bpe.decode(tokens["ids"], PATH)).collect()} == {t or "" for _, t in rows}
