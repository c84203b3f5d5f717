import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from snipquarry.llm.bpe_encode import TOKENIZERS, Encoder, Transducer, encode_corpus, lexicon_bytes, load_ranks

RANKS = load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
WORDS = [b" the", b"the", b" there", b" then", b"a", b" adapter", b"adapters", "é".encode()]


@pytest.fixture(scope="module")
def own():
    return Encoder(np.frombuffer(lexicon_bytes(WORDS, RANKS), dtype=np.int64), RANKS)


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_transducer():
    ws = sorted({b"", b"a", b"ab", b"abs", b"bs", b"cabs", b"cab"})
    t = Transducer.compile(ws)
    assert t.walk([*ws[1:], b"b", b"abx", b"z"]).tolist() == [1, 2, 3, 4, 5, 6, -1, -1, -1]
    suffixes = sorted(p + b"ation" for p in (b"n", b"st", b"rel", b"cre"))
    assert len(Transducer.compile(suffixes).final) < sum(map(len, suffixes)) / 2
    assert Transducer.compile([]).walk([b"a"]).tolist() == [-1]


def test_same_as_library(own, theirs):
    texts = [None, "", "   ", " the adapters then\n\n\tthere's", "<|endoftext|> x", "é ٣٤ ²½ \U0001f600​ a\u0085b\x1c", "x" * 3000, "ab" * 2000 + " the", "一二三。四"]
    ids, at = own.encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == theirs.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(own, theirs, text):
    assert own.encode([text])[0].tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_corpus(spark, theirs):
    d = spark.createDataFrame([(1, "the the the cat", "w"), (2, None, "x"), (3, "", "y"), (3, " ", "z"), (4, "the " * 5000, None)], "doc_id long, text string, ids string")
    got = encode_corpus(d).collect()
    assert len(got) == 5
    assert sorted((r.doc_id, len(r.ids)) for r in got)[:4] == [(1, 4), (2, 0), (3, 0), (3, 1)]
    assert next(r.ids for r in got if r.doc_id == 4) == theirs.encode("the " * 5000, add_special_tokens=False).ids
    assert encode_corpus(d.limit(0)).count() == 0
