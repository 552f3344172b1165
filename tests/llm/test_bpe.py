"""The codec against the tokenizers library."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from snapcat.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(vocabulary, text):
    import numpy as np

    return np.frombuffer(bpe.Encoder.encode(bpe.encoder(vocabulary), [text])[0], np.int32).tolist()


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_any_text(vocabulary, library, text):
    assert ids(vocabulary, text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\tab'sé1!\xa0\x1c"))
def test_white_space(vocabulary, library, text):
    assert ids(vocabulary, text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "", " ", "  a  b \n\n c", "it's we'll 12 34é", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "՘࢏ x y",
    "ab" * 40, "x" * 5000, "🙂" * 30, "Donaudampfschifffahrtsgesellschaft" * 5, "\x1c\x85  　z", "a" * 64, "a" * 65, "a" * 33,
])
def test_cases(vocabulary, library, text):
    assert ids(vocabulary, text) == library.encode(text, add_special_tokens=False).ids


def test_long_text_in_portions(vocabulary, library):
    rng = random.Random(7)
    text = "".join(rng.choice(["the ", "ing", " 12", "\n", "é", "!!"]) for _ in range(600_000))
    assert len(text) > 1 << 20
    assert ids(vocabulary, text) == library.encode(text, add_special_tokens=False).ids


def test_kept_words_stay_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    tool = bpe.Encoder(vocabulary)
    texts = [f"word{i} other{i} 's{i}" for i in range(40)]
    for some in (texts[:9], texts, texts[5:]):
        assert tool.encode(some) == [bpe.encoder(vocabulary).encode([t])[0] for t in some]


def test_frame(spark, sf_dir, vocabulary, library):
    rows = bpe.op6_bpe_codec(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        own = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        back = library.decode(own, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_nulls_repeats_clashes_and_empty_tables(spark, vocabulary):
    docs = spark.createDataFrame([(1, None, 5, "x"), (1, "a b", 6, None), (1, "a b", 6, None), (None, "", 7, "y")], "doc_id long, text string, ids int, decoded string")
    rows = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    assert [r.decoded for r in rows] == ["", "a b", "a b", ""]
    assert [len(r.ids) for r in rows] == [0, 2, 2, 0]
    assert bpe.decode(bpe.encode(docs.limit(0), vocabulary), vocabulary).count() == 0


def test_first_words_of_many_texts_are_merged_together(vocabulary, monkeypatch):
    calls, merge = [], bpe.Encoder.merge
    monkeypatch.setattr(bpe.Encoder, "merge", lambda self, words: calls.append(len(words)) or merge(self, words))
    texts = [f"first{i}x follows" for i in range(300)] + ["", " ", "one", "two  spaces", "a\nb"]
    found = bpe.Encoder(vocabulary).encode(texts)
    assert len(calls) <= 10
    assert found == [bpe.Encoder(vocabulary).encode([t])[0] for t in texts]
