"""Counts after edits against encoding the edited text from the start."""

import random

import pytest
from pyspark.sql import functions as F

from snapcat.llm import bpe
from snapcat.llm import tokencount as t


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def edited(text, edits):
    for at, remove, put in edits:
        at = min(max(at, 0), len(text))
        text = text[:at] + put + text[at + max(remove, 0) :]
    return text


@pytest.mark.parametrize("seed", range(60))
def test_random_edits(vocabulary, library, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(t, "LEAF", rng.choice([1, 3, 64]))
    parts = [" ", " ", "\n", "  ", "the", "ing", "'s", "12", "!", "é", "\xa0", "\x1c", "<|endof", "text|>", "<|endoftext|>", "a", "🙂", "՘"]
    if seed % 3 == 0:
        parts = [" the", " a", "b", "12", ".", "\nNow"]
    spell = lambda n: "".join(rng.choice(parts) for _ in range(n))
    text = spell(rng.choice([0, 1, 30, 300]))
    tool = bpe.encoder(vocabulary)
    own = t.CountedText(tool, *t.counted(tool, [text])[0])
    size = lambda x: len(library.encode(x, add_special_tokens=False).ids)
    assert (own.text(), own.n_tokens) == (text, size(text))
    for _ in range(25):
        edit = (rng.randrange(-1, len(text) + 3), rng.choice([0, 0, 1, 2, 9, 500 if rng.random() < 0.05 else 4]), spell(rng.randrange(4)))
        own.edit(*edit)
        text = edited(text, [edit])
        assert (own.text(), own.n_chars, own.n_tokens) == (text, len(text), size(text))


def test_an_edit_encodes_little(vocabulary):
    tool = bpe.encoder(vocabulary)
    text = "some words and more " * 50_000
    own = t.CountedText(tool, *t.counted(tool, [text])[0])
    own.edit(500_000, 3, "xyz")
    assert own.encoded < 100


def test_heads_of_texts_are_merged_together(vocabulary, monkeypatch):
    """Texts that each begin with words of their own need a few merges, not one a text."""
    calls = []
    plain = bpe.Encoder.merge
    monkeypatch.setattr(bpe.Encoder, "merge", lambda self, words: calls.append(len(words)) or plain(self, words))
    with bpe.encoder(vocabulary) as tool:
        texts = [f"head{k}qx and tail{k}" for k in range(200)]
        found = t.counted(tool, texts)
        assert len(calls) < 10
        assert [sum(tokens) for _, tokens in found] == [len(ids) // 4 for ids in tool.encode(texts)]
        # What is known of a chunk is not encoded again.
        calls.clear()
        own = t.CountedText(tool, *found[0])
        own.edit(own.n_chars, 0, " tail7")
        assert not calls and own.n_tokens == len(tool.encode([own.text()])[0]) // 4


def test_masks_without_addresses():
    """The shorter search finds what the whole one finds wherever there is no address."""
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice("ab.-+_1234567890 \n٣é") for _ in range(rng.randrange(40)))
        assert [m.span() for m in t.UNADDRESSED.finditer(text)] == [m.span() for m in t.MASKED.finditer(text)]
        assert not any(m["mail"] for m in t.UNADDRESSED.finditer(text))


def test_query(spark, sf_dir, library):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = t.op4_edited_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(docs) and any(r.n_edits > 1 for r in rows)
    size = lambda x: len(library.encode(x, add_special_tokens=False).ids)
    for r in rows:
        text = docs[r.doc_id].text or ""
        masked = t.MASKED.sub(lambda m: "[MAIL]" if m["mail"] else "[NUMBER]", text)
        assert (r.n_before, r.n_after) == (size(text), size(f"Source: {docs[r.doc_id].source}\n{masked}"))


def test_nulls_repeats_clashes_and_empty_tables(spark, vocabulary):
    rows = [(1, None, None), (2, "", [(5, 1, "a b")]), (3, "a b c", [(None, None, None), (1, 99, None)]), (3, "a b c", [(None, None, None), (1, 99, None)]), (None, "a b", [])]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits {t.EDITS}").withColumn("count", F.lit("x"))
    found = [tuple(r["count"])[:3] for r in t.count_edited(docs, vocabulary).collect()]
    assert found == [(0, 0, 0), (0, 2, 1), (3, 1, 2), (3, 1, 2), (2, 2, 0)]
    assert t.count_edited(docs.limit(0), vocabulary).count() == 0
