"""Repeated windows against a plain count, the query against its SQL."""

import random
from collections import Counter

import numpy as np
import parity
import pytest
from pyspark.sql import functions as F

from snapcat.llm import substring as s


def plain(texts, window):
    words = [[w for w in (t or "").translate({c: " " for c in range(9, 14)}).split(" ") if w] for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    spell = lambda k: " ".join(rng.choice("a b cc é D1 -".split()) + str(rng.randrange(4)) for _ in range(k))
    shared = [spell(rng.randrange(3, 30)) for _ in range(5)]
    texts = [rng.choice(["", "\n\t", None]) if rng.random() < 0.1 else "  ".join([spell(rng.randrange(12)), rng.choice(shared), spell(rng.randrange(9))]) for _ in range(n)]
    return [*texts, "x " * 30, "p q p q p q p q p q", texts[3], texts[3]]


@pytest.mark.parametrize("window", [1, 2, 5, 8])
@pytest.mark.parametrize("held", [1, 1 << 20])
def test_against_plain_count(spark, monkeypatch, window, held):
    texts = corpus(window)
    monkeypatch.setattr(s, "HELD_WINDOWS", held)
    monkeypatch.setattr(s, "HELD_PLACES", held)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = sorted(s.remove_repeated(docs, window=window).collect())
    assert [(r.n_words, r.n_removed, r.kept) for r in rows] == plain(texts, window)


def test_anchors_never_undercount():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)]
    own = s.Windows(texts, 9)
    places = Counter(own.places().tolist())
    at = np.flatnonzero(own.valid)
    a, b = own.exact(at)
    windows = Counter(zip(a.tolist(), b.tolist(), strict=True))
    assert len(at) == sum(max(0, len(t.split()) - 8) for t in texts)
    assert all(places[int(own.anchor[i])] >= windows[x, y] for i, x, y in zip(at, a.tolist(), b.tolist(), strict=True))
    assert windows.most_common(1)[0][1] > 1


def test_sketch_passes_all_repeated(spark, monkeypatch):
    """A sketch far too small lets windows pass, and loses none."""
    texts = corpus(9)
    monkeypatch.setattr(s, "MOST_SKETCH", 1 << 10)
    monkeypatch.setattr(s, "sketch_bits", lambda _: 11)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sorted(s.remove_repeated(docs, window=4).collect())
    assert [(r.n_words, r.n_removed, r.kept) for r in rows] == plain(texts, 4)


def test_windows_around_a_hot_phrase_are_dealt_out(spark):
    """Windows of different documents share the anchor in the phrase; no bucket has more than a few times its share."""
    rng = random.Random(8)
    phrase = " ".join(f"p{k}" for k in range(25))
    spell = lambda: " ".join(str(rng.randrange(10**9)) for _ in range(40))
    texts = [f"{spell()} {phrase} {spell()}" for _ in range(4000)]
    texts += texts[:1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    rows = sorted(s.remove_repeated(docs).collect())
    assert [(r.n_words, r.n_removed, r.kept) for r in rows] == plain(texts, 35)
    keyed = docs.select(F.col("doc_id").alias("row_key_1"), F.lit(0).cast("long").alias("row_key_2"), "text")
    bits = s.sketch_bits(sum(map(len, texts)))
    sketch = spark.sparkContext.broadcast(s.merged_sketch(keyed, 35, bits))
    sent = keyed.mapInArrow(s.finder(35, bits, sketch, 256), s.FOUND).where("not known")
    sizes = [r.n for r in sent.groupBy("bucket").agg(F.sum(F.size("a")).alias("n")).collect()]
    assert sum(sizes) > 4000 and max(sizes) < sum(sizes) / 10, (max(sizes), sum(sizes))


def test_long_text_in_portions(spark):
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10**9)) for _ in range(600_000))
    half = " ".join(text.split()[300_000:300_050])
    assert len(text) > 16 << 18
    docs = spark.createDataFrame([(1, text), (2, half)], "doc_id long, text string")
    assert sorted((r.n_words, r.n_removed) for r in s.remove_repeated(docs).collect()) == [(50, 50), (600_000, 50)]


def test_query(spark, sf_dir):
    con = parity.connect(sf_dir)
    assert parity.compare(spark, con, sf_dir, s.op9_repeated_substrings, s.OP9) == ""


def test_nulls_repeats_clashes_and_empty_tables(spark):
    long = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(1, None, 1), (None, long, 1), (2, long, 2), (2, long, 2), (3, long + " x", None), (4, "", 3), (5, "a b", 4)], "doc_id long, text string, first int").withColumn("row_key_1", F.lit(1))
    rows = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in s.remove_repeated(docs).collect())
    assert rows == [(0, 40, 40, ""), (1, 0, 0, ""), (2, 40, 40, ""), (2, 40, 40, ""), (3, 41, 40, "x"), (4, 0, 0, ""), (5, 2, 0, "a b")]
    assert s.remove_repeated(docs.limit(0)).count() == 0
