"""Spans against a search window by window, the query against its SQL."""

import random

import parity
import pytest
from pyspark.sql import functions as F

from snapcat.llm import decontaminate as d


def plain(words, items, window=d.WINDOW):
    hit, names, longest = set(), set(), 0
    for name, own in items:
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == own[k : k + n]:
                    hit.update(range(at, at + n))
                    names.add(name)
        for a in range(len(words)):
            for b in range(len(own)):
                run = 0
                while a + run < len(words) and b + run < len(own) and words[a + run] == own[b + run]:
                    run += 1
                longest = max(longest, run)
    return longest, sorted(hit), names


def plain_windows(words, items, window=d.WINDOW):
    """Hit words by looking every window up; for longer inputs."""
    at = {}
    hit, names = set(), set()
    for name, own in items:
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            at.setdefault(tuple(own[k : k + n]), set()).add(name)
    for n in {len(w) for w in at}:
        for k in range(len(words) - n + 1):
            if found := at.get(tuple(words[k : k + n])):
                hit.update(range(k, k + n))
                names |= found
    return None, hit, names


@pytest.mark.parametrize("seed", range(40))
def test_scan(seed):
    rng = random.Random(seed)
    letters = [b"a", b"b", b"c", b"d"][: rng.choice([1, 2, 4])]
    items = [(str(i % 5), [rng.choice(letters) for _ in range(rng.randrange(0, 12))]) for i in range(rng.randrange(0, 7))]
    words = [rng.choice([*letters, b"zz"]) for _ in range(rng.randrange(0, 60))]
    window = rng.choice([1, 3, 5])
    longest, spans, names = d.Automaton(items, window).scan(words)
    assert (longest, [i for a, b in spans for i in range(a, b + 1)], names) == plain(words, items, window)
    assert spans == d.union(spans)


def test_words():
    assert [w.decode() for w in d.words_of("Ab-c 9é\x00Z_z à\x7f `~ Ü")] == ["ab", "c", "9é", "z", "z", "à", "Ü"]
    assert d.words_of(None) == d.words_of(" .,") == []


def test_cut():
    text = "Keep this, é. One two\nthree four! And that"
    assert d.cut(text, [{"first": 3, "last": 6}]) == "Keep this, é.! And that"
    assert d.cut("one two", [{"first": 0, "last": 1}]) == ""


def test_query(spark, sf_dir):
    con = parity.connect(sf_dir)
    assert parity.compare(spark, con, sf_dir, d.op8_benchmark_spans, d.OP8) == ""


def make(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string").withColumn("found", F.lit(1)), spark.createDataFrame(items, "item_id string, text string"))


def test_blocks_find_what_one_block_finds(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(6)]
    spell = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs, items = make(spark, [(i, spell(80)) for i in range(30)], [(f"i{i}", spell(rng.randrange(1, 60))) for i in range(9)])
    whole = sorted(map(str, d.benchmark_spans(docs, items, window=4).collect()))
    monkeypatch.setattr(d.blocks, "__defaults__", (20,))
    assert len(list(d.blocks(items, "item_id", "text", 4))) > 3
    assert sorted(map(str, d.benchmark_spans(docs, items, window=4).collect())) == whole


def test_nulls_repeats_clashes_and_empty_tables(spark):
    ten = "a b c d e f g h i j"
    docs, items = make(spark, [(1, None), (None, ""), (2, ten + " k"), (2, ten + " k"), (3, "x y " * 20 + ten)], [("q", ten), ("q", "y X"), (None, "x y x"), ("n", None), ("e", " ")])
    rows = d.benchmark_spans(docs.withColumnRenamed("found", "Other"), items).select("doc_id", "found.*").collect()
    assert [(r.doc_id, r.n_words, r.longest, len(r.spans), r["items"]) for r in rows] == [
        (1, 0, 0, 0, []), (None, 0, 0, 0, []), (2, 11, 10, 1, ["q"]), (2, 11, 10, 1, ["q"]), (3, 50, 10, 2, ["q"])]
    kept = d.decontaminate(docs, spark.createDataFrame([("q", ten)], "item_id string, text string"))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) == [(3, ("x y " * 20).strip())]
    assert kept.count() == 3
    assert d.benchmark_spans(docs.limit(0), items).count() == 0
    assert {r.found.n_words for r in d.benchmark_spans(docs, items.limit(0)).collect()} == {0, 11, 50}
