"""Fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from snapcat.llm import simhash
from snapcat.llm.components import components, forest


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, points):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= 3:
                a, b = sorted((find(ids[i]), find(ids[j])))
                parent[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one Two", "A b c", "ÀB à x y z", "a\x1cb c\xa0d e\x85f g", "x y z " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_fingerprint_in_portions():
    rng = random.Random(3)
    text = " ".join(rng.choice(["alpha", "Beta", "gamma", "d"]) + str(rng.randrange(99)) for _ in range(700_000))
    assert len(text) > 1 << 22
    assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_code_is_perfect():
    code = simhash.Golay()
    words = np.arange(1 << 23, dtype=np.uint32)
    lead = code.nearest(words)
    own = words[simhash.Golay().error[code.low[words & 0xFFF] ^ code.high[words >> 12]] == 0]
    word_of = np.zeros(4096, np.uint32)
    word_of[own >> 11] = own
    assert len(own) == 4096 == len(set((own >> 11).tolist()))
    assert np.bitwise_count(words ^ word_of[lead]).max() == 3


def test_forest():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    node, root = forest(a, b)
    label = dict(zip(node.tolist(), root.tolist(), strict=True))
    assert all(label.get(x, x) == label.get(y, y) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    assert len(label) == len(set(node.tolist())) and not set(root.tolist()) & set(label)


def test_components_of_chains_and_stars(spark):
    rows = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5), (2001, 2000), (2001, 2000)]
    found = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 40)}, 2001: 2000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("tile", [8192, 5])
def test_links_of_points(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(11)
    points = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        points.add(base)
        for _ in range(rng.randrange(8)):
            near = base
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                near ^= 1 << bit
            points.add(near)
    centre = rng.getrandbits(64)
    points |= {centre ^ 1 << a ^ 1 << b for a in range(12) for b in range(12)}
    points = sorted(points)
    expected = plain_components(points, points)
    frame = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in points], "point long")
    found = {r.node % 2**64: r.root % 2**64 for r in components(simhash.point_links(frame)).collect()}
    groups = lambda of: sorted(sorted(p for p in points if of(p) == r) for r in {of(p) for p in points})
    assert groups(lambda p: found.get(p, p)) == groups(expected.__getitem__)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    points = [plain_fingerprint(d.text) for d in docs]
    expected = plain_components([d.doc_id for d in docs], points)
    rows = simhash.op10_simhash_components(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == sorted(
        (d.doc_id, f"{p:016x}", expected[d.doc_id]) for d, p in zip(docs, points, strict=True))


def test_nulls_repeats_clashes_and_empty_tables(spark):
    long = "one two three four five six seven"
    rows = [(4, None, 1), (3, "", 1), (None, long, 2), (9, long, 2), (9, long, 2), (8, "other words here now and then", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, point int").withColumn("root", F.lit("x"))
    found = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert found == [(0, 9), (3, 3), (4, 3), (8, 8), (9, 9), (9, 9)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 8, 9]
    assert simhash.keep_one(docs.limit(0)).count() == 0
    only = spark.createDataFrame([(None, long), (None, long)], "doc_id long, text string")
    assert simhash.keep_one(only).count() == 1
