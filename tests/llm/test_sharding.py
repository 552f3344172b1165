"""Capacities against exhaustive search, whole tables against their laws."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import parity
import pytest
from pyspark.sql import functions as F

from snapcat.llm import sharding as s


def least_capacity(sizes, shards):
    best = [0] + [10**18] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[i], sum(sizes[i:j])) for i in range(j + 1)) for j in range(len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed", range(30))
def test_cuts(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 7, rng.randrange(1, 60)]) for _ in range(rng.randrange(1, 14))]
    shards = rng.randrange(1, 8)
    cuts = s.Cuts(list(itertools.accumulate(sizes)), shards)
    low = max(max(sizes), -(-sum(sizes) // shards))
    best = cuts.smallest(low, low + max(sizes))
    assert best == least_capacity(sizes, shards)
    places = [0, *cuts.even(best), sum(sizes)]
    assert places == sorted(places) and len(places) == shards + 1
    assert max(b - a for a, b in itertools.pairwise(places)) == best
    assert set(places) <= {0, *cuts.bounds}


@pytest.mark.parametrize("summary", [20, 40, 300, 1 << 16])
def test_rounds_find_the_same_capacity(spark, summary):
    rng = random.Random(9)
    sizes = [rng.choice([17, 18, 40, rng.randrange(16, 3000)]) for _ in range(600)]
    upto = list(itertools.accumulate(sizes))
    groups = spark.createDataFrame([(str(i).encode(), b, u) for i, (b, u) in enumerate(zip(sizes, upto, strict=True))], "digest binary, bytes long, upto long").cache()
    exact = s.Cuts(upto, 7)
    low = -(-upto[-1] // 7)
    best = exact.smallest(low, low + max(sizes))
    places = [0, *s.cut_places(groups, 7, summary), upto[-1]]
    assert max(b - a for a, b in itertools.pairwise(places)) == best
    assert set(places) <= {0, *upto}


def check(rows, docs, shards):
    texts = {d.doc_id: d.text or "" for d in docs}
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((d.doc_id, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs)
    slots, size, at = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        at[texts[r.doc_id]].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in at.values())
    groups = defaultdict(int)
    for d in docs:
        groups[d.text or ""] += len((d.text or "").encode()) + 16
    order = [groups[t] for t in sorted(groups, key=lambda t: hashlib.sha256(t.encode()).digest())]
    assert max(size.values()) == least_capacity(order, shards)
    return size


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    size = check(s.op1_minimax_shards(spark, sf_dir).collect(), docs, 40)
    assert len(size) == 40


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert parity.compare(spark, parity.connect(sf_dir), sf_dir, s.op1_minimax_shards, s.OP1) == ""


def test_query_has_no_python(spark, sf_dir):
    plan = s.op1_minimax_shards(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "a"), (4, "a"), (5, "b" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("size", F.lit(1)).withColumn("digest", F.lit(None).cast("string"))
    found = s.shard(docs, 3).collect()
    check(found, docs.collect(), 3)
    assert len({r.shard for r in found if r.doc_id in (1, 2)}) == 1
    check(s.shard(docs, 40).collect(), docs.collect(), 40)
    assert s.shard(docs.limit(0), 4).count() == 0
    nulls = spark.createDataFrame([(None, "x"), (None, "y"), (None, "y")], "doc_id long, text string")
    assert sorted((r.shard, r.slot) for r in s.shard(nulls, 1).collect()) == [(0, 0), (0, 1), (0, 2)]
