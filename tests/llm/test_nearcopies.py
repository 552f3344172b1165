"""Near copies against a comparison of all pairs."""

import random

import corpus_pipeline as p
import numpy as np
from pyspark.sql import functions as F

from snapcat.llm import nearcopies as n
from snapcat.llm import simhash


def plain_set(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """Smallest id of each component, all pairs compared."""
    parent = {i: i for i, _ in rows}
    own = {i: plain_set(t) for i, t in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in own.items():
        for j, t in own.items():
            if j < i and 5 * len(s & t) >= 4 * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {find(i) for i in own}


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert {r.doc_id for r in n.keep_one(docs).collect()} == plain_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_pairs_about_the_limit(spark):
    """Copies with a few words changed, on both sides of 0.8; few of them are within 3 bits of each other's fingerprint."""
    rng = random.Random(7)
    rows = []
    for k in range(80):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 120, 300]))]
        rows.append((2 * k, " ".join(words)))
        for _ in range(rng.randrange(1, 1 + len(words) // 30)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        rows.append((2 * k + 1, " ".join(words).upper()))
    expected = plain_kept(rows)
    assert 90 < len(expected) < 150
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in p.near_duplicates(spark, docs, "").collect()} == expected


def test_fingerprints_link(spark, monkeypatch):
    """With bands that never meet, similar texts are linked by their fingerprints alone; equal fingerprints of unlike sets are not."""
    repeated = " ".join(["the same five words again"] * 400)
    rows = [(k, f"{repeated} {' '.join(f'{name}{k}x{i}' for i in range(40))}") for k, name in enumerate("abc")]
    long = [f"w{i}" for i in range(4000)]
    rows += [(10 + k, " ".join([*long, f"end{k}"])) for k in range(4)]
    assert len({simhash.fingerprint(t, 5) for i, t in rows if i < 10}) == 1
    apart = lambda own: (sketch(own)[0], np.array([hash((own.tobytes(), k)) for k in range(n.BANDS)], np.int64).view(np.uint64))
    sketch = n.sketch
    monkeypatch.setattr(n, "sketch", apart)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in n.keep_one(docs).collect()} == plain_kept(rows) == {0, 1, 2, 10}


def test_chains_of_copies(spark):
    """Each copy is similar to its neighbours only; a band's first member does not know them all."""
    rng = random.Random(3)
    words, rows = [f"w{k}" for k in range(200)], []
    for k in range(60):
        rows.append((k, " ".join(words)))
        for at in rng.sample(range(200), 3):
            words[at] = f"x{k}-{at}"
    rows += [(100 + k, f"quite other words {k} and more of them than five") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in n.keep_one(docs).collect()} == plain_kept(rows)


def test_large_group(spark, monkeypatch):
    """Two thousand copies of one text, most pairs of them on both sides of 0.8, in tiles of a few sets."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(2000):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 9)):
            words[at] = f"x{k}-{at}"
        rows.append((k, " ".join(words)))
    monkeypatch.setattr(n, "TILE_BYTES", 100_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    kept = {r.doc_id for r in n.keep_one(docs).collect()}
    assert kept == plain_kept_of(rows) and 1 < len(kept) < 1500


def plain_kept_of(rows):
    """As plain_kept, with counts of common shingles from a table of who has which."""
    import numpy as np

    own = [sorted(map(hash, plain_set(t))) for _, t in rows]
    names = {h: k for k, h in enumerate({h for s in own for h in s})}
    sizes = np.array([len(s) for s in own])
    who = [[] for _ in names]
    for i, s in enumerate(own):
        for h in s:
            who[names[h]].append(i)
    root = np.arange(len(rows))
    for i, s in enumerate(own):
        common = np.bincount(np.concatenate([who[names[h]] for h in s]), minlength=len(rows))
        near = np.flatnonzero(5 * common >= 4 * (sizes[i] + sizes - common))
        root[np.isin(root, root[near])] = root[near].min()
    return {rows[i][0] for i in range(len(rows)) if root[i] == i}


def test_tiles():
    """Links between components only, one for each member and other component."""
    import pyarrow as pa

    keys = ["band", "row", "column"]
    sets = {1: range(10), 2: range(9), 3: range(9), 4: range(50, 60), 5: range(1, 10)}
    rows = [(7, 0, 0, side, p, r, list(sets[p])) for side, p, r in [(0, 1, 1), (0, 4, 4), (1, 1, 1), (1, 2, 2), (1, 3, 2), (1, 4, 4), (1, 5, 5)]]
    rows += [(8, 0, 0, 0, 1, 1, list(sets[1])), (8, 0, 1, 1, 2, 2, list(sets[2]))]
    kinds = pa.schema([*((c, pa.int64()) for c in ("band", "row", "column", "side", "point", "root")), ("set", pa.list_(pa.int64()))])
    for size in (1, 4, 100):
        table = pa.Table.from_arrays([pa.array([r[k] for r in rows], kinds[k].type) for k in range(7)], schema=kinds)
        found = [tuple(x.values()) for b in n.tile_links(keys)(iter(table.to_batches(size))) for x in b.to_pylist()]
        assert sorted(found) == [(1, 2), (1, 5)]
    assert list(n.tile_links(keys)(iter([]))) == []


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(4, None), (3, ""), (None, "a b c"), (9, "A b\nc"), (9, "A b\nc"), (8, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("point", F.lit(1)).withColumn("set", F.lit("x"))
    kept = n.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 8, 9]
    assert n.keep_one(docs.limit(0)).count() == 0
