"""Counts against a plain count, estimates against the same steps in one place."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapcat.llm import quality as q


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    count = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + j for i in range(len(words) - 7) if count[tuple(words[i : i + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>") if text else 0, dup, len(hit)]


def test_counts():
    rng = random.Random(1)
    spell = lambda: " ".join(rng.choice(["a", "b", "é#", "c\n", "\x1cd", "$|", "\xa0"]) for _ in range(rng.randrange(60)))
    texts = [None, "", " \n\n", "x\nx\n \n \nx ", "a b c d e f g h " * 3, "p q r s t u v w x p q r s t u v w", *(spell() for _ in range(300))]
    assert q.statistics(texts).tolist() == [plain(t) for t in texts]
    assert q.statistics([]).shape == (0, 5)


def test_chi2():
    assert abs(q.chi2(11.0705, 5) - 0.95) < 1e-5 and abs(q.chi2_point(0.975, 5) - 12.8325) < 1e-3


def estimate_in_one_place(x):
    """The same concentration steps over all rows of a pool."""
    n, floors = len(x), np.square(q.FLOORS)
    order = np.sort(x, 0)
    point = lambda share: order[int(np.ceil(n * share)) - 1] / q.UNIT
    middle, inverse = point(0.5), np.diag(1 / np.square(np.maximum((point(0.75) - point(0.25)) / 1.349, q.FLOORS)))
    z = x / q.UNIT
    dist = lambda: np.einsum("ni,ij,nj->n", z - middle, inverse, z - middle)
    solve = lambda y, share: (y.mean(0), np.linalg.inv(q.widening(share) * np.cov(y.T, bias=True) + np.diag(floors)))
    for _ in range(q.STEPS):
        step = np.floor(8 * np.log2(dist() + 2**-20))
        at = np.sort(step)
        near = step <= at[int(np.ceil(n * q.SHARE)) - 1]
        middle, inverse = solve(z[near], q.SHARE)
    middle, inverse = solve(z[dist() <= q.chi2_point(0.975, 5)], 0.975)
    return dist()


@pytest.mark.parametrize("most", [10_000, 0])
def test_verdicts(spark, monkeypatch, most):
    monkeypatch.setattr(q, "MOST_BROADCAST", most)
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = {r.doc_id: r for r in q.op5_quality(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    pools, by = defaultdict(list), Counter()
    passed = []
    for d in docs:
        r, own = rows[d.doc_id], plain(d.text)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == own
        assert r.base_failed == (own[0] < 20 or 100 * own[4] > 30 * own[0])
        if r.base_failed:
            assert not r.kept
        else:
            passed.append((d, own))
            by[d.lang, d.source] += 1
    rest = Counter()
    for (lang, _), n in by.items():
        rest[lang] += n if n < q.LEAST else 0
    for d, own in passed:
        pools[(d.lang, d.source) if by[d.lang, d.source] >= q.LEAST else d.lang if rest[d.lang] >= q.LEAST else ""].append((d.doc_id, own))
    assert len(pools) > 3
    for own in pools.values():
        x = np.array([[np.log1p(c[0]), np.log1p(c[1] / c[0]), *np.sqrt(np.array(c[2:]) / c[0])] for _, c in own])
        x = np.floor(x * q.UNIT + 0.5)
        if len(own) >= q.LEAST:
            for (i, _), d in zip(own, estimate_in_one_place(x), strict=True):
                assert abs(rows[i].distance - d) < 1e-6 * max(1, d) and rows[i].kept == (d <= q.CUTOFF)
        else:
            assert all(rows[i].kept for i, _ in own)


def test_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = q.op5_quality(spark, sf_dir).where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in found}
    print(n)
    assert n.get((1, False), 0) <= 0.002 * n[1, True]
    assert n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))


def test_nulls_repeats_clashes_and_empty_tables(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, None, None, "s"), (None, text, None, None), (2, text, "en", None), (2, text, "en", None), (3, "", "en", "s")] + [(i, text.replace("word1", f"w{i}"), "de", "t") for i in range(10, 140)]
    docs = spark.createDataFrame([*rows, (200, "$$$ ## " * 3 + text, "de", "t")], "doc_id long, text string, lang string, source string").withColumn("pool", F.lit(1)).withColumn("x0", F.lit(2)).withColumn("counts", F.lit(1))
    found = {(r.doc_id, r.kept, r.base_failed) for r in q.judge(docs).collect()}
    assert {(1, False, True), (None, True, False), (2, True, False), (3, False, True), (10, True, False), (200, False, False)} <= found
    assert q.judge(docs).count() == len(rows) + 1
    assert q.judge(docs.limit(0)).count() == 0
