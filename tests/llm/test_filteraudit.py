"""Positional counts against single bits; the audit against following every document through every order."""

import itertools
import random
import re
from collections import Counter

import numpy as np

from snapcat.llm import filteraudit as f


def test_positional_popcount():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 5, 7, 100, 1001):
        words = rng.integers(0, 1 << 32, n, np.uint32)
        assert f.positional_popcount(words).tolist() == [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]


def test_survival_words():
    for failed in range(32):
        assert [bool(int(f.WORDS[failed]) >> s & 1) for s in range(32)] == [not s & failed for s in range(32)]
    assert len(f.ORDERS) == 120


def plain_failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) << 2 | bool(re.search(r"[#$%&*|]", text)) << 3


def plain(docs, labels):
    rows = []
    for i, text, part in docs:
        text = text or ""
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        own = {x for k, x in enumerate("ABCDE") if (plain_failed(text) | copy << 4) >> k & 1}
        rows.append((part or "", own, any(i == j and q == 1 for j, q, _ in labels if j is not None), any(i == j and t == 1 for j, _, t in labels if j is not None)))
    out, shares = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                now = [r for r in left if x in r[1]]
                own = [sum(x in r[1] for r in gone), sum(r[1] == {x} for r in rows if r[0] == part), sum(r[2] for r in now), sum(r[3] for r in now)]
                left, gone = [r for r in left if x not in r[1]], gone + now
                out[part, order, step] = [len(left), len(now), *own]
                shares[part, x] += len(now)
    return sorted((*k, *v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def audited(spark, docs, labels):
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "'x' AS part", "1 AS failed", "2 AS good", "3 AS digest", "4 AS first")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS id", "true AS positive")
    return sorted(tuple(r) for r in f.audit(f.survivors(f.judged(frame, known))).collect())


def test_audit(spark):
    rng = random.Random(5)
    spell = lambda: " ".join(rng.choice(["a", "b", "Cd", "é", "x#", "\x1cq", "y\n"]) + str(rng.randrange(rng.choice([3, 200]))) for _ in range(rng.choice([3, 49, 50, 80])))
    texts = [None, "", "same words", "same words", "SHOUT", "\xa0", *(spell() for _ in range(30))]
    docs = [(rng.choice([None, *range(40)]) if k % 9 == 0 else k, rng.choice(texts), rng.choice([None, "", "s", "t"])) for k in range(120)]
    docs += docs[:5]
    labels = [(rng.choice([None, *range(120)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(90)]
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_many_parts_and_empty(spark, monkeypatch):
    docs = [(k, "word", f"s{k % 7}") for k in range(50)]
    assert audited(spark, docs, []) == plain(docs, [])
    assert audited(spark, [], []) == []


def test_long_text():
    text = "word " * 1_200_000 + "End é"
    assert f.failed_alone(text) == plain_failed(text) == 2
    assert f.failed_alone("Ab é" * 40) == plain_failed("Ab é" * 40)
