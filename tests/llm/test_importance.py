"""CRCs of runs against zlib, the draw against a plain one."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from snapcat.llm import importance as m

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_crcs(text, n):
    words = plain_words(text)
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def test_shifts():
    rng = np.random.default_rng(2)
    for a, b in ((b"", b"x"), (b"abc", b""), (b"one ", b"two" * 50), (b"p" * 9, b"q" * 70_001), (b"z", bytes(256)), (b"z", bytes(255))):
        crc = np.array([zlib.crc32(a)], np.uint32)
        assert int(m.shifted(crc, np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)
        assert int(m.past_space(crc)[0]) == zlib.crc32(a + b" ")
    assert m.shifted(rng.integers(0, 1 << 32, 5, np.uint32), np.zeros(5, int)).shape == (5,)


def test_run_crcs(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", "...", "One", "a b", "É x-y\x00Z9", *(" ".join(rng.choice(["alpha", "B", "c3", "ß", "w" * 300]) for _ in range(rng.randrange(40))) for _ in range(40))]
    for held in (1 << 17, 5):
        monkeypatch.setattr(m, "HELD", held)
        # Short blocks also within a text.
        monkeypatch.setattr(m, "word_blocks", (lambda raw, keep, most: pieces(raw, keep, most)) if held == 5 else m.word_blocks)
        for n in (1, 2, 4):
            found = [Counter() for _ in texts]
            for block in m.text_blocks(pa.array(texts), n):
                for of, crcs in m.run_crcs(block, n):
                    for k, crc in zip(of.tolist(), crcs.tolist(), strict=True):
                        found[k][crc] += 1
            assert found == [Counter(plain_crcs(t, n)) for t in texts]


def pieces(raw, keep, most):
    words, held = raw.split(), []
    if not words:
        yield []
    for k in range(0, len(words), most):
        yield held + words[k : k + most]
        held = (held + words[k : k + most])[-keep:] if keep else []


def plain(docs, target, words=1, buckets=10_000, percent=10, least=20, seed=2024):
    s, t = ([0] * buckets for _ in range(2))
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for crc in plain_crcs(text, words):
                counts[crc % buckets] += 1
    gain = [math.floor(1000 * math.log(((b + 1.0) * (sum(s) + float(buckets))) / ((a + 1.0) * (sum(t) + float(buckets))))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        own = [gain[crc % buckets] for crc in plain_crcs(text, words)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text))])
    drawn = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


def drawn(spark, docs, target, **more):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS rank", "2 AS score", "3 AS text_hash", "4 AS range")
    found = m.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), **more)
    return found.select("doc_id", "n_features", "weight", "score", "rank").collect()


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


def test_resample(spark):
    rng = random.Random(6)
    spell = lambda n: " ".join(rng.choice(["alpha", "Beta", "c", "delta", "é"]) for _ in range(n))
    docs = [(k, spell(rng.randrange(15, 60))) for k in range(150)] + [(None, spell(30)), (900, None), (901, ""), (902, "!?")]
    target = ["alpha alpha beta", None, spell(9)]
    assert by_id(drawn(spark, docs, target)) == by_id(plain(docs, target))
    assert by_id(drawn(spark, docs, target, words=3, buckets=97, percent=50)) == by_id(plain(docs, target, 3, 97, 50))
    assert by_id(drawn(spark, docs, [])) == by_id(plain(docs, []))


def test_ties_repeats_and_empty(spark):
    docs = [(7, "one two " * 15)] * 40 + [(None, "one two " * 15)] * 10
    found = drawn(spark, docs, ["one"], percent=50)
    assert by_id(found) == by_id(plain(docs, ["one"], percent=50))
    assert sorted(r.rank for r in found if r.rank) == list(range(1, 26))
    assert drawn(spark, [], ["one"]) == []
    assert [r.rank for r in drawn(spark, [(1, "few words")], ["one"])] == [None]
