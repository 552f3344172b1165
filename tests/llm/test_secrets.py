"""Verdicts against the planted tokens, features by hand, redaction."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapcat.llm import secrets as s

PLANTED = re.compile(r"token = \"([0-9a-f]{40})\"", re.IGNORECASE)


def test_features():
    name, f = s.describe("AKIAabcd1234efgh", 'the api_key: "', '" and', "a/test/b.py", frozenset(["abcd"]))
    at = dict(zip(s.FEATURES, f, strict=True))
    assert name == "api_key" and len(f) == len(s.FEATURES)
    assert (at["length"], at["upper"], at["digit"], at["covered"]) == (16, 0.25, 0.25, 0.25)
    assert (at["uu"], at["ul"], at["ld"], at["dl"]) == (3 / 15, 1 / 15, 1 / 15, 1 / 15)
    assert (at["assigned"], at["quoted"], at["credential"], at["credential_near"], at["path_depth"], at["path_test"]) == (1, 1, 1, 1, 2, 1)
    assert s.covered("thethethe", frozenset(["the"])) == 1 and s.covered("xthey", frozenset(["the", "they"])) == 0.8


@pytest.mark.parametrize("text, values", [
    ('password = "hunter2!x"', ["hunter2!x"]),
    ('db_password: "Tr0ub4dor&3", pwd=\'x9Kd82mQpL\'', ["Tr0ub4dor&3", "x9Kd82mQpL"]),
    ("postgres://u:S3cretPw9@h/db https://ghp_x9@host ftp://a:p@ss@h", ["S3cretPw9", "ghp_x9", "p@ss"]),
    ("AWS_SECRET_ACCESS_KEY=abcd1234EFGH5678ijkl== SOME_LONG_SETTING=abcd1234EFGH5678", ["abcd1234EFGH5678ijkl==", "abcd1234EFGH5678"]),
    ("PASSWD=a+b/c;d! https://h/?token=q1&user=7", ["a+b/c;d!", "q1"]),
    ('"api_key": "a\\"b c"} author: jsmith1990 monkey=1 http://h:80/x', ['a\\"b c']),
    ("SECRET_URL=postgres://u:S3cretPw9@h/db pwd=", ["S3cretPw9"]),
    ('password = "open', ["open"]),
    ("abcd1234EFGH5678== password=\npwd: ''", ["abcd1234EFGH5678=="]),
])
def test_candidates(text, values):
    assert [text[a:b] for a, b in s.places(text)] == values
    assert all(len(s.describe(v, "", "", "", frozenset())[1]) == len(s.FEATURES) for v in values)


def test_placeholders_are_whole_words():
    placeholder = lambda value, before="", path="": [s.describe(value, before, "", path, frozenset())[1][s.FEATURES.index(c)] for c in ("placeholder", "path_test")]
    assert placeholder("q7", "the latest key for yourself is ", "latest/x") == [0, 0]
    assert placeholder("your-token-here") == placeholder("myTestKey1") == placeholder("changeme1") == placeholder("xxxxxxxx") == [1, 0]
    assert placeholder("q7", "an example: ", "a/test_b/c") == [1, 1]


def test_time_is_linear():
    for text in ("key=" * 100_000, "key='" * 100_000, "a:" * 200_000, "x" * 400_000, "://a:" * 80_000, 'key="' + "\\" * 200_000, 'key="' + '\\"' * 200_000):
        began = time.perf_counter()
        s.places(text)
        assert time.perf_counter() - began < 5


def test_trees_are_the_forest(spark):
    found = s.candidates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), frozenset()).select(F.inline("candidates"))
    forest = s.train(s.label_findings(found))
    rows = s.judge(found, forest).select("features", "score").collect()
    scores = s.Trees(forest).scores(np.array([r.features for r in rows]))
    assert len(rows) > 100 and np.allclose(scores, [r.score for r in rows]) and len(set(scores.round(6))) > 2
    assert s.Trees(0.25).scores(np.zeros((2, 3))).tolist() == [0.25, 0.25]


def test_short_secrets_are_masked(spark):
    """Passwords of any form among the given documents, whose own secrets are 40 hex characters."""
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    texts = ['x password = "hunter2!x" y', 'db_password: "Tr0ub4dor&3"', "pwd='x9Kd82mQpL'", "at postgres://u:S3cretPw9@h/db now", "DB_PASSWORD=k3Jx8fQz2m!"]
    clean = ['x password = "[SECRET]" y', 'db_password: "[SECRET]"', "pwd='[SECRET]'", "at postgres://u:[SECRET]@h/db now", "DB_PASSWORD=[SECRET]"]
    own = spark.createDataFrame([(10**6 + k, t, "s") for k, t in enumerate(texts)], given.schema)
    assert [r.text for r in s.redact(given.unionByName(own)).where("doc_id >= 1000000").orderBy("doc_id").collect()] == clean


def test_planted_tokens_and_nothing_else(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = s.op3_secrets(spark, sf_dir).collect()
    assert all(docs[r.doc_id].text[r.first : r.first + r.length] == r.value for r in rows)
    planted = {(i, m.start(1)) for i, d in docs.items() for m in PLANTED.finditer(d.text)}
    found = {(r.doc_id, r.first) for r in rows if r.is_secret}
    assert planted and found == planted
    assert len(rows) > len(planted)


def test_forest_judges_what_the_rules_leave_open(spark):
    """Half of the tokens lose their name; the forest still tells them from words and numbers."""
    rng = random.Random(5)
    key = lambda: "".join(rng.choice("abcdef0123456789") for _ in range(40))
    word = lambda n: "".join(rng.choice(["er", "th", "an", "in", "on"]) for _ in range(n))
    rows = []
    for i in range(400):
        values = [(key(), i % 2), (word(10), 1), ("".join(rng.choice("0123456789") for _ in range(18)), 1)]
        text = f'{word(2)} ' + (f'token = "{values[0][0]}"' if i % 2 else f"{word(2)} {values[0][0]}") + f" {word(3)} {values[1][0]} {values[2][0]} end"
        rows.append((i, text, "src"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = s.scan(docs).collect()
    wrong = [r for r in found if r.is_secret != bool(re.fullmatch("[a-f0-9]{40}", r.value))]
    assert len(found) == 1200 and len(wrong) <= 12


@pytest.mark.parametrize("labels, expected", [([], {False}), ([1.0], {True}), ([0.0], {False})])
def test_labels_of_one_kind(spark, labels, expected):
    docs = spark.createDataFrame([(1, "a " + "x9" * 10, None)], "doc_id long, text string, source string")
    labelled = spark.createDataFrame([("v", [0.0] * len(s.FEATURES), x) for x in labels], "value string, features array<double>, label double")
    assert {r.is_secret for r in s.scan(docs, labelled=labelled).collect()} == expected


def test_redaction_nulls_repeats_clashes_and_empty_tables(spark):
    key, other = "3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1", "9f1e5a35c7b8d733c0b5c7d364eda8ac88d92aaa"
    text = f'é x token = "{key}" and secret: {other} but internationalization stays'
    rows = [(1, None, "a"), (2, "", None), (None, text, "s"), (3, text, "s"), (3, text, "s"), (4, "word " * 300_000 + text, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("score", F.lit("x")).withColumn("vector", F.lit(1)).withColumn("path", F.lit(1))
    out = s.redact(docs)
    assert out.columns == docs.columns
    clean = 'é x token = "[SECRET]" and secret: [SECRET] but internationalization stays'
    found = sorted((r.doc_id or 0, r.text) for r in out.collect() if r.text)
    assert found == [(0, clean), (3, clean), (3, clean), (4, "word " * 300_000 + clean)]
    assert out.count() == 6
    assert s.redact(docs.limit(0)).count() == 0
