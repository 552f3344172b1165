"""Every stage against a plain version of it, on the stage's own input."""

import re

import corpus_pipeline as p
import pytest
import test_decontaminate as windows
import test_nearcopies
from pyspark.sql import functions as F

from snapcat.llm import decontaminate, langid
from snapcat.llm.bpe import default_vocabulary, encoder


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf_dir, out = "/root/testdata/sf0.001", [spark.read.parquet("/root/testdata/sf0.001/documents.parquet")]
    folder = tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return [{r.doc_id: r for r in x.collect()} for x in out]


def test_language(spark, stages):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tools = langid.compressors(langid.fit(docs))
    assert set(stages[1]) == {i for i, d in stages[0].items() if not langid.classify(d.text, tools)["rejected"]}
    assert len(stages[1]) >= 0.99 * len(stages[0])


def test_near_duplicates(stages):
    assert set(stages[2]) == test_nearcopies.plain_kept([(i, r.text) for i, r in stages[1].items()])
    assert all(stages[2][i] == stages[1][i] for i in stages[2])


def test_decontaminate(spark, stages):
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    changed = 0
    for i, d in stages[2].items():
        words = decontaminate.words_of(d.text)
        _, hit, _ = windows.plain_windows(words, items)
        if 2 * len(hit) > len(words):
            assert i not in stages[3]
        else:
            assert decontaminate.words_of(stages[3][i].text) == [w for k, w in enumerate(words) if k not in hit]
            assert stages[3][i].n_chars == len(stages[3][i].text)
            assert hit or stages[3][i] == d
            changed += bool(hit)
    assert changed


def test_secrets(stages):
    token = re.compile(r"(token = \")[0-9a-f]{40}\"", re.IGNORECASE)
    assert set(stages[4]) == set(stages[3])
    for i, d in stages[3].items():
        assert stages[4][i].text == token.sub(r'\1[SECRET]"', d.text)


def test_encode(stages):
    assert set(stages[5]) == set(stages[4])
    tool = encoder(default_vocabulary())
    for i, d in stages[4].items():
        assert b"".join(tool.vocabulary.bytes[x] for x in stages[5][i]["ids"]).decode() == d.text
        assert stages[5][i].n_tokens == len(stages[5][i]["ids"])


def test_run(spark, sf_dir, stages):
    assert sorted((r.doc_id, r["ids"]) for r in p.run(spark, sf_dir).collect()) == sorted((i, r["ids"]) for i, r in stages[5].items())


def test_nulls_repeats_clashes_and_empty_tables(spark, sf_dir):
    text = "and the thing was with them there and then for the other thing"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, text, "en", None, 5), (3, text, "en", None, 5), (None, text + " again", "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("found", F.lit(1)).withColumn("fingerprint", F.lit("x"))
    # Names that the stages use themselves, in any case.
    for name in ("language", "Found_", "row_key_1", "ROW_KEY_2", "secret_places", "point", "root", "band", "set"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in p.STAGES:
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0 and (name == "encode" or empty.columns == docs.columns)
        docs = spark.createDataFrame((out := stage(spark, docs, sf_dir)).collect(), out.schema)
        if name != "encode":
            assert all(r[c] == c for r in docs.collect() for c in ("language", "Found_", "row_key_1", "ROW_KEY_2", "secret_places", "point"))
    # The text with one word more is a near copy.
    assert [r.doc_id for r in docs.collect()] == [3]
