"""Held-out accuracy, and what a prediction may depend on."""

import zlib

from pyspark.sql import functions as F

from snapcat.llm import langid as m


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = m.op2_language(spark, sf_dir).collect()
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.005 * len(rows)


def test_labels_of_held_out_documents_do_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = docs.withColumn("lang", F.when(m.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert m.fit(docs.where(~m.held_out())).contents == m.fit(other.where(~m.held_out())).contents


def test_sizes_against_plain_compression():
    model = m.Model([type("R", (), {"lang": lang, "hash": 1, "text": text, "n": n}) for lang, text, n in (("aa", "lorem ipsum dolor sit amet " * 9, 2), ("bb", "quick brown foxes jump over " * 9, 2))])
    tools = m.compressors(model)
    text = "Dolor SIT amet, lorem! " * 400
    raw = m.letters(text)
    size = {k: sum(len(t.compress(raw[i : i + m.BLOCK])) for i in range(0, len(raw), m.BLOCK)) for k, t in tools.items()}
    found = m.classify(text, tools)
    assert found["lang"] == "aa" and len(raw) > 2 * m.BLOCK
    assert found["margin"] == size["bb"] / size["aa"] - 1


def test_nulls_repeats_ties_clashes_and_empty_tables(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 ?! ... ²½Ⅷ", None), (4, "the cat and the dog", "en"), (4, "the cat and the dog", "en"), (None, "der Hund und die Katze", "de"), (5, "x", "fr"), (6, "the dog " * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("hash", F.lit(1)).withColumn("rank", F.lit(2))
    found = m.identify(docs, m.fit(docs)).collect()
    assert [r.language.lang for r in found][:6] == ["und", "und", "und", "en", "en", "de"]
    assert [r.language.rejected for r in found][:3] == [True] * 3
    empty = m.identify(docs, m.fit(docs.limit(0))).collect()
    assert {(r.language.lang, r.language.score) for r in empty} == {("und", 0.0)}
    one = m.identify(docs, m.fit(docs.where("lang = 'en'"))).collect()
    assert {(r.language.lang, r.language.score, r.language.rejected) for r in one[3:]} == {("en", 1.0, False)}
    assert m.identify(docs.limit(0), m.fit(docs)).count() == 0
