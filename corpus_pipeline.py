"""A training-data pipeline over ``documents``: each stage takes what the one before it kept.

1. ``language``: documents whose language is not clear, or that have no letters, go. Learnt from the labels.
2. ``near_duplicates``: documents with a Jaccard similarity of 0.8 or more over five-word shingles are linked; of each
   component one stays, the one with the smallest id.
3. ``decontaminate``: benchmark passages are cut out; documents that are mostly benchmark go.
4. ``secrets``: secrets are masked; every document stays.
5. ``encode``: token ids of what is left.

All stages but the last return the columns of ``documents``; ``n_chars`` follows the text. Null or empty
texts have no letters and go with the first stage; of repeated rows one stays. Empty tables stay empty.

Python workers and the buffers beside the heap live on from stage to stage, so the stages hand texts over in
batches of ``BATCH_ROWS``, fewer than Spark's default, which is meant for narrow rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.llm import bpe, decontaminate, langid, nearcopies, secrets
from snapcat.llm.common import free_names
from snapcat.session import shared_folder


#: Rows of an Arrow batch while the pipeline runs.
BATCH_ROWS = 1000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a clear language."""
    small_batches(spark)
    (name,) = free_names(docs, "language")
    found = langid.identify(docs, langid.fit(docs), to=name)
    return found.where(~F.col(f"{name}.rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    small_batches(spark)
    return nearcopies.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of the benchmark."""
    small_batches(spark)
    return counted(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    small_batches(spark)
    return counted(secrets.redact(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the token ids of the text and their number."""
    small_batches(spark)
    return bpe.encode(docs, bpe.default_vocabulary()).select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, after a change of the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else docs


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", without_benchmark),
    ("secrets", without_secrets),
    ("encode", encode),
]

#: The stages compress, train a forest and follow byte pairs; no SQL has them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


def all_queries() -> dict:
    return {"pipeline": run}


def all_oracles() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
