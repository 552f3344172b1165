"""Writing documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from snapcat.plans import files
from snapcat.plans import fragments as fr
from snapcat.plans.artifacts import snapshot_fragments
from snapcat.plans.snapshot import SnapshotConfig, snapshot
from snapcat.session import merged, tidy


def write_fragments(frames: Mapping[str, DataFrame], root: str) -> None:
    """One Parquet folder per kind (``kind=...``), rows in document order.

    Range partitioning on the fragment order splits long documents over tasks
    and lays the rest out so that a reader of one document opens few files.
    """
    for kind, frame in frames.items():
        ordered = frame.select(*fr.FRAGMENT).repartitionByRange(*fr.DOC, *fr.ORDER).sortWithinPartitions(*fr.DOC, *fr.ORDER)
        with tidy(frame.sparkSession):
            ordered.write.mode("overwrite").parquet(f"{root}/kind={kind}")


def read_fragments(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def write_docs(spark: SparkSession, fragment_root: str, root: str) -> None:
    """Assembled documents as Parquet rows ``(db_id, path, part, doc)``."""
    docs = fr.assemble(read_fragments(spark, fragment_root))
    with tidy(spark):
        docs.write.mode("overwrite").parquet(root)


def write_text(docs: DataFrame, root: str) -> None:
    """One text file per document, at its path."""
    files.write_files(docs, root)


def generate(raw: Mapping[str, DataFrame], cfg: SnapshotConfig, root: str) -> None:
    """A whole run: catalog relations to written documents.

    The normalised frames are written first and read back, so each is computed
    once, and an executor lost while documents are built costs no introspection.
    """
    spark = raw["pg_database"].sparkSession
    planned = snapshot(raw, cfg)
    for name, frame in planned.items():
        with tidy(spark):
            frame.write.mode("overwrite").parquet(f"{root}/frames/{name}")
    frames = {name: merged(spark.read.parquet(f"{root}/frames/{name}")) for name in planned}
    write_fragments(snapshot_fragments(frames, cfg), f"{root}/fragments")
    write_docs(spark, f"{root}/fragments", f"{root}/docs")
