"""Reading and writing catalog exports (one Parquet directory per relation)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from snapcat.session import merged, tidy
from snapcat.sources.lazy import LazyFrames
from snapcat.sources.relations import CATALOG_COLUMNS


def export_schema(relation: str) -> str:
    """DDL of one relation, ``db_id`` first."""
    columns = CATALOG_COLUMNS[relation]
    return ", ".join(["db_id bigint", *(f"{name} {kind}" for name, kind in columns.items())])


def read_catalog(spark: SparkSession, root: str) -> LazyFrames:
    """Frames over ``root/<relation>``, for joins by sorting; the given schema spares the footer scan."""
    def reader(relation: str):
        return lambda: merged(spark.read.schema(export_schema(relation)).parquet(f"{root}/{relation}"))

    return LazyFrames({relation: reader(relation) for relation in CATALOG_COLUMNS})


def write_catalog(raw: Mapping[str, DataFrame], root: str) -> None:
    """Write every relation as Parquet under ``root``."""
    for relation, frame in raw.items():
        with tidy(frame.sparkSession):
            frame.select("db_id", *CATALOG_COLUMNS[relation]).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{relation}")
