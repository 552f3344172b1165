"""Any table as TOON documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapcat.functions.toon import INDENT, kind_of, scalar_text
from snapcat.session import settle


def row_line(df: DataFrame, cols: Sequence[str]):
    """Comma row of the columns, NULL as ``null``."""
    parts = []
    for name in cols:
        kind = kind_of(df.schema[name].dataType)
        value = F.col(f"`{name}`")
        parts.append(scalar_text(value.cast("string") if kind == "string" else value, kind))
    return F.concat_ws(",", *parts)


def toon_rows(df: DataFrame, key: str, rows_per_doc: int, cols: Sequence[str] | None = None) -> DataFrame:
    """Documents of the rows whose key falls in one range of ``rows_per_doc`` values.

    ``key`` must be a unique integer column (``check_key`` tells), which bounds
    a document by ``rows_per_doc`` rows; a range with more rows fails the job.
    For other keys use ``toon_ranked``.
    """
    cols = list(cols or df.columns)
    head = "]{" + ",".join(cols) + "}:"
    chunk = F.floor(F.col(key) / F.lit(rows_per_doc)).cast("bigint")
    lines = F.sort_array(F.collect_list(F.struct(F.col("row_key"), F.col("line"))))
    refused = F.raise_error(F.lit(f"{key} is not unique"))
    body = F.array_join(F.transform(lines, lambda r: F.concat(F.lit("\n" + INDENT), r["line"])), "")
    return (
        df.select(chunk.alias("chunk"), F.col(key).alias("row_key"), row_line(df, cols).alias("line"))
        .groupBy("chunk")
        .agg(F.count("*").alias("row_count"), body.alias("body"))
        .select(
            "chunk",
            "row_count",
            F.when(F.col("row_count") > rows_per_doc, refused.cast("string"))
            .otherwise(F.concat(F.lit("["), F.col("row_count").cast("string"), F.lit(head), "body"))
            .alias("doc"),
        )
    )


def dense_positions(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``position``: 1, 2, ... in the order of the columns, NULLs first.

    Rows are sorted into ranges; a place is what the ranges before hold and the
    rank within the own one. A key that fills a third of the table falls into as
    many ranges as any third, if the columns after it differ.
    """
    ranged = settle(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    # One row a partition.
    sizes = ranged.groupBy("range").agg(F.count("*").alias("own"))
    before = sizes.select("range", (F.sum("own").over(Window.orderBy("range")) - F.col("own")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.withColumn("rank", rank).join(before, "range").withColumn("position", F.col("before") + F.col("rank")).drop("range", "rank", "before")


def toon_ranked(df: DataFrame, keys: Sequence[str], rows_per_doc: int, cols: Sequence[str] | None = None) -> DataFrame:
    """Documents of ``rows_per_doc`` consecutive rows in the order of any columns, ties by the row's text.

    The columns need not be unique, whole or free of NULLs; the last document has what is left.
    """
    cols = list(cols or df.columns)
    names = [f"key_{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)), row_line(df, cols).alias("line"))
    placed = dense_positions(rows, [*names, "line"])
    chunk = F.floor((F.col("position") - 1) / F.lit(rows_per_doc)).cast("bigint")
    # At most ``rows_per_doc`` rows.
    lines = F.sort_array(F.collect_list(F.struct("position", "line")))
    head = F.concat(F.lit("["), F.count("*").cast("string"), F.lit("]{" + ",".join(cols) + "}:"))
    body = F.array_join(F.transform(lines, lambda r: F.concat(F.lit("\n" + INDENT), r["line"])), "")
    return placed.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("row_count"), F.concat(head, body).alias("doc"))
