"""Statistics for documents from rows, for tables that a catalog has no statistics of."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcat.operators import row_facts
from snapcat.operators.catalog import KEY
from snapcat.session import settle

TOP_VALUES, ENUM_VALUES = 5, 8
Tables = Mapping[tuple[int, str, str], DataFrame]


def row_frames(tables: Tables, computed_at: str, top: int = TOP_VALUES, enum_values: int = ENUM_VALUES) -> dict[str, DataFrame]:
    """``stats``, ``column_stats`` and ``enum_like`` of tables (db_id, schema, name), as the catalog's frames with more members.

    All tables are counted in one job. The counts are written, because the three frames read them.
    """
    schemas = {at: df.schema for at, df in tables.items()}
    counts = settle(row_facts.counted(row_facts.union([row_facts.cells(df, **dict(zip(KEY, at, strict=True))) for at, df in tables.items()]), KEY))
    profile = settle(row_facts.profile(tables, KEY, counts))
    shown = lambda c: row_facts.by_type(schemas, KEY, lambda data_type: row_facts.as_toon(F.col(c), data_type))
    best = row_facts.frequent(tables, counts, top, KEY).withColumn("shown", shown("value"))
    # At most ``top`` values a column.
    lists = best.groupBy(*KEY, "column_name").agg(F.sort_array(F.collect_list(F.struct("position", "shown")))["shown"].alias("top_values"))
    column_stats = profile.join(lists, [*KEY, "column_name"], "left").select(
        *KEY, "column_name", "null_fraction", F.col("distinct_count").alias("distinct_count_estimate"),
        shown("min_value").alias("min_text"), shown("max_value").alias("max_text"), "top_values")
    stats = profile.groupBy(*KEY).agg(F.max("row_count").alias("row_count_estimate"), F.count("*").alias("column_stat_count")).select(
        *KEY, F.lit(computed_at).alias("computed_at"), F.lit("full_scan").alias("sampling_strategy"), "row_count_estimate", "column_stat_count",
        F.lit(None).cast("string").alias("note"))
    enum_like = row_facts.short_lists(counts, tables, enum_values, KEY).select(*KEY, "column_name")
    return {"stats": stats, "column_stats": column_stats, "enum_like": enum_like}


def with_row_facts(frames: Mapping[str, DataFrame], rows: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The catalog's frames, with facts from rows for the tables that have no column statistics."""
    out = {name: frames[name] for name in frames}
    if "stats" not in out:
        return out | dict(rows)
    known = out["column_stats"].select(*KEY).distinct()
    stats, column_stats = (rows[name].join(known, KEY, "left_anti") for name in ("stats", "column_stats"))
    kept = out["stats"].join(stats.select(*KEY), KEY, "left_anti")
    out["stats"] = kept.unionByName(stats)
    out["column_stats"] = out["column_stats"].unionByName(column_stats, allowMissingColumns=True)
    out["enum_like"] = rows["enum_like"]
    return out
