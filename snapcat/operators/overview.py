"""Group E: the table index, rankings and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapcat.operators.catalog import KEY

TOP = 5
DESCRIPTION_LENGTH = 200


def short_description(comment: Column, redact: bool = False) -> Column:
    """Comment cut to 200 characters; NULL when empty or redacted."""
    if redact:
        return F.lit(None).cast("string")
    cut = F.concat(F.left(comment, F.lit(DESCRIPTION_LENGTH - 3)), F.lit("..."))
    return F.when(F.length(comment) > DESCRIPTION_LENGTH, cut).when(comment != "", comment)


def db_index(tables: DataFrame, tags: DataFrame, primary_keys: DataFrame, redact: bool = False) -> DataFrame:
    """One entry per table; ``tags`` carries the foreign-key counts."""
    return (
        tables.join(tags, KEY)
        .join(primary_keys, KEY, "left")
        .select(
            *KEY,
            short_description(F.col("comment"), redact).alias("short_description"),
            "row_count_estimate",
            F.col("pk_columns").alias("primary_key_columns"),
            F.col("fk_out").alias("foreign_key_out_count"),
            F.col("fk_in").alias("foreign_key_in_count"),
            "tags",
        )
    )


def _top(frame: DataFrame, score: str) -> DataFrame:
    """Best rows per database. Spark keeps only the top rows of each map task
    before the shuffle (WindowGroupLimit), so a huge database is no hot spot."""
    order = Window.partitionBy("db_id").orderBy(F.col(score).desc(), "schema_name", "table_name")
    return frame.withColumn("position", F.row_number().over(order)).where(F.col("position") <= TOP)


def start_tables(flags: DataFrame) -> DataFrame:
    """Tables to start reading from: referenced and core ones, not junctions or lookups."""
    score = (
        F.col("fk_in") * 2
        + F.when(F.col("core"), 5).otherwise(0)
        - F.when(F.col("junction"), 3).otherwise(0)
        - F.when(F.col("lookup"), 2).otherwise(0)
    )
    scored = flags.select(*KEY, score.cast("bigint").alias("score")).where("score > 0")
    return _top(scored, "score")


def entry_points(fk_counts: DataFrame) -> DataFrame:
    """Tables that two or more foreign keys point to."""
    return _top(fk_counts.where("fk_in >= 2").select(*KEY, "fk_in"), "fk_in")


def has_relationships(fk_counts: DataFrame) -> DataFrame:
    linked = F.bool_or((F.col("fk_in") > 0) | (F.col("fk_out") > 0))
    return fk_counts.groupBy("db_id").agg(linked.alias("has_relationships"))


def table_buckets(flags: DataFrame) -> DataFrame:
    """Each table in one bucket, one row per table."""
    bucket = F.when(F.col("core"), "core").when(F.col("junction"), "junction").when(F.col("lookup"), "lookup").otherwise("other")
    return flags.select(*KEY, bucket.alias("bucket"))


def schema_list(schemas: Column) -> Column:
    """`` `x` schema`` for one schema, else the count and the names."""
    one = F.concat(F.lit("`"), F.get(schemas, F.lit(0)), F.lit("` schema"))
    many = F.concat(F.size(schemas).cast("string"), F.lit(" schemas ("), F.array_join(schemas, ", "), F.lit(")"))
    return F.when(F.size(schemas) == 1, one).otherwise(many)
