"""Document paths: ``<db>/<schema>/<directory>/<safe name>/...``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcat.functions.names import safe_name


def with_safe_name(frame: DataFrame, name: Column, identity: Column, *within: str) -> DataFrame:
    """Adds ``safe``, unique per database, schema and the columns ``within``.

    Of the objects whose names become equal one keeps the plain form: one that
    has it as its own name, else the smallest identity. The others append their
    identity in hex. No safe name holds ``__``, so
    the suffixed forms cannot clash. The group is only reduced to its minimum.
    """
    named = frame.withColumns({"safe": safe_name(name), "identity": identity})
    group = ["db_id", "schema_name", *within, "safe"]
    first = named.groupBy(*group).agg(F.min_by("identity", F.struct(name != F.col("safe"), "identity")).alias("first_identity"))
    suffix = F.concat(F.lit("__"), F.lower(F.hex("identity")))
    unique = F.when(F.col("identity") == F.col("first_identity"), F.col("safe")).otherwise(F.concat("safe", suffix))
    return named.join(first, group).withColumn("safe", unique).drop("identity", "first_identity")


def object_path(directory: str | Column, *tail: str | Column) -> Column:
    """Path of a document of a named object."""
    parts = [p if isinstance(p, Column) else F.lit(p) for p in (directory, *tail)]
    return F.concat_ws("/", F.col("db_id").cast("string"), "schema_name", *parts)


def database_path(name: str) -> Column:
    return F.concat(F.col("db_id").cast("string"), F.lit("/" + name))
