"""Group C: table tags from names, columns and foreign-key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcat.operators.catalog import KEY
from snapcat.operators.names import AUDIT_NAMES, CONFIG_NAMES, LOG_NAMES, LOOKUP_NAMES, contains_any

CORE_INCOMING = 3


def is_core() -> Column:
    return F.col("fk_in") >= CORE_INCOMING


def is_lookup() -> Column:
    referenced_leaf = (F.col("n_columns") <= 5) & (F.col("fk_out") == 0) & (F.col("fk_in") > 0)
    return (
        contains_any(F.lower("table_name"), LOOKUP_NAMES)
        | referenced_leaf
        | (F.col("has_lookup_column") & (F.col("n_columns") <= 4))
    )


def is_audit() -> Column:
    return contains_any(F.lower("table_name"), AUDIT_NAMES) | (F.col("n_audit_columns") >= 2)


def is_config() -> Column:
    key_value = (F.col("n_columns") <= 4) & F.col("has_config_key") & F.col("has_config_value")
    return contains_any(F.lower("table_name"), CONFIG_NAMES) | key_value


def is_log() -> Column:
    return contains_any(F.lower("table_name"), LOG_NAMES) | (F.col("has_log_time") & F.col("has_log_kind"))


#: The tags that need no junction facts, by their rule.
RULES = {"core": is_core, "lookup": is_lookup, "audit": is_audit, "config": is_config, "log": is_log}


def tag_flags(junctions: DataFrame) -> DataFrame:
    """One boolean per tag for every table; a projection of the junction facts."""
    return junctions.select(
        *KEY,
        "fk_out",
        "fk_in",
        "is_junction",
        "junction_reasoning",
        is_core().alias("core"),
        F.col("is_junction").alias("junction"),
        is_lookup().alias("lookup"),
        is_audit().alias("audit"),
        is_config().alias("config"),
        is_log().alias("log"),
    )


def table_tags(flags: DataFrame) -> DataFrame:
    """The flags as an ordered array; no tag gives an empty one."""
    names = ("core", "junction", "lookup", "audit", "config", "log")
    return flags.withColumn("tags", F.array_compact(F.array(*(F.when(F.col(n), n) for n in names))))
