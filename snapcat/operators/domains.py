"""Group D: business domains from table names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcat.operators.names import contains_any

# Keywords per domain, in the order they are tried.
DOMAIN_WORDS = {
    "Auth": ("user", "auth", "login", "session", "permission", "role", "token"),
    "Billing": ("payment", "invoice", "subscription", "billing", "charge", "refund"),
    "Commerce": ("order", "cart", "product", "catalog", "inventory", "price"),
    "Content": ("post", "article", "comment", "media", "attachment", "content"),
    "Messaging": ("message", "notification", "email", "sms", "chat"),
    "Analytics": ("metric", "analytics", "stat", "tracking", "event"),
    "System": ("schema", "migration", "meta", "sys_", "pg_"),
}
OTHER = "Other"
MIN_PREFIX = 3


def name_prefix(name: Column) -> Column:
    """Lower-cased text before the first underscore; NULL where that is no usable prefix."""
    lowered = F.lower(name)
    at = F.instr(lowered, "_")
    usable = (at > MIN_PREFIX) & (at < F.length(lowered))
    return F.when(usable, F.substring_index(lowered, "_", 1))


def capitalised(prefix: Column) -> Column:
    """First letter upper-cased, the rest untouched."""
    return F.concat(F.upper(F.left(prefix, F.lit(1))), F.substr(prefix, F.lit(2)))


def content_domain(name: Column) -> Column:
    lowered = F.lower(name)
    ladder = F
    for domain, words in DOMAIN_WORDS.items():
        ladder = ladder.when(contains_any(lowered, words), domain)
    return ladder.otherwise(OTHER)


def prefix_groups(tables: DataFrame) -> DataFrame:
    """Prefixes that two or more tables of a database share."""
    return (
        tables.select("db_id", name_prefix(F.col("table_name")).alias("prefix"))
        .where("prefix IS NOT NULL")
        .groupBy("db_id", "prefix")
        .agg(F.count("*").alias("table_count"))
        .where("table_count >= 2")
        .withColumn("domain", capitalised(F.col("prefix")))
    )


def table_domains(tables: DataFrame) -> DataFrame:
    """The domain of every table: its shared prefix, else its keywords.

    One row per table, so a domain that holds a third of all tables is never
    gathered in one place. Within a domain the listing order is the name.
    """
    shared = prefix_groups(tables).select("db_id", "prefix", F.col("domain").alias("prefix_domain"))
    return (
        tables.select("db_id", "schema_name", "table_name", name_prefix(F.col("table_name")).alias("prefix"))
        .join(shared, ["db_id", "prefix"], "left")
        .select(
            "db_id",
            F.coalesce("prefix_domain", content_domain(F.col("table_name"))).alias("domain"),
            "schema_name",
            "table_name",
        )
    )


def domain_sizes(table_domains: DataFrame) -> DataFrame:
    return table_domains.groupBy("db_id", "domain").agg(F.count("*").alias("table_count"))
