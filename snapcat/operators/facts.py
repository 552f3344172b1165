"""Per-table facts that junction detection, tags and rankings draw on, in one pass.

Tables, columns, keys and both ends of the foreign keys become rows of one
shape, are shuffled by table once and meet in two aggregations (per column name,
then per table) instead of a join each. Ends of foreign keys are counted before
that, combined on the map side, so a table that draws a third of all foreign keys
is one partial row per task, and nothing is gathered into lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcat.operators.catalog import KEY
from snapcat.operators.names import (
    AUDIT_COLUMNS,
    CONFIG_KEYS,
    CONFIG_VALUES,
    LOG_KINDS,
    LOG_TIMES,
    LOOKUP_COLUMNS,
    METADATA_COLUMNS,
)

MARKS = ("is_table", "is_column", "is_fk_column", "is_key_column", "starts_fk", "ends_fk")


def _cells(frame: DataFrame, name: Column, prefix: str | None = None, **marks: Column) -> DataFrame:
    schema, table = (f"{prefix}_schema", f"{prefix}_table") if prefix else ("schema_name", "table_name")
    zero = F.lit(0).cast("bigint")
    return frame.select(
        "db_id",
        F.col(schema).alias("schema_name"),
        F.col(table).alias("table_name"),
        name.alias("name"),
        *(marks[m].cast("bigint").alias(m) if m in marks else zero.alias(m) for m in MARKS),
    )


def _signs(name: Column) -> dict[str, Column]:
    """What the name of a column, in lower case, is a sign of."""
    return {
        "has_lookup_column": name.isin(*LOOKUP_COLUMNS),
        "has_config_key": name.isin(*CONFIG_KEYS),
        "has_config_value": name.isin(*CONFIG_VALUES),
        "has_log_time": name.contains("timestamp") | name.isin(*LOG_TIMES),
        "has_log_kind": name.isin(*LOG_KINDS),
    }


def _facts_of(frame: DataFrame, kind: Column | str, name: Column | None = None, prefix: str | None = None, n: Column | None = None) -> DataFrame:
    """Rows of one shape: ``n`` facts of a kind on a table, or on a name in it."""
    schema, table = (f"{prefix}_schema", f"{prefix}_table") if prefix else ("schema_name", "table_name")
    return frame.select(
        "db_id",
        F.col(schema).alias("schema_name"),
        F.col(table).alias("table_name"),
        (F.lit(None).cast("string") if name is None else name).alias("name"),
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"),
        (F.lit(1) if n is None else n).cast("bigint").alias("n"),
    )


def table_facts(tables: DataFrame, columns: DataFrame, constraints: DataFrame, fks: DataFrame) -> DataFrame:
    """One row of counts and signs per table; tables without columns or keys are kept.

    Ends of foreign keys are counted first: any number of keys may end at one table. What else a table has is
    bounded by its columns and keys, and is dealt out by table once, for the names in it and for the table.
    """
    sources = fks.select("db_id", "from_schema", "from_table", F.posexplode_outer("from_columns").alias("slot", "fk_column"))
    keys = constraints.where("constraint_type = 'PRIMARY KEY'").select(*KEY, F.explode("columns").alias("key_column"))
    ends = fks.groupBy("db_id", "to_schema", "to_table").agg(F.count("*").alias("n"))
    starts = F.when(F.coalesce("slot", F.lit(0)) == 0, "s").otherwise("f")
    cells = (
        _facts_of(tables, "t")
        .unionByName(_facts_of(columns, "c", F.col("column_name")))
        .unionByName(_facts_of(keys, "k", F.col("key_column")))
        .unionByName(_facts_of(sources, starts, F.col("fk_column"), "from"))
        .unionByName(_facts_of(ends, "e", None, "to", F.col("n")))
    )
    marks = {
        "is_table": F.col("kind") == "t",
        "is_column": F.col("kind") == "c",
        "is_fk_column": F.col("kind").isin("s", "f") & F.col("name").isNotNull(),
        "is_key_column": F.col("kind") == "k",
        "starts_fk": F.col("kind") == "s",
        "ends_fk": F.col("kind") == "e",
    }
    counted = [F.sum(F.when(test, F.col("n")).otherwise(F.lit(0).cast("bigint"))).alias(mark) for mark, test in marks.items()]
    per_name = cells.repartition(*KEY).groupBy(*KEY, "name").agg(*counted)

    name = F.lower("name")
    column, in_fk, in_key = F.col("is_column") > 0, F.col("is_fk_column") > 0, F.col("is_key_column") > 0

    def some(test: Column) -> Column:
        return F.coalesce(F.bool_or(column & test), F.lit(False))

    return (
        per_name.groupBy(*KEY)
        .agg(
            F.sum("is_table").alias("is_table"),
            F.sum("starts_fk").alias("fk_out"),
            F.sum("ends_fk").alias("fk_in"),
            F.sum("is_column").alias("n_columns"),
            F.count_if(column & ~in_fk & ~name.isin(*METADATA_COLUMNS)).alias("n_payload"),
            F.count_if(in_key).alias("n_key_columns"),
            F.count_if(in_key & ~in_fk).alias("n_own_key_columns"),
            F.count_if(column & name.isin(*AUDIT_COLUMNS)).alias("n_audit_columns"),
            *(some(test).alias(fact) for fact, test in _signs(name).items()),
        )
        .where("is_table > 0")
        .drop("is_table")
    )


#: What each tag but ``junction`` counts: ends of foreign keys, columns, or names among those of an audit trail.
TAG_CELLS = {"core": ("to",), "lookup": ("column", "from", "to"), "audit": ("audit",), "config": ("column",), "log": ("column",)}


def tag_facts(tag: str, tables: DataFrame, columns: DataFrame, fks: DataFrame) -> DataFrame:
    """The facts of ``table_facts`` that one tag draws on.

    None of them needs a row for each name of a column, so rows are combined by table where they are read, and
    shuffled once. Only names of an audit trail are told apart, which are few.
    """
    test = F.lower("column_name").isin(*AUDIT_COLUMNS)
    parts = {
        "column": lambda: _cells(columns, F.col("column_name"), is_column=F.lit(1)),
        "audit": lambda: _cells(columns.where(test).select(*KEY, "column_name").distinct(), F.col("column_name"), is_column=F.lit(1)),
        "from": lambda: _cells(fks, F.lit(None).cast("string"), "from", starts_fk=F.lit(1)),
        "to": lambda: _cells(fks, F.lit(None).cast("string"), "to", ends_fk=F.lit(1)),
    }
    cells = _cells(tables, F.lit(None).cast("string"), is_table=F.lit(1))
    for part in TAG_CELLS[tag]:
        cells = cells.unionByName(parts[part]())
    out = cells.groupBy(*KEY).agg(
        F.sum("is_table").alias("is_table"),
        F.sum("starts_fk").alias("fk_out"),
        F.sum("ends_fk").alias("fk_in"),
        F.sum("is_column").alias("n_columns"),
        F.sum("is_column").alias("n_audit_columns"),
        *(F.coalesce(F.bool_or((F.col("is_column") > 0) & test), F.lit(False)).alias(fact) for fact, test in _signs(F.lower("name")).items()),
    )
    return out.where("is_table > 0").drop("is_table", "n_columns" if tag == "audit" else "n_audit_columns")
