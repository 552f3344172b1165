"""Group V: facts computed from rows, for tables that come without statistics or keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapcat.functions.toon import float_text, number_text
from snapcat.operators import row_facts


#: Characters of a value from which its digest is shuffled in its place.
LONG = 64


def _is_fractional(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DoubleType, T.FloatType))


def _is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.ArrayType, T.StructType, T.MapType))


def _group_text(field: T.StructField) -> Column:
    """Text that tells two values of the column apart exactly when they differ."""
    value = F.col(f"`{field.name}`")
    if _is_nested(field.dataType):
        return F.to_json(value)
    if _is_fractional(field.dataType):
        return (value + F.lit(0.0).cast(field.dataType)).cast("string")  # 0.0 and -0.0 are one value
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(value)
    if isinstance(field.dataType, T.TimestampType):
        return F.unix_micros(value).cast("string")  # the local time of two instants can be the same
    return value.cast("string")


def _short(text: Column) -> Column:
    """Text that stands for a value where only its identity counts: long values by digest and length."""
    digest = F.concat(F.lit("#"), F.sha2(text, 256), F.lit(":"), F.length(text).cast("string"))
    return F.when(F.length(text) <= LONG, F.concat(F.lit("="), text)).otherwise(F.when(text.isNotNull(), digest))


def canonical_text(value: Column, data_type: T.DataType) -> Column:
    """How a value is shown: plain decimals for doubles, the cast text otherwise."""
    if _is_nested(data_type):
        return F.to_json(value)
    if _is_fractional(data_type):
        return F.when(value.isNotNull(), float_text(value) if isinstance(data_type, T.FloatType) else number_text(value))
    if isinstance(data_type, T.BinaryType):
        return F.hex(value)
    return value.cast("string")


def _fields(df: DataFrame, cols: Sequence[str] | None) -> list[T.StructField]:
    return [df.schema[name] for name in (cols or df.columns)]


def value_counts(df: DataFrame, cols: Sequence[str] | None = None, short: bool = False) -> DataFrame:
    """Rows per (column, value), NULLs left out; ``short`` values tell each other apart without being shown.

    One scan and one shuffle for all columns. Counts combine on the map side,
    so a value that fills a third of the table is one row per task.
    """
    cells = F.array(
        *(
            F.struct(F.lit(f.name).alias("column_name"), (_short(_group_text(f)) if short else _group_text(f)).alias("value"))
            for f in _fields(df, cols)
        )
    )
    return (
        df.select(F.inline(cells)).where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    )


def profile_columns(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Row count, null fraction, distinct count, smallest and largest value per column, in one scan.

    Columns with a long text as an extreme are scanned once more. ``exact=False`` estimates distinct
    counts without a shuffle of the values, the choice for very large tables.
    """
    return row_facts.profile({(): df.select(*(f"`{c}`" for c in cols or df.columns))}) if exact else estimated_profile(df, cols)


def estimated_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    fields = _fields(df, cols)
    aggregates = [F.count("*").alias("row_count")]
    for i, f in enumerate(fields):
        value = F.col(f"`{f.name}`")
        aggregates.append(F.count(value).alias(f"present_{i}"))
        if not _is_nested(f.dataType):
            aggregates += [F.min(value).alias(f"min_{i}"), F.max(value).alias(f"max_{i}")]
        aggregates.append(F.approx_count_distinct(F.to_json(value) if _is_nested(f.dataType) else value).alias(f"distinct_{i}"))
    one_row = df.agg(*aggregates)

    def entry(i: int, f: T.StructField) -> Column:
        nested = _is_nested(f.dataType)
        missing = F.col("row_count") - F.col(f"present_{i}")
        return F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col("row_count"),
            F.when(F.col("row_count") > 0, missing / F.col("row_count")).alias("null_fraction"),
            (F.lit(None).cast("string") if nested else canonical_text(F.col(f"min_{i}"), f.dataType)).alias("min_value"),
            (F.lit(None).cast("string") if nested else canonical_text(F.col(f"max_{i}"), f.dataType)).alias("max_value"),
            F.col(f"distinct_{i}").alias("distinct_count"),
        )

    return one_row.select(F.inline(F.array(*(entry(i, f) for i, f in enumerate(fields)))))


def top_values(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """The k most frequent values per column, ties by value.

    The ranking keeps k rows per column in each task before its shuffle (WindowGroupLimit). Long texts
    are counted by digest; the texts of the winners are looked up.
    """
    own = df.select(*(f"`{c}`" for c in cols))
    return row_facts.frequent({(): own}, row_facts.counted(row_facts.cells(own)), k)


def enum_like_columns(df: DataFrame, k: int) -> DataFrame:
    """String columns with at most k distinct values, and the values in order.

    Only the first k + 1 values of a column ever leave a task, which is enough
    to tell whether it has more than k.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    order = Window.partitionBy("column_name").orderBy("value")
    return (
        value_counts(df, strings)
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= k + 1)
        .groupBy("column_name")
        .agg(F.count("*").alias("value_count"), F.sort_array(F.collect_list("value")).alias("values"))
        .where(F.col("value_count") <= k)
    )


def _all_present(cols: Sequence[str]) -> Column:
    present = F.lit(True)
    for name in cols:
        present = present & F.col(name).isNotNull()
    return present


def check_key(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Whether a column list is a key: rows, distinct keys, duplicate groups, rows with a NULL in the key."""
    complete = _all_present(cols)
    keys = [_short(F.col(c)).alias(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c) for c in cols]
    groups = df.select(*keys).groupBy(*cols).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("bigint")
    return groups.agg(
        F.coalesce(F.sum("n"), zero).alias("row_count"),
        F.count_if(complete).alias("distinct_keys"),
        F.count_if(complete & (F.col("n") > 1)).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(~complete, F.col("n"))), zero).alias("null_key_rows"),
    ).withColumn("holds", (F.col("duplicate_groups") == 0) & (F.col("null_key_rows") == 0))


def check_fk(child: DataFrame, child_cols: Sequence[str], parent: DataFrame, parent_cols: Sequence[str]) -> DataFrame:
    """Orphans, NULL references, children per parent and the cardinality seen.

    Both sides are reduced to one row per key before they meet, so no key is hot in the join.
    """
    names = [f"k{i}" for i in range(len(child_cols))]
    children = (
        child.select(*(F.col(c).alias(n) for c, n in zip(child_cols, names, strict=True)))
        .groupBy(*names)
        .agg(F.count("*").alias("n"))
    )
    parents = (
        parent.select(*(F.col(c).alias(n) for c, n in zip(parent_cols, names, strict=True)))
        .where(_all_present(names))
        .distinct()
        .withColumn("known", F.lit(True))
    )
    complete = _all_present(names)
    orphan = complete & F.col("known").isNull()
    zero = F.lit(0).cast("bigint")
    return (
        children.join(parents, names, "left")
        .agg(
            F.coalesce(F.sum("n"), zero).alias("child_rows"),
            F.coalesce(F.sum(F.when(~complete, F.col("n"))), zero).alias("null_fk_rows"),
            F.coalesce(F.sum(F.when(orphan, F.col("n"))), zero).alias("orphan_rows"),
            F.count_if(orphan).alias("orphan_keys"),
            F.coalesce(F.max(F.when(F.col("known"), F.col("n"))), zero).alias("max_children"),
        )
        .withColumn("cardinality", F.when(F.col("max_children") <= 1, "one-to-one").otherwise("many-to-one"))
    )


def check_rows(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Violations per check, all in one scan; a check that is NULL passes, as in SQL."""
    names = list(checks)
    one_row = df.agg(
        F.count("*").alias("row_count"), *(F.count_if(~checks[name]).alias(f"bad_{i}") for i, name in enumerate(names))
    )
    entries = F.array(
        *(
            F.struct(F.lit(name).alias("check_name"), F.col("row_count"), F.col(f"bad_{i}").alias("violations"))
            for i, name in enumerate(names)
        )
    )
    return one_row.select(F.inline(entries)).withColumn("holds", F.col("violations") == 0)


def key_density(df: DataFrame, col: str) -> DataFrame:
    """Smallest, largest, distinct and missing values of an integer key."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(F.col(col).cast("bigint").alias("key"))
        .agg(F.count("*").alias("n"))
        .agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("distinct_keys"))
        .withColumn("missing_keys", F.col("max_key") - F.col("min_key") + 1 - F.col("distinct_keys"))
    )


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type two columns are compared in; text where nothing closer fits both."""
    if a == b:
        return a
    exact = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
    digits = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (exact[type(t)], 0) if type(t) in exact else None for t in (a, b)]
    if all(digits):
        (whole_a, scale_a), (whole_b, scale_b) = digits
        scale = max(scale_a, scale_b)
        return T.DecimalType(min(38, max(whole_a, whole_b) + scale), scale)
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    days = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return T.TimestampType() if isinstance(a, days) and isinstance(b, days) else T.StringType()


def inclusion(child: DataFrame, parent: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """How much of each child column's values a parent column holds, for the given pairs.

    The two columns of a pair are compared in their common type. One scan per
    side whatever the number of pairs; values meet in one grouping, so nothing
    is joined. A pair without any value has a row too.
    """
    common = [common_type(child.schema[c].dataType, parent.schema[p].dataType) for c, p in pairs]

    def cells(df: DataFrame, side: int) -> DataFrame:
        typed = df.select(*(F.col(f"`{pair[side]}`").cast(common[i]).alias(f"v{i}") for i, pair in enumerate(pairs)))
        entries = F.array(*(F.struct(F.lit(i).alias("pair"), _group_text(f).alias("value")) for i, f in enumerate(typed.schema.fields)))
        df = typed
        return (
            df.select(F.inline(entries))
            .where("value IS NOT NULL")
            .select("pair", "value", F.lit(side == 0).alias("in_child"), F.lit(side == 1).alias("in_parent"))
        )

    seen = (
        cells(child, 0)
        .unionByName(cells(parent, 1))
        .groupBy("pair", "value")
        .agg(F.bool_or("in_child").alias("in_child"), F.bool_or("in_parent").alias("in_parent"))
    )
    counted = seen.groupBy("pair").agg(
        F.count_if("in_child").alias("child_values"), F.count_if(F.col("in_child") & F.col("in_parent")).alias("included_values")
    )
    spark, zero = child.sparkSession, F.lit(0).cast("bigint")
    labels = spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate(pairs)], "pair int, child_column string, parent_column string")
    return labels.join(counted, "pair", "left").withColumns({c: F.coalesce(c, zero) for c in ("child_values", "included_values")}).select(
        "child_column",
        "parent_column",
        "child_values",
        "included_values",
        F.when(F.col("child_values") > 0, F.col("included_values") / F.col("child_values")).alias("inclusion_ratio"),
    )
