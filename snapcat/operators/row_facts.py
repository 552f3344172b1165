"""Facts of many tables from their rows, in one grouping (V1 to V3).

Every value of every column becomes a cell: the table's key, the column, and the value in the slot of its kind (whole
number, double, instant, local time, text). Cells are counted per distinct value; counts combine on the map side. Rows, nulls, distinct
values, extremes, most frequent values and short lists of values all come out of that one table of counts.

A text of more than ``LONG`` characters is its first ``LONG`` characters and a digest, so long texts are not shuffled. Where an extreme or
a frequent value is a long text, a second scan of that column alone brings the text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapcat.functions.toon import decimal_text, float_text, number_text, quoted
from snapcat.session import settle

LONG = 64
#: Slots of a cell, with their types; ``digest`` tells long texts apart.
SLOTS = {"whole": "bigint", "fraction": "double", "instant": "timestamp", "local": "timestamp_ntz", "text": "string", "digest": "string"}
#: Rows of long texts that are looked up by broadcasting their digests; more are joined.
MOST_LOOKED_UP = 10_000

NESTED = (T.ArrayType, T.StructType, T.MapType)


def _slot(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.IntegralType, T.BooleanType, T.DateType)):
        return "whole"
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return "fraction"
    if isinstance(data_type, T.TimestampType):
        return "instant"
    return "local" if isinstance(data_type, T.TimestampNTZType) else "text"


def _unordered(data_type: T.DataType) -> bool:
    """Whether the text of a value does not sort like the value."""
    return isinstance(data_type, T.DecimalType)


def _value(field: T.StructField) -> Column:
    """The value as its slot holds it."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, NESTED):
        return F.to_json(value)
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(value)
    if isinstance(field.dataType, T.DateType):
        return F.unix_date(value)
    if isinstance(field.dataType, T.BooleanType):
        return value.cast("int")
    return value


def _text_slots(text: Column) -> dict[str, Column]:
    digest = F.concat(F.sha2(text, 256), F.lit(":"), F.length(text).cast("string"))
    return {"text": F.left(text, F.lit(LONG)), "digest": F.when(F.length(text) > LONG, digest)}


def cell(field: T.StructField) -> Column:
    slot, value = _slot(field.dataType), _value(field)
    own = _text_slots(value.cast("string")) if slot == "text" else {slot: value}
    parts = (own.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in SLOTS.items())
    return F.struct(F.lit(field.name).alias("column_name"), *parts)


def cells(df: DataFrame, cols: Sequence[str] | None = None, **key: str | int) -> DataFrame:
    """A row per row and column: the key, the column and the slots; all slots are NULL for a NULL."""
    fields = [df.schema[c] for c in (cols or df.columns)]
    return df.select(*(F.lit(v).alias(k) for k, v in key.items()), F.inline(F.array(*map(cell, fields))))


def counted(rows: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """How often each value stands in its column."""
    return rows.groupBy(*key, "column_name", *SLOTS).agg(F.count("*").alias("n"))


def column_facts(counts: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Rows, present rows, distinct values and extremes by slot of every column.

    A low or high text is a struct of its first characters and whether it goes on after them.
    """
    present = F.coalesce(*(F.col(s).isNotNull() | F.lit(None) for s in SLOTS), F.lit(False))
    plain = [s for s in SLOTS if s not in ("text", "digest")]
    text = F.when(F.col("text").isNotNull(), F.struct("text", F.col("digest").isNotNull().alias("long")))
    return counts.groupBy(*key, "column_name").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0).cast("bigint")).alias("present"),
        F.count_if(present).alias("distinct_count"),
        *(f(s).alias(f"{side}_{s}") for s in plain for side, f in (("low", F.min), ("high", F.max))),
        F.min(text).alias("low_text"),
        F.max(text).alias("high_text"),
    )


def _shown(slots: dict[str, Column], data_type: T.DataType) -> Column:
    """A value out of its slot, as V1 and V2 show it."""
    value = slots[_slot(data_type)]
    if isinstance(data_type, T.BooleanType):
        return value.cast("boolean").cast("string")
    if isinstance(data_type, T.DateType):
        return F.date_from_unix_date(value.cast("int")).cast("string")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.when(value.isNotNull(), float_text(value) if isinstance(data_type, T.FloatType) else number_text(value))
    return value.cast("string")


def as_toon(text: Column, data_type: T.DataType) -> Column:
    """A shown value in text form: numbers and booleans as they are, anything else quoted where it must be."""
    if isinstance(data_type, T.DecimalType):
        return decimal_text(text.try_cast(data_type), data_type.scale)
    return text if isinstance(data_type, (T.NumericType, T.BooleanType)) else quoted(text)


def by_type(schemas: Mapping[tuple, T.StructType], key: Sequence[str], make) -> Column:
    """``make(data type)`` for the column that a row is about. Types, not columns, make the branches."""
    names: dict[str, tuple[T.DataType, list]] = {}
    for at, schema in schemas.items():
        for f in schema.fields:
            names.setdefault(f.dataType.simpleString(), (f.dataType, []))[1].append((*at, f.name))
    out = F
    place = F.struct(*(F.col(c) for c in key), F.col("column_name")) if key else F.col("column_name")
    for data_type, columns in names.values():
        these = [F.struct(*map(F.lit, c)) if key else F.lit(c[0]) for c in columns]
        out = out.when(place.isin(*these), make(data_type))
    return out.otherwise(F.lit(None).cast("string"))


def _extremes_of(df: DataFrame, columns: Sequence[str], key: Mapping[str, str | int]) -> DataFrame:
    """Whole extremes of a few columns, by a scan of them."""
    one = df.agg(*(f(F.col(f"`{c}`")).alias(f"{side}_{i}") for i, c in enumerate(columns) for side, f in (("low", F.min), ("high", F.max))))

    def text(name: str, c: str) -> Column:
        return F.hex(name) if isinstance(df.schema[c].dataType, T.BinaryType) else F.col(name).cast("string")

    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), text(f"low_{i}", c).alias("low_whole_text"), text(f"high_{i}", c).alias("high_whole_text")) for i, c in enumerate(columns)))
    return one.select(*(F.lit(v).alias(k) for k, v in key.items()), F.inline(rows))


def profile(tables: Mapping[tuple, DataFrame], key: Sequence[str] = (), counts: DataFrame | None = None) -> DataFrame:
    """V1 of all columns of all tables: key, column_name, data_type, row_count, null_fraction, min_value, max_value and distinct_count.

    ``tables`` maps values of ``key`` to frames. Each is scanned once, and the columns once more that have a long text as an extreme.
    """
    spark = next(iter(tables.values())).sparkSession
    if counts is None:
        counts = counted(union([cells(df, **dict(zip(key, at, strict=True))) for at, df in tables.items()]), key)
    found = column_facts(counts, key)
    names = [*key, "column_name"]
    looked_up = None
    if any(_slot(f.dataType) == "text" and not isinstance(f.dataType, NESTED) for df in tables.values() for f in df.schema.fields):
        found = settle(found)
        # At most a row a column.
        long = {tuple(r) for r in found.where("low_text.long OR high_text.long").select(*names).collect()}
        for at, df in tables.items():
            own = [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED) and ((*at, f.name) in long or _unordered(f.dataType))]
            if own:
                more = _extremes_of(df, own, dict(zip(key, at, strict=True)))
                looked_up = more if looked_up is None else looked_up.unionByName(more)
    # A row a column, with columns of empty tables.
    listed = [(*at, f.name, f.dataType.simpleString()) for at, df in tables.items() for f in df.schema.fields]
    listed = F.array(*(F.struct(*(F.lit(v).alias(name) for v, name in zip(row, [*names, "data_type"], strict=True))) for row in listed))
    out = spark.range(1).select(F.inline(listed)).join(found, names, "left")
    if looked_up is not None:
        out = out.join(looked_up, names, "left")
    schemas = {at: df.schema for at, df in tables.items()}

    def extreme(side: str) -> Column:
        slots = {s: F.col(f"{side}_{s}") for s in SLOTS if s not in ("text", "digest")} | {"text": F.col(f"{side}_text.text")}
        make = lambda data_type: F.lit(None).cast("string") if isinstance(data_type, NESTED) else _shown(slots, data_type)
        shown = by_type(schemas, key, make)
        return shown if looked_up is None else F.coalesce(f"{side}_whole_text", shown)

    rows = F.coalesce("row_count", F.lit(0).cast("bigint"))
    return out.select(
        *names, "data_type", rows.alias("row_count"), F.when(rows > 0, (rows - F.col("present")) / rows).alias("null_fraction"),
        extreme("low").alias("min_value"), extreme("high").alias("max_value"), F.coalesce("distinct_count", F.lit(0).cast("bigint")).alias("distinct_count"))


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def frequent(tables: Mapping[tuple, DataFrame], counts: DataFrame, k: int, key: Sequence[str] = ()) -> DataFrame:
    """V2: key, column_name, value, n and position of the k most frequent values of every column; ties by the shown value.

    Where a long text may be among them, those that tie on its first characters are looked up before the last ranking.
    """
    schemas = {at: df.schema for at, df in tables.items()}
    names = [*key, "column_name"]
    slots = {s: F.col(s) for s in SLOTS}
    shown = counts.withColumn("value", by_type(schemas, key, lambda data_type: _shown(slots, data_type))).where("value IS NOT NULL")
    best = Window.partitionBy(*names).orderBy(F.desc("n"), "value")
    # All that could be among the first k when long texts are compared whole.
    near = shown.withColumn("position", F.rank().over(best)).where(F.col("position") <= k).select(*names, "value", "digest", "n")
    texts = {at: [f.name for f in df.schema.fields if _slot(f.dataType) == "text"] for at, df in tables.items()}
    if any(texts.values()):
        near = settle(near)
        long = near.where("digest IS NOT NULL").select(*names, "digest")
        if many := long.count():
            wanted = F.broadcast(long) if many <= MOST_LOOKED_UP else long
            parts = []
            for at, own in texts.items():
                if own:
                    fields = [F.struct(F.lit(c).alias("column_name"), _value(tables[at].schema[c]).cast("string").alias("whole")) for c in own]
                    held = tables[at].select(*(F.lit(v).alias(name) for name, v in zip(key, at, strict=True)), F.inline(F.array(*fields))).where(F.length("whole") > LONG)
                    parts.append(held.withColumn("digest", _text_slots(F.col("whole"))["digest"]).join(wanted, [*names, "digest"]).dropDuplicates([*names, "digest"]))
            near = near.join(union(parts).select(*names, "digest", "whole"), [*names, "digest"], "left").withColumn("value", F.coalesce("whole", "value"))
    return near.select(*names, "value", "n").withColumn("position", F.row_number().over(best)).where(F.col("position") <= k)


def short_lists(counts: DataFrame, tables: Mapping[tuple, DataFrame], k: int, key: Sequence[str] = ()) -> DataFrame:
    """V3: key, column_name and value_count of the text columns with at least one and at most k distinct values."""
    strings = [(*at, f.name) for at, df in tables.items() for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    place = F.struct(*(F.col(c) for c in key), F.col("column_name")) if key else F.col("column_name")
    wanted = place.isin(*(F.struct(*map(F.lit, c)) if key else F.lit(c[0]) for c in strings)) if strings else F.lit(False)
    sizes = counts.where(wanted & F.col("text").isNotNull()).groupBy(*key, "column_name").agg(F.count("*").alias("value_count"))
    return sizes.where(F.col("value_count") <= k)
