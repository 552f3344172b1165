"""Documents as ordered fragments, one row per piece of text.

A document is the concatenation of its fragments in the order of ``ORDER``,
less the first line break (every fragment that starts a line begins with one).
No step gathers a document: an index of a database that holds a third of all
tables is as many rows as any other third of the fleet. ``assemble`` turns
fragments into text, in parts of a fixed number of fragments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapcat.functions import toon
from snapcat.functions.toon import INDENT, Field
from snapcat.session import settle

DOC = ["db_id", "path"]
ORDER = ["section", "k1", "ord", "k2"]
FRAGMENT = [*DOC, *ORDER, "text"]
FIRST, LAST = float("-inf"), float("inf")
#: Fragments of one row of assembled text.
PART_FRAGMENTS = 1000


def fragment(
    text: Column, section: int | Column = 0, k1: Column | str = "", order: Column | float = 0.0, k2: Column | str = ""
) -> list[Column]:
    """The columns of one fragment."""
    def column(value, kind: str) -> Column:
        return (value if isinstance(value, Column) else F.lit(value)).cast(kind)

    return [
        F.col("db_id"),
        F.col("path"),
        column(section, "int").alias("section"),
        column(k1, "string").alias("k1"),
        column(order, "double").alias("ord"),
        column(k2, "string").alias("k2"),
        text.alias("text"),
    ]


def whole(docs: DataFrame, body: Column, section: int = 0) -> DataFrame:
    """One fragment per row; rows whose body is NULL have none."""
    return docs.withColumn("body", body).where("body IS NOT NULL").select(
        *fragment(F.concat(F.lit("\n"), F.col("body")), section)
    )


def union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


GROUP = [*DOC, "section", "list_name"]


def object_list(rows: DataFrame, fields: Sequence[Field], docs: DataFrame | None = None) -> DataFrame:
    """Lists of objects at the root of documents.

    ``rows`` has ``GROUP``, the order columns and the members. ``docs`` names
    the lists to print even when empty. The shape of a list depends on all its
    objects; where the fields alone decide it, rows need not meet their list's
    facts. Else they join one row per list, which adaptive execution splits
    when a list is huge.
    """
    dashed = any(f.kind == "strings" and f.omit == "never" for f in fields)
    table = all(f.kind != "strings" and f.omit == "never" for f in fields)
    places = [*GROUP, "k1", "ord", "k2"]
    # Written, because the facts of a list and its rows both need it: what the rows come from is planned and run once.
    shaped = settle(toon.with_texts(rows, fields, *places).select(*places, *toon.shape_columns(fields, 1)))
    own = shaped.select(*GROUP, F.lit(1).alias("own"), F.lit(0).alias("listed"), "mask", "nested")
    if docs is not None:
        # Named lists stand among the rows, of which they have none: both are counted in one shuffle.
        kinds = dict(own.dtypes)
        none = {name: F.lit(None).cast(kinds[name]).alias(name) for name in ("mask", "nested")}
        own = own.unionByName(docs.select(*GROUP, F.lit(0).alias("own"), F.lit(1).alias("listed"), none["mask"], none["nested"]))
    facts = own.groupBy(*GROUP).agg(
        F.sum("own").alias("n"), F.sum("listed").alias("listed"), F.min("mask").alias("low"), F.max("mask").alias("high"), F.bool_or("nested").alias("any_list")
    )
    tabular = F.lit(table) if table or dashed else toon.is_tabular(F.col("low"), F.col("high"), F.col("any_list"))
    facts = facts.select(*GROUP, "n", "listed", "low", tabular.alias("tabular"))
    listed = facts
    if docs is not None:
        # A list named several times has as many heads; a list without a place counts no rows.
        placed = (F.col("n") > 0) & F.col("db_id").isNotNull() & F.col("path").isNotNull()
        listed = facts.withColumn("head", F.explode(F.array_repeat(F.lit(0), F.col("listed").cast("int")))).withColumns(
            {"n": F.when(placed, F.col("n")), "low": F.when(placed, F.col("low")), "tabular": F.when(placed, F.col("tabular"))})
    count = F.coalesce("n", F.lit(0).cast("bigint"))
    head = toon.list_head(F.col("list_name"), count, F.coalesce("tabular", F.lit(False)), F.col("low"), fields)
    heads = listed.select(*fragment(F.concat(F.lit("\n"), head), F.col("section"), order=FIRST))
    body = shaped.withColumn("tabular", F.lit(table)) if table or dashed else shaped.join(facts.select(*GROUP, "tabular"), GROUP)
    text = F.when(F.col("tabular"), F.concat(F.lit("\n" + INDENT), F.col("row_text"))).otherwise(
        F.concat(F.lit("\n"), F.col("dash_text"))
    )
    return heads.unionByName(body.select(*fragment(text, F.col("section"), F.col("k1"), F.col("ord"), F.col("k2"))))


def mixed_list(rows: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Lists at the root of documents whose elements are scalars, lists of scalars or objects.

    ``rows`` has ``GROUP``, the order columns, ``element`` (scalar, list or object), ``scalar`` (in text form), ``items``
    (texts of a list's scalars) and the members of objects. The form depends on all elements of a list: scalars alone
    stand in one line, objects with the same members in a table, anything else one element after a dash each.
    """
    places = [*GROUP, "k1", "ord", "k2"]
    own = ["element", "scalar", "items"]
    shaped = settle(toon.with_texts(rows, fields, *places, *own).select(*places, *own, *toon.shape_columns(fields, 1)))
    is_object = F.col("element") == "object"
    place = F.struct("k1", "ord", "k2")
    facts = shaped.groupBy(*GROUP).agg(
        F.count("*").alias("n"), F.count_if(F.col("element") == "scalar").alias("scalars"), F.count_if(is_object).alias("objects"),
        F.min(F.when(is_object, F.col("mask"))).alias("low"), F.max(F.when(is_object, F.col("mask"))).alias("high"),
        F.bool_or(is_object & F.col("nested")).alias("any_list"), F.min(place).alias("first"),
    )
    tabular = F.coalesce(toon.is_tabular(F.col("low"), F.col("high"), F.col("any_list")), F.lit(False)) & (F.col("n") == F.col("objects"))
    facts = facts.select(*GROUP, "n", "low", "first", (F.col("n") == F.col("scalars")).alias("inline"), tabular.alias("tabular"))
    head = F.concat(toon.list_head(F.col("list_name"), F.col("n"), F.col("tabular"), F.col("low"), fields), F.when(F.col("inline"), " ").otherwise(""))
    heads = facts.select(*fragment(F.concat(F.lit("\n"), head), F.col("section"), order=FIRST))
    dash = F.lit(f"\n{INDENT}- ")
    text = (
        F.when(F.col("inline"), F.concat(F.when(place == F.col("first"), "").otherwise(","), F.col("scalar")))
        .when(F.col("tabular"), F.concat(F.lit("\n" + INDENT), F.col("row_text")))
        .when(is_object, F.concat(F.lit("\n"), F.col("dash_text")))
        .when(F.col("element") == "list", F.concat(dash, toon.texts_list(F.col("items"))))
        .otherwise(F.concat(dash, F.col("scalar")))
    )
    body = shaped.join(facts.drop("n", "low"), GROUP)
    return heads.unionByName(body.select(*fragment(text, F.col("section"), F.col("k1"), F.col("ord"), F.col("k2"))))


RUN = [*DOC, "section", "k1"]


def run_of_values(
    rows: DataFrame, separator: str, head: Column, tail: Column | None = None, groups: DataFrame | None = None
) -> DataFrame:
    """Values strung together in one line.

    ``rows`` has ``RUN``, ``ord``, ``k2`` and ``value``. ``head`` and ``tail``
    are built on ``n`` and the columns of ``groups``, which also names the runs
    to print even when empty.
    """
    place = F.struct("ord", "k2")
    facts = rows.groupBy(*RUN).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    runs = groups.join(facts, RUN, "left") if groups is not None else facts
    runs = runs.withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    lead = F.when(place == F.col("first"), "").otherwise(separator)
    parts = [
        runs.select(*fragment(head, F.col("section"), F.col("k1"), FIRST)),
        rows.join(facts.select(*RUN, "first"), RUN).select(
            *fragment(F.concat(lead, F.col("value")), F.col("section"), F.col("k1"), F.col("ord"), F.col("k2"))
        ),
    ]
    if tail is not None:
        parts.append(runs.select(*fragment(tail, F.col("section"), F.col("k1"), LAST)))
    return union(parts)


def inline_head(name: str, indent: int = 0) -> Column:
    """``name:[N]: `` ahead of a run of values (``name:[0]:`` when there is none)."""
    return F.concat(
        F.lit(f"\n{INDENT * indent}{name}:["), F.col("n").cast("string"), F.lit("]:"), F.when(F.col("n") > 0, " ").otherwise("")
    )


def _unbroken(text: Column) -> Column:
    """Text less the line break its first line begins with."""
    return F.when(text.startswith("\n"), F.substr(text, F.lit(2))).otherwise(text)


#: Documents of more fragments are sorted by ranges, over as many tasks as they need.
LONG_DOCUMENT = 100_000


def with_positions(fragments: DataFrame) -> DataFrame:
    """Adds ``position``: 1, 2, ... in document order, whatever the size of the document and of the cluster.

    Fragments of a document are sorted by one task, and shuffled once, unless it has more than ``LONG_DOCUMENT``.
    The long ones go by ranges; neither the number nor the ranges leave a trace in the position.
    """
    written = settle(fragments.where("db_id IS NOT NULL AND path IS NOT NULL").select(*FRAGMENT))
    long = settle(written.groupBy(*DOC).agg(F.count("*").alias("n")).where(F.col("n") > LONG_DOCUMENT).select(*DOC))
    if long.isEmpty():
        return _positions_by_document(written)
    # At most one row for every so many fragments.
    few = F.broadcast(long)
    return _positions_by_document(written.join(few, DOC, "left_anti")).unionByName(_positions_by_range(written.join(few, DOC, "left_semi")))


def _positions_by_document(fragments: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*DOC).orderBy(*ORDER, "text"))
    return fragments.select(*FRAGMENT, place.cast("bigint").alias("position"))


def _positions_by_range(fragments: DataFrame) -> DataFrame:
    """Fragments are sorted into ranges, which split long documents; ranks within
    a range and the counts of the ranges before give the position. The ranges
    themselves are sampled and leave no trace in it.
    """
    order = [*ORDER, "text"]
    ranged = settle(fragments.select(*FRAGMENT).repartitionByRange(*DOC, *order).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy(*DOC, "range").agg(F.count("*").alias("own"))
    # One row a range that a document reaches into.
    before = counts.select(*DOC, "range", (F.sum("own").over(Window.partitionBy(*DOC).orderBy("range")) - F.col("own")).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*DOC, "range").orderBy(*order))
    return ranged.withColumn("rank", rank).join(before, [*DOC, "range"]).select(*FRAGMENT, (F.col("before") + F.col("rank")).alias("position"))


def assemble(fragments: DataFrame) -> DataFrame:
    """Text of each document as ``(db_id, path, part, doc)``; parts 0, 1, ... in order give the whole.

    A part is ``PART_FRAGMENTS`` consecutive fragments, the last one what is
    left; short documents have part 0 alone.
    """
    part = F.floor((F.col("position") - 1) / PART_FRAGMENTS).cast("int").alias("part")
    pieces = F.sort_array(F.collect_list(F.struct("position", "text")))
    parts = with_positions(fragments).groupBy(*DOC, part).agg(F.array_join(pieces["text"], "").alias("joined"))
    return parts.select(*DOC, "part", F.when(F.col("part") == 0, _unbroken(F.col("joined"))).otherwise(F.col("joined")).alias("doc"))
