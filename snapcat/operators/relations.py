"""Group B: facts about the foreign-key graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcat.operators.catalog import KEY
from snapcat.operators.names import JUNCTION_NAMES, contains_any
from snapcat.session import release, settle

# The three reasons, in the order they are tried.
REASON_KEY = "Primary key consists entirely of foreign key columns"
REASON_FEW = "Table has multiple foreign keys with minimal additional columns"
REASON_NAME = "Table name suggests junction pattern and has multiple foreign keys"

FROM_KEY = ["db_id", "from_schema", "from_table"]
TO_KEY = ["db_id", "to_schema", "to_table"]


def keyed(frame: DataFrame, prefix: str) -> DataFrame:
    """Frame with the table key taken from its ``from_``/``to_`` columns."""
    return frame.withColumnsRenamed({f"{prefix}_schema": "schema_name", f"{prefix}_table": "table_name"})


def incoming(fks: DataFrame, tables: DataFrame) -> DataFrame:
    """Foreign keys whose target is in the snapshot, self references included."""
    scope = tables.select("db_id", F.col("schema_name").alias("to_schema"), F.col("table_name").alias("to_table"))
    return fks.join(scope, TO_KEY, "left_semi")


def fk_counts(fks: DataFrame, tables: DataFrame) -> DataFrame:
    """Outgoing and incoming constraint counts of every table.

    Both sides are counted before they meet the tables, so a target that draws
    a third of all foreign keys costs one partial count per map task.
    """
    outgoing = keyed(fks, "from").groupBy(*KEY).agg(F.count("*").alias("fk_out"))
    arriving = keyed(fks, "to").groupBy(*KEY).agg(F.count("*").alias("fk_in"))
    zero = F.lit(0).cast("bigint")
    return (
        tables.select(*KEY)
        .join(outgoing, KEY, "left")
        .join(arriving, KEY, "left")
        .select(*KEY, F.coalesce("fk_out", zero).alias("fk_out"), F.coalesce("fk_in", zero).alias("fk_in"))
    )


def primary_keys(constraints: DataFrame) -> DataFrame:
    """First primary key of each table, by constraint name."""
    return (
        constraints.where("constraint_type = 'PRIMARY KEY'")
        .groupBy(*KEY)
        .agg(F.min_by("columns", "constraint_name").alias("pk_columns"), F.min("constraint_name").alias("pk_name"))
    )


def junctions(facts: DataFrame) -> DataFrame:
    """``is_junction`` and the reason, for every table of ``table_facts``."""
    keyed_by_fks = (F.col("n_key_columns") > 0) & (F.col("n_own_key_columns") == 0)
    few_columns = (F.col("n_payload") <= 2) & (F.col("n_columns") <= 8)
    reason = (
        F.when(keyed_by_fks, REASON_KEY)
        .when(few_columns, REASON_FEW)
        .when(contains_any(F.lower("table_name"), JUNCTION_NAMES), REASON_NAME)
    )
    return facts.withColumn("junction_reasoning", F.when(F.col("fk_out") >= 2, reason)).withColumn(
        "is_junction", F.col("junction_reasoning").isNotNull()
    )


def with_fk_unique(fks: DataFrame, constraints: DataFrame, indexes: DataFrame) -> DataFrame:
    """Whether the foreign key's columns are exactly those of some key or unique index.

    Order does not matter, so both sides compare as sorted lists. The distinct keys of a
    table, each a few names (32 columns at most, the server's limit), are gathered beside
    its foreign keys: these go by their table, as they do to meet whatever else it has.
    """
    names = F.array_sort(F.array_distinct("columns"))
    keys = (
        constraints.where(F.col("constraint_type").isin("PRIMARY KEY", "UNIQUE"))
        .select(*KEY, "columns")
        .unionByName(indexes.where("is_unique").select(*KEY, "columns"))
        .where(F.size("columns") > 0)  # an index over expressions names no column and makes none unique
        .groupBy(
            F.col("db_id"), F.col("schema_name").alias("from_schema"), F.col("table_name").alias("from_table")
        )
        .agg(F.collect_set(F.struct(F.size("columns").alias("width"), names.alias("names"))).alias("unique_keys"))
    )
    shaped = fks.withColumns(
        {"width": F.size("from_columns"), "column_set": F.array_sort(F.array_distinct("from_columns"))}
    )
    own, width = F.col("column_set"), F.col("width")
    exact = F.exists("unique_keys", lambda k: (k["width"] == width) & (k["names"] == own))
    # A foreign key that names a column twice matches any key of its width that holds its distinct columns.
    held = F.exists("unique_keys", lambda k: (k["width"] == width) & (F.size(F.array_except(own, k["names"])) == 0))
    loose = (F.size(own) < width) & ~F.exists(own, lambda x: x.isNull()) & held
    return (
        shaped.join(keys, FROM_KEY, "left")
        .withColumn("fk_unique", F.coalesce(exact, F.lit(False)) | F.coalesce(loose, F.lit(False)))
        .drop("width", "column_set", "unique_keys")
    )


def with_cardinality(fks: DataFrame, junctions: DataFrame) -> DataFrame:
    """``many-to-many`` out of junction tables, else by uniqueness (needs ``fk_unique``)."""
    flags = junctions.where("is_junction").select(
        "db_id", F.col("schema_name").alias("from_schema"), F.col("table_name").alias("from_table"), "is_junction"
    )
    cardinality = (
        F.when(F.col("is_junction"), "many-to-many").when(F.col("fk_unique"), "one-to-one").otherwise("many-to-one")
    )
    return fks.join(flags, FROM_KEY, "left").withColumn("cardinality", cardinality).drop("is_junction", "fk_unique")


def graph_nodes(tables: DataFrame) -> DataFrame:
    return tables.select("db_id", "table_name", "schema_name")


def graph_edges(fks: DataFrame) -> DataFrame:
    """One edge per foreign key, out-of-scope targets included."""
    names = ("db_id", "from_table", "from_schema", "from_columns", "to_table", "to_schema", "to_columns", "constraint_name")
    # Lists of columns that the snapshot was not asked for are not there.
    return fks.select(*(n for n in names if n in fks.columns))


def graph_candidates(junctions: DataFrame) -> DataFrame:
    return junctions.where("is_junction").select("db_id", "table_name", "schema_name")


def graph_components(fks: DataFrame) -> DataFrame:
    """Tables on cycles of foreign keys, with their component; written, because several parts of a document read it."""
    return settle(strongly_connected(graph_edges(fks)))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """Groups of two or more tables that reach each other through foreign keys.

    Colouring: every table takes the greatest table that reaches it; of the
    tables of a colour those that reach its root in turn form one component,
    and the edges of the rest go on. Greatest is by hash, so that chains fall
    apart in few rounds whatever their names. Frames stay linear in the edges
    (no pair closure) and each round is settled in the shared folder, so a lost
    executor costs one round at most. Only row counts come to the driver.
    """
    def end(side: str) -> Column:
        schema, table = F.col(f"{side}_schema"), F.col(f"{side}_table")
        return F.struct(F.xxhash64(schema, table).alias("rank"), schema.alias("schema_name"), table.alias("table_name"))

    live = settle(edges.select("db_id", end("from").alias("src"), end("to").alias("dst")).where("src <> dst").distinct())
    found: list[DataFrame] = [live.limit(0).select("db_id", F.col("src").alias("v"), F.col("src").alias("colour"))]
    first = live
    while not live.isEmpty():
        # An edge lies on a cycle only if something leads to it and away from it.
        inner = settle(live.join(live.select("db_id", F.col("dst").alias("src")).distinct(), ["db_id", "src"], "left_semi").join(
            live.select("db_id", F.col("src").alias("dst")).distinct(), ["db_id", "dst"], "left_semi"
        ))
        colours = _spread(inner)
        tinted = settle(
            inner.join(colours.select("db_id", F.col("v").alias("src"), "colour"), ["db_id", "src"])
            .join(colours.select("db_id", F.col("v").alias("dst"), F.col("colour").alias("dst_colour")), ["db_id", "dst"])
            .where("colour = dst_colour")
            .select("db_id", "src", "dst", "colour")
        )
        # Backwards inside a colour its root is the greatest that can be reached.
        reached = _spread(tinted.select("db_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
        own = colours.select("db_id", "v", F.col("colour").alias("own"))
        members = settle(reached.join(own, ["db_id", "v"]).where("colour = own").select("db_id", "v", "colour"))
        found.append(members)
        done = members.select("db_id", "v")
        rest = settle(
            tinted.select("db_id", "src", "dst")
            .join(done.withColumnRenamed("v", "src"), ["db_id", "src"], "left_anti")
            .join(done.withColumnRenamed("v", "dst"), ["db_id", "dst"], "left_anti")
        )
        release(inner, colours, tinted, reached, *(() if live is first else (live,)))
        live = rest
    members = found[0]
    for more in found[1:]:
        members = members.unionByName(more)
    name = F.max(F.struct("v.schema_name", "v.table_name")).alias("name")
    sizes = members.groupBy("db_id", "colour").agg(F.count("*").alias("component_size"), name).where("component_size >= 2")
    return members.join(sizes, ["db_id", "colour"]).select(
        "db_id",
        F.col("name.schema_name").alias("component_schema"),
        F.col("name.table_name").alias("component_table"),
        F.col("v.schema_name").alias("schema_name"),
        F.col("v.table_name").alias("table_name"),
        "component_size",
    )


def _spread(live: DataFrame) -> DataFrame:
    """Greatest vertex that reaches each vertex, itself included.

    Each round takes the colours of neighbours and then the colour of the own
    colour, which reaches whatever its bearer reaches.
    """
    colours = settle(
        live.select("db_id", F.explode(F.array("src", "dst")).alias("v"))
        .distinct()
        .withColumn("colour", F.col("v"))
    )
    while True:
        offers = (
            live.join(colours.withColumnRenamed("v", "src"), ["db_id", "src"])
            .groupBy("db_id", F.col("dst").alias("v"))
            .agg(F.max("colour").alias("offer"))
        )
        near = settle(colours.join(offers, ["db_id", "v"], "left").select("db_id", "v", "colour", F.greatest("colour", "offer").alias("near")))
        jumps = near.select("db_id", F.col("v").alias("near"), F.col("near").alias("far"))
        step = settle(
            near.join(jumps, ["db_id", "near"], "left")
            .select("db_id", "v", F.greatest("near", "far").alias("colour"), (F.greatest("near", "far") != F.col("colour")).alias("moved"))
        )
        release(near, colours)
        colours = step
        if step.where("moved").isEmpty():
            return step
