"""Group G: one function per kind of document, each giving fragments.

Members appear in the declared order of the lists below; ``omit`` says when a
member is left out.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcat.functions import toon
from snapcat.functions.toon import Field
from snapcat.operators import domains, overview, relations, semantics, tags
from snapcat.operators.catalog import KEY, with_fk_nullable
from snapcat.operators.facts import table_facts
from snapcat.plans import fragments as fr
from snapcat.plans.paths import database_path, object_path, with_safe_name
from snapcat.plans.snapshot import SnapshotConfig
from snapcat.session import settle
from snapcat.sources.lazy import LazyFrames

# Members of each object, in order.
COLUMN = (
    Field("column_name"),
    Field("data_type"),
    Field("udt_name", omit="empty"),
    Field("nullable", "bool"),
    Field("default_value", omit="null"),
    Field("generated", "bool", "false"),
    Field("generation_expression", omit="null"),
    Field("is_identity", "bool", "false"),
    Field("identity_generation", omit="empty"),
    Field("collation", omit="null"),
    Field("character_max_length", "integer", "null"),
    Field("numeric_precision", "integer", "null"),
    Field("numeric_scale", "integer", "null"),
)
PRIMARY_KEY = (Field("columns", "strings", source="pk_columns"), Field("constraint_name", omit="empty", source="pk_name"))
STRUCTURE = (Field("table_name"), Field("schema_name", omit="empty"), Field("table_type", omit="empty"))
INDEX = (
    Field("index_name"),
    Field("unique", "bool", source="is_unique"),
    Field("primary", "bool", "false", source="is_primary"),
    Field("index_type", omit="empty"),
    Field("columns", "strings"),
    Field("include_columns", "strings", "empty"),
    Field("predicate", omit="null"),
    Field("expression", omit="null"),
)
CONSTRAINT = (
    Field("constraint_name"),
    Field("constraint_type"),
    Field("columns", "strings", "empty"),
    Field("expression", omit="null"),
    Field("definition", omit="null"),
)
NOT_NULL = (Field("constraint_name"), Field("constraint_type"), Field("columns", "strings"))
OUTGOING = (
    Field("constraint_name"),
    Field("from_columns", "strings"),
    Field("to_table"),
    Field("to_schema", omit="empty"),
    Field("to_columns", "strings"),
    Field("on_update", omit="empty"),
    Field("on_delete", omit="empty"),
    Field("nullable", "bool"),
    Field("cardinality", omit="empty"),
)
INCOMING = (
    Field("constraint_name"),
    Field("from_table"),
    Field("from_schema", omit="empty"),
    Field("from_columns", "strings"),
    Field("to_columns", "strings"),
    Field("cardinality", omit="empty"),
)
JUNCTION = (Field("is_junction", "bool"), Field("reasoning", omit="empty", source="junction_reasoning"))
TRIGGER = (
    Field("trigger_name"),
    Field("timing"),
    Field("events", "strings"),
    Field("function_or_procedure", omit="empty"),
    Field("definition", omit="null"),
)
COLUMN_STAT = (Field("null_fraction", "double", "null"), Field("distinct_count_estimate", "integer", "null"))
# Facts that come from rows only.
ROW_STAT = (*COLUMN_STAT, Field("min", "raw", "null", "min_text"), Field("max", "raw", "null", "max_text"), Field("top_values", "raws", "empty"))
NODE = (Field("table_name"), Field("schema_name", omit="empty"))
EDGE = (
    Field("from_table"),
    Field("from_schema", omit="empty"),
    Field("from_columns", "strings"),
    Field("to_table"),
    Field("to_schema", omit="empty"),
    Field("to_columns", "strings"),
    Field("constraint_name"),
)
INDEX_ENTRY = (
    Field("table_name"),
    Field("schema_name", omit="empty"),
    Field("short_description", omit="empty"),
    Field("row_count_estimate", "integer", "null"),
    Field("primary_key_columns", "strings", "empty"),
    Field("foreign_key_out_count", "integer"),
    Field("foreign_key_in_count", "integer"),
    Field("tags", "strings", "empty"),
)
VIEW = (Field("view_name", source="table_name"), Field("schema_name", omit="empty"), Field("definition", omit="null"))
ROUTINE = (
    Field("routine_name"),
    Field("schema_name", omit="empty"),
    Field("routine_type"),
    Field("language", omit="empty"),
)
ARGUMENT = (Field("name", omit="empty"), Field("data_type"), Field("mode", omit="empty"))
ENUM = (Field("enum_name"), Field("schema_name", omit="empty"))
SEQUENCE = (
    Field("sequence_name"),
    Field("schema_name", omit="empty"),
    Field("data_type", omit="empty"),
    Field("start_value", "integer", "null"),
    Field("min_value", "integer", "null"),
    Field("max_value", "integer", "null"),
    Field("increment", "integer", "null"),
    Field("cycle", "bool", "false"),
    Field("owned_by", omit="empty"),
    Field("comment", omit="empty"),
)
TYPE = (Field("type_name"), Field("schema_name", omit="empty"), Field("type_kind"))
ATTRIBUTE = (Field("name"), Field("data_type"))

ROW = toon.Members()
SEMANTIC_LISTS = ("status", "timestamp", "currency_amount", "id")


class Model:
    """Snapshot frames and the facts the documents draw on, each planned once.

    Table facts feed several parts of one document and are settled.
    ``settled`` does the same for the paths, which a full run uses in every kind.
    """

    def __init__(self, frames: Mapping[str, DataFrame], cfg: SnapshotConfig, settled: bool = False):
        self.frames = frames
        self.cfg = cfg
        self.settled = settled

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]

    @cached_property
    def table_dirs(self) -> DataFrame:
        keys = self["tables"].select(*KEY)
        named = with_safe_name(keys, F.col("table_name"), F.col("table_name")).withColumnRenamed("safe", "dir")
        return settle(named) if self.settled else named

    @cached_property
    def view_dirs(self) -> DataFrame:
        keys = self["views"].select(*KEY)
        return with_safe_name(keys, F.col("table_name"), F.col("table_name")).withColumnRenamed("safe", "dir")

    @cached_property
    def junctions(self) -> DataFrame:
        return settle(
            relations.junctions(
                table_facts(self["tables"], self["columns"], self["constraints"], self["foreign_keys"])
            )
        )

    @cached_property
    def flags(self) -> DataFrame:
        return settle(tags.tag_flags(self.junctions))

    @cached_property
    def primary_keys(self) -> DataFrame:
        return relations.primary_keys(self["constraints"])

    @cached_property
    def linked(self) -> DataFrame:
        """Foreign keys with nullability and cardinality."""
        fks = self["foreign_keys"]
        if "nullable" not in fks.columns:
            fks = with_fk_nullable(fks, self["columns"])
        unique = relations.with_fk_unique(fks, self["constraints"], self["indexes"])
        return settle(relations.with_cardinality(unique, self.junctions))

    def table_docs(self, kind: str) -> DataFrame:
        """The table key and the path of one document of each table."""
        return self.table_dirs.select(*KEY, object_path("tables", F.col("dir"), f"table.{kind}.toon").alias("path"))

    def written_docs(self, kind: str) -> DataFrame:
        """The same, written: for documents whose parts all ask for the paths."""
        return settle(self.table_docs(kind))

    def view_docs(self, kind: str) -> DataFrame:
        return self.view_dirs.select(*KEY, object_path("views", F.col("dir"), f"view.{kind}.toon").alias("path"))


def _placed(frame: DataFrame, section: int, list_name: str, k1="", order=0.0, k2="") -> DataFrame:
    """Adds the place of each row within its document."""
    def column(value, kind):
        return (value if isinstance(value, Column) else F.lit(value)).cast(kind)

    return frame.withColumns(
        {"section": F.lit(section), "list_name": F.lit(list_name), "k1": column(k1, "string"),
         "ord": column(order, "double"), "k2": column(k2, "string")}
    )


def _lists(docs: DataFrame, section: int, list_name: str) -> DataFrame:
    return docs.select(*fr.DOC, F.lit(section).alias("section"), F.lit(list_name).alias("list_name"))


def _pair(*parts: str) -> Column:
    """One sort key of several; the separator sorts below any printable character."""
    return F.concat_ws("\x1f", *parts)


def doc_structure(m: Model) -> DataFrame:
    rows = m["tables"].join(m.table_docs("structure"), KEY).join(m.primary_keys, KEY, "left")
    key = F.when(
        F.col("pk_columns").isNotNull(), toon.nested_object("primary_key", toon.object_lines(ROW, PRIMARY_KEY, 1))
    )
    estimate = Field("row_count_estimate", "integer", "null").line(ROW)
    return fr.whole(rows, toon.lines([*(f.line(ROW) for f in STRUCTURE), key, estimate]))


def _columns_doc(docs: DataFrame, columns: DataFrame) -> DataFrame:
    """Column lists; a table holds at most 1,600 columns, so each is gathered in one row."""
    place = [*KEY, "ordinal_position"]
    shaped = toon.with_texts(columns, COLUMN, *place).select(*place, *toon.shape_columns(COLUMN, 1))
    listed = shaped.groupBy(*KEY).agg(
        F.count("*").alias("n"),
        F.min("mask").alias("low"),
        F.max("mask").alias("high"),
        F.sort_array(F.collect_list(F.struct("ordinal_position", "row_text", "dash_text"))).alias("items"),
    )
    tabular = F.coalesce(toon.is_tabular(F.col("low"), F.col("high"), F.lit(False)), F.lit(False))
    head = toon.list_head(F.lit("columns"), F.coalesce("n", F.lit(0).cast("bigint")), tabular, F.col("low"), COLUMN)
    rows = F.concat(F.lit("\n" + toon.INDENT), F.array_join("items.row_text", "\n" + toon.INDENT))
    dashes = F.concat(F.lit("\n"), F.array_join("items.dash_text", "\n"))
    body = F.when(F.col("n").isNull(), "").when(tabular, rows).otherwise(dashes)
    return fr.whole(docs.join(listed, KEY, "left"), F.concat(head, body))


def doc_columns(m: Model) -> DataFrame:
    return _columns_doc(m.table_docs("columns"), m["columns"])


def doc_indexes(m: Model) -> DataFrame:
    docs = m.written_docs("indexes")
    rows = _placed(m["indexes"].join(docs, KEY), 0, "indexes", k2=F.col("index_name"))
    return fr.object_list(rows, INDEX, _lists(docs, 0, "indexes"))


# Lists of the constraints document by constraint type.
CONSTRAINT_LISTS = {"UNIQUE": (10, "unique_constraints"), "CHECK": (20, "check_constraints"), "EXCLUSION": (30, "exclusion_constraints")}


def doc_constraints(m: Model) -> DataFrame:
    docs = m.written_docs("constraints")
    named = m["constraints"].join(docs, KEY)
    # A table has one primary key; should an export list several, the last by name wins.
    keys = (
        named.where("constraint_type = 'PRIMARY KEY'")
        .groupBy("db_id", "path")
        .agg(F.max_by(F.struct(*(f.name for f in CONSTRAINT)), "constraint_name").alias("key"))
        .select("db_id", "path", "key.*")
    )
    parts = [fr.whole(keys, toon.nested_object("primary_key", toon.object_lines(ROW, CONSTRAINT, 1)))]
    kind = F.col("constraint_type")
    section, name = F, F
    for constraint_type, (number, list_name) in CONSTRAINT_LISTS.items():
        section = section.when(kind == constraint_type, number)
        name = name.when(kind == constraint_type, list_name)
    others = named.where(kind.isin(*CONSTRAINT_LISTS)).withColumns(
        {"section": section, "list_name": name, "k1": F.lit(""), "ord": F.lit(0.0), "k2": F.col("constraint_name")}
    )
    parts.append(fr.object_list(others, CONSTRAINT))
    required = m["columns"].where(~F.col("nullable")).join(docs, KEY).select(
        *fr.DOC,
        "ordinal_position",
        F.concat("column_name", F.lit("_not_null")).alias("constraint_name"),
        F.lit("NOT NULL").alias("constraint_type"),
        F.array("column_name").alias("columns"),
    )
    parts.append(fr.object_list(_placed(required, 40, "not_null_constraints", order=F.col("ordinal_position")), NOT_NULL))
    return fr.union(parts)


def doc_relations(m: Model) -> DataFrame:
    docs = m.written_docs("relations")
    linked = m.linked
    source = relations.keyed(linked.select("db_id", "from_schema", "from_table", *(f.name for f in OUTGOING)), "from")
    outgoing = _placed(source.join(docs, KEY), 0, "outgoing_foreign_keys", k2=F.col("constraint_name"))
    # Joining the documents of the snapshot's tables keeps in-scope targets only.
    target = relations.keyed(linked.select("db_id", "to_schema", "to_table", *(f.name for f in INCOMING)), "to")
    incoming = _placed(
        target.join(docs, KEY), 10, "incoming_foreign_keys", k1=F.col("from_schema"), k2=_pair("from_table", "constraint_name")
    )
    detection = toon.nested_object("junction_table_detection", toon.object_lines(ROW, JUNCTION, 1))
    return fr.union([
        fr.object_list(outgoing, OUTGOING, _lists(docs, 0, "outgoing_foreign_keys")),
        fr.object_list(incoming, INCOMING, _lists(docs, 10, "incoming_foreign_keys")),
        fr.whole(m.junctions.join(docs, KEY), detection, 20),
    ])


def doc_triggers(m: Model) -> DataFrame:
    docs = m.written_docs("triggers")
    rows = _placed(m["triggers"].join(docs, KEY), 0, "triggers", k2=F.col("trigger_name"))
    return fr.object_list(rows, TRIGGER, _lists(docs, 0, "triggers"))


def _sorted_texts(test: Column, order: str, text: Column) -> Column:
    return F.sort_array(F.collect_list(F.when(test, F.struct(F.col(order).alias("o"), text.alias("t")))))["t"]


def _comment_lines(columns: DataFrame) -> Column:
    line = F.concat(F.lit(toon.INDENT), toon.key_text(F.col("column_name")), F.lit(": "), toon.quoted(F.col("comment")))
    return _sorted_texts(F.coalesce(F.col("comment") != "", F.lit(False)), "column_name", line)


def _map_block(name: str, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(lines, "\n")))


def doc_comments(m: Model) -> DataFrame:
    """Table comment, column comments and column semantics (at most 1,600 columns per table)."""
    name = toon.quoted(F.col("column_name"))
    classed, lists = semantics.column_classes(m["columns"]), SEMANTIC_LISTS
    if "enum_like" in m.frames:
        found = m["enum_like"].select(*KEY, "column_name", F.lit(True).alias("is_enum_like"))
        classed, lists = classed.join(found, [*KEY, "column_name"], "left"), ("enum_like", *SEMANTIC_LISTS)
    gathered = classed.groupBy(*KEY).agg(
        _comment_lines(classed).alias("comments"),
        *(_sorted_texts(F.coalesce(f"is_{kind}", F.lit(False)), "ordinal_position", name).alias(f"{kind}_columns") for kind in lists),
    )
    rows = m["tables"].join(m.table_docs("comments"), KEY).join(gathered, KEY, "left")
    semantic = toon.lines(
        [
            F.when(F.size(f"{kind}_columns") > 0, F.concat(F.lit(f"{kind}_columns:"), toon.texts_list(F.col(f"{kind}_columns"))))
            for kind in lists
        ],
        1,
    )
    parts = [
        Field("table_comment", omit="empty", source="comment").line(ROW),
        _map_block("column_comments", F.col("comments")),
        F.when(semantic != "", F.concat(F.lit("inferred_semantics:\n"), semantic)),
    ]
    return fr.whole(rows, toon.lines(parts))


def doc_stats(m: Model) -> DataFrame:
    body = toon.object_lines(ROW, ROW_STAT if "top_values" in m["column_stats"].columns else COLUMN_STAT, 2)
    entry = F.concat(F.lit(toon.INDENT), toon.key_text(F.col("column_name")), F.lit(":\n"), body)
    per_column = m["column_stats"].groupBy(*KEY).agg(_sorted_texts(F.lit(True), "column_name", entry).alias("entries"))
    rows = m["stats"].join(m.table_docs("stats"), KEY).join(per_column, KEY, "left")
    parts = [
        Field("computed_at").line(ROW),
        Field("sampling_strategy").line(ROW),
        Field("row_count_estimate", "integer", "null").line(ROW),
        _map_block("per_column_stats", F.col("entries")),
        Field("note", omit="empty").line(ROW),
    ]
    return fr.whole(rows, toon.lines(parts))


def doc_view_definition(m: Model) -> DataFrame:
    return fr.whole(m["views"].join(m.view_docs("definition"), KEY), toon.object_lines(ROW, VIEW))


def doc_view_columns(m: Model) -> DataFrame:
    return _columns_doc(m.view_docs("columns"), m["view_columns"])


def doc_view_dependencies(m: Model) -> DataFrame:
    docs = m.view_docs("dependencies")
    parts = [docs.select(*fr.fragment(F.lit("")))]  # a view without dependencies has an empty document
    for number, kind, name in ((1, "r", "depends_on_tables"), (2, "v", "depends_on_views")):
        rows = m["view_dependencies"].where(F.col("dep_kind") == kind).join(docs, KEY).select(
            *fr.DOC, F.lit(number).alias("section"), F.lit("").alias("k1"), F.lit(0.0).alias("ord"),
            F.col("dependency").alias("k2"), toon.quoted(F.col("dependency")).alias("value"),
        )
        parts.append(fr.run_of_values(rows, ",", fr.inline_head(name)))
    return fr.union(parts)


def doc_view_comments(m: Model) -> DataFrame:
    comments = m["view_columns"].groupBy(*KEY).agg(_comment_lines(m["view_columns"]).alias("comments"))
    rows = m["views"].join(m.view_docs("comments"), KEY).join(comments, KEY, "left")
    parts = [Field("view_comment", omit="empty", source="comment").line(ROW), _map_block("column_comments", F.col("comments"))]
    return fr.whole(rows, toon.lines(parts))


def doc_routines(m: Model) -> DataFrame:
    folder = F.when(F.col("routine_type") == "procedure", "procedures").otherwise("functions")
    named = with_safe_name(
        m["routines"].withColumn("folder", folder), F.col("routine_name"), F.col("routine_oid"), "folder"
    ).withColumn("path", object_path("routines", F.col("folder"), F.concat("safe", F.lit(".toon"))))
    parts = [
        *(f.line(ROW) for f in ROUTINE),
        F.when(F.size("arguments") > 0, toon.list_text("arguments", F.col("arguments"), ARGUMENT)),
        Field("return_type", omit="empty").line(ROW),
        Field("definition", omit="null").line(ROW),
    ]
    return fr.whole(named, toon.lines(parts))


def _object_docs(frame: DataFrame, name: str, folder: str) -> DataFrame:
    safe = with_safe_name(frame, F.col(name), F.col(name))
    return safe.withColumn("path", object_path(folder, F.concat("safe", F.lit(".toon")))).drop("safe")


def doc_enums(m: Model) -> DataFrame:
    docs = _object_docs(m["enums"], "enum_name", "enums")
    enum_key = ["db_id", "schema_name", "enum_name"]
    labels = m["enum_labels"].where("label IS NOT NULL").join(docs.select(*enum_key, "path"), enum_key).select(
        *fr.DOC, F.lit(1).alias("section"), F.lit("").alias("k1"), F.col("sort_order").alias("ord"),
        F.col("label").alias("k2"), toon.quoted(F.col("label")).alias("value"),
    )
    runs = docs.select(*fr.DOC, F.lit(1).alias("section"), F.lit("").alias("k1"))
    comment = Field("comment", omit="empty").line(ROW)
    return fr.union([
        fr.whole(docs, toon.object_lines(ROW, ENUM)),
        fr.run_of_values(labels, ",", fr.inline_head("values"), groups=runs),
        fr.whole(docs, comment, 2),
    ])


def doc_sequences(m: Model) -> DataFrame:
    return fr.whole(_object_docs(m["sequences"], "sequence_name", "sequences"), toon.object_lines(ROW, SEQUENCE))


def doc_types(m: Model) -> DataFrame:
    parts = [
        *(f.line(ROW) for f in TYPE),
        F.when(F.size("attributes") > 0, toon.list_text("attributes", F.col("attributes"), ATTRIBUTE)),
        Field("base_type", omit="empty").line(ROW),
        Field("constraint", omit="null").line(ROW),
        Field("comment", omit="empty").line(ROW),
    ]
    return fr.whole(_object_docs(m["types"], "type_name", "types"), toon.lines(parts))


COUNTED = ("tables", "views", "routines", "enums", "sequences", "types")


def database_counts(m: Model) -> DataFrame:
    """Objects of each kind per database, 0 for kinds that are switched off."""
    out = m["databases"]
    for kind in COUNTED:
        column = f"n_{kind}"
        if kind in m.frames:
            counted = m[kind].groupBy("db_id").agg(F.count("*").alias(column))
            out = out.join(counted, "db_id", "left").withColumn(column, F.coalesce(column, F.lit(0).cast("bigint")))
        else:
            out = out.withColumn(column, F.lit(0).cast("bigint"))
    return out


def doc_manifest(m: Model) -> DataFrame:
    cfg = m.cfg
    enabled = toon.lines(
        [
            F.lit("tables: true"),
            *(F.concat(F.lit(f"{kind}: "), (F.col(f"n_{kind}") > 0).cast("string")) for kind in COUNTED[1:]),
            F.lit(f"stats: {str(cfg.include_stats).lower()}"),
        ],
        1,
    )
    schemas = F.array(*(F.lit(s) for s in cfg.schemas)).cast("array<string>")
    parts = [
        F.concat(F.lit("generation_timestamp: "), toon.quoted(F.lit(cfg.generated_at))),
        Field("database_engine", source="engine").line(ROW),
        Field("database_version", omit="empty", source="version").line(ROW),
        Field("database_name", source="name").line(ROW),
        F.concat(F.lit("included_schemas:"), toon.inline_list(schemas)),
        Field("included_tables_count", "integer", source="n_tables").line(ROW),
        F.concat(F.lit("enabled_artifacts:\n"), enabled),
        F.lit(f"stats_enabled: {str(cfg.include_stats).lower()}"),
        F.lit("usage_enabled: false"),
    ]
    rows = database_counts(m).withColumn("path", database_path("manifest.toon"))
    return fr.whole(rows, toon.lines(parts))


def _database_docs(m: Model, name: str) -> DataFrame:
    return m["databases"].select("db_id", database_path(name).alias("path"))


def doc_index(m: Model) -> DataFrame:
    docs = _database_docs(m, "db.index.toon")
    entries = overview.db_index(m["tables"], tags.table_tags(m.flags), m.primary_keys, m.cfg.redact_comments)
    # The list's shape and its rows both read the entries.
    listed = settle(entries).withColumn("path", database_path("db.index.toon"))
    rows = _placed(listed, 0, "tables", k1=F.col("schema_name"), k2=F.col("table_name"))
    # At most five start tables per database.
    starts = overview.start_tables(m.flags).groupBy("db_id").agg(
        F.sort_array(F.collect_list(F.struct("position", toon.quoted(F.col("table_name")).alias("t"))))["t"].alias("starts")
    )
    recommended = starts.withColumn("path", database_path("db.index.toon"))
    return fr.union([
        fr.object_list(rows, INDEX_ENTRY, _lists(docs, 0, "tables")),
        fr.whole(recommended, F.concat(F.lit("recommended_start_tables:"), toon.texts_list(F.col("starts"))), 1),
    ])


def doc_graph(m: Model) -> DataFrame:
    path = database_path("db.relationships.toon")
    docs = _database_docs(m, "db.relationships.toon")
    nodes = _placed(relations.graph_nodes(m["tables"]).withColumn("path", path), 0, "nodes",
                    k1=F.col("schema_name"), k2=F.col("table_name"))
    edges = _placed(relations.graph_edges(m["foreign_keys"]).withColumn("path", path), 1, "edges",
                    k1=F.col("constraint_name"), k2=_pair("from_schema", "from_table"))
    candidates = relations.graph_candidates(m.junctions).select(
        "db_id", path.alias("path"), F.lit(2).alias("section"), F.lit("").alias("k1"), F.lit(0.0).alias("ord"),
        _pair("table_name", "schema_name").alias("k2"), toon.quoted(F.col("table_name")).alias("value"),
    )
    return fr.union([
        fr.object_list(nodes, NODE, _lists(docs, 0, "nodes")),
        fr.object_list(edges, EDGE, _lists(docs, 1, "edges")),
        fr.run_of_values(candidates, ",", fr.inline_head("junction_table_candidates")),
        *_component_lists(relations.graph_components(m["foreign_keys"]).withColumn("path", path)),
    ])


def _component_lists(members: DataFrame) -> list[DataFrame]:
    """Components as a list of lists of table names, in the order of their first tables; nothing where a database has none.

    A component is a run of fragments, however many tables it has.
    """
    group = [*fr.DOC, "component_schema", "component_table"]
    first = members.groupBy(*group).agg(F.min(F.struct("schema_name", "table_name")).alias("first"))
    first = settle(first.select(*group, _pair("first.schema_name", "first.table_name").alias("k1")))
    counts = first.groupBy(*fr.DOC).agg(F.count("*").cast("string").alias("n"))
    values = members.join(first, group).select(
        *fr.DOC, F.lit(3).alias("section"), "k1", F.lit(0.0).alias("ord"), _pair("schema_name", "table_name").alias("k2"),
        toon.quoted(F.col("table_name")).alias("value"),
    )
    # The head has an empty key, which comes before any component.
    head = F.concat(F.lit("strongly_connected_components:["), F.col("n"), F.lit("]:"))
    item = F.concat(F.lit(f"\n{toon.INDENT}- ["), F.col("n").cast("string"), F.lit("]: "))
    return [fr.whole(counts, head, 3), fr.run_of_values(values, ",", item)]


def doc_domains(m: Model) -> DataFrame:
    """Domains as list items; the tables of one are a run, however many they are."""
    path = database_path("db.domains.toon")
    placed = domains.table_domains(m["tables"]).select(
        "db_id", path.alias("path"), F.lit(1).alias("section"), F.col("domain").alias("k1"), F.lit(0.0).alias("ord"),
        _pair("table_name", "schema_name").alias("k2"), toon.quoted(F.col("table_name")).alias("value"),
    )
    listed = placed.groupBy(*fr.RUN).agg(F.count("*").alias("n")).groupBy(*fr.DOC).agg(F.count("*").alias("domain_count"))
    docs = _database_docs(m, "db.domains.toon").join(listed, fr.DOC, "left")
    count = F.coalesce("domain_count", F.lit(0).cast("bigint"))
    pad = toon.INDENT
    item = F.concat(
        F.lit(f"\n{pad}- \n{pad * 2}domain_name: "), toon.quoted(F.col("k1")), fr.inline_head("tables", 2)
    )
    return fr.union([
        fr.whole(docs, F.concat(F.lit("domains:["), count.cast("string"), F.lit("]:"))),
        fr.run_of_values(placed, ",", item),
    ])


# The guide's lines; those with a kind appear only when the database has such objects.
GUIDE = (
    ("List all tables", "db.index.toon", None),
    ("See how tables connect", "db.relationships.toon", None),
    ("Find tables by domain/feature", "db.domains.toon", None),
    ("Get columns for a table", "tables/<name>/table.columns.toon", None),
    ("Get primary/foreign keys", "tables/<name>/table.relations.toon", None),
    ("Check indexes/constraints", "tables/<name>/table.indexes.toon", None),
    ("Look up enum values", "enums/<name>.toon", "enums"),
    ("View definitions", "views/<name>/view.definition.toon", "views"),
    ("Function/procedure code", "routines/functions/<name>.toon", "routines"),
)
# Buckets in print order with their headings.
BUCKETS = (
    ("core", "**Core** (central entities): "),
    ("other", "**Tables**: "),
    ("junction", "**Junction** (many-to-many): "),
    ("lookup", "**Lookup**: "),
)


def doc_overview(m: Model) -> DataFrame:
    """The plain-text guide to one database. Its sentences and headings are fixed values."""
    path = database_path("llms.txt")
    # Every part of the guide reads the counts.
    counts = settle(database_counts(m)).withColumn("path", path)
    schemas = F.array(*(F.lit(s) for s in m.cfg.schemas)).cast("array<string>")

    def text(*parts) -> Column:
        return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))

    def if_any(kind: str, line: Column) -> Column:
        return F.when(F.col(f"n_{kind}") > 0, line)

    intro = toon.lines([
        text("# ", F.col("name"), " Schema Reference\n"),
        text("This directory contains complete schema documentation for ", F.col("name"), " (", F.col("engine"), " ",
             F.col("version"), ").\n"),
        F.lit("## Finding What You Need\n\n| Task | File to Read |\n|------|-------------|"),
        *(
            if_any(kind, F.lit(f"| {task} | `{file}` |")) if kind else F.lit(f"| {task} | `{file}` |")
            for task, file, kind in GUIDE
        ),
        F.lit("\n## At a Glance\n"),
        text("- **", F.col("n_tables").cast("string"), " tables** across ", overview.schema_list(schemas)),
        *(if_any(kind, text("- **", F.col(f"n_{kind}").cast("string"), f" {kind}**")) for kind in ("views", "enums", "routines")),
        F.lit("\n## Table Index\n"),
    ])
    parts = [fr.whole(counts, intro)]

    number = F
    for i, (bucket, _) in enumerate(BUCKETS):
        number = number.when(F.col("bucket") == bucket, 10 + i)
    bucketed = overview.table_buckets(m.flags).select(
        "db_id", path.alias("path"), number.alias("section"), F.lit("").alias("k1"), F.lit(0.0).alias("ord"),
        _pair("schema_name", "table_name").alias("k2"), text("`", F.col("table_name"), "`").alias("value"),
    )
    heading = F
    for i, (_, title) in enumerate(BUCKETS):
        heading = heading.when(F.col("section") == 10 + i, title)
    parts.append(fr.run_of_values(bucketed, ", ", F.concat(F.lit("\n"), heading), F.lit("\n")))

    related = overview.has_relationships(m.flags).where("has_relationships").withColumn("path", path)
    parts.append(fr.whole(related, F.lit("## Key Entry Points\n\nStart exploring from these highly-connected tables:\n"), 20))
    points = overview.entry_points(m.flags).withColumn("path", path)
    arrow = text("\n- `", F.col("table_name"), "` ← referenced by ", F.col("fk_in").cast("string"), " tables")
    parts.append(points.select(*fr.fragment(arrow, 21, order=F.col("position"))))
    parts.append(related.select(*fr.fragment(F.lit("\n"), 22)))

    with_enums = counts.where("n_enums > 0")
    parts.append(fr.whole(with_enums, F.lit("## Enum Quick Reference\n"), 30))
    run = [F.lit(31).alias("section"), _pair("schema_name", "enum_name").alias("k1")]
    enums = m["enums"].select("db_id", path.alias("path"), *run, "enum_name")
    labels = m["enum_labels"].where("label IS NOT NULL").select(
        "db_id", path.alias("path"), *run, F.col("sort_order").alias("ord"), F.col("label").alias("k2"), F.col("label").alias("value")
    )
    parts.append(fr.run_of_values(labels, "`, `", text("\n- **", F.col("enum_name"), "**: `"), F.lit("`"), groups=enums))
    parts.append(with_enums.select(*fr.fragment(F.lit("\n"), 32)))
    parts.append(counts.select(*fr.fragment(F.lit("\n"), 40)))
    return fr.union(parts)


# Document kinds and the frames each needs beyond the always present ones.
KINDS = {
    "overview": (doc_overview, ()),
    "manifest": (doc_manifest, ()),
    "index": (doc_index, ()),
    "relationships": (doc_graph, ()),
    "domains": (doc_domains, ()),
    "structure": (doc_structure, ()),
    "columns": (doc_columns, ()),
    "indexes": (doc_indexes, ()),
    "constraints": (doc_constraints, ()),
    "relations": (doc_relations, ()),
    "triggers": (doc_triggers, ()),
    "comments": (doc_comments, ()),
    "stats": (doc_stats, ("stats", "column_stats")),
    "view_definition": (doc_view_definition, ("views",)),
    "view_columns": (doc_view_columns, ("views", "view_columns")),
    "view_dependencies": (doc_view_dependencies, ("views", "view_dependencies")),
    "view_comments": (doc_view_comments, ("views", "view_columns")),
    "routines": (doc_routines, ("routines",)),
    "enums": (doc_enums, ()),
    "sequences": (doc_sequences, ()),
    "types": (doc_types, ()),
}


def snapshot_fragments(frames: Mapping[str, DataFrame], cfg: SnapshotConfig) -> LazyFrames:
    """Fragments of every kind of document the snapshot's frames allow.

    Give it written frames: most are read by several kinds.
    """
    model = Model(frames, cfg, settled=True)
    return LazyFrames(
        {kind: (lambda build=build: build(model)) for kind, (build, needs) in KINDS.items() if all(n in frames for n in needs)}
    )
