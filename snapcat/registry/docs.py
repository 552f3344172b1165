"""Registered queries on documents: groups G, H (lists and objects) and I.

Each query gives the fragments of one kind of document for the whole fleet,
without the numeric order column. ``catalog_docs`` runs everything from the raw
relations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.functions import toon
from snapcat.operators import overview
from snapcat.plans import artifacts as art
from snapcat.plans import files
from snapcat.plans import fragments as fr
from snapcat.plans import sink
from snapcat.plans.artifacts import Model, snapshot_fragments
from snapcat.plans.row_stats import ENUM_VALUES, TOP_VALUES, row_frames, with_row_facts
from snapcat.plans.snapshot import SnapshotConfig, snapshot
from snapcat.registry import catalog as cat
from snapcat.registry import facts
from snapcat.registry.facts import _sql
from snapcat.registry.rows import TABLES, _number, _quoted, _shown, read
from snapcat.session import settle, shared_folder
from snapcat.sources.fleet import SCHEMAS, fleet_normal, fleet_raw
from snapcat.sources.lazy import LazyFrames
from snapcat.sources.parquet import catalog_frames, parquet_tables

COMPUTED_AT = cat.COMPUTED_AT
COLS = ["db_id", "path", "section", "k1", "k2", "text"]


def model(spark: SparkSession, sf_dir: str, cfg: SnapshotConfig = cat.FULL) -> Model:
    """Normalised tables of the fleet; the other frames come out of the raw relations."""
    return Model(snapshot(fleet_raw(spark, sf_dir), cfg).replaced(**fleet_normal(spark, sf_dir)), cfg)


def doc_query(kind: str):
    build, _ = art.KINDS[kind]
    return lambda spark, sf: build(model(spark, sf)).select(*COLS)


#: Kinds of documents whose order is checked, too: labels, lists by type, positions of columns, runs and buckets.
ORDERED = ("constraints", "enums", "index", "overview", "relations", "relationships")


def ordered_query(kind: str):
    """Documents of a kind, every piece of text at its place."""
    build, _ = art.KINDS[kind]
    return lambda spark, sf: fr.with_positions(build(model(spark, sf))).select("db_id", "path", "position", "text")


def redacted_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment documents of a run that redacts comments: only the semantics remain."""
    cfg = SnapshotConfig(schemas=SCHEMAS, redact_comments=True, redact_definitions=True)
    normal = fleet_normal(spark, sf_dir)
    frames = snapshot(fleet_raw(spark, sf_dir), cfg).replaced(
        tables=normal["tables"].withColumn("comment", F.lit("")),
        columns=normal["columns"].withColumn("comment", F.lit(None).cast("string")),
    )
    return art.doc_comments(Model(frames, cfg)).select(*COLS)


def doc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model(spark, sf_dir).table_docs("structure")


def schema_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema list text from the schemas each database has."""
    held = fleet_normal(spark, sf_dir)["tables"].groupBy("db_id").agg(
        F.sort_array(F.collect_set("schema_name")).alias("schemas")
    )
    return held.select("db_id", overview.schema_list(F.col("schemas")).alias("schema_list"))


def number_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as an object document: nested member, omitted NULLs."""
    df = read(spark, sf_dir, "orders").withColumn("o_priority", F.expr("nullif(o_orderpriority, '5-LOW')"))
    inner = (toon.Field("o_orderstatus"), toon.Field("o_priority", omit="null"))
    body = toon.lines([
        toon.Field("o_orderkey", "integer").line(toon.Members()),
        toon.Field("o_totalprice", "double").line(toon.Members()),
        toon.nested_object("state", toon.object_lines(toon.Members(), inner, 1)),
    ])
    return df.select("o_orderkey", body.alias("doc"))


EVENT = (toon.Field("event_type"), toon.Field("value", "double", "null"), toon.Field("props", omit="null"))
EVENT_LISTS = {"props": "nullif(props, '{\"k\": 1}')", "value": "CASE WHEN user_id % 2 = 0 THEN value END"}


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of every user as elements of a list."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("db_id"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"),
        F.lit(0).alias("section"),
        F.lit("events").alias("list_name"),
        F.lit("").alias("k1"),
        F.col("event_id").cast("double").alias("ord"),
        F.col("event_id").cast("string").alias("k2"),
        "event_type",
        *(F.expr(e).alias(n) for n, e in EVENT_LISTS.items()),
    )


def event_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list of events per user: table form where all events of a user have the same members."""
    return fr.object_list(user_events(spark, sf_dir), EVENT).select(*COLS)


TURN = (toon.Field("turn", "integer"), toon.Field("text"), toon.Field("long", "bool", "false"))
#: The lists of a conversation: all turns, and those of each role.
TURN_LISTS = ("turns", "user", "assistant", "system")


def mixed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lists of their turns: users' turns are objects, others the lines of the text, or the text where it has one."""
    lines = F.split("text", "\n")
    several = (F.col("role") != "user") & (F.size(lines) > 1)
    rows = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("db_id"),
        F.concat(F.lit("conversation/"), F.col("conv_id").cast("string")).alias("path"),
        F.explode(F.array(F.lit("turns"), F.col("role"))).alias("list_name"),
        F.lit("").alias("k1"),
        F.col("turn").cast("double").alias("ord"),
        F.col("turn").cast("string").alias("k2"),
        F.when(F.col("role") == "user", "object").when(several, "list").otherwise("scalar").alias("element"),
        toon.scalar_text(F.col("text"), "string").alias("scalar"),
        F.transform(lines, toon.quoted).alias("items"),
        "turn",
        "text",
        (F.length("text") > 400).alias("long"),
    )
    section = F.array_position(F.array(*map(F.lit, TURN_LISTS)), F.col("list_name")).cast("int")
    return fr.mixed_list(rows.withColumn("section", section), TURN).select(*COLS)


def docs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per type of event: fragments written, assembled to text, written, and read back whole."""
    rows = read(spark, sf_dir, "events").select(
        F.lit(0).cast("bigint").alias("db_id"),
        F.concat(F.lit("type/"), F.col("event_type")).alias("path"),
        F.lit(0).alias("section"),
        F.lit("events").alias("list_name"),
        F.lit("").alias("k1"),
        F.col("event_id").cast("double").alias("ord"),
        F.col("event_id").cast("string").alias("k2"),
        "event_type",
        *(F.expr(e).alias(n) for n, e in EVENT_LISTS.items()),
    )
    root = f"{shared_folder(spark)}/docs-{uuid.uuid4().hex}"
    sink.write_fragments({"events": fr.object_list(rows, EVENT)}, f"{root}/fragments")
    sink.write_docs(spark, f"{root}/fragments", f"{root}/docs")
    return spark.read.parquet(f"{root}/docs")


def docs_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file per user, at its path below the shared folder, read back."""
    places = fr.object_list(user_events(spark, sf_dir), EVENT)
    root = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    files.write_files(fr.assemble(places), root)
    return files.read_files(root, spark)


#: Tables whose documents are made from their rows.
ROW_TABLES = ("orders", "lineitem", "events", "conversations")


def row_model(spark: SparkSession, sf_dir: str) -> Model:
    tables = parquet_tables(spark, sf_dir, list(ROW_TABLES))
    return Model(with_row_facts(catalog_frames(tables), row_frames(tables, COMPUTED_AT)), SnapshotConfig(schemas=("public",), include_stats=True))


def catalog_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full run from the raw relations: fragments and characters per database and kind.

    Every frame is settled, as ``sink.generate`` writes them, and the sizes
    of each kind are settled on their own: one plan for all kinds would hold
    hundreds of joins.
    """
    planned = snapshot(fleet_raw(spark, sf_dir), cat.FULL)
    frames = LazyFrames({name: (lambda name=name: settle(planned[name])) for name in planned})
    sizes = [
        settle(
            frame.groupBy("db_id")
            .agg(F.count("*").alias("fragment_count"), F.sum(F.length("text")).alias("characters"))
            .select("db_id", F.lit(kind).alias("kind"), "fragment_count", "characters")
        )
        for kind, frame in snapshot_fragments(frames, cat.FULL).items()
    ]
    return fr.union(sizes)


QUERIES = {
    **{f"doc_{kind}": doc_query(kind) for kind in art.KINDS},
    "doc_comments_redacted": redacted_comments,
    "doc_paths": doc_paths,
    "schema_list": schema_lists,
    "toon_object": number_objects,
    "toon_table": event_lists,
    "toon_mixed": mixed_lists,
    **{f"ordered_{kind}": ordered_query(kind) for kind in ORDERED},
    "docs_files": docs_files,
    "doc_stats_rows": lambda spark, sf: art.doc_stats(row_model(spark, sf)).select(*COLS),
    "doc_comments_rows": lambda spark, sf: art.doc_comments(row_model(spark, sf)).select(*COLS),
    "docs_text": docs_text,
    "catalog_docs": catalog_docs,
}


# --- oracles -----------------------------------------------------------------

NL = "chr(10)"
#: Places of what begins and ends a list.
FIRST, LAST = "CAST('-inf' AS DOUBLE)", "CAST('inf' AS DOUBLE)"


def _value(f: toon.Field) -> str:
    return f'"{f.source or f.name}"'


def _present(f: toon.Field) -> str:
    v = _value(f)
    if f.omit == "never":
        return "true"
    if f.omit == "null":
        return f"{v} IS NOT NULL"
    if f.omit == "false":
        return f"coalesce({v}, false)"
    return f"coalesce(len({v}) > 0, false)" if f.kind == "strings" else f"coalesce({v} <> '', false)"


def _list(v: str) -> str:
    return (f"'[' || len({v}) || ']:' || CASE WHEN len({v}) > 0 THEN ' ' || array_to_string(list_transform({v}, "
            f"lambda e: {_quoted('e')}), ',') ELSE '' END")


def _text(f: toon.Field) -> str:
    v = _value(f)
    if f.kind == "strings":
        return _list(f"coalesce({v}, CAST([] AS VARCHAR[]))")
    if f.kind == "double":
        return _number(v)
    if f.kind == "string":
        return f"coalesce({_quoted(v)}, 'null')"
    return f"coalesce(CAST({v} AS VARCHAR), 'null')"


def _line(f: toon.Field, pad: str = "") -> str:
    gap = ":" if f.kind == "strings" else ": "
    return f"CASE WHEN {_present(f)} THEN '{pad}{f.name}{gap}' || {_text(f)} END"


def _ws(sep: str, parts) -> str:
    return f"concat_ws({sep}, {', '.join(parts)})"


def _lines(fields, pad: str = "") -> str:
    return _ws(NL, [_line(f, pad) for f in fields])


def _dash(fields) -> str:
    return f"'  - ' || {NL} || {_lines(fields, '    ')}"


def _list_sql(rows: str, fields, docs: str | None = None) -> str:
    """Heads and rows; ``rows`` selects GROUP, k1, k2 and the members."""
    mask = " + ".join(f"CASE WHEN {_present(f)} THEN {1 << i} ELSE 0 END" for i, f in enumerate(fields))
    nested = " OR ".join(["false", *(f"({_present(f)})" for f in fields if f.kind == "strings")])
    row = _ws("','", [f"CASE WHEN {_present(f)} THEN {_text(f)} END" for f in fields if f.kind != "strings"] or ["''"])
    names = _ws("','", [f"CASE WHEN low & {1 << i} > 0 THEN '{f.name}' END" for i, f in enumerate(fields)])
    group = "db_id, path, section, list_name"
    source = f"({docs}) d LEFT JOIN facts USING ({group})" if docs else "facts"
    return f"""(WITH shaped AS MATERIALIZED (SELECT {group}, k1, CAST(ord AS DOUBLE) AS ord, k2, {mask} AS mask, {nested} AS nested, {row} AS row_text,
      {_dash(fields)} AS dash_text FROM ({rows})),
    facts AS MATERIALIZED (SELECT {group}, count(*) AS n, min(mask) AS low, min(mask) = max(mask) AND min(mask) > 0 AND NOT bool_or(nested) AS tabular
      FROM shaped GROUP BY ALL)
    SELECT db_id, path, section, '' AS k1, {FIRST} AS ord, '' AS k2, {NL} || list_name || ':' || CASE WHEN tabular THEN '[' || n || ']{{' || {names} || '}}:'
      ELSE '[' || coalesce(n, 0) || ']:' END AS text FROM {source}
    UNION ALL SELECT db_id, path, section, k1, ord, k2, {NL} || CASE WHEN tabular THEN '  ' || row_text ELSE dash_text END
      FROM shaped JOIN facts USING ({group}))"""


def _run_sql(rows: str, separator: str, head: str, tail: str | None = None, groups: str | None = None) -> str:
    """``rows`` selects RUN, ord, k2 and value."""
    run = "db_id, path, section, k1"
    source = f"({groups}) g LEFT JOIN facts USING ({run})" if groups else "facts"
    out = f"""(WITH placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {run} ORDER BY ord, k2) AS place FROM ({rows})),
    facts AS MATERIALIZED (SELECT {run}, count(*) AS c FROM placed GROUP BY ALL)
    SELECT db_id, path, section, k1, {FIRST} AS ord, '' AS k2, {head} AS text FROM (SELECT *, coalesce(c, 0) AS n FROM {source})
    UNION ALL SELECT {run}, CAST(ord AS DOUBLE), k2, CASE WHEN place = 1 THEN '' ELSE '{separator}' END || value FROM placed"""
    if tail:
        out += f" UNION ALL SELECT db_id, path, section, k1, {LAST}, '', {tail} FROM (SELECT *, coalesce(c, 0) AS n FROM {source})"
    return out + ")"


def _whole(body: str, source: str, section: int = 0) -> str:
    return (f"SELECT db_id, path, {section} AS section, '' AS k1, CAST(0 AS DOUBLE) AS ord, '' AS k2, {NL} || body AS text FROM "
            f"(SELECT *, {body} AS body FROM ({source})) WHERE body IS NOT NULL")


def _safe_sql(source: str, name: str, identity: str, within: str = "") -> str:
    safe = f"coalesce({facts._SAFE.format(name)}, 'unnamed')"
    return f"""SELECT * EXCLUDE (safe0), CASE WHEN row_number() OVER (PARTITION BY db_id, schema_name{within}, safe0
      ORDER BY {name} <> safe0, {identity}) = 1 THEN safe0 ELSE safe0 || '__' || lower(hex({identity})) END AS safe
      FROM (SELECT *, {safe} AS safe0 FROM ({source}))"""


DIRS = "dirs AS MATERIALIZED (" + _safe_sql("SELECT db_id, schema_name, table_name FROM f_tables", "table_name", "table_name") + ")"
VIEW_DIRS = "view_dirs AS MATERIALIZED (" + _safe_sql(f"SELECT db_id, schema_name, table_name FROM ({cat.VIEWS})", "table_name", "table_name") + ")"
KEYS = "db_id, schema_name, table_name"


def _tdoc(kind: str) -> str:
    return f"(SELECT {KEYS}, db_id || '/' || schema_name || '/tables/' || safe || '/table.{kind}.toon' AS path FROM dirs)"


def _vdoc(kind: str) -> str:
    return f"(SELECT {KEYS}, db_id || '/' || schema_name || '/views/' || safe || '/view.{kind}.toon' AS path FROM view_dirs)"


def _heads(docs: str, section: int, name: str) -> str:
    return f"SELECT db_id, path, {section} AS section, '{name}' AS list_name FROM {docs}"


def _place(section: int, name: str, k1: str, k2: str, order: str = "0") -> str:
    return f"{section} AS section, '{name}' AS list_name, {k1} AS k1, {order} AS ord, {k2} AS k2"


def _columns_sql(docs: str, columns: str) -> str:
    shaped = _list_sql(
        f"SELECT c.*, path, {_place(0, 'columns', chr(39) * 2, chr(39) * 2, 'ordinal_position')} FROM ({columns}) c JOIN {docs} USING ({KEYS})",
        art.COLUMN, _heads(docs, 0, "columns"))
    # The list is gathered in one fragment.
    return f"""SELECT db_id, path, 0 AS section, '' AS k1, CAST(0 AS DOUBLE) AS ord, '' AS k2, string_agg(text, '' ORDER BY ord) AS text
        FROM {shaped} GROUP BY db_id, path"""


def _quoted_list(test: str, column: str, order: str) -> str:
    return f"list({column} ORDER BY {order}) FILTER (WHERE {test})"


def _comment_map(name: str, lines: str) -> str:
    return f"CASE WHEN len({lines}) > 0 THEN '{name}:' || {NL} || array_to_string({lines}, {NL}) END"


KEY_TEXT = f"CASE WHEN regexp_matches(column_name, '^[A-Za-z_][A-Za-z0-9_.]*$') THEN column_name ELSE {_quoted('column_name')} END"
COMMENT_LINE = f"'  ' || {KEY_TEXT} || ': ' || {_quoted('comment')}"


def _comments_sql(comments: bool) -> str:
    lists = ", ".join(
        f"{_quoted_list(facts.SEM[k], 'column_name', 'ordinal_position')} AS {name}"
        for k, name in (("status", "status_columns"), ("timestamp", "timestamp_columns"), ("currency", "currency_amount_columns"),
                        ("id", "id_columns"))
    )
    semantic = _ws(NL, [
        f"CASE WHEN len({n}) > 0 THEN '  {n}:' || {_list(n)} END"
        for n in ("status_columns", "timestamp_columns", "currency_amount_columns", "id_columns")
    ])
    shown = "coalesce(comment, '') <> ''" if comments else "false"
    body = _ws(NL, [
        _line(toon.Field("table_comment", omit="empty", source="comment")) if comments else "NULL",
        _comment_map("column_comments", "comments"),
        f"CASE WHEN {semantic} <> '' THEN 'inferred_semantics:' || {NL} || {semantic} END",
    ])
    return _whole(body, f"""SELECT * FROM f_tables JOIN {_tdoc('comments')} USING ({KEYS}) LEFT JOIN (SELECT {KEYS},
      {_quoted_list(shown, COMMENT_LINE, 'column_name')} AS comments, {lists} FROM f_columns GROUP BY ALL) USING ({KEYS})""")


def _object_sql(source: str, name: str, folder: str) -> str:
    return f"SELECT *, db_id || '/' || schema_name || '/{folder}/' || safe || '.toon' AS path FROM ({_safe_sql(source, name, name)})"


N_COUNTS = f"""n_counts AS (SELECT d.db_id, datname AS name, 'postgresql' AS engine, version,
  (SELECT count(*) FROM f_tables t WHERE t.db_id = d.db_id) AS n_tables,
  (SELECT count(*) FROM ({cat.VIEWS}) t WHERE t.db_id = d.db_id) AS n_views,
  (SELECT count(*) FROM ({cat.ROUTINES}) t WHERE t.db_id = d.db_id) AS n_routines,
  (SELECT count(DISTINCT (schema_name, enum_name)) FROM ({cat.ENUMS}) t WHERE t.db_id = d.db_id) AS n_enums,
  (SELECT count(*) FROM ({cat.SEQUENCES}) t WHERE t.db_id = d.db_id) AS n_sequences,
  (SELECT count(*) FROM ({cat.TYPES}) t WHERE t.db_id = d.db_id) AS n_types FROM pg_database d)"""
RAW_ALL = tuple(dict.fromkeys([
    r for part in ("cat_views", "cat_routines", "cat_enums", "cat_sequences", "cat_types", "database_meta")
    for r in cat.PARTS[part][1] if "(" not in r
]))
COUNT_NEEDS = ("f_tables", *RAW_ALL, cat.CLASSES, cat.OWNERS, cat.ATTRIBUTES, cat.DOMAINS, N_COUNTS)
SEP = "chr(31)"


def _dbdoc(name: str) -> str:
    return f"(SELECT db_id, db_id || '/{name}' AS path FROM pg_database)"


def _manifest_sql() -> str:
    enabled = _ws(NL, ["'  tables: true'", *(f"'  {k}: ' || CAST(n_{k} > 0 AS VARCHAR)" for k in art.COUNTED[1:]), "'  stats: true'"])
    body = _ws(NL, [
        f"'generation_timestamp: \"{COMPUTED_AT}\"'", "'database_engine: postgresql'",
        _line(toon.Field("database_version", source="version")), _line(toon.Field("database_name", source="name")),
        "'included_schemas:[2]: public,app'", "'included_tables_count: ' || n_tables",
        f"'enabled_artifacts:' || {NL} || {enabled}", "'stats_enabled: true'", "'usage_enabled: false'"])
    return _whole(body, "SELECT *, db_id || '/manifest.toon' AS path FROM n_counts")


def _overview_sql() -> str:
    def lit(text: str) -> str:
        return "'" + text.replace("\n", "' || chr(10) || '") + "'"

    guide = [
        f"CASE WHEN n_{kind} > 0 THEN {lit(f'| {task} | `{file}` |')} END" if kind else lit(f"| {task} | `{file}` |")
        for task, file, kind in art.GUIDE
    ]
    body = _ws(NL, [
        "'# ' || name || ' Schema Reference' || chr(10)",
        "'This directory contains complete schema documentation for ' || name || ' (' || engine || ' ' || version || ').' || chr(10)",
        lit("## Finding What You Need\n\n| Task | File to Read |\n|------|-------------|"), *guide,
        lit("\n## At a Glance\n"), "'- **' || n_tables || ' tables** across 2 schemas (public, app)'",
        *(f"CASE WHEN n_{k} > 0 THEN '- **' || n_{k} || ' {k}**' END" for k in ("views", "enums", "routines")),
        lit("\n## Table Index\n")])
    source = "SELECT *, db_id || '/llms.txt' AS path FROM n_counts"
    section = "CASE WHEN core THEN 10 WHEN junction THEN 12 WHEN lookup THEN 13 ELSE 11 END"
    heading = "CASE section " + " ".join(f"WHEN {10 + i} THEN {lit(t)}" for i, (_, t) in enumerate(art.BUCKETS)) + " END"
    buckets = f"""SELECT db_id, db_id || '/llms.txt' AS path, {section} AS section, '' AS k1, 0 AS ord,
      schema_name || {SEP} || table_name AS k2, '`' || table_name || '`' AS value FROM flags"""
    related = "SELECT db_id, db_id || '/llms.txt' AS path FROM counts GROUP BY db_id HAVING bool_or(fk_in > 0 OR fk_out > 0)"
    plain = "SELECT db_id, path, {} AS section, '' AS k1, CAST(0 AS DOUBLE) AS ord, '' AS k2, chr(10) AS text FROM ({})"
    points = f"""SELECT db_id, db_id || '/llms.txt' AS path, 21 AS section, '' AS k1, CAST(position AS DOUBLE) AS ord, '' AS k2, {NL} || '- `' || table_name ||
      '` ← referenced by ' || fk_in || ' tables' AS text FROM (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY fk_in DESC,
      schema_name, table_name) AS position FROM counts WHERE fk_in >= 2) WHERE position <= 5"""
    enum_run = f"db_id, db_id || '/llms.txt' AS path, 31 AS section, schema_name || {SEP} || enum_name AS k1"
    labels = f"SELECT {enum_run}, sort_order AS ord, label AS k2, label AS value FROM ({cat.ENUMS}) WHERE label IS NOT NULL"
    enums = f"SELECT DISTINCT {enum_run}, enum_name FROM ({cat.ENUMS})"
    with_enums = f"SELECT * FROM ({source}) WHERE n_enums > 0"
    return " UNION ALL ".join([
        _whole(body, source), "SELECT * FROM " + _run_sql(buckets, ", ", f"{NL} || {heading}", NL),
        _whole(lit("## Key Entry Points\n\nStart exploring from these highly-connected tables:\n"), related, 20),
        points, plain.format(22, related), _whole(lit("## Enum Quick Reference\n"), with_enums, 30),
        "SELECT * FROM " + _run_sql(labels, "`, `", f"{NL} || '- **' || enum_name || '**: `'", "'`'", enums),
        plain.format(32, with_enums), plain.format(40, source)])


HEAD = "'[' || n || ']:' || CASE WHEN n > 0 THEN ' ' ELSE '' END"


def _doc_parts() -> dict[str, tuple[str, tuple[str, ...]]]:
    t = ("f_tables", DIRS)
    named = f"SELECT * FROM f_constraints JOIN {_tdoc('constraints')} USING ({KEYS})"
    kind = "CASE constraint_type WHEN 'UNIQUE' THEN {} WHEN 'CHECK' THEN {} ELSE {} END"
    sections = kind.format(*(n for n, _ in art.CONSTRAINT_LISTS.values()))
    list_names = kind.format(*(f"'{n}'" for _, n in art.CONSTRAINT_LISTS.values()))
    pk = f"""CASE WHEN pk_columns IS NOT NULL THEN 'primary_key:' || {NL} || {_lines(art.PRIMARY_KEY, '  ')} END"""
    cards = f"""SELECT c.*, EXISTS (SELECT 1 FROM f_columns k WHERE k.db_id = c.db_id AND k.schema_name = c.from_schema
      AND k.table_name = c.from_table AND k.nullable AND list_contains(c.from_columns, k.column_name)) AS nullable FROM cards c"""
    view_needs = (*cat.BASE[:2], cat.CLASSES, "info_views", "pg_description", VIEW_DIRS)
    commented = (*cat.BASE, "pg_description", "pg_attribute", "info_columns", cat.COMMENTED, "info_views", VIEW_DIRS)
    view_cols = f"SELECT c.* FROM commented c SEMI JOIN view_dirs USING ({KEYS})"
    enum_docs = _object_sql(f"SELECT DISTINCT db_id, schema_name, enum_name, comment FROM ({cat.ENUMS})", "enum_name", "enums")
    enum_rows = f"""SELECT db_id, path, 1 AS section, '' AS k1, sort_order AS ord, label AS k2, {_quoted('label')} AS value
      FROM (SELECT e.*, path FROM ({cat.ENUMS}) e JOIN ({enum_docs}) USING (db_id, schema_name, enum_name)) WHERE label IS NOT NULL"""
    attributes = """CASE WHEN attributes IS NOT NULL THEN 'attributes:[' || (length(attributes) - length(replace(attributes, ':', ''))) ||
      ']{name,data_type}:' || chr(10) || '  ' || replace(replace(attributes, ',', chr(10) || '  '), ':', ',') END"""
    routine_rows = _safe_sql(
        f"SELECT *, CASE routine_type WHEN 'procedure' THEN 'procedures' ELSE 'functions' END AS folder FROM ({cat.ROUTINES})",
        "routine_name", "routine_oid", ", folder")
    return {
        "structure": (_whole(_ws(NL, [*(_line(f) for f in art.STRUCTURE), pk, _line(toon.Field("row_count_estimate", "integer", "null"))]),
                             f"SELECT * FROM f_tables JOIN {_tdoc('structure')} USING ({KEYS}) LEFT JOIN j_pk USING ({KEYS})"),
                      (*facts.JUNCTIONS, DIRS)),
        "columns": (_columns_sql(_tdoc("columns"), "SELECT * FROM f_columns"), ("f_tables", "f_columns", DIRS)),
        "indexes": (f"SELECT * FROM " + _list_sql(
            f"SELECT i.*, path, {_place(0, 'indexes', chr(39) * 2, 'index_name')} FROM f_indexes i JOIN {_tdoc('indexes')} USING ({KEYS})",
            art.INDEX, _heads(_tdoc("indexes"), 0, "indexes")), ("f_tables", "f_indexes", DIRS)),
        "constraints": (" UNION ALL ".join([
            _whole(f"'primary_key:' || {NL} || {_lines(art.CONSTRAINT, '  ')}", f"{named} WHERE constraint_type = 'PRIMARY KEY'"),
            "SELECT * FROM " + _list_sql(f"SELECT *, {sections} AS section, {list_names} AS list_name, '' AS k1, 0 AS ord, constraint_name AS k2 "
                                         f"FROM ({named}) WHERE constraint_type <> 'PRIMARY KEY'", art.CONSTRAINT),
            "SELECT * FROM " + _list_sql(
                f"""SELECT db_id, path, {_place(40, 'not_null_constraints', chr(39) * 2, chr(39) * 2, 'ordinal_position')}, column_name || '_not_null' AS constraint_name,
                'NOT NULL' AS constraint_type, [column_name] AS columns FROM f_columns JOIN {_tdoc('constraints')} USING ({KEYS})
                WHERE NOT nullable""", art.NOT_NULL)]), ("f_tables", "f_columns", "f_constraints", DIRS)),
        "relations": (" UNION ALL ".join([
            "SELECT * FROM " + _list_sql(
                f"""SELECT c.*, path, {_place(0, 'outgoing_foreign_keys', chr(39) * 2, 'constraint_name')} FROM ({cards}) c
                JOIN {_tdoc('relations')} d ON d.db_id = c.db_id AND d.schema_name = from_schema AND d.table_name = from_table""",
                art.OUTGOING, _heads(_tdoc("relations"), 0, "outgoing_foreign_keys")),
            "SELECT * FROM " + _list_sql(
                f"""SELECT c.*, path, {_place(10, 'incoming_foreign_keys', 'from_schema', f'from_table || {SEP} || constraint_name')} FROM cards c
                JOIN {_tdoc('relations')} d ON d.db_id = c.db_id AND d.schema_name = to_schema AND d.table_name = to_table""",
                art.INCOMING, _heads(_tdoc("relations"), 10, "incoming_foreign_keys")),
            _whole(f"'junction_table_detection:' || {NL} || {_lines(art.JUNCTION, '  ')}",
                   f"SELECT * FROM junctions JOIN {_tdoc('relations')} USING ({KEYS})", 20)]), (*facts.CARDS, DIRS)),
        "triggers": ("SELECT * FROM " + _list_sql(
            f"""SELECT g.* EXCLUDE (events), string_split(events, ',') AS events, path, {_place(0, 'triggers', chr(39) * 2, 'trigger_name')}
            FROM ({cat.TRIGGERS}) g JOIN {_tdoc('triggers')} USING ({KEYS})""", art.TRIGGER, _heads(_tdoc("triggers"), 0, "triggers")),
            (*cat.BASE, "pg_trigger", "pg_proc", *t)),
        "comments": (_comments_sql(True), ("f_tables", "f_columns", DIRS)),
        "stats": (_whole(_ws(NL, [
            f"'computed_at: \"{COMPUTED_AT}\"'", "'sampling_strategy: estimate'", _line(toon.Field("row_count_estimate", "integer", "null")),
            _comment_map("per_column_stats", "entries"), _line(toon.Field("note"))]),
            f"""SELECT * FROM ({cat.TABLE_STATS}) JOIN {_tdoc('stats')} USING ({KEYS}) LEFT JOIN (SELECT {KEYS},
            list('  ' || {KEY_TEXT} || ':' || {NL} || {_lines(art.COLUMN_STAT, '    ')} ORDER BY column_name) AS entries
            FROM ({cat.STATS}) GROUP BY ALL) USING ({KEYS})"""), (*cat.BASE, "pg_stats", *t)),
        "view_definition": (_whole(_lines(art.VIEW), f"SELECT * FROM ({cat.VIEWS}) JOIN {_vdoc('definition')} USING ({KEYS})"), view_needs),
        "view_columns": (_columns_sql(_vdoc("columns"), view_cols), commented),
        "view_dependencies": (" UNION ALL ".join([
            f"SELECT db_id, path, 0 AS section, '' AS k1, CAST(0 AS DOUBLE) AS ord, '' AS k2, '' AS text FROM {_vdoc('dependencies')}",
            *("SELECT * FROM " + _run_sql(
                f"""SELECT db_id, path, {n} AS section, '' AS k1, 0 AS ord, dependency AS k2, {_quoted('dependency')} AS value
                FROM ({cat.VIEW_DEPS}) JOIN {_vdoc('dependencies')} USING ({KEYS}) WHERE dep_kind = '{k}'""", ",", f"{NL} || '{name}:' || {HEAD}")
              for n, k, name in ((1, "r", "depends_on_tables"), (2, "v", "depends_on_views")))]),
            (*view_needs[:-1], "pg_depend", "pg_rewrite", VIEW_DIRS)),
        "view_comments": (_whole(_ws(NL, [_line(toon.Field("view_comment", omit="empty", source="comment")), _comment_map("column_comments", "comments")]),
                                 f"""SELECT * FROM ({cat.VIEWS}) JOIN {_vdoc('comments')} USING ({KEYS}) LEFT JOIN (SELECT {KEYS},
                                 {_quoted_list("coalesce(comment, '') <> ''", COMMENT_LINE, 'column_name')} AS comments FROM ({view_cols}) GROUP BY ALL)
                                 USING ({KEYS})"""), commented),
        "routines": (_whole(_ws(NL, [
            *(_line(f) for f in art.ROUTINE),
            f"CASE WHEN arguments IS NOT NULL THEN {_arguments_sql()} END",
            _line(toon.Field("return_type", omit="empty")), _line(toon.Field("definition", omit="null"))]),
            f"SELECT *, db_id || '/' || schema_name || '/routines/' || folder || '/' || safe || '.toon' AS path FROM ({routine_rows})"),
            cat.PARTS["cat_routines"][1]),
        "enums": (" UNION ALL ".join([
            _whole(_lines(art.ENUM), enum_docs),
            "SELECT * FROM " + _run_sql(enum_rows, ",", f"{NL} || 'values:' || {HEAD}",
                                        groups=f"SELECT db_id, path, 1 AS section, '' AS k1 FROM ({enum_docs})"),
            _whole(_line(toon.Field("comment", omit="empty")), enum_docs, 2)]), cat.PARTS["cat_enums"][1]),
        "sequences": (_whole(_lines(art.SEQUENCE), _object_sql(cat.SEQUENCES, "sequence_name", "sequences")), cat.PARTS["cat_sequences"][1]),
        "types": (_whole(_ws(NL, [*(_line(f) for f in art.TYPE), attributes, _line(toon.Field("base_type", omit="empty")),
                                  _line(toon.Field("constraint", omit="null")), _line(toon.Field("comment", omit="empty"))]),
                         _object_sql(cat.TYPES, "type_name", "types")), cat.PARTS["cat_types"][1]),
        "manifest": (_manifest_sql(), COUNT_NEEDS),
        "overview": (_overview_sql(), (*COUNT_NEEDS[:1], *facts.JUNCTIONS[1:-1], *COUNT_NEEDS[1:], facts.JUNCTION_CTE, facts.COUNTS_CTE, facts.FLAGS_CTE)),
        "index": (" UNION ALL ".join([
            "SELECT * FROM " + _list_sql(
                f"""SELECT t.db_id, t.db_id || '/db.index.toon' AS path, {_place(0, 'tables', 'schema_name', 'table_name')}, t.table_name, t.schema_name,
                CASE WHEN length(comment) > 200 THEN comment[:197] || '...' ELSE comment END AS short_description, row_count_estimate,
                pk_columns AS primary_key_columns, fk_out AS foreign_key_out_count, fk_in AS foreign_key_in_count,
                CASE WHEN tags = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(tags, ',') END AS tags
                FROM f_tables t JOIN tagged USING ({KEYS}) LEFT JOIN j_pk USING ({KEYS})""",
                art.INDEX_ENTRY, _heads(_dbdoc("db.index.toon"), 0, "tables")),
            _whole("'recommended_start_tables:' || " + _list("starts"),
                   """SELECT db_id, db_id || '/db.index.toon' AS path, list(table_name ORDER BY position) AS starts FROM (
                   SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY score DESC, schema_name, table_name) AS position FROM (
                   SELECT *, fk_in * 2 + CASE WHEN core THEN 5 ELSE 0 END - CASE WHEN junction THEN 3 ELSE 0 END
                   - CASE WHEN lookup THEN 2 ELSE 0 END AS score FROM flags) WHERE score > 0) WHERE position <= 5 GROUP BY db_id""", 1)]),
            ("pg_database", *facts.FLAGS)),
        "relationships": (" UNION ALL ".join([
            "SELECT * FROM " + _list_sql(
                f"SELECT db_id, db_id || '/db.relationships.toon' AS path, {_place(0, 'nodes', 'schema_name', 'table_name')}, table_name, schema_name FROM f_tables",
                art.NODE, _heads(_dbdoc("db.relationships.toon"), 0, "nodes")),
            "SELECT * FROM " + _list_sql(
                f"""SELECT *, db_id || '/db.relationships.toon' AS path, {_place(1, 'edges', 'constraint_name', f'from_schema || {SEP} || from_table')}
                FROM f_foreign_keys""", art.EDGE, _heads(_dbdoc("db.relationships.toon"), 1, "edges")),
            "SELECT * FROM " + _run_sql(
                f"""SELECT db_id, db_id || '/db.relationships.toon' AS path, 2 AS section, '' AS k1, 0 AS ord,
                table_name || {SEP} || schema_name AS k2, {_quoted('table_name')} AS value FROM junctions WHERE is_junction""", ",",
                f"{NL} || 'junction_table_candidates:' || {HEAD}"),
            _whole("'strongly_connected_components:[' || n || ']:'", """SELECT db_id, db_id || '/db.relationships.toon' AS path, count(DISTINCT first) AS n
                FROM member WHERE component_size >= 2 GROUP BY db_id""", 3),
            "SELECT * FROM " + _run_sql(
                f"""SELECT db_id, db_id || '/db.relationships.toon' AS path, 3 AS section, first[1] || {SEP} || first[2] AS k1, 0 AS ord,
                v[1] || {SEP} || v[2] AS k2, {_quoted('v[2]')} AS value FROM member WHERE component_size >= 2""", ",",
                f"{NL} || '  - [' || n || ']: '")]), ("pg_database", *facts.JUNCTIONS, *facts.MEMBERS)),
        "domains": (" UNION ALL ".join([
            _whole("'domains:[' || n || ']:'", """SELECT db_id, db_id || '/db.domains.toon' AS path,
                   (SELECT count(DISTINCT domain) FROM d_tables t WHERE t.db_id = d.db_id) AS n FROM pg_database d"""),
            "SELECT * FROM " + _run_sql(
                f"""SELECT db_id, db_id || '/db.domains.toon' AS path, 1 AS section, domain AS k1, 0 AS ord,
                table_name || {SEP} || schema_name AS k2, {_quoted('table_name')} AS value FROM d_tables""", ",",
                f"{NL} || '  - ' || {NL} || '    domain_name: ' || {_quoted('k1')} || {NL} || '    tables:' || {HEAD}")]),
            ("pg_database", *facts.DOMAINS)),
    }


def _arguments_sql() -> str:
    """Arguments from their ``name:type:mode`` form; a missing name is ``-``."""
    items = "string_split(arguments, ',')"
    part = "string_split(e, ':')[{}]"
    tabular = (f"CASE WHEN len(list_filter({items}, lambda e: {part.format(1)} = '-')) = 0 THEN 3 "
               f"WHEN len(list_filter({items}, lambda e: {part.format(1)} <> '-')) = 0 THEN 2 ELSE 0 END")
    row3 = f"'  ' || {part.format(1)} || ',' || {_quoted(part.format(2))} || ',' || {part.format(3)}"
    row2 = f"'  ' || {_quoted(part.format(2))} || ',' || {part.format(3)}"
    dash = (f"'  - ' || chr(10) || CASE WHEN {part.format(1)} <> '-' THEN '    name: ' || {part.format(1)} || chr(10) ELSE '' END || "
            f"'    data_type: ' || {_quoted(part.format(2))} || chr(10) || '    mode: ' || {part.format(3)}")

    def joined(expr: str) -> str:
        return f"array_to_string(list_transform({items}, lambda e: {expr}), chr(10))"

    return (f"'arguments:[' || len({items}) || ']' || CASE {tabular} WHEN 3 THEN '{{name,data_type,mode}}:' || chr(10) || {joined(row3)} "
            f"WHEN 2 THEN '{{data_type,mode}}:' || chr(10) || {joined(row2)} ELSE ':' || chr(10) || {joined(dash)} END")


def _row_stats_sql() -> str:
    """Statistics documents of ``ROW_TABLES``: one SELECT a column, put together by table."""
    columns, tables = [], []
    for table in ROW_TABLES:
        for c, kind in TABLES[table].items():
            text = lambda x, kind=kind: x if kind in ("int", "bigint", "double") else _quoted(x)
            columns.append(f"""SELECT '{table}' AS table_name, '{c}' AS column_name, CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS null_fraction,
                count(DISTINCT {c}) AS distinct_count_estimate, {text(_shown(f'min({c})', kind))} AS min_text, {text(_shown(f'max({c})', kind))} AS max_text,
                (SELECT list({text('value')} ORDER BY n DESC, value) FROM (SELECT {_shown(c, kind)} AS value, count(*) AS n FROM {table}
                    WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, value LIMIT {TOP_VALUES})) AS top_values FROM {table}""")
        tables.append(f"SELECT '{table}' AS table_name, count(*) AS row_count_estimate FROM {table}")
    lines = _ws(NL, [_line(f, "    ") for f in art.COLUMN_STAT] + ["'    min: ' || min_text", "'    max: ' || max_text", f"'    top_values:' || {_joined('top_values')}"])
    body = _ws(NL, [f"'computed_at: \"{COMPUTED_AT}\"'", "'sampling_strategy: full_scan'", _line(toon.Field("row_count_estimate", "integer", "null")), _comment_map("per_column_stats", "entries")])
    return "WITH c AS MATERIALIZED (" + " UNION ALL ".join(columns) + "), t AS (" + " UNION ALL ".join(tables) + ") " + _unplaced(_whole(
        body, f"""SELECT * FROM t JOIN (SELECT table_name, CAST(0 AS BIGINT) AS db_id, '0/public/tables/' || table_name || '/table.stats.toon' AS path,
        list('  ' || column_name || ':' || {NL} || {lines} ORDER BY column_name) AS entries FROM c GROUP BY ALL) USING (table_name)"""))


def _joined(texts: str) -> str:
    return f"'[' || len({texts}) || ']: ' || array_to_string({texts}, ',')"


def _row_comments_sql() -> str:
    """Semantics of ``ROW_TABLES``: short lists of values from the rows, the rest from names and types."""
    columns = []
    for table in ROW_TABLES:
        for k, (c, kind) in enumerate(TABLES[table].items()):
            few = f"(SELECT count(DISTINCT {c}) BETWEEN 1 AND {ENUM_VALUES} FROM {table})" if kind == "string" else "false"
            columns.append(f"SELECT '{table}' AS table_name, {k} AS ordinal_position, '{c}' AS column_name, '{kind}' AS data_type, {few} AS enum_like")
    kinds = (("status", "status"), ("timestamp", "timestamp"), ("currency", "currency_amount"), ("id", "id"))
    lists = ", ".join([f"{_quoted_list('enum_like', 'column_name', 'ordinal_position')} AS enum_like_columns",
                       *(f"{_quoted_list(facts.SEM[k], 'column_name', 'ordinal_position')} AS {name}_columns" for k, name in kinds)])
    semantic = _ws(NL, [f"CASE WHEN len({n}_columns) > 0 THEN '  {n}_columns:' || {_list(f'{n}_columns')} END" for n in ("enum_like", *(n for _, n in kinds))])
    return "WITH c AS MATERIALIZED (" + " UNION ALL ".join(columns) + ") " + _unplaced(_whole(
        f"CASE WHEN {semantic} <> '' THEN 'inferred_semantics:' || {NL} || {semantic} ELSE '' END",
        f"SELECT CAST(0 AS BIGINT) AS db_id, '0/public/tables/' || table_name || '/table.comments.toon' AS path, {lists} FROM c GROUP BY table_name"))


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) if facts.MEMBERS[0] in sql else sql


def _unplaced(body: str) -> str:
    return f"SELECT * EXCLUDE (ord) FROM ({body})"


def oracles() -> dict[str, str]:
    parts = _doc_parts()
    out = {f"doc_{kind}": _recursive(_sql(_unplaced(body), *needs)) for kind, (body, needs) in parts.items()}
    for kind in ORDERED:
        body, needs = parts[kind]
        out[f"ordered_{kind}"] = _recursive(_sql(
            f"SELECT db_id, path, row_number() OVER (PARTITION BY db_id, path ORDER BY section, k1, ord, k2, text) AS position, text FROM ({body})", *needs))
    out["doc_comments_redacted"] = _sql(_unplaced(_comments_sql(False)), "f_tables", "f_columns", DIRS)
    out["doc_paths"] = _sql(f"SELECT * FROM {_tdoc('structure')}", "f_tables", DIRS)
    out["schema_list"] = _sql(
        """SELECT db_id, CASE WHEN count(DISTINCT schema_name) = 1 THEN '`' || min(schema_name) || '` schema'
        ELSE count(DISTINCT schema_name) || ' schemas (' || string_agg(DISTINCT schema_name, ', ' ORDER BY schema_name) || ')' END AS schema_list
        FROM f_tables GROUP BY db_id""", "f_tables")
    inner = (toon.Field("o_orderstatus"), toon.Field("o_priority", omit="null"))
    body = _ws(NL, [_line(toon.Field("o_orderkey", "integer")), _line(toon.Field("o_totalprice", "double")),
                    f"'state:' || {NL} || {_lines(inner, '  ')}"])
    out["toon_object"] = f"SELECT o_orderkey, {body} AS doc FROM (SELECT *, nullif(o_orderpriority, '5-LOW') AS o_priority FROM orders)"
    out["toon_table"] = "SELECT * EXCLUDE (ord) FROM " + _list_sql(
        f"""SELECT user_id AS db_id, 'user/' || user_id AS path, {_place(0, 'events', chr(39) * 2, 'CAST(event_id AS VARCHAR)')}, event_type,
        {', '.join(f'{e} AS {n}' for n, e in EVENT_LISTS.items())} FROM events""", EVENT)
    out["doc_stats_rows"], out["doc_comments_rows"] = _row_stats_sql(), _row_comments_sql()
    by_user = _list_sql(
        f"""SELECT user_id AS db_id, 'user/' || user_id AS path, {_place(0, 'events', chr(39) * 2, 'CAST(event_id AS VARCHAR)')}, event_type,
        {', '.join(f'{e} AS {n}' for n, e in EVENT_LISTS.items())} FROM events""", EVENT)
    out["docs_files"] = f"""SELECT path, substr(string_agg(text, '' ORDER BY CASE WHEN k2 = '' THEN -1 ELSE CAST(k2 AS BIGINT) END), 2) AS doc
        FROM {by_user} GROUP BY path"""
    rows = f"""SELECT db_id, path, list_position({list(TURN_LISTS)}, list_name)::INTEGER AS section, list_name, k2, turn, text, long, element, {_quoted('text')} AS scalar
        FROM (SELECT conv_id AS db_id, 'conversation/' || conv_id AS path, unnest(['turns', role]) AS list_name, CAST(turn AS VARCHAR) AS k2, turn, text,
        length(text) > 400 AS long, CASE WHEN role = 'user' THEN 'object' WHEN contains(text, chr(10)) THEN 'list' ELSE 'scalar' END AS element FROM conversations)"""
    items = f"""'[' || len(string_split(text, chr(10))) || ']: ' || array_to_string(list_transform(string_split(text, chr(10)), lambda p: {_quoted('p')}), ',')"""
    out["toon_mixed"] = f"""WITH e AS MATERIALIZED ({rows}),
    form AS MATERIALIZED (SELECT db_id, path, section, list_name, count(*) AS n, min(turn) AS first, bool_or(long) AS long,
        CASE WHEN bool_and(element = 'scalar') THEN 'inline' WHEN bool_and(element = 'object') AND (bool_and(long) OR NOT bool_or(long)) THEN 'table'
        ELSE 'dash' END AS form FROM e GROUP BY ALL)
    SELECT db_id, path, section, '' AS k1, '' AS k2, chr(10) || list_name || ':[' || n || ']' ||
        CASE form WHEN 'inline' THEN ': ' WHEN 'table' THEN CASE WHEN long THEN '{{turn,text,long}}:' ELSE '{{turn,text}}:' END ELSE ':' END AS text FROM form
    UNION ALL SELECT e.db_id, e.path, e.section, '', k2, CASE
        WHEN form = 'inline' THEN CASE WHEN turn = first THEN '' ELSE ',' END || scalar
        WHEN form = 'table' THEN chr(10) || '  ' || turn || ',' || scalar || CASE WHEN e.long THEN ',true' ELSE '' END
        WHEN element = 'object' THEN chr(10) || '  - ' || chr(10) || '    turn: ' || turn || chr(10) || '    text: ' || scalar || CASE WHEN e.long THEN chr(10) || '    long: true' ELSE '' END
        WHEN element = 'list' THEN chr(10) || '  - ' || {items} ELSE chr(10) || '  - ' || scalar END
    FROM e JOIN form USING (db_id, path, section, list_name)"""
    by_type = _list_sql(
        f"""SELECT CAST(0 AS BIGINT) AS db_id, 'type/' || event_type AS path, {_place(0, 'events', chr(39) * 2, 'CAST(event_id AS VARCHAR)')}, event_type,
        {', '.join(f'{e} AS {n}' for n, e in EVENT_LISTS.items())} FROM events""", EVENT)
    out["docs_text"] = f"""SELECT db_id, path, CAST(part AS INTEGER) AS part, CASE WHEN part = 0 THEN substr(joined, 2) ELSE joined END AS doc FROM (
        SELECT db_id, path, (position - 1) // 1000 AS part, string_agg(text, '' ORDER BY position) AS joined FROM (
            SELECT *, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN k2 = '' THEN -1 ELSE CAST(k2 AS BIGINT) END) AS position FROM {by_type})
        GROUP BY ALL)"""
    ctes: list[str] = []
    for _, needs in parts.values():
        ctes += [n for n in needs if n not in ctes]
    rank = {c: i for i, c in enumerate(ctes)}
    ctes.sort(key=lambda x: ("(" in x, rank[x]))
    out["catalog_docs"] = _recursive(_sql(" UNION ALL ".join(
        f"SELECT db_id, '{kind}' AS kind, count(*) AS fragment_count, CAST(sum(length(text)) AS BIGINT) AS characters FROM ({body}) GROUP BY db_id"
        for kind, (body, _) in parts.items()), *ctes))
    return out
