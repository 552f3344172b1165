"""Registered queries on the raw fleet: group A."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcat.functions import codes
from snapcat.operators import catalog as c
from snapcat.plans.snapshot import SnapshotConfig, snapshot
from snapcat.registry.facts import K, _sql
from snapcat.session import settle, shared_folder
from snapcat.sources.export import read_catalog, write_catalog
from snapcat.sources.fleet import SCHEMAS, fleet_raw

COMPUTED_AT = "2024-01-01T00:00:00Z"
FULL = SnapshotConfig(
    schemas=SCHEMAS, include_views=True, include_routines=True, include_stats=True, generated_at=COMPUTED_AT
)


class Raw:
    """Raw relations and the frames most operators start from."""

    def __init__(self, relations: Mapping[str, DataFrame]):
        self.r = relations
        self.classes = c.named_classes(self.r["pg_class"], self.r["pg_namespace"])
        self.notes = self.r["pg_description"]

    def tables(self) -> DataFrame:
        return c.tables(self.r["info_tables"], self.classes, self.notes, SCHEMAS)

    def scope(self) -> DataFrame:
        # Comments are not needed to tell which tables are in scope.
        listed = self.r["info_tables"].where(F.col("table_schema").isin(*SCHEMAS) & (F.col("table_type") == "BASE TABLE"))
        return c.table_scope(listed.withColumnRenamed("table_schema", "schema_name"), c.of_tables(self.classes))

    def views(self) -> DataFrame:
        return c.views(self.r["info_views"], self.classes, self.notes, SCHEMAS)


def lists(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.array_join(n, ",") for n in names})


def cat_row_estimate(raw: Raw):
    return c.row_estimates(raw.classes, raw.tables())


def cat_column_comments(raw: Raw):
    commented = c.with_column_comments(c.columns(raw.r["info_columns"]), raw.classes, raw.r["pg_attribute"], raw.notes)
    return commented.select(*K, "column_name", "comment")


def cat_constraints(raw: Raw):
    return lists(c.constraints(raw.r["pg_constraint"], raw.scope(), raw.r["pg_attribute"]), "columns")


def cat_indexes(raw: Raw):
    out = c.indexes(raw.r["pg_index"], raw.scope(), raw.r["pg_class"], raw.r["pg_am"], raw.r["pg_attribute"])
    return lists(out, "columns", "include_columns")


def cat_foreign_keys(raw: Raw):
    return lists(c.foreign_keys(raw.r["pg_constraint"], raw.scope(), c.of_tables(raw.classes), raw.r["pg_attribute"]), "from_columns", "to_columns")


def cat_triggers(raw: Raw):
    return lists(c.triggers(raw.r["pg_trigger"], raw.scope(), raw.r["pg_proc"], raw.r["pg_namespace"]), "events")


def trigger_bits(raw: Raw):
    bits = raw.r["pg_trigger"].select("db_id", "oid", "tgtype", codes.trigger_timing(F.col("tgtype")).alias("timing"),
                                                 codes.trigger_events(F.col("tgtype")).alias("events"))
    return lists(bits, "events")


def cat_enums(raw: Raw):
    enums = c.enums(raw.r["pg_type"], raw.r["pg_namespace"], raw.notes, SCHEMAS)
    return c.enum_labels(enums, raw.r["pg_enum"])


def owners(raw: Raw) -> DataFrame:
    return c.sequence_owners(raw.r["pg_depend"], raw.r["pg_attribute"], raw.classes)


def cat_sequences(raw: Raw):
    return c.sequences(raw.r["pg_sequence"], raw.classes, raw.notes, owners(raw), SCHEMAS)


def _pairs(attributes: str):
    return F.array_join(F.transform(attributes, lambda a: F.concat_ws(":", a["name"], a["data_type"])), ",")


def type_attributes(raw: Raw):
    return c.type_attributes(raw.r["pg_attribute"], raw.r["pg_type"]).select("db_id", "oid", _pairs("attributes").alias("attributes"))


def cat_types(raw: Raw):
    types = c.types(
        raw.r["pg_type"], raw.r["pg_namespace"], raw.r["pg_class"], raw.notes,
        c.type_attributes(raw.r["pg_attribute"], raw.r["pg_type"]),
        c.domain_info(raw.r["pg_type"], raw.r["pg_constraint"]), SCHEMAS,
    )
    return types.withColumn("attributes", _pairs("attributes"))


def _arguments(col: str):
    return F.array_join(
        F.transform(col, lambda a: F.concat_ws(":", F.coalesce(a["name"], F.lit("-")), a["data_type"], a["mode"])), ","
    )


def cat_routines(raw: Raw):
    out = c.routines(raw.r["pg_proc"], raw.r["pg_namespace"], raw.r["pg_language"], raw.notes, SCHEMAS)
    return out.withColumn("arguments", _arguments("arguments"))


def routine_arguments(raw: Raw):
    procs = raw.r["pg_proc"]
    zipped = codes.routine_arguments(F.col("proargnames"), F.col("proargtypes"), F.col("proargmodes"))
    return procs.select("db_id", "oid", zipped.alias("arguments")).withColumn("arguments", _arguments("arguments"))


def view_columns(raw: Raw):
    commented = c.with_column_comments(c.columns(raw.r["info_columns"]), raw.classes, raw.r["pg_attribute"], raw.notes)
    views = raw.r["info_views"].where(F.col("table_schema").isin(*SCHEMAS)).withColumnRenamed("table_schema", "schema_name")
    return commented.join(views.select(*K), K, "left_semi").select(*K, "ordinal_position", "column_name", "data_type", "comment")


def view_dependencies(raw: Raw):
    return c.view_dependencies(raw.r["pg_depend"], raw.r["pg_rewrite"], raw.classes, raw.views())


def cat_table_stats(raw: Raw):
    tables = raw.tables()
    with_rows = tables.join(c.row_estimates(raw.classes, tables), K, "left")
    return c.table_stats(with_rows, c.column_stats(raw.r["pg_stats"]), COMPUTED_AT)


def catalog_snapshot(spark, sf):
    """Rows per database and frame of a full snapshot."""
    frames = snapshot(fleet_raw(spark, sf), FULL)
    out = None
    for name, frame in frames.items():
        rows = frame.groupBy("db_id").agg(F.count("*").alias("row_count")).select("db_id", F.lit(name).alias("frame"), "row_count")
        out = rows if out is None else out.unionByName(rows)
    return out


def snapshot_from_export(spark, sf):
    """The same from an export: relations written as Parquet, read back by schema, scoped, and snapshotted."""
    root = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    write_catalog(fleet_raw(spark, sf), root)
    frames = snapshot(read_catalog(spark, root), FULL)
    out = [settle(frame.groupBy("db_id").agg(F.count("*").alias("row_count")).select("db_id", F.lit(name).alias("frame"), "row_count")) for name, frame in frames.items()]
    return reduce(DataFrame.unionByName, out)


REDACTED = SnapshotConfig(schemas=SCHEMAS, include_views=True, include_routines=True, redact_comments=True, redact_definitions=True)


def redacted(frame: str):
    """A frame of the snapshot without the texts of definitions and comments."""
    return lambda raw: snapshot(raw.r, REDACTED)[frame]


def cat_triggers_redacted(raw: Raw):
    return lists(redacted("triggers")(raw), "events")


def cat_routines_redacted(raw: Raw):
    return redacted("routines")(raw).withColumn("arguments", _arguments("arguments"))


def _with(operator, *relations):
    """Query on raw relations alone."""
    return lambda raw: operator(*(raw.r[r] for r in relations))


ON_RAW = {
    "cat_tables": lambda raw: raw.tables(),
    "cat_row_estimate": cat_row_estimate,
    "cat_columns": _with(c.columns, "info_columns"),
    "cat_column_comments": cat_column_comments,
    "cat_constraints": cat_constraints,
    "cat_indexes": cat_indexes,
    "cat_include_columns": lambda raw: lists(
        raw.r["pg_index"].select("db_id", "indexrelid", codes.include_columns(F.col("indexdef")).alias("include_columns")),
        "include_columns",
    ),
    "cat_foreign_keys": cat_foreign_keys,
    "cat_triggers": cat_triggers,
    "trigger_bits": trigger_bits,
    "cat_enums": cat_enums,
    "cat_sequences": cat_sequences,
    "sequence_owner": owners,
    "cat_types": cat_types,
    "type_attributes": type_attributes,
    "domain_info": _with(c.domain_info, "pg_type", "pg_constraint"),
    "cat_routines": cat_routines,
    "routine_arguments": routine_arguments,
    "cat_views": lambda raw: raw.views(),
    "view_columns": view_columns,
    "view_dependencies": view_dependencies,
    "cat_column_stats": _with(c.column_stats, "pg_stats"),
    "cat_table_stats": cat_table_stats,
    "database_meta": _with(c.databases, "pg_database"),
    "cat_views_redacted": redacted("views"),
    "cat_triggers_redacted": cat_triggers_redacted,
    "cat_routines_redacted": cat_routines_redacted,
}


def on_template(query):
    return lambda spark, sf: query(Raw(fleet_raw(spark, sf)))


QUERIES = {
    **{name: on_template(query) for name, query in ON_RAW.items()},
    "catalog_snapshot": catalog_snapshot,
    "snapshot_from_export": snapshot_from_export,
}


# --- oracles -----------------------------------------------------------------

IN = "IN ('public', 'app')"
CLASSES = """classes AS MATERIALIZED (SELECT c.db_id, c.oid, n.nspname AS schema_name, c.relname AS table_name, c.relkind, c.reltuples
  FROM pg_class c JOIN pg_namespace n ON n.db_id = c.db_id AND n.oid = c.relnamespace)"""
SCOPE = f"""scope AS MATERIALIZED (SELECT db_id, oid, schema_name, table_name, reltuples FROM classes
  JOIN (SELECT db_id, table_schema AS schema_name, table_name FROM info_tables WHERE table_type = 'BASE TABLE' AND table_schema {IN}) AS t
  USING (db_id, schema_name, table_name))"""
BASE = ("pg_class", "pg_namespace", "info_tables", CLASSES, SCOPE)


def _key_cte(name: str, relation: str, key: str, rel: str, ident: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT s.db_id, s.{ident} AS id, string_agg(a.attname, ',' ORDER BY s.ord) AS names
      FROM (SELECT db_id, {ident}, {rel} AS rel, unnest({key}) AS attnum, generate_subscripts({key}, 1) AS ord FROM {relation}) s
      JOIN pg_attribute a ON a.db_id = s.db_id AND a.attrelid = s.rel AND a.attnum = s.attnum GROUP BY ALL)"""


def _note(oid: str, kind: str) -> str:
    return f"""LEFT JOIN (SELECT db_id, objoid, description FROM pg_description WHERE classoid = '{kind}' AND objsubid = 0) d
      ON d.db_id = x.db_id AND d.objoid = {oid}"""


TIMING = "CASE WHEN tgtype & 2 = 2 THEN 'before' WHEN tgtype & 64 = 64 THEN 'instead of' ELSE 'after' END"
EVENTS = """array_to_string(list_filter([CASE WHEN tgtype & 4 = 4 THEN 'insert' END, CASE WHEN tgtype & 8 = 8 THEN 'delete' END,
  CASE WHEN tgtype & 16 = 16 THEN 'update' END, CASE WHEN tgtype & 32 = 32 THEN 'truncate' END], lambda e: e IS NOT NULL), ',')"""
INCLUDE = """nullif(array_to_string(list_filter(list_transform(string_split(
  regexp_extract(regexp_extract(indexdef, '(?is)^.*? INCLUDE (.*)$', 1), '^[^()]*\\(([^)]*)\\)', 1), ','),
  lambda s: trim(s)), lambda s: s <> ''), ','), '')"""
ARGUMENTS = """CASE WHEN len(proargtypes) > 0 THEN array_to_string(list_transform(range(1, len(proargtypes) + 1), lambda i:
  coalesce(nullif(proargnames[i], ''), '-') || ':' || proargtypes[i] || ':' ||
  CASE lower(coalesce(proargmodes[i], 'i')) WHEN 'o' THEN 'OUT' WHEN 'b' THEN 'INOUT' WHEN 'v' THEN 'VARIADIC' WHEN 't' THEN 'TABLE'
  ELSE 'IN' END), ',') END"""
COLUMNS = """SELECT db_id, table_schema AS schema_name, table_name, ordinal_position, column_name, data_type, udt_name,
  is_nullable = 'YES' AS nullable, column_default AS default_value, coalesce(is_generated, 'NEVER') <> 'NEVER' AS generated,
  generation_expression, coalesce(is_identity, 'NO') = 'YES' AS is_identity, identity_generation, collation_name AS collation,
  character_maximum_length AS character_max_length, numeric_precision, numeric_scale FROM info_columns"""
COMMENTED = f"""commented AS (SELECT x.*, n.description AS comment FROM ({COLUMNS}) x LEFT JOIN (
  SELECT k.db_id, k.schema_name, k.table_name, a.attname AS column_name, d.description FROM pg_description d
  JOIN pg_attribute a ON a.db_id = d.db_id AND a.attrelid = d.objoid AND a.attnum = d.objsubid
  JOIN classes k ON k.db_id = d.db_id AND k.oid = d.objoid
  WHERE d.classoid = 'pg_class' AND d.objsubid > 0 AND d.description <> '' AND NOT a.attisdropped) n
  USING (db_id, schema_name, table_name, column_name))"""
TABLES = f"""SELECT x.db_id, x.table_schema AS schema_name, x.table_name, x.table_type, coalesce(d.description, '') AS comment
  FROM info_tables x LEFT JOIN classes k ON k.db_id = x.db_id AND k.schema_name = x.table_schema AND k.table_name = x.table_name
  {_note('k.oid', 'pg_class')} WHERE x.table_schema {IN} AND x.table_type = 'BASE TABLE'"""
CONSTRAINTS = """SELECT x.db_id, s.schema_name, s.table_name, conname AS constraint_name,
  CASE contype WHEN 'p' THEN 'PRIMARY KEY' WHEN 'u' THEN 'UNIQUE' WHEN 'c' THEN 'CHECK' ELSE 'EXCLUSION' END AS constraint_type,
  coalesce(k.names, '') AS columns, CASE WHEN contype = 'c' THEN definition END AS expression, definition
  FROM pg_constraint x JOIN scope s ON s.db_id = x.db_id AND s.oid = x.conrelid
  LEFT JOIN con_keys k ON k.db_id = x.db_id AND k.id = x.oid WHERE contype IN ('p', 'u', 'c', 'x')"""
INDEXES = f"""SELECT x.db_id, s.schema_name, s.table_name, i.relname AS index_name, indisunique AS is_unique, indisprimary AS is_primary,
  am.amname AS index_type, coalesce(k.names, '') AS columns, {INCLUDE} AS include_columns, predicate, expression, indexdef AS definition
  FROM pg_index x JOIN scope s ON s.db_id = x.db_id AND s.oid = x.indrelid JOIN pg_class i ON i.db_id = x.db_id AND i.oid = x.indexrelid
  JOIN pg_am am ON am.db_id = x.db_id AND am.oid = i.relam LEFT JOIN ind_keys k ON k.db_id = x.db_id AND k.id = x.indexrelid"""
ACTION = "CASE {0} WHEN 'a' THEN 'NO ACTION' WHEN 'r' THEN 'RESTRICT' WHEN 'c' THEN 'CASCADE' WHEN 'n' THEN 'SET NULL' WHEN 'd' THEN 'SET DEFAULT' ELSE '' END"
FKS = f"""SELECT x.db_id, conname AS constraint_name, s.schema_name AS from_schema, s.table_name AS from_table, coalesce(k.names, '') AS from_columns,
  t.schema_name AS to_schema, t.table_name AS to_table, coalesce(f.names, '') AS to_columns, {ACTION.format('confupdtype')} AS on_update,
  {ACTION.format('confdeltype')} AS on_delete FROM pg_constraint x JOIN scope s ON s.db_id = x.db_id AND s.oid = x.conrelid
  JOIN classes t ON t.db_id = x.db_id AND t.oid = x.confrelid LEFT JOIN con_keys k ON k.db_id = x.db_id AND k.id = x.oid
  LEFT JOIN ref_keys f ON f.db_id = x.db_id AND f.id = x.oid WHERE contype = 'f'"""
TRIGGERS = f"""SELECT x.db_id, s.schema_name, s.table_name, tgname AS trigger_name, {TIMING} AS timing, {EVENTS} AS events,
  CASE WHEN n.nspname IN ('public', '') THEN p.proname ELSE n.nspname || '.' || p.proname END AS function_or_procedure, x.definition
  FROM pg_trigger x JOIN scope s ON s.db_id = x.db_id AND s.oid = x.tgrelid JOIN pg_proc p ON p.db_id = x.db_id AND p.oid = x.tgfoid
  JOIN pg_namespace n ON n.db_id = x.db_id AND n.oid = p.pronamespace WHERE NOT tgisinternal"""
ENUMS = f"""SELECT x.db_id, n.nspname AS schema_name, x.typname AS enum_name, coalesce(d.description, '') AS comment,
  e.enumsortorder AS sort_order, e.enumlabel AS label FROM pg_type x JOIN pg_namespace n ON n.db_id = x.db_id AND n.oid = x.typnamespace
  LEFT JOIN pg_enum e ON e.db_id = x.db_id AND e.enumtypid = x.oid {_note('x.oid', 'pg_type')}
  WHERE x.typtype = 'e' AND n.nspname {IN}"""
OWNERS = """owners AS MATERIALIZED (SELECT d.db_id, d.objid AS oid, min(CASE WHEN k.schema_name IN ('public', '') THEN k.table_name
    ELSE k.schema_name || '.' || k.table_name END || '.' || a.attname) AS owned_by
  FROM pg_depend d JOIN pg_attribute a ON a.db_id = d.db_id AND a.attrelid = d.refobjid AND a.attnum = d.refobjsubid
  JOIN classes k ON k.db_id = d.db_id AND k.oid = d.refobjid
  WHERE d.classid = 'pg_class' AND d.refclassid = 'pg_class' AND d.deptype = 'a' GROUP BY ALL)"""
SEQUENCES = f"""SELECT x.db_id, k.schema_name, k.table_name AS sequence_name, seqtype AS data_type, seqstart AS start_value, seqmin AS min_value,
  seqmax AS max_value, seqincrement AS increment, seqcycle AS "cycle", coalesce(o.owned_by, '') AS owned_by, coalesce(d.description, '') AS comment
  FROM pg_sequence x JOIN classes k ON k.db_id = x.db_id AND k.oid = x.seqrelid LEFT JOIN owners o ON o.db_id = x.db_id AND o.oid = x.seqrelid
  {_note('x.seqrelid', 'pg_class')} WHERE k.schema_name {IN}"""
ATTRIBUTES = """attributes AS MATERIALIZED (SELECT t.db_id, t.oid, string_agg(a.attname || ':' || a.format_type, ',' ORDER BY a.attnum) AS attributes
  FROM pg_type t JOIN pg_attribute a ON a.db_id = t.db_id AND a.attrelid = t.typrelid
  WHERE t.typtype = 'c' AND a.attnum > 0 AND NOT a.attisdropped GROUP BY ALL)"""
DOMAINS = """domains AS MATERIALIZED (SELECT t.db_id, t.oid, t.base_type, c."constraint" FROM pg_type t LEFT JOIN
  (SELECT db_id, contypid, min(definition) AS "constraint" FROM pg_constraint WHERE contypid > 0 GROUP BY ALL) c
  ON c.db_id = t.db_id AND c.contypid = t.oid WHERE t.typtype = 'd')"""
TYPES = f"""SELECT x.db_id, n.nspname AS schema_name, typname AS type_name, CASE typtype WHEN 'c' THEN 'composite' WHEN 'd' THEN 'domain'
  ELSE 'range' END AS type_kind, a.attributes, coalesce(m.base_type, '') AS base_type, m."constraint", coalesce(d.description, '') AS comment
  FROM (SELECT * FROM pg_type ANTI JOIN (SELECT db_id, reltype AS oid FROM pg_class WHERE relkind IN ('m', 'p', 'r', 'v')) AS rows_of USING (db_id, oid)) x
  JOIN pg_namespace n ON n.db_id = x.db_id AND n.oid = x.typnamespace LEFT JOIN attributes a ON a.db_id = x.db_id AND a.oid = x.oid
  LEFT JOIN domains m ON m.db_id = x.db_id AND m.oid = x.oid {_note('x.oid', 'pg_type')}
  WHERE typtype IN ('c', 'd', 'r') AND n.nspname {IN}"""
ROUTINES = f"""SELECT x.db_id, n.nspname AS schema_name, proname AS routine_name, x.oid AS routine_oid,
  CASE prokind WHEN 'p' THEN 'procedure' ELSE 'function' END AS routine_type, l.lanname AS language, {ARGUMENTS} AS arguments,
  coalesce(result, '') AS return_type, definition, coalesce(d.description, '') AS comment
  FROM pg_proc x JOIN pg_namespace n ON n.db_id = x.db_id AND n.oid = x.pronamespace JOIN pg_language l ON l.db_id = x.db_id AND l.oid = x.prolang
  {_note('x.oid', 'pg_proc')} WHERE prokind IN ('f', 'p') AND n.nspname {IN}"""
VIEWS = f"""SELECT x.db_id, x.table_schema AS schema_name, x.table_name, x.view_definition AS definition, coalesce(d.description, '') AS comment
  FROM info_views x LEFT JOIN classes k ON k.db_id = x.db_id AND k.schema_name = x.table_schema AND k.table_name = x.table_name
  {_note('k.oid', 'pg_class')} WHERE x.table_schema {IN}"""
VIEW_DEPS = f"""SELECT DISTINCT v.db_id, c.schema_name, c.table_name, dc.relkind AS dep_kind,
  CASE WHEN dc.schema_name IN ('public', '') THEN dc.table_name ELSE dc.schema_name || '.' || dc.table_name END AS dependency
  FROM pg_depend d JOIN pg_rewrite r ON r.db_id = d.db_id AND r.oid = d.objid JOIN classes c ON c.db_id = d.db_id AND c.oid = r.ev_class
  JOIN info_views v ON v.db_id = c.db_id AND v.table_schema = c.schema_name AND v.table_name = c.table_name
  JOIN classes dc ON dc.db_id = d.db_id AND dc.oid = d.refobjid
  WHERE d.classid = 'pg_rewrite' AND d.refclassid = 'pg_class' AND dc.relkind IN ('r', 'v') AND v.table_schema {IN}
  AND NOT (dc.schema_name = c.schema_name AND dc.table_name = c.table_name)"""
STATS = """SELECT db_id, schemaname AS schema_name, tablename AS table_name, attname AS column_name, null_frac AS null_fraction,
  CASE WHEN n_distinct > 0 THEN CAST(trunc(n_distinct) AS BIGINT) END AS distinct_count_estimate FROM pg_stats"""
ESTIMATES = "SELECT db_id, schema_name, table_name, CASE WHEN reltuples >= 0 THEN CAST(reltuples AS BIGINT) END AS row_count_estimate FROM scope"
TABLE_STATS = f"""SELECT e.db_id, e.schema_name, e.table_name, '{COMPUTED_AT}' AS computed_at, 'estimate' AS sampling_strategy, row_count_estimate,
  (SELECT count(*) FROM pg_stats p WHERE p.db_id = e.db_id AND p.schemaname = e.schema_name AND p.tablename = e.table_name) AS column_stat_count,
  '{c.STATS_NOTE}' AS note FROM ({ESTIMATES}) e"""

CON_KEYS = _key_cte("con_keys", "pg_constraint", "conkey", "conrelid", "oid")
REF_KEYS = _key_cte("ref_keys", "pg_constraint", "confkey", "confrelid", "oid")
IND_KEYS = _key_cte("ind_keys", "pg_index", "indkey", "indrelid", "indexrelid")

# Body and the relations (or CTE) each needs.
PARTS = {
    "cat_tables": (TABLES, (*BASE, "pg_description")),
    "cat_row_estimate": (ESTIMATES, BASE),
    "cat_columns": (COLUMNS, ("info_columns",)),
    "cat_column_comments": ("SELECT db_id, schema_name, table_name, column_name, comment FROM commented",
                            (*BASE, "pg_description", "pg_attribute", "info_columns", COMMENTED)),
    "cat_constraints": (CONSTRAINTS, (*BASE, "pg_constraint", "pg_attribute", CON_KEYS)),
    "cat_indexes": (INDEXES, (*BASE, "pg_index", "pg_attribute", "pg_am", IND_KEYS)),
    "cat_include_columns": (f"SELECT db_id, indexrelid, {INCLUDE} AS include_columns FROM pg_index", ("pg_index",)),
    "cat_foreign_keys": (FKS, (*BASE, "pg_constraint", "pg_attribute", CON_KEYS, REF_KEYS)),
    "cat_triggers": (TRIGGERS, (*BASE, "pg_trigger", "pg_proc")),
    "trigger_bits": (f"SELECT db_id, oid, tgtype, {TIMING} AS timing, {EVENTS} AS events FROM pg_trigger", ("pg_trigger",)),
    "cat_enums": (ENUMS, ("pg_type", "pg_enum", "pg_namespace", "pg_description")),
    "cat_sequences": (SEQUENCES, ("pg_class", "pg_namespace", CLASSES, "pg_sequence", "pg_depend", "pg_attribute", "pg_description", OWNERS)),
    "sequence_owner": ("SELECT * FROM owners", ("pg_class", "pg_namespace", CLASSES, "pg_depend", "pg_attribute", OWNERS)),
    "cat_types": (TYPES, ("pg_type", "pg_namespace", "pg_class", "pg_attribute", "pg_constraint", "pg_description", ATTRIBUTES, DOMAINS)),
    "type_attributes": ("SELECT * FROM attributes", ("pg_type", "pg_attribute", ATTRIBUTES)),
    "domain_info": ("SELECT * FROM domains", ("pg_type", "pg_constraint", DOMAINS)),
    "cat_routines": (ROUTINES, ("pg_proc", "pg_namespace", "pg_language", "pg_description")),
    "routine_arguments": (f"SELECT db_id, oid, {ARGUMENTS} AS arguments FROM pg_proc", ("pg_proc",)),
    "cat_views": (VIEWS, ("pg_class", "pg_namespace", CLASSES, "info_views", "pg_description")),
    "view_columns": (f"""SELECT c.db_id, c.schema_name, c.table_name, ordinal_position, column_name, data_type, comment FROM commented c
        JOIN info_views v ON v.db_id = c.db_id AND v.table_schema = c.schema_name AND v.table_name = c.table_name WHERE c.schema_name {IN}""",
                     (*BASE, "pg_description", "pg_attribute", "info_columns", COMMENTED, "info_views")),
    "view_dependencies": (VIEW_DEPS, ("pg_class", "pg_namespace", CLASSES, "info_views", "pg_depend", "pg_rewrite")),
    "cat_column_stats": (STATS, ("pg_stats",)),
    "cat_table_stats": (TABLE_STATS, (*BASE, "pg_stats")),
    "database_meta": ("SELECT db_id, datname AS name, 'postgresql' AS engine, version FROM pg_database", ("pg_database",)),
}

# Without definitions and comments; triggers have none of the latter.
for _name in ("cat_views", "cat_triggers", "cat_routines"):
    _body, _needs = PARTS[_name]
    _gone = "CAST(NULL AS VARCHAR) AS definition" + (", '' AS comment" if _name != "cat_triggers" else "")
    PARTS[f"{_name}_redacted"] = (f"SELECT * REPLACE ({_gone}) FROM ({_body})", _needs)

# Frames of the snapshot as queries over the parts above.
SNAPSHOT = {
    "databases": "database_meta", "tables": "cat_tables", "constraints": "cat_constraints", "indexes": "cat_indexes",
    "foreign_keys": "cat_foreign_keys", "triggers": "cat_triggers", "sequences": "cat_sequences",
    "enum_labels": "cat_enums", "types": "cat_types", "views": "cat_views", "view_columns": "view_columns",
    "view_dependencies": "view_dependencies", "routines": "cat_routines", "stats": "cat_table_stats",
}


def _snapshot_sql() -> str:
    ctes: list[str] = []
    for part in SNAPSHOT.values():
        ctes += [x for x in PARTS[part][1] if x not in ctes]
    # Relations first, derived CTE after, in their order of first use.
    ctes.sort(key=lambda x: "(" in x)
    bodies = {frame: PARTS[part][0] for frame, part in SNAPSHOT.items()}
    bodies["columns"] = "SELECT c.db_id FROM commented c SEMI JOIN scope USING (db_id, schema_name, table_name)"
    bodies["column_stats"] = ("SELECT p.db_id FROM pg_stats p JOIN scope s ON s.db_id = p.db_id AND s.schema_name = p.schemaname "
                              "AND s.table_name = p.tablename")
    bodies["enums"] = f"SELECT DISTINCT db_id, schema_name, enum_name FROM ({ENUMS})"
    union = " UNION ALL ".join(
        f"SELECT db_id, '{frame}' AS frame, count(*) AS row_count FROM ({body}) GROUP BY db_id" for frame, body in bodies.items()
    )
    return _sql(union, *ctes)


def oracles() -> dict[str, str]:
    out = {name: _sql(body, *needs) for name, (body, needs) in PARTS.items()}
    out["catalog_snapshot"] = out["snapshot_from_export"] = _snapshot_sql()
    return out
