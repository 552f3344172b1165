"""Registered queries on the normalised fleet: groups B to F."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.functions.names import safe_name
from snapcat.operators import catalog, domains, names, overview, relations, semantics, tags
from snapcat.operators.facts import table_facts, tag_facts
from snapcat.sources.fleet import duckdb_cte, fleet_normal

Query = Callable[[SparkSession, str], DataFrame]


def joined(*columns: str) -> list:
    """List columns as comma-joined text (lists do not compare across engines)."""
    return [F.array_join(c, ",").alias(c) for c in columns]


class Fleet:
    """Normalised frames and the facts built on them."""

    def __init__(self, frames: Mapping[str, DataFrame]):
        self.frames = frames

    @property
    def tables(self) -> DataFrame:
        return self.frames["tables"]

    @property
    def columns(self) -> DataFrame:
        return self.frames["columns"]

    @property
    def constraints(self) -> DataFrame:
        return self.frames["constraints"]

    @property
    def indexes(self) -> DataFrame:
        return self.frames["indexes"]

    @property
    def fks(self) -> DataFrame:
        return self.frames["foreign_keys"]

    def counts(self) -> DataFrame:
        return relations.fk_counts(self.fks, self.tables)

    def junctions(self) -> DataFrame:
        return relations.junctions(table_facts(self.tables, self.columns, self.constraints, self.fks))

    def flags(self) -> DataFrame:
        return tags.tag_flags(self.junctions())

    def unique_fks(self) -> DataFrame:
        return relations.with_fk_unique(self.fks, self.constraints, self.indexes)

    def cardinality(self) -> DataFrame:
        return relations.with_cardinality(self.unique_fks(), self.junctions())

    def domains(self) -> DataFrame:
        return domains.table_domains(self.tables)


FleetQuery = Callable[[Fleet], DataFrame]
FK_ID = ["db_id", "from_schema", "from_table", "constraint_name"]
K = ["db_id", "schema_name", "table_name"]


def fk_nullable(f: Fleet):
    told = f.fks if "nullable" in f.fks.columns else catalog.with_fk_nullable(f.fks, f.columns)
    return told.select(*FK_ID, "nullable")


def fk_incoming(f: Fleet):
    return relations.incoming(f.fks, f.tables).select(
        "db_id", "to_schema", "to_table", "constraint_name", "from_schema", "from_table", *joined("from_columns", "to_columns")
    )


def fk_counts(f: Fleet):
    return f.counts()


def junction_tables(f: Fleet):
    return f.junctions().select(*K, "is_junction", "junction_reasoning")


def fk_unique(f: Fleet):
    return f.unique_fks().select(*FK_ID, "fk_unique")


def fk_cardinality(f: Fleet):
    return f.cardinality().select(*FK_ID, "to_schema", "to_table", "cardinality")


def incoming_cardinality(f: Fleet):
    return relations.incoming(f.cardinality(), f.tables).select(
        "db_id", "to_schema", "to_table", "constraint_name", "cardinality"
    )


def graph_nodes(f: Fleet):
    return relations.graph_nodes(f.tables)


def graph_edges(f: Fleet):
    edges = relations.graph_edges(f.fks)
    return edges.withColumns({c: F.array_join(c, ",") for c in ("from_columns", "to_columns")})


def graph_candidates(f: Fleet):
    return relations.graph_candidates(f.junctions())


def fk_scc(f: Fleet):
    return relations.strongly_connected(relations.graph_edges(f.fks))


def tag_query(name: str) -> FleetQuery:
    if name not in tags.RULES:
        return lambda f: f.flags().where(name).select(*K)
    return lambda f: tag_facts(name, f.tables, f.columns, f.fks).where(tags.RULES[name]()).select(*K)


def table_tags(f: Fleet):
    return tags.table_tags(f.flags()).select(*K, *joined("tags"))


def domain_prefix(f: Fleet):
    return f.tables.select(*K, domains.name_prefix(F.col("table_name")).alias("prefix"))


def domain_groups(f: Fleet):
    return domains.prefix_groups(f.tables)


def domain_content(f: Fleet):
    return f.tables.select(*K, domains.content_domain(F.col("table_name")).alias("domain"))


def db_domains(f: Fleet):
    return f.domains()


def domain_sizes(f: Fleet):
    return domains.domain_sizes(f.domains())


def primary_keys(f: Fleet):
    return relations.primary_keys(f.constraints).select(*K, *joined("pk_columns"), "pk_name")


def short_descriptions(f: Fleet):
    return f.tables.select(*K, overview.short_description(F.col("comment")).alias("short_description"))


def db_index(f: Fleet):
    entries = overview.db_index(f.tables, tags.table_tags(f.flags()), relations.primary_keys(f.constraints))
    return entries.withColumns({c: F.array_join(c, ",") for c in ("primary_key_columns", "tags")})


def start_tables(f: Fleet):
    return overview.start_tables(f.flags()).withColumn("position", F.col("position").cast("bigint"))


def entry_points(f: Fleet):
    return overview.entry_points(f.counts()).withColumn("position", F.col("position").cast("bigint"))


def has_relationships(f: Fleet):
    return overview.has_relationships(f.counts())


def table_buckets(f: Fleet):
    return overview.table_buckets(f.flags())


def sem_query(name: str) -> FleetQuery:
    def run(f: Fleet):
        classed = semantics.column_classes(f.columns)
        return classed.where(f"is_{name}").select(*K, "column_name")

    return run


def column_semantics(f: Fleet):
    lists = [f"{kind}_columns" for kind in semantics.CLASSES]
    return semantics.column_semantics(f.columns).select(*K, *joined(*lists))


def safe_names(spark, sf):
    parts = [("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"), ("documents", "text"), ("pages", "url")]
    out = None
    for table, column in parts:
        name = F.col(column)
        rows = spark.read.parquet(f"{sf}/{table}.parquet").select(
            F.lit(table).alias("source"), name.alias("name"), safe_name(name).alias("safe_name")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


ON_FLEET: dict[str, FleetQuery] = {
    "fk_nullability": fk_nullable,
    "fk_incoming": fk_incoming,
    "fk_counts": fk_counts,
    "junction_tables": junction_tables,
    "fk_unique": fk_unique,
    "fk_cardinality": fk_cardinality,
    "fk_incoming_cardinality": incoming_cardinality,
    "graph_nodes": graph_nodes,
    "graph_edges": graph_edges,
    "graph_candidates": graph_candidates,
    "fk_scc": fk_scc,
    **{f"tag_{name}": tag_query(name) for name in ("core", "junction", "lookup", "audit", "config", "log")},
    "table_tags": table_tags,
    "domain_prefix": domain_prefix,
    "domain_groups": domain_groups,
    "domain_content": domain_content,
    "db_domains": db_domains,
    "domain_sizes": domain_sizes,
    "primary_keys": primary_keys,
    "short_descriptions": short_descriptions,
    "db_index": db_index,
    "start_tables": start_tables,
    "entry_points": entry_points,
    "has_relationships": has_relationships,
    "table_buckets": table_buckets,
    "sem_id": sem_query("id"),
    "sem_timestamp": sem_query("timestamp"),
    "sem_status": sem_query("status"),
    "sem_currency": sem_query("currency_amount"),
    "column_semantics": column_semantics,
}


def on_template(query: FleetQuery) -> Query:
    return lambda spark, sf: query(Fleet(fleet_normal(spark, sf)))


QUERIES: dict[str, Query] = {**{name: on_template(query) for name, query in ON_FLEET.items()}, "safe_name": safe_names}


# --- oracles -----------------------------------------------------------------

def _any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


JUNCTION_CTE = f"""
j_fk AS (SELECT db_id, from_schema AS schema_name, from_table AS table_name, count(*) AS fk_out,
                list_distinct(flatten(list(from_columns))) AS fk_columns
         FROM f_foreign_keys GROUP BY ALL),
j_col AS (SELECT c.db_id, c.schema_name, c.table_name, count(*) AS n_columns,
                 count(*) FILTER (WHERE NOT list_contains(j.fk_columns, column_name)
                                  AND lower(column_name) NOT IN {_in(names.METADATA_COLUMNS)}) AS payload
          FROM f_columns c JOIN j_fk j USING (db_id, schema_name, table_name) GROUP BY ALL),
j_pk AS (SELECT db_id, schema_name, table_name, arg_min("columns", constraint_name) AS pk_columns, min(constraint_name) AS pk_name
         FROM f_constraints WHERE constraint_type = 'PRIMARY KEY' GROUP BY ALL),
j_reason AS (SELECT t.db_id, t.schema_name, t.table_name, CASE
    WHEN j.fk_out IS NULL OR j.fk_out < 2 THEN NULL
    WHEN len(p.pk_columns) > 0 AND list_has_all(j.fk_columns, p.pk_columns) THEN '{relations.REASON_KEY}'
    WHEN coalesce(payload, 0) <= 2 AND coalesce(n_columns, 0) <= 8 THEN '{relations.REASON_FEW}'
    WHEN {_any("lower(t.table_name)", names.JUNCTION_NAMES)} THEN '{relations.REASON_NAME}'
  END AS junction_reasoning
  FROM f_tables t LEFT JOIN j_fk j USING (db_id, schema_name, table_name)
  LEFT JOIN j_col USING (db_id, schema_name, table_name) LEFT JOIN j_pk p USING (db_id, schema_name, table_name)),
junctions AS (SELECT db_id, schema_name, table_name, junction_reasoning IS NOT NULL AS is_junction, junction_reasoning FROM j_reason)"""

COUNTS_CTE = """
counts AS (SELECT t.db_id, t.schema_name, t.table_name,
    (SELECT count(*) FROM f_foreign_keys f WHERE f.db_id = t.db_id AND f.from_schema = t.schema_name AND f.from_table = t.table_name) AS fk_out,
    (SELECT count(*) FROM f_foreign_keys f WHERE f.db_id = t.db_id AND f.to_schema = t.schema_name AND f.to_table = t.table_name) AS fk_in
  FROM f_tables t)"""

UNIQUE_CTE = """
u_keys AS (SELECT db_id, schema_name, table_name, "columns" AS key FROM f_constraints WHERE constraint_type IN ('PRIMARY KEY', 'UNIQUE')
  UNION ALL SELECT db_id, schema_name, table_name, "columns" FROM f_indexes WHERE is_unique),
uniques AS (SELECT f.*, EXISTS (SELECT 1 FROM u_keys k WHERE k.db_id = f.db_id AND k.schema_name = f.from_schema
    AND k.table_name = f.from_table AND len(k.key) = len(f.from_columns) AND list_has_all(k.key, f.from_columns)) AS fk_unique
  FROM f_foreign_keys f),
cards AS (SELECT u.*, CASE WHEN j.is_junction THEN 'many-to-many' WHEN fk_unique THEN 'one-to-one' ELSE 'many-to-one' END AS cardinality
  FROM uniques u LEFT JOIN junctions j ON j.db_id = u.db_id AND j.schema_name = u.from_schema AND j.table_name = u.from_table)"""

FLAGS_CTE = f"""
c_signs AS (SELECT db_id, schema_name, table_name, count(*) AS n,
    bool_or(lower(column_name) IN {_in(names.LOOKUP_COLUMNS)}) AS lookup_col,
    count(*) FILTER (WHERE lower(column_name) IN {_in(names.AUDIT_COLUMNS)}) AS audit_cols,
    bool_or(lower(column_name) IN {_in(names.CONFIG_KEYS)}) AS has_key,
    bool_or(lower(column_name) IN {_in(names.CONFIG_VALUES)}) AS has_value,
    bool_or(contains(lower(column_name), 'timestamp') OR lower(column_name) IN {_in(names.LOG_TIMES)}) AS has_time,
    bool_or(lower(column_name) IN {_in(names.LOG_KINDS)}) AS has_kind
  FROM f_columns GROUP BY ALL),
flags AS (SELECT t.db_id, t.schema_name, t.table_name, fk_out, fk_in,
    fk_in >= 3 AS core, is_junction AS junction,
    {_any("lower(table_name)", names.LOOKUP_NAMES)} OR (coalesce(n, 0) <= 5 AND fk_out = 0 AND fk_in > 0)
      OR (coalesce(lookup_col, false) AND coalesce(n, 0) <= 4) AS lookup,
    {_any("lower(table_name)", names.AUDIT_NAMES)} OR coalesce(audit_cols, 0) >= 2 AS audit,
    {_any("lower(table_name)", names.CONFIG_NAMES)} OR (coalesce(n, 0) <= 4 AND coalesce(has_key AND has_value, false)) AS config,
    {_any("lower(table_name)", names.LOG_NAMES)} OR coalesce(has_time AND has_kind, false) AS log
  FROM f_tables t JOIN counts USING (db_id, schema_name, table_name) JOIN junctions USING (db_id, schema_name, table_name)
  LEFT JOIN c_signs USING (db_id, schema_name, table_name)),
tagged AS (SELECT *, array_to_string(list_filter([CASE WHEN core THEN 'core' END, CASE WHEN junction THEN 'junction' END,
    CASE WHEN lookup THEN 'lookup' END, CASE WHEN audit THEN 'audit' END, CASE WHEN config THEN 'config' END,
    CASE WHEN log THEN 'log' END], lambda x: x IS NOT NULL), ',') AS tags FROM flags)"""

_PREFIX = """CASE WHEN instr(lower(table_name), '_') > 3 AND instr(lower(table_name), '_') < length(table_name)
    THEN split_part(lower(table_name), '_', 1) END"""
_CONTENT = "CASE " + " ".join(
    f"WHEN {_any('lower(table_name)', words)} THEN '{d}'" for d, words in domains.DOMAIN_WORDS.items()
) + " ELSE 'Other' END"
DOMAIN_CTE = f"""
d_prefix AS (SELECT db_id, schema_name, table_name, {_PREFIX} AS prefix FROM f_tables),
d_groups AS (SELECT db_id, prefix, count(*) AS table_count, upper(prefix[1]) || prefix[2:] AS domain
  FROM d_prefix WHERE prefix IS NOT NULL GROUP BY db_id, prefix HAVING count(*) >= 2),
d_tables AS (SELECT p.db_id, coalesce(g.domain, {_CONTENT}) AS domain, schema_name, table_name
  FROM d_prefix p LEFT JOIN d_groups g USING (db_id, prefix))"""


def _sql(body: str, *ctes: str, relation: Callable[[str], str] = duckdb_cte) -> str:
    """``ctes`` are relation names, which ``relation`` renders, or ready CTE text."""
    parts = [relation(c) if "(" not in c else c for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


BASE = ("f_tables", "f_columns", "f_constraints", "f_indexes", "f_foreign_keys")
JUNCTIONS = ("f_tables", "f_columns", "f_constraints", "f_foreign_keys", JUNCTION_CTE)
CARDS = (*BASE, JUNCTION_CTE, UNIQUE_CTE)
FLAGS = (*JUNCTIONS, COUNTS_CTE, FLAGS_CTE)
DOMAINS = ("f_tables", DOMAIN_CTE)


#: Members of strongly connected components; the statement must say WITH RECURSIVE.
MEMBERS = (
    """reach(db_id, a, b) AS (
      SELECT DISTINCT db_id, (from_schema, from_table), (to_schema, to_table) FROM f_foreign_keys
        WHERE (from_schema, from_table) <> (to_schema, to_table)
      UNION
      SELECT r.db_id, r.a, (f.to_schema, f.to_table) FROM reach r JOIN f_foreign_keys f
        ON f.db_id = r.db_id AND f.from_schema = r.b[1] AND f.from_table = r.b[2])""",
    "mutual AS (SELECT x.db_id, x.a, x.b FROM reach x JOIN reach y ON x.db_id = y.db_id AND x.a = y.b AND x.b = y.a)",
    """member AS (SELECT db_id, a AS v, max(b) AS root, min(b) AS first, count(*) FILTER (WHERE a <> b) + 1 AS component_size
      FROM mutual GROUP BY db_id, a)""",
)


def _sem(condition: str) -> str:
    return f"SELECT db_id, schema_name, table_name, column_name FROM f_columns WHERE {condition}"


SEM = {
    "id": "(column_name IN ('id', 'uuid') OR column_name LIKE '%\\_id' ESCAPE '\\' OR column_name LIKE '%\\_uuid' ESCAPE '\\')",
    "timestamp": "(contains(data_type, 'timestamp') OR data_type = 'date' OR suffix(column_name, '_at') OR suffix(column_name, '_date')"
    " OR suffix(column_name, '_time') OR column_name IN ('created', 'updated', 'deleted'))",
    "status": "(column_name IN ('status', 'state') OR suffix(column_name, '_status') OR suffix(column_name, '_state'))",
    "currency": "((data_type IN ('money', 'numeric') OR contains(data_type, 'decimal')) AND "
    + _any("column_name", semantics.MONEY_WORDS) + ")",
}


def _listed(name: str) -> str:
    return f"coalesce(string_agg(column_name, ',' ORDER BY ordinal_position) FILTER (WHERE {SEM[name]}), '')"


_SAFE = "nullif(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_'), '')"


def _safe(table: str, column: str) -> str:
    return f"SELECT '{table}' AS source, {column} AS name, coalesce({_SAFE.format(column)}, 'unnamed') AS safe_name FROM {table}"


def oracles(relation: Callable[[str], str] = duckdb_cte) -> dict[str, str]:
    """The SQL of each query, on the relations as ``relation`` renders them."""
    sql = partial(_sql, relation=relation)
    out = {
        "fk_nullability": sql(
            """SELECT db_id, from_schema, from_table, constraint_name, EXISTS (SELECT 1 FROM f_columns c WHERE c.db_id = f.db_id
            AND c.schema_name = from_schema AND c.table_name = from_table AND c.nullable AND list_contains(from_columns, column_name)) AS nullable
            FROM f_foreign_keys f""", "f_columns", "f_foreign_keys"),
        "fk_incoming": sql(
            """SELECT f.db_id, to_schema, to_table, constraint_name, from_schema, from_table,
            array_to_string(from_columns, ',') AS from_columns, array_to_string(to_columns, ',') AS to_columns
            FROM f_foreign_keys f JOIN f_tables t ON t.db_id = f.db_id AND t.schema_name = to_schema AND t.table_name = to_table""",
            "f_tables", "f_foreign_keys"),
        "fk_counts": sql("SELECT * FROM counts", "f_tables", "f_foreign_keys", COUNTS_CTE),
        "junction_tables": sql("SELECT * FROM junctions", *JUNCTIONS),
        "fk_unique": sql("SELECT db_id, from_schema, from_table, constraint_name, fk_unique FROM uniques", *CARDS),
        "fk_cardinality": sql(
            "SELECT db_id, from_schema, from_table, constraint_name, to_schema, to_table, cardinality FROM cards", *CARDS),
        "fk_incoming_cardinality": sql(
            """SELECT c.db_id, to_schema, to_table, constraint_name, cardinality FROM cards c
            JOIN f_tables t ON t.db_id = c.db_id AND t.schema_name = to_schema AND t.table_name = to_table""", *CARDS),
        "graph_nodes": sql("SELECT db_id, table_name, schema_name FROM f_tables", "f_tables"),
        "graph_edges": sql(
            """SELECT db_id, from_table, from_schema, array_to_string(from_columns, ',') AS from_columns, to_table, to_schema,
            array_to_string(to_columns, ',') AS to_columns, constraint_name FROM f_foreign_keys""", "f_foreign_keys"),
        "graph_candidates": sql("SELECT db_id, table_name, schema_name FROM junctions WHERE is_junction", *JUNCTIONS),
        "fk_scc": sql(
            """SELECT db_id, root[1] AS component_schema, root[2] AS component_table, v[1] AS schema_name, v[2] AS table_name, component_size
            FROM member WHERE component_size >= 2""", "f_foreign_keys", *MEMBERS).replace("WITH ", "WITH RECURSIVE ", 1),
        **{f"tag_{n}": sql(f"SELECT db_id, schema_name, table_name FROM flags WHERE {n}", *FLAGS)
           for n in ("core", "junction", "lookup", "audit", "config", "log")},
        "table_tags": sql("SELECT db_id, schema_name, table_name, tags FROM tagged", *FLAGS),
        "domain_prefix": sql("SELECT * FROM d_prefix", *DOMAINS),
        "domain_groups": sql("SELECT * FROM d_groups", *DOMAINS),
        "domain_content": sql(f"SELECT db_id, schema_name, table_name, {_CONTENT} AS domain FROM f_tables", "f_tables"),
        "db_domains": sql("SELECT * FROM d_tables", *DOMAINS),
        "domain_sizes": sql("SELECT db_id, domain, count(*) AS table_count FROM d_tables GROUP BY ALL", *DOMAINS),
        "primary_keys": sql(
            """SELECT db_id, schema_name, table_name, array_to_string("columns", ',') AS pk_columns, constraint_name AS pk_name
            FROM f_constraints WHERE constraint_type = 'PRIMARY KEY'""", "f_constraints"),
        "short_descriptions": sql(
            """SELECT db_id, schema_name, table_name, CASE WHEN length(comment) > 200 THEN comment[:197] || '...'
            ELSE nullif(comment, '') END AS short_description FROM f_tables""", "f_tables"),
        "db_index": sql(
            """SELECT t.db_id, t.schema_name, t.table_name, CASE WHEN length(comment) > 200 THEN comment[:197] || '...'
            ELSE nullif(comment, '') END AS short_description, row_count_estimate, array_to_string(pk_columns, ',') AS primary_key_columns,
            fk_out AS foreign_key_out_count, fk_in AS foreign_key_in_count, tags
            FROM f_tables t JOIN tagged USING (db_id, schema_name, table_name) LEFT JOIN j_pk USING (db_id, schema_name, table_name)""",
            *FLAGS),
        "start_tables": sql(
            """, s AS (SELECT db_id, schema_name, table_name, fk_in * 2 + CASE WHEN core THEN 5 ELSE 0 END
              - CASE WHEN junction THEN 3 ELSE 0 END - CASE WHEN lookup THEN 2 ELSE 0 END AS score FROM flags),
            r AS (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY score DESC, schema_name, table_name) AS position FROM s WHERE score > 0)
            SELECT * FROM r WHERE position <= 5""", *FLAGS),
        "entry_points": sql(
            """, r AS (SELECT db_id, schema_name, table_name, fk_in,
              row_number() OVER (PARTITION BY db_id ORDER BY fk_in DESC, schema_name, table_name) AS position FROM counts WHERE fk_in >= 2)
            SELECT * FROM r WHERE position <= 5""", "f_tables", "f_foreign_keys", COUNTS_CTE),
        "has_relationships": sql(
            "SELECT db_id, bool_or(fk_in > 0 OR fk_out > 0) AS has_relationships FROM counts GROUP BY db_id",
            "f_tables", "f_foreign_keys", COUNTS_CTE),
        "table_buckets": sql(
            """SELECT db_id, schema_name, table_name, CASE WHEN core THEN 'core' WHEN junction THEN 'junction'
            WHEN lookup THEN 'lookup' ELSE 'other' END AS bucket FROM flags""", *FLAGS),
        "sem_id": sql(_sem(SEM["id"]), "f_columns"),
        "sem_timestamp": sql(_sem(SEM["timestamp"]), "f_columns"),
        "sem_status": sql(_sem(SEM["status"]), "f_columns"),
        "sem_currency": sql(_sem(SEM["currency"]), "f_columns"),
        "column_semantics": sql(
            f"""SELECT db_id, schema_name, table_name, {_listed('status')} AS status_columns, {_listed('timestamp')} AS timestamp_columns,
            {_listed('currency')} AS currency_amount_columns, {_listed('id')} AS id_columns FROM f_columns
            WHERE {' OR '.join(SEM.values())} GROUP BY ALL""", "f_columns"),
        "safe_name": " UNION ALL ".join(_safe(t, c) for t, c in [
            ("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"), ("documents", "text"), ("pages", "url")]),
    }
    return {k: v.replace("\n, ", ",\n").replace(")\n,", "),\n") if k in ("fk_scc", "start_tables", "entry_points") else v for k, v in out.items()}
