"""A fleet drawn from the rows of given tables, large and skewed where those are.

Every customer is a database. Orders are its tables, their line items the columns, keys, indexes and
foreign keys; the suppliers and parts that a database's line items name are tables of it too, and targets
of the keys. Documents are comments, part types column comments, pages views, and a user's events the
labels of an enum. Every third order, page and user belongs to database 0, which so has a third of all
objects; line items 1, 3 and 5 of every order point at one supplier, which draws a third of all keys in every database.

The relations are SQL that Spark and DuckDB both read, so ``given_cte`` renders the same for the oracle
queries; rows of databases without a customer have no namespace and fall away with their first join.
Line items with the same order and number are one column. Nothing is limited. Columns, suppliers and parts,
which most relations start from, are written once to the shared folder where a relation needs them.
"""

from __future__ import annotations

import string
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from snapcat.session import merged, settle
from snapcat.sources.lazy import LazyFrames

NAMES = ("customer", "orders", "lineitem", "supplier", "part", "documents", "pages", "events")


def _dealt(key: str, own: str) -> str:
    return f"CASE WHEN {key} % 3 = 0 THEN CAST(0 AS BIGINT) ELSE {own} END AS db_id"


# Orders by state: one namespace each, the last outside the schemas of the snapshot.
ORDERS = f"""(SELECT {_dealt('o_orderkey', 'o_custkey')}, o_orderkey, o_orderkey * 4 + 100 AS oid, o_orderpriority || '_' || o_orderkey AS table_name,
    CASE o_orderstatus WHEN 'F' THEN 'public' WHEN 'O' THEN 'app' ELSE 'other' END AS schema_name, o_totalprice FROM {{orders}})"""
NAMESPACE = "CASE schema_name WHEN 'public' THEN CAST(2200 AS BIGINT) WHEN 'app' THEN CAST(2300 AS BIGINT) ELSE CAST(2400 AS BIGINT) END"
LINES = """(SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, min(l_linestatus) AS line_status, min(l_partkey) AS partkey,
    CASE WHEN l_linenumber IN (1, 3, 5) THEN CAST(0 AS BIGINT) ELSE min(l_suppkey) END AS suppkey, count(*) AS copies
    FROM {lineitem} GROUP BY l_orderkey, l_linenumber)"""
COLUMNS = f"""(SELECT o.db_id, o.oid, o.o_orderkey, o.schema_name, o.table_name, l.l_linenumber, l.flag, l.line_status, l.partkey, l.suppkey, l.copies,
    CASE WHEN l.l_linenumber = 1 THEN 'id' ELSE 'c' || l.l_linenumber || CASE l.flag WHEN 'A' THEN '_at' WHEN 'R' THEN '_price' ELSE '_status' END END
      AS column_name,
    CASE l.flag WHEN 'A' THEN 'timestamp without time zone' WHEN 'R' THEN 'numeric' ELSE 'text' END AS data_type
    FROM {ORDERS} o JOIN {LINES} l ON l.l_orderkey = o.o_orderkey)"""
# Odd line items name a supplier, even ones a part.
SUPPLIERS = f"""(SELECT x.db_id, x.first_order, s_suppkey * 4 + 101 AS oid, s_name AS table_name, 'public' AS schema_name, s_acctbal AS size
    FROM (SELECT db_id, suppkey, min(o_orderkey) AS first_order FROM {{columns}} c WHERE l_linenumber % 2 = 1 GROUP BY db_id, suppkey) x
    JOIN {{supplier}} ON s_suppkey = x.suppkey)"""
PARTS = f"""(SELECT x.db_id, p_partkey * 4 + 102 AS oid, p_name || ' ' || p_partkey AS table_name, 'app' AS schema_name, p_retailprice AS size
    FROM (SELECT DISTINCT db_id, partkey FROM {{columns}} c WHERE l_linenumber % 2 = 0) x JOIN {{part}} ON p_partkey = x.partkey)"""
PAGES = f"""(SELECT {_dealt('page_id', 'page_id')}, page_id * 4 + 103 AS oid, url || '#' || page_id AS table_name, 'public' AS schema_name, html FROM {{pages}})"""
LABELS = f"(SELECT {_dealt('user_id', 'user_id')}, user_id, event_type || ' ' || props AS label, event_id FROM {{events}})"
OBJECTS = f"""(SELECT db_id, oid, schema_name, table_name, CASE WHEN o_totalprice < 50000 THEN CAST(-1 AS DOUBLE) ELSE floor(o_totalprice) END AS size FROM {ORDERS} o
    UNION ALL SELECT db_id, oid, schema_name, table_name, floor(size) FROM {{suppliers}} s
    UNION ALL SELECT db_id, oid, schema_name, table_name, floor(size) FROM {{parts}} p)"""
INDEX_OID = "-(o_orderkey * 64 + l_linenumber) - 1"

RELATIONS = {
    "pg_database": "SELECT c_custkey AS db_id, c_name AS datname, c_mktsegment AS version FROM {customer}",
    "pg_namespace": " UNION ALL ".join(
        f"SELECT c_custkey AS db_id, CAST({oid} AS BIGINT) AS oid, '{name}' AS nspname FROM {{customer}}" for oid, name in ((2200, "public"), (2300, "app"), (2400, "other"))),
    "pg_am": "SELECT c_custkey AS db_id, CAST(403 AS BIGINT) AS oid, 'btree' AS amname FROM {customer}",
    "info_tables": f"""SELECT db_id, schema_name AS table_schema, table_name, 'BASE TABLE' AS table_type FROM {OBJECTS} t
        UNION ALL SELECT db_id, schema_name, table_name, 'VIEW' FROM {PAGES} v""",
    "info_columns": f"""SELECT db_id, schema_name AS table_schema, table_name, column_name, data_type, data_type AS udt_name,
        CASE WHEN line_status = 'O' THEN 'YES' ELSE 'NO' END AS is_nullable, CAST(NULL AS STRING) AS column_default,
        CAST(NULL AS INTEGER) AS character_maximum_length, CAST(NULL AS INTEGER) AS numeric_precision, CAST(NULL AS INTEGER) AS numeric_scale,
        'NO' AS is_identity, CAST(NULL AS STRING) AS identity_generation, 'NEVER' AS is_generated, CAST(NULL AS STRING) AS generation_expression,
        CAST(NULL AS STRING) AS collation_name, l_linenumber AS ordinal_position FROM {{columns}} c
        UNION ALL SELECT db_id, schema_name, table_name, 'id', 'bigint', 'bigint', 'NO', NULL, NULL, NULL, NULL, 'NO', NULL, 'NEVER', NULL, NULL, 1
        FROM (SELECT db_id, schema_name, table_name FROM {{suppliers}} s UNION ALL SELECT db_id, schema_name, table_name FROM {{parts}} p) t""",
    "info_views": f"SELECT db_id, schema_name AS table_schema, table_name, html AS view_definition FROM {PAGES} v",
    "pg_class": f"""SELECT db_id, oid, table_name AS relname, {NAMESPACE} AS relnamespace, 'r' AS relkind, size AS reltuples,
        CAST(0 AS BIGINT) AS reltype, CAST(2 AS BIGINT) AS relam FROM {OBJECTS} t
        UNION ALL SELECT db_id, oid, table_name, {NAMESPACE}, 'v', CAST(-1 AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM {PAGES} v
        UNION ALL SELECT db_id, {INDEX_OID}, 'ix_' || o_orderkey || '_' || l_linenumber, {NAMESPACE}, 'i', CAST(0 AS DOUBLE), CAST(0 AS BIGINT), CAST(403 AS BIGINT)
        FROM {{columns}} c WHERE line_status = 'F'""",
    "pg_attribute": f"""SELECT db_id, oid AS attrelid, column_name AS attname, l_linenumber AS attnum, copies > 2 AS attisdropped, data_type AS format_type FROM {{columns}} c
        UNION ALL SELECT db_id, oid, 'id', 1, false, 'bigint' FROM (SELECT db_id, oid FROM {{suppliers}} s UNION ALL SELECT db_id, oid FROM {{parts}} p) t""",
    "pg_description": f"""SELECT db_id, oid AS objoid, 'pg_class' AS classoid, 0 AS objsubid, text AS description FROM {ORDERS} o JOIN {{documents}} ON doc_id = o_orderkey
        UNION ALL SELECT db_id, oid, 'pg_class', l_linenumber, p_type FROM {{columns}} c JOIN {{part}} ON p_partkey = partkey WHERE flag <> 'N'""",
    "pg_constraint": f"""SELECT db_id, o_orderkey * 256 + l_linenumber * 4 + k AS oid, oid AS conrelid,
        CASE WHEN k <> 1 THEN CAST(0 AS BIGINT) WHEN l_linenumber % 2 = 1 THEN suppkey * 4 + 101 ELSE partkey * 4 + 102 END AS confrelid, CAST(0 AS BIGINT) AS contypid,
        CASE k WHEN 1 THEN 'fk_' WHEN 2 THEN 'pk_' WHEN 3 THEN 'uq_' ELSE 'ck_' END || l_linenumber AS conname,
        CASE k WHEN 1 THEN 'f' WHEN 2 THEN 'p' WHEN 3 THEN 'u' ELSE 'c' END AS contype, {{list}}(l_linenumber) AS conkey, {{list}}(1) AS confkey,
        'a' AS confupdtype, CASE flag WHEN 'A' THEN 'a' WHEN 'R' THEN 'c' ELSE 'n' END AS confdeltype, 'ON ' || column_name || ' OF ' || table_name AS definition
        FROM (SELECT c.*, 1 AS k FROM {{columns}} c
              UNION ALL SELECT c.*, CASE WHEN l_linenumber = 1 THEN 2 WHEN flag = 'A' THEN 3 ELSE 0 END FROM {{columns}} c) d
        UNION ALL SELECT db_id, -oid, oid, first_order * 4 + 100, CAST(0 AS BIGINT), 'fk_first_order', 'f', {{list}}(1), {{list}}(1), 'a', 'a', 'ON id OF ' || table_name
        FROM {{suppliers}} s""",
    "pg_index": f"""SELECT db_id, {INDEX_OID} AS indexrelid, oid AS indrelid, flag = 'A' AS indisunique, l_linenumber = 1 AS indisprimary, {{list}}(l_linenumber) AS indkey,
        'CREATE INDEX ON "' || table_name || '" USING btree (' || column_name || ') INCLUDE (id, ' || data_type || ')' AS indexdef,
        CASE WHEN copies > 1 THEN 'copies > 1' END AS predicate, CAST(NULL AS STRING) AS expression FROM {{columns}} c WHERE line_status = 'F'""",
    "pg_type": f"""SELECT DISTINCT db_id, user_id AS oid, CAST(2200 AS BIGINT) AS typnamespace, CAST(0 AS BIGINT) AS typrelid, 'kinds_' || user_id AS typname,
        'e' AS typtype, CAST(NULL AS STRING) AS base_type FROM {LABELS} e""",
    "pg_enum": f"SELECT db_id, user_id AS enumtypid, label AS enumlabel, CAST(min(event_id) AS DOUBLE) AS enumsortorder FROM {LABELS} e GROUP BY db_id, user_id, label",
}


#: What most relations start from, by the name that stands for it in their SQL.
SHARED = {"columns": COLUMNS, "suppliers": SUPPLIERS, "parts": PARTS}


def _names(text: str) -> set[str]:
    return {name for _, name, _, _ in string.Formatter().parse(text) if name in NAMES or name in SHARED}


def dealt(lines: DataFrame) -> DataFrame:
    """Lines by their order. They are grouped by order and number and then meet their order: so they are shuffled and sorted once for both."""
    return lines.repartition("l_orderkey")


def given_raw(spark: SparkSession, sf_dir: str) -> LazyFrames:
    """The catalog relations of the fleet."""

    def given(name: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return dealt(rows) if name == "lineitem" else rows

    def frame(text: str) -> DataFrame:
        read = {name: shared(name) if name in SHARED else given(name) for name in _names(text)}
        return spark.sql(text.format(list="array", **{n: "{" + n + "}" for n in read}), **read)

    @cache
    def shared(name: str) -> DataFrame:
        return settle(frame(f"SELECT * FROM {SHARED[name]} s"))

    return LazyFrames({relation: (lambda text=text: merged(frame(text))) for relation, text in RELATIONS.items()})


def given_cte(relation: str) -> str:
    """A ``WITH`` item for the relation in DuckDB's terms."""

    def whole(text: str) -> str:
        return text.format(list="list_value", **{n: whole(SHARED[n]) if n in SHARED else n for n in _names(text)})

    return f"{relation} AS MATERIALIZED ({whole(RELATIONS[relation])})"
