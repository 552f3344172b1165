"""Registered queries on the given tables: groups V and the scalar part of H."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.functions import toon
from snapcat.operators import profile, sketches
from snapcat.operators.toon_rows import toon_ranked, toon_rows
from snapcat.session import settle

# Columns of the given tables.
TABLES: dict[str, dict[str, str]] = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int",
             "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
               "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
                 "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
                 "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double",
               "props": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# NULLs put into columns that have none, the same way in both engines.
NULLED = {
    "orders": {"o_orderpriority": "nullif(o_orderpriority, '5-LOW')",
               "o_totalprice": "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END"},
    "lineitem": {"l_returnflag": "nullif(l_returnflag, 'N')", "l_orderkey": "nullif(l_orderkey, 1)"},
    "events": {"user_id": "CASE WHEN event_type = 'click' THEN NULL ELSE user_id END", "props": "nullif(props, '{\"k\": 1}')"},
}


def read_nulled(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    changed = NULLED[table]
    return read(spark, sf_dir, table).selectExpr(*(f"{changed[c]} AS {c}" if c in changed else c for c in TABLES[table]))


def read_ranked(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return read_nulled(spark, sf_dir, table) if table in NULLED else read(spark, sf_dir, table)


def nulled_sql(table: str) -> str:
    changed = NULLED[table]
    return "SELECT " + ", ".join(f"{changed[c]} AS {c}" if c in changed else c for c in TABLES[table]) + f" FROM {table}"


TOP_COLUMNS = {
    "lineitem": ["l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_shipdate"],
    "orders": ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"],
    "events": ["user_id", "event_type", "value", "props"],
    "documents": ["text", "lang", "source"],
    "conversations": ["conv_id", "role", "text"],
}
TOP_K = 10
ENUM_K = 8
ENUM_TABLES = ("orders", "lineitem", "events", "customer", "part", "conversations", "documents")

KEYS = {
    "lineitem_line": ("lineitem", ["l_orderkey", "l_linenumber"]),
    "conversations_turn": ("conversations", ["conv_id", "turn"]),
    "orders_pk": ("orders", ["o_orderkey"]),
    "documents_text": ("documents", ["text"]),
    "events_user_time": ("events", ["user_id", "ts"]),
}
NULL_KEYS = {"events_user": ("events", ["user_id"]), "lineitem_nulls": ("lineitem", ["l_orderkey", "l_linenumber"])}

FOREIGN_KEYS = {
    "nation_region": ("nation", "n_regionkey", "region", "r_regionkey"),
    "customer_nation": ("customer", "c_nationkey", "nation", "n_nationkey"),
    "supplier_nation": ("supplier", "s_nationkey", "nation", "n_nationkey"),
    "orders_customer": ("orders", "o_custkey", "customer", "c_custkey"),
    "lineitem_orders": ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    "lineitem_part": ("lineitem", "l_partkey", "part", "p_partkey"),
    "lineitem_supplier": ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    "labels_documents": ("labels", "doc_id", "documents", "doc_id"),
    "events_customer": ("events", "user_id", "customer", "c_custkey"),
    "orders_in_lineitem": ("orders", "o_orderkey", "lineitem", "l_orderkey"),
}

CHECKS = {
    "lineitem": {
        "discount_range": "l_discount BETWEEN 0 AND 0.1",
        "quantity_small": "l_quantity <= 40",
        "flag_known": "l_returnflag IN ('A', 'R')",
        "price_positive": "l_extendedprice > 0",
    },
    "orders": {"total_above": "o_totalprice > 2000", "priority_known": "o_orderpriority <> '1-URGENT'"},
}

DENSITY = {"orders": "o_orderkey", "customer": "c_custkey", "lineitem": "l_orderkey", "events": "user_id", "labels": "doc_id"}

PAIRS = {
    "lineitem_orders": ("lineitem", "orders", [("l_orderkey", "o_orderkey"), ("l_linenumber", "o_orderkey"), ("l_partkey", "o_custkey")]),
    "orders_customer": ("orders", "customer", [("o_custkey", "c_custkey"), ("o_orderkey", "c_custkey"), ("o_orderstatus", "c_mktsegment")]),
    "events_customer": ("events", "customer", [("user_id", "c_custkey"), ("event_id", "c_custkey")]),
}

CHUNKS = {"nation": ("n_nationkey", 10), "supplier": ("s_suppkey", 50), "part": ("p_partkey", 500),
          "orders": ("o_orderkey", 1000), "documents": ("doc_id", 20), "benchmark": ("item_id", 16)}


#: Documents in the order of columns that are no key: many rows an order, NULLs, a few values for all rows.
RANKED = {"lineitem": (["l_orderkey"], 500), "events": (["event_type", "user_id"], 300), "conversations": (["role"], 25)}


def _top(df: DataFrame, cols) -> DataFrame:
    return profile.top_values(df, cols, TOP_K).withColumn("position", F.col("position").cast("bigint"))


def _enums(df: DataFrame) -> DataFrame:
    return profile.enum_like_columns(df, ENUM_K).withColumn("values", F.array_join("values", "|"))


#: Tables whose sketches are kept by day, and the day.
SKETCHED = {"events": "CAST(ts AS DATE)", "lineitem": "CAST(l_shipdate AS DATE)", "orders": "CAST(o_orderdate AS DATE)"}
SKETCHED_RANK_ERROR = 2 * sketches.RANK_ERROR


def merged_sketches(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Sketches by day, written and merged: exact counts, and whether the estimates are within their bounds of the exact figures."""
    df = read_nulled(spark, sf_dir, table)
    kept = settle(sketches.sketch_columns(df.withColumn("day", F.expr(SKETCHED[table])), ["day"]))
    merged = settle(sketches.estimates(sketches.merge(kept), (0.5,)).select("column_name", "row_count", "null_fraction", "distinct_count", "quantiles"))
    # One number a column.
    medians = {r.column_name: r.quantiles[0] for r in merged.where("quantiles IS NOT NULL").collect()}
    numbers = {c: F.unix_micros(F.col(c).cast("timestamp")) if kind == "timestamp_ntz" else F.col(c) for c, kind in TABLES[table].items() if c in medians}
    shares = [F.struct(F.lit(c).alias("column_name"), *((F.count_if(t) / F.count(x)).alias(n) for n, t in (("below", x < medians[c]), ("upto", x <= medians[c]))))
              for c, x in numbers.items()]
    ranks = df.agg(F.array(*shares).alias("r")).select(F.inline("r"))
    exact = profile.profile_columns(df).select("column_name", F.col("distinct_count").alias("exact"))
    off = SKETCHED_RANK_ERROR
    return merged.join(exact, "column_name").join(ranks, "column_name", "left").select(
        "column_name", "row_count", "null_fraction", (F.abs(F.col("distinct_count") - F.col("exact")) <= sketches.DISTINCT_ERROR * F.col("exact")).alias("distinct_close"),
        ((F.col("below") - off <= 0.5) & (F.col("upto") + off >= 0.5)).alias("median_close"))


def quoted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoting of every text the tables hold."""
    out = None
    for table, key, column in QUOTED:
        rows = read(spark, sf_dir, table).select(
            F.lit(table).alias("source"), F.col(key).alias("row_id"), toon.needs_quotes(F.col(column)).alias("needs_quotes"),
            toon.quoted(F.col(column)).alias("quoted"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


QUOTED = [("documents", "doc_id", "text"), ("benchmark", "item_id", "text"), ("pages", "page_id", "html"),
          ("pages", "page_id", "url"), ("events", "event_id", "props"), ("conversations", "conv_id", "text")]


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number form of every double of the tables, and of every vector element."""
    out = read(spark, sf_dir, "embeddings").select(
        F.lit("embedding").alias("source"), F.explode(F.col("embedding").cast("array<double>")).alias("x")
    )
    for table, column in NUMBERS:
        out = out.unionByName(read(spark, sf_dir, table).select(F.lit(column).alias("source"), F.col(column).alias("x")))
    return out.groupBy("source", toon.number_text(F.col("x")).alias("number")).agg(F.count("*").alias("n"))


NUMBERS = [("lineitem", "l_extendedprice"), ("lineitem", "l_discount"), ("orders", "o_totalprice"), ("events", "value"),
           ("customer", "c_acctbal"), ("part", "p_retailprice")]


def scalar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar form of columns of each kind, NULLs included."""
    df = read_nulled(spark, sf_dir, "orders")
    return df.select(
        "o_orderkey",
        toon.scalar_text(F.col("o_custkey"), "integer").alias("as_integer"),
        toon.scalar_text(F.col("o_totalprice"), "double").alias("as_number"),
        toon.scalar_text(F.col("o_orderpriority"), "string").alias("as_string"),
        toon.scalar_text(F.col("o_orderpriority") < "3", "bool").alias("as_bool"),
    )


def key_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key form of names the tables hold: bare where the name allows it."""
    out = None
    for table, column in KEY_NAMES:
        rows = read(spark, sf_dir, table).select(F.lit(column).alias("source"), F.col(column).alias("name")).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("key_text", toon.key_text(F.col("name")))


KEY_NAMES = [("part", "p_name"), ("part", "p_type"), ("orders", "o_orderpriority"), ("events", "props"), ("documents", "text"),
             ("customer", "c_name"), ("pages", "url")]


def line_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline lists: the lines of every document."""
    return read(spark, sf_dir, "documents").select("doc_id", toon.inline_list(F.split("text", "\n")).alias("lines"))


QUERIES = {
    **{f"profile_{t}": (lambda spark, sf, t=t: profile.profile_columns(read(spark, sf, t))) for t in TABLES},
    **{f"profile_nulls_{t}": (lambda spark, sf, t=t: profile.profile_columns(read_nulled(spark, sf, t))) for t in NULLED},
    **{f"top_values_{t}": (lambda spark, sf, t=t, c=c: _top(read(spark, sf, t), c)) for t, c in TOP_COLUMNS.items()},
    **{f"enum_like_{t}": (lambda spark, sf, t=t: _enums(read(spark, sf, t))) for t in ENUM_TABLES},
    **{f"key_check_{n}": (lambda spark, sf, t=t, c=c: profile.check_key(read(spark, sf, t), c)) for n, (t, c) in KEYS.items()},
    **{f"key_check_{n}": (lambda spark, sf, t=t, c=c: profile.check_key(read_nulled(spark, sf, t), c))
       for n, (t, c) in NULL_KEYS.items()},
    **{f"fk_check_{n}": (lambda spark, sf, c=c, cc=cc, p=p, pc=pc: profile.check_fk(read(spark, sf, c), [cc], read(spark, sf, p), [pc]))
       for n, (c, cc, p, pc) in FOREIGN_KEYS.items()},
    "fk_check_events_nulls": lambda spark, sf: profile.check_fk(
        read_nulled(spark, sf, "events"), ["user_id"], read(spark, sf, "customer"), ["c_custkey"]
    ),
    **{f"check_eval_{t}": (lambda spark, sf, t=t: profile.check_rows(read_nulled(spark, sf, t), {n: F.expr(e) for n, e in CHECKS[t].items()}))
       for t in CHECKS},
    **{f"key_density_{t}": (lambda spark, sf, t=t, c=c: profile.key_density(read(spark, sf, t), c)) for t, c in DENSITY.items()},
    **{f"infer_fk_{n}": (lambda spark, sf, c=c, p=p, pairs=pairs: profile.inclusion(read(spark, sf, c), read(spark, sf, p), pairs))
       for n, (c, p, pairs) in PAIRS.items()},
    **{f"toon_rows_{t}": (lambda spark, sf, t=t, k=k, n=n: toon_rows(read(spark, sf, t), k, n)) for t, (k, n) in CHUNKS.items()},
    **{f"toon_rows_{t}": (lambda spark, sf, t=t, k=k, n=n: toon_ranked(read_ranked(spark, sf, t), k, n)) for t, (k, n) in RANKED.items()},
    **{f"sketch_profile_{t}": (lambda spark, sf, t=t: merged_sketches(spark, sf, t)) for t in SKETCHED},
    "toon_quote": quoted_texts,
    "toon_number": number_texts,
    "toon_scalar": scalar_texts,
    "toon_key": key_texts,
    "toon_inline_list": line_lists,
}


# --- oracles -----------------------------------------------------------------

def _number(x: str) -> str:
    """Plain form of a double; digits come from the shortest text, zeros from its exponent."""
    text = f"CAST({x} AS VARCHAR)"
    digits = f"replace(split_part(ltrim({text}, '-'), 'e', 1), '.', '')"
    small = (f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || '0.' || "
             f"repeat('0', CAST(-CAST(split_part({text}, 'e', 2) AS INTEGER) - 1 AS BIGINT)) || {digits}")
    return (f"CASE WHEN {x} IS NULL THEN 'null' WHEN {x} = trunc({x}) AND abs({x}) < 9e15 THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
            f"WHEN contains({text}, 'e-') THEN {small} ELSE {text} END")


def _shown(column: str, kind: str) -> str:
    if kind == "double":
        return f"CASE WHEN {column} IS NOT NULL THEN {_number(column)} END"
    if kind.startswith("array"):
        return "CAST(NULL AS VARCHAR)"
    return f"CAST({column} AS VARCHAR)"


def _quoted(x: str) -> str:
    body = f"replace({x}, '\\', '\\\\')"
    for char, escape in (("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")):
        body = f"replace({body}, {char}, {escape})"
    return f"CASE WHEN {_needs(x)} THEN '\"' || {body} || '\"' ELSE {x} END"


def _needs(x: str) -> str:
    return f"regexp_matches({x}, '^$|^(true|false|null)$|^[-0-9 ]| $|[:\"\\\\\\[\\]{{}},\\x00-\\x1f]')"


def _scalar(column: str, kind: str) -> str:
    if kind == "double":
        return _number(column)
    if kind in ("int", "bigint", "boolean"):
        return f"coalesce(CAST({column} AS VARCHAR), 'null')"
    text = f"CAST({column} AS VARCHAR)" if kind != "string" else column
    return f"coalesce({_quoted(text)}, 'null')"


def _profile(source: str, table: str) -> str:
    parts = []
    for column, kind in TABLES[table].items():
        low, high = (_shown(f"min({column})", kind), _shown(f"max({column})", kind))
        parts.append(
            f"SELECT '{column}' AS column_name, '{kind}' AS data_type, count(*) AS row_count, "
            f"CAST(count(*) - count({column}) AS DOUBLE) / count(*) AS null_fraction, {low} AS min_value, {high} AS max_value, "
            f"count(DISTINCT {column}) AS distinct_count FROM src"
        )
    return f"WITH src AS ({source}) " + " UNION ALL ".join(parts)


def _top_sql(table: str) -> str:
    parts = []
    for column in TOP_COLUMNS[table]:
        shown = _shown(column, TABLES[table][column])
        parts.append(
            f"SELECT *, row_number() OVER (ORDER BY n DESC, value) AS position FROM (SELECT '{column}' AS column_name, {shown} AS value, "
            f"count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY ALL)"
        )
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + f") WHERE position <= {TOP_K}"


def _enum_sql(table: str) -> str:
    parts = [
        f"SELECT '{c}' AS column_name, count(*) AS value_count, string_agg(v, '|' ORDER BY v) AS \"values\" "
        f"FROM (SELECT DISTINCT {c} AS v FROM {table} WHERE {c} IS NOT NULL)"
        for c, kind in TABLES[table].items() if kind == "string"
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + f") WHERE value_count BETWEEN 1 AND {ENUM_K}"


def _key_sql(source: str, cols: list[str]) -> str:
    complete = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return (
        f"SELECT *, duplicate_groups = 0 AND null_key_rows = 0 AS holds FROM (SELECT CAST(sum(n) AS BIGINT) AS row_count, "
        f"count(*) FILTER (WHERE {complete}) AS distinct_keys, count(*) FILTER (WHERE {complete} AND n > 1) AS duplicate_groups, "
        f"CAST(coalesce(sum(n) FILTER (WHERE NOT ({complete})), 0) AS BIGINT) AS null_key_rows "
        f"FROM (SELECT {', '.join(cols)}, count(*) AS n FROM ({source}) GROUP BY ALL))"
    )


def _fk_sql(child: str, cc: str, parent: str, pc: str) -> str:
    return f"""WITH c AS ({child}), p AS (SELECT DISTINCT {pc} AS k FROM {parent}),
    per AS (SELECT {cc} AS k, count(*) AS n FROM c WHERE {cc} IS NOT NULL GROUP BY ALL)
    SELECT *, CASE WHEN max_children <= 1 THEN 'one-to-one' ELSE 'many-to-one' END AS cardinality FROM (
    SELECT (SELECT count(*) FROM c) AS child_rows, (SELECT count(*) FROM c WHERE {cc} IS NULL) AS null_fk_rows,
    (SELECT count(*) FROM c WHERE {cc} IS NOT NULL AND {cc} NOT IN (SELECT k FROM p)) AS orphan_rows,
    (SELECT count(*) FROM per ANTI JOIN p USING (k)) AS orphan_keys,
    (SELECT coalesce(max(n), 0) FROM per SEMI JOIN p USING (k)) AS max_children)"""


def _check_sql(table: str) -> str:
    return f"WITH src AS ({nulled_sql(table)}) " + " UNION ALL ".join(
        f"SELECT *, violations = 0 AS holds FROM (SELECT '{n}' AS check_name, count(*) AS row_count, "
        f"count(*) FILTER (WHERE NOT ({e})) AS violations FROM src)" for n, e in CHECKS[table].items()
    )


def _pair_sql(child: str, parent: str, pairs) -> str:
    return " UNION ALL ".join(
        f"""SELECT *, CAST(included_values AS DOUBLE) / child_values AS inclusion_ratio FROM (SELECT '{c}' AS child_column,
        '{p}' AS parent_column, count(*) AS child_values, count(*) FILTER (WHERE v IN (SELECT CAST({p} AS VARCHAR) FROM {parent})) AS included_values
        FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {child} WHERE {c} IS NOT NULL))""" for c, p in pairs
    )


def _chunk_sql(table: str, key: str, n: int) -> str:
    cols = TABLES[table]
    line = " || ',' || ".join(_scalar(c, kind) for c, kind in cols.items())
    return f"""SELECT CAST(floor({key} / {n}) AS BIGINT) AS chunk, count(*) AS row_count,
    '[' || count(*) || ']{{{','.join(cols)}}}:' || string_agg(chr(10) || '  ' || {line}, '' ORDER BY {key}) AS doc
    FROM {table} GROUP BY 1"""


def _ranked_sql(table: str, keys: list[str], n: int) -> str:
    cols = TABLES[table]
    line = " || ',' || ".join(_scalar(c, kind) for c, kind in cols.items())
    source = nulled_sql(table) if table in NULLED else f"SELECT * FROM {table}"
    order = ", ".join(f"{k} NULLS FIRST" for k in keys)
    return f"""SELECT (position - 1) // {n} AS chunk, count(*) AS row_count,
    '[' || count(*) || ']{{{','.join(cols)}}}:' || string_agg(chr(10) || '  ' || line, '' ORDER BY position) AS doc
    FROM (SELECT line, row_number() OVER (ORDER BY {order}, line) AS position FROM (SELECT *, {line} AS line FROM ({source}))) GROUP BY 1"""


def oracles() -> dict[str, str]:
    numbers = [("embedding", "(SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)")]
    numbers += [(c, f"(SELECT {c} AS x FROM {t})") for t, c in NUMBERS]
    return {
        **{f"profile_{t}": _profile(f"SELECT * FROM {t}", t) for t in TABLES},
        **{f"profile_nulls_{t}": _profile(nulled_sql(t), t) for t in NULLED},
        **{f"top_values_{t}": _top_sql(t) for t in TOP_COLUMNS},
        **{f"enum_like_{t}": _enum_sql(t) for t in ENUM_TABLES},
        **{f"key_check_{n}": _key_sql(f"SELECT * FROM {t}", c) for n, (t, c) in KEYS.items()},
        **{f"key_check_{n}": _key_sql(nulled_sql(t), c) for n, (t, c) in NULL_KEYS.items()},
        **{f"fk_check_{n}": _fk_sql(f"SELECT * FROM {c}", cc, p, pc) for n, (c, cc, p, pc) in FOREIGN_KEYS.items()},
        "fk_check_events_nulls": _fk_sql(nulled_sql("events"), "user_id", "customer", "c_custkey"),
        **{f"check_eval_{t}": _check_sql(t) for t in CHECKS},
        **{f"key_density_{t}": f"SELECT min({c}) AS min_key, max({c}) AS max_key, count(DISTINCT {c}) AS distinct_keys, "
           f"max({c}) - min({c}) + 1 - count(DISTINCT {c}) AS missing_keys FROM {t}" for t, c in DENSITY.items()},
        **{f"infer_fk_{n}": _pair_sql(c, p, pairs) for n, (c, p, pairs) in PAIRS.items()},
        **{f"toon_rows_{t}": _chunk_sql(t, k, n) for t, (k, n) in CHUNKS.items()},
        **{f"toon_rows_{t}": _ranked_sql(t, k, n) for t, (k, n) in RANKED.items()},
        **{f"sketch_profile_{t}": f"WITH src AS ({nulled_sql(t)}) " + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) AS row_count, CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS null_fraction, true AS distinct_close, "
            f"{'NULL' if kind == 'string' else 'true'} AS median_close FROM src" for c, kind in TABLES[t].items()) for t in SKETCHED},
        "toon_quote": " UNION ALL ".join(
            f"SELECT '{t}' AS source, {k} AS row_id, {_needs(c)} AS needs_quotes, {_quoted(c)} AS quoted FROM {t}" for t, k, c in QUOTED),
        "toon_number": " UNION ALL ".join(
            f"SELECT '{c}' AS source, {_number('x')} AS number, count(*) AS n FROM {src} GROUP BY ALL" for c, src in numbers),
        "toon_scalar": f"""SELECT o_orderkey, {_scalar('o_custkey', 'bigint')} AS as_integer, {_scalar('o_totalprice', 'double')} AS as_number,
            {_scalar('o_orderpriority', 'string')} AS as_string, coalesce(CAST(o_orderpriority < '3' AS VARCHAR), 'null') AS as_bool
            FROM ({nulled_sql('orders')})""",
        "toon_key": " UNION ALL ".join(
            f"SELECT *, CASE WHEN regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_.]*$') THEN name ELSE {_quoted('name')} END AS key_text "
            f"FROM (SELECT DISTINCT '{c}' AS source, {c} AS name FROM {t})" for t, c in KEY_NAMES),
        "toon_inline_list": f"""SELECT doc_id, '[' || len(parts) || ']: ' ||
            array_to_string(list_transform(parts, lambda p: {_quoted('p')}), ',') AS lines
            FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)""",
    }
