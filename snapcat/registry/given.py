"""Registered queries on the fleet drawn from given rows: the same operators, on a large, skewed and dirty catalog.

Frames of groups B to F come out of the snapshot of the raw relations, so each of these queries runs the whole way. Frames that
several others read are written once: unfolded, a plan would join the lines of all orders dozens of times.
"""

from __future__ import annotations

from dataclasses import replace

from snapcat.registry import catalog, facts
from snapcat.session import merged, settle
from snapcat.sources.given import given_cte, given_raw

RAW = ("cat_tables", "cat_row_estimate", "cat_column_comments", "cat_constraints", "cat_indexes", "cat_foreign_keys", "cat_enums", "cat_views", "cat_views_redacted", "database_meta")
FACTS = ("fk_nullability", "fk_incoming", "fk_counts", "junction_tables", "fk_cardinality", "fk_scc", "table_tags", "db_domains", "domain_groups", "primary_keys",
         "db_index", "start_tables", "entry_points", "table_buckets", "column_semantics")


def on_raw(name: str):
    return lambda spark, sf: catalog.ON_RAW[name](catalog.Raw(given_raw(spark, sf)))


#: What of the snapshot a query reads less of: those on table facts read names of tables, primary keys and the own columns of foreign keys.
ON_FACTS = {"table_texts": False, "constraint_types": ("p",), "fk_lists": ("from_columns",)}
READ = {
    **dict.fromkeys(("junction_tables", "table_tags", "start_tables", "table_buckets"), ON_FACTS),
    "fk_incoming": {"table_texts": False},
    "fk_nullability": {"table_texts": False, "fk_lists": ("from_columns",)},
    "fk_cardinality": {"table_texts": False, "constraint_types": ("p", "u"), "fk_lists": ("from_columns",)},
    "db_index": {"constraint_types": ("p",), "fk_lists": ("from_columns",)},
    # Counts and components are of tables, whatever columns their keys have; counts have a row for each row of a table.
    "fk_counts": {"fk_lists": ()},
    "fk_scc": {"table_texts": False, "fk_lists": ()},
}


def on_fleet(name: str):
    cfg = replace(catalog.FULL, fk_nullable=name == "fk_nullability", **READ.get(name, {}))
    return lambda spark, sf: facts.ON_FLEET[name](facts.Fleet(catalog.snapshot(given_raw(spark, sf), cfg, lambda frame: merged(settle(frame)))))


QUERIES = {**{f"given_{name}": on_raw(name) for name in RAW}, **{f"given_{name}": on_fleet(name) for name in FACTS}}


# --- oracles -----------------------------------------------------------------

#: Normalised frames from the raw relations: body, and the relations and CTE it needs.
NORMAL = {
    "f_tables": (f"SELECT * FROM ({catalog.TABLES}) JOIN ({catalog.ESTIMATES}) USING (db_id, schema_name, table_name)", catalog.PARTS["cat_tables"][1]),
    "f_columns": ("SELECT * FROM commented SEMI JOIN scope USING (db_id, schema_name, table_name)", catalog.PARTS["cat_column_comments"][1]),
    "f_constraints": (f"""SELECT * REPLACE (list_filter(string_split("columns", ','), lambda x: x <> '') AS "columns") FROM ({catalog.CONSTRAINTS})""",
                      catalog.PARTS["cat_constraints"][1]),
    "f_indexes": (f"""SELECT * REPLACE (list_filter(string_split("columns", ','), lambda x: x <> '') AS "columns") FROM ({catalog.INDEXES})""",
                  catalog.PARTS["cat_indexes"][1]),
    "f_foreign_keys": (f"""SELECT * REPLACE (list_filter(string_split(from_columns, ','), lambda x: x <> '') AS from_columns,
        list_filter(string_split(to_columns, ','), lambda x: x <> '') AS to_columns) FROM ({catalog.FKS})""", catalog.PARTS["cat_foreign_keys"][1]),
}


def _cte(name: str) -> str:
    """A raw relation, or a normalised frame with all that it needs inside."""
    if name not in NORMAL:
        return given_cte(name)
    body, needs = NORMAL[name]
    return f"{name} AS MATERIALIZED ({facts._sql(body, *needs, relation=given_cte)})"


def oracles() -> dict[str, str]:
    frames = facts.oracles(_cte)
    raw = {name: facts._sql(body, *needs, relation=given_cte) for name in RAW for body, needs in [catalog.PARTS[name]]}
    return {**{f"given_{name}": raw[name] for name in RAW}, **{f"given_{name}": frames[name] for name in FACTS}}
