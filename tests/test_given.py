"""The fleet of given rows is as large and as skewed as it says."""

from dataclasses import replace

from pyspark.sql import functions as F

from snapcat.operators.catalog import KEY
from snapcat.operators.facts import table_facts
from snapcat.plans.snapshot import snapshot
from snapcat.registry import all_queries, catalog, given
from snapcat.sources.given import COLUMNS, RELATIONS, dealt, given_cte, given_raw, merged
from snapcat.sources.relations import CATALOG_COLUMNS


def test_columns_are_those_of_an_export(spark, sf_dir):
    raw = given_raw(spark, sf_dir)
    for name in RELATIONS:
        assert set(raw[name].columns) == {"db_id", *CATALOG_COLUMNS[name]}
        kinds = {f.name: f.dataType.simpleString() for f in raw[name].schema}
        assert {c: kinds[c] for c in CATALOG_COLUMNS[name]} == CATALOG_COLUMNS[name]
        assert "{" not in given_cte(name)


def test_every_order_is_a_table_and_one_database_has_a_third(spark, sf_dir):
    raw = given_raw(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    tables = raw["pg_class"].where("relkind = 'r' AND oid % 4 = 0").groupBy("db_id").count().collect()
    n = orders.count()
    assert sum(r["count"] for r in tables) == n
    hot = next(r["count"] for r in tables if r.db_id == 0)
    assert hot >= n / 3 and hot > 10 * max(r["count"] for r in tables if r.db_id != 0)


def test_one_target_draws_a_third_of_all_keys(spark, sf_dir):
    keys = given_raw(spark, sf_dir)["pg_constraint"].where("contype = 'f'")
    # Tables of supplier 0.
    assert keys.where("confrelid = 101").count() > keys.count() / 3


def test_object_ids_and_names_are_unique(spark, sf_dir):
    raw = given_raw(spark, sf_dir)
    for name, key in (("pg_class", ["db_id", "oid"]), ("pg_constraint", ["db_id", "oid"]), ("pg_attribute", ["db_id", "attrelid", "attnum"]),
                      ("info_tables", ["db_id", "table_schema", "table_name"]), ("info_columns", ["db_id", "table_schema", "table_name", "column_name"])):
        assert raw[name].groupBy(*key).count().where("count > 1").isEmpty(), name


def test_lines_are_joined_once(spark, sf_dir, capsys):
    """What most relations start from is written once; plans read that, and broadcast none of it by the size of its files."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        given_raw(spark, sf_dir)["pg_constraint"].explain()
        raw = capsys.readouterr().out
        all_queries()["given_fk_counts"](spark, sf_dir).explain()
        frames = capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "lineitem.parquet" not in raw and "settled-" in raw
    assert "lineitem.parquet" not in frames and "BroadcastHashJoin" not in frames


def test_keys_meet_columns_only_for_nullability(spark, sf_dir, capsys):
    raw = given_raw(spark, sf_dir)
    bare = snapshot(raw, replace(catalog.FULL, fk_nullable=False))["foreign_keys"]
    full = snapshot(raw, catalog.FULL)["foreign_keys"]
    assert set(bare.columns) == {*full.columns} - {"nullable"}
    full.explain()
    # Which columns are nullable no comment tells.
    assert "p_type" not in capsys.readouterr().out
    assert bare.count() == full.count()


def test_table_facts_read_names_and_primary_keys_alone(spark, sf_dir, capsys):
    """What a query on table facts does not read is not joined, and the facts are the same."""
    raw = given_raw(spark, sf_dir)
    less = snapshot(raw, replace(catalog.FULL, fk_nullable=False, **given.ON_FACTS))
    full = snapshot(raw, replace(catalog.FULL, fk_nullable=False))
    less["tables"].explain()
    assert "documents.parquet" not in capsys.readouterr().out
    assert "to_columns" not in less["foreign_keys"].columns
    assert {r.constraint_type for r in less["constraints"].select("constraint_type").distinct().collect()} == {"PRIMARY KEY"}
    few, all_ = (f.select(*KEY, "fk_out", "fk_in", "n_columns", "n_payload", "n_key_columns", "n_own_key_columns") for f in
                 (table_facts(x["tables"], x["columns"], x["constraints"], x["foreign_keys"]) for x in (less, full)))
    assert not few.isEmpty() and few.exceptAll(all_).isEmpty() and all_.exceptAll(few).isEmpty()


def test_lines_are_shuffled_once(spark, sf_dir, capsys):
    """Lines are dealt by order before they are grouped, not once for the groups and again for their orders."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    read = {"orders": spark.read.parquet(f"{sf_dir}/orders.parquet"), "lineitem": dealt(lines)}
    merged(spark.sql(f"SELECT * FROM {COLUMNS} c".format(**{n: "{" + n + "}" for n in read}), **read)).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2


def test_scope_meets_tables_only(spark, sf_dir, capsys):
    """Indexes, two fifths of the classes, are not shuffled to find the tables in scope."""
    scope = catalog.Raw(given_raw(spark, sf_dir)).scope()
    scope.explain()
    assert "ix_" not in capsys.readouterr().out
    assert scope.count() == given_raw(spark, sf_dir)["info_tables"].where("table_type = 'BASE TABLE' AND table_schema IN ('public', 'app')").join(
        spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS db_id"), "db_id").count()
