"""Group A: code maps, and raw relations against the template they describe."""

import pytest
from pyspark.sql import functions as F

from snapcat.functions import codes
from snapcat.operators.catalog import parse_schemas, with_key_names
from snapcat.plans.snapshot import SnapshotConfig, snapshot
from snapcat.sources.export import read_catalog, write_catalog
from snapcat.sources.fleet import SCHEMAS, fleet_normal, fleet_raw


def test_argument_modes(spark):
    modes = ["i", "I", "o", "O", "b", "B", "v", "V", "t", "T", "", "x", None]
    df = spark.createDataFrame([(n, m) for n, m in enumerate(modes)], "n int, m string")
    got = [r[0] for r in df.orderBy("n").select(codes.argument_mode(F.col("m"))).collect()]
    assert got == ["IN", "IN", "OUT", "OUT", "INOUT", "INOUT", "VARIADIC", "VARIADIC", "TABLE", "TABLE", "IN", "IN", "IN"]


@pytest.mark.parametrize(("names", "types", "modes", "want"), [
    (None, None, None, None),
    (None, [], None, None),
    (["a"], ["integer"], ["i"], [("a", "integer", "IN")]),
    (["a", ""], ["integer", "text"], ["i", "o"], [("a", "integer", "IN"), (None, "text", "OUT")]),
    (None, ["integer", "text"], None, [(None, "integer", "IN"), (None, "text", "IN")]),
    (["a"], ["integer", "text"], ["b"], [("a", "integer", "INOUT"), (None, "text", "IN")]),
])
def test_routine_arguments(spark, names, types, modes, want):
    df = spark.createDataFrame([(names, types, modes)], "n array<string>, t array<string>, m array<string>")
    got = df.select(codes.routine_arguments(F.col("n"), F.col("t"), F.col("m"))).first()[0]
    assert (None if got is None else [tuple(a) for a in got]) == want


@pytest.mark.parametrize(("definition", "want"), [
    ("CREATE INDEX i ON t USING btree (a) INCLUDE (b, c)", ["b", "c"]),
    ("CREATE INDEX i ON t USING btree (a) include ( b ,, c ) WHERE (d > 0)", ["b", "c"]),
    ("CREATE INDEX i ON t USING btree (a)", None),
    ("CREATE INDEX i ON t USING btree (a) INCLUDE ()", None),
    ("x INCLUDE )( y INCLUDE (b)", None),
])
def test_include_columns(spark, definition, want):
    assert spark.range(1).select(codes.include_columns(F.lit(definition))).first()[0] == want


@pytest.mark.parametrize(("bits", "timing", "events"), [
    (2 | 4 | 16, "before", ["insert", "update"]), (64 | 8, "instead of", ["delete"]), (32, "after", ["truncate"]), (1, "after", []),
])
def test_trigger_bits(spark, bits, timing, events):
    row = spark.range(1).select(codes.trigger_timing(F.lit(bits)), codes.trigger_events(F.lit(bits))).first()
    assert tuple(row) == (timing, events)


def test_parse_schemas():
    assert parse_schemas(" public , app,,") == ["public", "app"]
    assert parse_schemas(" , ") == ["public"]


def normal_rows(frame, names):
    return sorted(map(str, frame.select(*names).collect()))


@pytest.fixture(scope="module")
def planned(spark, sf_dir):
    return snapshot(fleet_raw(spark, sf_dir), SnapshotConfig(schemas=SCHEMAS))


@pytest.mark.parametrize("name", ["tables", "columns", "constraints", "indexes", "foreign_keys"])
def test_raw_relations_give_the_normal_frames(spark, sf_dir, planned, name):
    want = fleet_normal(spark, sf_dir)[name]
    assert normal_rows(planned[name], want.columns) == normal_rows(want, want.columns)


def test_switched_off_parts_are_absent(planned):
    assert not {"views", "routines", "stats"} & set(planned)


def test_export_round_trip(spark, sf_dir, tmp_path):
    raw = {name: frame.where("db_id <= 3") for name, frame in fleet_raw(spark, sf_dir).items() if name in ("pg_class", "pg_constraint")}
    write_catalog(raw, str(tmp_path))
    back = read_catalog(spark, str(tmp_path))
    for name, frame in raw.items():
        assert normal_rows(back[name], back[name].columns) == normal_rows(frame, back[name].columns)


def test_schema_filter_reaches_the_scan_of_an_export(spark, sf_dir, tmp_path):
    """The schemas of a snapshot are pushed into the Parquet scans, and only the columns that it needs are read."""
    from snapcat.plans.snapshot import SnapshotConfig, snapshot
    from snapcat.sources.export import read_catalog, write_catalog
    from snapcat.sources.fleet import fleet_raw

    raw = {name: frame.where("db_id < 3") for name, frame in fleet_raw(spark, sf_dir).items() if name in ("info_columns", "info_tables", "pg_class", "pg_namespace", "pg_description", "pg_attribute")}
    write_catalog(raw, str(tmp_path))
    frames = snapshot(read_catalog(spark, str(tmp_path)), SnapshotConfig(schemas=("app",)))
    assert {r.schema_name for r in frames["columns"].select("schema_name").distinct().collect()} == {"app"}
    # Scans are told apart by their columns.
    scan = scan_with(spark, frames["columns"], "ordinal_position")
    assert "EqualTo(table_schema,app)" in scan or "In(table_schema, [app])" in scan
    assert "EqualTo(table_type,BASE TABLE)" in scan_with(spark, frames["tables"], "table_type")


def scan_with(spark, frame, column):
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    try:
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    return next(line for line in plan.splitlines() if "FileScan" in line and column in line)


def test_key_names(spark):
    attributes = spark.createDataFrame(
        [(1, 10, "a", 1), (1, 10, "b", 2), (1, 11, "x", 1), (1, 11, "y", 2), (2, 10, "other", 1)],
        "db_id bigint, attrelid bigint, attname string, attnum int")
    keyed = spark.createDataFrame(
        [(1, 1, 10, [2, 1], 11, [1, 2]), (1, 2, 10, [0, 1], 11, [9]), (1, 3, 10, None, 11, []), (1, 4, 10, [1, 1], 12, [1]), (2, 1, 10, [1], 0, None)],
        "db_id bigint, id bigint, rel bigint, key array<int>, target bigint, refs array<int>")
    got = with_key_names(keyed, "id", {"names": ("rel", "key"), "to": ("target", "refs")}, attributes)
    assert {(r.db_id, r.id): (r.names, r.to) for r in got.collect()} == {
        (1, 1): (["b", "a"], ["x", "y"]), (1, 2): (["a"], []), (1, 3): ([], []), (1, 4): (["a", "a"], []), (2, 1): (["other"], [])}


def plan_of(frame, capsys):
    frame.explain()
    return capsys.readouterr().out


def test_an_export_is_not_broadcast(spark, sf_dir, tmp_path, capsys):
    """Files of an export are a few bytes a row; the planner's threshold must not collect them on the driver."""
    write_catalog(fleet_raw(spark, sf_dir), str(tmp_path))
    frames = snapshot(read_catalog(spark, str(tmp_path)), SnapshotConfig(schemas=SCHEMAS, include_views=True, include_routines=True, include_stats=True))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        assert [name for name in frames if "BroadcastHashJoin" in plan_of(frames[name], capsys)] == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def test_keys_are_shuffled_once_for_names_and_scope(spark, capsys):
    attributes = spark.createDataFrame([(1, 10, "a", 1), (1, 10, "b", 2)], "db_id bigint, attrelid bigint, attname string, attnum int")
    keyed = spark.createDataFrame([(1, 1, 10, [2, 1]), (1, 1, 10, [2, 1]), (1, None, 10, [1])], "db_id bigint, id bigint, conrelid bigint, key array<int>")
    scope = spark.createDataFrame([(1, 10, "t")], "db_id bigint, conrelid bigint, table_name string")
    got = with_key_names(keyed, "id", {"names": ("conrelid", "key")}, attributes).join(scope, ["db_id", "conrelid"])
    # Keys, attributes and scope: each is dealt out once, by relation.
    assert plan_of(got, capsys).count("Exchange hashpartitioning(db_id") == 3
    # Rows with the same identity share their slots, rows without one have none.
    assert sorted((r.id or 0, r.names) for r in got.collect()) == [(0, []), (1, ["b", "b", "a", "a"]), (1, ["b", "b", "a", "a"])]
