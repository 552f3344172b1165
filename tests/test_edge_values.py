"""Values on which a rule is easily wrong: line ends, exact decimals, floats, zones, types that differ, empty keys."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from snapcat.functions import toon
from snapcat.operators import profile
from snapcat.operators.relations import with_fk_unique
from snapcat.plans.snapshot import SnapshotConfig, snapshot
from snapcat.sources.fleet import fleet_raw


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, bare", [("abc", True), ("abc\n", False), ("abc ", False), ("a.b_1", True), ("", False)])
def test_key_ends_at_the_end_of_the_text(spark, text, bare):
    shown = one(spark, toon.key_text(F.lit(text)))
    assert (shown == text) == bare or text == "abc "
    assert "\n" not in shown


@pytest.mark.parametrize("text", ["x  ", "true\u0085", " ", "null "])
def test_other_line_ends_need_no_quotes(spark, text):
    assert one(spark, toon.quoted(F.lit(text))) == text


@pytest.mark.parametrize("text, shown", [
    ("123456789012345678.12", "123456789012345678.12"), ("0.00", "0"), ("100.00", "100"), ("-5.50", "-5.5"), ("-0.01", "-0.01")])
def test_decimals_keep_their_digits(spark, text, shown):
    frame = spark.createDataFrame([(Decimal(text),)], "x decimal(30,2)")
    kind = toon.kind_of(frame.schema["x"].dataType)
    assert frame.select(toon.scalar_text(F.col("x"), kind).alias("x")).first().x == shown
    whole = spark.createDataFrame([(Decimal("100"),), (None,)], "x decimal(38,0)")
    assert [r.x for r in whole.select(toon.scalar_text(F.col("x"), toon.kind_of(whole.schema["x"].dataType)).alias("x")).collect()] == ["100", "null"]


@pytest.mark.parametrize("value, shown", [(0.1, "0.1"), (1.5, "1.5"), (16777216.0, "16777216"), (1e-7, "0.0000001"), (float("nan"), "null")])
def test_floats_keep_their_own_digits(spark, value, shown):
    frame = spark.createDataFrame([(value,)], "x float")
    assert frame.select(toon.scalar_text(F.col("x"), toon.kind_of(frame.schema["x"].dataType)).alias("x")).first().x == shown
    if value == value:
        assert profile.profile_columns(frame).first().min_value == shown
        assert profile.top_values(frame, ["x"], 1).first().value == shown


def test_instants_of_the_autumn_hour_are_two(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        first = int(datetime.datetime(2024, 11, 3, 5, 30, tzinfo=datetime.UTC).timestamp())
        frame = spark.range(2).select(F.timestamp_seconds(F.lit(first) + 3600 * F.col("id")).alias("x"))
        assert profile.profile_columns(frame).first().distinct_count == 2
        assert {r.value for r in profile.top_values(frame, ["x"], 5).collect()} == {"2024-11-03 01:30:00"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_inclusion_compares_in_the_common_type(spark):
    child = spark.createDataFrame([(1, 5, None, "7"), (2, 6, None, "x")], "a bigint, b int, c string, d string")
    parent = spark.createDataFrame([(Decimal("1.00"), 5.0, None, 7), (Decimal("2.50"), 6.0, None, 8)], "a decimal(10,2), b double, c string, d int")
    rows = profile.inclusion(child, parent, [(x, x) for x in "abcd"]).collect()
    found = {r.child_column: (r.child_values, r.included_values, r.inclusion_ratio) for r in rows}
    assert found == {"a": (2, 1, 0.5), "b": (2, 2, 1.0), "c": (0, 0, None), "d": (2, 1, 0.5)}


def test_expression_index_makes_no_key_unique(spark):
    base = "db_id long, schema_name string, table_name string"
    fks = spark.createDataFrame([(1, "s", "t", "fk", [])], "db_id long, from_schema string, from_table string, constraint_name string, from_columns array<string>")
    constraints = spark.createDataFrame([], f"{base}, constraint_type string, columns array<string>")
    indexes = spark.createDataFrame([(1, "s", "t", True, [])], f"{base}, is_unique boolean, columns array<string>")
    assert [r.fk_unique for r in with_fk_unique(fks, constraints, indexes).collect()] == [False]


def test_redaction_reaches_every_frame(spark, sf_dir):
    raw = fleet_raw(spark, sf_dir)
    plain, hidden = (snapshot(raw, SnapshotConfig(include_views=True, include_routines=True, redact_comments=r, redact_definitions=r)) for r in (False, True))
    names = [n for n in ("tables", "columns", "views", "routines", "enums", "sequences", "types", "triggers") if {"comment", "definition"} & set(plain[n].columns)]
    assert "routines" in names
    for name in names:
        for column in {"comment", "definition"} & set(plain[name].columns):
            filled = lambda frames: frames[name].where(F.coalesce(F.col(column), F.lit("")) != "").count()  # noqa: B023, E731
            assert filled(hidden) == 0, (name, column)


def test_components_of_long_chains_and_rings_take_few_rounds(spark, monkeypatch):
    from snapcat.operators import relations

    rounds, settle = [], relations.settle
    monkeypatch.setattr(relations, "settle", lambda frame: rounds.append(1) or settle(frame))
    name = lambda i: f"t{i:04d}"
    pairs = [(1, name(i), name(i + 1)) for i in range(24)] + [(1, name(i + 1), name(i)) for i in range(60, 84)]
    pairs += [(2, name(i), name((i + 1) % 40)) for i in range(40)] + [(2, "x", "x"), (2, name(5), "y"), (3, "a", "b"), (3, "b", "a"), (3, "b", "c")]
    edges = spark.createDataFrame([(d, "s", a, "s", b) for d, a, b in pairs], "db_id long, from_schema string, from_table string, to_schema string, to_table string")
    found = relations.strongly_connected(edges).collect()
    assert {(r.db_id, r.table_name) for r in found} == {(2, name(i)) for i in range(40)} | {(3, "a"), (3, "b")}
    assert {(r.db_id, r.component_table, r.component_size) for r in found} == {(2, name(39), 40), (3, "b", 2)}
    print(len(rounds))
    assert len(rounds) < 160


def test_rows_of_a_repeated_key_are_refused(spark):
    from snapcat.operators.toon_rows import toon_rows

    assert toon_rows(spark.range(10), "id", 5).count() == 2
    with pytest.raises(Exception, match="not unique"):
        toon_rows(spark.range(10).selectExpr("id % 2 AS id"), "id", 5).collect()
