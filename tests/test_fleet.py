"""Frames of the template fleet are sized as what they are, not as the customers that they come from."""

import pytest

from snapcat.registry import all_queries
from snapcat.sources.fleet import fleet_raw

DATABASES = 200_000


@pytest.fixture
def customers(spark, tmp_path):
    spark.range(DATABASES).selectExpr("id AS c_custkey", "'Customer#' || id AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


@pytest.fixture
def own_threshold(spark):
    """Spark's own limit on broadcasts by estimate, which a session of the caller has."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def planned(frame, capsys) -> str:
    frame.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", ["cat_column_comments", "doc_columns"])
def test_large_frames_are_not_broadcast(spark, customers, own_threshold, capsys, name):
    plan = planned(all_queries()[name](spark, customers), capsys)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_the_template_is_not_in_the_plan(spark, customers, capsys):
    """A template as a literal is a hundred kilobytes in every description of a plan that the driver keeps."""
    assert len(planned(fleet_raw(spark, customers)["info_columns"], capsys)) < 5000


def test_relations_hold_a_row_for_each_customer_and_template_row(spark, customers):
    raw = fleet_raw(spark, customers)
    assert raw["pg_namespace"].count() == 4 * DATABASES
    assert raw["info_tables"].where("(db_id + 1) % 7 = 0 AND table_name = 'users' AND table_schema = 'public'").isEmpty()
    assert raw["pg_class"].dtypes[:3] == [("db_id", "bigint"), ("oid", "bigint"), ("relname", "string")]
