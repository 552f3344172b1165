"""Sketches kept by part and merged against sketches of all rows at once, and against exact figures."""

import datetime

from pyspark.sql import functions as F

from snapcat.operators import sketches as k
from snapcat.session import settle


def by_column(frame):
    return {r.column_name: r for r in frame.collect()}


def test_merged_equals_at_once(spark):
    n = 60_000
    df = spark.range(n).select(
        (F.col("id") % 30).alias("day"), (F.col("id") * 7919 % 20_011).alias("many"), F.when(F.col("id") % 4 > 0, F.col("id") / 7).alias("x"),
        F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100)).alias("s"), F.lit(None).cast("date").alias("none"))
    kept = settle(k.sketch_columns(df, ["day"]))
    assert kept.count() == 30 * 4
    merged, once = by_column(k.estimates(k.merge(kept))), by_column(k.estimates(k.sketch_columns(df.drop("day"))))
    for c, r in merged.items():
        o = once[c]
        assert (r.row_count, r.null_fraction) == (o.row_count, o.null_fraction) == (n, {"x": 0.25, "none": 1.0}.get(c, 0.0))
        # A union of sketches is read out a little differently than a sketch that saw all values.
        assert abs(r.distinct_count - o.distinct_count) <= 0.03 * max(1, o.distinct_count)
    assert [abs(merged[c].distinct_count - e) <= k.DISTINCT_ERROR * e for c, e in (("many", 20_011), ("x", 45_000), ("s", 100))] == [True] * 3
    for q, rank in zip(merged["x"].quantiles, (0.25, 0.5, 0.75), strict=True):
        assert abs(q / (n / 7) - rank) <= 2 * k.RANK_ERROR
    # Fewer values than are tracked: counts are exact.
    assert tuple(merged["s"].frequent[0]) == ("s0", df.where("s = 's0'").count())
    assert merged["s"].quantiles is None and merged["none"].frequent is None and merged["none"].distinct_count == 0


def test_coarser_parts(spark):
    day = datetime.date(2024, 1, 1)
    df = spark.createDataFrame([(day + datetime.timedelta(days=i % 60), i) for i in range(600)], "day date, v int")
    kept = settle(k.sketch_columns(df, ["day"])).withColumn("month", F.trunc("day", "month"))
    months = {r.month.month: r for r in k.estimates(k.merge(kept, ["month"])).collect()}
    assert {m: r.row_count for m, r in months.items()} == {1: 310, 2: 290} and abs(months[1].distinct_count - 310) <= 16


def test_empty(spark):
    assert k.estimates(k.merge(k.sketch_columns(spark.createDataFrame([], "a int, b string")))).count() == 0


def test_rows_are_grouped_not_cells(spark, capsys):
    df = spark.range(10).selectExpr("id % 2 AS day", "id AS a", "CAST(NULL AS string) AS b")
    kept = k.sketch_columns(df, ["day"])
    kept.explain()
    plan = capsys.readouterr().out
    # Rows become one per column after the aggregation, so above it in the plan.
    assert 0 <= plan.index("Generate inline") < plan.index("Aggregate")
    out = by_column(k.estimates(k.merge(kept)))
    assert (out["a"].row_count, out["b"].null_fraction, out["b"].frequent) == (10, 1.0, None)
