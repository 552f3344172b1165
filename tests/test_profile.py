"""Group V on small tables with NULLs and hot values."""

from pyspark.sql import functions as F

from snapcat.operators import profile
from snapcat.operators.toon_rows import toon_ranked


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def sample(spark):
    data = [(1, "a", 1.5), (2, "a", None), (2, "b", 0.0), (None, "a", -0.0), (5, None, 1e7)]
    return spark.createDataFrame(data, "k int, s string, x double")


def test_profile(spark):
    got = {r.column_name: r for r in profile.profile_columns(sample(spark)).collect()}
    assert (got["k"].row_count, got["k"].null_fraction, got["k"].distinct_count, got["k"].min_value, got["k"].max_value) == (5, 0.2, 3, "1", "5")
    assert (got["s"].distinct_count, got["s"].min_value, got["s"].max_value) == (2, "a", "b")
    assert (got["x"].distinct_count, got["x"].min_value, got["x"].max_value) == (3, "0", "10000000")


def test_profile_estimate_is_close(spark):
    df = spark.range(10_000).withColumn("g", F.col("id") % 100)
    got = {r.column_name: r for r in profile.profile_columns(df, exact=False).collect()}
    assert abs(got["g"].distinct_count - 100) <= 15
    assert got["id"].min_value == "0"


def test_profile_of_no_rows(spark):
    got = profile.profile_columns(sample(spark).where("false")).collect()
    assert {(r.row_count, r.null_fraction, r.distinct_count, r.min_value) for r in got} == {(0, None, 0, None)}


def test_top_values(spark):
    got = rows(profile.top_values(sample(spark), ["s", "x"], 2).select("column_name", "value", "n", "position"))
    assert got == [("s", "a", 3, 1), ("s", "b", 1, 2), ("x", "0", 2, 1), ("x", "1.5", 1, 2)]


def test_enum_like(spark):
    df = sample(spark).withColumn("t", F.col("x").cast("string"))
    assert [(r.column_name, r.values) for r in profile.enum_like_columns(df, 2).collect()] == [("s", ["a", "b"])]


def test_check_key(spark):
    assert tuple(profile.check_key(sample(spark), ["k"]).first()) == (5, 3, 1, 1, False)
    assert tuple(profile.check_key(sample(spark).where("k <> 2"), ["k", "s"]).first()) == (2, 1, 0, 1, False)
    assert profile.check_key(spark.range(5), ["id"]).first().holds


def test_check_fk(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    got = profile.check_fk(sample(spark), ["k"], parent, ["id"]).first()
    assert tuple(got) == (5, 1, 1, 1, 2, "many-to-one")
    assert profile.check_fk(parent.distinct(), ["id"], parent, ["id"]).first().cardinality == "one-to-one"


def test_checks_pass_on_null(spark):
    got = rows(profile.check_rows(sample(spark), {"small": F.col("x") < 5, "known": F.col("s") == "a"}))
    assert got == [("known", 5, 1, False), ("small", 5, 1, False)]


def test_density(spark):
    assert tuple(profile.key_density(sample(spark), "k").first()) == (1, 5, 3, 2)


def test_inclusion(spark):
    parent = spark.createDataFrame([(1,), (2,), (9,)], "id bigint")
    got = rows(profile.inclusion(sample(spark), parent, [("k", "id"), ("s", "id")]))
    assert got == [("k", "id", 3, 2, 2 / 3), ("s", "id", 2, 0, 0.0)]


def test_one_hot_value(spark):
    """A value that fills a third of the table leaves every count exact."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    assert tuple(profile.check_key(df, ["k"]).first()) == (30_000, 20_001, 1, 0, False)
    assert profile.top_values(df, ["k"], 1).first().n == 10_000


def test_documents_over_any_key(spark):
    """A hot key, NULLs and equal rows: consecutive rows of equal documents, nothing refused."""
    data = [(None if k % 7 == 0 else "hot" if k % 3 else f"k{k}", k // 2) for k in range(200)]
    docs = toon_ranked(spark.createDataFrame(data, "s string, n int").repartition(5), ["s"], 30).collect()
    lines = [line.strip() for d in sorted(docs, key=lambda d: d.chunk) for line in d.doc.split("\n")[1:]]
    assert lines == [line for _, line in sorted(((s is not None, s or ""), f"{'null' if s is None else s},{n}") for s, n in data)]
    assert [d.row_count for d in sorted(docs, key=lambda d: d.chunk)] == [30] * 6 + [20] and docs[0].doc.startswith(f"[{docs[0].row_count}]{{s,n}}:")
    assert toon_ranked(spark.createDataFrame([], "s string"), ["s"], 3).count() == 0
