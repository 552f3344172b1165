"""Row facts of many tables in one grouping: every type, long texts, empty tables, documents made of them."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from snapcat.operators import row_facts as r
from snapcat.plans import artifacts as art
from snapcat.plans import fragments as fr
from snapcat.plans.artifacts import Model
from snapcat.plans.row_stats import row_frames, with_row_facts
from snapcat.plans.snapshot import SnapshotConfig
from snapcat.sources.parquet import catalog_frames

TYPES = "i int, b boolean, d date, f float, x double, t timestamp, n timestamp_ntz, m decimal(30,2), s string, y binary, a array<int>"
DAY, TIME = datetime.date(2024, 2, 29), datetime.datetime(2024, 2, 29, 12, 30)
ROWS = [
    (3, True, DAY, 0.1, -0.0, TIME, TIME, decimal.Decimal("10.50"), "p" * 64 + "b", b"\x0f", [1, None]),
    (-3, False, None, 0.1, 0.0, None, TIME, decimal.Decimal("9.00"), "p" * 64 + "a", b"\xff", [1, None]),
    (None, None, None, None, float("nan"), None, None, None, "p" * 64, None, None),
    (3, None, DAY, 2.5, 1e300, TIME, TIME, decimal.Decimal("10.50"), None, b"\x0f", [2]),
]


def test_every_type(spark):
    df = spark.createDataFrame(ROWS, TYPES)
    out = {x.column_name: x for x in r.profile({(): df}).collect()}
    shown = {c: (x.min_value, x.max_value, x.distinct_count) for c, x in out.items()}
    assert shown == {
        "i": ("-3", "3", 2), "b": ("false", "true", 2), "d": ("2024-02-29", "2024-02-29", 1), "f": ("0.1", "2.5", 2), "x": ("0", "null", 3),
        "t": ("2024-02-29 12:30:00", "2024-02-29 12:30:00", 1), "n": ("2024-02-29 12:30:00", "2024-02-29 12:30:00", 1),
        # As numbers, not as texts; whole texts, not their first characters.
        "m": ("9.00", "10.50", 2), "s": ("p" * 64, "p" * 64 + "b", 3), "y": ("0F", "FF", 2), "a": (None, None, 2)}
    assert all(x.row_count == 4 for x in out.values()) and out["d"].null_fraction == 0.5
    assert {c: x.data_type for c, x in out.items()} == {f.name: f.dataType.simpleString() for f in df.schema}


def test_one_scan(spark, sf_dir):
    plan = r.profile({(): spark.read.parquet(f"{sf_dir}/lineitem.parquet").drop("l_returnflag", "l_linestatus")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_empty_tables_and_several(spark):
    one, none = spark.createDataFrame([(1, "x"), (1, None)], "k long, s string"), spark.createDataFrame([], "k long, s string")
    tables = {(0, "a", "one"): one, (0, "a", "none"): none, (7, "b", "one"): one.limit(1)}
    key = ["db_id", "schema_name", "table_name"]
    out = {(x.db_id, x.table_name, x.column_name): (x.row_count, x.null_fraction, x.min_value, x.distinct_count) for x in r.profile(tables, key).collect()}
    assert out[0, "one", "s"] == (2, 0.5, "x", 1) and out[0, "none", "k"] == (0, None, None, 0) and out[7, "one", "k"] == (1, 0.0, "1", 1) and len(out) == 6


def plain_top(rows, k):
    counts = {}
    for x in rows:
        if x is not None:
            counts[x] = counts.get(x, 0) + 1
    return sorted(counts.items(), key=lambda v: (-v[1], v[0]))[:k]


@pytest.mark.parametrize("most", [10_000, 0])
def test_frequent_long_texts(spark, monkeypatch, most):
    """Texts alike in their first characters; more of them tie than are wanted."""
    monkeypatch.setattr(r, "MOST_LOOKED_UP", most)
    same = "q" * 64
    texts = [same + c for c in "zyxwvu"] + [same] * 2 + ["a", None, same + "w", "q" * 63, "b" * 500]
    df = spark.createDataFrame([(t, k % 3) for k, t in enumerate(texts)], "s string, k int")
    for k in (1, 3, 5, 20):
        out = r.frequent({(): df}, r.counted(r.cells(df)), k).collect()
        found = {c: [(x.value, x.n) for x in sorted(out, key=lambda x: x.position) if x.column_name == c] for c in ("s", "k")}
        assert found["s"] == plain_top(texts, k)
        assert found["k"] == plain_top([str(i % 3) for i in range(len(texts))], k)


def text_of(frame):
    return {x.path: x.doc for x in fr.assemble(frame.select(*fr.FRAGMENT)).collect()}


def test_documents_from_rows(spark):
    """Facts from rows stand in where the catalog has none, and only there."""
    rows = [(k, "on" if k % 3 else "off, really", None if k == 2 else 0.5) for k in range(6)]
    tables = {(1, "public", name): spark.createDataFrame(rows, "id long, state string, cost double") for name in ("t", "known")}
    own = catalog_frames(tables)
    key = "db_id bigint, schema_name string, table_name string"
    own["column_stats"] = spark.createDataFrame([(1, "public", "known", "id", 0.25, 4)], f"{key}, column_name string, null_fraction double, distinct_count_estimate bigint")
    heads = [(1, "public", t, "then", "estimate", n, c, "note") for t, n, c in (("t", None, 0), ("known", 9, 1))]
    own["stats"] = spark.createDataFrame(heads, f"{key}, computed_at string, sampling_strategy string, row_count_estimate bigint, column_stat_count bigint, note string")
    model = Model(with_row_facts(own, row_frames(tables, "now", top=2)), SnapshotConfig(schemas=("public",), include_stats=True))
    docs = text_of(art.doc_stats(model))
    assert docs["1/public/tables/t/table.stats.toon"] == """computed_at: now
sampling_strategy: full_scan
row_count_estimate: 6
per_column_stats:
  cost:
    null_fraction: 0.16666666666666666
    distinct_count_estimate: 1
    min: 0.5
    max: 0.5
    top_values:[1]: 0.5
  id:
    null_fraction: 0
    distinct_count_estimate: 6
    min: 0
    max: 5
    top_values:[2]: 0,1
  state:
    null_fraction: 0
    distinct_count_estimate: 2
    min: "off, really"
    max: on
    top_values:[2]: on,"off, really\""""
    assert docs["1/public/tables/known/table.stats.toon"].startswith("computed_at: then\nsampling_strategy: estimate\nrow_count_estimate: 9\nper_column_stats:\n  id:\n    null_fraction: 0.25\n    distinct_count_estimate: 4\nnote: note")
    assert text_of(art.doc_comments(model))["1/public/tables/t/table.comments.toon"] == (
        "inferred_semantics:\n  enum_like_columns:[1]: state\n  status_columns:[1]: state\n  id_columns:[1]: id")


MIXED = (fr.Field("n", "integer"), fr.Field("s", omit="empty"))


def mixed(spark, elements):
    rows = [(1, "p", 0, "list", "", float(k), str(k), *e) for k, e in enumerate(elements)]
    kinds = "db_id bigint, path string, section int, list_name string, k1 string, ord double, k2 string, element string, scalar string, items array<string>, n bigint, s string"
    return text_of(fr.mixed_list(spark.createDataFrame(rows, kinds), MIXED))["p"]


def test_mixed_lists(spark):
    scalar, items = lambda x: ("scalar", x, None, None, None), lambda *x: ("list", None, list(x), None, None)
    thing = lambda n, s="": ("object", None, None, n, s)
    assert mixed(spark, [scalar("1"), scalar("null"), scalar('"a,b"')]) == 'list:[3]: 1,null,"a,b"'
    assert mixed(spark, [thing(1, "x"), thing(2, "y")]) == "list:[2]{n,s}:\n  1,x\n  2,y"
    assert mixed(spark, [thing(1, "x"), thing(2)]) == "list:[2]:\n  - \n    n: 1\n    s: x\n  - \n    n: 2"
    assert mixed(spark, [items("1", "2"), items()]) == "list:[2]:\n  - [2]: 1,2\n  - [0]:"
    assert mixed(spark, [scalar("x"), items("y"), thing(3)]) == "list:[3]:\n  - x\n  - [1]: y\n  - \n    n: 3"


def test_components_in_the_relationship_document(spark):
    key = "db_id bigint, table_name string, schema_name string"
    edges = [("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "a"), ("f", "f"), ("g", "a")]
    fks = spark.createDataFrame([(1, x, "public", [y + "_id"], y, "public", ["id"], f"{x}_{y}") for x, y in edges],
                                "db_id bigint, from_table string, from_schema string, from_columns array<string>, to_table string, to_schema string, to_columns array<string>, constraint_name string")
    names = spark.createDataFrame([(1, x, "public") for x in "abcdefg"] + [(2, "z", "public")], key)
    frames = {"foreign_keys": fks, "tables": names, "databases": spark.createDataFrame([(1,), (2,)], "db_id bigint")}
    model = Model(frames, SnapshotConfig(schemas=("public",)))
    model.__dict__["junctions"] = names.withColumn("is_junction", F.lit(False))
    docs = text_of(art.doc_graph(model))
    assert docs["1/db.relationships.toon"].endswith("strongly_connected_components:[2]:\n  - [2]: a,b\n  - [3]: c,d,e")
    assert "components" not in docs["2/db.relationships.toon"]
