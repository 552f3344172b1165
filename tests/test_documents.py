"""Groups G and I: whole documents of one database, long documents, paths and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from snapcat.functions import toon
from snapcat.plans import files
from snapcat.plans import fragments as fr
from snapcat.plans import sink
from snapcat.plans.artifacts import KINDS, Model
from snapcat.plans.paths import with_safe_name
from snapcat.plans.snapshot import SnapshotConfig, snapshot
from snapcat.session import settle
from snapcat.sources.fleet import SCHEMAS, fleet_raw

CFG = SnapshotConfig(schemas=SCHEMAS, include_views=True, include_routines=True, include_stats=True)


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    frames = snapshot({n: f.where("db_id = 2") for n, f in fleet_raw(spark, sf_dir).items()}, CFG)
    return Model({n: f for n, f in frames.items()}, CFG)


def docs_of(model, kind):
    rows = fr.assemble(settle(KINDS[kind][0](model).select(*fr.FRAGMENT))).collect()
    return {r.path: r.doc for r in rows}


def test_columns_document(model):
    docs = docs_of(model, "columns")
    assert docs["2/app/tables/users/table.columns.toon"] == (
        "columns:[6]{column_name,data_type,udt_name,nullable}:\n  id,bigint,int8,false\n  user_uuid,uuid,uuid,false\n"
        "  login_time,timestamp,timestamp,true\n  balance,money,money,false\n  plan,text,text,false\n  region,text,text,false"
    )
    assert docs["2/public/tables/roles/table.columns.toon"] == "columns:[2]{column_name,data_type,udt_name,nullable}:\n  id,bigint,int8,false\n  name,text,text,false"


def test_relations_document(model):
    docs = docs_of(model, "relations")
    assert docs["2/public/tables/profiles/table.relations.toon"] == (
        "outgoing_foreign_keys:[1]:\n  - \n    constraint_name: fk_profiles_1\n    from_columns:[1]: user_id\n    to_table: users\n"
        "    to_schema: public\n    to_columns:[1]: id\n    on_update: NO ACTION\n    on_delete: NO ACTION\n    nullable: false\n"
        "    cardinality: one-to-one\nincoming_foreign_keys:[0]:\njunction_table_detection:\n  is_junction: false"
    )


def test_constraints_document(model):
    docs = docs_of(model, "constraints")
    assert docs["2/public/tables/widgets/table.constraints.toon"].startswith(
        "primary_key:\n  constraint_name: pk_widgets\n  constraint_type: PRIMARY KEY\n  columns:[1]: id\n  definition: PRIMARY KEY (id)\n"
        "check_constraints:[1]{constraint_name,constraint_type,expression,definition}:\n  widgets_open,CHECK,CHECK (true),CHECK (true)\n"
        "not_null_constraints:[6]:\n  - \n    constraint_name: id_not_null"
    )


def test_domains_document(model):
    text = docs_of(model, "domains")["2/db.domains.toon"]
    assert text.startswith("domains:[9]:\n  - \n    domain_name: Analytics\n    tables:[1]: metrics\n  - \n    domain_name: Auth\n    tables:[4]: roles,user_roles,users,users\n")


def test_enum_documents(model):
    docs = docs_of(model, "enums")
    assert docs["2/public/enums/order_state.toon"] == "enum_name: order_state\nschema_name: public\nvalues:[3]: new,paid,shipped"
    assert docs["2/public/enums/mood.toon"] == "enum_name: mood\nschema_name: public\nvalues:[0]:"


def test_view_documents(model):
    deps = docs_of(model, "view_dependencies")
    assert deps["2/public/views/order_summary/view.dependencies.toon"] == "depends_on_tables:[2]: order_items,orders\ndepends_on_views:[1]: active_users"
    assert docs_of(model, "view_comments")["2/public/views/order_summary/view.comments.toon"] == ""


def test_overview(model):
    text = docs_of(model, "overview")["2/llms.txt"]
    assert text.startswith("# db_2 Schema Reference\n\nThis directory contains complete schema documentation for db_2 (postgresql 16.2).\n\n## Finding")
    assert "- **27 tables** across 2 schemas (public, app)\n- **2 views**\n- **3 enums**\n- **5 routines**\n\n## Table Index\n\n**Core** (central entities): `users`\n\n**Tables**: `users`, " in text
    assert text.endswith("- `users` ← referenced by 7 tables\n- `orders` ← referenced by 2 tables\n\n## Enum Quick Reference\n\n- **tier**: `free`, `pro plan`\n- **mood**: ``\n- **order_state**: `new`, `paid`, `shipped`\n\n")


def test_long_documents_are_whole_in_parts(spark):
    """One document with a third of all fragments, cut into parts; nothing lost, order kept."""
    rows = [(1, "hot", 0, "", float(i), "", f"\nline {i}") for i in range(3000)]
    rows += [(1, f"d{i % 600}", 0, "", float(i), "", f"\nrow {i}") for i in range(6000)]
    kinds = "db_id bigint, path string, section int, k1 string, ord double, k2 string, text string"
    frame = settle(spark.createDataFrame(rows, kinds))
    docs = fr.assemble(frame).collect()
    hot = sorted((r.part, r.doc) for r in docs if r.path == "hot")
    assert [part for part, _ in hot] == [0, 1, 2]
    assert "".join(text for _, text in hot) == "\n".join(f"line {i}" for i in range(3000))
    assert {r.part for r in docs if r.path != "hot"} == {0}
    whole = {r.path: r.doc for r in docs}
    assert whole["d7"] == "\n".join(f"row {i}" for i in range(7, 6000, 600))


def test_paths_of_equal_safe_names(spark):
    names = ["Order  Details!", "order_details", "order-details"]
    df = spark.createDataFrame([(1, "p", n) for n in names], "db_id bigint, schema_name string, table_name string")
    got = {r.table_name: r.safe for r in with_safe_name(df, F.col("table_name"), F.col("table_name")).collect()}
    assert got["order_details"] == "order_details"
    assert got["order-details"] == "order_details__" + b"order-details".hex()
    assert len(set(got.values())) == 3


def test_redaction(spark, sf_dir):
    raw = {n: f.where("db_id = 2") for n, f in fleet_raw(spark, sf_dir).items()}
    cfg = SnapshotConfig(schemas=SCHEMAS, include_views=True, include_routines=True, redact_comments=True, redact_definitions=True)
    frames = snapshot(raw, cfg)
    assert frames["views"].where("definition IS NOT NULL OR comment <> ''").isEmpty()
    assert frames["routines"].where("definition IS NOT NULL").isEmpty()
    assert frames["triggers"].where("definition IS NOT NULL").isEmpty()
    assert frames["enums"].where("comment <> ''").isEmpty()
    comments = docs_of(Model(frames, cfg), "comments")["2/public/tables/orders/table.comments.toon"]
    assert comments.startswith("inferred_semantics:") and "Gross" not in comments


def test_sinks(spark, model, tmp_path):
    kinds = {k: KINDS[k][0](model) for k in ("structure", "sequences")}
    sink.write_fragments(kinds, str(tmp_path / "fragments"))
    sink.write_docs(spark, str(tmp_path / "fragments"), str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    want = {**docs_of(model, "structure"), **docs_of(model, "sequences")}
    assert {r.path: r.doc for r in docs.collect()} == want
    sink.write_text(docs, str(tmp_path / "text"))
    found = {str(f.relative_to(tmp_path / "text")): f.read_text() for f in (tmp_path / "text").rglob("*") if f.is_file() and not f.name.startswith("_")}
    assert {p: t for p, t in found.items() if not p.rpartition("/")[2].startswith(".")} == want
    counts = json.loads((tmp_path / "text/_SUCCESS").read_text())
    assert counts == {"documents": len(want), "bytes": sum(len(t.encode()) for t in want.values())}


def test_files_at_odd_paths(spark, tmp_path):
    """Parts out of order, paths that point elsewhere, names that need care in addresses, empty and null documents, a second run."""
    rows = [("a/b+c %d.toon", 1, "two\n"), ("a/b+c %d.toon", 0, "one "), ("../x/./y", 0, "é"), ("/q//r", 0, ""), ("n", 0, None), (None, 0, "z")]
    docs = spark.createDataFrame(rows, "path string, part int, doc string")
    for _ in range(2):
        files.write_files(docs, str(tmp_path / "out"))
    want = {"a/b+c %d.toon": "one two\n", "%2E%2E/x/%2E/y": "é", "q/r": ""}
    on_disk = {str(f.relative_to(tmp_path / "out")): f.read_text() for f in (tmp_path / "out").rglob("*") if f.is_file() and f.name[0] not in "_."}
    assert on_disk == want
    assert not [f for f in (tmp_path / "out").rglob(".*") if not f.name.endswith(".crc")]
    # Spark's reader has no row for an empty file.
    assert {r.path: r.doc for r in files.read_files(str(tmp_path / "out"), spark).collect()} == {p: t for p, t in want.items() if t}


def test_failed_files_leave_no_mark(spark, tmp_path):
    (tmp_path / "out/a").mkdir(parents=True)
    (tmp_path / "out/a/b").write_text("a file where a folder is needed")
    with pytest.raises(Exception):  # noqa: B017
        files.write_files(spark.createDataFrame([("a/b/c", 0, "x")], files.SCHEMA), str(tmp_path / "out"))
    assert not (tmp_path / "out/_SUCCESS").exists()
    files.write_files(spark.createDataFrame([], files.SCHEMA), str(tmp_path / "none"))
    assert json.loads((tmp_path / "none/_SUCCESS").read_text()) == {"documents": 0, "bytes": 0}


def test_positions_of_short_and_long_documents(spark, monkeypatch):
    """Whether a document goes through one task or by ranges, its places are the same; short ones are shuffled once."""
    rows = [(db, f"{db}/x", k % 3, f"k{k % 5}", float(k % 7), str(k), f"t{k}") for db, n in ((1, 40), (2, 3), (3, 11)) for k in range(n)]
    rows.append((4, None, 0, "", 0.0, "", "nowhere"))
    frame = spark.createDataFrame(rows, "db_id bigint, path string, section int, k1 string, ord double, k2 string, text string")
    want = [(r[0], r[1], n, r[6]) for db in (1, 2, 3) for n, r in enumerate(sorted(x for x in rows if x[0] == db), 1)]
    for most in (0, 5, 100_000):
        monkeypatch.setattr(fr, "LONG_DOCUMENT", most)
        placed = fr.with_positions(frame)
        assert sorted((r.db_id, r.path, r.position, r.text) for r in placed.collect()) == sorted(want)
    assert placed._jdf.queryExecution().executedPlan().toString().rpartition("Initial Plan")[2].count("Exchange") == 1


def test_heads_of_named_lists(spark):
    """A list that is named has a head with its count, whether it has rows or not, and one for each time it is named."""
    rows = spark.createDataFrame([(1, "a", 0, "l", "", 0.0, "x", "v")] * 2, "db_id bigint, path string, section int, list_name string, k1 string, ord double, k2 string, name string")
    docs = spark.createDataFrame([(1, "a", 0, "l"), (1, "b", 0, "l"), (1, "b", 0, "l"), (2, None, 0, "l")], "db_id bigint, path string, section int, list_name string")
    heads = fr.object_list(rows, (toon.Field("name"),), docs).where(F.col("ord") == fr.FIRST)
    assert sorted((r.db_id, r.path or "", r.text) for r in heads.collect()) == [(1, "a", "\nl:[2]{name}:"), (1, "b", "\nl:[0]:"), (1, "b", "\nl:[0]:"), (2, "", "\nl:[0]:")]
