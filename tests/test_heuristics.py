"""Groups B to F: the known cases of each rule, and the full template's facts."""

import collections
import random

import pytest
from pyspark.sql import functions as F
from schemas import frames

from snapcat.operators import domains, overview, relations, semantics, tags
from snapcat.operators.facts import table_facts, tag_facts
from snapcat.registry import facts
from snapcat.sources.fleet import template_frames


def facts_of(f):
    return relations.junctions(table_facts(f["tables"], f["columns"], f["constraints"], f["foreign_keys"]))


@pytest.fixture(scope="module")
def small(spark):
    two = [(["a_id"], "a"), (["b_id"], "b")]
    body = ["id", "a_id", "b_id"]
    return frames(spark, {
        "user_roles": {"cols": ["user_id", "role_id"], "pk": ["user_id", "role_id"],
                       "fks": [(["user_id"], "users"), (["role_id"], "roles")]},
        "project_members": {"cols": ["id", "a_id", "b_id", "created_at"], "pk": ["id"], "fks": two},
        **{n: {"cols": [*body, "x", "y"], "pk": ["id"], "fks": two}
           for n in ("user_to_group", "post_has_tag", "item_x_category", "order_link_product")},
        "wide_map_table": {"cols": [*body, "c", "d", "e"], "pk": ["id"], "fks": two},
        "orders": {"cols": ["id", "user_id", "total", "status", "created", "notes"], "pk": ["id"], "fks": [(["user_id"], "users")]},
        "settings": {"cols": ["id", "name", "value"], "pk": ["id"]},
        "transactions": {"cols": [*body, *"cdefghi"], "pk": ["id"], "fks": two},
        "users": {"cols": ["id", "email"], "incoming": 3},
        "currencies": {"cols": ["id", "code", "name"], "incoming": 1},
        **{n: {"cols": ["id"]} for n in ("order_status", "user_types", "product_category", "payment_kinds", "ref_countries",
                                         "lookup_currencies", "user_audit", "order_history", "app_config", "user_settings",
                                         "access_log", "user_events", "catalog_items", "empty_one")},
        "changes": {"cols": ["id", "action", "old_value", "new_value"]},
        "properties": {"cols": ["id", "key", "value"]},
        "activity": {"cols": ["id", "event_type", "timestamp"]},
        "no_columns": {},
    })


@pytest.fixture(scope="module")
def tagged(small):
    rows = tags.table_tags(tags.tag_flags(facts_of(small))).collect()
    return {r.table_name: r for r in rows}


def test_junctions(tagged):
    reasons = {n: r.junction_reasoning for n, r in tagged.items() if r.is_junction}
    assert reasons == {
        "user_roles": relations.REASON_KEY,
        **{n: relations.REASON_FEW for n in ("project_members", "user_to_group", "post_has_tag", "item_x_category", "order_link_product")},
        "wide_map_table": relations.REASON_NAME,
    }


@pytest.mark.parametrize(("tag", "names"), [
    ("core", {"users"}),
    ("audit", {"user_audit", "order_history", "changes", "access_log"}),
    ("config", {"app_config", "user_settings", "properties", "settings"}),
    ("log", {"access_log", "user_events", "activity", "catalog_items"}),
])
def test_tags(tagged, tag, names):
    assert {n for n, r in tagged.items() if tag in r.tags} == names


def test_lookup(tagged):
    found = {n for n, r in tagged.items() if "lookup" in r.tags}
    assert found >= {"order_status", "user_types", "product_category", "payment_kinds", "ref_countries", "lookup_currencies",
                     "currencies", "properties", "users"}
    assert not found & {"orders", "no_columns", "transactions"}
    assert tagged["no_columns"].tags == []
    assert tagged["access_log"].tags == ["audit", "log"]


def test_unique_and_cardinality(spark):
    f = frames(spark, {
        "child": {"cols": ["a", "b", "c"], "pk": ["a", "b"], "unique": [["c"]],
                  "fks": [(["b", "a"], "p"), (["c"], "p"), (["a"], "p"), (["a", "a"], "p"), (["c", "c"], "p")]},
    })
    unique = relations.with_fk_unique(f["foreign_keys"], f["constraints"], f["indexes"])
    assert {r.constraint_name: r.fk_unique for r in unique.collect()} == {
        "fk_child_0": True, "fk_child_1": True, "fk_child_2": False,
        # A repeated column matches keys of the same width that hold it.
        "fk_child_3": True, "fk_child_4": False,
    }


def test_incoming_ignores_targets_out_of_scope(spark):
    f = frames(spark, {"a": {"cols": ["id"], "fks": [(["id"], "a"), (["id"], "gone")]}})
    assert [r.to_table for r in relations.incoming(f["foreign_keys"], f["tables"]).collect()] == ["a"]


def components(edges):
    """Brute force: mutual reachability."""
    reach = collections.defaultdict(set)
    nodes = {n for e in edges for n in e}
    for start in nodes:
        todo = [start]
        while todo:
            for a, b in edges:
                if a == todo[0] and b not in reach[start]:
                    reach[start].add(b)
                    todo.append(b)
            todo.pop(0)
    groups = {frozenset({n} | {m for m in reach[n] if n in reach[m]}) for n in nodes}
    return {g for g in groups if len(g) > 1}


def test_scc_against_brute_force(spark):
    rng = random.Random(5)
    edges = {db: {(f"t{rng.randrange(9)}", f"t{rng.randrange(9)}") for _ in range(rng.randrange(4, 14))} for db in range(6)}
    edges[6] = {(f"t{i}", f"t{i + 1}") for i in range(8)}  # a chain holds none
    rows = [(db, "public", a, "public", b) for db, pairs in edges.items() for a, b in pairs]
    df = spark.createDataFrame(rows, "db_id bigint, from_schema string, from_table string, to_schema string, to_table string")
    found = collections.defaultdict(set)
    for r in relations.strongly_connected(df).collect():
        found[(r.db_id, r.component_table)].add(r.table_name)
    got = {db: {frozenset(g) for (d, _), g in found.items() if d == db} for db in edges}
    assert got == {db: components(pairs) for db, pairs in edges.items()}


def test_scc_without_cycles(spark):
    df = spark.createDataFrame([(1, "p", "a", "p", "b")], "db_id bigint, from_schema string, from_table string, to_schema string, to_table string")
    assert relations.strongly_connected(df).count() == 0


@pytest.mark.parametrize(("name", "prefix"), [
    ("Order_Items", "order"), ("ab_x", None), ("_abc_d", None), ("abc_", None), ("abc", None), ("abc_d_e", "abc"),
])
def test_domain_prefix(spark, name, prefix):
    assert spark.range(1).select(domains.name_prefix(F.lit(name))).first()[0] == prefix


def test_template_facts(spark):
    """What the rules give on the whole template."""
    f = template_frames(spark)
    flags = tags.table_tags(tags.tag_flags(facts_of(f))).collect()
    name = {(r.schema_name, r.table_name): r for r in flags}
    assert len(flags) == 31
    assert {k[1] for k, r in name.items() if r.is_junction} == {"user_roles", "invoices", "project_members", "post_has_tag"}
    assert {k for k, r in name.items() if r.core} == {("public", "users")}
    assert {k[1] for k, r in name.items() if r.lookup} == {"users", "roles", "order_status", "properties", "countries"}
    assert not name[("app", "users")].lookup
    assert {k[1] for k, r in name.items() if r.audit} == {"access_log", "changes"}
    assert {k[1] for k, r in name.items() if r.log} == {"access_log", "activity", "catalog_items"}
    assert {k[1] for k, r in name.items() if r.config} == {"app_settings", "properties"}
    assert {k: r.fk_in for k, r in name.items() if r.fk_in} == {
        ("public", "users"): 9, ("public", "orders"): 2, ("public", "posts"): 2, ("public", "roles"): 1, ("public", "projects"): 1,
        ("public", "catalog_items"): 1, ("public", "widgets"): 1, ("public", "departments"): 1, ("public", "employees"): 1,
        ("app", "users"): 1,
    }
    flags_df = tags.tag_flags(facts_of(f))
    starts = [(r.table_name, r.score) for r in overview.start_tables(flags_df).orderBy("position").collect()]
    assert starts == [("users", 21), ("orders", 4), ("posts", 4), ("users", 2), ("catalog_items", 2)]
    points = [(r.table_name, r.fk_in) for r in overview.entry_points(flags_df).orderBy("position").collect()]
    assert points == [("users", 9), ("orders", 2), ("posts", 2)]
    grouped = collections.defaultdict(set)
    for r in domains.table_domains(f["tables"]).collect():
        grouped[r.domain].add(r.table_name)
    assert grouped["Order"] == {"order_details", "order_items", "order_status"}
    assert grouped["Auth"] == {"users", "roles", "user_roles"}
    assert grouped["Commerce"] == {"catalog_items", "orders", "Order  Details!", "product_comments"}
    assert grouped["System"] == {"schema_migrations"}
    assert len(grouped["Other"]) == 14


def test_column_semantics(spark):
    cases = [("id", "text"), ("user_id", "text"), ("session_uuid", "text"), ("identifier", "text"), ("created_at", "text"),
             ("birth_date", "text"), ("updated", "text"), ("any", "timestamp with time zone"), ("day", "date"), ("status", "text"),
             ("payment_state", "text"), ("status_count", "text"), ("amount", "numeric"), ("total_price", "decimal(10,2)"),
             ("order_cost", "money"), ("amount2", "text"), ("name", "numeric"), ("ID", "text")]
    df = spark.createDataFrame([(1, "p", "t", n, c, k) for n, (c, k) in enumerate(cases)],
                               "db_id bigint, schema_name string, table_name string, ordinal_position int, column_name string, data_type string")
    row = semantics.column_semantics(df).first()
    assert row.id_columns == ["id", "user_id", "session_uuid"]
    assert row.timestamp_columns == ["created_at", "birth_date", "updated", "any", "day"]
    assert row.status_columns == ["status", "payment_state"]
    assert row.currency_amount_columns == ["amount", "total_price", "order_cost"]
    assert semantics.column_semantics(df.where("column_name = 'name'")).count() == 0


@pytest.mark.parametrize(("schemas", "text"), [
    (["public"], "`public` schema"), (["public", "app"], "2 schemas (public, app)"), (["a", "b", "c"], "3 schemas (a, b, c)"), ([], "0 schemas ()"),
])
def test_schema_list(spark, schemas, text):
    column = F.array(*(F.lit(s) for s in schemas)).cast("array<string>")
    assert spark.range(1).select(overview.schema_list(column)).first()[0] == text


def test_short_description(spark):
    df = spark.createDataFrame([("",), ("x" * 200,), ("y" * 201,)], "c string").select(overview.short_description(F.col("c")).alias("d"))
    assert [r.d for r in df.collect()] == [None, "x" * 200, "y" * 197 + "..."]


def test_tags_by_their_own_facts(small, spark):
    """Each tag out of the facts it draws on, with repeated rows, is that of all facts."""
    twice = {n: small[n].unionByName(small[n]) for n in ("tables", "columns", "constraints", "foreign_keys")}
    odd = spark.createDataFrame([(1, "public", "changes", "Action")], "db_id bigint, schema_name string, table_name string, column_name string")
    for f in (small, twice, {**twice, "columns": small["columns"].select(*odd.columns).unionByName(odd)}):
        flags = tags.tag_flags(facts_of(f)).collect()
        for tag, rule in tags.RULES.items():
            own = tag_facts(tag, f["tables"], f["columns"], f["foreign_keys"])
            assert {r.table_name: r.on for r in own.select("table_name", rule().alias("on")).collect()} == {r.table_name: r[tag] for r in flags}, tag


@pytest.mark.parametrize(("tag", "shuffles"), [("lookup", 1), ("audit", 2)])
def test_rows_of_a_tag_are_shuffled_by_table(tag, shuffles, small, capsys):
    facts.tag_query(tag)(facts.Fleet(small)).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == shuffles


def test_rows_of_a_table_are_shuffled_once(spark, capsys):
    """Facts of names and of tables come out of one shuffle by table; ends of foreign keys are counted before it."""
    f = template_frames(spark)
    table_facts(f["tables"], f["columns"], f["constraints"], f["foreign_keys"]).explain()
    # The keys of one database lie in one task, where their ends are counted without a shuffle.
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


def test_foreign_keys_are_shuffled_once_for_their_cardinality(spark, capsys):
    """Uniqueness goes by table, as junctions do, so a foreign key is dealt out once for both."""
    f = template_frames(spark)
    unique = relations.with_fk_unique(f["foreign_keys"], f["constraints"], f["indexes"])
    unique.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2
