"""A fleet of databases derived from ``customer``: one database per customer.

Each relation is a template (rows of literals) that every customer row meets,
plus column expressions written in SQL that Spark and DuckDB both accept.
Nothing is shuffled to build it, so the fleet grows with the customer table
alone. ``duckdb_cte`` renders the same relation for the oracle queries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.sources.lazy import LazyFrames
from snapcat.sources.relations import CATALOG_COLUMNS

# Ord | schema.table | column:type[?] | primary key | unique | foreign keys.
TEMPLATE = """
1 | public.users | id:bigint,email:text,name:text?,status:text,created_at:timestamp | id | email |
2 | public.roles | id:bigint,name:text | id | |
3 | public.user_roles | user_id:bigint,role_id:bigint | user_id,role_id | | user_id>public.users(id);role_id>public.roles(id)
4 | public.projects | id:bigint,owner_id:bigint?,title:text,budget_amount:numeric,start_date:date?,state:text | id | | owner_id>public.users(id)
5 | public.project_members | id:bigint,project_id:bigint,member_id:bigint,created_at:timestamp | id | | project_id>public.projects(id);member_id>public.users(id)
6 | public.post_has_tag | id:bigint,left_id:bigint,right_id:bigint,extra_data:text?,more_data:text?,third_data:text? | id | | left_id>public.posts(id);right_id>public.widgets(id)
7 | public.transactions | id:bigint,from_account_id:bigint,to_account_id:bigint,amount:numeric,currency:text,description:text?,status:text,processed_at:timestamp?,reference_number:text,notes:text? | id | | from_account_id>public.users(id);to_account_id>public.users(id)
8 | public.profiles | user_id:bigint,bio:text? | user_id | | user_id>public.users(id)
9 | public.order_status | code:text,label:text | code | |
10 | public.access_log | id:bigint,user_id:bigint?,path:text | id | | user_id>public.users(id)
11 | public.app_settings | setting_key:text,setting_value:text? | setting_key | |
12 | public.activity | id:bigint,event_type:text,timestamp:timestamp,payload:text? | id | |
13 | public.changes | id:bigint,action:text,old_value:text?,new_value:text? | id | |
14 | public.properties | id:bigint,key:text,value:text? | id | |
15 | public.catalog_items | id:bigint,sku:text,unit_cost:numeric,stock:integer,shelf:text,bin:text | id | sku |
16 | public.countries | id:bigint,code:text,name:text | id | code |
17 | public.orders | id:bigint,user_id:bigint,status:text,total:numeric,placed_at:timestamp,updated:text? | id | | user_id>public.users(id)
18 | public.order_items | order_id:bigint,line_no:integer,item_id:bigint?,price:numeric,qty:integer,note:text? | order_id,line_no | | order_id>public.orders(id);item_id>public.catalog_items(id)
19 | public.posts | id:bigint,author_id:bigint,body:text,parent_id:bigint?,created:timestamp,slug:text,lang:text,draft:boolean,views:bigint | id | slug | author_id>public.users(id);parent_id>public.posts(id)
20 | public.schema_migrations | version:text | version | |
21 | public.widgets | id:bigint,a:text,b:text,c:text,d:text,e:text | id | |
22 | public.departments | id:bigint,title:text,head_id:bigint?,floor:integer,budget:numeric,city:text | id | head_id | head_id>public.employees(id)
23 | public.employees | id:bigint,department_id:bigint,full_title:text,hired_date:date,salary:numeric,grade:text | id | | department_id>public.departments(id)
24 | public.Order  Details! | id:bigint,order_id:bigint,memo:text,k1:text,k2:text,k3:text | id | | order_id>public.orders(id)
25 | app.users | id:bigint,user_uuid:uuid,login_time:timestamp?,balance:money,plan:text,region:text | id | user_uuid |
26 | app.empty_shell | | | |
27 | app.invoices | id:bigint,user_id:bigint,amount:numeric,due_date:date,state:text,ref:text | id | | user_id>app.users(id);id>other.ledger(id)
28 | public.product_comments | id:bigint,body:text,rank:integer,p1:text,p2:text,p3:text | id | |
29 | public.notifications | id:bigint,body:text,sent:boolean,q1:text,q2:text,q3:text | id | |
30 | public.metrics | id:bigint,reading:double precision,r1:text,r2:text,r3:text,r4:text | id | |
31 | public.order_details | id:bigint,memo:text,s1:text,s2:text,s3:text,s4:text | id | |
"""

SCHEMAS = ("public", "app")

# Identifiers used by the template.
NAMESPACES = {"public": 2200, "app": 2300, "other": 2400, "pg_catalog": 11}
ACCESS_METHODS = {"btree": 403, "gin": 2742}
LANGUAGES = {"plpgsql": 13000, "sql": 14}
LEDGER_OID = 19001

DROP_RULE = "(db_id + ord) % 7 <> 0"
ROW_COUNT = "(db_id * 37 + ord * 101) % 100000"

DUCKDB_TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "array<string>": "VARCHAR[]",
    "array<int>": "INTEGER[]",
}
ARROW_TYPES = {
    "string": pa.string(),
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "array<string>": pa.list_(pa.string()),
    "array<int>": pa.list_(pa.int32()),
}


@dataclass
class Column:
    name: str
    type: str
    nullable: bool


@dataclass
class TemplateTable:
    ord: int
    schema: str
    name: str
    columns: list[Column]
    primary_key: list[str]
    unique: list[list[str]]
    # (from columns, schema, table, to columns)
    foreign_keys: list[tuple[list[str], str, str, list[str]]]

    @property
    def oid(self) -> int:
        return 10000 + self.ord

    def attnums(self, names: list[str]) -> list[int]:
        positions = [c.name for c in self.columns]
        return [positions.index(name) + 1 for name in names]


@dataclass
class Relation:
    """Template rows, their types, and the output columns as shared-dialect SQL."""

    fields: dict[str, str]
    rows: list[tuple]
    select: dict[str, str] = field(default_factory=dict)
    where: str = "true"

    def output(self) -> dict[str, str]:
        chosen = {name: name for name in self.fields if name != "ord"}
        chosen.update(self.select)
        return chosen


def _parse(text: str) -> list[TemplateTable]:
    tables = []
    for line in text.strip().splitlines():
        ord_, full, cols, pk, unique, fks = (part.strip() for part in line.split("|"))
        schema, name = full.split(".", 1)
        columns = [
            Column(n, t.removesuffix("?"), t.endswith("?"))
            for n, t in (c.split(":") for c in cols.split(",") if c)
        ]
        keys = []
        for fk in filter(None, fks.split(";")):
            source, target = fk.split(">")
            target, to_cols = target.removesuffix(")").split("(")
            to_schema, to_table = target.split(".")
            keys.append((source.split(","), to_schema, to_table, to_cols.split(",")))
        tables.append(
            TemplateTable(
                int(ord_),
                schema,
                name,
                columns,
                [c for c in pk.split(",") if c],
                [u.split(",") for u in unique.split(";") if u],
                keys,
            )
        )
    return tables


TABLES = _parse(TEMPLATE)
BY_NAME = {(t.schema, t.name): t for t in TABLES}

LONG_COMMENT = "One row per person who can sign in. " * 7

# Comments by (schema, table) and by (schema, table, column).
TABLE_COMMENTS = {
    ("public", "users"): LONG_COMMENT.strip(),
    ("public", "roles"): "Named permission sets",
    ("public", "orders"): 'Sales orders: "placed" and later',
    ("app", "invoices"): "Invoices, per app user",
    ("public", "widgets"): "",
}
COLUMN_COMMENTS = {
    ("public", "users", "email"): "Login address, unique",
    ("public", "users", "status"): 'One of: "new", active',
    ("public", "orders", "total"): "Gross total",
    ("public", "posts", "slug"): "",
    ("app", "users", "balance"): "Open balance",
}

# Views as (ord, schema, name, definition, columns, depended-on class oids).
VIEWS = [
    (101, "public", "active_users", "SELECT id, email FROM users WHERE status = 'active'",
     [("id", "bigint"), ("email", "text")], [10001, 10003, 40101]),
    (102, "public", "order_summary", "SELECT o.id, o.total FROM orders o JOIN order_items i ON i.order_id = o.id",
     [("id", "bigint"), ("total", "numeric")], [10017, 10018, 10018, 40101, 41001]),
    (103, "app", "invoice_view", "SELECT i.id FROM app.invoices i",
     [("id", "bigint")], [10027, 10001, 40102]),
]
VIEW_COMMENTS = {("public", "active_users"): "People who may sign in", ("app", "invoice_view"): ""}
VIEW_COLUMN_COMMENTS = {("public", "active_users", "email"): "Copied from users"}

# Enums as (ord, oid, schema, name, [(label, sort order)], comment).
ENUMS = [
    (121, 50121, "public", "order_state", [("shipped", 3.0), ("new", 1.0), ("paid", 1.5)], "Life of an order"),
    (122, 50122, "public", "mood", [], None),
    (123, 50123, "app", "tier", [("free", 1.0), ("pro plan", 2.0)], None),
]

# Sequences as (ord, schema, name, type, start, min, max, increment, cycle, owners (oid, attnum), comment).
SEQUENCES = [
    (131, "public", "users_id_seq", "bigint", 1, 1, 9223372036854775807, 1, False, [(10001, 1)], "Feeds users.id"),
    (132, "public", "orders_id_seq", "integer", 100, 1, 2147483647, 10, False, [(10017, 1), (10018, 1)], None),
    (133, "app", "ticket_seq", "smallint", -1, -32768, -1, -1, True, [], None),
]

# Types as (ord, oid, schema, name, typtype, class oid, base type, constraints, comment).
TYPES = [
    (141, 50141, "public", "address", "c", 42141, None, [], "Postal address"),
    (142, 50142, "public", "email_address", "d", 0, "text", ["CHECK ((VALUE ~ '@'::text))", "CHECK ((length(VALUE) < 200))"], None),
    (143, 50143, "app", "positive_int", "d", 0, "integer", [], None),
    (144, 50144, "public", "price_range", "r", 0, None, [], None),
]
TYPE_ATTRIBUTES = {42141: [(1, "street", False, "text"), (2, "old_zip", True, "-"), (3, "city", False, "character varying(80)")]}

# Routines as (ord, oid, schema, name, kind, language, names, types, modes, result, definition, comment).
ROUTINES = [
    (151, 60151, "public", "touch_updated", "f", "plpgsql", None, [], None, "trigger",
     "CREATE FUNCTION touch_updated() RETURNS trigger\n LANGUAGE plpgsql", "Stamps rows"),
    (152, 60152, "app", "audit_row", "f", "plpgsql", None, [], None, "trigger", "CREATE FUNCTION app.audit_row()", None),
    (153, 60153, "public", "add_numbers", "f", "sql", ["a", "b"], ["integer", "integer"], None, "integer",
     "SELECT a + b", None),
    (154, 60154, "public", "archive_orders", "p", "plpgsql", ["before", "", "n"],
     ["date", "text", "integer", "text[]", "bigint", "boolean"], ["i", "o", "b", "v", "t"], None, "CALL archive()", None),
    (155, 60155, "public", "my_agg", "a", "sql", None, ["integer"], None, "integer", None, None),
    (156, 60156, "public", "add_numbers", "f", "sql", ["a"], ["numeric", "numeric"], ["I", "x"], "numeric",
     "SELECT a + $2", None),
]

# Triggers as (oid, table ord, function oid, name, tgtype, internal).
TRIGGERS = [
    (80001, 1, 60151, "users_touch", 1 + 2 + 4 + 16, False),
    (80002, 1, 60152, "users_audit", 1 + 4 + 8 + 16, False),
    (80003, 17, 60151, "orders_truncate", 32, False),
    (80004, 17, 60152, "orders_instead", 64 + 8, False),
    (80005, 27, 60152, "RI_ConstraintTrigger_a", 5, True),
]

# Indexes beyond those of the keys, as
# (table ord, name, unique, method, key, definition, predicate, expression).
EXTRA_INDEXES = [
    (1, "users_lower_email", False, "btree", [0],
     "CREATE INDEX users_lower_email ON public.users USING btree (lower(email))", None, "lower(email)"),
    (17, "orders_open", True, "btree", [3],
     "CREATE UNIQUE INDEX orders_open ON public.orders USING btree (status) WHERE (total > 0)", "(total > (0)::numeric)", None),
    (18, "order_items_cover", False, "btree", [1, 4, 5],
     "CREATE INDEX order_items_cover ON public.order_items USING btree (order_id) INCLUDE (price, qty)", None, None),
    (19, "posts_body", False, "gin", [3], "CREATE INDEX posts_body ON public.posts USING gin (body)", None, None),
]

# Checks and exclusions as (table ord, name, contype, key, definition).
EXTRA_CONSTRAINTS = [
    (17, "orders_total_check", "c", [4], "CHECK ((total >= (0)::numeric))"),
    (17, "orders_status_check", "c", [3], "CHECK ((status <> ''::text))"),
    (21, "widgets_open", "c", [], "CHECK (true)"),
    (4, "projects_no_overlap", "x", [5], "EXCLUDE USING gist (start_date WITH =)"),
]

CONSTRAINT_TYPES = {"p": "PRIMARY KEY", "u": "UNIQUE", "c": "CHECK", "x": "EXCLUSION"}


def _constraints() -> list[tuple]:
    """(ord, oid, contype, name, from columns, target table or None, target oid, to columns, confdeltype, definition)"""
    out = []
    for t in TABLES:
        if t.primary_key:
            out.append((t.ord, "p", f"pk_{t.name}", t.primary_key, None, 0, [], "", f"PRIMARY KEY ({', '.join(t.primary_key)})"))
        for n, cols in enumerate(t.unique, 1):
            out.append((t.ord, "u", f"uq_{t.name}_{n}", cols, None, 0, [], "", f"UNIQUE ({', '.join(cols)})"))
        for n, (cols, schema, name, to_cols) in enumerate(t.foreign_keys, 1):
            target = BY_NAME.get((schema, name))
            definition = f"FOREIGN KEY ({', '.join(cols)}) REFERENCES {schema}.{name}({', '.join(to_cols)})"
            oid = target.oid if target else LEDGER_OID
            out.append((t.ord, "f", f"fk_{t.name}_{n}", cols, (schema, name), oid, to_cols, "c" if n % 2 == 0 else "a", definition))
    names = {t.ord: [c.name for c in t.columns] for t in TABLES}
    for ord_, name, kind, key, definition in EXTRA_CONSTRAINTS:
        out.append((ord_, kind, name, [names[ord_][k - 1] for k in key], None, 0, [], "", definition))
    return [(row[0], 70000 + i, *row[1:]) for i, row in enumerate(out)]


def _indexes() -> list[tuple]:
    """(ord, oid, name, unique, primary, method, indkey, columns, definition, predicate, expression)"""
    out = []
    for t in TABLES:
        keys = [("pk_" + t.name, t.primary_key, True)] if t.primary_key else []
        keys += [(f"uq_{t.name}_{n}", cols, False) for n, cols in enumerate(t.unique, 1)]
        for name, cols, primary in keys:
            definition = f"CREATE UNIQUE INDEX {name} ON {t.schema}.{t.name} USING btree ({', '.join(cols)})"
            out.append((t.ord, name, True, primary, "btree", t.attnums(cols), cols, definition, None, None))
    for ord_, name, unique, method, key, definition, predicate, expression in EXTRA_INDEXES:
        cols = [TABLES[ord_ - 1].columns[k - 1].name for k in key if k]
        out.append((ord_, name, unique, False, method, key, cols, definition, predicate, expression))
    return [(row[0], 20000 + i, *row[1:]) for i, row in enumerate(out)]


CONSTRAINTS = _constraints()
INDEXES = _indexes()
UDT = {"bigint": "int8", "integer": "int4", "boolean": "bool", "double precision": "float8"}


def _column_facts(t: TemplateTable, n: int, c: Column) -> dict:
    serial = (t.schema, t.name, c.name) in {("public", "users", "id"), ("public", "orders", "id")}
    identity = (t.schema, t.name, c.name) == ("public", "widgets", "id")
    generated = (t.schema, t.name, c.name) == ("public", "order_details", "memo")
    return {
        "ord": t.ord,
        "table_schema": t.schema,
        "table_name": t.name,
        "column_name": c.name,
        "data_type": c.type,
        "udt_name": UDT.get(c.type, c.type),
        "is_nullable": "YES" if c.nullable else "NO",
        "column_default": f"nextval('{t.name}_id_seq'::regclass)" if serial else None,
        "character_maximum_length": 80 if c.name == "title" else None,
        "numeric_precision": 12 if c.type == "numeric" else None,
        "numeric_scale": 2 if c.type == "numeric" else None,
        # A missing flag counts as NO / NEVER.
        "is_identity": "YES" if identity else (None if n == 1 else "NO"),
        "identity_generation": "ALWAYS" if identity else None,
        "is_generated": "ALWAYS" if generated else (None if n == 1 else "NEVER"),
        "generation_expression": "(s1 || s2)" if generated else None,
        "collation_name": "C" if c.name in ("code", "sku") else None,
        "ordinal_position": n,
    }


def _info_columns() -> Relation:
    fields = {"ord": "bigint", **CATALOG_COLUMNS["info_columns"]}
    rows = [
        tuple(_column_facts(t, n, c)[f] for f in fields)
        for t in TABLES
        for n, c in enumerate(t.columns, 1)
    ]
    for ord_, schema, view, _, columns, _ in VIEWS:
        shell = TemplateTable(ord_, schema, view, [], [], [], [])
        rows += [
            tuple(_column_facts(shell, n, Column(name, kind, True))[f] for f in fields)
            for n, (name, kind) in enumerate(columns, 1)
        ]
    return Relation(fields, rows)


def raw_relations() -> dict[str, Relation]:
    """The catalog relations of the fleet, as an export would hold them."""
    kinds = CATALOG_COLUMNS
    out: dict[str, Relation] = {}

    out["pg_database"] = Relation(
        {"ord": "bigint"}, [(0,)], {"datname": "'db_' || db_id", "version": "'16.' || (db_id % 5)"}
    )
    out["info_tables"] = Relation(
        {"ord": "bigint", **kinds["info_tables"]},
        [(t.ord, t.schema, t.name, "BASE TABLE") for t in TABLES]
        + [(ord_, schema, name, "VIEW") for ord_, schema, name, *_ in VIEWS]
        + [(199, "other", "ledger", "BASE TABLE"), (198, "app", "remote_orders", "FOREIGN")],
        where=DROP_RULE,
    )
    out["info_columns"] = _info_columns()
    out["info_views"] = Relation(
        {"ord": "bigint", **kinds["info_views"]},
        [(ord_, schema, name, definition) for ord_, schema, name, definition, *_ in VIEWS],
        where=DROP_RULE,
    )

    class_rows = [(t.ord, t.oid, t.name, NAMESPACES[t.schema], "r", 61000 + t.ord, 2) for t in TABLES]
    class_rows += [(199, LEDGER_OID, "ledger", NAMESPACES["other"], "r", 61199, 2)]
    class_rows += [(ord_, oid, name, NAMESPACES[TABLES[ord_ - 1].schema], "i", 0, ACCESS_METHODS[method])
                   for ord_, oid, name, _, _, method, *_ in INDEXES]
    class_rows += [(v[0], 40000 + v[0], v[2], NAMESPACES[v[1]], "v", 61000 + v[0], 0) for v in VIEWS]
    class_rows += [(190, 41001, "mv_stats", NAMESPACES["public"], "m", 61190, 0)]
    class_rows += [(s[0], 43000 + s[0], s[2], NAMESPACES[s[1]], "S", 0, 0) for s in SEQUENCES]
    class_rows += [(t[0], t[5], t[3], NAMESPACES[t[2]], "c", t[1], 0) for t in TYPES if t[5]]
    out["pg_class"] = Relation(
        {"ord": "bigint", "oid": "bigint", "relname": "string", "relnamespace": "bigint", "relkind": "string",
         "reltype": "bigint", "relam": "bigint"},
        class_rows,
        {"reltuples": f"CASE WHEN (db_id + ord) % 5 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST({ROW_COUNT} AS DOUBLE) END"},
    )
    out["pg_namespace"] = Relation(
        {"ord": "bigint", **kinds["pg_namespace"]}, [(0, oid, name) for name, oid in NAMESPACES.items()]
    )

    attributes = [(t.ord, t.oid, c.name, n, False, c.type) for t in TABLES for n, c in enumerate(t.columns, 1)]
    attributes += [(t.ord, t.oid, "tableoid", -6, False, "oid") for t in TABLES]
    attributes += [(1, 10001, "........pg.dropped.6........", 6, True, "-"), (199, LEDGER_OID, "id", 1, False, "bigint")]
    attributes += [(v[0], 40000 + v[0], name, n, False, kind) for v in VIEWS for n, (name, kind) in enumerate(v[4], 1)]
    attributes += [(141, oid, name, n, dropped, kind) for oid, attrs in TYPE_ATTRIBUTES.items() for n, name, dropped, kind in attrs]
    out["pg_attribute"] = Relation({"ord": "bigint", **kinds["pg_attribute"]}, attributes)

    notes = [(BY_NAME[key].ord, BY_NAME[key].oid, "pg_class", 0, text) for key, text in TABLE_COMMENTS.items()]
    notes += [(BY_NAME[(s, t)].ord, BY_NAME[(s, t)].oid, "pg_class", BY_NAME[(s, t)].attnums([c])[0], text)
              for (s, t, c), text in COLUMN_COMMENTS.items()]
    notes += [(1, 10001, "pg_class", 6, "comment of a dropped column"), (1, 10001, "pg_proc", 0, "other class, same oid")]
    views = {(v[1], v[2]): v for v in VIEWS}
    notes += [(views[key][0], 40000 + views[key][0], "pg_class", 0, text) for key, text in VIEW_COMMENTS.items()]
    notes += [(views[(s, v)][0], 40000 + views[(s, v)][0], "pg_class", [n for n, _ in views[(s, v)][4]].index(c) + 1, text)
              for (s, v, c), text in VIEW_COLUMN_COMMENTS.items()]
    notes += [(e[0], e[1], "pg_type", 0, e[5]) for e in ENUMS if e[5]]
    notes += [(s[0], 43000 + s[0], "pg_class", 0, s[10]) for s in SEQUENCES if s[10]]
    notes += [(t[0], t[1], "pg_type", 0, t[8]) for t in TYPES if t[8]]
    notes += [(r[0], r[1], "pg_proc", 0, r[11]) for r in ROUTINES if r[11]]
    out["pg_description"] = Relation(
        {"ord": "bigint", **kinds["pg_description"]}, notes, where="(db_id + ord) % 3 <> 0"
    )

    constraint_rows = [
        (ord_, oid, TABLES[ord_ - 1].oid, to_oid, 0, name, kind, TABLES[ord_ - 1].attnums(cols),
         ([BY_NAME[target].attnums(to_cols) if target in BY_NAME else [1]][0] if target else []),
         "a" if kind == "f" else " ", action or " ", definition)
        for ord_, oid, kind, name, cols, target, to_oid, to_cols, action, definition in CONSTRAINTS
    ]
    constraint_rows += [
        (t[0], 71000 + 10 * t[0] + n, 0, 0, t[1], f"{t[3]}_check{n}", "c", [], [], " ", " ", text)
        for t in TYPES for n, text in enumerate(t[7])
    ]
    out["pg_constraint"] = Relation({"ord": "bigint", **kinds["pg_constraint"]}, constraint_rows)
    out["pg_index"] = Relation(
        {"ord": "bigint", **kinds["pg_index"]},
        [(ord_, oid, 10000 + ord_, unique, primary, key, definition, predicate, expression)
         for ord_, oid, _, unique, primary, _, key, _, definition, predicate, expression in INDEXES],
    )
    out["pg_am"] = Relation({"ord": "bigint", **kinds["pg_am"]}, [(0, oid, name) for name, oid in ACCESS_METHODS.items()])
    out["pg_trigger"] = Relation(
        {"ord": "bigint", **kinds["pg_trigger"]},
        [(ord_, oid, 10000 + ord_, fn, name, bits, internal, f"CREATE TRIGGER {name} EXECUTE FUNCTION f{fn}()")
         for oid, ord_, fn, name, bits, internal in TRIGGERS],
    )
    out["pg_proc"] = Relation(
        {"ord": "bigint", **kinds["pg_proc"]},
        [(ord_, oid, NAMESPACES[schema], LANGUAGES[language], name, kind, names, types, modes, result, definition)
         for ord_, oid, schema, name, kind, language, names, types, modes, result, definition, _ in ROUTINES],
    )
    out["pg_language"] = Relation({"ord": "bigint", **kinds["pg_language"]}, [(0, oid, name) for name, oid in LANGUAGES.items()])
    type_rows = [(e[0], e[1], NAMESPACES[e[2]], 0, e[3], "e", None) for e in ENUMS]
    type_rows += [(t[0], t[1], NAMESPACES[t[2]], t[5], t[3], t[4], t[6]) for t in TYPES]
    type_rows += [(t.ord, 61000 + t.ord, NAMESPACES[t.schema], t.oid, t.name, "c", None) for t in TABLES]
    type_rows += [(v[0], 61000 + v[0], NAMESPACES[v[1]], 40000 + v[0], v[2], "c", None) for v in VIEWS]
    out["pg_type"] = Relation({"ord": "bigint", **kinds["pg_type"]}, type_rows)
    out["pg_enum"] = Relation(
        {"ord": "bigint", **kinds["pg_enum"]}, [(e[0], e[1], label, order) for e in ENUMS for label, order in e[4]]
    )
    out["pg_sequence"] = Relation(
        {"ord": "bigint", **kinds["pg_sequence"]}, [(s[0], 43000 + s[0], *s[3:9]) for s in SEQUENCES], where=DROP_RULE
    )
    depends = [(s[0], "pg_class", "pg_class", 43000 + s[0], oid, attnum, "a") for s in SEQUENCES for oid, attnum in s[9]]
    depends += [(133, "pg_class", "pg_class", 43133, 10001, 1, "n")]
    depends += [(v[0], "pg_rewrite", "pg_class", 44000 + v[0], oid, 0, "n") for v in VIEWS for oid in v[5]]
    depends += [(101, "pg_rewrite", "pg_proc", 44101, 10002, 0, "n")]
    out["pg_depend"] = Relation({"ord": "bigint", **kinds["pg_depend"]}, depends)
    out["pg_rewrite"] = Relation({"ord": "bigint", **kinds["pg_rewrite"]}, [(v[0], 44000 + v[0], 40000 + v[0]) for v in VIEWS])
    out["pg_stats"] = Relation(
        {"ord": "bigint", "n": "int", "schemaname": "string", "tablename": "string", "attname": "string",
         "most_common_vals": "string"},
        [(t.ord, n, t.schema, t.name, c.name, None) for t in TABLES for n, c in enumerate(t.columns, 1)],
        {
            "null_frac": "CAST((db_id + n) % 8 AS DOUBLE) / 8",
            "n_distinct": "CASE WHEN (db_id + n) % 4 = 0 THEN CAST(-0.5 AS DOUBLE) WHEN (db_id + n) % 4 = 1 "
            "THEN CAST(0 AS DOUBLE) ELSE CAST(db_id * n AS DOUBLE) / 2 END",
        },
    )
    return out


def normal_relations() -> dict[str, Relation]:
    """The normalised frames group A yields, rendered directly from the template."""
    types = {
        "ord": "bigint",
        "schema_name": "string",
        "table_name": "string",
    }
    noted = "(db_id + ord) % 3 <> 0"
    tables = Relation(
        {**types, "table_type": "string", "note": "string"},
        [(t.ord, t.schema, t.name, "BASE TABLE", TABLE_COMMENTS.get((t.schema, t.name), "")) for t in TABLES],
        {
            "comment": f"CASE WHEN {noted} THEN note ELSE '' END",
            "row_count_estimate": f"CASE WHEN (db_id + ord) % 5 = 0 THEN NULL ELSE {ROW_COUNT} END",
        },
        DROP_RULE,
    )
    column_fields = {k: v for k, v in CATALOG_COLUMNS["info_columns"].items() if not k.startswith("table_")}
    columns = Relation(
        {**types, **column_fields, "note": "string"},
        [
            (t.ord, t.schema, t.name, *(_column_facts(t, n, c)[f] for f in column_fields),
             COLUMN_COMMENTS.get((t.schema, t.name, c.name)))
            for t in TABLES for n, c in enumerate(t.columns, 1)
        ],
        {
            "nullable": "is_nullable = 'YES'",
            "default_value": "column_default",
            "generated": "coalesce(is_generated, 'NEVER') <> 'NEVER'",
            "is_identity": "coalesce(is_identity, 'NO') = 'YES'",
            "collation": "collation_name",
            "character_max_length": "character_maximum_length",
            "comment": f"CASE WHEN {noted} AND note <> '' THEN note END",
        },
        DROP_RULE,
    )
    constraints = Relation(
        {**types, "constraint_name": "string", "constraint_type": "string", "columns": "array<string>",
         "expression": "string", "definition": "string"},
        [
            (ord_, TABLES[ord_ - 1].schema, TABLES[ord_ - 1].name, name, CONSTRAINT_TYPES[kind], cols,
             definition if kind == "c" else None, definition)
            for ord_, _, kind, name, cols, *_, definition in CONSTRAINTS if kind != "f"
        ],
        where=DROP_RULE,
    )
    indexes = Relation(
        {**types, "index_name": "string", "is_unique": "boolean", "is_primary": "boolean", "index_type": "string",
         "columns": "array<string>", "include_columns": "array<string>", "predicate": "string", "expression": "string"},
        [
            (ord_, TABLES[ord_ - 1].schema, TABLES[ord_ - 1].name, name, unique, primary, method, cols,
             ["price", "qty"] if name == "order_items_cover" else None, predicate, expression)
            for ord_, _, name, unique, primary, method, _, cols, _, predicate, expression in INDEXES
        ],
        where=DROP_RULE,
    )
    foreign_keys = Relation(
        {"ord": "bigint", "constraint_name": "string", "from_schema": "string", "from_table": "string",
         "from_columns": "array<string>", "to_schema": "string", "to_table": "string", "to_columns": "array<string>",
         "on_update": "string", "on_delete": "string"},
        [
            (ord_, name, TABLES[ord_ - 1].schema, TABLES[ord_ - 1].name, cols, *target, to_cols, "NO ACTION",
             "CASCADE" if action == "c" else "NO ACTION")
            for ord_, _, kind, name, cols, target, _, to_cols, action, _ in CONSTRAINTS if kind == "f"
        ],
        where=DROP_RULE,
    )
    return {"tables": tables, "columns": columns, "constraints": constraints, "indexes": indexes, "foreign_keys": foreign_keys}


NORMAL_DROP = {"tables": ("note",), "columns": ("note", "is_nullable", "column_default", "is_generated", "collation_name",
                                                "character_maximum_length")}


def _output(name: str, relation: Relation) -> dict[str, str]:
    drop = NORMAL_DROP.get(name, ()) + (("n",) if name == "pg_stats" else ())
    return {k: v for k, v in relation.output().items() if k not in drop}


def _literal(value, kind: str) -> str:
    """One DuckDB literal."""
    sql_type = DUCKDB_TYPES[kind]
    if value is None:
        return f"CAST(NULL AS {sql_type})"
    if isinstance(value, list):
        inner = kind[len("array<"):-1]
        return f"CAST([{', '.join(_literal(v, inner) for v in value)}] AS {sql_type})"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return f"CAST({value} AS {sql_type})"
    return "'" + value.replace("'", "''") + "'"


def _spark_frame(databases: DataFrame, name: str, relation: Relation) -> DataFrame:
    """Every database row with every row of the template, which is a local table of some kilobytes.

    Joined, not exploded: the planner takes an explosion to be no larger than what went in, and would
    broadcast frames of millions of rows from the driver. A join it sizes by the product of both sides.
    """
    values = zip(*relation.rows, strict=True)
    columns = {f: pa.array(own, ARROW_TYPES[kind]) for (f, kind), own in zip(relation.fields.items(), values, strict=True)}
    rows = databases.sparkSession.createDataFrame(pa.table(columns))
    return databases.crossJoin(F.broadcast(rows)).where(relation.where).selectExpr(
        "db_id", *(f"{expr} AS `{out}`" for out, expr in _output(name, relation).items()))


def fleet_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per database, dealt out in turn.

    Every row is about to become a hundred, and a customer file of one row
    group would be one task. Rows are dealt without regard to a key, so that
    later groupings shuffle as they would on the relations of a real export,
    where the rows of one database lie anywhere.
    """
    databases = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS db_id")
    return databases.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _frames(databases: DataFrame, relations: dict[str, Relation]) -> LazyFrames:
    return LazyFrames(
        {name: (lambda name=name, relation=relation: _spark_frame(databases, name, relation)) for name, relation in relations.items()}
    )


def fleet_raw(spark: SparkSession, sf_dir: str) -> LazyFrames:
    return _frames(fleet_databases(spark, sf_dir), raw_relations())


def fleet_normal(spark: SparkSession, sf_dir: str) -> LazyFrames:
    return _frames(fleet_databases(spark, sf_dir), normal_relations())


def template_frames(spark: SparkSession, db_id: int = 0) -> LazyFrames:
    """One database with no table dropped (unit tests)."""
    relations = normal_relations()
    for relation in relations.values():
        relation.where = "true"
    return _frames(spark.range(db_id, db_id + 1).selectExpr("id AS db_id"), relations)


def duckdb_cte(*names: str) -> str:
    """``WITH`` items for the named relations (normalised ones come as ``f_<name>``)."""
    raw, normal = raw_relations(), normal_relations()
    parts = []
    for name in names:
        key = name.removeprefix("f_")
        relation = normal[key] if name.startswith("f_") else raw[key]
        values = ", ".join(
            "(" + ", ".join(_literal(v, k) for v, k in zip(row, relation.fields.values(), strict=True)) + ")"
            for row in relation.rows
        )
        quoted = ", ".join(f'"{f}"' for f in relation.fields)
        output = ", ".join(f'{expr} AS "{out}"' for out, expr in _output(key, relation).items())
        parts.append(
            f"{name} AS MATERIALIZED (SELECT db_id, {output} FROM (SELECT c_custkey AS db_id FROM customer) "
            f"CROSS JOIN (VALUES {values}) AS t({quoted}) WHERE {relation.where})"
        )
    return ",\n".join(parts)
