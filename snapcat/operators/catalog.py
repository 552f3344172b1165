"""Group A: raw catalog relations -> normalised frames, for all databases at once.

Every join equates ``db_id``. Keys meet the attributes of their relation, gathered in
one row (1,600 at most, the server's limit), and take the names of their slots there:
keys are shuffled once by their relation, for the names and for the scope.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapcat.functions import codes
from snapcat.session import merged

KEY = ["db_id", "schema_name", "table_name"]
DEFAULT_SCHEMAS = ("public",)
# Fixed value: the note under statistics.
STATS_NOTE = "Values are estimates from PostgreSQL statistics. Run ANALYZE for more accurate statistics."


#: Constraints of a table's own columns: primary key, unique, check and exclusion.
KEY_TYPES = ("p", "u", "c", "x")


def parse_schemas(text: str) -> list[str]:
    """``"a, b"`` -> ``["a", "b"]``; nothing left means the default schema."""
    names = [part.strip() for part in text.split(",")]
    return [name for name in names if name] or list(DEFAULT_SCHEMAS)


def named_classes(pg_class: DataFrame, pg_namespace: DataFrame) -> DataFrame:
    """Every class with its schema name."""
    namespaces = pg_namespace.select("db_id", F.col("oid").alias("relnamespace"), F.col("nspname").alias("schema_name"))
    return pg_class.join(namespaces, ["db_id", "relnamespace"]).select(
        "db_id", "oid", "schema_name", F.col("relname").alias("table_name"), "relkind", "reltuples", "relam"
    )


def table_scope(tables: DataFrame, classes: DataFrame) -> DataFrame:
    """Object ids of the tables (or views) in the snapshot."""
    return classes.select("oid", *KEY).join(tables.select(*KEY), KEY, "left_semi")


def of_tables(classes: DataFrame) -> DataFrame:
    """Classes of base tables, plain and partitioned: no index, view or type can be listed as one or be the target of a key."""
    return classes.where(F.col("relkind").isin("r", "p"))


def descriptions(pg_description: DataFrame, classoid: str) -> DataFrame:
    """Whole-object comments of one kind."""
    return pg_description.where((F.col("classoid") == classoid) & (F.col("objsubid") == 0)).select(
        "db_id", F.col("objoid").alias("oid"), "description"
    )


def attribute_lists(pg_attribute: DataFrame, relation: str) -> DataFrame:
    """Numbers and names of the attributes of each relation, at most 1,600 and those of the system."""
    own = pg_attribute.where("db_id IS NOT NULL AND attrelid IS NOT NULL").select(
        "db_id", F.col("attrelid").alias(relation), F.struct(F.col("attnum").cast("int").alias("attnum"), "attname").alias("attribute"))
    # Dealt out as they are: gathered where they lie, they would be as many and larger.
    return own.repartition("db_id", relation).groupBy("db_id", relation).agg(F.collect_list("attribute").alias("attributes"))


def with_slots(keyed: DataFrame, ident: str, relation: str, keys: dict[str, str]) -> DataFrame:
    """Rows dealt out by (db_id, ``relation``), each list of attribute numbers as slots (place, number); rows of one ``ident`` share theirs."""
    slot = lambda number, place: F.struct(place.alias("place"), number.cast("int").alias("attnum"))
    same = Window.partitionBy("db_id", relation, ident)
    slots = {out: F.when(F.col(ident).isNotNull(), F.flatten(F.collect_list(F.transform(F.col(key), slot)).over(same))) for out, key in keys.items()}
    return keyed.repartition("db_id", relation).withColumns(slots)


def slot_names(slots: str) -> Column:
    """Names of the slots in key order out of ``attributes``; slots without an attribute vanish. At most 32 slots, the server's limit on a key."""
    of_slot = lambda s: F.transform(
        F.filter("attributes", lambda a: a["attnum"] == s["attnum"]), lambda a: F.struct(s["place"].alias("place"), a["attname"].alias("attname")))
    names = F.transform(F.sort_array(F.flatten(F.transform(slots, of_slot))), lambda n: n["attname"])
    return F.coalesce(names, F.array().cast("array<string>"))


def with_key_names(keyed: DataFrame, ident: str, slots: dict[str, tuple[str, str]], pg_attribute: DataFrame) -> DataFrame:
    """Adds the names of key slots in key order, empty where no slot has a name.

    ``slots`` gives for each list of names the columns with the relation and its attribute numbers. Rows go by
    (db_id, relation) and meet all attributes of their relation at once; a join with the relations finds them there.
    """
    first = next(iter(slots.values()))[0]
    out = with_slots(keyed, ident, first, {name: key for name, (_, key) in slots.items()})
    for name, (relation, _) in slots.items():
        out = out.join(attribute_lists(pg_attribute, relation), ["db_id", relation], "left").withColumn(name, slot_names(name)).drop("attributes")
    # The planner takes rows with names for as small as the files of their keys.
    return merged(out)


def table_names(info_tables: DataFrame, schemas: Sequence[str]) -> DataFrame:
    """Base tables of the schemas."""
    return info_tables.where(F.col("table_schema").isin(*schemas) & (F.col("table_type") == "BASE TABLE")).select(
        "db_id", F.col("table_schema").alias("schema_name"), "table_name", "table_type"
    )


def tables(info_tables: DataFrame, classes: DataFrame, pg_description: DataFrame, schemas: Sequence[str]) -> DataFrame:
    """Base tables of the schemas, with their comment ('' when none)."""
    return with_object_comment(table_names(info_tables, schemas), classes, pg_description)


def with_object_comment(base: DataFrame, classes: DataFrame, pg_description: DataFrame) -> DataFrame:
    comments = (
        classes.select("oid", *KEY)
        .join(descriptions(pg_description, "pg_class"), ["db_id", "oid"])
        .select(*KEY, F.col("description").alias("comment"))
    )
    return base.join(comments, KEY, "left").withColumn("comment", F.coalesce("comment", F.lit("")))


def row_estimates(classes: DataFrame, tables: DataFrame) -> DataFrame:
    """Planner row counts; a negative count means never analysed."""
    estimate = F.when(F.col("reltuples") >= 0, F.col("reltuples").cast("bigint"))
    return classes.join(tables.select(*KEY), KEY, "left_semi").select(*KEY, estimate.alias("row_count_estimate"))


def columns(info_columns: DataFrame) -> DataFrame:
    """Columns of tables and views; missing flags count as NO / NEVER."""
    return info_columns.select(
        "db_id",
        F.col("table_schema").alias("schema_name"),
        "table_name",
        "ordinal_position",
        "column_name",
        "data_type",
        "udt_name",
        (F.col("is_nullable") == "YES").alias("nullable"),
        F.col("column_default").alias("default_value"),
        (F.coalesce("is_generated", F.lit("NEVER")) != "NEVER").alias("generated"),
        "generation_expression",
        (F.coalesce("is_identity", F.lit("NO")) == "YES").alias("is_identity"),
        "identity_generation",
        F.col("collation_name").alias("collation"),
        F.col("character_maximum_length").alias("character_max_length"),
        "numeric_precision",
        "numeric_scale",
    )


def with_column_comments(
    columns: DataFrame, classes: DataFrame, pg_attribute: DataFrame, pg_description: DataFrame
) -> DataFrame:
    """Adds the non-empty comment of each column that is not dropped."""
    notes = pg_description.where(
        (F.col("classoid") == "pg_class") & (F.col("objsubid") > 0) & (F.col("description") != "")
    ).select("db_id", F.col("objoid").alias("oid"), F.col("objsubid").alias("attnum"), F.col("description").alias("comment"))
    live = pg_attribute.where((F.col("attnum") > 0) & ~F.col("attisdropped")).select(
        "db_id", F.col("attrelid").alias("oid"), "attnum", F.col("attname").alias("column_name")
    )
    named = (
        notes.join(live, ["db_id", "oid", "attnum"])
        .join(classes.select("oid", *KEY), ["db_id", "oid"])
        .select(*KEY, "column_name", "comment")
    )
    return columns.join(named, [*KEY, "column_name"], "left")


def constraints(
    pg_constraint: DataFrame, scope: DataFrame, pg_attribute: DataFrame, types: Sequence[str] = KEY_TYPES
) -> DataFrame:
    """Primary key, unique, check and exclusion constraints with column names in key order."""
    kind = codes.constraint_type(F.col("contype"))
    own = pg_constraint.where(F.col("contype").isin(*types)).withColumnRenamed("oid", "constraint_oid")
    return (
        with_key_names(own, "constraint_oid", {"columns": ("conrelid", "conkey")}, pg_attribute)
        .join(scope.withColumnRenamed("oid", "conrelid"), ["db_id", "conrelid"])
        .select(
            *KEY,
            F.col("conname").alias("constraint_name"),
            kind.alias("constraint_type"),
            "columns",
            F.when(kind == "CHECK", F.col("definition")).alias("expression"),
            "definition",
        )
    )


def indexes(
    pg_index: DataFrame, scope: DataFrame, pg_class: DataFrame, pg_am: DataFrame, pg_attribute: DataFrame
) -> DataFrame:
    """Indexes with key columns (expression slots vanish, INCLUDE columns are listed too)."""
    methods = pg_am.select("db_id", F.col("oid").alias("relam"), F.col("amname").alias("index_type"))
    index_class = pg_class.where(F.col("relkind").isin("i", "I")).select(
        "db_id", F.col("oid").alias("indexrelid"), F.col("relname").alias("index_name"), "relam"
    ).join(methods, ["db_id", "relam"])
    return (
        with_key_names(pg_index, "indexrelid", {"columns": ("indrelid", "indkey")}, pg_attribute)
        .join(scope.withColumnRenamed("oid", "indrelid"), ["db_id", "indrelid"])
        .join(index_class, ["db_id", "indexrelid"])
        .select(
            *KEY,
            "index_name",
            F.col("indisunique").alias("is_unique"),
            F.col("indisprimary").alias("is_primary"),
            "index_type",
            "columns",
            codes.include_columns(F.col("indexdef")).alias("include_columns"),
            "predicate",
            "expression",
            F.col("indexdef").alias("definition"),
        )
    )


FK_SLOTS = {"from_columns": ("conrelid", "conkey"), "to_columns": ("confrelid", "confkey")}


def foreign_keys(
    pg_constraint: DataFrame, scope: DataFrame, classes: DataFrame, pg_attribute: DataFrame, lists: Sequence[str] = tuple(FK_SLOTS)
) -> DataFrame:
    """Foreign keys of the tables, with the lists of columns that are asked for; targets outside the schemas are kept."""
    source = scope.select(
        "db_id", F.col("oid").alias("conrelid"), F.col("schema_name").alias("from_schema"), F.col("table_name").alias("from_table")
    )
    target = classes.select(
        "db_id", F.col("oid").alias("confrelid"), F.col("schema_name").alias("to_schema"), F.col("table_name").alias("to_table")
    )
    own = pg_constraint.where(F.col("contype") == "f").withColumnRenamed("oid", "constraint_oid")
    named = with_slots(own, "constraint_oid", "conrelid", {name: FK_SLOTS[name][1] for name in lists}) if lists else own
    at_source, at_target = (["from_columns"] if "from_columns" in lists else []), (["to_columns"] if "to_columns" in lists else [])
    if at_source:
        named = named.join(attribute_lists(pg_attribute, "conrelid"), ["db_id", "conrelid"], "left").withColumn("from_columns", slot_names("from_columns")).drop("attributes")
    named = merged(named).join(source, ["db_id", "conrelid"])
    if at_target:
        # Dealt out again, so that a target that draws a third of all keys can be split: only a join of two shuffles is.
        target = target.join(attribute_lists(pg_attribute, "confrelid"), ["db_id", "confrelid"], "left").repartition("db_id", "confrelid")
        named = named.join(target, ["db_id", "confrelid"]).withColumn("to_columns", slot_names("to_columns"))
    else:
        named = named.join(target, ["db_id", "confrelid"])
    return (
        named
        .select(
            "db_id",
            F.col("conname").alias("constraint_name"),
            "from_schema",
            "from_table",
            *at_source,
            "to_schema",
            "to_table",
            *at_target,
            codes.fk_action(F.col("confupdtype")).alias("on_update"),
            codes.fk_action(F.col("confdeltype")).alias("on_delete"),
        )
    )


def with_fk_nullable(fks: DataFrame, columns: DataFrame) -> DataFrame:
    """A foreign key is nullable when any of its columns is; unknown columns are not."""
    nullable = (
        columns.where("nullable")
        .groupBy(*KEY)
        # At most 1,600 names per table, the server's limit on columns.
        .agg(F.collect_set("column_name").alias("nullable_columns"))
        .select(
            "db_id", F.col("schema_name").alias("from_schema"), F.col("table_name").alias("from_table"), "nullable_columns"
        )
    )
    return (
        fks.join(nullable, ["db_id", "from_schema", "from_table"], "left")
        .withColumn("nullable", F.coalesce(F.arrays_overlap("from_columns", "nullable_columns"), F.lit(False)))
        .drop("nullable_columns")
    )


def triggers(
    pg_trigger: DataFrame, scope: DataFrame, pg_proc: DataFrame, pg_namespace: DataFrame, redact_definitions: bool = False
) -> DataFrame:
    """User triggers with decoded timing, events and function reference."""
    functions = (
        pg_proc.select("db_id", F.col("oid").alias("tgfoid"), "proname", F.col("pronamespace").alias("ns"))
        .join(pg_namespace.select("db_id", F.col("oid").alias("ns"), "nspname"), ["db_id", "ns"])
        .select("db_id", "tgfoid", codes.unqualified_public(F.col("nspname"), F.col("proname")).alias("function_or_procedure"))
    )
    definition = F.lit(None).cast("string") if redact_definitions else F.col("definition")
    return (
        pg_trigger.where(~F.col("tgisinternal"))
        .join(scope.withColumnRenamed("oid", "tgrelid"), ["db_id", "tgrelid"])
        .join(functions, ["db_id", "tgfoid"])
        .select(
            *KEY,
            F.col("tgname").alias("trigger_name"),
            codes.trigger_timing(F.col("tgtype")).alias("timing"),
            codes.trigger_events(F.col("tgtype")).alias("events"),
            "function_or_procedure",
            definition.alias("definition"),
        )
    )


def _in_schemas(frame: DataFrame, ns_col: str, pg_namespace: DataFrame, schemas: Sequence[str]) -> DataFrame:
    wanted = pg_namespace.where(F.col("nspname").isin(*schemas)).select(
        "db_id", F.col("oid").alias(ns_col), F.col("nspname").alias("schema_name")
    )
    return frame.join(wanted, ["db_id", ns_col])


def _with_comment(frame: DataFrame, pg_description: DataFrame, classoid: str, redact: bool) -> DataFrame:
    if redact:
        return frame.withColumn("comment", F.lit(""))
    notes = descriptions(pg_description, classoid).withColumnRenamed("description", "comment")
    return frame.join(notes, ["db_id", "oid"], "left").withColumn("comment", F.coalesce("comment", F.lit("")))


def enums(
    pg_type: DataFrame, pg_namespace: DataFrame, pg_description: DataFrame,
    schemas: Sequence[str], redact_comments: bool = False,
) -> DataFrame:
    """One row per enum. Labels stay one row each (``enum_labels``): the server
    sets no bound on labels per enum, so they are never gathered into one cell."""
    named = _in_schemas(pg_type.where("typtype = 'e'"), "typnamespace", pg_namespace, schemas)
    return _with_comment(named, pg_description, "pg_type", redact_comments).select(
        "db_id", "oid", "schema_name", F.col("typname").alias("enum_name"), "comment"
    )


def enum_labels(enums: DataFrame, pg_enum: DataFrame) -> DataFrame:
    """Labels with their sort order; an enum without labels keeps one row of NULLs."""
    labels = pg_enum.select(
        "db_id", F.col("enumtypid").alias("oid"), F.col("enumsortorder").alias("sort_order"), F.col("enumlabel").alias("label")
    )
    return enums.join(labels, ["db_id", "oid"], "left").drop("oid")


def sequence_owners(pg_depend: DataFrame, pg_attribute: DataFrame, classes: DataFrame) -> DataFrame:
    """Owning ``table.column`` by automatic dependency; the smallest where there are several."""
    owned = pg_depend.where(
        (F.col("classid") == "pg_class") & (F.col("refclassid") == "pg_class") & (F.col("deptype") == "a")
    ).select("db_id", "objid", F.col("refobjid").alias("attrelid"), F.col("refobjsubid").alias("attnum"))
    table = classes.select("db_id", F.col("oid").alias("attrelid"),
                           codes.unqualified_public(F.col("schema_name"), F.col("table_name")).alias("table_ref"))
    return (
        owned.join(pg_attribute.select("db_id", "attrelid", "attnum", "attname"), ["db_id", "attrelid", "attnum"])
        .join(table, ["db_id", "attrelid"])
        .groupBy("db_id", F.col("objid").alias("oid"))
        .agg(F.min(F.concat_ws(".", "table_ref", "attname")).alias("owned_by"))
    )


def sequences(
    pg_sequence: DataFrame, classes: DataFrame, pg_description: DataFrame, owners: DataFrame,
    schemas: Sequence[str], redact_comments: bool = False,
) -> DataFrame:
    named = pg_sequence.withColumnRenamed("seqrelid", "oid").join(
        classes.where(F.col("schema_name").isin(*schemas)), ["db_id", "oid"]
    )
    with_owner = named.join(owners, ["db_id", "oid"], "left")
    return _with_comment(with_owner, pg_description, "pg_class", redact_comments).select(
        "db_id",
        "schema_name",
        F.col("table_name").alias("sequence_name"),
        F.col("seqtype").alias("data_type"),
        F.col("seqstart").alias("start_value"),
        F.col("seqmin").alias("min_value"),
        F.col("seqmax").alias("max_value"),
        F.col("seqincrement").alias("increment"),
        F.col("seqcycle").alias("cycle"),
        F.coalesce("owned_by", F.lit("")).alias("owned_by"),
        "comment",
    )


def type_attributes(pg_attribute: DataFrame, pg_type: DataFrame) -> DataFrame:
    """Live attributes of composite types in order (at most 1,600 each)."""
    composites = pg_type.where("typtype = 'c'").select("db_id", "oid", F.col("typrelid").alias("attrelid"))
    live = pg_attribute.where((F.col("attnum") > 0) & ~F.col("attisdropped"))
    return (
        live.join(composites, ["db_id", "attrelid"])
        .groupBy("db_id", "oid")
        .agg(F.sort_array(F.collect_list(F.struct("attnum", "attname", "format_type"))).alias("sorted"))
        .select(
            "db_id",
            "oid",
            F.transform(
                "sorted", lambda a: F.struct(a["attname"].alias("name"), a["format_type"].alias("data_type"))
            ).alias("attributes"),
        )
    )


def domain_info(pg_type: DataFrame, pg_constraint: DataFrame) -> DataFrame:
    """Base type and constraint of domains; the smallest text where there are several."""
    texts = (
        pg_constraint.where(F.col("contypid") > 0)
        .groupBy("db_id", F.col("contypid").alias("oid"))
        .agg(F.min("definition").alias("constraint"))
    )
    domains = pg_type.where("typtype = 'd'").select("db_id", "oid", "base_type")
    return merged(domains.join(texts, ["db_id", "oid"], "left"))


def types(
    pg_type: DataFrame, pg_namespace: DataFrame, pg_class: DataFrame, pg_description: DataFrame,
    attributes: DataFrame, domains: DataFrame, schemas: Sequence[str], redact_comments: bool = False,
) -> DataFrame:
    """Composite, domain and range types that are not the row type of a table or view."""
    row_types = pg_class.where(F.col("relkind").isin("r", "v", "m", "p")).select("db_id", F.col("reltype").alias("oid"))
    own = pg_type.where(F.col("typtype").isin("c", "d", "r")).join(row_types, ["db_id", "oid"], "left_anti")
    named = _in_schemas(own.drop("base_type"), "typnamespace", pg_namespace, schemas)
    full = named.join(attributes, ["db_id", "oid"], "left").join(domains, ["db_id", "oid"], "left")
    return _with_comment(full, pg_description, "pg_type", redact_comments).select(
        "db_id",
        "schema_name",
        F.col("typname").alias("type_name"),
        codes.recode(F.col("typtype"), codes.TYPE_KINDS, F.lit("other")).alias("type_kind"),
        "attributes",
        F.coalesce("base_type", F.lit("")).alias("base_type"),
        "constraint",
        "comment",
    )


def routines(
    pg_proc: DataFrame, pg_namespace: DataFrame, pg_language: DataFrame, pg_description: DataFrame,
    schemas: Sequence[str], redact_definitions: bool = False, redact_comments: bool = False,
) -> DataFrame:
    """Functions and procedures with zipped arguments."""
    languages = pg_language.select("db_id", F.col("oid").alias("prolang"), F.col("lanname").alias("language"))
    named = _in_schemas(pg_proc.where(F.col("prokind").isin("f", "p")), "pronamespace", pg_namespace, schemas)
    definition = F.lit(None).cast("string") if redact_definitions else F.col("definition")
    return _with_comment(named.join(languages, ["db_id", "prolang"]), pg_description, "pg_proc", redact_comments).select(
        "db_id",
        "schema_name",
        F.col("proname").alias("routine_name"),
        F.col("oid").alias("routine_oid"),
        codes.recode(F.col("prokind"), codes.ROUTINE_KINDS, F.lit("function")).alias("routine_type"),
        "language",
        codes.routine_arguments(F.col("proargnames"), F.col("proargtypes"), F.col("proargmodes")).alias("arguments"),
        F.coalesce("result", F.lit("")).alias("return_type"),
        definition.alias("definition"),
        "comment",
    )


def views(
    info_views: DataFrame, classes: DataFrame, pg_description: DataFrame, schemas: Sequence[str],
    redact_definitions: bool = False, redact_comments: bool = False,
) -> DataFrame:
    """Views with definition and comment, each left out when redacted."""
    base = info_views.where(F.col("table_schema").isin(*schemas)).select(
        "db_id",
        F.col("table_schema").alias("schema_name"),
        "table_name",
        (F.lit(None).cast("string") if redact_definitions else F.col("view_definition")).alias("definition"),
    )
    if redact_comments:
        return base.withColumn("comment", F.lit(""))
    return with_object_comment(base, classes, pg_description)


def view_dependencies(
    pg_depend: DataFrame, pg_rewrite: DataFrame, classes: DataFrame, views: DataFrame
) -> DataFrame:
    """Distinct (view, dependency) rows, never the view itself; kinds r and v only.

    A view's dependencies have no fixed bound, so they stay one row each.
    """
    rules = pg_depend.where((F.col("classid") == "pg_rewrite") & (F.col("refclassid") == "pg_class")).select(
        "db_id", F.col("objid").alias("rule"), F.col("refobjid").alias("dep_oid")
    )
    rewrites = pg_rewrite.select("db_id", F.col("oid").alias("rule"), F.col("ev_class").alias("oid"))
    targets = classes.where(F.col("relkind").isin("r", "v")).select(
        "db_id", F.col("oid").alias("dep_oid"), F.col("schema_name").alias("dep_schema"),
        F.col("table_name").alias("dep_name"), F.col("relkind").alias("dep_kind"),
    )
    return (
        rules.join(rewrites, ["db_id", "rule"])
        .select("db_id", "oid", "dep_oid")
        .distinct()
        .join(table_scope(views, classes), ["db_id", "oid"])
        .join(targets, ["db_id", "dep_oid"])
        .where((F.col("dep_schema") != F.col("schema_name")) | (F.col("dep_name") != F.col("table_name")))
        .select(*KEY, "dep_kind", codes.unqualified_public(F.col("dep_schema"), F.col("dep_name")).alias("dependency"))
    )


def column_stats(pg_stats: DataFrame) -> DataFrame:
    """Null fraction as is; the distinct count only where it is a count, not a fraction."""
    return pg_stats.select(
        "db_id",
        F.col("schemaname").alias("schema_name"),
        F.col("tablename").alias("table_name"),
        F.col("attname").alias("column_name"),
        F.col("null_frac").alias("null_fraction"),
        F.when(F.col("n_distinct") > 0, F.col("n_distinct").cast("bigint")).alias("distinct_count_estimate"),
    )


def table_stats(tables: DataFrame, column_stats: DataFrame, computed_at: str) -> DataFrame:
    """One header row per table plus the number of columns with statistics.

    ``tables`` carries ``row_count_estimate``; the per-column part stays in the
    ``column_stats`` frame.
    """
    counted = merged(column_stats.groupBy(*KEY).agg(F.count("*").alias("column_stat_count")))
    return tables.join(counted, KEY, "left").select(
        *KEY,
        F.lit(computed_at).alias("computed_at"),
        F.lit("estimate").alias("sampling_strategy"),
        "row_count_estimate",
        F.coalesce("column_stat_count", F.lit(0).cast("bigint")).alias("column_stat_count"),
        F.lit(STATS_NOTE).alias("note"),
    )


def databases(pg_database: DataFrame) -> DataFrame:
    return pg_database.select(
        "db_id", F.col("datname").alias("name"), F.lit("postgresql").alias("engine"), "version"
    )
