"""Columns of the catalog relations an export must hold.

An export is one Parquet directory per relation. Every relation carries
``db_id``, so one directory serves a whole fleet of databases. Text that only
the server can render (definitions, type names) arrives as columns.
"""

from __future__ import annotations

# Relation -> column -> type.
CATALOG_COLUMNS: dict[str, dict[str, str]] = {
    "pg_database": {"datname": "string", "version": "string"},
    "info_tables": {"table_schema": "string", "table_name": "string", "table_type": "string"},
    "info_columns": {
        "table_schema": "string",
        "table_name": "string",
        "column_name": "string",
        "data_type": "string",
        "udt_name": "string",
        "is_nullable": "string",
        "column_default": "string",
        "character_maximum_length": "int",
        "numeric_precision": "int",
        "numeric_scale": "int",
        "is_identity": "string",
        "identity_generation": "string",
        "is_generated": "string",
        "generation_expression": "string",
        "collation_name": "string",
        "ordinal_position": "int",
    },
    "info_views": {"table_schema": "string", "table_name": "string", "view_definition": "string"},
    "pg_class": {
        "oid": "bigint",
        "relname": "string",
        "relnamespace": "bigint",
        "relkind": "string",
        "reltuples": "double",
        "reltype": "bigint",
        "relam": "bigint",
    },
    "pg_namespace": {"oid": "bigint", "nspname": "string"},
    "pg_attribute": {
        "attrelid": "bigint",
        "attname": "string",
        "attnum": "int",
        "attisdropped": "boolean",
        "format_type": "string",
    },
    "pg_description": {"objoid": "bigint", "classoid": "string", "objsubid": "int", "description": "string"},
    "pg_constraint": {
        "oid": "bigint",
        "conrelid": "bigint",
        "confrelid": "bigint",
        "contypid": "bigint",
        "conname": "string",
        "contype": "string",
        "conkey": "array<int>",
        "confkey": "array<int>",
        "confupdtype": "string",
        "confdeltype": "string",
        "definition": "string",
    },
    "pg_index": {
        "indexrelid": "bigint",
        "indrelid": "bigint",
        "indisunique": "boolean",
        "indisprimary": "boolean",
        "indkey": "array<int>",
        "indexdef": "string",
        "predicate": "string",
        "expression": "string",
    },
    "pg_am": {"oid": "bigint", "amname": "string"},
    "pg_trigger": {
        "oid": "bigint",
        "tgrelid": "bigint",
        "tgfoid": "bigint",
        "tgname": "string",
        "tgtype": "int",
        "tgisinternal": "boolean",
        "definition": "string",
    },
    "pg_proc": {
        "oid": "bigint",
        "pronamespace": "bigint",
        "prolang": "bigint",
        "proname": "string",
        "prokind": "string",
        "proargnames": "array<string>",
        "proargtypes": "array<string>",
        "proargmodes": "array<string>",
        "result": "string",
        "definition": "string",
    },
    "pg_language": {"oid": "bigint", "lanname": "string"},
    "pg_type": {
        "oid": "bigint",
        "typnamespace": "bigint",
        "typrelid": "bigint",
        "typname": "string",
        "typtype": "string",
        "base_type": "string",
    },
    "pg_enum": {"enumtypid": "bigint", "enumlabel": "string", "enumsortorder": "double"},
    "pg_sequence": {
        "seqrelid": "bigint",
        "seqtype": "string",
        "seqstart": "bigint",
        "seqmin": "bigint",
        "seqmax": "bigint",
        "seqincrement": "bigint",
        "seqcycle": "boolean",
    },
    "pg_depend": {
        "classid": "string",
        "refclassid": "string",
        "objid": "bigint",
        "refobjid": "bigint",
        "refobjsubid": "int",
        "deptype": "string",
    },
    "pg_rewrite": {"oid": "bigint", "ev_class": "bigint"},
    "pg_stats": {
        "schemaname": "string",
        "tablename": "string",
        "attname": "string",
        "null_frac": "double",
        "n_distinct": "double",
        "most_common_vals": "string",
    },
}
