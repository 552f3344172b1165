"""Column expressions that decode catalog codes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Catalog codes and their names.
CONSTRAINT_TYPES = {"p": "PRIMARY KEY", "u": "UNIQUE", "c": "CHECK", "x": "EXCLUSION", "f": "FOREIGN KEY"}
FK_ACTIONS = {"a": "NO ACTION", "r": "RESTRICT", "c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT"}
ARGUMENT_MODES = {"i": "IN", "o": "OUT", "b": "INOUT", "v": "VARIADIC", "t": "TABLE"}
ROUTINE_KINDS = {"f": "function", "p": "procedure"}
TYPE_KINDS = {"c": "composite", "d": "domain", "r": "range"}
TRIGGER_EVENTS = {4: "insert", 8: "delete", 16: "update", 32: "truncate"}
TRIGGER_BEFORE, TRIGGER_INSTEAD = 2, 64


def recode(col: Column, names: Mapping[str, str], otherwise: Column) -> Column:
    out = F
    for code, name in names.items():
        out = out.when(col == code, name)
    return out.otherwise(otherwise)


def constraint_type(col: Column) -> Column:
    """Unknown codes pass through."""
    return recode(col, CONSTRAINT_TYPES, col)


def fk_action(col: Column) -> Column:
    return recode(col, FK_ACTIONS, F.lit(""))


def argument_mode(col: Column) -> Column:
    return recode(F.lower(col), ARGUMENT_MODES, F.lit("IN"))


def trigger_timing(tgtype: Column) -> Column:
    return (
        F.when(tgtype.bitwiseAND(TRIGGER_BEFORE) > 0, "before")
        .when(tgtype.bitwiseAND(TRIGGER_INSTEAD) > 0, "instead of")
        .otherwise("after")
    )


def trigger_events(tgtype: Column) -> Column:
    return F.array_compact(
        F.array(*(F.when(tgtype.bitwiseAND(bit) > 0, name) for bit, name in TRIGGER_EVENTS.items()))
    )


def include_columns(definition: Column) -> Column:
    """Columns of an index definition's INCLUDE list; NULL where it has none."""
    rest = F.regexp_extract(definition, r"(?is)^.*? INCLUDE (.*)$", 1)
    inside = F.regexp_extract(rest, r"^[^()]*\(([^)]*)\)", 1)
    names = F.filter(
        F.transform(F.split(inside, ","), lambda name: F.btrim(name, F.lit(" \t\n\r"))), lambda name: name != ""
    )
    return F.when(F.size(names) > 0, names)


def routine_arguments(names: Column, types: Column, modes: Column) -> Column:
    """Zip by position; ``get`` yields NULL past the end of the shorter lists."""
    zipped = F.transform(
        types,
        lambda kind, i: F.struct(
            F.nullif(F.get(names, i), F.lit("")).alias("name"),
            kind.alias("data_type"),
            argument_mode(F.get(modes, i)).alias("mode"),
        ),
    )
    return F.when(F.size(types) > 0, zipped)


def unqualified_public(schema: Column, name: Column) -> Column:
    """``schema.name``, without the prefix for the public schema or none."""
    return F.when(schema.isin("public", ""), name).otherwise(F.concat(schema, F.lit("."), name))
