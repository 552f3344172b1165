"""Group F: what columns mean, by name and type (case-sensitive)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcat.operators.catalog import KEY
from snapcat.operators.names import contains_any

# Names, endings and types of each class.
ID_NAMES, ID_ENDINGS = ("id", "uuid"), ("_id", "_uuid")
TIME_NAMES, TIME_ENDINGS = ("created", "updated", "deleted"), ("_at", "_date", "_time")
STATUS_NAMES, STATUS_ENDINGS = ("status", "state"), ("_status", "_state")
MONEY_TYPES = ("money", "numeric")
MONEY_WORDS = ("amount", "price", "cost", "total", "balance")


def _named(name: Column, names: tuple[str, ...], endings: tuple[str, ...]) -> Column:
    found = name.isin(*names)
    for ending in endings:
        found = found | name.endswith(ending)
    return found


def is_id(name: Column) -> Column:
    return _named(name, ID_NAMES, ID_ENDINGS)


def is_timestamp(name: Column, data_type: Column) -> Column:
    return data_type.contains("timestamp") | (data_type == "date") | _named(name, TIME_NAMES, TIME_ENDINGS)


def is_status(name: Column) -> Column:
    return _named(name, STATUS_NAMES, STATUS_ENDINGS)


def is_currency(name: Column, data_type: Column) -> Column:
    return (data_type.isin(*MONEY_TYPES) | data_type.contains("decimal")) & contains_any(name, MONEY_WORDS)


CLASSES = ("status", "timestamp", "currency_amount", "id")


def column_classes(columns: DataFrame) -> DataFrame:
    """One flag per class; a column may fall in several."""
    name, kind = F.col("column_name"), F.col("data_type")
    return columns.withColumns(
        {
            "is_status": is_status(name),
            "is_timestamp": is_timestamp(name, kind),
            "is_currency_amount": is_currency(name, kind),
            "is_id": is_id(name),
        }
    )


def column_semantics(columns: DataFrame) -> DataFrame:
    """Per table, the columns of each class in column order (at most 1,600 per table).

    Tables with no such column are absent.
    """
    def listed(kind: str) -> Column:
        hits = F.collect_list(F.when(F.col(f"is_{kind}"), F.struct("ordinal_position", "column_name")))
        return F.sort_array(hits)["column_name"].alias(f"{kind}_columns")

    classed = column_classes(columns).where(" OR ".join(f"is_{kind}" for kind in CLASSES))
    return classed.groupBy(*KEY).agg(*(listed(kind) for kind in CLASSES))
