"""File-system-safe object names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_name(name: Column) -> Column:
    """Lower case, runs of anything outside ``[a-z0-9_]`` as one ``_``, trimmed; never empty."""
    squeezed = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.btrim(squeezed, F.lit("_")), F.lit("")), F.lit("unnamed"))
