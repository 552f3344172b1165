"""Name parts and column names the heuristics look for, and plain substring tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Columns that do not count as payload of a junction table.
METADATA_COLUMNS = ("created_at", "updated_at", "created_by", "updated_by", "deleted_at", "id", "uuid")
# Parts of a name that suggest a junction table.
JUNCTION_NAMES = ("_to_", "_x_", "_has_", "_rel_", "_link_", "_map_", "_assoc_")

# Name parts and column names behind each tag.
LOOKUP_NAMES = ("_type", "_types", "_status", "_statuses", "_category", "_categories", "_kind", "_kinds", "_code",
                "_codes", "lookup_", "ref_")
LOOKUP_COLUMNS = ("name", "code", "value", "label")
AUDIT_NAMES = ("_audit", "_history", "_log", "_changelog", "audit_", "history_")
AUDIT_COLUMNS = ("action", "old_value", "new_value", "changed_by", "changed_at", "revision")
CONFIG_NAMES = ("config", "setting", "preference", "option")
CONFIG_KEYS = ("key", "name", "setting_key")
CONFIG_VALUES = ("value", "setting_value")
LOG_NAMES = ("_log", "_logs", "_event", "_events", "log_", "event_")
LOG_TIMES = ("logged_at", "event_time")
LOG_KINDS = ("event_type", "log_type", "action")


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Plain substring tests (``_`` would be a wildcard in LIKE)."""
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found
