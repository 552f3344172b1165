"""The whole catalog snapshot as lazy frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcat.operators import catalog as c
from snapcat.sources.lazy import LazyFrames


@dataclass(frozen=True)
class SnapshotConfig:
    schemas: tuple[str, ...] = c.DEFAULT_SCHEMAS
    include_views: bool = False
    include_routines: bool = False
    include_stats: bool = False
    redact_comments: bool = False
    redact_definitions: bool = False
    # Whether foreign keys say if they are nullable, for which they meet the columns.
    fk_nullable: bool = True
    # The column lists that foreign keys have: a list costs a join of its keys with the attributes.
    fk_lists: tuple[str, ...] = ("from_columns", "to_columns")
    # Without, tables have neither comment nor estimate, as where only their names are read.
    table_texts: bool = True
    # Types of the constraints that are read.
    constraint_types: tuple[str, ...] = c.KEY_TYPES
    # Stands for "now", so that equal inputs give equal documents.
    generated_at: str = "1970-01-01T00:00:00Z"


def snapshot(raw: Mapping[str, DataFrame], cfg: SnapshotConfig, keep: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> LazyFrames:
    """Normalised frames, each planned when first asked for.

    Parts that are switched off are absent. ``keep`` may write the frames that several others read
    (classes, listed tables, foreign keys), where each reading would cost joins of large relations.
    """
    @cache
    def classes() -> DataFrame:
        return keep(c.named_classes(raw["pg_class"], raw["pg_namespace"]))

    @cache
    def names() -> DataFrame:
        """Keys of the listed tables. Neither which tables are in scope nor which columns are theirs is told by a comment."""
        return c.table_names(raw["info_tables"], cfg.schemas).select(*c.KEY)

    @cache
    def listed() -> DataFrame:
        if not cfg.table_texts:
            return c.table_names(raw["info_tables"], cfg.schemas)
        listed = c.tables(raw["info_tables"], classes(), raw["pg_description"], cfg.schemas)
        return keep(listed.withColumn("comment", F.lit("")) if cfg.redact_comments else listed)

    @cache
    def scope() -> DataFrame:
        return c.table_scope(names(), c.of_tables(classes()))

    @cache
    def bare_columns() -> DataFrame:
        return c.columns(raw["info_columns"].where(F.col("table_schema").isin(*cfg.schemas)))

    @cache
    def all_columns() -> DataFrame:
        columns = bare_columns()
        if cfg.redact_comments:
            return columns.withColumn("comment", F.lit(None).cast("string"))
        return c.with_column_comments(columns, classes(), raw["pg_attribute"], raw["pg_description"])

    @cache
    def enums() -> DataFrame:
        return c.enums(raw["pg_type"], raw["pg_namespace"], raw["pg_description"], cfg.schemas, cfg.redact_comments)

    def foreign_keys() -> DataFrame:
        fks = c.foreign_keys(raw["pg_constraint"], scope(), classes(), raw["pg_attribute"], cfg.fk_lists)
        # The keys are those of listed tables, and which of their columns are nullable no comment tells.
        return keep(c.with_fk_nullable(fks, bare_columns()) if cfg.fk_nullable else fks)

    builders = {
        "databases": lambda: c.databases(raw["pg_database"]),
        "tables": lambda: listed().join(c.row_estimates(classes(), names()), c.KEY, "left") if cfg.table_texts else listed(),
        "columns": lambda: all_columns().join(names(), c.KEY, "left_semi"),
        "constraints": lambda: c.constraints(raw["pg_constraint"], scope(), raw["pg_attribute"], cfg.constraint_types),
        "indexes": lambda: c.indexes(raw["pg_index"], scope(), raw["pg_class"], raw["pg_am"], raw["pg_attribute"]),
        "foreign_keys": foreign_keys,
        "triggers": lambda: c.triggers(
            raw["pg_trigger"], scope(), raw["pg_proc"], raw["pg_namespace"], cfg.redact_definitions
        ),
        "enums": lambda: enums().drop("oid"),
        "enum_labels": lambda: c.enum_labels(enums(), raw["pg_enum"]),
        "sequences": lambda: c.sequences(
            raw["pg_sequence"], classes(), raw["pg_description"],
            c.sequence_owners(raw["pg_depend"], raw["pg_attribute"], classes()), cfg.schemas, cfg.redact_comments,
        ),
        "types": lambda: c.types(
            raw["pg_type"], raw["pg_namespace"], raw["pg_class"], raw["pg_description"],
            c.type_attributes(raw["pg_attribute"], raw["pg_type"]),
            c.domain_info(raw["pg_type"], raw["pg_constraint"]), cfg.schemas, cfg.redact_comments,
        ),
    }
    if cfg.include_views:
        builders["views"] = lambda: c.views(
            raw["info_views"], classes(), raw["pg_description"], cfg.schemas, cfg.redact_definitions, cfg.redact_comments
        )
        builders["view_columns"] = lambda: all_columns().join(out["views"].select(*c.KEY), c.KEY, "left_semi")
        builders["view_dependencies"] = lambda: c.view_dependencies(
            raw["pg_depend"], raw["pg_rewrite"], classes(), out["views"]
        )
    if cfg.include_routines:
        builders["routines"] = lambda: c.routines(
            raw["pg_proc"], raw["pg_namespace"], raw["pg_language"], raw["pg_description"], cfg.schemas, cfg.redact_definitions,
            cfg.redact_comments,
        )
    if cfg.include_stats:
        builders["column_stats"] = lambda: c.column_stats(raw["pg_stats"]).join(names(), c.KEY, "left_semi")
        builders["stats"] = lambda: c.table_stats(out["tables"], out["column_stats"], cfg.generated_at)
    out = LazyFrames(builders)
    return out
