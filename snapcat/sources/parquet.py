"""Catalog frames of tables that come as Parquet files without a catalog."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet_tables(spark: SparkSession, folder: str, names: list[str], db_id: int = 0, schema: str = "public") -> dict[tuple[int, str, str], DataFrame]:
    """Frames of the files ``folder/name.parquet`` by (db_id, schema, name)."""
    return {(db_id, schema, name): spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def catalog_frames(tables: Mapping[tuple[int, str, str], DataFrame]) -> dict[str, DataFrame]:
    """``tables`` and ``columns`` as the snapshot has them, from the schemas of the files."""
    spark = next(iter(tables.values())).sparkSession
    listed, columns = [], []
    for (db_id, schema, name), df in tables.items():
        key = [F.lit(db_id).cast("bigint").alias("db_id"), F.lit(schema).alias("schema_name"), F.lit(name).alias("table_name")]
        listed.append(F.struct(*key, F.lit("").alias("comment")))
        columns += [
            F.struct(
                *key, F.lit(f.name).alias("column_name"), F.lit(k).alias("ordinal_position"), F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(f.nullable).alias("nullable"), F.lit(None).cast("string").alias("comment"))
            for k, f in enumerate(df.schema.fields, 1)
        ]
    one = spark.range(1)
    return {"tables": one.select(F.inline(F.array(*listed))), "columns": one.select(F.inline(F.array(*columns)))}
