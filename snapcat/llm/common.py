"""Helpers shared by the operators of this package."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as words at a time.
WORK_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def runs(sizes: list[int], most: int = WORK_BYTES) -> Iterator[range]:
    """Consecutive positions whose sizes sum to at most ``most``; a larger single one stands alone."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield range(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield range(start, len(sizes))


def portions(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of an Arrow batch, about ``WORK_BYTES`` at a time."""
    sizes = [len(t) if (t := x.as_buffer()) is not None else 0 for x in texts]
    for run in runs(sizes):
        yield texts.slice(run.start, len(run)).to_pylist()


def word_blocks(raw: bytes, keep: int, most: int = 1 << 18) -> Iterator[list[bytes]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text, at most about ``most`` at a time; each block but the first begins
    with the last ``keep`` words of the one before. At least one block, without words if there are none."""
    if len(raw) <= 16 * most:
        yield raw.split()
        return
    found, held = (m[0] for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)), []
    while more := list(itertools.islice(found, most)):
        yield held + more
        held = (held + more)[-keep:] if keep else []


def row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits of id and text that name a row; rows with the same key are equal in both."""
    id_, text = F.col(id_col), F.col(text_col)
    return [F.xxhash64(F.isnull(id_), id_, F.isnull(text), text).alias("row_key_1"), F.xxhash64(F.lit(1), text, F.isnull(text), id_, F.isnull(id_)).alias("row_key_2")]


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
