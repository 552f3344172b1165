"""Documents as text files at their own paths, written by the tasks that hold them.

Spark's text writer names its files itself and puts keys into folder names. ``DocumentFiles`` is a Spark data source that
writes each document to ``root/path`` instead. The parts of a document arrive in order in one task, which has one file
open at a time and never holds more than a part, so neither the number nor the length of documents matters. A file is written
beside its place and moved there when it is whole. A task that is repeated, or runs twice, writes the same files
again. When all tasks have ended the commit writes ``_SUCCESS`` with the number of documents and bytes; a failed run has none.

The root is any address that ``pyarrow.fs`` knows (``file:``, ``s3:``, ``hdfs:`` ...), seen by all executors. Files
of an earlier run that this one does not write stay. Path parts ``.`` and ``..`` are spelled with ``%2E``, empty ones are dropped, so
nothing is written outside the root. A null document has no file; an empty one has an empty file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, part int, doc string"


def place_of(root: str, path: str) -> str:
    """The address of a document's file below the root."""
    parts = (p.replace(".", "%2E") if p in (".", "..") else p for p in path.split("/") if p)
    return "/".join([root.rstrip("/"), *parts])


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote."""

    documents: int
    size: int


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows of (path, part, doc), sorted; equal paths are one file."""
        store, root = fs.FileSystem.from_uri(self.root)
        done = Written(0, 0)
        path, file, staged = None, None, ""

        def close() -> None:
            if file is not None:
                file.close()
                store.move(staged, place_of(root, path))

        try:
            for batch in iterator:
                for next_path, doc in zip(batch.column("path").to_pylist(), batch.column("doc"), strict=True):
                    if file is None or next_path != path:
                        close()
                        file, path = None, next_path
                        folder, _, name = place_of(root, path).rpartition("/")
                        store.create_dir(folder, recursive=True)
                        staged = f"{folder}/.{name}.{uuid.uuid4().hex}"
                        file = store.open_output_stream(staged)
                        done.documents += 1
                    text = (doc.as_py() or "").encode()
                    file.write(text)
                    done.size += len(text)
            close()
        except BaseException:
            if file is not None and not file.closed:
                file.close()
                store.delete_file(staged)
            raise
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.root)
        store.create_dir(root, recursive=True)
        written = [m for m in messages if m]
        with store.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(json.dumps({"documents": sum(m.documents for m in written), "bytes": sum(m.size for m in written)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Whole files stay where they are; without ``_SUCCESS`` the run does not count."""


class DocumentFiles(DataSource):
    """Write-only source ``document_files``: option ``path`` is the root."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def write_files(docs: DataFrame, root: str) -> None:
    """Writes documents (path, part, doc) below the root, each to one file, parts in order."""
    spark = docs.sparkSession
    spark.dataSource.register(DocumentFiles)
    rows = docs.where("path IS NOT NULL AND doc IS NOT NULL").select("path", F.col("part").cast("int").alias("part"), "doc")
    # A path is dealt to one task; the parts of a long document pass through it one after the other.
    rows.repartition("path").sortWithinPartitions("path", "part").write.format("document_files").option("path", address(root)).mode("append").save()


def address(root: str) -> str:
    return root if ":/" in root else f"file://{root}"


def read_files(docs_root: str, spark: SparkSession) -> DataFrame:
    """(path, doc) of the files below a root; empty files have no row."""
    found = spark.read.text(docs_root, wholetext=True, recursiveFileLookup=True)
    base = F.regexp_replace(F.lit(address(docs_root).rstrip("/")), "^[a-z0-9]+:/+", "/")
    file = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/+", "/")
    return found.select(F.substr(file, F.length(base) + 2).alias("path"), F.col("value").alias("doc"))
