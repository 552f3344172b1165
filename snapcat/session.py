"""Session settings shared by the bench, the tests and the examples."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "snapcat", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; sizing is left to the cluster unless given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Split a skewed join side even where that costs another shuffle.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # Sizes before execution are guesses, and far too low after an explode: broadcast by measured size only.
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
        # A full run holds several hundred stages; keep their compiled code.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where it names none, one in the warehouse, which is shared too.

    On a cluster, a warehouse in a local folder is another one on every machine, and is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    local = spark._jvm.org.apache.hadoop.fs.Path(warehouse).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"
    if local and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    return f"{warehouse}/_settled"


#: Files of a shuffle go when the query that made them has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """While it lasts, what is written takes its shuffles with it: nothing reads them again, and on disk they are many times the result."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def settle(frame: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Cuts the lineage like a checkpoint and survives lost executors, but computes
    the frame once, and later reads take only the columns they need. The files
    go when ``release`` is told that nothing reads them any more, or when the application ends;
    the shuffles that made them go at once.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    with tidy(spark):
        frame.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(frame.schema).parquet(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength() > SMALL_FILES:
        out = merged(out)
    out.settled_path = path
    return out


#: Files of so many bytes hold few rows however well they are packed; the planner may broadcast them.
SMALL_FILES = 1 << 18


def merged(frame: DataFrame) -> DataFrame:
    """The frame for joins by sorting. Files of a catalog are a few bytes a row, so the planner would take millions of rows for
    small and collect them on the driver to broadcast them."""
    return frame.hint("merge")


def release(*frames: DataFrame) -> None:
    """Delete the files of settled frames that nothing planned or returned reads any more; rounds of an iteration go this way."""
    for frame in frames:
        if path := getattr(frame, "settled_path", None):
            spark = frame.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            system = place.getFileSystem(spark._jsc.hadoopConfiguration())
            system.delete(place, True)
            system.cancelDeleteOnExit(place)
            frame.settled_path = None
