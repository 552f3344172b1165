"""Where intermediate frames go, and how long they stay."""

import pathlib

import pytest
from pyspark.sql import functions as F

from snapcat import session
from snapcat.operators import relations


def settled(spark):
    return {p.name for p in pathlib.Path(session.shared_folder(spark).removeprefix("file:")).glob("settled-*")}


def test_release(spark):
    frame = session.settle(spark.range(3))
    path = frame.settled_path
    assert frame.count() == 3 and path.rpartition("/")[2] in settled(spark)
    session.release(frame, spark.range(1))
    session.release(frame)
    assert path.rpartition("/")[2] not in settled(spark)


def test_rounds_of_an_iteration_go(spark, monkeypatch):
    """A cycle of many tables takes many rounds; the files of a few frames are there at any time."""
    n, before, most = 200, settled(spark), [0, 0]
    keep = session.settle

    def counting(frame):
        out = keep(frame)
        most[0] = max(most[0], len(settled(spark) - before))
        most[1] += 1
        return out

    monkeypatch.setattr(relations, "settle", counting)
    edges = spark.createDataFrame([(1, "s", f"t{k}", "s", f"t{(k + 1) % n}") for k in range(n)] + [(1, "s", "a", "s", "b")], "db_id long, from_schema string, from_table string, to_schema string, to_table string")
    assert {r.component_size for r in relations.strongly_connected(edges).collect()} == {n}
    assert most[1] > 12 and most[0] <= 9
    assert len(settled(spark) - before) <= 3


def test_local_warehouse_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return "file:/somewhere/warehouse" if key == "spark.sql.warehouse.dir" else default

    class Cluster:
        def __init__(self):
            self.conf, self._jvm, self._jsc, self.sparkContext = Conf(), spark._jvm, spark._jsc, Context()

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(Cluster())
    Context.master = "local[8]"
    assert session.shared_folder(Cluster()) == "file:/somewhere/warehouse/_settled"


def test_shuffles_of_a_written_frame_go(spark, monkeypatch):
    """What is settled takes the files of its shuffles with it, and the session is as it was."""
    modes, write = [], session.shared_folder
    monkeypatch.setattr(session, "shared_folder", lambda s: modes.append(s.conf.get(session.CLEANUP)) or write(s))
    before = spark.conf.get(session.CLEANUP, "false")
    with session.tidy(spark):
        assert spark.conf.get(session.CLEANUP) == "true"
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    first = session.settle(frame)
    # The frame itself can be asked again, and shared parts of it written twice.
    assert sorted(first.collect()) == sorted(frame.collect()) == sorted(session.settle(frame.unionByName(first)).distinct().collect())
    assert spark.conf.get(session.CLEANUP, "false") == before and modes


def test_large_settled_frames_are_not_broadcast(spark, monkeypatch, capsys):
    """Files are a few bytes a row: what they hold can be far larger than the planner takes it for."""
    rows = spark.range(50).selectExpr("id AS k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        for small, said in ((1 << 18, True), (0, False)):
            monkeypatch.setattr(session, "SMALL_FILES", small)
            session.settle(rows).join(session.settle(rows), "k").explain()
            assert ("BroadcastHashJoin" in capsys.readouterr().out) == said
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
