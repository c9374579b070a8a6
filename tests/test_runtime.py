"""Shared folder, bounds on broadcasts and on what is dealt out again."""

import os

import pytest
from pyspark.sql import functions as F

from assize import runtime as R


def hinted(df):
    return "broadcast" in df._jdf.queryExecution().logical().toString().lower()


def test_broadcast_is_bounded_by_bytes(spark):
    few = spark.createDataFrame([(1, "x" * 1000, [1, 2], {"a": 1.0}, (None, "y"))], "k long, t string, l array<int>, m map<string,double>, s struct<a: int, b: string>")
    assert hinted(R.broadcast_if_small(few)) and not hinted(R.broadcast_if_small(few, 500))
    # few rows of long values are no small side, although their files compress well
    assert not hinted(R.broadcast_if_small(spark.range(3).select(F.repeat(F.lit("a"), 2_000_000).alias("t")), 1_000_000))
    assert R.memory_bytes(few.filter("false")) == 0 and R.broadcast_if_small(few.filter("false")).count() == 0
    assert R.memory_bytes(spark.createDataFrame([(None, None)], "a string, b array<string>")) > 0


def test_spread_is_bounded(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    df = R.table(spark, str(tmp_path), "t")
    assert R.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(R, "SPREAD_BYTES", 10)
    assert R.spread(df) is df


class _Cluster:
    """A session of a cluster, as far as the shared folder is concerned."""

    def __init__(self, root):
        self.conf = {"spark.checkpoint.dir": root}
        self.sparkContext = self._jsc = self

    def getCheckpointDir(self):
        return None

    def sc(self):
        return self

    def isLocal(self):
        return False


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        R.scratch_root(_Cluster(None))
    assert R.scratch_root(_Cluster("hdfs://shared/x/")) == "hdfs://shared/x"


def test_scratch_is_cleared(spark):
    folder = R.scratch_folder(spark)
    assert R.materialize(spark.range(5).toDF("k"), "t").count() == 5
    path = folder.removeprefix("file://")
    kept = [n for n in os.listdir(path) if n.startswith("t-")]
    assert kept and folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    R.clear_scratch(spark)
    assert not os.path.exists(path)
    assert R.materialize(spark.range(2).toDF("k"), "t").count() == 2
