"""Session helpers: tables, shared scratch space and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


#: Largest table, in bytes of its files, that is dealt out over the cores; a bound on what ``spread`` can ever shuffle.
SPREAD_BYTES = 64 << 20
#: Largest side of a join, in bytes of its values, that is broadcast.
BROADCAST_BYTES = 32 << 20


def _bytes_of_files(read: DataFrame) -> int:
    """The size of the files that a plain read of a table covers, as its file index has it."""
    return int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` on as many partitions as there are cores, if it reads files of at most SPREAD_BYTES in all that make fewer: a small file is one task otherwise.

    Larger inputs are never shuffled for it, however many cores there are; ``spark.sql.files.maxPartitionBytes`` decides on their tasks.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores or _bytes_of_files(df) > SPREAD_BYTES:
        return df
    return df.repartition(cores)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only a session that runs within this one process may do without: it gets a folder of this machine. On a cluster a missing
    setting is an error, as no folder of one machine can be read by the executors of others.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"assize-scratch-{os.getuid()}")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder. It is deleted when the application ends in order."""
    sc = spark.sparkContext
    folder = f"{scratch_root(spark)}/assize-{sc.applicationId}"
    if folder not in _KNOWN:
        _KNOWN.add(folder)
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


_KNOWN: set[str] = set()


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables that this application has written so far, as between the jobs of a long session; frames that read them can be used no more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage and lets several consumers share one computation; the files outlive any executor.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _value_bytes(c: Column, kind: T.DataType) -> Column:
    """An estimate from above of what a value takes in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        size = F.octet_length(c) + 24
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(c, F.lit(32).cast("long"), lambda n, x: n + _value_bytes(x, kind.elementType))
    elif isinstance(kind, T.StructType):
        size = sum((_value_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(24))
    elif isinstance(kind, T.MapType):
        size = _value_bytes(F.map_keys(c), T.ArrayType(kind.keyType)) + _value_bytes(F.map_values(c), T.ArrayType(kind.valueType))
    else:
        return F.lit(16).cast("long")
    return F.coalesce(size.cast("long"), F.lit(16).cast("long"))


def memory_bytes(df: DataFrame) -> int:
    """An estimate from above of what all rows take in memory."""
    row = sum((_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(32))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES, label: str = "side") -> DataFrame:
    """``df`` with a broadcast hint if it takes at most ``most`` bytes in memory, else unhinted: then the same join shuffles.

    The side is written once, so that measuring does not compute it a second time; one whose compressed files are larger is not measured at all.
    """
    return hinted(materialize(df, label), most)


def hinted(written: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A table that was written with ``materialize``, with a broadcast hint if it takes at most ``most`` bytes in memory."""
    small = _bytes_of_files(written) <= most and memory_bytes(written) <= most
    return F.broadcast(written) if small else written


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until ``df`` has no such column (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application, for clusters where it is not installed."""
    sc = spark.sparkContext
    done = getattr(ship_package, "done", None)
    if done == sc.applicationId:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="assize-"), "assize-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    ship_package.done = sc.applicationId
