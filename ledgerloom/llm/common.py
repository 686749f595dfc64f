"""Shared helpers of the training-data operators: tables, scratch tables, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import sys
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; removed when Python ends.

    Where the setting is missing a temporary folder is used, on a local master only: executors of
    a cluster could not see it.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="ledgerloom-llm-")
        _OWN[app] = f"{base.rstrip('/')}/llm-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, _OWN[app])
    return _OWN[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session has ended; nothing can be deleted any more
        pass


def _release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of tables already written: it acts on what the driver has collected.

    What the first collection lets go of on the Python side only the second one finds in the JVM.
    """
    for pause in (0.1, 0):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(pause)


class Stage:
    """A DataFrame written as Parquet in the shared folder and read again: lineage is cut there."""

    def __init__(self, df: DataFrame, label: str, partition_by: tuple[str, ...] = ()):
        self.spark = df.sparkSession
        _release(self.spark)
        self.path = f"{scratch_root(self.spark)}/{label}-{uuid.uuid4().hex[:8]}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Remove the files; only once nothing reads them any more."""
        _delete(self.spark, self.path)


def lean(run):
    """A batch function that gives freed memory back to the system when its task ends.

    Workers live on between tasks; without this, what one operator's arrays took stays with them.
    """

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def stage(df: DataFrame, label: str) -> DataFrame:
    return Stage(df, label).df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links as (id, root): root is the smallest id.

    Alternating large-star and small-star rounds on tables of links. Only minima are aggregated
    per node (so a hub is pre-aggregated), and every round is written to the shared folder. An id
    without a link to another id does not appear.
    """
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .distinct()
    )
    now = Stage(links, "links")
    mark = _mark(now.df)
    while mark[0]:
        both = now.df.select("u", "v").unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        mid = Stage(large, "links")
        low = mid.df.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            mid.df.join(low, "u")
            .select(F.inline(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            )))
            .filter("u <> v")
            .distinct()
        )
        new = Stage(small, "links")
        new_mark = _mark(new.df)
        now.drop()
        mid.drop()
        now = new
        if new_mark == mark:
            break
        mark = new_mark
    roots = now.df.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return now.df.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def _mark(links: DataFrame) -> tuple:
    """Count and order-free digest of a set of links."""
    h = F.xxhash64("u", "v")
    row = links.agg(
        F.count("*").alias("n"),
        F.sum(F.shiftright(h, 32)).alias("x"),
        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("y"),
    ).first()
    return (row["n"], row["x"], row["y"])


def ship(spark: SparkSession) -> None:
    """Let executors import this package where neither their path nor their folder has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if root in map(os.path.abspath, filter(None, known)) or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "ledgerloom"), "zip", root, "ledgerloom")
    context.addPyFile(archive)
