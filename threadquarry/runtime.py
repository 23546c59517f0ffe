"""Table access and the ways this library cuts a plan's lineage."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Upper bound, in bytes, of a side that an operator broadcasts on its own account.
BROADCAST_BYTES = 8 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the workers, once per application: a zip that Spark hands to every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="threadquarry-")  # the driver's own; executors fetch the file from it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    base = os.path.join(folder, "threadquarry")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer partitions than there are cores: costly functions of rows should not
    wait for one task. Tables with enough partitions, and what comes out of a shuffle, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if re.search("(?<!Broadcast)Exchange", df._jdf.queryExecution().executedPlan().toString()):
        return df  # shuffled anyway; counting its partitions would run it
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@functools.cache
def _own_dir() -> str:
    """A folder for this process alone, gone with it."""
    path = tempfile.mkdtemp(prefix="threadquarry-shared-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests on one machine)."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; a cluster needs a folder that all executors share")
    return "file://" + _own_dir()


_ROOTS: list[tuple[object, str]] = []


@atexit.register
def _clear() -> None:
    """Remove what this process wrote, as far as its JVM still answers; the owner of the folder clears the rest."""
    for jvm, root in _ROOTS:
        try:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the process is ending
            return


class Scratch:
    """Written intermediate tables: each cuts the lineage, and survives the loss of executors.

    ``keep`` writes a table below the shared folder and returns it as a fresh scan. ``drop`` removes a superseded one.
    What an operator returns may still read its last tables, so those stay until the process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _ROOTS.append((spark.sparkContext._jvm, self.root))

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = self.path(name)
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            path = getattr(df, "_scratch_path", None)
            if path:
                jvm = self.spark.sparkContext._jvm
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
