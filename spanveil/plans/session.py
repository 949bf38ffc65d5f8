"""Session helpers: reading tables, cutting lineage in shared storage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can read.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master, where all
    executors are this machine, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = os.path.join(tempfile.gettempdir(), "spanveil-shared")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """The intermediate tables of one run: written to the shared folder, dropped as soon as nothing needs them.

    What is left, tables that a returned DataFrame still reads, goes when the program ends.
    """

    _left: set[Scratch] = set()

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/spanveil/{uuid.uuid4().hex}"
        # Kept, so that what is left can still be dropped after the session has stopped.
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        Scratch._left.add(self)

    def path(self, what: str) -> str:
        return f"{self.root}/{what}"

    def stage(self, df: DataFrame, what: str) -> DataFrame:
        """Write ``df`` as a table and read it back: the lineage ends there, and a lost executor costs only a re-read."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(what))
        return self.spark.read.schema(df.schema).parquet(self.path(what))

    def read(self, what: str, schema: str) -> DataFrame:
        """Tables written before; ``what`` may be a pattern of their names."""
        return self.spark.read.schema(schema).parquet(self.path(what))

    def drop(self, *what: str) -> None:
        """Delete some of the tables, or all without a name."""
        for name in what or ("",):
            place = self._jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
            place.getFileSystem(self._conf).delete(place, True)
        if not what:
            Scratch._left.discard(self)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs in here go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@atexit.register
def _drop_left() -> None:
    for scratch in list(Scratch._left):
        try:
            scratch.drop()
        except Exception:  # noqa: BLE001  the session's process is gone: nothing can be deleted through it
            return


def stage(df: DataFrame, what: str) -> DataFrame:
    """One table in a folder of its own."""
    return Scratch(df.sparkSession).stage(df, what)


def busy(scan: DataFrame) -> DataFrame:
    """A scan for processor-bound work: spread out if it has fewer partitions than there are cores, as small files do."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
