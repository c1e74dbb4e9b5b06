"""Cutting lineage and finding shared storage.

Everything that must outlive a stage goes to the folder named by ``spark.checkpoint.dir``, which every
executor and the driver can reach. Only a session without that setting (tests, a laptop) gets a
temporary folder, and only when its master is local.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI; sets one for a local session that has none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and return it without its lineage (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables and archives."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parquet_cut(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`cut`, but as a Parquet table: columnar and compressed, for wide intermediate rows."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """A folder of tables in shared storage for one operator, which deletes what is no longer needed.

    Every table leaves its plan, metrics and broadcasts behind on the driver, whose heap would grow to its limit before the JVM
    looks for them; so they are collected once in ``EVERY`` tables, and broadcasts nobody holds are then freed everywhere.
    """

    EVERY = 8

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self._at, self._written = spark, scratch(spark, name), {}, 0

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as a Parquet table and return it read from there, without its lineage."""
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._written += 1
        if self._written % self.EVERY == 0:
            self.spark._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that :meth:`cut` returned and no later step reads."""
        for df in tables:
            if found := self._at.pop(id(df), None):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(found[1])
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
