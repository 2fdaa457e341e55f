"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, one in the warehouse, which a cluster's driver and executors
    share; a local session, as in tests, takes a folder of this machine."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        got = known.get() if known.isDefined() else None
    if not got:
        local = spark.sparkContext.master.startswith("local")
        got = f"file://{tempfile.mkdtemp(prefix='cubitgrid-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_cubitgrid"
        spark.sparkContext.setCheckpointDir(got)
    return got


class Tables:
    """A table written here replaces the lineage that made it, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/t{self.n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cubitgrid_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for df in dfs:
            if path := getattr(df, "_cubitgrid_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def clear(self) -> None:
        """Delete all tables that were written here."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
