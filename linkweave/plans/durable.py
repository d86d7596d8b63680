"""Intermediate tables that survive the loss of an executor.

Iterative operators cut their lineage by writing a Parquet table under the
session's shared checkpoint folder and reading it back: one pass over the data,
columnar and compressed, with footers that answer counts.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: spark.checkpoint.dir, else the context's, else (one-machine masters only) a temporary one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_root:
        made = tempfile.mkdtemp(prefix="linkweave-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _local_root[sc.applicationId] = "file://" + made
    return _local_root[sc.applicationId]


class Scratch:
    """Tables of one operator run; replaced ones are dropped so that disk stays at about two rounds."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/linkweave-{uuid.uuid4().hex}"
        self.made = 0
        at = self._path(self.root)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)  # with the session; results read these tables until then

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:04d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            at = self._path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    return Scratch(df.sparkSession).write(df, name)
