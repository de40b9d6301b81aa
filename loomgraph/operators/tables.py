"""Intermediate tables of iterative operators, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Rounds:
    """Writes the state of each round as Parquet, which cuts lineage and survives lost executors; older rounds are deleted."""

    def __init__(self, spark: SparkSession, name: str, keep: int = 3):
        context = spark.sparkContext
        root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not root and (context.master == "local" or context.master.startswith("local[")):
            root = f"{tempfile.gettempdir()}/loomgraph-checkpoints"  # one machine
        if not root:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        self.spark, self.root, self.n, self.kept = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0, keep
        system, path = self._file("")
        system.mkdirs(path)
        system.deleteOnExit(path)

    def save(self, df: DataFrame, temporary: bool = False) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        if temporary and self.n > self.kept:
            self.drop(self.n - self.kept)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, n: int) -> None:
        system, path = self._file(str(n))
        system.delete(path, True)

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path
