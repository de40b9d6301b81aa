"""What the operators share: shared-folder tables, hashing and input shaping."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Removed at both ends of a line, and what separates words.
SPACES = " \t\n\x0b\x0c\r"
#: Rows of a small table's file.
ROWS_A_FILE = 200_000
#: Bytes of rows that go to a Python worker at once, however long their texts are.
BATCH_BYTES = 16 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, named by spark.checkpoint.dir; a session of one machine may do with a temporary one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found and (context.master == "local" or context.master.startswith("local[")):
        found = f"{tempfile.gettempdir()}/loomgraph-checkpoints"
    if not found:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found.rstrip("/")


def release() -> None:
    """Give back the memory that a Python worker has freed: idle workers stand beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``run`` for mapInPandas; the worker's memory goes back when the task ends."""

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(batches)
        finally:
            release()

    return held


class SharedTables:
    """Parquet tables in the shared folder that cut lineage and survive lost executors; they go when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        system, root = self._file("")
        system.mkdirs(root)
        system.deleteOnExit(root)

    def _file(self, name: str):
        """The file system and the path of one of the tables."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Write ``df`` and read it back; about ``rows`` rows, if known, go to as few files as they fill."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        if rows is not None:
            df = df.coalesce(-(-max(1, rows) // ROWS_A_FILE))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, number: int) -> None:
        """Delete a table that no later step reads."""
        system, path = self._file(str(number))
        system.delete(path, True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; texts of ASCII bytes take the JVM's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named by their places, and the place of each exact name: names may hold dots or differ in case only."""
    places = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*places), dict(zip(reversed(docs.columns), reversed(places)))


def exact(docs: DataFrame, *names: str) -> DataFrame:
    """The columns of these exact names."""
    own, at = numbered(docs)
    return own.select(*[F.col(at[n]).alias(n) for n in dict.fromkeys(names)])


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``gone``'s only column; null keys stay."""
    own, at = numbered(docs)
    return own.join(gone.toDF("_gone").distinct(), F.col(at[key]) == F.col("_gone"), "left_anti").toDF(*docs.columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
