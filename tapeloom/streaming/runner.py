"""Running streams to the end of the available input and reading what they wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tapeloom.session import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB state store, which also keeps state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def follow_parquet(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Rows of Parquet files as they arrive, a bounded number of files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def append_to_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Start the stream into a Parquet table; the file sink commits each batch once."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input into a new table and return it."""
    spark = stream.sparkSession
    path = new_folder(spark, name)
    append_to_table(stream, path, f"{path}-checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], name: str, mode: str = "append") -> None:
    """Process all available input, calling ``handle`` per micro-batch.

    A batch can be repeated after a failure with the same number; ``handle`` must write to
    places named by that number.
    """
    spark = stream.sparkSession
    path = new_folder(spark, name)
    stream.writeStream.outputMode(mode).foreachBatch(handle).option(
        "checkpointLocation", f"{path}-checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()


class Versions:
    """A small table kept as one folder per batch number; a repeated batch overwrites its own."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{batch:012d}")

    def read(self, before: int | None = None) -> DataFrame:
        """The newest version, or the newest older than ``before``; empty when there is none."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        done = sorted(
            n for n in names
            if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")) and (before is None or int(n[1:]) < before)
        )
        if not done:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{done[-1]}")
