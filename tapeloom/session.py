"""Session helpers: defaults for local runs and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Rows of a block of ordered operators; unset, rows are spread over the shuffle partitions.
BLOCK_ROWS_CONF = "spark.tapeloom.blockRows"


def local_session(cores: str = "8", shuffle_partitions: int = 8, name: str = "tapeloom") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def block_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BLOCK_ROWS_CONF, "0"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Rows of a part where tasks hold their rows in memory.
PART_ROWS = 1_000_000


def parts_for(df: DataFrame) -> int:
    """Parts of about PART_ROWS rows for a stored table, no fewer than shuffles have."""
    return max(shuffle_partitions(df.sparkSession), -(-df.count() // PART_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is used only when the setting is absent and the session is local;
    on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="tapeloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def pin(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and return the stored rows.

    Cuts the lineage: a lost executor re-reads the table, and values that depend on how rows
    were placed (positions, samples) stay what they were.  Later steps read only the columns
    they need and Spark knows the true size.  ``by`` sorts rows into folders, so that a filter on
    those columns reads its folders only.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pinned-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
