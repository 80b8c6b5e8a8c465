"""Sinks: checked appends, quarantine, high-water marks, retention, graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.sources.readers import project


def _plain(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema]


def append_checked(df: DataFrame, schema: T.StructType, path: str) -> DataFrame:
    """Append only when names, order and types equal ``schema``; otherwise nothing is written."""
    if _plain(df.schema) != _plain(schema):
        raise ValueError(f"schema mismatch: expected {_plain(schema)}, got {_plain(df.schema)}")
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def csv_to_parquet(spark: SparkSession, csv: str, schema: T.StructType, out: str, sep: str = ",") -> DataFrame:
    raw = spark.read.option("header", True).option("sep", sep).csv(csv)
    project(raw, schema).write.mode("overwrite").parquet(out)
    return spark.read.schema(schema).parquet(out)


def write_quarantine(rejected: DataFrame, path: str) -> None:
    rejected.write.mode("append").option("header", True).csv(path)


def newer_than_mark(df: DataFrame, mark_path: str, column: str = "event_id") -> DataFrame:
    """Rows above the stored high-water mark; all rows when there is none."""
    spark = df.sparkSession
    try:
        mark = spark.read.schema("last_id long").parquet(mark_path).agg(F.max("last_id")).first()[0]
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        mark = None
    return df if mark is None else df.filter(F.col(column) > mark)


def store_mark(df: DataFrame, mark_path: str, column: str = "event_id") -> None:
    """Append the highest processed id as the new mark (nothing for empty input)."""
    top = df.agg(F.max(column).cast("long").alias("last_id")).filter("last_id IS NOT NULL")
    top.coalesce(1).write.mode("append").parquet(mark_path)


def last_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows, oldest first (a bounded top-n, not a sort of everything)."""
    newest = df.orderBy(*[F.col(o).desc() for o in order]).limit(n)
    return newest.orderBy(*order)


def newest_per_key(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Keep the newest ``n`` rows per key; the rank filter is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def append_summary(summary: DataFrame, path: str) -> DataFrame:
    """Append one run's summary row with the time of writing."""
    summary.withColumn("time", F.current_timestamp()).write.mode("append").parquet(path)
    return summary.sparkSession.read.parquet(path)


def export_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def import_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def graph_json(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line per vertex and per edge."""
    v = vertices.select(F.lit("vertex").alias("kind"), F.to_json(F.struct("*")).alias("value"))
    return v.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("*")).alias("value")))
