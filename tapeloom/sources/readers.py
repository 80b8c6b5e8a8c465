"""Scans of trade, decision, metric, tick, depth, calendar and news logs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.scalar import parse_time, safe_double
from tapeloom.sources.schemas import TRADE, TRADE_LOG


def snake_case(name: str) -> str:
    """``eventTime`` -> ``event_time``; already lower-case names stay."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(c) for c in df.columns])


def _text_csv(spark: SparkSession, path, sep: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).csv(path)


def typed(column: Column, dtype: T.DataType) -> Column:
    """Text as ``dtype``; values that do not fit become null, NaN too."""
    if isinstance(dtype, T.StringType):
        return column
    number = column.try_cast("double")
    number = F.when(~F.isnan(number), number)
    return number if isinstance(dtype, T.DoubleType) else number.try_cast(dtype)


def project(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Known fields in schema order with their types; absent ones are null."""
    have = set(df.columns)
    return df.select(
        *[
            (typed(F.col(f.name), f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )


def read_trades_csv(spark: SparkSession, path: str, schema: T.StructType = TRADE) -> DataFrame:
    """Comma-separated trade log: lower-case names, typed columns, parsed ``event_time``."""
    raw = _text_csv(spark, path, ",")
    raw = raw.toDF(*[c.lower() for c in raw.columns])
    known = {f.name: f.dataType for f in schema}
    return raw.select(
        *[
            (parse_time(c) if c == "event_time" else typed(F.col(c), known.get(c, T.StringType()))).alias(c)
            for c in raw.columns
        ]
    )


def read_trade_files(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = TRADE_LOG) -> DataFrame:
    """Union of semicolon-separated logs, projected to the known fields, all as text.

    Files may differ in the order and set of their columns: those with the same header line are one
    scan, fields that a file lacks are null, empty files have no rows.  Files are listed without
    their contents, and one line of each is read ahead.
    """
    listed = spark.read.format("binaryFile").load(paths).where("length > 0").select("path")
    by_header: dict[str, list[str]] = {}
    for row in listed.toLocalIterator():
        head = spark.read.text(row["path"]).head()
        by_header.setdefault(head[0] if head else "", []).append(row["path"])
    out = spark.createDataFrame([], T.StructType([T.StructField(f.name, T.StringType()) for f in schema]))
    for files in by_header.values():
        raw = _text_csv(spark, files, ";")
        raw = raw.toDF(*[c.lower() for c in raw.columns])
        have = set(raw.columns)
        out = out.unionByName(raw.select(*[(F.col(f.name) if f.name in have else F.lit(None).cast("string")).alias(f.name) for f in schema]))
    return out


def read_decisions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Calendar rows (time, impact, id); a missing id is the row's place in time order."""
    from tapeloom.operators.ordered import row_index

    raw = normalise_columns(_text_csv(spark, path, ","))
    rows = raw.select(
        F.coalesce(F.try_to_timestamp("time"), parse_time("time")).cast("timestamp_ntz").alias("time"),
        safe_double("impact").alias("impact"),
        (F.col("id").try_cast("long") if "id" in raw.columns else F.lit(None).cast("long")).alias("id"),
    ).filter(F.col("time").isNotNull())
    placed = row_index(rows.withColumn("_tie", F.xxhash64("time", "impact", "id")), [], ["time", "_tie"], "_n")
    return placed.select("time", "impact", F.coalesce("id", "_n").alias("id"))


def read_news_embeddings(spark: SparkSession, parquet: str | None = None, csv: str | None = None) -> DataFrame:
    """News vectors from Parquet if it is there, else from CSV; a damaged Parquet file is an error."""
    if parquet is not None:
        try:
            return normalise_columns(spark.read.parquet(parquet))
        except AnalysisException as missing:
            if csv is None or missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return normalise_columns(spark.read.option("header", True).option("inferSchema", True).csv(csv))


def read_ticks(spark: SparkSession, path: str, features: Sequence[str] = ()) -> DataFrame:
    """Semicolon-separated ticks: time, bid, ask, optional latency and feature vector."""
    raw = _text_csv(spark, path, ";")
    names = sorted(features)
    have = set(raw.columns)

    def number(c):
        return safe_double(c) if c in have else F.lit(0.0)

    return raw.select(
        parse_time("time").alias("time"), number("bid").alias("bid"), number("ask").alias("ask"),
        number("latency").alias("latency"),
        F.array(*[number(f) for f in names]).cast("array<double>").alias("features"),
    )


def parse_depth(df: DataFrame, columns: Sequence[str] = ("bid_depth", "ask_depth")) -> DataFrame:
    return df.withColumns({c: F.from_json(c, "array<double>") for c in columns})


def join_depth(df: DataFrame, depth: DataFrame, time: str | None = "event_time", order: Sequence[str] = (), depth_order: Sequence[str] = ()) -> DataFrame:
    """Depth arrays by time; without a common time by row position in the given orders."""
    if time is not None:
        return df.join(depth, time, "left")
    from tapeloom.operators.ordered import row_index

    new = [c for c in depth.columns if c not in df.columns]
    left = row_index(df, [], order, "_i")
    right = row_index(depth, [], depth_order, "_i").select("_i", *new)
    return left.join(right, "_i", "left").drop("_i")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each input file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_json_log(spark: SparkSession, path: str, schema: T.StructType, version: int) -> tuple[DataFrame, DataFrame]:
    """JSON-lines log: rows of the expected version, and rejected lines with the reason."""
    parsed = parse_json_lines(spark.read.text(path), schema, version)
    return parsed.filter("reason IS NULL").select("row.*"), parsed.filter("reason IS NOT NULL").select("value", "reason")


def parse_json_lines(lines: DataFrame, schema: T.StructType, version: int) -> DataFrame:
    """Add ``row`` and the reject ``reason`` (bad json, missing field, other version)."""
    wanted = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    row = F.from_json("value", wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.select("value", row.alias("_r"))
    gaps = [F.col(f"_r.{f.name}").isNull() for f in schema if f.name != "schema_version"]
    absent = gaps[0]
    for g in gaps[1:]:
        absent = absent | g
    reason = F.when(F.col("_r._corrupt_record").isNotNull() | F.col("_r").isNull(), "bad json").when(absent, "missing or mistyped field")
    if "schema_version" in schema.names:
        reason = reason.when(F.coalesce(F.col("_r.schema_version"), F.lit(version)) != version, "schema version mismatch")
    return rows.withColumn("reason", reason).withColumn("row", F.struct(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema])).drop("_r")


def read_log_table(spark: SparkSession, url: str, driver: str, lower: int, upper: int, partitions: int, table: str = "logs") -> DataFrame:
    """A ``logs`` table over JDBC, read in ``event_id`` ranges; needs the driver's jar."""
    return (
        spark.read.format("jdbc").option("url", url).option("dbtable", table).option("driver", driver)
        .option("partitionColumn", "event_id").option("lowerBound", lower).option("upperBound", upper)
        .option("numPartitions", partitions).load()
    )


def kafka_stream(spark: SparkSession, brokers: str, topic: str, schema: T.StructType, version: int, max_offsets: int = 1_000_000) -> DataFrame:
    """JSON messages of a topic from the earliest offset, as ``value``, ``row`` and ``reason``; needs the Kafka
    connector jar.  Messages that don't fit have a reason and belong in the quarantine."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic)
        .option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", max_offsets).load()
    )
    return parse_json_lines(raw.select(F.col("value").cast("string").alias("value")), schema, version)


def follow_csv(spark: SparkSession, folder: str, schema: T.StructType, sep: str = ";", files_per_trigger: int = 100) -> DataFrame:
    """Rows of files as they arrive in ``folder``."""
    return (
        spark.readStream.schema(schema).option("header", True).option("sep", sep)
        .option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    )
