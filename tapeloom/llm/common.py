"""What several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_bucket(key: Column, buckets: int) -> Column:
    """crc32 of the key as text, modulo ``buckets``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % buckets


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
