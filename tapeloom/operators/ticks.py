"""Tick summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.ordered import over_rows


def tick_metrics(df: DataFrame, keys, time, bid, ask) -> DataFrame:
    """Tick count, mean spread and price change from the first to the last tick."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tick_count"),
        F.avg(F.col(ask) - F.col(bid)).alias("avg_spread"),
        (F.max_by(bid, F.struct(*time)) - F.min_by(bid, F.struct(*time))).alias("price_change"),
    )


def interval_volatility(df: DataFrame, keys, order, price, time, span, name) -> DataFrame:
    """Population deviation of price changes per interval of ``span``; one change gives 0."""

    def build(rows, lay):
        return rows.withColumn("_d", F.col(price) - F.lag(price).over(lay.ordered()))

    moved = over_rows(df.select(*keys, *order, price), keys, order, build, before=1)
    return moved.groupBy(*keys, F.floor(F.col(time) / span).alias(name)).agg(
        F.coalesce(F.stddev_pop("_d"), F.lit(0.0)).alias("volatility"), F.count("_d").alias("moves")
    )
