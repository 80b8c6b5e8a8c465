"""Pairing OPEN with CLOSE rows and matching predictions to realised trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.asof import asof
from tapeloom.operators.ordered import over_rows
from tapeloom.session import pin


def pair_open_close(
    log: DataFrame, ticket: str, time: str, keep: Sequence[str], profit: str = "profit", tie: str | None = None
) -> DataFrame:
    """One row per closed trade: the CLOSE row with the OPEN it consumes.

    A later OPEN replaces an earlier one of the same ticket and a CLOSE consumes it, so a
    CLOSE pairs exactly when the row before it in its ticket is an OPEN.
    """
    rows = log.filter(F.col("action").isin("OPEN", "CLOSE")).withColumn(
        "_late", (F.col("action") == "CLOSE").cast("int")
    )
    order = [time, *([tie] if tie else []), "_late"]
    cols = ["action", time, *keep]

    def build(df, lay):
        before = F.lag(F.struct(*cols)).over(lay.ordered())
        return df.withColumn("_open", before)

    paired = over_rows(rows.select(ticket, *cols, profit, *([tie] if tie else []), "_late"), [ticket], order, build, before=1)
    return paired.filter((F.col("action") == "CLOSE") & (F.col("_open.action") == "OPEN")).select(
        ticket,
        *[F.col(f"_open.{c}").alias(c) for c in keep],
        F.col(f"_open.{time}").alias("open_time"),
        F.col(time).alias("close_time"),
        F.col(profit).cast("double").alias(profit),
    )


def match_predictions(preds: DataFrame, trades: DataFrame, window: int) -> DataFrame:
    """Give each prediction at most one trade and each trade at most one prediction.

    First by ``decision_id`` (the earliest trade of a decision), then the remaining
    predictions take the next trade of their symbol and direction within ``window`` seconds
    among the remaining trades; a trade wanted by several goes to the earliest prediction and
    the others stay unmatched.
    """
    info = ["ticket", "open_time", "close_time", "profit", "order_type"]
    first = (
        trades.filter(F.col("decision_id").isNotNull())
        .groupBy("decision_id")
        .agg(F.min_by(F.struct(*info), F.struct("open_time", "ticket")).alias("trade"))
    )
    # Read three times below.
    by_id = pin(preds.filter(F.col("decision_id").isNotNull()).join(first, "decision_id").select("pred_id", "trade"))
    rest = preds.join(by_id.select("pred_id"), "pred_id", "left_anti")
    free = trades.join(by_id.select(F.col("trade.ticket").alias("ticket")), "ticket", "left_anti")
    near = asof(
        rest.select("pred_id", "timestamp", "symbol", "direction"),
        free.select(*info, "symbol", "direction"),
        ["symbol", "direction"], "timestamp", "open_time", "pred_id", "ticket", "forward", window,
    ).filter(F.col("match").isNotNull())
    owners = near.groupBy(F.col("match.ticket").alias("_ticket")).agg(
        F.min_by(F.struct("pred_id", F.struct(*[F.col(f"match.{c}") for c in info]).alias("trade")), F.struct("timestamp", "pred_id")).alias("o")
    ).select("o.pred_id", "o.trade")
    owned = by_id.unionByName(owners)
    return preds.join(owned, "pred_id", "left").select(
        preds["*"], *[F.col(f"trade.{c}").alias(c) for c in info], F.col("trade").isNotNull().alias("is_match")
    )


def unused_trades(trades: DataFrame, matched: DataFrame) -> DataFrame:
    return trades.join(matched.filter("is_match").select("ticket"), "ticket", "left_anti")


def score_vector(matched: DataFrame, trades: DataFrame) -> DataFrame:
    """(y, p): predictions with their outcome plus every unused trade as a missed positive."""
    seen = matched.filter(F.col("probability").isNotNull()).select(
        F.col("is_match").cast("int").alias("y"), F.col("probability").alias("p")
    )
    missed = unused_trades(trades, matched).select(F.lit(1).alias("y"), F.lit(0.0).alias("p"))
    return seen.unionByName(missed)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key, pre-aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def transitions(trades: DataFrame, order: Sequence[str], state: Sequence[str], action: str, reward: str) -> DataFrame:
    """(state, action, reward, next state) over trades in time order; the last repeats itself."""

    def build(df, lay):
        w = lay.ordered()
        return df.withColumns({f"next_{c}": F.coalesce(F.lead(c).over(w), F.col(c)) for c in state})

    rows = trades.select(*dict.fromkeys([*order, *state, action, reward]))
    return over_rows(rows, [], order, build, after=1)
