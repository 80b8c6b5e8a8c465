"""Session summaries, model audits, bandits, federated means and replay comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.ordered import over_rows, row_index, running_sums
from tapeloom.operators.resample import PRIME, row_number_of


def _c(name: str) -> Column:
    return F.col(name)


def session_summary(trades: DataFrame, metrics: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: win rate, Sharpe, hold time, slippage, prediction, live and shadow accuracy."""
    p = _c("profit")
    dev = F.stddev_pop(p)
    hold = _c("exit_time") - _c("entry_time")
    base = trades.agg(
        F.avg((p > 0).cast("double")).alias("win_rate"),
        F.when(dev > 0, F.avg(p) / dev * F.sqrt(F.count(p))).otherwise(0.0).alias("sharpe"),
        F.coalesce(F.avg(hold), F.lit(0.0)).alias("avg_hold_time"),
        F.avg("slippage").alias("slippage_mean"), F.stddev_pop("slippage").alias("slippage_std"),
    )
    won = (p > 0).cast("int")
    known = trades.filter(_c("decision_id").isNotNull()).select("decision_id", "profit")
    pred = known.join(metrics.select("decision_id", "prediction"), "decision_id").agg(
        F.coalesce(F.avg((won == (_c("prediction") > 0.5).cast("int")).cast("double")), F.lit(0.0)).alias("prediction_accuracy")
    )
    live = decisions.filter(_c("action").isin("buy", "sell")).join(known, "decision_id", "left").agg(
        F.coalesce(
            F.avg((F.coalesce(won, F.lit(0)) == (_c("probability") > 0.5).cast("int")).cast("double")), F.lit(0.0)
        ).alias("live_prediction_accuracy")
    )
    out = base
    for one_row in (pred, live, shadow_accuracy(decisions, known)):
        out = out.join(F.broadcast(one_row))
    return out


def shadow_accuracy(decisions: DataFrame, trades: DataFrame) -> DataFrame:
    """Accuracy of shadow rows against the executed decision that ends their run.

    In decision order a run of rows with one ``executed_model_idx`` ends at its first
    non-shadow row; the shadow rows of the run predict whether that decision won.  The end is
    found by looking ahead: islands are numbered from the end by counting run ends.
    """
    rows = decisions.select("decision_id", "action", "executed_model_idx", "probability").withColumn("_neg", -_c("decision_id"))

    def build(df, lay):
        return df.withColumn("_prev", F.lag("executed_model_idx").over(lay.ordered()))

    rows = over_rows(rows, [], ["_neg"], build, before=1)
    starts = (_c("action") != "shadow") | _c("_prev").isNull() | (_c("executed_model_idx") != _c("_prev"))
    rows = running_sums(rows, [], ["_neg"], {"island": starts.cast("long")})
    ends = rows.filter(_c("action").isin("buy", "sell")).join(trades, "decision_id", "left").groupBy("island").agg(
        F.max((F.coalesce(_c("profit"), F.lit(0.0)) > 0).cast("int")).alias("actual")
    )
    shadows = rows.filter(_c("action") == "shadow").join(ends, "island")
    return shadows.agg(
        F.coalesce(
            F.avg(((_c("probability") > 0.5).cast("int") == _c("actual")).cast("double")), F.lit(0.0)
        ).alias("shadow_prediction_accuracy")
    )


def model_audit(decisions: DataFrame, trades: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Trades, wins, win rate and profit per model, for chosen and shadow rows."""
    rows = decisions.join(trades, "decision_id", "left").withColumn("profit", F.coalesce("profit", F.lit(0.0)))
    said = F.when(_c("chosen") == 1, _c("action")).otherwise(F.when(_c("probability") > threshold, "buy").otherwise("sell"))
    rows = rows.withColumn("_mp", F.when(said == _c("action"), _c("profit")).otherwise(-_c("profit")))
    return rows.groupBy("model_idx", F.when(_c("chosen") == 1, "chosen").otherwise("shadow").alias("role")).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(_c("_mp") > 0).alias("wins"),
        F.avg((_c("_mp") > 0).cast("double")).alias("win_rate"), F.sum("_mp").alias("profit"),
    )


def shadow_trade_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("model_idx").agg(
        F.avg((_c("profit") > 0).cast("double")).alias("accuracy"), F.sum("profit").alias("profit")
    )


def bandit_scores(stats: DataFrame) -> DataFrame:
    """Upper confidence score per model, its rank (untried first, low index on ties), best flag.

    ``stats`` holds one row per model, a table of bounded size.
    """
    total = stats.agg(F.sum("total").alias("_t"))
    rows = stats.join(F.broadcast(total))  # one row
    mean = F.try_divide(_c("wins"), _c("total"))
    score = F.when(_c("total") == 0, F.lit(float("inf"))).otherwise(
        mean + F.sqrt(F.try_divide(2 * F.log(_c("_t") + 1), _c("total")))
    )
    rows = rows.withColumns({"mean": F.coalesce(mean, F.lit(0.0)), "ucb": score})
    best = rows.agg(
        F.max_by("model_idx", F.struct("ucb", -_c("model_idx"))).alias("_u"),
        F.max_by("model_idx", F.struct("mean", -_c("model_idx"))).alias("_m"),
    )
    return rows.join(F.broadcast(best)).select(
        "model_idx", "total", "wins", "mean", "ucb",
        (_c("model_idx") == _c("_u")).alias("ucb_choice"), (_c("model_idx") == _c("_m")).alias("best_model"),
    )


def vector_mean(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise mean of arrays per key, as an array; nulls are ignored."""
    cells = df.select(*keys, F.posexplode(vector).alias("_pos", "_x"))
    means = cells.groupBy(*keys, "_pos").agg(F.avg("_x").alias("_m"))
    packed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_m"))).alias("_l"))  # one item per dimension
    return packed.select(*keys, F.transform("_l", lambda e: e["_m"]).alias("mean"))


def noisy_group_mean(df: DataFrame, keys: Sequence[str], columns: Sequence[str], action: str, copies: str, scale: float = 1e-3, seed: int = 0) -> DataFrame:
    """Group means with small normal noise, the rounded mean action, repeated per contributor.

    Noise comes from uniform numbers from the MD5 of seed, column, use and key: the same after a recomputed
    task."""
    means = df.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in columns], F.round(F.avg(action)).cast("int").alias(action), F.count(F.lit(1)).alias(copies)
    )
    def noise(i):
        def u(j):
            return (row_number_of(F.concat_ws(":", F.lit(seed), F.lit(i), F.lit(j), *keys)) + 0.5) / float(PRIME)

        return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * F.pi() * u(1)) * scale

    rows = means.withColumns({c: _c(c) + noise(i) for i, c in enumerate(columns)})
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), _c(copies)))).drop(copies)


def shadow_status(history: DataFrame, time: str, accuracy: str, span: int, threshold: float) -> DataFrame:
    """Trailing-window accuracy of a history: window minimum and mean, enough data, verdict."""
    ends = history.agg(F.max(time).alias("_hi"), F.min(time).alias("_lo"), F.max_by(accuracy, time).alias("current_accuracy"), F.count(F.lit(1)).alias("history_length"))
    rows = history.join(F.broadcast(ends))  # one row
    recent = rows.filter(_c(time) >= _c("_hi") - span)
    out = recent.agg(
        F.first("current_accuracy").alias("current_accuracy"), F.first("history_length").alias("history_length"),
        F.min(accuracy).alias("window_min_accuracy"), F.avg(accuracy).alias("window_avg_accuracy"),
        (F.first("_hi") - F.first("_lo") >= span).alias("has_month"),
    )
    return out.withColumn("meets_threshold", _c("has_month") & (_c("window_min_accuracy") >= threshold))


def replay_rows(df: DataFrame, old: str, new: str, threshold: float) -> DataFrame:
    """Decisions whose side of the threshold changed."""
    return df.filter((_c(old) >= threshold) != (_c(new) >= threshold))


def replay_comparison(df: DataFrame, old: str, new: str, profit: str, threshold: float) -> DataFrame:
    won = F.coalesce(_c(profit), F.lit(0.0)) > 0
    was, now = _c(old) >= threshold, _c(new) >= threshold
    return df.agg(
        F.avg((was == won).cast("double")).alias("accuracy_old"),
        F.avg((now == won).cast("double")).alias("accuracy_new"),
        F.coalesce(-F.sum(F.when(was & ~now, _c(profit))), F.lit(0.0)).alias("profit_delta"),
        F.count_if(now & won).alias("tp"), F.count_if(now & ~won).alias("fp"),
        F.count_if(~now & ~won).alias("tn"), F.count_if(~now & won).alias("fn"),
        F.count_if(was != now).alias("divergences"),
    )


def metric_history(df: DataFrame, strategy: str, order: Sequence[str], metric: str) -> DataFrame:
    """Metrics of each strategy in order, one row per position instead of one long list."""
    return row_index(df.select(strategy, *order, metric), [strategy], order, "position").select(strategy, "position", metric)


def session_statistics(df: DataFrame, session: Column, price: str) -> DataFrame:
    """Mean and deviation of the price per session; sessions without rows use all rows."""
    spark = df.sparkSession
    stats = df.groupBy(session.alias("session")).agg(F.avg(price).alias("mean"), F.stddev_pop(price).alias("std"))
    whole = df.agg(F.avg(price).alias("_m"), F.stddev_pop(price).alias("_s"))
    names = spark.createDataFrame([("asian",), ("london",), ("newyork",)], "session string")
    return names.join(stats, "session", "left").join(F.broadcast(whole)).select(
        "session", F.coalesce("mean", "_m").alias("mean"), F.coalesce("std", "_s").alias("std")
    )
