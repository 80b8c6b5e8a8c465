"""Profit, risk and stress metrics of return series, per strategy key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.ordered import drawdown, running_sums, value_ranks

YEAR_SECONDS = 365 * 24 * 3600


def _c(name: str) -> Column:
    return F.col(name)


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, F.try_divide(top, bottom)).otherwise(0.0)


def profit_columns(profit: Column) -> dict[str, Column]:
    """Aggregates over realised profits: totals, expectancy, downside, profit factor."""
    n = F.count(profit)
    gain = zero(F.sum(F.when(profit >= 0, profit)))
    loss = zero(-F.sum(F.when(profit < 0, profit)))
    down = zero(-F.avg(F.when(profit < 0, profit)))
    return {
        "gross_profit": gain,
        "gross_loss": loss,
        "profit_factor": F.when(loss > 0, F.try_divide(gain, loss)).otherwise(F.lit(float("inf"))),
        "expectancy": F.when(n > 0, F.try_divide(gain - loss, n)).otherwise(0.0),
        "expected_return": zero(F.avg(profit)),
        "downside_risk": down,
        "risk_reward": zero(F.avg(profit)) - down,
    }


def ratio_columns(profit: Column, suffix: str = "") -> dict[str, Column]:
    """Sharpe (sample deviation) and Sortino (root mean square of losses) per trade."""
    several = F.count(profit) > 1
    mean = F.avg(profit)
    dev = F.stddev_samp(profit)
    down = F.sqrt(F.avg(F.when(profit < 0, profit * profit)))
    return {
        f"sharpe_ratio{suffix}": F.when(several, ratio_or_zero(mean, dev)).otherwise(0.0),
        f"sortino_ratio{suffix}": F.when(several, ratio_or_zero(mean, down)).otherwise(0.0),
    }


def annual_factor(close_seconds: Column) -> Column:
    """Root of trades per 365-day year between the first and last close."""
    years = (F.max(close_seconds) - F.min(close_seconds)) / YEAR_SECONDS
    years = F.when(years > 0, years).otherwise(1.0)
    n = F.count(close_seconds)
    return F.when(n > 1, F.sqrt(n / years)).otherwise(0.0)


def grouped(df: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in columns.items()])


def tail_risk(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value-at-risk family, exactly, from counts of distinct values.

    ``var_rank``: the order statistic at int(0.05 n); ``var_loss``: minus the one at
    int(0.05 (n-1)); ``var_95``: linear 5 % quantile; ``cvar``: mean of the worst
    ceil(5 %) rows; ``es_95``: mean of rows not above ``var_95``.
    """
    ranks = value_ranks(df, keys, value)
    n = ranks.groupBy(*keys).agg(F.max("upto").alias("n"))

    def with_(right):
        return ranks.join(right, list(keys)) if keys else ranks.join(F.broadcast(right))  # one row

    v, rank = _c("value"), _c("upto")
    at = (_c("n") - 1) * 0.05
    k = F.greatest(F.lit(1), F.ceil(_c("n") * 0.05))
    in_tail = F.greatest(F.lit(0), F.least(rank, k) - (rank - _c("cnt")))

    def pick(i):
        return F.min(F.when(rank > i, v))

    picked = with_(n).groupBy(*keys).agg(
        F.first("n").alias("n"),
        pick(F.floor(_c("n") * 0.05)).alias("var_rank"),
        (-pick(F.floor((_c("n") - 1) * 0.05))).alias("var_loss"),
        (pick(F.floor(at)) + (pick(F.ceil(at)) - pick(F.floor(at))) * F.max(at - F.floor(at))).alias("var_95"),
        (F.sum(v * in_tail) / F.first(k)).alias("cvar"),
    )
    tail = with_(picked.select(*keys, "var_95")).filter(v <= _c("var_95") + 1e-12)
    es = tail.groupBy(*keys).agg((F.sum(v * _c("cnt")) / F.sum("cnt")).alias("es_95"))
    if not keys:
        return picked.join(F.broadcast(es))  # one row
    return picked.join(es, list(keys), "left")


def volatility_spikes(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows further than three population deviations from the mean of their key."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    rows = df.join(stats, list(keys)) if keys else df.join(F.broadcast(stats))  # one row
    return rows.groupBy(*keys).agg(
        F.count_if((_c("_s") > 0) & (F.abs(_c(value) - _c("_m")) > 3 * _c("_s"))).alias("volatility_spikes")
    )


def budget_columns(profit: Column, order_type: Column, slippage: Column, budget: float, allowed: Sequence[str]) -> dict[str, Column]:
    used = F.sum(F.abs(profit))
    names = [a.lower() for a in allowed]
    return {
        "budget_utilisation": used / budget if budget > 0 else used,
        "order_type_compliance": zero(F.avg(F.lower(F.trim(order_type)).isin(*names).cast("double"))),
        "slippage_mean": zero(F.avg(slippage)),
        "slippage_std": zero(F.stddev_pop(slippage)),
    }


def stress(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, is_limit: str) -> DataFrame:
    """Total, drawdown and limit fill rate under each scenario, per key.

    Scenarios: baseline; shock (the first return loses max(3 std, 10 % of itself, 0.01));
    volatility_regime (second half: gains halved, losses x1.5); liquidity_drought (the first
    30 % of limit orders cancelled, at least one, the others halved).
    """
    rows = df.select(*keys, *order, _c(value).cast("double").alias("r"), _c(is_limit).alias("lim"))
    one = F.lit(1).cast("long")
    rows = running_sums(rows, keys, order, {"_i": one, "_lim_i": _c("lim").cast("long")}).withColumn("_i", _c("_i") - 1)
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_pop("r").alias("_s"), F.sum(_c("lim").cast("long")).alias("_l")
    )
    rows = rows.join(stats, list(keys)) if keys else rows.join(F.broadcast(stats))  # one row
    r = _c("r")
    shock = F.when(_c("_i") == 0, r - F.greatest(3 * _c("_s"), 0.1 * F.abs(r), F.lit(0.01))).otherwise(r)
    later = (_c("_n") > 1) & (_c("_i") >= F.floor(_c("_n") / 2))
    regime = F.when(later, F.when(r >= 0, r * 0.5).otherwise(r * 1.5)).otherwise(r)
    cut = F.greatest(F.lit(1), F.ceil(_c("_l") * 0.3))
    cancelled = _c("lim") & (_c("_lim_i") <= cut)
    drought = F.when(cancelled, 0.0).when(_c("lim"), r * 0.5).otherwise(r)
    filled = F.lit(True)
    cases = [("baseline", r, filled), ("shock", shock, filled), ("volatility_regime", regime, filled), ("liquidity_drought", drought, ~cancelled)]
    options = F.array(*[F.struct(F.lit(n).alias("scenario"), v.alias("x"), f.alias("filled")) for n, v, f in cases])
    long = rows.select(*keys, *order, "lim", F.explode(options).alias("o")).select(*keys, *order, "lim", "o.*")
    group = [*keys, "scenario"]
    totals = long.groupBy(*group).agg(
        F.sum("x").alias("pnl"), F.avg(F.when(_c("lim"), _c("filled").cast("double"))).alias("limit_fill_rate")
    )
    return totals.join(drawdown(long, group, order, "x"), group)


def stress_summary(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    return results.groupBy(*keys).agg(
        F.min("pnl").alias("stress_pnl_min"),
        F.max("max_drawdown").alias("stress_drawdown_max"),
        F.min("limit_fill_rate").alias("stress_limit_fill_rate_min"),
    )


def risk_card(
    df: DataFrame, key: str, order: Sequence[str], value: str, order_type: str, slippage: str, is_limit: str,
    budget: float, allowed: Sequence[str], limits: dict[str, float], least: dict[str, float],
) -> DataFrame:
    """All strategy risk metrics with the list of breached limits and a verdict."""
    p = _c(value)
    card = grouped(
        df, [key],
        {"risk": zero(F.stddev_samp(p)), "mean_return": zero(F.avg(p))}
        | ratio_columns(p) | budget_columns(p, _c(order_type), _c(slippage), budget, allowed),
    )
    parts = [
        drawdown(df, [key], order, value),
        tail_risk(df, [key], value).select(key, _c("var_rank").alias("var_95")),
        volatility_spikes(df, [key], value),
        stress_summary(stress(df, [key], order, value, is_limit), [key]),
    ]
    for part in parts:
        card = card.join(part, key)
    reasons = [F.when(_c(c) > lim, F.lit(f"{c} above {lim}")) for c, lim in limits.items()]
    reasons += [F.when(_c(c) < lim, F.lit(f"{c} below {lim}")) for c, lim in least.items()]
    card = card.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return card.withColumn("passed", F.size("reasons") == 0)


def promote_best(models: DataFrame, metric: str, k: int, max_drift: float = 0.2, max_drawdown: float | None = None, var_limit: float | None = None) -> DataFrame:
    """The ``k`` best models by a metric after drift and risk filters.

    Names such as ``sharpe`` resolve to ``sharpe_ratio`` first; ``risk_reward`` is expected
    return minus downside risk.
    """
    have = set(models.columns)
    aliases = {"sharpe": ["sharpe_ratio", "sharpe"], "sharpe_ratio": ["sharpe_ratio", "sharpe"],
               "sortino": ["sortino_ratio", "sortino"], "sortino_ratio": ["sortino_ratio", "sortino"]}
    if metric == "risk_reward":
        score = _c("expected_return") - _c("downside_risk")
    else:
        found = [c for c in aliases.get(metric, [metric]) if c in have]
        score = F.coalesce(*[_c(c) for c in found], F.lit(0.0)) if found else F.lit(0.0)
    keep = F.lit(True)
    for c in ("drift_psi", "drift_ks"):
        if c in have:
            keep = keep & (zero(_c(c)) <= max_drift)
    if max_drawdown is not None:
        keep = keep & (zero(_c("max_drawdown")) <= max_drawdown)
    if var_limit is not None:
        keep = keep & (zero(_c("var_95")) <= var_limit)
    return models.filter(keep).withColumn("score", zero(score)).orderBy(_c("score").desc(), _c("model")).limit(k)


def pareto_front(df: DataFrame, ret: str, risk: str) -> DataFrame:
    """Rows no other row beats: higher return and lower risk are better; equals stay.

    A row is beaten when a row of higher return has no more risk, or one of the same return
    has less: only the lowest risk at or above each return matters, a running minimum over
    distinct returns.
    """
    best = df.groupBy(_c(ret).alias("_ret")).agg(F.min(risk).alias("_low")).withColumn("_neg", -_c("_ret"))
    from tapeloom.operators.ordered import lay_out

    lay = lay_out(best, [], ["_neg"])
    rows = lay.carry(lay.df, {"_s": F.min("_low")}, {"_b": lambda w: F.min("_s").over(w)})
    above = F.min("_low").over(lay.rows(-2**31, -1))
    rows = rows.withColumn("_above", F.least(above, _c("_b").cast("double")))
    front = lay.finish(rows.filter(_c("_above").isNull() | (_c("_above") > _c("_low")))).select("_ret", "_low")
    return df.join(front, (_c(ret) == _c("_ret")) & (_c(risk) == _c("_low"))).drop("_ret", "_low")
