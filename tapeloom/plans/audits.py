"""Log summaries, audits, bandits and replay queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.scalar import hour_of, session_tag
from tapeloom.operators import audits as A
from tapeloom.operators import ticks as TK
from tapeloom.operators.resample import PRIME
from tapeloom.plans import base
from tapeloom.plans.base import query, table, ticks

HOUR = 3_600_000_000


@query("tick_metrics", """
SELECT symbol, count(*) AS tick_count, avg(ask - bid) AS avg_spread, arg_max(bid, (t, id)) - arg_min(bid, (t, id)) AS price_change FROM ticks GROUP BY 1""",
    ctes="ticks", doubles="avg_spread price_change")
def tick_metrics(spark, sf):
    return TK.tick_metrics(ticks(spark, sf), ["symbol"], ["t", "id"], "bid", "ask")


@query("interval_volatility", f"""
WITH d AS (SELECT symbol, t, bid - lag(bid) OVER (PARTITION BY symbol ORDER BY t, id) AS d FROM ticks)
SELECT symbol, t // {HOUR} AS hr, coalesce(stddev_pop(d), 0) AS volatility, count(d) AS moves FROM d GROUP BY 1, 2""", ctes="ticks", doubles="volatility")
def interval_volatility(spark, sf):
    return TK.interval_volatility(ticks(spark, sf), ["symbol"], ["t", "id"], "bid", "t", HOUR, "hr")


def session_trades(spark, sf):
    t = base.closed_trades(spark, sf)
    return t.select(F.col("ticket").alias("decision_id"), "profit", F.col("open_time").alias("entry_time"), F.col("close_time").alias("exit_time"), ((F.col("ticket") % 7) / 100.0).alias("slippage"))


SHADOW = """sd AS (SELECT d.*, t.profit AS tp, lag(executed_model_idx) OVER (ORDER BY d.decision_id DESC) AS prev FROM decisions d LEFT JOIN trades t ON t.ticket = d.decision_id),
si AS (SELECT *, sum((action <> 'shadow' OR prev IS NULL OR executed_model_idx <> prev)::INT) OVER (ORDER BY decision_id DESC ROWS UNBOUNDED PRECEDING) AS island FROM sd),
se AS (SELECT island, max((coalesce(tp, 0) > 0)::INT) AS actual FROM si WHERE action IN ('buy', 'sell') GROUP BY 1),
sh AS (SELECT coalesce(avg(((probability > 0.5)::INT = actual)::INT), 0) AS shadow_prediction_accuracy FROM si JOIN se USING (island) WHERE action = 'shadow')"""


@query("session_summary", f"""
WITH {SHADOW},
b AS (SELECT avg((profit > 0)::INT) AS win_rate, avg(profit) / stddev_pop(profit) * sqrt(count(*)) AS sharpe, avg(close_time - open_time) AS avg_hold_time,
    avg((ticket % 7) / 100) AS slippage_mean, stddev_pop((ticket % 7) / 100) AS slippage_std FROM trades),
p AS (SELECT avg(((profit > 0) = (probability > 0.5))::INT) AS prediction_accuracy FROM trades t JOIN (SELECT decision_id AS i, probability FROM decisions) d ON d.i = t.ticket),
l AS (SELECT avg(((coalesce(tp, 0) > 0) = (probability > 0.5))::INT) AS live_prediction_accuracy FROM sd WHERE action IN ('buy', 'sell'))
SELECT * FROM b, p, l, sh""", ctes="trades decisions",
    doubles="win_rate sharpe avg_hold_time slippage_mean slippage_std prediction_accuracy live_prediction_accuracy shadow_prediction_accuracy", digits=5)
def session_summary(spark, sf):
    d = base.decisions(spark, sf).drop("profit")
    return A.session_summary(session_trades(spark, sf), d.select("decision_id", F.col("probability").alias("prediction")), d)


@query("shadow_accuracy", f"""
WITH {SHADOW}
SELECT shadow_prediction_accuracy FROM sh""", ctes="trades decisions", doubles="shadow_prediction_accuracy")
def shadow_accuracy(spark, sf):
    return A.shadow_accuracy(base.decisions(spark, sf).drop("profit"), session_trades(spark, sf).select("decision_id", "profit"))


@query("model_audit", """
WITH m AS (SELECT model_idx, CASE WHEN chosen = 1 THEN 'chosen' ELSE 'shadow' END AS role, CASE WHEN chosen = 1 OR action = CASE WHEN probability > 0.5 THEN 'buy' ELSE 'sell' END
    THEN coalesce(t.profit, 0) ELSE -coalesce(t.profit, 0) END AS mp FROM decisions d LEFT JOIN trades t ON t.ticket = d.decision_id)
SELECT model_idx, role, count(*) AS trades, count_if(mp > 0) AS wins, avg((mp > 0)::INT) AS win_rate, sum(mp) AS profit FROM m GROUP BY 1, 2""",
    ctes="trades decisions", doubles="win_rate profit", digits=5, ints="wins")
def model_audit(spark, sf):
    return A.model_audit(base.decisions(spark, sf).drop("profit"), session_trades(spark, sf).select("decision_id", "profit"))


@query("shadow_trade_stats", """
SELECT model_idx, avg((profit > 0)::INT) AS accuracy, sum(profit) AS profit FROM decisions WHERE action = 'shadow' GROUP BY 1""", ctes="decisions", doubles="accuracy profit", digits=5)
def shadow_trade_stats(spark, sf):
    return A.shadow_trade_stats(base.decisions(spark, sf).filter("action = 'shadow'"))


@query("bandit_scores", """
WITH s AS (SELECT model_idx, count(*) AS total, count_if(profit > 0) AS wins FROM decisions GROUP BY 1),
u AS (SELECT *, wins / total AS mean, wins / total + sqrt(2 * ln((SELECT sum(total) FROM s) + 1) / total) AS ucb FROM s)
SELECT model_idx, total, wins, mean, ucb, row_number() OVER (ORDER BY ucb DESC, model_idx) = 1 AS ucb_choice, row_number() OVER (ORDER BY mean DESC, model_idx) = 1 AS best_model FROM u""",
    ctes="decisions", doubles="mean ucb", ints="wins")
def bandit_scores(spark, sf):
    s = base.decisions(spark, sf).groupBy("model_idx").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("profit") > 0).alias("wins"))
    return A.bandit_scores(s)


@query("federated_mean", """
WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2)
SELECT label, max(m) FILTER (i = 1) AS first_weight, max(m) FILTER (i = 64) AS last_weight, sum(m) AS total, count(*)::INT AS dims FROM c GROUP BY 1""",
    doubles="first_weight last_weight total")
def federated_mean(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    m = A.vector_mean(e, ["label"], "v")
    return m.select("label", F.get("mean", F.lit(0)).alias("first_weight"), F.get("mean", F.lit(63)).alias("last_weight"),
                    F.aggregate("mean", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("mean").alias("dims"))


@query("headline_pooling", """
WITH n AS (SELECT symbol, vec, i FROM news, range(1, 65) r(i)), c AS (SELECT symbol, i, avg(vec[i]) AS m, count(*) AS headline_count FROM n GROUP BY 1, 2)
SELECT symbol, max(headline_count) AS headline_count, max(m) FILTER (i = 1) AS emb_0, max(m) FILTER (i = 64) AS emb_63 FROM c GROUP BY 1""", ctes="news", doubles="emb_0 emb_63")
def headline_pooling(spark, sf):
    from tapeloom.plans.joins import _news

    news = _news(spark, sf).select("symbol", F.col("vec").cast("array<double>").alias("vec"))
    counts = news.groupBy("symbol").agg(F.count(F.lit(1)).alias("headline_count"))
    m = A.vector_mean(news, ["symbol"], "vec").join(counts, "symbol")
    return m.select("symbol", "headline_count", F.get("mean", F.lit(0)).alias("emb_0"), F.get("mean", F.lit(63)).alias("emb_63"))


def _drawn(*parts):
    """A uniform number from the MD5 of the parts, as in SQL."""
    return f"((('0x' || substr(md5({" || ':' || ".join(parts)}), 1, 8))::BIGINT % {PRIME} + 0.5::DOUBLE) / {PRIME}.0::DOUBLE)"


def _noise(i):
    return f"sqrt(-2 * ln({_drawn(f"'0:{i}:0'", 'symbol')})) * cos(2 * pi() * {_drawn(f"'0:{i}:1'", 'symbol')}) * 1e-3"


@query("noisy_group_mean", f"""
WITH g AS (SELECT symbol, avg(bid) AS bid, avg(ask) AS ask, round(avg(user_id % 2))::INT AS action, count(*) AS n FROM ticks GROUP BY 1)
SELECT symbol, bid + {_noise(0)} AS bid, ask + {_noise(1)} AS ask, action, unnest(range(1, n + 1)) AS copy FROM g""", ctes="ticks", doubles="bid ask")
def noisy_group_mean(spark, sf):
    rows = ticks(spark, sf).select("symbol", "bid", "ask", (F.col("user_id") % 2).alias("action"))
    return A.noisy_group_mean(rows, ["symbol"], ["bid", "ask"], "action", "n")


@query("shadow_status", """
WITH h AS (SELECT t // 86400000000 AS day, avg((probability > 0.5)::INT) AS acc FROM decisions GROUP BY 1), e AS (SELECT max(day) AS hi, min(day) AS lo, count(*) AS n FROM h)
SELECT (SELECT acc FROM h WHERE day = hi) AS current_accuracy, any_value(n) AS history_length, min(acc) AS window_min_accuracy, avg(acc) AS window_avg_accuracy,
    any_value(hi - lo >= 14) AS has_month, any_value(hi - lo >= 14) AND min(acc) >= 0.4 AS meets_threshold FROM h, e WHERE day >= hi - 14 GROUP BY hi""",
    ctes="decisions", doubles="current_accuracy window_min_accuracy window_avg_accuracy")
def shadow_status(spark, sf):
    h = base.decisions(spark, sf).groupBy(F.floor(F.col("t") / 86_400_000_000).alias("day")).agg(F.avg((F.col("probability") > 0.5).cast("double")).alias("acc"))
    return A.shadow_status(h, "day", "acc", 14, 0.4)


def replayed(spark, sf):
    d = base.decisions(spark, sf)
    return d.withColumn("new_probability", F.col("probability") * 0.5 + (F.col("decision_id") % 10) / 20.0)


REPLAY = "rp AS (SELECT *, probability * 0.5::DOUBLE + (decision_id % 10) / 20.0::DOUBLE AS new_probability FROM decisions)"


@query("replay_comparison", f"""
WITH {REPLAY}, f AS (SELECT profit, profit > 0 AS won, probability >= 0.5 AS was, new_probability >= 0.5 AS now FROM rp)
SELECT avg((was = won)::INT) AS accuracy_old, avg((now = won)::INT) AS accuracy_new, coalesce(-sum(profit) FILTER (was AND NOT now), 0) AS profit_delta,
    count_if(now AND won) AS tp, count_if(now AND NOT won) AS fp, count_if(NOT now AND NOT won) AS tn, count_if(NOT now AND won) AS fn, count_if(was <> now) AS divergences FROM f""",
    ctes="decisions", doubles="accuracy_old accuracy_new profit_delta", digits=5, ints="tp fp tn fn divergences")
def replay_comparison(spark, sf):
    return A.replay_comparison(replayed(spark, sf), "probability", "new_probability", "profit", 0.5)


@query("replay_divergences", f"""
WITH {REPLAY}
SELECT decision_id, probability, new_probability, profit FROM rp WHERE (probability >= 0.5) <> (new_probability >= 0.5)""", ctes="decisions",
    doubles="probability new_probability profit")
def replay_divergences(spark, sf):
    return A.replay_rows(replayed(spark, sf), "probability", "new_probability", 0.5).select("decision_id", "probability", "new_probability", "profit")


@query("metric_history", """
SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY t, id) - 1 AS position, bid FROM ticks""", ctes="ticks", doubles="bid")
def metric_history(spark, sf):
    return A.metric_history(ticks(spark, sf), "symbol", ["t", "id"], "bid")


@query("session_statistics", """
SELECT CASE WHEN (t // 3600000000) % 24 < 8 THEN 'asian' WHEN (t // 3600000000) % 24 < 16 THEN 'london' ELSE 'newyork' END AS session, avg(bid) AS mean, stddev_pop(bid) AS std FROM ticks GROUP BY 1""",
    ctes="ticks", doubles="mean std")
def session_statistics(spark, sf):
    return A.session_statistics(ticks(spark, sf), session_tag(hour_of("t")), "bid")
