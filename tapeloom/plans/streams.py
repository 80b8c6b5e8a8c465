"""Streaming queries: the tables arrive as files in time order and are read as streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tapeloom.operators.drift import melt
from tapeloom.operators.resample import PRIME
from tapeloom.plans import base
from tapeloom.plans.analytics import FEATS, training_rows
from tapeloom.plans.base import ORACLES, query, table, ticks
from tapeloom.plans.logs_in import JSON_LINES, MESSAGE, json_lines
from tapeloom.session import pin
from tapeloom.sources import schemas as S
from tapeloom.sources.readers import follow_csv
from tapeloom.streaming import pipelines as P
from tapeloom.streaming import stateful as ST
from tapeloom.streaming.runner import follow_parquet, new_folder, run_to_table


FILES = 4  # files written per slice and read per micro-batch
BATCH_ROWS = 1_000_000  # rows of a micro-batch of streams whose results don't depend on where batches end


def arriving(df, order, slices=3, last=None):
    """``df`` as a stream: slices of ``order`` arrive one after the other, a slice per batch, then the rows
    of ``last``.  Rows are dealt into slices once, so that each is read twice however many slices there are."""
    spark = df.sparkSession
    folder = new_folder(spark, "arriving")
    marks = df.agg(F.percentile_approx(order, [i / slices for i in range(1, slices)], 10000)).first()[0]
    below = F.filter(F.array(*map(F.lit, marks)), lambda m: m < F.col(order))
    dealt = pin(df.where(F.col(order).isNotNull()).withColumn("_slice", F.size(below)), by=["_slice"])
    for i in range(slices):
        dealt.where(F.col("_slice") == i).drop("_slice").repartition(FILES).write.mode("append").parquet(folder)
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(folder)
    return follow_parquet(spark, folder, df.schema, FILES)


def event_stream(spark, sf):
    e = ticks(spark, sf).withColumn("ts", F.timestamp_micros("t"))
    return arriving(e, "t")


def closing_stream(spark, sf):
    """The events and, a year later, a heartbeat: a row of nulls that moves the watermark past the last
    windows, which are then complete and emitted."""
    e = ticks(spark, sf).withColumn("ts", F.timestamp_micros("t"))
    beat = e.agg((F.max("t") + 365 * 86_400_000_000).alias("t")).withColumn("ts", F.timestamp_micros("t"))
    return arriving(e, "t", last=e.limit(0).unionByName(beat, allowMissingColumns=True))


def shuffled_stream(spark, sf):
    """The events out of order: each arrives up to six hours after its time, which the watermark allows for,
    and a heartbeat of another key a year later lets all of them pass."""
    e = ticks(spark, sf).withColumns({"ts": F.timestamp_micros("t"), "seen": F.col("t") + F.pmod(F.xxhash64("id"), F.lit(6 * 3_600_000_000))})
    late = 365 * 86_400_000_000
    beat = e.agg((F.max("t") + late).alias("t")).select(F.lit("heartbeat").alias("symbol"), "t", F.timestamp_micros("t").alias("ts"), (F.col("t") + late).alias("seen"))
    slices = max(3, math.ceil(e.count() / BATCH_ROWS))
    return arriving(e, "seen", slices, e.limit(0).unionByName(beat, allowMissingColumns=True)).withWatermark("ts", "6 hours")


@query("stream_validation", f"""
WITH {JSON_LINES}
SELECT count_if(reason IS NULL) AS accepted, count_if(reason IS NOT NULL) AS rejected, sum(k) FILTER (reason IS NULL)::BIGINT AS total_k FROM lines""", ints="accepted rejected")
def stream_validation(spark, sf):
    folder = new_folder(spark, "messages")
    json_lines(spark, sf).repartition(3).write.text(folder)
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(folder)
    good, bad = P.route_json(lines, S.struct(MESSAGE), 3)
    return good.agg(F.count(F.lit(1)).alias("accepted"), F.sum("k").alias("total_k")).join(F.broadcast(bad.agg(F.count(F.lit(1)).alias("rejected"))))  # one row each


@query("stream_deduplicated", """
SELECT symbol, id, t FROM ticks""", ctes="ticks")
def stream_deduplicated(spark, sf):
    e = ticks(spark, sf).withColumn("ts", F.timestamp_micros("t"))
    twice = e.unionByName(e.filter("id % 3 = 0"))
    return run_to_table(P.deduplicated(arriving(twice, "t"), ["id"], "ts", "60 days"), "dedup").select("symbol", "id", "t")


@query("stream_tumbling_metrics", """
WITH w AS (SELECT symbol, t // 21600000000 AS w, count(*) AS n, avg(bid) AS mean, min(bid) AS low, max(bid) AS high FROM ticks GROUP BY 1, 2)
SELECT symbol, w * 21600000000 AS start_us, n, mean, low, high FROM w""", ctes="ticks", doubles="mean low high")
def stream_tumbling_metrics(spark, sf):
    out = run_to_table(P.window_metrics(closing_stream(spark, sf), ["symbol"], "ts", "bid", "6 hours", None, "1 hour"), "tumbling")
    return out.filter("symbol IS NOT NULL").select("symbol", F.unix_micros("start").alias("start_us"), "n", "mean", "low", "high")


@query("stream_sliding_metrics", """
WITH s AS (SELECT symbol, bid, unnest([t // 10800000000, t // 10800000000 - 1]) AS w FROM ticks), w AS (SELECT symbol, w, count(*) AS n, avg(bid) AS mean FROM s GROUP BY 1, 2)
SELECT symbol, w * 10800000000 AS start_us, n, mean FROM w""", ctes="ticks", doubles="mean")
def stream_sliding_metrics(spark, sf):
    out = run_to_table(P.window_metrics(closing_stream(spark, sf), ["symbol"], "ts", "bid", "6 hours", "3 hours", "1 hour"), "sliding")
    return out.filter("symbol IS NOT NULL").select("symbol", F.unix_micros("start").alias("start_us"), "n", "mean")


@query("stream_sessions", """
WITH g AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 7200000000 THEN 0 ELSE 1 END AS first FROM ticks),
i AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM g), s AS (SELECT user_id, i, min(t) AS start_us, max(t) + 7200000000 AS end_us, count(*) AS n FROM i GROUP BY 1, 2)
SELECT user_id, start_us, end_us, n FROM s""", ctes="ticks")
def stream_sessions(spark, sf):
    out = run_to_table(P.activity_sessions(closing_stream(spark, sf), ["user_id"], "ts", "2 hours", "1 hour"), "sessions")
    return out.filter("user_id IS NOT NULL").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("stream_page_hinkley")
def stream_page_hinkley(spark, sf):
    s = shuffled_stream(spark, sf).select("symbol", "t", "id", "bid", "ts")
    return run_to_table(ST.change_alarms(s, ["symbol"], ["t", "id"], "bid", "page_hinkley", "ts", threshold=400.0), "ph").select("symbol", "id")


@query("stream_cusum")
def stream_cusum(spark, sf):
    s = shuffled_stream(spark, sf).select("symbol", "t", "id", "bid", "ts")
    return run_to_table(ST.change_alarms(s, ["symbol"], ["t", "id"], "bid", "cusum", "ts", threshold=150.0, drift=0.5), "cusum").select("symbol", "id")


# The streamed detectors must raise the alarms of the batch ones.
ORACLES["stream_page_hinkley"] = ORACLES["page_hinkley"]
ORACLES["stream_cusum"] = ORACLES["cusum"]


@query("stream_online_drift")
def stream_online_drift(spark, sf):
    e = ticks(spark, sf).withColumn("volume", F.col("user_id").cast("double"))
    rows = melt(e, ["bid", "volume"], keep=["symbol", "t", "id"])
    return run_to_table(ST.online_drift(arriving(rows, "t"), ["symbol", "feature"], ["t", "id"], "value", 500, 100, 0.1, 0.1), "drift")


REGIMES = [[10.0, 0.002], [25.0, 0.004], [50.0, 0.006]]


@query("stream_regimes", """
WITH f AS (SELECT symbol, t, id, stddev_pop((bid + ask) / 2) OVER w AS v, avg(ask - bid) OVER w AS s, count(*) OVER w AS n FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY t, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
d AS (SELECT symbol, t, id, pow(v - 10, 2) + pow(s - 0.002, 2) AS a, pow(v - 25, 2) + pow(s - 0.004, 2) AS b, pow(v - 50, 2) + pow(s - 0.006, 2) AS c FROM f WHERE n = 20),
r AS (SELECT symbol, t, id, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS regime FROM d), p AS (SELECT *, lag(regime) OVER (PARTITION BY symbol ORDER BY t, id) AS prev FROM r)
SELECT symbol, id, regime FROM p WHERE prev IS NULL OR prev <> regime""", ctes="ticks")
def stream_regimes(spark, sf):
    s = shuffled_stream(spark, sf).select("symbol", "t", "id", "bid", "ask", "ts")
    return run_to_table(ST.regime_changes(s, ["symbol"], ["t", "id"], "bid", "ask", 20, REGIMES, "ts"), "regimes").select("symbol", "id", "regime")


@query("stream_confidence_weighted")
def stream_confidence_weighted(spark, sf):
    s = arriving(training_rows(spark, sf), "t")
    return run_to_table(ST.confidence_weighted(s, ["symbol"], ["t", "id"], FEATS, "label"), "cw")


@query("stream_truth_join", """
SELECT p.pred_id, t.ticket, p.probability FROM preds p JOIN opens t ON p.symbol = t.symbol AND t.open_time BETWEEN p.timestamp AND p.timestamp + 60""", ctes="trades preds", doubles="probability")
def stream_truth_join(spark, sf):
    p = base.predictions(spark, sf).withColumn("pt", F.timestamp_seconds("timestamp")).select("pred_id", "symbol", "probability", "pt", "timestamp")
    o = base.trade_log(spark, sf).filter("action = 'OPEN'").withColumn("tt", F.timestamp_seconds("event_time")).select("ticket", "symbol", "tt", "event_time")
    # Slices of the two tables end at slightly different times; the delay covers that.
    left, right = arriving(p, "timestamp", 2), arriving(o, "event_time", 2)
    out = P.predictions_with_truth(left, right, ["symbol"], "pt", "tt", 60, "30 days")
    return run_to_table(out, "truth").select("pred_id", "ticket", "probability")


@query("stream_strategy_totals", """
SELECT symbol AS strategy, count(*) AS n, avg(bid) AS mean, max(bid) AS high FROM ticks GROUP BY 1""", ctes="ticks", doubles="mean high")
def stream_strategy_totals(spark, sf):
    return P.strategy_totals(event_stream(spark, sf).withColumnRenamed("symbol", "strategy"), "strategy", "bid")


@query("stream_metric_alarms")
def stream_metric_alarms(spark, sf):
    return P.metric_alarms(event_stream(spark, sf).select("symbol", "t", "id", "bid"), ["symbol"], ["t", "id"], "bid", 1.5)


@query("stream_metric_alarms_final")
def stream_metric_alarms_final(spark, sf):
    """The verdict after the last micro-batch is the one over the whole table."""
    seen = P.metric_alarms(event_stream(spark, sf).select("symbol", "t", "id", "bid"), ["symbol"], ["t", "id"], "bid", 1.5)
    rounded = {c: F.round(c, 6) + F.lit(0.0) for c in ("last_value", "ewm_mean", "ewm_std")}
    return seen.where("batch_no = 2").drop("batch_no").withColumns(rounded)


ORACLES["stream_metric_alarms_final"] = ORACLES["ewma_anomaly"]


@query("stream_sgd_updates")
def stream_sgd_updates(spark, sf):
    rows = training_rows(spark, sf).withColumns({f: F.col(f) / 50.0 for f in FEATS})
    return P.sgd_updates(arriving(rows, "t"), FEATS, "label")


def _draw_sql(rows, ids, weight, k):
    number = f"(('0x' || substr(md5('0:' || {" || ':' || ".join(ids)}), 1, 8))::BIGINT % {PRIME} + 0.5::DOUBLE) / {PRIME}.0::DOUBLE"
    return f"SELECT * FROM {rows} ORDER BY -ln({number}) / greatest({weight}, 1e-6::DOUBLE), {', '.join(ids)} LIMIT {k}"


@query("stream_replay_sample", f"""
WITH d AS (SELECT t, decision_id, probability, (profit > 0)::INT AS y, greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, probability)) AS p FROM decisions),
w AS (SELECT t, decision_id, probability, y, -ln(CASE WHEN y = 1 THEN p ELSE 1 - p END) + abs(probability - y) AS weight FROM d ORDER BY t DESC, decision_id DESC LIMIT 500)
SELECT * FROM ({_draw_sql("w", ["t", "decision_id"], "weight", 50)})""", ctes="decisions", doubles="probability weight")
def stream_replay_sample(spark, sf):
    rows = base.decisions(spark, sf).select("t", "decision_id", "probability", (F.col("profit") > 0).cast("int").alias("y"))
    rows = rows.withColumn("weight", P.replay_weight("probability", "y"))
    return P.replay_sample(arriving(rows, "t"), ["t", "decision_id"], "weight", 500, 50)


@query("stream_calibration")
def stream_calibration(spark, sf):
    rows = base.decisions(spark, sf).select("t", "decision_id", "probability", (F.col("profit") > 0).cast("int").alias("y"))
    return P.running_calibration(arriving(rows, "t"), ["t", "decision_id"], "probability", "y", 1000)


@query("weighted_sample", f"""
WITH w AS (SELECT decision_id, probability, abs(profit) AS weight FROM decisions)
SELECT * FROM ({_draw_sql("w", ["decision_id"], "weight", 100)})""", ctes="decisions", doubles="probability weight")
def weighted_sample(spark, sf):
    return P.weighted_sample(base.decisions(spark, sf).select("decision_id", "probability", F.abs("profit").alias("weight")), ["decision_id"], "weight", 100)


@query("newest_buffer", """
SELECT id, bid FROM ticks ORDER BY t DESC, id DESC LIMIT 200""", ctes="ticks", doubles="bid")
def newest_buffer(spark, sf):
    from tapeloom.sources.writers import last_rows

    return last_rows(ticks(spark, sf).select("t", "id", "bid"), ["t", "id"], 200).select("id", "bid")


@query("tail_follow", """
SELECT event_id, value FROM events""", doubles="value")
def tail_follow(spark, sf):
    folder = new_folder(spark, "tail")
    table(spark, sf, "events").select("event_id", "value").repartition(3).write.option("header", True).option("sep", ";").csv(folder)
    return run_to_table(follow_csv(spark, folder, S.struct("event_id long, value double"), files_per_trigger=1), "tailed")
