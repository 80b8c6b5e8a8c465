"""Labels, weights, folds, scalar functions, formulas and scoring queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tapeloom import registry as X
from tapeloom.functions import formula as FM
from tapeloom.functions import scalar as S
from tapeloom.functions import scoring as SC
from tapeloom.operators import labels as L
from tapeloom.operators import resample as RS
from tapeloom.operators import warping as WP
from tapeloom.operators.ordered import quantiles
from tapeloom.plans import base
from tapeloom.plans.base import bars, query, table, ticks

TICK = "PARTITION BY symbol ORDER BY t, id"
DAY = 86_400_000_000


@query("triple_barrier", f"""
WITH f AS (SELECT symbol, id, bid, bid + 1.5 * (bid * 0.1::DOUBLE) AS tp, bid - 1.0 * (bid * 0.1::DOUBLE) AS sl, list(bid) OVER ({TICK} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS f,
    lead(bid, 5) OVER w AS l5, lead(bid, 20) OVER w AS l20 FROM ticks WINDOW w AS ({TICK})),
h AS (SELECT *, coalesce(len(f), 0) AS n, coalesce(list_position(list_transform(f, lambda v: v >= tp), true), coalesce(len(f), 0) + 1) AS tpt,
    coalesce(list_position(list_transform(f, lambda v: v <= sl), true), coalesce(len(f), 0) + 1) AS slt FROM f)
SELECT symbol, id, tp AS take_profit, sl AS stop_loss, n::INT AS horizon_len, CASE WHEN tpt = 0 THEN n + 1 ELSE tpt END::INT AS tp_time, CASE WHEN slt = 0 THEN n + 1 ELSE slt END::INT AS sl_time,
    (CASE WHEN tpt = 0 THEN n + 1 ELSE tpt END <= CASE WHEN slt = 0 THEN n + 1 ELSE slt END AND CASE WHEN tpt = 0 THEN n + 1 ELSE tpt END <= n)::INT::DOUBLE AS meta_label,
    coalesce((l5 > bid)::INT, 0)::DOUBLE AS label_h5, coalesce((l20 > bid)::INT, 0)::DOUBLE AS label_h20 FROM h""", ctes="ticks", doubles="take_profit stop_loss")
def triple_barrier(spark, sf):
    t = ticks(spark, sf).withColumn("spread", F.col("bid") * 0.1)
    df = L.triple_barrier(t, ["symbol"], ["t", "id"], "bid", "spread", 6, 1.5, 1.0)
    return df.select("symbol", "id", "take_profit", "stop_loss", "horizon_len", "tp_time", "sl_time", "meta_label", "label_h5", "label_h20")


WEIGHTS = f"""w AS (SELECT symbol, t, id, bid - 20 AS profit FROM ticks), m AS (SELECT median(abs(profit)) FILTER (abs(profit) > 0) AS med, max(t) AS hi FROM w),
    ww AS (SELECT symbol, id, least(abs(profit) / med, 10) AS profit_weight, pow(0.5::DOUBLE, ((hi - t) // 1000000) / 86400 / 7) AS decay_weight,
    greatest(1 / (1 + stddev_pop(profit) OVER ({TICK} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)), 1e-6) AS vol_scaler FROM w, m)"""


def weighted(spark, sf):
    t = ticks(spark, sf).withColumn("profit", F.col("bid") - 20.0)
    return L.sample_weights(t, ["symbol"], ["t", "id"], "profit", "t", 7.0)


@query("profit_weights", f"""
WITH {WEIGHTS}
SELECT id, profit_weight FROM ww""", ctes="ticks", doubles="profit_weight")
def profit_weights(spark, sf):
    return L.profit_weights(ticks(spark, sf).withColumn("profit", F.col("bid") - 20.0), "profit").select("id", "profit_weight")


@query("decay_weights", f"""
WITH {WEIGHTS}
SELECT id, decay_weight FROM ww""", ctes="ticks", doubles="decay_weight", digits=8)
def decay_weights(spark, sf):
    return L.decay_weights(ticks(spark, sf), "t", 7.0).select("id", "decay_weight")


@query("sample_weights", f"""
WITH {WEIGHTS}
SELECT id, profit_weight * decay_weight * vol_scaler / (SELECT avg(profit_weight * decay_weight * vol_scaler) FROM ww) AS weight FROM ww""", ctes="ticks", doubles="weight")
def sample_weights(spark, sf):
    return weighted(spark, sf).select("id", "weight")


@query("weight_summary", f"""
WITH {WEIGHTS}, x AS (SELECT profit_weight * decay_weight * vol_scaler AS w FROM ww)
SELECT min(w) AS min, max(w) AS max, avg(w) AS mean, stddev_pop(w) AS std FROM x""", ctes="ticks", doubles="min max mean std")
def weight_summary(spark, sf):
    return L.weight_summary(weighted(spark, sf), "raw_weight")


@query("purged_folds", """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index, count(*) OVER () // 5 AS size, count(*) OVER () AS n FROM events),
f AS (SELECT event_id, row_index, k::INT AS fold, CASE WHEN row_index < size * (k + 1) THEN 'train' WHEN row_index >= size * (k + 1) + 3 AND row_index < size * (k + 1) + 3 + size THEN 'validation' END AS role FROM r, range(4) x(k))
SELECT * FROM f WHERE role IS NOT NULL""")
def purged_folds(spark, sf):
    e = table(spark, sf, "events").select("ts", "event_id")
    return L.purged_folds(e, ["ts", "event_id"], 4, 3).select("event_id", "row_index", "fold", "role")


@query("chronological_holdout", """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN i >= n - n // 6 THEN 'validation' ELSE 'train' END AS role FROM r""")
def chronological_holdout(spark, sf):
    return L.holdout(table(spark, sf, "events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id", "role")


@query("label_choice", """
SELECT event_id, (value > 20)::INT AS y, event_id % 2 AS y_single_sign FROM events""")
def label_choice(spark, sf):
    e = table(spark, sf, "events").withColumns({"profit": F.col("value") - 20, "label": F.col("event_id") % 2, "gain": F.col("value") + 1})
    a = L.pick_label(e, "profit", "label").select("event_id", "label", "gain", F.col("y").alias("y1"))
    return L.pick_label(a, "gain", "label").select("event_id", F.col("y1").alias("y"), F.col("y").cast("long").alias("y_single_sign"))


@query("curriculum_phases", """
WITH d AS (SELECT event_id, abs(value - user_id) / 2 + abs(value - 20) AS difficulty FROM events)
SELECT event_id, difficulty, ntile(7) OVER (ORDER BY difficulty, event_id)::INT AS phase FROM d""", doubles="difficulty", digits=4)
def curriculum_phases(spark, sf):
    e = table(spark, sf, "events").withColumn("profit", F.col("value") - 20)
    return L.curriculum(e, "event_id", ["value", "user_id"], "profit", 7).select("event_id", "difficulty", "phase")


@query("sentiment_views", """
SELECT vec_id, list_avg(embedding::DOUBLE[]) AS sentiment_score FROM embeddings""", doubles="sentiment_score")
def sentiment_views(spark, sf):
    return L.sentiment_views(table(spark, sf, "embeddings"), "embedding").select("vec_id", "sentiment_score")


@query("symbol_tasks", """
SELECT event_type AS symbol, count(*) AS rows, sum((value > 20)::INT)::BIGINT AS positives FROM events GROUP BY 1""")
def symbol_tasks(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), (F.col("value") > 20).cast("int").alias("y"))
    return L.task_sizes(e, "symbol", "y")


@query("feature_matrix", """
SELECT event_id, 'value' AS feature, value FROM events WHERE value <> 0 UNION ALL SELECT event_id, 'event_type=' || event_type, 1.0 FROM events""", doubles="value")
def feature_matrix(spark, sf):
    return L.feature_matrix(table(spark, sf, "events"), "event_id", ["value"], ["event_type"])


@query("mixup_augmentation")
def mixup_augmentation(spark, sf):
    return L.mixup(ticks(spark, sf), ["t", "id"], ["bid", "ask"], "t", 0.5)


@query("dtw_augmentation")
def dtw_augmentation(spark, sf):
    return WP.dtw_mixup(ticks(spark, sf), ["symbol"], ["t", "id"], "bid", window=8, ratio=0.5).select("symbol", "id", "mixed", "distance", "lam")


# Windows that start at a chosen row, all earlier windows of the symbol, and the table of least costs row by row.
@query("dtw_partner", """
WITH w AS (SELECT symbol, id, t, row_number() OVER o AS i, list(bid) OVER (PARTITION BY symbol ORDER BY t, id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS x FROM ticks WINDOW o AS (PARTITION BY symbol ORDER BY t, id)),
full_w AS (SELECT * FROM w WHERE len(x) = 6),
q AS (SELECT * FROM full_w WHERE ('0x' || substr(md5('0:' || t || ':' || id), 1, 8))::BIGINT % 2147483647 < 2147483647 // 60),
d AS (SELECT q.symbol, q.id, p.id AS partner_id, p.i, list_reduce(q.x, lambda above, a: list_reduce(list_zip(p.x, above[1:6], above[2:7]), lambda row, c: list_append(row, abs(a - c[1]) + least(row[len(row)], c[2], c[3])), ['Infinity'::DOUBLE]),
    ['0'::DOUBLE, 'Infinity', 'Infinity', 'Infinity', 'Infinity', 'Infinity', 'Infinity'])[7] AS distance FROM q JOIN full_w p ON p.symbol = q.symbol AND p.i + 6 <= q.i)
SELECT symbol, id, arg_min(partner_id, (distance, i)) AS partner_id, min(distance) AS distance FROM d GROUP BY 1, 2""", ctes="ticks", doubles="distance")
def dtw_partner(spark, sf):
    """The nearest earlier window of a sixtieth of all windows."""
    x = ticks(spark, sf)
    drawn = RS.row_number_of(F.concat_ws(":", F.lit(0), "t", "id")) < RS.PRIME // 60
    found = WP.nearest_windows(x, ["symbol"], ["t", "id"], "bid", 6, drawn)
    return found.select("symbol", "id", "partner_id", "distance")


@query("union_with_synthetic", """
SELECT false AS is_synthetic, count(*) AS rows FROM ticks UNION ALL SELECT true, floor(count(*) * 0.25)::BIGINT FROM ticks""", ctes="ticks")
def union_with_synthetic(spark, sf):
    return L.mixup(ticks(spark, sf), ["t", "id"], ["bid"], "t", 0.25).groupBy("is_synthetic").agg(F.count(F.lit(1)).alias("rows"))


# --- scalar functions -----------------------------------------------------------------------

TAU = 2 * math.pi


@query("calendar_encoding", f"""
SELECT event_id, sin({TAU} * hour(ts) / 24) AS hour_sin, cos({TAU} * hour(ts) / 24) AS hour_cos, sin({TAU} * (isodow(ts) - 1) / 7) AS dow_sin, cos({TAU} * (isodow(ts) - 1) / 7) AS dow_cos,
    sin({TAU} * (month(ts) - 1) / 12) AS month_sin, cos({TAU} * (month(ts) - 1) / 12) AS month_cos, sin({TAU} * (day(ts) - 1) / 31) AS dom_sin, cos({TAU} * (day(ts) - 1) / 31) AS dom_cos FROM events""",
    doubles="hour_sin hour_cos dow_sin dow_cos month_sin month_cos dom_sin dom_cos")
def calendar_encoding(spark, sf):
    e = S.calendar_encoding(table(spark, sf, "events").select("event_id", "ts"), "ts")
    return e.drop("ts")


@query("safe_cast", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value ELSE -1 END AS x FROM events""", doubles="x")
def safe_cast(spark, sf):
    i = F.col("event_id") % 3
    text = F.when(i == 0, F.col("value").cast("string")).when(i == 1, "NaN").otherwise("n/a")
    return table(spark, sf, "events").select("event_id", S.safe_double(text, -1.0).alias("x"))


FORMULAS = {"f_a": "mul(bid, add(volume, 1))", "f_b": "log(div(bid, sub(volume, 50)))", "f_c": "max(sqrt(neg(bid)), sin(bid))", "f_d": "min(abs(sub(bid, 20)), cos(volume))"}


@query("formulas", """
SELECT id, bid * (user_id + 1) AS f_a, coalesce(CASE WHEN user_id <> 50 AND bid / (user_id - 50) > 0 THEN ln(bid / (user_id - 50)) END, 0) AS f_b,
    sin(bid) AS f_c, least(abs(bid - 20), cos(user_id)) AS f_d FROM ticks""", ctes="ticks", doubles="f_a f_b f_c f_d")
def formulas(spark, sf):
    t = ticks(spark, sf).withColumnRenamed("user_id", "volume")
    return FM.with_formulas(t, FORMULAS).select("id", *FORMULAS)


STRATEGY = {
    "type": "trailing_stop", "lookback": 6, "buffer": 60.0,
    "child": {"type": "stop_loss", "limit": 40.0, "child": {
        "type": "position", "size": 2.0, "condition": {
            "type": "and",
            "left": {"type": "gt", "left": {"type": "price"}, "right": {"type": "sma", "window": 5}},
            "right": {"type": "lt", "left": {"type": "rsi", "window": 7}, "right": {"type": "const", "value": 80.0}}}}},
}


@query("strategy_expression", f"""
WITH d AS (SELECT symbol, t, id, bid, coalesce(bid - lag(bid) OVER ({TICK}), 0) AS d FROM ticks),
i AS (SELECT *, avg(bid) OVER ({TICK} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sma, avg(greatest(d, 0)) OVER ({TICK} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS up,
    avg(greatest(-d, 0)) OVER ({TICK} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS dn, max(bid) OVER ({TICK} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS hi FROM d),
p AS (SELECT *, CASE WHEN bid > sma AND 100 - 100 / (1 + up / greatest(dn, 1e-12)) < 80 AND d >= -40 THEN 1.0 ELSE 0.0 END AS pos FROM i)
SELECT symbol, id, CASE WHEN pos > 0 AND hi - bid > 60 THEN 0.0 ELSE pos END AS signal FROM p""", ctes="ticks", doubles="signal")
def strategy_expression(spark, sf):
    return FM.evaluate_spec(ticks(spark, sf), STRATEGY, ["symbol"], ["t", "id"], "bid").select("symbol", "id", "signal")


MIXED = {"type": "add", "left": {"type": "sub", "left": {"type": "bollinger", "window": 10, "band": "upper"}, "right": {"type": "ema", "window": 9}},
         "right": {"type": "div", "left": {"type": "atr", "window": 8}, "right": {"type": "rolling_volatility", "window": 8}}}


@query("strategy_indicators", f"""
WITH RECURSIVE s AS (SELECT symbol, id, bid, row_number() OVER ({TICK}) AS i, coalesce(bid - lag(bid) OVER ({TICK}), 0) AS d FROM ticks),
e AS (SELECT symbol, id, i, bid AS ema FROM s WHERE i = 1 UNION ALL SELECT s.symbol, s.id, s.i, 0.2::DOUBLE * s.bid + 0.8::DOUBLE * e.ema FROM e JOIN s ON s.symbol = e.symbol AND s.i = e.i + 1),
f AS (SELECT symbol, id, avg(bid) OVER w10 + 2 * stddev_pop(bid) OVER w10 AS upper, avg(abs(d)) OVER w8 AS atr, stddev_pop(d) OVER w8 AS vol FROM s
    WINDOW w10 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), w8 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT f.symbol, f.id, upper - ema + atr / CASE WHEN abs(vol) < 1e-12 THEN 1e-12 ELSE vol END AS signal FROM f JOIN e USING (id)""", ctes="ticks", doubles="signal", digits=5)
def strategy_indicators(spark, sf):
    t = ticks(spark, sf).select("symbol", "t", "id", "bid")
    return FM.evaluate_spec(t, MIXED, ["symbol"], ["t", "id"], "bid").select("symbol", "id", "signal")


@query("cross_symbol_expression", """
SELECT hr, click / CASE WHEN abs(view) < 1e-12 THEN 1e-12 ELSE view END AS signal FROM (SELECT hr, coalesce(last_value(c IGNORE NULLS) OVER u, 0) AS click, coalesce(last_value(v IGNORE NULLS) OVER u, 0) AS view
    FROM (SELECT hr, max(close) FILTER (symbol = 'click') AS c, max(close) FILTER (symbol = 'view') AS v FROM bars WHERE symbol IN ('click', 'view') GROUP BY 1) WINDOW u AS (ORDER BY hr ROWS UNBOUNDED PRECEDING))""",
    ctes="bars", doubles="signal", digits=4)
def cross_symbol_expression(spark, sf):
    from tapeloom.operators.windows import wide_by_symbol

    wide = wide_by_symbol(bars(spark, sf), "hr", ["click", "view"], "close")
    return FM.evaluate_spec(wide, {"type": "cross_price", "symbol": "click"}, [], ["hr"], "view", others={"click": "click"}).select("hr", "signal")


@query("polynomial_terms", """
SELECT event_id, value * value AS sq, value * user_id AS cross_term, value * user_id * user_id AS cubic FROM events""", doubles="sq cross_term cubic", digits=4)
def polynomial_terms(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.round("value", 2).alias("value"), F.col("user_id").cast("double").alias("user_id"))
    terms = S.polynomial_terms(["event_id", "value", "user_id"], 3, excluded=["event_id"])
    pick = {"sq": "value^2", "cross_term": "value*user_id", "cubic": "value*user_id^2"}
    return e.select("event_id", *[terms[n].alias(c) for c, n in pick.items()])


@query("quantile_clip", """
WITH q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)
SELECT event_id, least(greatest(value, lo), hi) AS value FROM events, q""", doubles="value")
def quantile_clip(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return SC.clip(e, SC.fit_clip(e, ["value"]))


MODEL = {
    "feature_names": ["bid", "user_id"], "coefficients": [0.4, -0.7], "intercept": 0.1,
    "feature_mean": [20.0, 75.0], "feature_std": [30.0, 43.0], "clip_low": [1.0, 5.0], "clip_high": [120.0, 140.0],
}
Z0, Z1 = "(least(greatest(bid, 1), 120) - 20) / 30", "(least(greatest(user_id, 5), 140) - 75) / 43"
LOGIT = f"(0.4::DOUBLE * ({Z0}) - 0.7::DOUBLE * ({Z1}) + 0.1::DOUBLE)"


@query("logistic_score", f"""
SELECT id, 1 / (1 + exp(-{LOGIT})) AS p FROM ticks""", ctes="ticks", doubles="p")
def logistic_score(spark, sf):
    return ticks(spark, sf).select("id", SC.logistic_probability(MODEL).alias("p"))


@query("platt_calibration", f"""
SELECT id, 1 / (1 + exp(-(1.5::DOUBLE * {LOGIT} - 0.2::DOUBLE))) AS p FROM ticks""", ctes="ticks", doubles="p")
def platt_calibration(spark, sf):
    return ticks(spark, sf).select("id", SC.logistic_probability(MODEL | {"calibration": {"method": "platt", "coef": 1.5, "intercept": -0.2}}).alias("p"))


@query("isotonic_calibration", f"""
WITH p AS (SELECT id, 1 / (1 + exp(-{LOGIT})) AS p FROM ticks)
SELECT id, CASE WHEN p <= 0.2 THEN 0.05 WHEN p <= 0.5 THEN 0.05 + (p - 0.2) * (0.35 / 0.3) WHEN p <= 0.8 THEN 0.4 + (p - 0.5) * (0.5 / 0.3) ELSE 0.9 END AS p FROM p""", ctes="ticks", doubles="p")
def isotonic_calibration(spark, sf):
    cal = {"method": "isotonic", "x": [0.2, 0.5, 0.8], "y": [0.05, 0.4, 0.9]}
    return ticks(spark, sf).select("id", SC.logistic_probability(MODEL | {"calibration": cal}).alias("p"))


@query("expected_value", f"""
SELECT id, (1 / (1 + exp(-{LOGIT}))) * (3 * ({Z0}) + 2 * ({Z1}) - 0.5) AS ev FROM ticks""", ctes="ticks", doubles="ev")
def expected_value(spark, sf):
    return ticks(spark, sf).select("id", SC.expected_value(MODEL | {"pnl_coefficients": [3.0, 2.0], "pnl_intercept": -0.5}).alias("ev"))


DIM = 64  # components of an embedding


@query("linear_encoder", """
WITH z AS (SELECT vec_id, list_transform(embedding, lambda x, i: (x::DOUBLE - 0.01 * (i % 3)) / (0.1 * (1 + i % 2))) AS z FROM embeddings)
SELECT vec_id, list_sum(list_transform(z, lambda x, i: x / i)) + 0.3 AS e0, list_sum(list_transform(z, lambda x, i: x * (i % 5 - 2))) - 0.1 AS e1 FROM z""",
    doubles="e0 e1")
def linear_encoder(spark, sf):
    at = range(1, DIM + 1)
    xs = [F.get("embedding", F.lit(i - 1)).cast("double") for i in at]
    weights = [[1 / i for i in at], [i % 5 - 2 for i in at]]
    a, b = SC.encode(xs, weights, [0.3, -0.1], [0.01 * (i % 3) for i in at], [0.1 * (1 + i % 2) for i in at])
    return table(spark, sf, "embeddings").select("vec_id", a.alias("e0"), b.alias("e1"))


@query("yeo_johnson", """
SELECT event_id, CASE WHEN value - 20 >= 0 THEN (pow(value - 19, 0.3::DOUBLE) - 1) / 0.3 ELSE -(pow(21 - value, 1.7::DOUBLE) - 1) / 1.7 END AS x FROM events""", doubles="x", digits=5)
def yeo_johnson(spark, sf):
    return table(spark, sf, "events").select("event_id", S.yeo_johnson(F.col("value") - 20.0, 0.3).alias("x"))


@query("power_transform_fit", """
WITH l AS (SELECT unnest([-1.0, 0.5, 1.5]::DOUBLE[]) AS lam),
y AS (SELECT lam, value - 20 AS x, CASE WHEN value >= 20 THEN (pow(value - 19, lam) - 1) / lam ELSE -(pow(21 - value, 2 - lam) - 1) / (2 - lam) END AS y FROM events, l)
SELECT lam AS "lambda", -count(*) / 2 * ln(var_pop(y)) + (lam - 1) * sum(sign(x) * ln(abs(x) + 1)) AS log_likelihood FROM y GROUP BY 1""", doubles="log_likelihood", digits=3)
def power_transform_fit(spark, sf):
    e = table(spark, sf, "events").select((F.col("value") - 20.0).alias("x"))
    return SC.power_grid(e, "x", [-1.0, 0.5, 1.5])


@query("skewness_screen", """
SELECT 'value' AS feature, skewness(value) AS skew, abs(skewness(value)) > 1 AS skewed FROM events UNION ALL SELECT 'user_id', skewness(user_id), abs(skewness(user_id)) > 1 FROM events""", doubles="skew")
def skewness_screen(spark, sf):
    return SC.skewness_screen(table(spark, sf, "events"), ["value", "user_id"])


@query("tanh_network", f"""
WITH h AS (SELECT id, tanh(0.5 * bid / 30 - 0.2 * user_id / 43 + 0.1) AS a, tanh(-0.3 * bid / 30 + 0.8 * user_id / 43 - 0.2) AS b FROM ticks)
SELECT id, 1 / (1 + exp(-(1.2 * a - 0.7 * b + 0.05))) AS p FROM h""", ctes="ticks", doubles="p")
def tanh_network(spark, sf):
    xs = [F.col("bid") / 30.0, F.col("user_id") / 43.0]
    return ticks(spark, sf).select("id", SC.tanh_network(xs, [[0.5, -0.2], [-0.3, 0.8]], [0.1, -0.2], [1.2, -0.7], 0.05).alias("p"))


@query("expert_mixture", """
WITH x AS (SELECT id, bid / 30 AS a, user_id / 43 AS b FROM ticks), g AS (SELECT id, a, b, exp(0.5 * a) AS g0, exp(0.9 * b - 0.3) AS g1 FROM x)
SELECT id, (g0 / (1 + exp(-(a - b))) + g1 / (1 + exp(-(0.2 * a + 0.4 * b + 0.1)))) / (g0 + g1) AS p, CASE WHEN 0.5 * a >= 0.9 * b - 0.3 THEN 0 ELSE 1 END AS gate FROM g""", ctes="ticks", doubles="p")
def expert_mixture(spark, sf):
    xs = [F.col("bid") / 30.0, F.col("user_id") / 43.0]
    gates = [([0.5, 0.0], 0.0), ([0.0, 0.9], -0.3)]
    p = SC.expert_mixture(xs, xs, gates, [([1.0, -1.0], 0.0), ([0.2, 0.4], 0.1)])
    return ticks(spark, sf).select("id", p.alias("p"), SC.gate_choice(xs, gates).alias("gate"))


PRECISION = [[0.5, 0.1], [0.1, 0.8]]


@query("ood_gate", f"""
WITH z AS (SELECT id, {Z0} AS a, {Z1} AS b, {LOGIT} AS l FROM ticks), d AS (SELECT *, sqrt(0.5 * (a - 0.1) * (a - 0.1) + 0.2 * (a - 0.1) * (b + 0.1) + 0.8 * (b + 0.1) * (b + 0.1)) AS d FROM z)
SELECT id, d AS distance, CASE WHEN d > 1.2 THEN 0 ELSE 1 / (1 + exp(-l)) END AS p FROM d""", ctes="ticks", doubles="distance p")
def ood_gate(spark, sf):
    m = MODEL | {"ood": {"mean": [0.1, -0.1], "precision": PRECISION, "threshold": 1.2}}
    return ticks(spark, sf).select("id", SC.mahalanobis(SC.prepared(MODEL), [0.1, -0.1], PRECISION).alias("distance"), SC.logistic_probability(m).alias("p"))


@query("weighted_ensemble", """
WITH m AS (SELECT decision_id, (2 * probability + (decision_id % 10) / 10.0::DOUBLE) / 3 AS m FROM decisions)
SELECT decision_id, CASE WHEN m >= 0.4 THEN m ELSE 0 END AS p FROM m""", ctes="decisions", doubles="p")
def weighted_ensemble(spark, sf):
    d = base.decisions(spark, sf)
    return d.select("decision_id", SC.weighted_ensemble([F.col("probability"), (F.col("decision_id") % 10) / 10.0], [2.0, 1.0], 0.4).alias("p"))


@query("reconstruction_error", """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE - 0.01) AS x FROM embeddings), c AS (SELECT *, list_sum(x) / 8 AS c FROM x),
e AS (SELECT vec_id, list_sum(list_transform(x, lambda v: pow(v - c / 8, 2))) / 64 AS error FROM c)
SELECT vec_id, error, error > 0.016 AS is_anomaly FROM e""", doubles="error", digits=8)
def reconstruction_error(spark, sf):
    xs = [F.get("embedding", F.lit(i)).cast("double") for i in range(DIM)]
    e = SC.reconstruction_error(xs, [0.01] * DIM, [[1 / 8] * DIM])
    return table(spark, sf, "embeddings").select("vec_id", e.alias("error"), (e > 0.016).alias("is_anomaly"))


@query("decision_id_in_comment", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS decision_id FROM events""")
def decision_id_in_comment(spark, sf):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("open decision_id="), F.col("user_id").cast("string"), F.lit(" x"))).otherwise("none")
    return table(spark, sf, "events").select("event_id", S.decision_id_in(text).alias("decision_id"))


@query("json_vector", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS v0, CASE WHEN event_id % 3 = 1 THEN user_id::DOUBLE ELSE 0 END AS v1, 0.0::DOUBLE AS v2, 3 AS n FROM events""", doubles="v0 v1")
def json_vector(spark, sf):
    i = F.col("event_id") % 3
    text = F.when(i == 0, "not json").when(i == 1, F.concat(F.lit("["), F.col("value").cast("string"), F.lit(","), F.col("user_id").cast("string"), F.lit("]"))).otherwise(
        F.concat(F.lit("["), F.col("value").cast("string"), F.lit(", null, null, 7]")))
    v = S.json_vector(text, 3)
    return table(spark, sf, "events").select("event_id", v[0].alias("v0"), v[1].alias("v1"), v[2].alias("v2"), F.size(v).alias("n"))


@query("nearest_centroid", """
WITH d AS (SELECT event_id, pow(value - 5, 2) + pow(user_id - 20, 2) AS a, pow(value - 40, 2) + pow(user_id - 75, 2) AS b, pow(value - 10, 2) + pow(user_id - 130, 2) AS c FROM events)
SELECT event_id, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS centre FROM d""")
def nearest_centroid(spark, sf):
    v = F.array(F.col("value"), F.col("user_id").cast("double"))
    return table(spark, sf, "events").select("event_id", S.nearest_centroid(v, [[5.0, 20.0], [40.0, 75.0], [10.0, 130.0]]).alias("centre"))


@query("limit_order_fill", """
WITH o AS (SELECT id, CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END AS side, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN ask ELSE bid END ELSE 20.0::DOUBLE END AS lim, bid, ask FROM ticks),
f AS (SELECT id, CASE WHEN side = 1 THEN CASE WHEN ask < lim THEN 2 WHEN ask = lim THEN 1 ELSE 0 END ELSE CASE WHEN bid > lim THEN 2 WHEN bid = lim THEN 1 ELSE 0 END END AS filled, CASE WHEN side = 1 THEN ask ELSE bid END AS q FROM o)
SELECT id, filled::DOUBLE AS filled, CASE WHEN filled > 0 THEN q ELSE 0 END AS price FROM f""", ctes="ticks", doubles="filled price")
def limit_order_fill(spark, sf):
    i = F.col("id")
    t = ticks(spark, sf).withColumn("side", F.when(i % 2 == 0, 1).otherwise(-1))
    lim = F.when(i % 3 == 0, F.when(F.col("side") == 1, F.col("ask")).otherwise(F.col("bid"))).otherwise(20.0)
    filled, price = S.limit_fill(F.col("side"), lim, F.col("bid"), F.col("ask"), F.lit(2.0))
    return t.select("id", filled.alias("filled"), price.alias("price"))


@query("log_variance", """
SELECT l_orderkey, l_linenumber, l_partkey, ln(l_quantity) AS lv, 0.5 * (ln(2 * pi()) + ln(l_quantity) + pow(l_tax - l_discount, 2) / l_quantity) AS nll FROM lineitem""", doubles="lv nll")
def log_variance(spark, sf):
    lv = S.log_variance(F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", lv.alias("lv"), S.gaussian_nll(F.col("l_tax"), F.col("l_discount"), lv).alias("nll"))


NETWORK = MODEL | {"model_type": "nn", "nn_weights": [[[0.5, -0.3, 0.2], [-0.2, 0.8, 0.1]], [0.1, -0.2, 0.3], [[1.2], [-0.7], [0.4]], [0.05]]}
EXPERTS = MODEL | {
    "model_type": "moe", "regime_gating": {"feature_names": ["ask"], "weights": [[0.01], [-0.02]], "intercepts": [0.0, 1.0]},
    "session_models": [{"coefficients": [1.0, -1.0], "intercept": 0.0}, {"coefficients": [0.2, 0.4], "intercept": 0.1}],
}


@query("score_decision_log", f"""
WITH z AS (SELECT id, ask, {Z0} AS a, {Z1} AS b, 1 / (1 + exp(-{LOGIT})) AS logistic FROM ticks),
h AS (SELECT *, tanh(0.5 * a - 0.2 * b + 0.1) AS u, tanh(-0.3 * a + 0.8 * b - 0.2) AS v, tanh(0.2 * a + 0.1 * b + 0.3) AS w, exp(0.01 * ask) AS g0, exp(1 - 0.02 * ask) AS g1 FROM z)
SELECT id, logistic, 1 / (1 + exp(-(1.2 * u - 0.7 * v + 0.4 * w + 0.05))) AS network,
    (g0 / (1 + exp(-(a - b))) + g1 / (1 + exp(-(0.2 * a + 0.4 * b + 0.1)))) / (g0 + g1) AS experts FROM h""", ctes="ticks", doubles="logistic network experts")
def score_decision_log(spark, sf):
    df = ticks(spark, sf)
    for name, model in (("logistic", MODEL), ("network", NETWORK), ("experts", EXPERTS)):
        df = SC.score_log(df, model, name)
    return df.select("id", "logistic", "network", "experts")


@query("exact_quantiles", """
SELECT event_type AS symbol, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.99) AS q99 FROM events GROUP BY 1""", doubles="q10 q50 q99")
def exact_quantiles(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), "value")
    return quantiles(e, ["symbol"], "value", {"q10": 0.1, "q50": 0.5, "q99": 0.99})


@query("feature_plugins", f"""
SELECT symbol, id, lag(bid, 2) OVER w AS bid_lag_2, avg(bid) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sma,
    avg(bid) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) + 2 * stddev_pop(bid) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS bollinger_upper,
    sin({TAU} * (isodow(make_timestamp(t)) - 1) / 7) AS dow_sin FROM ticks WINDOW w AS ({TICK})""", ctes="ticks", doubles="bid_lag_2 sma bollinger_upper dow_sin")
def feature_plugins(spark, sf):
    df, _ = X.apply_features(ticks(spark, sf).withColumn("ts", F.timestamp_micros("t").cast("timestamp_ntz")), ["technical", "calendar"], technical={"price": "bid", "lags": [2]}, calendar={"ts": "ts"})
    return df.select("symbol", "id", "bid_lag_2", "sma", "bollinger_upper", "dow_sin")


@query("metric_plugins", """
SELECT model_idx, avg(((probability >= 0.5)::INT = (profit > 0)::INT)::INT) AS accuracy, avg(pow(probability - (profit > 0)::INT, 2)) AS brier_score, sum(profit) AS profit,
    CASE WHEN stddev_samp(profit) > 0 THEN avg(profit) / stddev_samp(profit) ELSE 0 END AS sharpe_ratio FROM decisions GROUP BY 1""", ctes="decisions", doubles="accuracy brier_score profit sharpe_ratio", digits=4)
def metric_plugins(spark, sf):
    d = base.decisions(spark, sf).withColumn("y", (F.col("profit") > 0).cast("int"))
    return X.compute_metrics(d, "y", "probability", "profit", ["accuracy", "brier_score", "profit", "sharpe_ratio"], keys=["model_idx"])


@query("report_steps", """
SELECT count_if(is_match) AS matched_events, count(*) - count_if(is_match) AS fp, count_if(is_match) / count(*) AS precision FROM matched""", ctes="trades preds matched", doubles="precision", ints="matched_events fp")
def report_steps(spark, sf):
    m = base.matched(spark, sf)
    r = m.agg(F.count_if("is_match").alias("matched_events"), (F.count(F.lit(1)) - F.count_if("is_match")).alias("fp"))
    return X.run_steps(r, ["precision"], {})


@query("merged_features", """
SELECT id, ask - bid AS spread, bid / 2 AS mid FROM ticks""", ctes="ticks", doubles="spread mid")
def merged_features(spark, sf):
    a = {"spread": F.col("ask") - F.col("bid"), "mid": (F.col("ask") + F.col("bid")) / 2}
    return X.merge_features(ticks(spark, sf), a, {"mid": F.col("bid") / 2}).select("id", "spread", "mid")
