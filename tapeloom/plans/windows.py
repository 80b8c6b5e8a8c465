"""Window-feature queries over ticks and hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import windows as W
from tapeloom.plans.base import bars, query, ticks

KEY, TICK, BAR = ["symbol"], ["t", "id"], ["hr"]
BY_TICK = "PARTITION BY symbol ORDER BY t, id"
BY_BAR = "PARTITION BY symbol ORDER BY hr"


@query("lag_diff", f"""
SELECT symbol, id, lag(bid, 1) OVER w AS bid_lag_1, lag(bid, 3) OVER w AS bid_lag_3,
    bid - lag(bid, 1) OVER w AS bid_diff FROM ticks WINDOW w AS ({BY_TICK})""",
    doubles="bid_lag_1 bid_lag_3 bid_diff", ctes="ticks")
def lag_diff(spark, sf):
    df = W.lag_diff(ticks(spark, sf), KEY, TICK, ["bid"], [1, 3])
    return df.select("symbol", "id", "bid_lag_1", "bid_lag_3", "bid_diff")


@query("sma", f"""
SELECT symbol, id, avg(bid) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sma FROM ticks WINDOW w AS ({BY_TICK})""",
    doubles="sma", ctes="ticks")
def sma(spark, sf):
    return W.sma(ticks(spark, sf), KEY, TICK, "bid", 5).select("symbol", "id", "sma")


@query("sma_before_row", f"""
SELECT symbol, id, coalesce(avg(bid) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS sma
FROM ticks WINDOW w AS ({BY_TICK})""", doubles="sma", ctes="ticks")
def sma_before_row(spark, sf):
    return W.sma(ticks(spark, sf), KEY, TICK, "bid", 5, include_current=False).select("symbol", "id", "sma")


@query("sma_centred", f"""
SELECT symbol, id, sum(bid) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 AS sma_centred
FROM ticks WINDOW w AS ({BY_TICK})""", doubles="sma_centred", ctes="ticks")
def sma_centred(spark, sf):
    return W.sma_centred(ticks(spark, sf), KEY, TICK, "bid", 4).select("symbol", "id", "sma_centred")


@query("bollinger_bands", f"""
SELECT symbol, id, avg(bid) OVER f + 2 * stddev_pop(bid) OVER f AS bollinger_upper, avg(bid) OVER f AS bollinger_middle,
    avg(bid) OVER f - 2 * stddev_pop(bid) OVER f AS bollinger_lower
FROM ticks WINDOW f AS ({BY_TICK} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    doubles="bollinger_upper bollinger_middle bollinger_lower", ctes="ticks")
def bollinger_bands(spark, sf):
    df = W.bollinger(ticks(spark, sf), KEY, TICK, "bid")
    return df.select("symbol", "id", "bollinger_upper", "bollinger_middle", "bollinger_lower")


DELTAS = f"""d AS (SELECT symbol, t, id, bid, bid - lag(bid) OVER (PARTITION BY symbol ORDER BY t, id) AS d FROM ticks)"""


@query("rsi_means", f"""
WITH {DELTAS}, m AS (SELECT symbol, id, avg(greatest(coalesce(d, 0), 0)) OVER f AS up,
    avg(greatest(-coalesce(d, 0), 0)) OVER f AS dn FROM d WINDOW f AS ({BY_TICK} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT symbol, id, 100 - 100 / (1 + up / (dn + 1e-9)) AS rsi FROM m""", doubles="rsi", ctes="ticks", digits=5)
def rsi_means(spark, sf):
    return W.rsi(ticks(spark, sf), KEY, TICK, "bid").select("symbol", "id", "rsi")


@query("rsi_sums", f"""
WITH {DELTAS}, m AS (SELECT symbol, id, sum(greatest(d, 0)) FILTER (d IS NOT NULL) OVER f AS up,
    sum(greatest(-d, 0)) FILTER (d IS NOT NULL) OVER f AS dn FROM d WINDOW f AS ({BY_TICK} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
SELECT symbol, id, CASE WHEN up IS NULL THEN 50 WHEN abs(dn) < 1e-12 THEN 100 ELSE 100 - 100 / (1 + up / dn) END AS rsi FROM m""",
    doubles="rsi", ctes="ticks")
def rsi_sums(spark, sf):
    return W.rsi(ticks(spark, sf), KEY, TICK, "bid", kind="sums").select("symbol", "id", "rsi")


@query("rsi_floored", f"""
WITH {DELTAS}, m AS (SELECT symbol, id, avg(greatest(coalesce(d, 0), 0)) OVER f AS up,
    avg(greatest(-coalesce(d, 0), 0)) OVER f AS dn FROM d WINDOW f AS ({BY_TICK} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT symbol, id, 100 - 100 / (1 + up / greatest(dn, 1e-12)) AS rsi FROM m""", doubles="rsi", ctes="ticks", digits=5)
def rsi_floored(spark, sf):
    return W.rsi(ticks(spark, sf), KEY, TICK, "bid", kind="floored").select("symbol", "id", "rsi")


TRUE_RANGE = f"""tr AS (SELECT *, greatest(abs(high - low), abs(high - coalesce(pc, close)), abs(low - coalesce(pc, close))) AS tr
    FROM (SELECT *, lag(close) OVER ({BY_BAR}) AS pc FROM bars))"""


@query("atr", f"""
WITH {TRUE_RANGE}
SELECT symbol, hr, avg(tr) OVER ({BY_BAR} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr FROM tr""",
    doubles="atr", ctes="bars")
def atr(spark, sf):
    return W.atr(bars(spark, sf), KEY, BAR, "close", "high", "low").select("symbol", "hr", "atr")


@query("atr_price_only", f"""
WITH {DELTAS}
SELECT symbol, id, coalesce(avg(abs(d)) OVER ({BY_TICK} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 0) AS atr FROM d""",
    doubles="atr", ctes="ticks")
def atr_price_only(spark, sf):
    return W.atr(ticks(spark, sf), KEY, TICK, "bid").select("symbol", "id", "atr")


@query("stop_target_in_atr", f"""
WITH {TRUE_RANGE}, a AS (SELECT *, avg(tr) OVER ({BY_BAR} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr FROM tr)
SELECT symbol, hr, CASE WHEN atr > 0 THEN abs(low - close) / atr ELSE 0 END AS sl_dist_atr,
    CASE WHEN atr > 0 THEN abs(high - close) / atr ELSE 0 END AS tp_dist_atr FROM a""",
    doubles="sl_dist_atr tp_dist_atr", ctes="bars")
def stop_target_in_atr(spark, sf):
    df = W.distance_in_atr(bars(spark, sf), KEY, BAR, "close", "low", "high", "high", "low")
    return df.select("symbol", "hr", "sl_dist_atr", "tp_dist_atr")


@query("stochastic", f"""
WITH k AS (SELECT symbol, t, id, CASE WHEN max(bid) OVER f = min(bid) OVER f THEN 0
    ELSE (bid - min(bid) OVER f) / (max(bid) OVER f - min(bid) OVER f) * 100 END AS stoch_k
    FROM ticks WINDOW f AS ({BY_TICK} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT symbol, id, stoch_k, avg(stoch_k) OVER ({BY_TICK} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS stoch_d FROM k""",
    doubles="stoch_k stoch_d", ctes="ticks")
def stochastic(spark, sf):
    return W.stochastic(ticks(spark, sf), KEY, TICK, "bid").select("symbol", "id", "stoch_k", "stoch_d")


PAIRS = [("click", "view"), ("error", "purchase")]


def _wide_sql(symbols):
    cols = ", ".join(f"max(close) FILTER (symbol = '{s}') AS {s}" for s in symbols)
    fill = ", ".join(f"coalesce(last_value({s} IGNORE NULLS) OVER u, 0) AS {s}" for s in symbols)
    names = ", ".join(f"'{s}'" for s in symbols)
    return f"""raw AS (SELECT hr, {cols} FROM bars WHERE symbol IN ({names}) GROUP BY hr),
    wide AS (SELECT hr, {fill} FROM raw WINDOW u AS (ORDER BY hr ROWS UNBOUNDED PRECEDING))"""


_FOUR = ["click", "error", "purchase", "view"]


def _corr_sql(a, b):
    guard = f"var_pop(r_{a}) OVER f > 1e-18 AND var_pop(r_{b}) OVER f > 1e-18 AND count(*) OVER f >= 2"
    rho = f"covar_pop(r_{a}, r_{b}) OVER f / sqrt((var_pop(r_{a}) OVER f) * (var_pop(r_{b}) OVER f))"
    return f"CASE WHEN {guard} THEN least(greatest({rho}, -1), 1) ELSE 0 END AS corr_{a}_{b}_w10"


@query("rolling_correlation", f"""
WITH {_wide_sql(_FOUR)}, r AS (SELECT hr, {", ".join(f"CASE WHEN lag({s}) OVER u <> 0 THEN {s} / lag({s}) OVER u - 1 ELSE 0 END AS r_{s}" for s in _FOUR)}
    FROM wide WINDOW u AS (ORDER BY hr))
SELECT hr, {", ".join(_corr_sql(a, b) for a, b in PAIRS)}
FROM r WINDOW f AS (ORDER BY hr ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    doubles="corr_click_view_w10 corr_error_purchase_w10", ctes="bars", digits=5)
def rolling_correlation(spark, sf):
    df = W.rolling_correlation(bars(spark, sf), "hr", PAIRS, "close", 10)
    return df.select("hr", "corr_click_view_w10", "corr_error_purchase_w10")


@query("peer_price_ratio", f"""
WITH {_wide_sql(["click", "error", "view"])}
SELECT hr, CASE WHEN error = 0 THEN 0 ELSE click / error END AS ratio_click_error,
    CASE WHEN view = 0 THEN 0 ELSE click / view END AS ratio_click_view FROM wide""",
    doubles="ratio_click_error ratio_click_view", ctes="bars")
def peer_price_ratio(spark, sf):
    df = W.peer_ratio(bars(spark, sf), "hr", "click", ["error", "view"], "close")
    return df.select("hr", "ratio_click_error", "ratio_click_view")


@query("adx", f"""
WITH {DELTAS}, m AS (SELECT symbol, t, id, d, avg(abs(d)) OVER f AS tr, avg(greatest(d, 0)) FILTER (d IS NOT NULL) OVER f AS p,
    avg(greatest(-d, 0)) FILTER (d IS NOT NULL) OVER f AS m FROM d WINDOW f AS ({BY_TICK} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
x AS (SELECT symbol, t, id, CASE WHEN d IS NULL THEN NULL WHEN tr = 0 OR p + m = 0 THEN 0 ELSE 100 * abs(p - m) / (p + m) END AS dx FROM m)
SELECT symbol, id, coalesce(avg(dx) OVER ({BY_TICK} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 0) AS adx FROM x""",
    doubles="adx", ctes="ticks")
def adx(spark, sf):
    return W.adx(ticks(spark, sf), KEY, TICK, "bid").select("symbol", "id", "adx")


@query("order_flow", f"""
WITH v AS (SELECT symbol, t, id, bid, ask, bid AS bt, ask / 2 AS ak, bid * 1.75::DOUBLE AS bv, ask * 0.75::DOUBLE AS av FROM ticks)
SELECT symbol, id, (ask * bt + bid * ak) / (bt + ak + 1e-9) AS depth_microprice, (bv - av) / (bv + av + 1e-9) AS depth_vol_imbalance,
    (bv - coalesce(lag(bv) OVER w, bv)) - (av - coalesce(lag(av) OVER w, av)) AS depth_order_flow_imbalance
FROM v WINDOW w AS ({BY_TICK})""",
    doubles="depth_microprice depth_vol_imbalance depth_order_flow_imbalance", ctes="ticks", digits=8)
def order_flow(spark, sf):
    df = ticks(spark, sf).withColumns({
        "bd": F.array(F.col("bid"), F.col("bid") / 2, F.col("bid") / 4),
        "ad": F.array(F.col("ask") / 2, F.col("ask") / 4),
    })
    df = W.order_flow(df, KEY, TICK, "bid", "ask", "bd", "ad")
    return df.select("symbol", "id", "depth_microprice", "depth_vol_imbalance", "depth_order_flow_imbalance")


@query("book_imbalance", f"""
WITH v AS (SELECT symbol, t, id, bid / (bid + user_id) AS b, user_id / (bid + user_id) AS a FROM ticks)
SELECT symbol, id, b - a AS book_imbalance, a - b AS book_spread, b / (a + 1e-9) AS bid_ask_ratio,
    avg(b - a) OVER ({BY_TICK} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS book_imbalance_roll FROM v""",
    doubles="book_imbalance book_spread bid_ask_ratio book_imbalance_roll", ctes="ticks", digits=4)
def book_imbalance(spark, sf):
    df = W.book_imbalance(ticks(spark, sf).withColumn("av", F.col("user_id").cast("double")), KEY, TICK, "bid", "av")
    return df.select("symbol", "id", "book_imbalance", "book_spread", "bid_ask_ratio", "book_imbalance_roll")


@query("candle_patterns", f"""
WITH c AS (SELECT *, abs(close - open) AS body, high - greatest(open, close) AS up, least(open, close) - low AS lo,
    high - low AS span, lag(open) OVER w AS po, lag(close) OVER w AS pc FROM bars WINDOW w AS ({BY_BAR}))
SELECT symbol, hr, (span > 0 AND lo >= 2 * body AND up <= body AND body / nullif(span, 0) < 0.3)::INT::DOUBLE AS pattern_hammer,
    (span <> 0 AND body <= 0.1::DOUBLE * span)::INT::DOUBLE AS pattern_doji,
    coalesce((body > abs(pc - po) AND ((open < pc AND close > po) OR (open > pc AND close < po)))::INT::DOUBLE, 0) AS pattern_engulfing FROM c""",
    doubles="pattern_hammer", ctes="bars")
def candle_patterns(spark, sf):
    df = W.candle_patterns(bars(spark, sf), KEY, BAR)
    return df.select("symbol", "hr", "pattern_hammer", "pattern_doji", "pattern_engulfing")


@query("hurst_fractal", f"""
WITH {DELTAS}, e AS (SELECT *, lag(d) OVER ({BY_TICK}) AS e FROM d), p AS (SELECT symbol, t, id, CASE WHEN e IS NOT NULL THEN d END AS d, e FROM e),
h AS (SELECT symbol, id, CASE WHEN count(e) OVER f >= 2 AND var_pop(d) OVER f > 1e-18 AND var_pop(e) OVER f > 1e-18
    THEN 0.5::DOUBLE + 0.5::DOUBLE * (covar_pop(d, e) OVER f) / sqrt((var_pop(d) OVER f) * (var_pop(e) OVER f)) ELSE 0.5 END AS h
    FROM p WINDOW f AS ({BY_TICK} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW))
SELECT symbol, id, least(greatest(h, 0), 1) AS hurst, 2 - least(greatest(h, 0), 1) AS fractal_dim FROM h""",
    doubles="hurst fractal_dim", ctes="ticks", digits=5)
def hurst_fractal(spark, sf):
    return W.hurst(ticks(spark, sf), KEY, TICK, "bid").select("symbol", "id", "hurst", "fractal_dim")


@query("fft_head4", f"""
WITH v AS (SELECT symbol, id, list(bid) OVER ({BY_TICK} ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS v FROM ticks),
h AS (SELECT symbol, id, coalesce(v[1], 0) AS a, coalesce(v[2], 0) AS b, coalesce(v[3], 0) AS c, coalesce(v[4], 0) AS d FROM v)
SELECT symbol, id, abs(a + b + c + d) AS fft_0_mag, CASE WHEN a + b + c + d < 0 THEN pi() ELSE 0 END AS fft_0_phase,
    sqrt((a - c) * (a - c) + (d - b) * (d - b)) AS fft_1_mag, atan2(d - b, a - c) AS fft_1_phase FROM h""",
    doubles="fft_0_mag fft_0_phase fft_1_mag fft_1_phase", ctes="ticks")
def fft_head4(spark, sf):
    df = W.fft_head4(ticks(spark, sf), KEY, TICK, "bid")
    return df.select("symbol", "id", "fft_0_mag", "fft_0_phase", "fft_1_mag", "fft_1_phase")


RETURNS = f"""r AS (SELECT *, coalesce(close / nullif(lag(close) OVER ({BY_BAR}), 0) - 1, 0) AS ret FROM bars)"""


@query("cross_section_rank", f"""
WITH v AS (SELECT symbol, hr, close, volume FROM bars),
n AS (SELECT *, count(*) OVER (PARTITION BY hr) AS n, rank() OVER (PARTITION BY hr ORDER BY close) - 1 AS rc,
    rank() OVER (PARTITION BY hr ORDER BY volume) - 1 AS rv FROM v)
SELECT symbol, hr, CASE WHEN n > 1 THEN rc / (n - 1) ELSE 0.5 END AS ret_rank, CASE WHEN n > 1 THEN rv / (n - 1) ELSE 0.5 END AS vol_rank FROM n""",
    doubles="ret_rank vol_rank", ctes="bars")
def cross_section_rank(spark, sf):
    df = W.cross_section_rank(bars(spark, sf), "hr", {"close": "ret_rank", "volume": "vol_rank"})
    return df.select("symbol", "hr", "ret_rank", "vol_rank")


@query("market_neutral", f"""
WITH {RETURNS}, m AS (SELECT *, avg(ret) OVER (PARTITION BY hr) AS mkt FROM r),
f AS (SELECT regr_slope(close, mkt) AS b, regr_intercept(close, mkt) AS a FROM m)
SELECT symbol, hr, close - (a + b * mkt) AS close_neutral FROM m, f""", doubles="close_neutral", ctes="bars", digits=5)
def market_neutral(spark, sf):
    df = W.simple_return(bars(spark, sf), KEY, BAR, "close")
    return W.neutralise(df, "hr", "ret", ["close"]).select("symbol", "hr", "close_neutral")


def _ema_sql(alpha_by_name, seed="bid", start=None):
    first = ", ".join(f"{seed if start is None else f'{a} * {seed} + (1 - {a}) * {start}'} AS {n}" for n, a in alpha_by_name.items())
    step = ", ".join(f"{a} * s.{seed} + (1 - {a}) * e.{n}" for n, a in alpha_by_name.items())
    names = ", ".join(alpha_by_name)
    return f"""s AS (SELECT symbol, id, {seed}, row_number() OVER ({BY_TICK}) AS i FROM ticks),
e AS (SELECT symbol, id, i, {first} FROM s WHERE i = 1 UNION ALL SELECT s.symbol, s.id, s.i, {step} FROM e JOIN s ON s.symbol = e.symbol AND s.i = e.i + 1)"""


@query("ema", f"""
WITH RECURSIVE {_ema_sql({"ema": "(2.0::DOUBLE / 11)"})}
SELECT symbol, id, ema FROM e""", doubles="ema", ctes="ticks")
def ema(spark, sf):
    return W.ewm(ticks(spark, sf).select("symbol", "t", "id", "bid"), KEY, TICK, {"ema": ("bid", 2.0 / 11)}).select("symbol", "id", "ema")


@query("macd", f"""
WITH RECURSIVE s AS (SELECT symbol, id, bid, row_number() OVER ({BY_TICK}) AS i FROM ticks),
e AS (SELECT symbol, id, i, bid AS a, bid AS b, 0::DOUBLE AS g FROM s WHERE i = 1 UNION ALL
    SELECT symbol, id, i, a, b, 0.2::DOUBLE * (a - b) + 0.8::DOUBLE * g FROM (SELECT s.symbol, s.id, s.i,
        (2.0::DOUBLE / 13) * s.bid + (11.0::DOUBLE / 13) * e.a AS a, (2.0::DOUBLE / 27) * s.bid + (25.0::DOUBLE / 27) * e.b AS b, e.g
        FROM e JOIN s ON s.symbol = e.symbol AND s.i = e.i + 1))
SELECT symbol, id, a - b AS macd, g AS macd_signal FROM e""", doubles="macd macd_signal", ctes="ticks")
def macd(spark, sf):
    df = ticks(spark, sf).select("symbol", "t", "id", "bid")
    return W.macd(df, KEY, TICK, "bid").select("symbol", "id", "macd", "macd_signal")


@query("ewma_anomaly", f"""
WITH a AS (SELECT symbol, bid, row_number() OVER (PARTITION BY symbol ORDER BY t DESC, id DESC) - 1 AS age FROM ticks),
w AS (SELECT symbol, bid, age, pow(0.7::DOUBLE, age) AS w FROM a WHERE age < 2000),
m AS (SELECT symbol, sum(w * bid) / sum(w) AS mu, sum(w) AS sw, sum(w * w) AS sw2, max(bid) FILTER (age = 0) AS last_value FROM w GROUP BY 1),
v AS (SELECT m.symbol, mu, last_value, sqrt(sum(w * (bid - mu) * (bid - mu)) * any_value(sw) / (any_value(sw) * any_value(sw) - any_value(sw2))) AS sd
    FROM w JOIN m ON w.symbol = m.symbol GROUP BY 1, 2, 3)
SELECT symbol, last_value, mu AS ewm_mean, sd AS ewm_std, abs(last_value - mu) > 1.5 * sd AS is_anomaly FROM v""",
    doubles="last_value ewm_mean ewm_std", ctes="ticks")
def ewma_anomaly(spark, sf):
    return W.ewma_anomaly(ticks(spark, sf), KEY, TICK, "bid", threshold=1.5)


@query("kalman", f"""
WITH RECURSIVE s AS (SELECT symbol, id, bid AS z, row_number() OVER ({BY_TICK}) AS i FROM ticks),
k AS (SELECT DISTINCT symbol, -1::BIGINT AS id, 0::BIGINT AS i, 0::DOUBLE AS x, 0::DOUBLE AS v, 1::DOUBLE AS p, 0::DOUBLE AS c, 1::DOUBLE AS q FROM s
UNION ALL SELECT symbol, id, i, x + p / (p + 0.01::DOUBLE) * (z - x), v + c / (p + 0.01::DOUBLE) * (z - x),
    p - p / (p + 0.01::DOUBLE) * p, c - p / (p + 0.01::DOUBLE) * c, q - c / (p + 0.01::DOUBLE) * c
    FROM (SELECT s.symbol, s.id, s.i, s.z, k.x + k.v AS x, k.v AS v, k.p + 2 * k.c + k.q + 0.0000025::DOUBLE AS p,
        k.c + k.q + 0.000005::DOUBLE AS c, k.q + 0.00001::DOUBLE AS q FROM k JOIN s ON s.symbol = k.symbol AND s.i = k.i + 1))
SELECT symbol, id, x AS kalman_level, v AS kalman_trend FROM k WHERE i > 0""", doubles="kalman_level kalman_trend", ctes="ticks", digits=5)
def kalman(spark, sf):
    df = ticks(spark, sf).select("symbol", "t", "id", "bid")
    return W.kalman(df, KEY, TICK, "bid").select("symbol", "id", "kalman_level", "kalman_trend")


@query("volatility_scaler", f"""
SELECT symbol, id, greatest(1 / (1 + stddev_pop(bid) OVER ({BY_TICK} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)), 1e-6) AS vol_scaler FROM ticks""",
    doubles="vol_scaler", ctes="ticks")
def volatility_scaler(spark, sf):
    return W.volatility_scaler(ticks(spark, sf), KEY, TICK, "bid").select("symbol", "id", "vol_scaler")


@query("window_sequences", f"""
WITH v AS (SELECT symbol, id, list(bid) OVER f AS b, list(user_id) OVER f AS u FROM ticks WINDOW f AS ({BY_TICK} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT symbol, id, b[1] AS first_bid, b[4] AS last_bid, u[1]::DOUBLE AS first_user, len(b)::INT AS steps FROM v WHERE len(b) = 4""",
    doubles="first_bid last_bid", ctes="ticks")
def window_sequences(spark, sf):
    df = W.window_sequences(ticks(spark, sf), KEY, TICK, ["bid", "user_id"], 4)
    return df.select(
        "symbol", "id", F.col("sequence")[0][0].alias("first_bid"), F.col("sequence")[3][0].alias("last_bid"),
        F.col("sequence")[0][1].alias("first_user"), F.size("sequence").alias("steps"),
    )


@query("next_tick_return", f"""
WITH n AS (SELECT symbol, id, bid, ask, bid - 20 AS sig, lead(bid) OVER w AS nb, lead(ask) OVER w AS na FROM ticks WINDOW w AS ({BY_TICK}))
SELECT symbol, id, CASE WHEN sig > 1 THEN 1 WHEN sig < -1 THEN -1 ELSE 0 END AS direction,
    CASE WHEN sig > 1 THEN nb - 0.01::DOUBLE - (ask + 0.01::DOUBLE) WHEN sig < -1 THEN bid - 0.01::DOUBLE - (na + 0.01::DOUBLE) END - 0.05::DOUBLE AS profit FROM n""",
    doubles="profit", ctes="ticks")
def next_tick_return(spark, sf):
    df = ticks(spark, sf).withColumn("sig", F.col("bid") - 20.0)
    return W.next_move(df, KEY, TICK, "bid", "ask", "sig", 1.0, 0.01, 0.05).select("symbol", "id", "direction", "profit")


@query("rolling_model_weights", f"""
WITH RECURSIVE src AS (SELECT user_id % 3 AS m, t, id, bid / 100 AS p, (bid > 20)::INT::DOUBLE AS h FROM ticks),
s AS (SELECT m, t, id, p, h, row_number() OVER (PARTITION BY m ORDER BY t, id) AS i FROM src),
e AS (SELECT m, t, id, i, 0.1::DOUBLE * p AS p, 0.1::DOUBLE * h AS h FROM s WHERE i = 1 UNION ALL
    SELECT s.m, s.t, s.id, s.i, 0.9::DOUBLE * e.p + 0.1::DOUBLE * s.p, 0.9::DOUBLE * e.h + 0.1::DOUBLE * s.h FROM e JOIN s ON s.m = e.m AND s.i = e.i + 1),
z AS (SELECT id, {", ".join(f"coalesce(last_value(CASE WHEN m = {m} THEN p + h END IGNORE NULLS) OVER (ORDER BY t, id ROWS UNBOUNDED PRECEDING), 0) AS s{m}" for m in range(3))} FROM e)
SELECT id, exp(s0) / (exp(s0) + exp(s1) + exp(s2)) AS weight_0, exp(s1) / (exp(s0) + exp(s1) + exp(s2)) AS weight_1,
    exp(s2) / (exp(s0) + exp(s1) + exp(s2)) AS weight_2 FROM z""", doubles="weight_0 weight_1 weight_2", ctes="ticks")
def rolling_model_weights(spark, sf):
    df = ticks(spark, sf).select(
        (F.col("user_id") % 3).alias("model"), "t", "id", (F.col("bid") / 100).alias("p"), (F.col("bid") > 20).alias("ok")
    )
    return W.model_weights(df, TICK, "model", "p", "ok", [0, 1, 2]).select("id", "weight_0", "weight_1", "weight_2")


@query("validation_demotions", f"""
WITH m AS (SELECT symbol, hr, close / high AS acc FROM bars), r AS (SELECT symbol, hr, avg(acc) OVER ({BY_BAR} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling,
    row_number() OVER ({BY_BAR}) AS i FROM m), o AS (SELECT *, max(CASE WHEN rolling >= 0.6 THEN i END) OVER ({BY_BAR} ROWS UNBOUNDED PRECEDING) AS ok FROM r),
f AS (SELECT symbol, hr, rolling, CASE WHEN rolling >= 0.6 THEN 0 ELSE i - coalesce(ok, 0) END AS failures FROM o)
SELECT symbol, hr, rolling, failures, failures > 0 AND failures % 3 = 0 AS demote FROM f""", doubles="rolling", ctes="bars")
def validation_demotions(spark, sf):
    df = bars(spark, sf).withColumn("acc", F.col("close") / F.col("high"))
    return W.demotion_flags(df, KEY, BAR, "acc", 0.6).select("symbol", "hr", "rolling", F.col("failures").cast("long").alias("failures"), "demote")


@query("regime_changes", f"""
WITH r AS (SELECT symbol, id, t, CASE WHEN bid < 10 THEN 0 WHEN bid < 40 THEN 1 ELSE 2 END AS regime FROM ticks),
p AS (SELECT *, lag(regime) OVER ({BY_TICK}) AS prev FROM r)
SELECT symbol, id, regime FROM p WHERE prev IS NULL OR prev <> regime""", ctes="ticks")
def regime_changes(spark, sf):
    df = ticks(spark, sf).withColumn("regime", F.when(F.col("bid") < 10, 0).when(F.col("bid") < 40, 1).otherwise(2))
    return W.regime_changes(df, KEY, TICK, "regime").select("symbol", "id", "regime")


@query("rolling_volatility", f"""
WITH {DELTAS}
SELECT symbol, id, stddev_pop(coalesce(d, 0)) OVER ({BY_TICK} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rolling_volatility FROM d""",
    doubles="rolling_volatility", ctes="ticks")
def rolling_volatility(spark, sf):
    return W.rolling_volatility(ticks(spark, sf), KEY, TICK, "bid", 10).select("symbol", "id", "rolling_volatility")


@query("stop_guards", f"""
WITH p AS (SELECT symbol, t, id, bid, CASE WHEN bid > 15 THEN 1.0 ELSE -1.0 END AS pos FROM ticks),
g AS (SELECT *, bid - coalesce(lag(bid) OVER w, bid) AS mv, max(bid) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) - bid AS fall,
    bid - min(bid) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rise FROM p WINDOW w AS ({BY_TICK}))
SELECT symbol, id, CASE WHEN mv >= -5 THEN pos ELSE 0 END AS stop_loss_position,
    CASE WHEN pos > 0 AND fall > 20 THEN 0 WHEN pos < 0 AND rise > 20 THEN 0 ELSE pos END AS trailing_stop_position FROM g""",
    doubles="stop_loss_position trailing_stop_position", ctes="ticks")
def stop_guards(spark, sf):
    df = ticks(spark, sf).withColumn("pos", F.when(F.col("bid") > 15, 1.0).otherwise(-1.0))
    df = W.stop_guards(df, KEY, TICK, "bid", "pos", 5.0, 10, 20.0)
    return df.select("symbol", "id", "stop_loss_position", "trailing_stop_position")


ENCODER = [[0.5, -0.25], [0.25, 0.5], [-0.5, 0.125]]
CENTRES = [[0.0, 0.0], [10.0, -5.0], [-10.0, 5.0]]


@query("tick_encoding", f"""
WITH p AS (SELECT symbol, id, list(bid) OVER ({BY_TICK} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS p FROM ticks),
e AS (SELECT symbol, id, CASE WHEN len(p) = 4 THEN 0.5::DOUBLE * (p[2] - p[1]) + 0.25::DOUBLE * (p[3] - p[2]) - 0.5::DOUBLE * (p[4] - p[3]) ELSE 0 END AS enc_0,
    CASE WHEN len(p) = 4 THEN -0.25::DOUBLE * (p[2] - p[1]) + 0.5::DOUBLE * (p[3] - p[2]) + 0.125::DOUBLE * (p[4] - p[3]) ELSE 0 END AS enc_1 FROM p),
d AS (SELECT *, enc_0 * enc_0 + enc_1 * enc_1 AS d0, (enc_0 - 10) * (enc_0 - 10) + (enc_1 + 5) * (enc_1 + 5) AS d1,
    (enc_0 + 10) * (enc_0 + 10) + (enc_1 - 5) * (enc_1 - 5) AS d2 FROM e)
SELECT symbol, id, enc_0, enc_1, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS centre_id FROM d""",
    doubles="enc_0 enc_1", ctes="ticks")
def tick_encoding(spark, sf):
    df = W.tick_encoding(ticks(spark, sf), KEY, TICK, "bid", ENCODER, CENTRES)
    return df.select("symbol", "id", "enc_0", "enc_1", "centre_id")
