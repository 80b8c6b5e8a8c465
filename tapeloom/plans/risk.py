"""Evaluation, risk, classification and threshold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import scalar as S
from tapeloom.operators import classify as C
from tapeloom.operators import thresholds as TH
from tapeloom.operators import matching as M
from tapeloom.operators import resample as RS
from tapeloom.operators import risk as R
from tapeloom.operators.ordered import drawdown
from tapeloom.operators.quality import net_of_costs
from tapeloom.plans import base
from tapeloom.plans.base import query
from tapeloom.session import pin

MATCH = "trades preds matched"
FEE, BPS = 1.5, 25.0
HIT = "SELECT * FROM matched WHERE is_match"

PROFIT_SQL = """count(*) FILTER (is_match) AS n, coalesce(sum(profit) FILTER (profit >= 0), 0) AS gross_profit, coalesce(-sum(profit) FILTER (profit < 0), 0) AS gross_loss,
    coalesce(-avg(profit) FILTER (profit < 0), 0) AS downside_risk, coalesce(avg(profit), 0) AS expected_return"""


def hits(spark, sf):
    return base.matched(spark, sf).filter("is_match")


def evaluation(spark, sf):
    """The one-row report of matching predictions to trades."""
    matched, trades = base.matched_and_trades(spark, sf)
    won = matched.filter("is_match")
    p = F.col("profit")
    net = net_of_costs(p, FEE, BPS)
    sums = R.grouped(won, [], R.profit_columns(p) | R.ratio_columns(p) | R.ratio_columns(net, "_net") | {
        "expected_return_net": F.coalesce(F.avg(net), F.lit(0.0)), "_annual": R.annual_factor(F.col("close_time"))})
    out = C.confusion(matched, trades)
    scores = M.score_vector(matched, trades)
    for one_row in (
        sums, drawdown(won, [], ["timestamp", "pred_id"], "profit"),
        R.tail_risk(won, [], "profit").select("var_95", "cvar", "es_95"),
        C.auc(scores), C.calibration_error(C.reliability(scores)),
    ):
        out = out.join(F.broadcast(one_row))
    return out.withColumns({
        "sharpe_ratio_annualised": F.col("sharpe_ratio") * F.col("_annual"),
        "sortino_ratio_annualised": F.col("sortino_ratio") * F.col("_annual"),
    }).drop("_annual")


DRAWDOWN = """cum AS (SELECT {k} {o}, sum({v}) OVER ({p} ORDER BY {o} ROWS UNBOUNDED PRECEDING) AS c FROM {src}),
    dd AS (SELECT {k} greatest(max(c) OVER ({p} ORDER BY {o} ROWS UNBOUNDED PRECEDING), 0) - c AS d FROM cum)"""


def drawdown_sql(src, order, value, key=""):
    return DRAWDOWN.format(k=f"{key}, " if key else "", o=order, v=value, p=f"PARTITION BY {key}" if key else "", src=src)


SCORES = """scores AS (SELECT is_match::INT AS y, probability AS p FROM matched WHERE probability IS NOT NULL
    UNION ALL SELECT 1, 0 FROM trades WHERE ticket NOT IN (SELECT ticket FROM matched WHERE is_match)),
    dist AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scores GROUP BY 1),
    ranked AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(neg) OVER (ORDER BY p) - neg AS below FROM dist),
    auc AS (SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS roc_auc, sum(pos * tp / (tp + fp)) / sum(pos) AS pr_auc FROM ranked),
    bins AS (SELECT greatest(0, ceil(p * 10)::INT - 1) AS bin, avg(y) AS prob_true, avg(p) AS prob_pred, count(*) AS n FROM scores GROUP BY 1)"""

TAIL = """srt AS (SELECT profit, row_number() OVER (ORDER BY profit) - 1 AS i, count(*) OVER () AS n, quantile_cont(profit, 0.05) OVER () AS q FROM hit),
    tail AS (SELECT max(profit) FILTER (i = floor(n * 0.05::DOUBLE)) AS var_rank, -max(profit) FILTER (i = floor((n - 1) * 0.05::DOUBLE)) AS var_loss, max(q) AS var_95,
        avg(profit) FILTER (i < ceil(n * 0.05::DOUBLE)) AS cvar, avg(profit) FILTER (profit <= q + 1e-12) AS es_95, max(n) AS n FROM srt)"""

RATIO = """CASE WHEN count(*) > 1 AND stddev_samp({v}) > 0 THEN avg({v}) / stddev_samp({v}) ELSE 0 END AS sharpe_ratio{s},
    CASE WHEN count(*) > 1 AND sqrt(avg({v} * {v}) FILTER ({v} < 0)) > 0 THEN avg({v}) / sqrt(avg({v} * {v}) FILTER ({v} < 0)) ELSE 0 END AS sortino_ratio{s}"""

HITS = f"hit AS (SELECT *, profit - ({FEE} + abs(profit) * {BPS} * 1e-4) AS net FROM matched WHERE is_match)"


@query("evaluation_report", f"""
WITH {HITS}, {SCORES}, {TAIL}, {drawdown_sql("hit", "timestamp, pred_id", "profit")},
s AS (SELECT {PROFIT_SQL}, avg(net) AS expected_return_net, {RATIO.format(v="profit", s="")}, {RATIO.format(v="net", s="_net")},
    sqrt(count(*) / ((max(close_time) - min(close_time)) / (365 * 86400))) AS annual FROM hit),
c AS (SELECT count(*) FILTER (is_match) AS tp, count(*) AS pe, (SELECT count(*) FROM trades) AS ae FROM matched)
SELECT tp AS matched_events, pe AS predicted_events, ae AS actual_events, pe - tp AS fp, ae - tp AS fn, tp / (pe + ae - tp) AS accuracy,
    tp / ae AS recall, tp / pe AS precision, gross_profit, gross_loss, gross_profit / gross_loss AS profit_factor, (gross_profit - gross_loss) / n AS expectancy,
    expected_return, downside_risk, expected_return - downside_risk AS risk_reward, sharpe_ratio, sortino_ratio, sharpe_ratio_net, sortino_ratio_net, expected_return_net,
    (SELECT max(d) FROM dd) AS max_drawdown, var_95, cvar, es_95, roc_auc, pr_auc, (SELECT avg((p - y) * (p - y)) FROM scores) AS brier_score,
    (SELECT sum(abs(prob_true - prob_pred) * n) / sum(n) FROM bins) AS ece, sharpe_ratio * annual AS sharpe_ratio_annualised, sortino_ratio * annual AS sortino_ratio_annualised
FROM s, c, (SELECT var_95, cvar, es_95 FROM tail), auc""", digits=5, ctes=MATCH,
    doubles="accuracy recall precision gross_profit gross_loss profit_factor expectancy expected_return downside_risk risk_reward sharpe_ratio sortino_ratio sharpe_ratio_net sortino_ratio_net expected_return_net max_drawdown var_95 cvar es_95 roc_auc pr_auc brier_score ece sharpe_ratio_annualised sortino_ratio_annualised")
def evaluation_report(spark, sf):
    return evaluation(spark, sf)


@query("profit_factors", f"""
WITH s AS (SELECT symbol, {PROFIT_SQL} FROM matched WHERE is_match GROUP BY 1)
SELECT symbol, gross_profit, gross_loss, gross_profit / nullif(gross_loss, 0) AS profit_factor, (gross_profit - gross_loss) / n AS expectancy, expected_return,
    downside_risk, expected_return - downside_risk AS risk_reward FROM s""", digits=5, ctes=MATCH,
    doubles="gross_profit gross_loss profit_factor expectancy expected_return downside_risk risk_reward")
def profit_factors(spark, sf):
    return R.grouped(hits(spark, sf), ["symbol"], R.profit_columns(F.col("profit")))


@query("match_counts", """
WITH c AS (SELECT count(*) FILTER (is_match) AS tp, count(*) AS pe, (SELECT count(*) FROM trades) AS ae FROM matched)
SELECT tp AS matched_events, pe AS predicted_events, ae AS actual_events, pe - tp AS fp, ae - tp AS fn, tp / (pe + ae - tp) AS accuracy,
    tp / ae AS recall, tp / pe AS precision FROM c""", ctes=MATCH, doubles="accuracy recall precision")
def match_counts(spark, sf):
    return C.confusion(*base.matched_and_trades(spark, sf))


@query("sharpe_sortino", f"""
WITH {HITS}
SELECT symbol, {RATIO.format(v="profit", s="")}, {RATIO.format(v="net", s="_net")} FROM hit GROUP BY 1""", ctes=MATCH,
    doubles="sharpe_ratio sortino_ratio sharpe_ratio_net sortino_ratio_net")
def sharpe_sortino(spark, sf):
    p = F.col("profit")
    return R.grouped(hits(spark, sf), ["symbol"], R.ratio_columns(p) | R.ratio_columns(net_of_costs(p, FEE, BPS), "_net"))


@query("annualised_ratios", f"""
WITH s AS (SELECT symbol, {RATIO.format(v="profit", s="")}, sqrt(count(*) / ((max(close_time) - min(close_time)) / (365 * 86400))) AS f FROM trades GROUP BY 1)
SELECT symbol, sharpe_ratio * f AS sharpe_ratio_annualised, sortino_ratio * f AS sortino_ratio_annualised FROM s""", ctes="trades",
    doubles="sharpe_ratio_annualised sortino_ratio_annualised")
def annualised_ratios(spark, sf):
    s = R.grouped(base.closed_trades(spark, sf), ["symbol"], R.ratio_columns(F.col("profit")) | {"_f": R.annual_factor(F.col("close_time"))})
    return s.select("symbol", *[(F.col(c) * F.col("_f")).alias(f"{c}_annualised") for c in ("sharpe_ratio", "sortino_ratio")])


@query("max_drawdown", f"""
WITH {drawdown_sql("trades", "close_time, ticket", "profit", "symbol")}
SELECT symbol, max(d) AS max_drawdown FROM dd GROUP BY 1""", ctes="trades", doubles="max_drawdown", digits=5)
def max_drawdown(spark, sf):
    return drawdown(base.closed_trades(spark, sf), ["symbol"], ["close_time", "ticket"], "profit")


@query("tail_risk", f"""
WITH hit AS (SELECT profit FROM trades), {TAIL}
SELECT * FROM tail""", ctes="trades", doubles="var_rank var_loss var_95 cvar es_95", digits=5)
def tail_risk(spark, sf):
    return R.tail_risk(base.closed_trades(spark, sf), [], "profit")


@query("tail_risk_by_symbol", """
WITH s AS (SELECT symbol, profit, row_number() OVER (PARTITION BY symbol ORDER BY profit) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM trades)
SELECT symbol, max(profit) FILTER (i = floor(n * 0.05::DOUBLE)) AS var_rank, quantile_cont(profit, 0.05) AS var_95, avg(profit) FILTER (i < ceil(n * 0.05::DOUBLE)) AS cvar FROM s GROUP BY 1""",
    ctes="trades", doubles="var_rank var_95 cvar", digits=5)
def tail_risk_by_symbol(spark, sf):
    return R.tail_risk(base.closed_trades(spark, sf), ["symbol"], "profit").select("symbol", "var_rank", "var_95", "cvar")


@query("volatility_spikes", """
WITH s AS (SELECT event_type AS symbol, avg(value) AS m, stddev_pop(value) AS d FROM events GROUP BY 1)
SELECT symbol, count_if(abs(value - m) > 3 * d) AS volatility_spikes FROM events JOIN s ON symbol = event_type GROUP BY 1""", ints="volatility_spikes")
def volatility_spikes(spark, sf):
    e = base.table(spark, sf, "events").select(F.col("event_type").alias("symbol"), "value")
    return R.volatility_spikes(e, ["symbol"], "value")


@query("budget_compliance", """
SELECT l_returnflag AS strategy, sum(abs(l_extendedprice * (0.05 - l_discount))) / 1000000 AS budget_utilisation,
    avg((lower(trim(l_linestatus)) = 'o')::INT) AS order_type_compliance, avg(l_tax) AS slippage_mean, stddev_pop(l_tax) AS slippage_std FROM lineitem GROUP BY 1""",
    doubles="budget_utilisation order_type_compliance slippage_mean slippage_std")
def budget_compliance(spark, sf):
    li = base.table(spark, sf, "lineitem").withColumn("strategy", F.col("l_returnflag"))
    p = F.col("l_extendedprice") * (0.05 - F.col("l_discount"))
    return R.grouped(li, ["strategy"], R.budget_columns(p, F.col("l_linestatus"), F.col("l_tax"), 1_000_000.0, ["O"]))


def strategies(spark, sf):
    """Return series per strategy: trades by symbol with order types and slippage."""
    t = base.closed_trades(spark, sf)
    return pin(t).select(
        F.col("symbol").alias("strategy"), "close_time", "ticket", "profit",
        F.when(F.col("ticket") % 4 == 0, " Limit ").otherwise("market").alias("order_type"),
        ((F.col("ticket") % 7) / 100.0).alias("slippage"), (F.col("ticket") % 4 == 0).alias("is_limit"))


STRESS = """st AS (SELECT symbol AS strategy, close_time, ticket, profit AS r, ticket % 4 = 0 AS lim, row_number() OVER w - 1 AS i,
        count(*) OVER (PARTITION BY symbol) AS n, stddev_pop(profit) OVER (PARTITION BY symbol) AS s, sum((ticket % 4 = 0)::INT) OVER w AS li,
        sum((ticket % 4 = 0)::INT) OVER (PARTITION BY symbol) AS l FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY close_time, ticket)),
    sc AS (SELECT strategy, 'baseline' AS scenario, close_time, ticket, lim, r AS x, true AS filled FROM st
        UNION ALL SELECT strategy, 'shock', close_time, ticket, lim, CASE WHEN i = 0 THEN r - greatest(3 * s, 0.1::DOUBLE * abs(r), 0.01) ELSE r END, true FROM st
        UNION ALL SELECT strategy, 'volatility_regime', close_time, ticket, lim, CASE WHEN i >= n // 2 THEN CASE WHEN r >= 0 THEN r * 0.5 ELSE r * 1.5 END ELSE r END, true FROM st
        UNION ALL SELECT strategy, 'liquidity_drought', close_time, ticket, lim, CASE WHEN lim AND li <= greatest(1, ceil(l * 0.3::DOUBLE)) THEN 0 WHEN lim THEN r * 0.5 ELSE r END,
            NOT (lim AND li <= greatest(1, ceil(l * 0.3::DOUBLE))) FROM st),
    scum AS (SELECT *, sum(x) OVER w AS c FROM sc WINDOW w AS (PARTITION BY strategy, scenario ORDER BY close_time, ticket ROWS UNBOUNDED PRECEDING)),
    sdd AS (SELECT *, greatest(max(c) OVER w, 0) - c AS d FROM scum WINDOW w AS (PARTITION BY strategy, scenario ORDER BY close_time, ticket ROWS UNBOUNDED PRECEDING)),
    stress AS (SELECT strategy, scenario, sum(x) AS pnl, avg(filled::INT) FILTER (lim) AS limit_fill_rate, max(d) AS max_drawdown FROM sdd GROUP BY 1, 2)"""


@query("stress_scenarios", f"""
WITH {STRESS}
SELECT * FROM stress""", ctes="trades", doubles="pnl limit_fill_rate max_drawdown", digits=5)
def stress_scenarios(spark, sf):
    return R.stress(strategies(spark, sf), ["strategy"], ["close_time", "ticket"], "profit", "is_limit")


@query("stress_summary", f"""
WITH {STRESS}
SELECT strategy, min(pnl) AS stress_pnl_min, max(max_drawdown) AS stress_drawdown_max, min(limit_fill_rate) AS stress_limit_fill_rate_min FROM stress GROUP BY 1""",
    ctes="trades", doubles="stress_pnl_min stress_drawdown_max stress_limit_fill_rate_min", digits=5)
def stress_summary(spark, sf):
    return R.stress_summary(R.stress(strategies(spark, sf), ["strategy"], ["close_time", "ticket"], "profit", "is_limit"), ["strategy"])


@query("risk_card", f"""
WITH {STRESS}, {drawdown_sql("trades", "close_time, ticket", "profit", "symbol")},
card AS (SELECT symbol AS strategy, stddev_samp(profit) AS risk, avg(profit) AS mean_return, {RATIO.format(v="profit", s="")}, sum(abs(profit)) / 50000000 AS budget_utilisation,
    count(*) FILTER (ticket % 4 <> 0) / count(*) AS order_type_compliance, avg((ticket % 7) / 100) AS slippage_mean, stddev_pop((ticket % 7) / 100) AS slippage_std FROM trades GROUP BY 1),
srt AS (SELECT symbol AS strategy, profit, row_number() OVER (PARTITION BY symbol ORDER BY profit) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM trades),
v AS (SELECT strategy, max(profit) FILTER (i = floor(n * 0.05::DOUBLE)) AS var_95 FROM srt GROUP BY 1),
m AS (SELECT symbol AS strategy, max(d) AS max_drawdown FROM dd GROUP BY 1),
k AS (SELECT strategy, count_if(abs(profit - mu) > 3 * sd) AS volatility_spikes FROM (SELECT symbol AS strategy, profit, avg(profit) OVER (PARTITION BY symbol) AS mu, stddev_pop(profit) OVER (PARTITION BY symbol) AS sd FROM trades) GROUP BY 1),
x AS (SELECT strategy, min(pnl) AS stress_pnl_min, max(max_drawdown) AS stress_drawdown_max FROM stress GROUP BY 1)
SELECT strategy, risk, mean_return, sharpe_ratio, sortino_ratio, budget_utilisation, order_type_compliance, slippage_mean, slippage_std, var_95, max_drawdown, volatility_spikes,
    stress_pnl_min, stress_drawdown_max, (max_drawdown > 100000)::INT + (budget_utilisation > 1)::INT + (order_type_compliance < 0.8)::INT AS breaches,
    NOT (max_drawdown > 100000 OR budget_utilisation > 1 OR order_type_compliance < 0.8) AS passed
FROM card JOIN v USING (strategy) JOIN m USING (strategy) JOIN k USING (strategy) JOIN x USING (strategy)""", ctes="trades", digits=5,
    doubles="risk mean_return sharpe_ratio sortino_ratio budget_utilisation order_type_compliance slippage_mean slippage_std var_95 max_drawdown stress_pnl_min stress_drawdown_max", ints="volatility_spikes")
def risk_card(spark, sf):
    c = R.risk_card(strategies(spark, sf), "strategy", ["close_time", "ticket"], "profit", "order_type", "slippage", "is_limit", 50_000_000.0, ["market"],
                    {"max_drawdown": 100000.0, "budget_utilisation": 1.0}, {"order_type_compliance": 0.8})
    return c.withColumn("breaches", F.size("reasons")).drop("reasons", "stress_limit_fill_rate_min")


@query("ranking_metrics", f"""
WITH {SCORES}
SELECT roc_auc, pr_auc, (SELECT avg((p - y) * (p - y)) FROM scores) AS brier_score FROM auc""", ctes=MATCH, doubles="roc_auc pr_auc brier_score")
def ranking_metrics(spark, sf):
    return C.auc(M.score_vector(*base.matched_and_trades(spark, sf)))


@query("leftover_positives", """
SELECT is_match::INT AS y, probability AS p FROM matched UNION ALL SELECT 1, 0 FROM trades WHERE ticket NOT IN (SELECT ticket FROM matched WHERE is_match)""",
    ctes=MATCH, doubles="p")
def leftover_positives(spark, sf):
    return M.score_vector(*base.matched_and_trades(spark, sf))


@query("reliability_curve", f"""
WITH {SCORES}
SELECT bin, prob_true, prob_pred, n FROM bins""", ctes=MATCH, doubles="prob_true prob_pred")
def reliability_curve(spark, sf):
    return C.reliability(M.score_vector(*base.matched_and_trades(spark, sf)))


@query("calibration_error", f"""
WITH {SCORES}
SELECT sum(abs(prob_true - prob_pred) * n) / sum(n) AS ece FROM bins""", ctes=MATCH, doubles="ece")
def calibration_error(spark, sf):
    return C.calibration_error(C.reliability(M.score_vector(*base.matched_and_trades(spark, sf))))


@query("gaussian_nll", """
SELECT avg(0.5::DOUBLE * (ln(2 * pi()) + ln(l_quantity) + (l_tax * 100 - l_discount * 100) ** 2 / l_quantity)) AS neg_log_likelihood,
    avg(l_discount * 100 - sqrt(l_quantity) * 2.0627128075074257::DOUBLE) AS expected_shortfall_pred FROM lineitem""", doubles="neg_log_likelihood expected_shortfall_pred")
def gaussian_nll(spark, sf):
    li = base.table(spark, sf, "lineitem")
    mu, lv = F.col("l_discount") * 100, S.log_variance(F.col("l_quantity"))
    return li.agg(F.avg(S.gaussian_nll(F.col("l_tax") * 100, mu, lv)).alias("neg_log_likelihood"), F.avg(S.predicted_shortfall(mu, lv)).alias("expected_shortfall_pred"))


@query("conformal_coverage", """
WITH b AS (SELECT quantile_cont(probability, 0.05) AS lo, quantile_cont(probability, 0.95) AS hi FROM preds WHERE model = 0)
SELECT any_value(lo) AS conformal_lower, any_value(hi) AS conformal_upper, avg((probability BETWEEN lo AND hi)::INT) AS conformal_coverage FROM preds, b""",
    ctes="trades preds", doubles="conformal_lower conformal_upper conformal_coverage")
def conformal_coverage(spark, sf):
    p = base.predictions(spark, sf)
    return C.conformal_coverage(p, p.filter("model = 0"), "probability")


@query("per_model_counts", """
SELECT model, count(*) AS predictions, count_if(is_match) AS matches FROM matched GROUP BY 1""", ctes=MATCH, ints="matches")
def per_model_counts(spark, sf):
    return C.per_model_counts(base.matched(spark, sf), "model")


THRESHOLDS = """x AS (SELECT timestamp, pred_id, probability AS p, profit AS r, (profit > 0)::INT AS y FROM matched WHERE is_match),
cand AS (SELECT DISTINCT p AS threshold FROM (SELECT p FROM x UNION ALL SELECT unnest([0.0, 0.5, 1.0, 0.333]))),
m AS (SELECT threshold, timestamp, pred_id, CASE WHEN p >= threshold THEN r ELSE 0 END AS r, (p >= threshold)::INT AS taken, y FROM x, cand),
c AS (SELECT *, sum(r) OVER (PARTITION BY threshold ORDER BY timestamp, pred_id ROWS UNBOUNDED PRECEDING) AS cum FROM m),
d AS (SELECT *, greatest(max(cum) OVER (PARTITION BY threshold ORDER BY timestamp, pred_id ROWS UNBOUNDED PRECEDING), 0) - cum AS dd,
    row_number() OVER (PARTITION BY threshold ORDER BY r) - 1 AS i, count(*) OVER (PARTITION BY threshold) AS n FROM c),
tt AS (SELECT threshold, sum(r) AS profit, CASE WHEN stddev_samp(r) > 1e-9 THEN avg(r) / stddev_samp(r) ELSE 0 END AS sharpe_ratio,
    coalesce(avg(r) / sqrt(avg(r * r) FILTER (r < 0)), 0) AS sortino_ratio, avg((taken = y)::INT) AS accuracy, count_if(r <> 0) > 0 AS active, max(dd) AS max_drawdown,
    max(r) FILTER (i = floor(n * 0.05::DOUBLE)) AS var_95 FROM d GROUP BY 1)"""


@query("threshold_table", f"""
WITH {THRESHOLDS}
SELECT threshold, profit, sharpe_ratio, sortino_ratio, accuracy, active, max_drawdown, var_95 FROM tt""", ctes=MATCH,
    doubles="threshold profit sharpe_ratio sortino_ratio accuracy max_drawdown var_95", digits=5)
def threshold_table(spark, sf):
    return thresholds(spark, sf)


def thresholds(spark, sf):
    x = hits(spark, sf).select("timestamp", "pred_id", "probability", "profit", (F.col("profit") > 0).cast("int").alias("y"))
    return TH.threshold_table(x, TH.threshold_candidates(x, "probability", [0.333]), ["timestamp", "pred_id"], "y", "probability", "profit")


FINE_THRESHOLDS = THRESHOLDS.replace("probability AS p", "probability * 0.9::DOUBLE + (pred_id % 1009) / 10090.0::DOUBLE AS p")


@query("threshold_table_fine", f"""
WITH {FINE_THRESHOLDS}
SELECT threshold, profit, sharpe_ratio, sortino_ratio, accuracy, active, max_drawdown, var_95 FROM tt""", ctes=MATCH,
    doubles="threshold profit sharpe_ratio sortino_ratio accuracy max_drawdown var_95", digits=5)
def threshold_table_fine(spark, sf):
    """Scores of which nearly every row has its own, each of them a threshold."""
    fine = F.col("probability") * 0.9 + (F.col("pred_id") % 1009) / 10090.0
    x = hits(spark, sf).select("timestamp", "pred_id", fine.alias("p"), "profit", (F.col("profit") > 0).cast("int").alias("y"))
    return TH.threshold_table(x, TH.threshold_candidates(x, "p", [0.333]), ["timestamp", "pred_id"], "y", "p", "profit")


@query("best_threshold", f"""
WITH {THRESHOLDS}
SELECT threshold, sharpe_ratio, max_drawdown FROM tt WHERE active AND max_drawdown <= 400000 ORDER BY sharpe_ratio DESC, threshold LIMIT 1""", ctes=MATCH,
    doubles="threshold sharpe_ratio max_drawdown", digits=5)
def best_threshold(spark, sf):
    return TH.best_threshold(thresholds(spark, sf), "sharpe_ratio", 400000.0).select("threshold", "sharpe_ratio", "max_drawdown")


BOOTSTRAP_CUTS = " + ".join(f"(z >= {c})::INT" for c in RS.CUTS)


@query("bootstrap_intervals", f"""
WITH x AS (SELECT timestamp, pred_id, probability AS p, profit AS r, (profit > 0)::INT AS y, ('0x' || substr(md5(pred_id::VARCHAR), 1, 8))::BIGINT % {RS.PRIME} AS a FROM matched WHERE is_match),
reps AS (SELECT b, ('0x' || substr(md5('0:' || b), 1, 8))::BIGINT % {RS.PRIME - 1} + 1 AS k FROM range(1000) t(b)),
z AS (SELECT x.*, b, a * k % {RS.PRIME} AS z FROM x, reps),
w AS (SELECT *, {BOOTSTRAP_CUTS} AS w FROM z),
d AS (SELECT *, w * r AS wr FROM w WHERE w > 0),
sums AS (SELECT b, sum(w) AS n, sum(w * ((p >= 0.5)::INT = y)::INT) / sum(w) AS accuracy, sum(w * (p - y) ** 2) / sum(w) AS brier_score, sum(wr) AS s, sum(wr * r) AS q,
    coalesce(sum(wr * r) FILTER (r < 0), 0) AS dq, coalesce(sum(w) FILTER (r < 0), 0) AS dn FROM d GROUP BY 1),
runs AS (SELECT b, sum(wr) OVER (PARTITION BY b ORDER BY timestamp, pred_id ROWS UNBOUNDED PRECEDING) AS cum, timestamp, pred_id FROM d),
falls AS (SELECT b, max(fall) AS max_drawdown FROM (SELECT b, greatest(0, max(cum) OVER (PARTITION BY b ORDER BY timestamp, pred_id ROWS UNBOUNDED PRECEDING)) - cum AS fall FROM runs) GROUP BY 1),
g AS (SELECT b, p, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM d GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER (PARTITION BY b) AS ap, sum(neg) OVER (PARTITION BY b) AS an FROM g WINDOW o AS (PARTITION BY b ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
areas AS (SELECT b, sum(pos * (an - fp + neg / 2.0::DOUBLE)) / any_value(ap * an) AS roc_auc, sum(pos * tp / (tp + fp)) / any_value(ap) AS pr_auc FROM c WHERE ap > 0 AND an > 0 GROUP BY 1),
v AS (SELECT b, r, sum(w) OVER (PARTITION BY b ORDER BY r, pred_id ROWS UNBOUNDED PRECEDING) AS upto, floor(sum(w) OVER (PARTITION BY b) * 0.05::DOUBLE) AS place FROM d),
risk AS (SELECT b, min(r) AS var_95 FROM v WHERE upto > place GROUP BY 1),
per AS (SELECT accuracy, roc_auc, pr_auc, brier_score, (s / n) / sqrt((q - s * s / n) / (n - 1)) AS sharpe_ratio, (s / n) / sqrt(dq / dn) AS sortino_ratio, max_drawdown, var_95, s AS profit, s / n AS mean_return
    FROM sums LEFT JOIN falls USING (b) LEFT JOIN areas USING (b) LEFT JOIN risk USING (b)),
long AS (UNPIVOT per ON * INTO NAME metric VALUE v)
SELECT metric, avg(v) AS mean, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM long GROUP BY 1""", ctes=MATCH, doubles="mean low high", digits=4)
def bootstrap_intervals(spark, sf):
    x = hits(spark, sf).withColumn("y", (F.col("profit") > 0).cast("int"))
    return RS.bootstrap(x, "pred_id", "y", "probability", "profit", order=["timestamp", "pred_id"])


def model_table(spark, sf):
    """Candidate models: one per part brand with return, risk and drift figures."""
    li = base.table(spark, sf, "lineitem").join(base.table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    r = F.col("l_quantity") * (0.05 - F.col("l_discount"))
    return li.groupBy(F.col("p_brand").alias("model")).agg(
        F.round(F.avg(r), 6).alias("expected_return"), F.round(F.stddev_pop(r), 6).alias("downside_risk"), F.round(F.avg("l_tax") * 4, 6).alias("drift_psi"),
        F.round(F.avg("l_discount") / F.stddev_pop("l_discount"), 6).alias("sharpe_ratio"), F.count(F.lit(1)).alias("max_drawdown"))


MODELS = """models AS (SELECT p_brand AS model, round(avg(l_quantity * (0.05::DOUBLE - l_discount)), 6) AS expected_return, round(stddev_pop(l_quantity * (0.05::DOUBLE - l_discount)), 6) AS downside_risk,
    round(avg(l_tax) * 4, 6) AS drift_psi, round(avg(l_discount) / stddev_pop(l_discount), 6) AS sharpe_ratio, count(*) AS max_drawdown FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)"""


@query("best_models", f"""
WITH {MODELS}
SELECT model, sharpe_ratio AS score FROM models WHERE drift_psi <= 0.17 ORDER BY score DESC, model LIMIT 5""", doubles="score")
def best_models(spark, sf):
    return R.promote_best(model_table(spark, sf), "sharpe", 5, max_drift=0.17).select("model", "score")


@query("best_models_by_risk_reward", f"""
WITH {MODELS}
SELECT model, expected_return - downside_risk AS score FROM models WHERE drift_psi <= 0.2 ORDER BY score DESC, model LIMIT 5""", doubles="score")
def best_models_by_risk_reward(spark, sf):
    return R.promote_best(model_table(spark, sf), "risk_reward", 5).select("model", "score")


@query("pareto_front", f"""
WITH {MODELS}
SELECT model, expected_return, downside_risk FROM models a WHERE NOT EXISTS (SELECT 1 FROM models b WHERE b.expected_return >= a.expected_return
    AND b.downside_risk <= a.downside_risk AND (b.expected_return > a.expected_return OR b.downside_risk < a.downside_risk))""", doubles="expected_return downside_risk")
def pareto_front(spark, sf):
    return R.pareto_front(model_table(spark, sf), "expected_return", "downside_risk").select("model", "expected_return", "downside_risk")
