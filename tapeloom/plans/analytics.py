"""Drift, anomaly, graph and model queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tapeloom.functions import scoring as SC
from tapeloom.operators import drift as D
from tapeloom.operators import forest as FO
from tapeloom.operators import graph as G
from tapeloom.operators import joins as J
from tapeloom.operators import models as M
from tapeloom.operators import spectral as SP
from tapeloom.operators import windows as W
from tapeloom.operators.forest import EULER, path_norm
from tapeloom.operators.resample import PRIME
from tapeloom.plans.base import SYMBOLS, bars, query, table, ticks
from tapeloom.plans.joins import EDGES

COLS = ["value", "user_id"]


def halves(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user_id"), "ts")
    early = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return e.filter(early), e.filter(~early)


HALVES = """b AS (SELECT 'value' AS feature, value AS v FROM events WHERE ts < TIMESTAMP '2024-01-16' UNION ALL SELECT 'user_id', user_id FROM events WHERE ts < TIMESTAMP '2024-01-16'),
r AS (SELECT 'value' AS feature, value AS v FROM events WHERE ts >= TIMESTAMP '2024-01-16' UNION ALL SELECT 'user_id', user_id FROM events WHERE ts >= TIMESTAMP '2024-01-16')"""
PSI = f"""{HALVES}, c AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS cuts FROM b GROUP BY 1),
xb AS (SELECT feature, least(len(list_filter(cuts, lambda k: k <= v)), len(cuts) - 1) AS bin, v >= cuts[1] AND v <= cuts[-1] AS ok FROM b JOIN c USING (feature)),
xr AS (SELECT feature, least(len(list_filter(cuts, lambda k: k <= v)), len(cuts) - 1) AS bin, v >= cuts[1] AND v <= cuts[-1] AS ok FROM r JOIN c USING (feature)),
pb AS (SELECT feature, bin, count_if(ok) / (SELECT count(*) FROM b WHERE b.feature = xb.feature) AS e FROM xb GROUP BY 1, 2),
pr AS (SELECT feature, bin, count_if(ok) / (SELECT count(*) FROM r WHERE r.feature = xr.feature) AS a FROM xr WHERE ok GROUP BY 1, 2),
psi AS (SELECT feature, sum((coalesce(e, 0) - coalesce(a, 0)) * ln((coalesce(e, 0) + 1e-6) / (coalesce(a, 0) + 1e-6))) AS psi FROM pb FULL JOIN pr USING (feature, bin) GROUP BY 1)"""
KS = """u AS (SELECT feature, v, sum(x) AS e, sum(1 - x) AS a FROM (SELECT *, 1 AS x FROM b UNION ALL SELECT *, 0 FROM r) GROUP BY 1, 2),
ks AS (SELECT feature, max(abs(ce / ne - ca / na)) AS ks FROM (SELECT feature, sum(e) OVER w AS ce, sum(a) OVER w AS ca, sum(e) OVER (PARTITION BY feature) AS ne, sum(a) OVER (PARTITION BY feature) AS na FROM u
    WINDOW w AS (PARTITION BY feature ORDER BY v)) GROUP BY 1)"""


@query("population_stability", f"""
WITH {PSI}
SELECT feature, psi FROM psi""", doubles="psi")
def population_stability(spark, sf):
    return D.psi(*halves(spark, sf), COLS)


@query("kolmogorov_smirnov", f"""
WITH {HALVES}, {KS}
SELECT feature, ks FROM ks""", doubles="ks")
def kolmogorov_smirnov(spark, sf):
    return D.ks(*halves(spark, sf), COLS)


@query("drift_decision", f"""
WITH {PSI}, {KS}
SELECT avg(psi) AS psi, avg(ks) AS ks, greatest(avg(psi), avg(ks)) > 0.02 AS drift FROM psi JOIN ks USING (feature)""", doubles="psi ks")
def drift_decision(spark, sf):
    return D.drift_report(*halves(spark, sf), COLS, 0.02)


PH = """s AS (SELECT symbol, t, id, bid AS v, row_number() OVER (PARTITION BY symbol ORDER BY t, id) AS i FROM ticks)"""


@query("page_hinkley", f"""
WITH RECURSIVE {PH},
k AS (SELECT DISTINCT symbol, 0::BIGINT AS i, -1::BIGINT AS id, 0::DOUBLE AS v, 0::DOUBLE AS n, 0::DOUBLE AS m, 0::DOUBLE AS c, 0::DOUBLE AS lo, false AS hit FROM s
UNION ALL SELECT symbol, i, id, v, CASE WHEN h THEN 0 ELSE n END, CASE WHEN h THEN 0 ELSE m END, CASE WHEN h THEN 0 ELSE c END, CASE WHEN h THEN 0 ELSE lo END, h FROM (
    SELECT *, n >= 30 AND c - lo > 400 AS h FROM (SELECT symbol, i, id, v, n, m, c2 AS c, least(lo, c2) AS lo FROM (SELECT *, c + v - m - 0.005::DOUBLE AS c2 FROM (
        SELECT s.symbol, s.i, s.id, s.v, k.n + 1 AS n, k.m + (s.v - k.m) / (k.n + 1) AS m, k.c, k.lo FROM k JOIN s ON s.symbol = k.symbol AND s.i = k.i + 1)))))
SELECT symbol, id FROM k WHERE hit""", ctes="ticks")
def page_hinkley(spark, sf):
    return D.change_alarms(ticks(spark, sf), ["symbol"], ["t", "id"], "bid", "page_hinkley", threshold=400.0).select("symbol", "id")


@query("cusum", f"""
WITH RECURSIVE {PH},
k AS (SELECT DISTINCT symbol, 0::BIGINT AS i, -1::BIGINT AS id, 0::DOUBLE AS v, 0::DOUBLE AS n, 0::DOUBLE AS m, 0::DOUBLE AS up, 0::DOUBLE AS dn, false AS hit FROM s
UNION ALL SELECT symbol, i, id, v, CASE WHEN h THEN 0 ELSE n END, CASE WHEN h THEN 0 ELSE m END, CASE WHEN h THEN 0 ELSE up END, CASE WHEN h THEN 0 ELSE dn END, h FROM (
    SELECT *, up > 150 OR -dn > 150 AS h FROM (SELECT symbol, i, id, v, n, m, greatest(0, up + v - m - 0.5) AS up, least(0, dn + v - m + 0.5) AS dn FROM (
        SELECT s.symbol, s.i, s.id, s.v, k.n + 1 AS n, k.m + (s.v - k.m) / (k.n + 1) AS m, k.up, k.dn FROM k JOIN s ON s.symbol = k.symbol AND s.i = k.i + 1))))
SELECT symbol, id FROM k WHERE hit""", ctes="ticks")
def cusum(spark, sf):
    return D.change_alarms(ticks(spark, sf), ["symbol"], ["t", "id"], "bid", "cusum", threshold=150.0, drift=0.5).select("symbol", "id")


def forest_sql(rows: str, names: list[str], sample: int = 256, depth: int = 8, trees: int = 100) -> str:
    """Isolation trees replayed: ``rows`` is a query of event_id and x0, x1, ... to grow from; makes the tables
    ``c0`` to ``c8`` of nodes per level and needs ``scored_rows`` to make ``paths`` (event_id, mean length)."""
    def uniform(use):
        return f"('0x' || substr(md5('0:' || tree || ':' || node || ':{use}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"

    many = len(names)
    opens = " + ".join(f"(h{i} > l{i})::INT" for i in range(many))
    listed = "list_filter([" + ", ".join(f"CASE WHEN h{i} > l{i} THEN {i} ELSE -1 END" for i in range(many)) + "], lambda i: i >= 0)"
    pick = lambda what: "CASE col " + " ".join(f"WHEN {i} THEN {what}{i}" for i in range(many)) + " END"
    xs = ", ".join(f"x{i}" for i in range(many))
    parts = [f"""grow_from AS (SELECT *, ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % {PRIME} AS a FROM ({rows})),
tree_factors AS (SELECT b AS tree, ('0x' || substr(md5('0:' || b), 1, 8))::BIGINT % {PRIME - 1} + 1 AS k FROM range({trees}) t(b)),
s0 AS MATERIALIZED (SELECT tree, 1 AS node, {xs} FROM grow_from, tree_factors QUALIFY row_number() OVER (PARTITION BY tree ORDER BY a * k % {PRIME}, event_id) <= {sample})"""]
    paths = []
    parts.append(f"q0 AS MATERIALIZED (SELECT event_id, tree, 1 AS node, {xs} FROM scored_rows, tree_factors)")
    for d in range(depth + 1):
        ranges = ", ".join(f"min(x{i}) AS l{i}, max(x{i}) AS h{i}" for i in range(many))
        column = f"CASE WHEN n > 1 AND {opens} > 0 THEN {listed}[floor({uniform('column')} * ({opens}))::INT + 1] ELSE -1 END" if d < depth else "-1"
        parts.append(f"g{d} AS (SELECT tree, node, count(*) AS n, {ranges} FROM s{d} GROUP BY 1, 2)")
        parts.append(f"k{d} AS (SELECT *, {column} AS col FROM g{d})")
        parts.append(f"m{d} AS (SELECT *, {pick('l')} + {uniform('cut')} * ({pick('h')} - {pick('l')}) AS cut, {pick('l')} AS low FROM k{d})")
        parts.append(f"c{d} AS MATERIALIZED (SELECT tree, node, CASE WHEN cut > low THEN col ELSE -1 END AS col, cut, {d} + CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1 ELSE 2 * (ln(n - 1) + {EULER}) - 2 * (n - 1) / n::DOUBLE END AS length FROM m{d})")
        paths.append(f"SELECT event_id, length FROM q{d} JOIN c{d} USING (tree, node) WHERE col < 0")
        if d < depth:
            for name, key in (("s", ""), ("q", "event_id, ")):
                parts.append(f"{name}{d + 1} AS MATERIALIZED (SELECT {key}tree, 2 * node + CASE WHEN {pick('x')} < cut THEN 0 ELSE 1 END AS node, {xs} FROM {name}{d} JOIN c{d} USING (tree, node) WHERE col >= 0)")
    parts.append("paths AS (SELECT event_id, sum(length) / 100 AS length FROM (" + " UNION ALL ".join(paths) + ") GROUP BY 1)")
    return ",\n".join(parts)


@query("isolation_forest", f"""
WITH scored_rows AS (SELECT event_id, value AS x0, user_id::DOUBLE AS x1 FROM events),
{forest_sql("SELECT event_id, value AS x0, user_id::DOUBLE AS x1 FROM events", COLS)}
SELECT event_id, value, user_id::DOUBLE AS user_id, pow(2, -length / {path_norm(256)}) AS anomaly_score FROM events JOIN paths USING (event_id)""", doubles="anomaly_score")
def isolation_forest(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user_id"))
    return FO.score_forest(e, COLS, FO.fit_forest(e, COLS, "event_id"))


def _drift_sql(column: str) -> str:
    early = "ts < TIMESTAMP '2024-01-16'"
    return f"""SELECT '{column}' AS feature, drift FROM (WITH scored_rows AS (SELECT event_id, {column}::DOUBLE AS x0 FROM events WHERE NOT {early}),
{forest_sql(f"SELECT event_id, {column}::DOUBLE AS x0 FROM events WHERE {early}", ["x0"])}
SELECT avg((pow(2, -length / {path_norm(256)}) > 0.5)::INT) AS drift FROM paths)"""


@query("isolation_drift", " UNION ALL ".join(map(_drift_sql, COLS)), doubles="drift")
def isolation_drift(spark, sf):
    return FO.forest_drift(*halves(spark, sf), COLS, "event_id")


# --- graph ----------------------------------------------------------------------------------

EDGE_SQL = """e(src, dst) AS (VALUES ('click', 'view'), ('click', 'error'), ('purchase', 'signup')),
pp AS (SELECT a.symbol AS a, b.symbol AS b, a.hr, a.close AS x, b.close AS y FROM bars a JOIN e ON e.src = a.symbol JOIN bars b ON b.symbol = e.dst AND b.hr = a.hr)"""


def pairs(spark, sf):
    return J.graph_pairs(bars(spark, sf), spark.createDataFrame(EDGES, "src string, dst string"), "hr", "close")


CORR_EDGES = f"""{EDGE_SQL}, rc AS (SELECT a, b, CASE WHEN count(*) OVER f >= 20 AND var_pop(x) OVER f > 1e-18 AND var_pop(y) OVER f > 1e-18
    THEN covar_pop(x, y) OVER f / sqrt((var_pop(x) OVER f) * (var_pop(y) OVER f)) END AS rho FROM pp WINDOW f AS (PARTITION BY a, b ORDER BY hr ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
w AS (SELECT a, b, avg(abs(rho)) AS weight FROM rc GROUP BY 1, 2 HAVING avg(abs(rho)) IS NOT NULL),
edges AS (SELECT a AS src, b AS dst, weight FROM w UNION ALL SELECT b, a, weight FROM w)"""


def corr_edges(spark, sf):
    return G.correlation_edges(pairs(spark, sf), "hr", 20)


def vertices(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("id")).distinct()


@query("correlation_edges", f"""
WITH {CORR_EDGES}
SELECT src, dst, weight FROM edges""", ctes="bars", doubles="weight")
def correlation_edges(spark, sf):
    return corr_edges(spark, sf)


@query("pair_regression", f"""
WITH {EDGE_SQL}
SELECT a, b, regr_slope(x, y) AS beta, regr_slope(y, x) AS beta_rev, count(*) AS n FROM pp GROUP BY 1, 2""", ctes="bars", doubles="beta beta_rev")
def pair_regression(spark, sf):
    return G.pair_regression(pairs(spark, sf))


@query("pair_residual", f"""
WITH {EDGE_SQL}, g AS (SELECT a, b, regr_slope(x, y) AS beta FROM pp GROUP BY 1, 2)
SELECT a, b, hr, x - beta * y AS residual FROM pp JOIN g USING (a, b)""", ctes="bars", doubles="residual")
def pair_residual(spark, sf):
    p = pairs(spark, sf)
    return G.pair_residual(p, G.pair_regression(p)).select("a", "b", "hr", "residual")


@query("weighted_degree", f"""
WITH {CORR_EDGES}
SELECT event_type AS id, coalesce(d, 0) AS degree, v AS avg_volume FROM (SELECT event_type FROM events GROUP BY 1) LEFT JOIN (SELECT src, sum(weight) AS d FROM edges GROUP BY 1) ON src = event_type
    JOIN (SELECT symbol, avg(volume) AS v FROM bars GROUP BY 1) ON symbol = event_type""", ctes="bars", doubles="degree avg_volume")
def weighted_degree(spark, sf):
    v = G.average_volume(bars(spark, sf), "symbol", "volume").withColumnRenamed("symbol", "id")
    return G.weighted_degree(vertices(spark, sf), corr_edges(spark, sf)).join(v, "id")


@query("pagerank", """
WITH RECURSIVE v AS (SELECT s_suppkey AS id, (SELECT count(*) FROM supplier) AS n FROM supplier),
ed AS (SELECT l_suppkey AS src, (l_partkey % (SELECT count(*) FROM supplier)) + (SELECT min(s_suppkey) FROM supplier) AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
sh AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM ed),
r AS (SELECT id, 0 AS step, 1.0::DOUBLE / n AS rank FROM v UNION ALL
    SELECT v.id, x.step + 1, 0.15 / v.n + 0.85 * coalesce(x.got, 0) FROM v JOIN (SELECT g.id, max(g.step) AS step, sum(g.got) AS got FROM (
        SELECT sh.dst AS id, r.step, r.rank * sh.share AS got FROM r JOIN sh ON sh.src = r.id UNION ALL SELECT r.id, r.step, 0 FROM r) g GROUP BY 1) x ON x.id = v.id WHERE x.step < 40)
SELECT id, rank FROM r WHERE step = 40""", doubles="rank", digits=5)
def pagerank(spark, sf):
    n, lo = table(spark, sf, "supplier").agg(F.count(F.lit(1)), F.min("s_suppkey")).first()
    edges = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("src"), ((F.col("l_partkey") % n) + lo).alias("dst")).agg(F.sum("l_quantity").alias("weight"))
    return G.pagerank(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), edges, tol=1e-7, max_iter=100)


@query("spectral_embedding")
def spectral_embedding(spark, sf):
    return G.spectral_embedding(corr_edges(spark, sf), vertices(spark, sf), 4)


@query("correlation_matrix", """
WITH v AS (SELECT l_quantity AS q, l_extendedprice AS p, l_tax AS t FROM lineitem),
c AS (SELECT 'l_quantity' AS a, 'l_quantity' AS b, covar_samp(q, q) AS covariance, corr(q, q) AS correlation FROM v UNION ALL SELECT 'l_quantity', 'l_extendedprice', covar_samp(q, p), corr(q, p) FROM v
UNION ALL SELECT 'l_quantity', 'l_tax', covar_samp(q, t), corr(q, t) FROM v UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', covar_samp(p, p), corr(p, p) FROM v
UNION ALL SELECT 'l_extendedprice', 'l_tax', covar_samp(p, t), corr(p, t) FROM v UNION ALL SELECT 'l_tax', 'l_tax', covar_samp(t, t), corr(t, t) FROM v)
SELECT a, b, covariance, correlation FROM c UNION ALL SELECT b, a, covariance, correlation FROM c WHERE a <> b""", doubles="covariance correlation", digits=3)
def correlation_matrix(spark, sf):
    return G.correlation_matrix(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


# --- spectral features ----------------------------------------------------------------------


@query("wavelet_statistics")
def wavelet_statistics(spark, sf):
    return SP.wavelet_statistics(ticks(spark, sf), ["symbol"], ["t", "id"], "bid", windows=(16, 32)).drop("ask", "user_id")


@query("cross_spectrum")
def cross_spectrum(spark, sf):
    return SP.cross_spectrum(bars(spark, sf), "hr", EDGES, "close")


# --- models ---------------------------------------------------------------------------------

FEATS = ["bid", "volume", "spread"]


def training_rows(spark, sf):
    t = ticks(spark, sf)
    return t.select(
        "symbol", "t", "id", "bid", F.col("user_id").cast("double").alias("volume"), (F.col("bid") * 0.01 + F.col("id") % 7).alias("spread"),
        (F.col("bid") + F.col("id") % 11 > 22).cast("int").alias("label"), (F.col("bid") - 20.0).alias("profit"), (F.lit(0.5) + F.col("id") % 4).alias("weight"))


@query("logistic_fold_fits")
def logistic_fold_fits(spark, sf):
    return M.fold_fits(training_rows(spark, sf), ["t", "id"], FEATS, "label", "weight", "logreg", n_splits=3, C=1.0)


@query("logistic_optimum", """
SELECT count(*)::BIGINT AS rows, sum(0.5 + id % 4) AS weight, 0.0 AS bias_slope, 0.0 AS slope_0, 0.0 AS slope_1 FROM ticks""", ctes="ticks", doubles="weight bias_slope slope_0 slope_1", digits=4)
def logistic_optimum(spark, sf):
    """The gradient of the penalised weighted loss at the fitted coefficients, which must be zero."""
    rows = training_rows(spark, sf)
    fitted = M.fit_classifier(rows, "logreg", FEATS[:2], "label", "weight", C=0.001, tol=1e-12, maxIter=500)
    model, scored = fitted.stages[-1], M.positive_probability(fitted.transform(rows))
    miss = F.col("weight") * (F.col("p") - F.col("label"))
    x = vector_to_array("features")
    found = scored.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("weight"), (F.sum(miss) / F.sum("weight")).alias("bias_slope"),
        *[((F.sum(miss * x[i]) + float(model.coefficients[i]) / 0.001) / F.sum("weight")).alias(f"slope_{i}") for i in range(2)])
    return found


@query("isotonic_fit")
def isotonic_fit(spark, sf):
    scored = M.fold_fits(training_rows(spark, sf), ["t", "id"], FEATS, "label", None, "logreg", n_splits=2)
    cal = M.isotonic_calibration(scored)
    return scored.select("id", "p", SC.calibrated(F.lit(0.0), F.col("p"), cal).alias("calibrated"))


@query("voting_ensemble")
def voting_ensemble(spark, sf):
    rows = training_rows(spark, sf)
    fitted = {n: M.fit_classifier(rows, n, FEATS, "label", "weight") for n in ("logreg", "gradient_boosting")}
    return M.voting_probability(rows, fitted, {"logreg": 1.0, "gradient_boosting": 2.0}).select("id", "label", "p")


@query("regime_clusters")
def regime_clusters(spark, sf):
    assigned, _ = M.regimes(training_rows(spark, sf), FEATS, 3)
    gate = M.regime_gate(assigned, FEATS)
    return gate.transform(assigned).select("id", "regime", F.col("gate").cast("int").alias("gate"))


@query("linear_autoencoder")
def linear_autoencoder(spark, sf):
    rows = training_rows(spark, sf)
    m = M.linear_autoencoder(rows, FEATS, 2)
    return rows.select("id", SC.reconstruction_error([F.col(f).cast("double") for f in FEATS], m["mean"], m["components"]).alias("error"))


@query("fold_ood")
def fold_ood(spark, sf):
    return M.fold_ood(training_rows(spark, sf), ["t", "id"], FEATS, 3)


TRAINING = """t AS (SELECT id, bid, user_id::DOUBLE AS volume, bid * 0.01 + id % 7 AS spread, (bid + id % 11 > 22)::INT AS label FROM ticks)"""


@query("variance_inflation", f"""
WITH {TRAINING}, c AS (SELECT corr(bid, volume) AS ab, corr(bid, spread) AS ac, corr(volume, spread) AS bc FROM t),
d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM c)
SELECT 'bid' AS feature, (1 - bc * bc) / det AS vif FROM d UNION ALL SELECT 'volume', (1 - ac * ac) / det FROM d UNION ALL SELECT 'spread', (1 - ab * ab) / det FROM d""",
    ctes="ticks", doubles="vif", digits=4)
def variance_inflation(spark, sf):
    return M.vif(training_rows(spark, sf), FEATS)


@query("mutual_information", f"""
WITH {TRAINING}, c AS (UNPIVOT (SELECT label, bid, volume, spread FROM t) ON bid, volume, spread INTO NAME feature VALUE value),
q AS (SELECT feature, list_distinct(quantile_cont(value, [{", ".join(f"{i / 16}" for i in range(1, 16))}])) AS cuts FROM c GROUP BY 1),
b AS (SELECT feature, label, len(list_filter(cuts, lambda x: x <= value)) AS bin FROM c JOIN q USING (feature)),
j AS (SELECT feature, bin, label, count(*) AS n FROM b GROUP BY 1, 2, 3),
m AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS total, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, label) AS nl FROM j)
SELECT feature, sum(n / total * ln(n * total / (nb * nl))) AS mutual_information FROM m GROUP BY 1""", ctes="ticks", doubles="mutual_information", digits=4)
def mutual_information(spark, sf):
    return M.mutual_information(training_rows(spark, sf), FEATS, "label")


@query("prune_correlated")
def prune_correlated(spark, sf):
    rows = training_rows(spark, sf).withColumn("ask", F.col("bid") * 1.0002)
    return M.prune_correlated(rows, [*FEATS, "ask"], "label")


@query("risk_parity")
def risk_parity(spark, sf):
    wide = W.wide_by_symbol(bars(spark, sf), "hr", SYMBOLS, "close")
    for s in SYMBOLS:
        wide = W.simple_return(wide, [], ["hr"], s, f"ret_{s}")
    returns = wide.select(*[F.col(f"ret_{s}").alias(s) for s in SYMBOLS])
    return M.risk_parity(returns, list(SYMBOLS))


@query("linear_attribution", """
WITH s AS (SELECT 'bid' AS feature, stddev_pop(bid) * 0.4 AS importance, avg(abs(bid * 0.4)) AS integrated_gradient FROM ticks UNION ALL SELECT 'user_id', stddev_pop(user_id) * 0.7, avg(abs(user_id * 0.7)) FROM ticks)
SELECT * FROM s""", ctes="ticks", doubles="importance integrated_gradient")
def linear_attribution(spark, sf):
    return M.linear_attribution(ticks(spark, sf), {"bid": 0.4, "user_id": -0.7})


@query("partial_dependence", """
SELECT 'bid' AS feature, g AS value, avg(1 / (1 + exp(-(0.4 * g / 30 - 0.7 * user_id / 43)))) AS average FROM ticks, (SELECT unnest([5.0, 20.0, 80.0]::DOUBLE[]) AS g) GROUP BY g""", ctes="ticks", doubles="average")
def partial_dependence(spark, sf):
    return M.partial_dependence(ticks(spark, sf), "bid", [5.0, 20.0, 80.0], lambda x: SC.sigmoid(x * (0.4 / 30) - F.col("user_id") * (0.7 / 43)))


@query("permutation_importance")
def permutation_importance(spark, sf):
    score = lambda c: SC.sigmoid((c["bid"] - 20.0) * 0.3 + c["spread"] * 0.01)
    return M.permutation_importance(training_rows(spark, sf), "id", FEATS, "label", score)


def _plane(rows, y, name):
    """Least squares of ``y`` on volume and spread from the moments of ``rows``."""
    return f"""{name} AS (SELECT my - b1 * mx - b2 * mz AS b0, b1, b2 FROM (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM (
    SELECT avg(volume) AS mx, avg(spread) AS mz, avg({y}) AS my, var_pop(volume) AS xx, var_pop(spread) AS zz, covar_pop(volume, spread) AS xz, covar_pop(volume, {y}) AS xy, covar_pop(spread, {y}) AS zy FROM {rows})))"""


@query("heteroscedastic_fit", f"""
WITH {TRAINING}, {_plane("t", "bid - 20", "a")},
r AS (SELECT id, volume, spread, b0 + b1 * volume + b2 * spread AS mean, ln(pow(bid - 20 - (b0 + b1 * volume + b2 * spread), 2) + 1e-6) AS lr FROM t, a), {_plane("r", "lr", "v")}
SELECT id, mean, b0 + b1 * volume + b2 * spread AS log_variance FROM r, v""", ctes="ticks", doubles="mean log_variance", digits=4)
def heteroscedastic_fit(spark, sf):
    return M.heteroscedastic(training_rows(spark, sf), ["volume", "spread"], "profit").select("id", "mean", "log_variance")


# At the optimum the rows below the fit and above it pull equally hard: the mean of (q - below) times each
# feature lies within the few rows on the fit, which make up what is rounded away.
@query("quantile_fit", """
SELECT q AS quantile, true AS balanced, round(q, 3) AS share_below FROM (SELECT unnest([0.05, 0.5, 0.95]::DOUBLE[]) AS q)""", doubles="quantile share_below", digits=2)
def quantile_fit(spark, sf):
    rows = training_rows(spark, sf).select("id", "volume", "spread", "profit")
    fits = M.quantile_regression(rows, ["volume", "spread"], "profit")
    out = None
    for fit in fits:
        miss = F.col("profit") - SC.total([F.col(f) * c for f, c in zip(["volume", "spread"], fit["coefficients"])]) - fit["intercept"]
        pull = fit["quantile"] - (miss < 0).cast("double")
        balance = [F.abs(F.avg(pull * F.col(f)) / F.avg(F.abs(f))) for f in ("volume", "spread")]
        one = rows.agg(
            (F.greatest(F.abs(F.avg(pull)), *balance) * F.count(F.lit(1)) < 12).alias("balanced"), F.avg((miss < 0).cast("double")).alias("share_below")
        ).select(F.lit(fit["quantile"]).alias("quantile"), "balanced", "share_below")
        out = one if out is None else out.unionByName(one)
    return out


@query("grid_evaluation")
def grid_evaluation(spark, sf):
    return M.grid_evaluation(training_rows(spark, sf), ["t", "id"], FEATS, "label", "profit", "logreg", [{"C": 1.0}, {"C": 0.01}], penalty=1e-6).withColumn("roc_auc", F.round("roc_auc", 6))


@query("shared_start")
def shared_start(spark, sf):
    rows = training_rows(spark, sf).withColumns({f: F.col(f) / 50.0 for f in FEATS})
    _, table_ = M.shared_start(rows, "symbol", FEATS, "label", rounds=2, inner_steps=2)
    return table_


SPECS = {
    "momentum": {"type": "position", "condition": {"type": "gt", "left": {"type": "price"}, "right": {"type": "sma", "window": 5}}},
    "reversal": {"type": "position", "size": -1.0, "condition": {"type": "gt", "left": {"type": "price"}, "right": {"type": "const", "value": 30.0}}},
}


@query("candidate_strategies", """
WITH m AS (SELECT hr, avg(close) AS close FROM bars GROUP BY 1),
w AS (SELECT hr, close AS p, avg(close) OVER (ORDER BY hr ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sma, lead(close) OVER (ORDER BY hr) - close AS mv FROM m),
l AS (SELECT 'momentum' AS candidate, 5 AS complexity, hr, CASE WHEN p > sma THEN mv ELSE 0 END AS pnl FROM w WHERE mv IS NOT NULL UNION ALL SELECT 'reversal', 4, hr, CASE WHEN p > 30 THEN -mv ELSE 0 END FROM w WHERE mv IS NOT NULL),
c AS (SELECT *, sum(pnl) OVER (PARTITION BY candidate ORDER BY hr) AS cum FROM l), d AS (SELECT *, max(cum) OVER (PARTITION BY candidate ORDER BY hr) - cum AS dd FROM c)
SELECT candidate, sum(pnl) AS ret, max(dd) AS risk, max(complexity)::INT AS complexity FROM d GROUP BY 1""", ctes="bars", doubles="ret risk", digits=4)
def candidate_strategies(spark, sf):
    market = bars(spark, sf).groupBy("hr").agg(F.avg("close").alias("close"))
    return M.evaluate_candidates(market, SPECS, ["hr"], "close")
