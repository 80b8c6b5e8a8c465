"""Fitted, random and iterative operators against numpy on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import classify as C
from tapeloom.operators import resample as RS
from tapeloom.operators import forest as FO
from tapeloom.operators import graph as G
from tapeloom.operators import labels as L
from tapeloom.operators import models as M
from tapeloom.operators import spectral as SP
from tapeloom.operators import warping as WP


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=400), rng.normal(size=400)
    pdf = pd.DataFrame({"id": np.arange(400), "a": a, "b": b, "c": a + 0.5 * rng.normal(size=400), "w": 1.0})
    pdf["label"] = (a - b + 0.3 * rng.normal(size=400) > 0).astype(int)
    pdf["profit"] = 2 * a - b + rng.normal(size=400)
    return pdf, spark.createDataFrame(pdf).persist()


def test_folds_predict_and_calibrate(rows):
    pdf, df = rows
    scored = M.fold_fits(df, ["id"], ["a", "b"], "label", "w", "logreg", n_splits=3, C=10.0)
    assert scored.count() == 299  # three validation blocks of 100, the last cut by the gap
    assert C.auc(scored).first()["roc_auc"] > 0.9
    cal = M.isotonic_calibration(scored)
    assert cal["y"] == sorted(cal["y"])


def test_voting_and_grid(rows):
    pdf, df = rows
    fitted = {n: M.classifier(n, ["a", "b"], "label", **s).fit(df) for n, s in {"logreg": {}, "gradient_boosting": {"maxIter": 3}}.items()}
    p = M.voting_probability(df, fitted, {"logreg": 1.0, "gradient_boosting": 1.0}).toPandas()
    assert (((p["p"] >= 0.5).astype(int) == p["label"]).mean()) > 0.9
    grid = M.grid_evaluation(df, ["id"], ["a", "b"], "label", "profit", "logreg", [{"C": 10.0}, {"C": 1e-3}])
    assert grid.filter("best").count() == 1


def test_vif_and_correlation_and_shrinkage(rows):
    pdf, df = rows
    x = pdf[["a", "b", "c"]].to_numpy()
    got = {r["feature"]: r["vif"] for r in M.vif(df, ["a", "b", "c"]).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef(x, rowvar=False)))
    assert [got[f] for f in "abc"] == pytest.approx(want.tolist())
    est = M.shrinkage_covariance(df, ["a", "b", "c"])
    xc = x - x.mean(0)
    emp = xc.T @ xc / len(x)
    mu = np.trace(emp) / 3
    delta = ((emp - mu * np.eye(3)) ** 2).sum() / 3
    beta = min((((xc**2).T @ (xc**2)) / len(x) - emp**2).sum() / (3 * len(x)), delta)
    want = (1 - beta / delta) * emp + beta / delta * mu * np.eye(3)
    assert np.allclose(est["covariance"], want)
    assert np.allclose(est["precision"], np.linalg.inv(want))


def test_ood_rates(rows):
    out = M.fold_ood(rows[1], ["id"], ["a", "b", "c"], 3).collect()
    assert len(out) == 3 and all(0 <= r["fold_rate"] <= 0.05 for r in out)


def test_pruning_keeps_one_of_a_pair(rows):
    pdf, df = rows
    df = df.withColumn("a2", F.col("a") * 3 + 1)
    got = {r["feature"]: (r["cluster"], r["kept"]) for r in M.prune_correlated(df, ["a", "b", "a2"], "label").collect()}
    assert got["a"][0] == got["a2"][0] != got["b"][0]
    assert got["a"][1] != got["a2"][1] and got["b"][1]


def test_risk_parity(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) * [1, 2, 4]
    got = {r["asset"]: r["weight"] for r in M.risk_parity(spark.createDataFrame(pd.DataFrame(x, columns=["p", "q", "r"])), ["p", "q", "r"]).collect()}
    assert sum(got.values()) == pytest.approx(1.0)
    assert got["p"] > got["r"]


def test_mutual_information_orders_features(rows):
    pdf, df = rows
    noise = df.withColumn("z", F.rand(1))
    got = {r["feature"]: r["mutual_information"] for r in M.mutual_information(noise, ["a", "z"], "label").collect()}
    assert got["a"] > 3 * got["z"]


def test_regressions(rows):
    pdf, df = rows
    h = M.heteroscedastic(df, ["a", "b"], "profit").toPandas()
    beta = np.linalg.lstsq(np.column_stack([pdf["a"], pdf["b"], np.ones(400)]), pdf["profit"], rcond=None)[0]
    want = np.column_stack([pdf["a"], pdf["b"], np.ones(400)]) @ beta
    assert np.allclose(h.sort_values("id")["mean"], want, atol=1e-4)
    q = M.quantile_regression(df, ["a", "b"], "profit", 0.9)
    fitted = pdf[["a", "b"]].to_numpy() @ np.array(q["coefficients"]) + q["intercept"]
    assert (pdf["profit"] <= fitted).mean() == pytest.approx(0.9, abs=0.03)


def test_permutation_importance(rows):
    got = {r["feature"]: r["importance"] for r in M.permutation_importance(rows[1], "id", ["a", "c"], "label", lambda c: (F.signum(c["a"]) + 1) / 2).collect()}
    assert got["a"] > 0.1 and got["c"] == 0.0


def test_shared_start_matches_loops(spark, rows):
    pdf, df = rows
    df = df.withColumn("symbol", F.when(F.col("id") < 300, "x").otherwise("y"))
    start, table = M.shared_start(df, "symbol", ["a", "b"], "label", rounds=2, inner_steps=3)
    w0 = np.zeros(2)
    for _ in range(2):
        ends = []
        for part in (pdf[pdf["id"] < 300], pdf[pdf["id"] >= 300]):
            x, y, w = part[["a", "b"]].to_numpy(), part["label"].to_numpy(), w0.copy()
            for _ in range(3):
                w = w - 0.1 * x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / len(y)
            ends.append(w)
        w0 = w0 + 0.1 * (np.mean(ends, axis=0) - w0)
    assert start == pytest.approx(w0.tolist())
    assert table.count() == 2


def test_bootstrap_brackets_the_mean(rows):
    pdf, df = rows
    got = {r["metric"]: r for r in RS.bootstrap(df.withColumn("p", F.col("label") * 0.6 + 0.2), "id", "label", "p", "profit", replicates=200).collect()}
    m = got["mean_return"]
    assert m["low"] < pdf["profit"].mean() < m["high"]
    se = pdf["profit"].std() / 20
    assert (m["high"] - m["low"]) == pytest.approx(2 * 1.96 * se, rel=0.25)


def test_forest_isolates_an_outlier(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=500), [12.0]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, v double")
    forest = FO.fit_forest(df, ["v"], "id", trees=30, sample=128)
    assert len(forest.column) == 30 and forest.sample == 128
    scored = FO.score_forest(df, ["v"], forest).toPandas().set_index("id")["anomaly_score"]
    assert scored.idxmax() == 500


def test_augmentation(spark, rows):
    pdf, df = rows
    out = L.mixup(df.withColumn("t", F.col("id") * 1_000_000), ["id"], ["a", "b"], "t", 0.5).toPandas()
    new = out[out["is_synthetic"]]
    assert len(new) == 200 and len(out) == 600
    assert new["a"].between(pdf["a"].min() - 0.2, pdf["a"].max() + 0.2).all()
    again = L.mixup(df.withColumn("t", F.col("id") * 1_000_000).repartition(3), ["id"], ["a", "b"], "t", 0.5).toPandas()
    assert sorted(again["a"].round(9)) == sorted(out["a"].round(9))


def test_dtw_mixup_is_the_same_when_split(spark, small_blocks):
    from tapeloom.session import BLOCK_ROWS_CONF

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(rng.normal(size=80).cumsum())], "symbol string, t long, price double")

    def run():
        return sorted((r["t"], round(r["distance"], 9)) for r in WP.dtw_mixup(df, ["symbol"], ["t"], "price", 4, 2.0).collect())

    split = run()
    spark.conf.unset(BLOCK_ROWS_CONF)
    assert split == run() and split


def test_quantile_fits_reach_the_least_loss(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=60) * 30 + 100
    y = 5 * x + rng.exponential(size=60) * 40
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0)], "x double, y double")

    def loss(q, slope, start):
        r = y - slope * x - start
        return np.where(r >= 0, q * r, (q - 1) * r).sum()

    for fit in M.quantile_regression(df, ["x"], "y", (0.1, 0.5, 0.9)):
        # A best line goes through two of the points.
        lines = [((y[j] - y[i]) / (x[j] - x[i]), i) for i in range(60) for j in range(i)]
        least = min(loss(fit["quantile"], s, y[i] - s * x[i]) for s, i in lines)
        assert loss(fit["quantile"], fit["coefficients"][0], fit["intercept"]) == pytest.approx(least, rel=1e-3)


def test_forest_of_odd_tables(spark):
    rows = [(i, 5.0, None if i % 9 == 0 else float(i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    forest = FO.fit_forest(df, ["a", "b"], "id", trees=7, sample=16)
    assert forest.sample == 16 and set(forest.column.ravel()) <= {-1, 1}  # a never varies
    inner = forest.column >= 0
    assert ((forest.cut > 0) & (forest.cut < 3))[inner].all() and inner[:, 1].any()
    assert (forest.length[~inner][forest.length[~inner] > 0] <= 4 + FO.path_norm(16)).all()
    few = FO.fit_forest(df.limit(1), ["a"], "id", trees=2)
    assert few.sample == 1 and FO.score_forest(df, ["a"], few).count() == 40
    assert FO.fit_forest(df.limit(0), ["a"], "id", trees=2).sample == 0


def test_forest_is_the_same_wherever_rows_lie(spark):
    df = spark.createDataFrame([(i, float(i * i % 97)) for i in range(300)], "id long, v double")
    one, two = (FO.fit_forest(d, ["v"], "id", trees=5, sample=32) for d in (df, df.repartition(7)))
    assert (one.column == two.column).all() and (one.cut == two.cut).all() and (one.length == two.length).all()


def slow_warp(a, b):
    cost = np.full((len(a) + 1, len(b) + 1), np.inf)
    cost[0, 0] = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            cost[i, j] = abs(x - y) + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
    return cost[-1, -1]


@pytest.mark.parametrize("window", [1, 2, 5])
def test_nearest_window_of_the_whole_series(spark, small_blocks, monkeypatch, window):
    monkeypatch.setattr(WP, "SEGMENT", 3)
    rng = np.random.default_rng(6)
    rows = [(s, i, None if i % 31 == 30 else float(v)) for s in ("a", "b", None) for i, v in enumerate(rng.integers(0, 6, size=70))]
    rows.append(("short", 0, 1.0))
    df = spark.createDataFrame(rows, "symbol string, t long, price double")
    got = {(r["symbol"], r["t"]): (r["distance"], r["partner_t"]) for r in WP.nearest_windows(df, ["symbol"], ["t"], "price", window, F.col("t") % 5 == 2).collect()}
    want = {}
    for s in ("a", "b", None):
        x = [r[2] for r in rows if r[0] == s]
        for at in range(2, 70 - window + 1, 5):
            if None in x[at : at + window]:
                continue
            all_ = [(slow_warp(x[at : at + window], x[k : k + window]), k) for k in range(at - window + 1) if None not in x[k : k + window]]
            if all_:
                want[s, at] = min(all_)
    assert got == want and len(want) >= 30


def test_wavelet_and_cross_spectrum(spark):
    flat = spark.createDataFrame([("s", i, 3.0) for i in range(40)], "symbol string, t long, x double")
    got = SP.wavelet_statistics(flat, ["symbol"], ["t"], "x", windows=(16, 32)).orderBy("t").collect()
    assert [c for c in got[0].asDict() if "_wp_" in c] == [f"x_wp_{n}_{s}" for n in ("w16_L1", "w32_L1", "w32_L2") for s in SP.STATS]
    # A constant c has c * sqrt(2) in the low half of each level and 0 in the high one, both of 11 values.
    assert got[-1]["x_wp_w16_L1_mean"] == pytest.approx(1.5 * np.sqrt(2)) and got[-1]["x_wp_w16_L1_min"] == pytest.approx(0.0, abs=1e-9)
    assert got[-1]["x_wp_w32_L2_max"] == pytest.approx(6.0) and got[20]["x_wp_w32_L2_max"] == 0.0
    assert got[12]["x_wp_w16_L1_max"] == 0.0 and got[13]["x_wp_w16_L1_max"] == pytest.approx(3 * np.sqrt(2))
    two = flat.union(flat.withColumns({"symbol": F.lit("u"), "x": F.sin(F.col("t") * 0.9)}))
    c = SP.cross_spectrum(two, "t", [("s", "u")], "x").orderBy(F.col("t").desc()).first()
    assert 0 <= c["csd_freq_s_u"] <= 0.5 and c["csd_coh_s_u"] <= 1 + 1e-9


def test_spectral_embedding_reproduces_the_adjacency(spark):
    e = [("a", "b", 0.5), ("b", "c", 0.25), ("a", "c", 1.0)]
    edges = spark.createDataFrame(e + [(y, x, w) for x, y, w in e], "src string, dst string, weight double")
    v = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    emb = {r["id"]: np.array(r["embedding"]) for r in G.spectral_embedding(edges, v, 3).collect()}
    adj = np.zeros((3, 3))
    at = {"a": 0, "b": 1, "c": 2}
    for x, y, w in e:
        adj[at[x], at[y]] = adj[at[y], at[x]] = w
    m = np.vstack([emb["a"], emb["b"], emb["c"]])
    assert np.allclose(m @ m.T, adj @ adj.T, atol=1e-6)  # the same inner products


def test_pagerank_loses_dangling_mass(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 1.0)], "src string, dst string, weight double")
    v = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = {r["id"]: r["rank"] for r in G.pagerank(v, edges).collect()}
    adj, pr = np.array([[0, 1, 1], [0, 0, 2], [0, 0, 0]], dtype=float), np.full(3, 1 / 3)
    out = adj.sum(1)
    out[out == 0] = 1
    for _ in range(50):
        pr = 0.05 + 0.85 * adj.T @ (pr / out)
    assert [got[x] for x in "abc"] == pytest.approx(pr.tolist(), abs=1e-6)
    assert sum(got.values()) < 1


def test_penalty_is_that_of_the_summed_loss(spark):
    """Newton's method on the penalised weighted loss gives the fitted coefficients."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 2)) * [1.0, 5.0]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1])))).astype(int)
    w = rng.integers(1, 4, 400).astype(float)
    df = spark.createDataFrame([(float(a), float(b), int(c), float(d)) for (a, b), c, d in zip(x, y, w)], "a double, b double, label int, w double")
    model = M.fit_classifier(df, "logreg", ["a", "b"], "label", "w", C=0.05, tol=1e-12, maxIter=300).stages[-1]
    lo, hi = np.quantile(x, [0.01, 0.99], axis=0)
    z = np.clip(x, lo, hi)
    rank = [np.sort(z, axis=0)[int(np.ceil(q * 400)) - 1] for q in (0.25, 0.5, 0.75)]
    z = np.column_stack([(z - rank[1]) / (rank[2] - rank[0]), np.ones(400)])
    beta, ridge = np.zeros(3), np.diag([1.0, 1.0, 0.0]) / 0.05
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve(z.T * (w * p * (1 - p)) @ z + ridge, z.T @ (w * (p - y)) + ridge @ beta)
    assert [*model.coefficients, model.intercept] == pytest.approx(beta.tolist(), rel=0.02, abs=0.01)


def test_linkage_against_mean_distances():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(12, 3))
    dist = np.linalg.norm(points[:, None] - points[None], axis=2)
    groups = [[i] for i in range(12)]
    while len(groups) > 1:
        mean, a, b = min((dist[np.ix_(g, h)].mean(), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        if mean > 1.5:
            break
        groups[a] = groups[a] + groups.pop(b)
    assert sorted(map(sorted, M._linkage(dist, 1.5))) == sorted(map(sorted, groups))


def test_warping_against_the_plain_table():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.normal(size=6), rng.normal(size=6)
        cost = np.full((7, 7), np.inf)
        cost[0, 0] = 0
        for i in range(6):
            for j in range(6):
                cost[i + 1, j + 1] = abs(a[i] - b[j]) + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
        assert L._warped_costs(np.abs(a[:, None] - b)[None])[0, -1, -1] == pytest.approx(cost[-1, -1])
        assert L.warped_partner(a, a) == pytest.approx(a)
        assert len(L.warped_partner(a, b)) == 6


def test_sample_gaps_against_histograms():
    from tapeloom.operators.drift import sample_gaps

    rng = np.random.default_rng(5)
    for a, b in ((rng.normal(size=200), rng.normal(0.5, 1, size=80)), (rng.integers(0, 4, 100).astype(float), rng.integers(0, 5, 60).astype(float))):
        cuts = np.unique(np.quantile(a, np.linspace(0, 1, 11)))
        p, q = np.histogram(a, cuts)[0] / len(a), np.histogram(b, cuts)[0] / len(b)
        grid = np.union1d(a, b)
        gap = np.abs((a[:, None] <= grid).mean(axis=0) - (b[:, None] <= grid).mean(axis=0)).max()
        assert sample_gaps(a, b) == pytest.approx((((p - q) * np.log((p + 1e-6) / (q + 1e-6))).sum(), gap))


def test_scan_of_files_with_different_headers(spark, tmp_path):
    from tapeloom.sources.readers import read_trade_files

    (tmp_path / "trades_1.csv").write_text("event_id;action;Ticket;symbol\n1;OPEN;10;X\n")
    (tmp_path / "trades_2.csv").write_text("symbol;ticket;sl_dist;event_id;new\nY;11;0.5;2;z\n")
    (tmp_path / "trades_3.csv").write_text("")
    got = sorted(tuple(r) for r in read_trade_files(spark, f"{tmp_path}/*.csv").select("event_id", "action", "ticket", "symbol", "sl_dist").collect())
    assert got == [("1", "OPEN", "10", "X", None), ("2", None, "11", "Y", "0.5")]
