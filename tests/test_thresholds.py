"""Thresholds and bootstrap metrics against loops over thresholds and replicates."""

import hashlib

import numpy as np
import pytest

from tapeloom.operators import resample as RS
from tapeloom.operators import thresholds as TH


def brute_risk(returns):
    cum = np.concatenate([[0.0], np.cumsum(returns)])
    return (np.maximum.accumulate(cum) - cum).max(), np.sort(returns)[int(0.05 * len(returns))]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 193])
def test_root_history_is_the_drawdown_at_each_score(n):
    rng = np.random.default_rng(n)
    returns, scores = rng.normal(size=n).round(3), rng.choice(np.arange(n // 2 + 1) / 10, size=n)
    score, (total, _, _, fall) = TH.node_histories(returns, scores)
    assert score.tolist() == sorted(set(scores), reverse=True)
    for s, t, f in zip(score, total, fall):
        masked = np.where(scores >= s, returns, 0)
        assert t == pytest.approx(masked.sum()) and f == pytest.approx(brute_risk(masked)[0])


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        p = None if i % 40 == 7 else float(rng.choice([rng.integers(0, 20) / 20, rng.random()]))
        rows.append((i, int(rng.integers(2)), p, float(rng.choice([0.0, 1.5, round(rng.normal(), 2)]))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shift", [0.0, -9.0, 9.0])
def test_every_threshold_against_a_loop(spark, scored, small_blocks, shift):
    rows = [(i, y, p, r + shift) for i, y, p, r in scored]
    df = spark.createDataFrame(rows, "id long, y int, p double, r double")
    got = {r["threshold"]: r for r in TH.threshold_table(df, TH.threshold_candidates(df, "p", [0.333]), ["id"], "y", "p", "r").collect()}
    ordered = sorted(rows)
    y, r = np.array([q[1] for q in ordered]), np.array([q[3] for q in ordered])
    p = np.array([-1.0 if q[2] is None else q[2] for q in ordered])
    assert set(got) == {q for q in p if q >= 0} | {0.0, 0.333, 0.5, 1.0}
    for t, row in got.items():
        masked = np.where(p >= t, r, 0.0)
        fall, var = brute_risk(masked)
        assert row["max_drawdown"] == pytest.approx(fall) and row["var_95"] == pytest.approx(var)
        assert row["profit"] == pytest.approx(masked.sum()) and row["accuracy"] == pytest.approx(((p >= t) == (y == 1)).mean())
        assert row["active"] == (masked != 0).any()


def test_thresholds_of_no_rows(spark):
    df = spark.createDataFrame([], "id long, y int, p double, r double")
    got = TH.threshold_table(df, TH.threshold_candidates(df, "p"), ["id"], "y", "p", "r").collect()
    assert {(r["threshold"], r["max_drawdown"], r["var_95"]) for r in got} == {(t, 0.0, 0.0) for t in (0.0, 0.5, 1.0)}


def brute_bootstrap(rows, replicates, seed):
    rows = sorted(q for q in rows if q[2] is not None)
    per = []
    for b in range(replicates):
        factor = int(hashlib.md5(f"{seed}:{b}".encode()).hexdigest()[:8], 16) % (RS.PRIME - 1) + 1
        drawn = []
        for i, y, p, r in rows:
            z = int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % RS.PRIME * factor % RS.PRIME
            drawn += [(y, p, r)] * sum(z >= c for c in RS.CUTS)
        y, p, r = (np.array(c, dtype=float) for c in zip(*drawn))
        fall, var = brute_risk(r)
        wins = np.sign(p[y == 1][:, None] - p[y == 0][None, :])
        precision = [((p >= s) & (y == 1)).sum() / (p >= s).sum() for s in p[y == 1]]
        per.append([((p >= 0.5) == (y == 1)).mean(), (wins + 1).mean() / 2, np.mean(precision), ((p - y) ** 2).mean(), r.mean() / r.std(ddof=1),
                    r.mean() / np.sqrt((r[r < 0] ** 2).mean()), fall, var, r.sum(), r.mean()])
    per = np.array(per)
    return {m: (v.mean(), np.quantile(v, 0.025), np.quantile(v, 0.975)) for m, v in zip(RS.METRICS, per.T)}


@pytest.mark.parametrize("chunk", [2_048, 3])
def test_bootstrap_against_drawn_rows(spark, scored, small_blocks, monkeypatch, chunk):
    monkeypatch.setattr(RS, "CHUNK", chunk)
    df = spark.createDataFrame(scored, "id long, y int, p double, r double")
    got = {r["metric"]: r[1:] for r in RS.bootstrap(df, "id", "y", "p", "r", replicates=15, seed=3).collect()}
    want = brute_bootstrap(scored, 15, 3)
    assert set(got) == set(want)
    for m in want:
        assert got[m] == pytest.approx(want[m]), m


def test_weights_are_poisson():
    w = RS._weights(np.random.default_rng(1).integers(RS.PRIME, size=20_000), np.array(RS.replicate_factors(40, 0)))
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w.T) - np.eye(40)).max() < 0.05
