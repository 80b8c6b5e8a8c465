"""Ordered passes against slow loops, whole and split into blocks of seven rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import windows as W
from tapeloom.operators.asof import asof
from tapeloom.operators.ordered import drawdown, last_known, quantiles, row_index, running_sums


def series(seed=1, n=120, hot=0.6):
    """Rows of three keys, one of them holding most rows, with tied times."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < hot else rng.choice(["a", "b"])
        rows.append((key, rng.randint(0, 40), i, round(rng.uniform(-5, 5), 2)))
    return pd.DataFrame(rows, columns=["symbol", "t", "id", "x"])


@pytest.fixture(params=[None, 7, 25])
def blocks(request, spark):
    from tapeloom.session import BLOCK_ROWS_CONF

    if request.param:
        spark.conf.set(BLOCK_ROWS_CONF, str(request.param))
    yield request.param
    spark.conf.unset(BLOCK_ROWS_CONF)


def by_id(df, col):
    return {r["id"]: r[col] for r in df.select("id", col).collect()}


def test_running_sums_and_index(spark, blocks):
    pdf = series()
    df = spark.createDataFrame(pdf)
    got = by_id(running_sums(df, ["symbol"], ["t", "id"], {"s": F.col("x")}), "s")
    ranks = by_id(row_index(df, ["symbol"], ["t", "id"], "i"), "i")
    for _, g in pdf.sort_values(["t", "id"]).groupby("symbol"):
        for k, (i, total) in enumerate(zip(g["id"], g["x"].cumsum())):
            assert got[i] == pytest.approx(total)
            assert ranks[i] == k


def test_global_index(spark, blocks):
    pdf = series()
    got = by_id(row_index(spark.createDataFrame(pdf), [], ["t", "id"], "i"), "i")
    assert [got[i] for i in pdf.sort_values(["t", "id"])["id"]] == list(range(len(pdf)))


def test_last_known(spark, blocks):
    pdf = series()
    pdf["y"] = pdf["x"].where(pdf["id"] % 9 == 0)
    df = spark.createDataFrame(pdf.astype({"y": object}).where(pdf.notna(), None), "symbol string, t long, id long, x double, y double")
    got = by_id(last_known(df, ["symbol"], ["t", "id"], {"z": F.col("y")}), "z")
    want = pdf.sort_values(["t", "id"]).assign(z=lambda d: d.groupby("symbol")["y"].ffill())
    for i, z in zip(want["id"], want["z"]):
        assert (got[i] is None and np.isnan(z)) or got[i] == z


def test_drawdown(spark, blocks):
    pdf = series(3)
    got = {r["symbol"]: r["max_drawdown"] for r in drawdown(spark.createDataFrame(pdf), ["symbol"], ["t", "id"], "x").collect()}
    for key, g in pdf.sort_values(["t", "id"]).groupby("symbol"):
        cum = np.concatenate([[0], g["x"].cumsum()])
        assert got[key] == pytest.approx((np.maximum.accumulate(cum) - cum).max())


def test_quantiles(spark, blocks):
    pdf = series(4)
    pdf["x"] = pdf["x"].round(0)  # many equal values
    got = {r["symbol"]: r for r in quantiles(spark.createDataFrame(pdf), ["symbol"], "x", {"a": 0.05, "b": 0.5, "c": 0.93}).collect()}
    for key, g in pdf.groupby("symbol"):
        for name, p in (("a", 0.05), ("b", 0.5), ("c", 0.93)):
            assert got[key][name] == pytest.approx(np.quantile(g["x"], p))


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("tolerance", [None, 2])
def test_asof(spark, blocks, direction, tolerance):
    left, right = series(5), series(6, 60).rename(columns={"t": "rt", "id": "rid", "x": "rx"})
    got = {
        r["id"]: r["match"]["rid"] if r["match"] else None
        for r in asof(spark.createDataFrame(left), spark.createDataFrame(right), ["symbol"], "t", "rt", "id", "rid", direction, tolerance).collect()
    }
    want = pd.merge_asof(
        left.sort_values(["t", "id"]), right.sort_values(["rt", "rid"]), left_on="t", right_on="rt", by="symbol",
        direction=direction, tolerance=tolerance,
    )
    assert got == {i: None if pd.isna(r) else int(r) for i, r in zip(want["id"], want["rid"])}


def test_rolling_features_do_not_depend_on_blocks(spark, small_blocks):
    from tapeloom.session import BLOCK_ROWS_CONF

    df = spark.createDataFrame(series(7, 90).assign(price=lambda d: d["x"] + 10))
    jobs = {
        "sma": lambda: W.sma(df, ["symbol"], ["t", "id"], "price", 5),
        "rsi": lambda: W.rsi(df, ["symbol"], ["t", "id"], "price", 9),
        "adx": lambda: W.adx(df, ["symbol"], ["t", "id"], "price", 5),
        "hurst": lambda: W.hurst(df, ["symbol"], ["t", "id"], "price", 12),
        "macd_signal": lambda: W.macd(df, ["symbol"], ["t", "id"], "price"),
        "kalman_level": lambda: W.kalman(df, ["symbol"], ["t", "id"], "price"),
    }
    split = {n: by_id(j(), n) for n, j in jobs.items()}
    spark.conf.unset(BLOCK_ROWS_CONF)
    for n, j in jobs.items():
        whole = by_id(j(), n)
        assert split[n] == pytest.approx(whole, abs=1e-9), n


def test_sma_stays_within_its_window(spark):
    pdf = series(8)
    rows = W.sma(spark.createDataFrame(pdf), ["symbol"], ["t", "id"], "x", 4).toPandas().sort_values(["t", "id"])
    for _, g in rows.groupby("symbol"):
        lo, hi = g["x"].rolling(4, min_periods=1).min(), g["x"].rolling(4, min_periods=1).max()
        assert ((g["sma"] >= lo - 1e-9) & (g["sma"] <= hi + 1e-9)).all()


def test_detectors_alarm_where_expected(spark, blocks):
    from tapeloom.operators.drift import change_alarms

    ph = spark.createDataFrame([("s", i, 0.0 if i < 10 else 1.0) for i in range(20)], "k string, i long, v double")
    first = change_alarms(ph, ["k"], ["i"], "v", "page_hinkley", delta=0.1, threshold=1.0, min_samples=5).agg(F.min("i")).first()[0]
    assert first == 11
    cs = spark.createDataFrame([("s", i, 0.0 if i < 5 else 1.0) for i in range(10)], "k string, i long, v double")
    assert change_alarms(cs, ["k"], ["i"], "v", "cusum", threshold=0.5).agg(F.min("i")).first()[0] == 5


def test_long_detector_series_passes_state_between_blocks(spark, small_blocks):
    from tapeloom.operators.drift import change_alarms

    pdf = series(9, 60)
    got = {r["id"] for r in change_alarms(spark.createDataFrame(pdf), ["symbol"], ["t", "id"], "x", "cusum", threshold=8.0).collect()}
    want = set()
    for _, g in pdf.sort_values(["t", "id"]).groupby("symbol"):
        want |= {g["id"].iloc[k] for k in slow_alarms(g["x"].tolist(), "cusum", 8.0, 0.0)}
    assert got == want


def slow_alarms(values, rule, threshold, slack, least=1):
    """Sums from their definitions, over all values since the last alarm."""
    places, start = [], 0
    for k in range(len(values)):
        seen = np.array(values[start : k + 1])
        off = seen - np.cumsum(seen) / np.arange(1, len(seen) + 1)
        if rule == "page_hinkley":
            total = np.concatenate([[0.0], np.cumsum(off - slack)])
            level = total[-1] - total.min()
        else:
            up, down = (np.concatenate([[0.0], np.cumsum(off + side * slack)]) for side in (-1, 1))
            level = max(up[-1] - up.min(), down.max() - down[-1])
        if level > threshold and len(seen) >= least:
            places.append(k)
            start = k + 1
    return places


@pytest.mark.parametrize("stretch", [1, 4, 256])
def test_alarms_in_stretches_are_those_of_the_definition(stretch, monkeypatch):
    from tapeloom.operators import drift

    monkeypatch.setattr(drift, "STRETCH", stretch)
    rng = np.random.default_rng(stretch)
    values = rng.normal(size=300) + np.repeat([0, 2, -1], 100)
    for cut in (0, 7, 300):
        for rule, settings, slow in (("cusum", {"threshold": 4.0, "drift": 0.2}, (4.0, 0.2)), ("page_hinkley", {"threshold": 5.0, "delta": 0.1, "min_samples": 9}, (5.0, 0.1, 9))):
            first, state = drift.alarm_places(values[:cut], drift.START, rule, **settings)
            second, _ = drift.alarm_places(values[cut:], state, rule, **settings)
            assert [*first, *(cut + k for k in second)] == slow_alarms(values.tolist(), rule, *slow)


def test_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "symbol string, t long, id long, x double")
    assert running_sums(empty, ["symbol"], ["t", "id"], {"s": F.col("x")}).count() == 0
    assert W.bollinger(empty, ["symbol"], ["t", "id"], "x").count() == 0
    one = spark.createDataFrame([("a", 1, 1, 2.0)], "symbol string, t long, id long, x double")
    row = W.bollinger(one, ["symbol"], ["t", "id"], "x").first()
    assert row["bollinger_upper"] == row["bollinger_lower"] == 2.0
