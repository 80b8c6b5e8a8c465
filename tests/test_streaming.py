"""Streams: state carried over micro-batches gives what one batch gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.plans.streams import arriving
from tapeloom.streaming import pipelines as P
from tapeloom.streaming import stateful as ST
from tapeloom.streaming.runner import run_to_table


def numbers(spark, n=90):
    rng = np.random.default_rng(2)
    v = rng.normal(size=n) + np.where(np.arange(n) > n // 2, 3.0, 0.0)
    return spark.createDataFrame([("k" if i % 3 else "m", i, float(x)) for i, x in enumerate(v)], "key string, t long, v double"), v


def test_stream_detector_equals_batch(spark):
    from tapeloom.operators.drift import change_alarms

    df, _ = numbers(spark)
    batch = sorted(r["t"] for r in change_alarms(df, ["key"], ["t"], "v", "cusum", threshold=6.0).collect())
    got = run_to_table(ST.change_alarms(arriving(df, "t"), ["key"], ["t"], "v", "cusum", threshold=6.0), "test")
    assert sorted(r["t"] for r in got.collect()) == batch and batch


def test_late_rows_are_put_in_order_and_later_ones_dropped(spark):
    from tapeloom.operators.drift import change_alarms

    df, _ = numbers(spark)
    batch = sorted(r["t"] for r in change_alarms(df, ["key"], ["t"], "v", "cusum", threshold=6.0).collect())
    timed = df.select("key", "t", "v", F.timestamp_seconds(F.col("t") + 1000).alias("ts"))
    # Rows arrive up to 20 seconds late; a heartbeat ends the series and a row after it comes too late.
    shaken = timed.withColumn("seen", F.col("t") + F.pmod(F.xxhash64("t"), F.lit(20)))
    ends = spark.createDataFrame([("beat", 1000, 0.0, 2000), ("k", 10, 1e9, 3000)], "key string, t long, v double, seen long")
    ends = ends.select("key", "t", "v", F.timestamp_seconds(F.col("t") + 1000).alias("ts"), "seen")
    stream = arriving(shaken.union(ends), "seen", 6).withWatermark("ts", "20 seconds").drop("seen")
    late = run_to_table(ST.change_alarms(stream, ["key"], ["t"], "v", "cusum", "ts", threshold=6.0), "late")
    assert sorted(r["t"] for r in late.collect()) == batch and batch


def test_online_drift_sees_the_shift(spark):
    df, _ = numbers(spark, 150)
    got = run_to_table(ST.online_drift(arriving(df.withColumn("key", F.lit("x")), "t"), ["key"], ["t"], "v", 60, 40, 1e9, 0.5), "test").collect()
    assert got and min(r["t"] for r in got) > 75


def test_sgd_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=60)
    y = (x > 0).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "t long, x double, y int")
    got = {r["feature"]: r["weight"] for r in P.sgd_updates(arriving(df, "t", 3), ["x"], "y").collect()}
    w = np.zeros(2)
    for lo, hi in ((0, 20), (20, 40), (40, 60)):
        z = np.column_stack([x[lo:hi], np.ones(hi - lo)])
        w = w - 0.1 * z.T @ (1 / (1 + np.exp(-(z @ w))) - y[lo:hi]) / (hi - lo)
    assert [got["x"], got["intercept"]] == pytest.approx(w.tolist(), rel=0.05)


def test_confidence_weighted_equals_a_loop(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 2))
    y = (x[:, 0] > x[:, 1]).astype(int)
    df = spark.createDataFrame([("m", i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "key string, t long, a double, b double, y int")
    df = df.withColumn("w", F.when(F.col("t") % 7 == 0, 0.0).otherwise(2.0))
    last = run_to_table(ST.confidence_weighted(arriving(df, "t"), ["key"], ["t"], ["a", "b"], "y", 1.0, "w"), "test").orderBy(F.col("n").desc()).first()
    mean, spread, used = np.zeros(3), np.ones(3), 0
    for i, (xi, yi) in enumerate(zip(x, y)):
        if i % 7 == 0:
            continue
        used += 1
        xi, s = np.append(xi, 1.0), 1 if yi == 1 else -1
        beta, short = 1.0 / (xi * xi @ spread + 1.0), 1.0 - s * (mean @ xi)
        if short > 0:
            mean, spread = mean + short * beta * s * spread * xi, spread - beta * (spread * xi) ** 2
    assert last["n"] == used
    assert [*last["weights"], last["bias"]] == pytest.approx(mean.tolist())


def test_replay_keeps_the_newest_and_prefers_heavy_rows(spark):
    df = spark.createDataFrame([(i, 100.0 if i % 10 == 0 else 0.01) for i in range(200)], "t long, weight double")
    got = P.replay_sample(arriving(df, "t"), ["t"], "weight", 100, 10).collect()
    assert len(got) == 10 and min(r["t"] for r in got) >= 100
    assert sum(r["weight"] > 1 for r in got) >= 8


def test_alarms_and_calibration(spark):
    from tapeloom.operators.windows import ewma_anomaly

    df, v = numbers(spark)
    got = P.metric_alarms(arriving(df, "t"), ["key"], ["t"], "v", 1.0).filter("batch_no = 2").toPandas().set_index("key")
    want = ewma_anomaly(df, ["key"], ["t"], "v", 1.0).toPandas().set_index("key")
    assert got["ewm_mean"].to_dict() == pytest.approx(want["ewm_mean"].to_dict())
    assert got["is_anomaly"].to_dict() == want["is_anomaly"].to_dict()
    pd_ewm = df.toPandas().sort_values("t")
    for key, g in pd_ewm.groupby("key"):
        assert want.loc[key, "ewm_mean"] == pytest.approx(g["v"].ewm(alpha=0.3).mean().iloc[-1])
        assert want.loc[key, "ewm_std"] == pytest.approx(g["v"].ewm(alpha=0.3).std().iloc[-1])
    cal = P.running_calibration(arriving(df.withColumn("y", (F.col("v") > 1).cast("int")), "t"), ["t"], "v", "y", 50).orderBy("batch_no").collect()
    assert [r["n"] for r in cal][-1] == 50
    assert cal[-1]["conformal_lower"] == pytest.approx(np.quantile(v[-50:], 0.05))


def test_waiting_rows_are_held_in_pieces_and_released_in_stretches(monkeypatch):
    import pandas as pd

    class Held:
        items = []

        def exists(self):
            return bool(self.items)

        def appendList(self, more):
            self.items = [*self.items, *more]

        def put(self, all_):
            self.items = list(all_)

        def clear(self):
            self.items = []

        def get(self):
            return iter(self.items)

    class Value(Held):
        def update(self, value):
            self.items = value

        def get(self):
            return self.items

    class Handle:
        timers = []

        def getValueState(self, *_):
            return Value()

        def getListState(self, *_):
            return Held()

        def registerTimer(self, at):
            self.timers.append(at)

    class Now:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    monkeypatch.setattr(ST, "RELEASE_ROWS", 50)
    rng = np.random.default_rng(5)
    v = rng.normal(size=300) + np.repeat([0.0, 4.0], 150)
    rows = pd.DataFrame({"key": "k", "t": np.arange(300), "v": v, ST.WAITS: np.arange(300) * 1000})
    taken = []
    p = ST._Detector(["key"], ["t"], "v", "cusum", {"threshold": 6.0})
    p.waiting = list(rows.columns)
    advance = p.advance
    p.advance = lambda pdf, before: (taken.append(len(pdf)), advance(pdf, before))[1]
    p.init(Handle())
    assert not list(p.handleInputRows(("k",), iter([rows.sample(frac=1, random_state=1)[:200], rows.sample(frac=1, random_state=1)[200:]]), Now(-1)))
    assert len(p.held.items) == 2  # a piece for each batch, not an item for each row
    got = [t for at in (199, 199, 10_000) for out in p.handleExpiredTimer(("k",), Now(at), None) for t in out["t"]]
    from tapeloom.operators.drift import START, alarm_places

    assert got == alarm_places(v, START, "cusum", threshold=6.0)[0] and got
    assert taken == [50] * 6 and not p.held.exists()
