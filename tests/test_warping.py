"""Nearest windows by value against all earlier windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import warping as WP


@pytest.mark.parametrize("n, size, digits", [(1, 4, 2), (40, 1, 0), (300, 2, 0), (300, 3, 2), (600, 6, 0), (900, 8, 2)])
def test_index_finds_the_nearest_earlier_window(n, size, digits):
    rng = np.random.default_rng(n + size)
    windows = np.lib.stride_tricks.sliding_window_view(rng.exponential(3.0, n + size - 1).round(digits), size)
    places = 5 + np.arange(n)
    asked = np.arange(0, n, 7)
    index = WP.WindowIndex(windows, places)
    cost, number = index.nearest(windows[asked], places[asked], np.full(len(asked), np.inf))
    for k, i in enumerate(asked):
        early = np.flatnonzero(places + size <= places[i])
        if not len(early):
            assert number[k] == -1
            continue
        every = WP._warped_costs(np.abs(windows[i][None, :, None] - windows[early][:, None, :]))[:, -1, -1]
        assert (cost[k], index.places[number[k]]) == (every.min(), places[early[every.argmin()]])
    # A bound that only an equal window reaches is kept, a lower one finds nothing.
    known = np.flatnonzero(number >= 0)
    again = index.nearest(windows[asked[known]], places[asked[known]], cost[known])
    assert (again[1] == number[known]).all()
    assert (index.nearest(windows[asked[known]], places[asked[known]], cost[known] - 1)[1] == -1).all()


def test_most_windows_of_a_series_without_trend_are_left_out(monkeypatch):
    """Segments of neighbouring rows leave out nothing here; leaves of windows alike do."""
    rng = np.random.default_rng(3)
    windows = np.lib.stride_tricks.sliding_window_view(rng.exponential(3.0, 20_007), 8)
    met, costs = [], WP.WindowIndex._costs
    monkeypatch.setattr(WP.WindowIndex, "_costs", lambda self, x, q, w, best: (met.append(len(q)), costs(self, x, q, w, best))[1])
    WP.WindowIndex(windows, np.arange(20_000)).nearest(windows[-100:], np.full(100, 30_000), np.full(100, np.inf))
    assert sum(met) < 0.6 * 100 * 20_000


def test_equal_windows_are_not_all_met(monkeypatch):
    """Of windows that are equally near only the earliest counts."""
    met, costs = [], WP.WindowIndex._costs
    monkeypatch.setattr(WP.WindowIndex, "_costs", lambda self, x, q, w, best: (met.append(len(q)), costs(self, x, q, w, best))[1])
    windows, at = np.full((20_000, 8), 2.5), np.arange(10_000, 20_000, 100)
    index = WP.WindowIndex(windows, np.arange(20_000))
    cost, number = index.nearest(windows[at], at, np.full(len(at), np.inf))
    assert (cost == 0).all() and (index.places[number] == 0).all()
    assert sum(met) < 0.1 * 20_000 * len(at)


@pytest.mark.parametrize("window", [1, 2, 3, 6])
def test_nearest_windows_over_cells(spark, monkeypatch, window):
    """Cells, slabs and chunks of queries that are much smaller than the series leave nothing out."""
    monkeypatch.setattr(WP, "CELL", 40)
    monkeypatch.setattr(WP, "QUERIES", 16)
    rng = np.random.default_rng(window)
    rows = []
    for key, n in (("a", 400), (None, 130), ("small", 9)):
        x = rng.exponential(5.0, n).round(0)
        x[n // 3 : n // 2] = 4.0  # windows that are equal
        rows += [(key, i, None if i % 97 == 96 else float("nan") if i % 89 == 88 else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, t long, price double")
    got = WP.nearest_windows(df, ["k"], ["t"], "price", window, F.col("t") % 5 == 0).collect()
    want = {}
    for key in ("a", None, "small"):
        x = np.array([np.nan if v is None else v for k, _, v in rows if k == key])
        every = np.lib.stride_tricks.sliding_window_view(x, window)
        sound = np.flatnonzero(np.isfinite(every).all(axis=1))
        for i in sound[sound % 5 == 0]:
            early = sound[sound + window <= i]
            if len(early):
                costs = WP._warped_costs(np.abs(every[i][None, :, None] - every[early][:, None, :]))[:, -1, -1]
                want[key, int(i)] = (int(early[costs.argmin()]), round(float(costs.min()), 9))
    assert {(r["k"], r["t"]): (r["partner_t"], round(r["distance"], 9)) for r in got} == want
    assert len(got) == len(want) > 80
