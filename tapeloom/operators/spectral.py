"""Wavelet-packet statistics and cross-spectral features over trailing windows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators.ordered import last_known, over_rows
from tapeloom.operators.windows import wide_by_symbol

# Low-pass decomposition filter of the Daubechies wavelet with four vanishing moments
# (fixed values); the high-pass filter follows by alternating signs.
DB4_LOW = (
    -0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114,
    -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523,
)
STATS = ("mean", "std", "energy", "min", "max")


def deepest_level(n: int) -> int:
    """Levels that ``n`` values allow: each halving must leave as many as the filter has, less one."""
    return max(0, int(math.log2(n / (len(DB4_LOW) - 1)))) if n >= len(DB4_LOW) else 0


def wavelet_statistics(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, windows: Sequence[int] = (16, 32), level: int | None = None,
    stats: Sequence[str] = STATS,
) -> DataFrame:
    """Statistics of all wavelet-packet coefficients of a level, ``{column}_wp_w{window}_L{level}_{stat}``, for
    levels 1 to ``level``, or to the deepest that the window allows.

    A window has up to ``window`` rows, fewer at the start of a key; levels that its rows don't allow are 0.
    Nulls take the last value before, or 0.  Spark places the rows and collects each window; a batch of
    windows is transformed together, one length at a time.
    """
    rows = last_known(df, keys, order, {"_x": F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))})
    rows = rows.withColumn("_x", F.coalesce("_x", F.lit(0.0)))
    levels = {w: min(level or deepest_level(w), deepest_level(w)) for w in windows}
    used = [w for w in windows if levels[w]]

    def build(rows, lay):
        return rows.withColumns({f"_w{w}": F.collect_list("_x").over(lay.rows(1 - w, 0)) for w in used})

    rows = over_rows(rows, keys, order, build, before=max(windows))
    for w in used:
        names = [f"{column}_wp_w{w}_L{n}_{s}" for n in range(1, levels[w] + 1) for s in stats]
        rows = rows.withColumn("_s", _packet_udf(levels[w], list(stats))(f"_w{w}"))
        rows = rows.withColumns({n: F.get("_s", F.lit(i)) for i, n in enumerate(names)}).drop("_s", f"_w{w}")
    return rows.drop("_x")


def _packet_udf(levels: int, stats: list[str]):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def of(series):
        import numpy as np
        import pandas as pd

        measures = {
            "mean": lambda c: c.mean(1), "std": lambda c: c.std(1), "energy": lambda c: (c * c).sum(1),
            "min": lambda c: c.min(1), "max": lambda c: c.max(1),
        }
        low = np.array(DB4_LOW)
        high = low[::-1] * np.where(np.arange(len(low)) % 2 == 0, -1.0, 1.0)
        out = np.zeros((len(series), levels * len(stats)))
        lengths = series.map(len).to_numpy()
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            nodes = [np.vstack([np.asarray(v, dtype=float) for v in series.iloc[at]])]
            for depth in range(min(levels, deepest_level(int(n)))):
                nodes = [half for node in nodes for half in (_halve(node, low), _halve(node, high))]
                joined = np.concatenate(nodes, axis=1)
                for i, name in enumerate(stats):
                    out[at, depth * len(stats) + i] = measures[name](joined)
        return pd.Series(list(out))

    return of


def _halve(x, taps):
    """Filter each row with symmetric extension and keep every second value."""
    import numpy as np

    n, k = x.shape[1], len(taps)
    at = np.arange(-(k - 1), n + k - 1) % (2 * n)
    at = np.where(at < n, at, 2 * n - 1 - at)
    ext = x[:, at]
    windows = np.lib.stride_tricks.sliding_window_view(ext, k, axis=1)[:, 1::2]
    return windows @ taps[::-1]


def cross_spectrum(df: DataFrame, time: str, pairs: Sequence[tuple[str, str]], value: str, window: int = 16, bins: int = 5) -> DataFrame:
    """Strongest cross-spectral frequency and its coherence per time and listed pair.

    Bins come from the transform of the leading ``bins`` values of each trailing window;
    times before the first full window get 0.
    """
    symbols = sorted({s for p in pairs for s in p})
    wide = wide_by_symbol(df, time, symbols, value)

    def build(rows, lay):
        return rows.withColumns({f"_l_{s}": F.collect_list(s).over(lay.rows(1 - window, 0)) for s in symbols})

    rows = over_rows(wide, [], [time], build, before=window)

    @F.pandas_udf("freq double, coh double")
    def peak(a, b):
        import numpy as np
        import pandas as pd

        out = np.zeros((len(a), 2))
        full = np.array([len(v) == window for v in a])
        if full.any():
            fa = np.fft.rfft(np.vstack([np.asarray(v, dtype=float) for v in a[full]]), bins, axis=1)
            fb = np.fft.rfft(np.vstack([np.asarray(v, dtype=float) for v in b[full]]), bins, axis=1)
            power = (np.abs(fa) ** 2) * (np.abs(fb) ** 2)
            coh = np.abs(fa * np.conj(fb)) ** 2 / (power + 1e-9)
            best = coh.argmax(axis=1)
            out[full, 0] = np.fft.rfftfreq(window)[:bins][best]
            out[full, 1] = coh[np.arange(len(best)), best]
        return pd.DataFrame(out, columns=["freq", "coh"])

    made = {}
    for a, b in pairs:
        made[f"csd_{a}_{b}"] = peak(f"_l_{a}", f"_l_{b}")
    rows = rows.withColumns(made)
    return rows.select(
        time, *[F.col(f"csd_{a}_{b}.{p}").alias(f"csd_{p}_{a}_{b}") for a, b in pairs for p in ("freq", "coh")]
    )
