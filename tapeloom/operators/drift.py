"""Distribution drift, sequential change detection and isolation-forest anomaly scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.ordered import quantiles, running_sums, scan_in_rounds


def _c(name: str) -> Column:
    return F.col(name)


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(feature, value) rows without nulls and NaN."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), _c(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(cells).alias("e")).select(*keep, "e.*").filter(
        _c("value").isNotNull() & ~F.isnan("value")
    )


def psi(baseline: DataFrame, recent: DataFrame, columns: Sequence[str], bins: int = 10, open_ended: bool = False) -> DataFrame:
    """Population stability index per feature over the baseline's quantile bins.

    Recent values outside the baseline range are not counted unless ``open_ended``.
    """
    base, now = melt(baseline, columns), melt(recent, columns)
    names = {f"q{i}": i / bins for i in range(bins + 1)}
    cuts = quantiles(base, ["feature"], "value", names).select(
        "feature", F.array_sort(F.array_distinct(F.array(*names))).alias("cuts")
    )

    def counts(rows, name):
        binned = rows.join(F.broadcast(cuts), "feature")  # one row per feature column
        below = F.size(F.filter("cuts", lambda c: c <= _c("value")))
        last = F.size("cuts") - 1
        inside = (_c("value") >= F.get("cuts", F.lit(0))) & (_c("value") <= F.get("cuts", last))
        bin_ = F.least(F.greatest(below - 1, F.lit(0)), last - 1)
        usable = F.size("cuts") > 1
        if not open_ended:
            usable = usable & inside
        return binned.groupBy("feature", F.when(usable, bin_).alias("bin")).agg(F.count(F.lit(1)).alias(name))

    def shares(rows, name):
        # at most bins + 1 rows per feature here
        w = Window.partitionBy("feature")
        return counts(rows, "n").withColumn(name, _c("n") / F.sum("n").over(w)).filter("bin IS NOT NULL").drop("n")

    both = shares(base, "e").join(shares(now, "a"), ["feature", "bin"], "full")
    e, a = F.coalesce("e", F.lit(0.0)), F.coalesce("a", F.lit(0.0))
    found = both.groupBy("feature").agg(F.sum((e - a) * F.ln((e + 1e-6) / (a + 1e-6))).alias("psi"))
    return cuts.select("feature").join(found, "feature", "left").withColumn("psi", F.coalesce("psi", F.lit(0.0)))


def ks(baseline: DataFrame, recent: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Largest gap between the two empirical distributions, per feature."""
    both = melt(baseline, columns).withColumn("_e", F.lit(1)).unionByName(melt(recent, columns).withColumn("_e", F.lit(0)))
    counts = both.groupBy("feature", "value").agg(F.sum("_e").alias("e"), F.sum(1 - _c("_e")).alias("a"))
    run = running_sums(counts, ["feature"], ["value"], {"ce": _c("e"), "ca": _c("a")})
    totals = counts.groupBy("feature").agg(F.sum("e").alias("ne"), F.sum("a").alias("na"))
    gaps = run.join(F.broadcast(totals), "feature")  # one row per feature column
    return gaps.filter((_c("ne") > 0) & (_c("na") > 0)).groupBy("feature").agg(
        F.max(F.abs(_c("ce") / _c("ne") - _c("ca") / _c("na"))).alias("ks")
    )


def sample_gaps(reference, recent, bins: int = 10) -> tuple[float, float]:
    """PSI over the reference's quantile bins and the KS distance of two arrays that fit a task.

    Both are read off the two distributions at the merged distinct values, as the table versions do.
    """
    import numpy as np

    values, place = np.unique(np.concatenate([reference, recent]), return_inverse=True)
    counts = np.zeros((2, len(values) + 1))
    np.add.at(counts, (np.repeat([0, 1], [len(reference), len(recent)]), place + 1), 1.0)
    upto = counts.cumsum(axis=1) / counts.sum(axis=1, keepdims=True)
    cuts = np.unique(np.quantile(reference, np.linspace(0, 1, bins + 1)))
    psi = 0.0
    if len(cuts) > 1:
        # Bins start at a cut; the last one ends with its cut.
        at = np.append(np.searchsorted(values, cuts[:-1], "left"), np.searchsorted(values, cuts[-1], "right"))
        shares = np.diff(upto[:, at], axis=1)
        psi = float(((shares[0] - shares[1]) * np.log((shares[0] + 1e-6) / (shares[1] + 1e-6))).sum())
    return psi, float(np.abs(upto[0] - upto[1]).max())


def drift_report(baseline: DataFrame, recent: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """Mean PSI and KS over features, and whether the larger one exceeds the threshold."""
    per = psi(baseline, recent, columns).join(ks(baseline, recent, columns), "feature", "full")
    out = per.agg(F.coalesce(F.avg("psi"), F.lit(0.0)).alias("psi"), F.coalesce(F.avg("ks"), F.lit(0.0)).alias("ks"))
    return out.withColumn("drift", F.greatest("psi", "ks") > threshold)


# --- sequential detectors -------------------------------------------------------------------


# Count, mean and the two sums of a detector that has seen nothing, as its state.
STATE = ("s0", "s1", "s2", "s3")
START = (0.0, 0.0, 0.0, 0.0)
# Values looked at together first; the stretch doubles until an alarm.
STRETCH = 256


def _off_mean(values, count: float, mean: float):
    """Counts, running means and distances of each value from the mean that includes it."""
    import numpy as np

    counts = count + np.arange(1, len(values) + 1)
    means = (mean * count + np.cumsum(values)) / counts
    return counts, means, values - means


def page_hinkley_levels(values, state, delta=0.005, threshold=50.0, min_samples=30):
    """The sum of distances less ``delta`` over its lowest level so far, which alarms above ``threshold``
    once there are ``min_samples``; with the states after each value."""
    import numpy as np

    counts, means, off = _off_mean(values, state[0], state[1])
    total = state[2] + np.cumsum(off - delta)
    floor = np.minimum(np.minimum.accumulate(total), state[3])
    return (total - floor > threshold) & (counts >= min_samples), (counts, means, total, floor)


def cusum_levels(values, state, drift=0.0, threshold=5.0):
    """Two sums that 0 holds from below and from above, of distances less and plus ``drift``; either alarms
    beyond ``threshold``.  A sum held at 0 is a free sum over its lowest level below 0."""
    import numpy as np

    counts, means, off = _off_mean(values, state[0], state[1])
    free = state[2] + np.cumsum(off - drift), state[3] + np.cumsum(off + drift)
    upper = free[0] - np.minimum(np.minimum.accumulate(free[0]), 0.0)
    lower = free[1] - np.maximum(np.maximum.accumulate(free[1]), 0.0)
    return (upper > threshold) | (lower < -threshold), (counts, means, upper, lower)


RULES = {"page_hinkley": page_hinkley_levels, "cusum": cusum_levels}


def alarm_places(values, state: tuple, rule: str, **settings) -> tuple[list[int], tuple]:
    """Places of alarms in ``values`` and the state after them; an alarm starts the detector anew.

    A stretch of values is taken at once up to its first alarm."""
    places, at, width = [], 0, STRETCH
    while at < len(values):
        part = values[at : at + width]
        hits, states = RULES[rule](part, state, **settings)
        if hits.any():
            first = int(hits.argmax())
            places.append(at + first)
            state, at, width = START, at + first + 1, STRETCH
        else:
            state, at, width = tuple(float(s[-1]) for s in states), at + len(part), 2 * width
    return places, state


def change_alarms(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rule: str, **settings) -> DataFrame:
    """Rows at which the detector (``page_hinkley`` or ``cusum``) raised an alarm.

    The detectors reset on alarm, so their state must pass from row to row; long keys are
    walked block by block with only the state handed on.
    """

    def step(pdf, state):
        before = START if state is None else tuple(float(s) for s in state)
        places, after = alarm_places(pdf[value].to_numpy(dtype=float), before, rule, **settings)
        return pdf.iloc[places], after

    cols = [*keys, *order, value]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*cols).schema)
    return scan_in_rounds(df, keys, order, step, out, STATE, [value])
