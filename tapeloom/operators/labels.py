"""Triple-barrier labels, sample weights, folds, curriculum phases and augmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.ordered import over_rows, quantiles, row_index
from tapeloom.operators.warping import _warped_costs, warped_partner  # noqa: F401  (tests name them here)


def _c(name: str) -> Column:
    return F.col(name)


def triple_barrier(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], price: str, spread: str | None,
    hold: int, take_mult: float = 1.0, stop_mult: float = 1.0, horizons: Sequence[int] = (5, 20),
) -> DataFrame:
    """Barrier levels, steps to each barrier, the meta label and direction labels.

    A barrier not touched within the horizon gets horizon length + 1.  Without a usable
    spread, 0.1 % of the price stands in for it.
    """
    step = F.abs(price) * 0.001 if spread is None else F.coalesce(_c(spread), F.lit(0.0))
    df = df.withColumns({"take_profit": _c(price) + take_mult * step, "stop_loss": _c(price) - stop_mult * step})

    def first_hit(test):
        ahead = F.transform(_c("_f"), lambda v, j: F.when(test(v), j + 1))
        return F.coalesce(F.array_min(F.array_compact(ahead)), F.size("_f") + 1)

    def build(rows, lay):
        rows = rows.withColumn("_f", F.collect_list(price).over(lay.rows(1, hold)))
        rows = rows.withColumns(
            {
                "horizon_len": F.size("_f"),
                "tp_time": first_hit(lambda v: v >= _c("take_profit")),
                "sl_time": first_hit(lambda v: v <= _c("stop_loss")),
            }
        )
        meta = (_c("tp_time") <= _c("sl_time")) & (_c("tp_time") <= _c("horizon_len"))
        w = lay.ordered()
        later = {
            f"label_h{h}": F.coalesce((F.lead(price, h).over(w) > _c(price)).cast("double"), F.lit(0.0)) for h in horizons
        }
        return rows.withColumns({"meta_label": meta.cast("double"), **later}).drop("_f")

    return over_rows(df, keys, order, build, after=max(hold, *horizons))


def profit_weights(df: DataFrame, profit: str, name: str = "profit_weight") -> DataFrame:
    """|profit| over the median of its non-zero values, within [0, 10]; all-zero gives 1."""
    size = F.abs(_c(profit))
    med = quantiles(df.select(F.when(size > 0, size).alias("_a")).filter("_a IS NOT NULL"), [], "_a", {"_med": 0.5})
    top = df.agg(F.max(size).alias("_top"))
    rows = df.join(F.broadcast(med)).join(F.broadcast(top))  # one row each
    value = F.least(F.coalesce(F.try_divide(size, _c("_med")), F.lit(0.0)), F.lit(10.0))
    return rows.withColumn(name, F.when(_c("_top") > 0, value).otherwise(1.0)).drop("_med", "_top")


def decay_weights(df: DataFrame, time: str, half_life_days: float, name: str = "decay_weight") -> DataFrame:
    """0.5^(age / half-life) in whole seconds; missing times take the smallest weight."""
    if half_life_days <= 0:
        return df.withColumn(name, F.lit(1.0))
    ends = df.agg(F.max(time).alias("_hi"), F.min(time).alias("_lo"))

    def decay(t):
        age = F.floor((_c("_hi") - t) / 1_000_000) / 86400.0
        return F.pow(F.lit(0.5), age / half_life_days)

    rows = df.join(F.broadcast(ends))  # one row
    return rows.withColumn(name, F.coalesce(decay(_c(time)), decay(_c("_lo")), F.lit(1.0))).drop("_hi", "_lo")


def normalised(df: DataFrame, weight: str, name: str) -> DataFrame:
    clean = F.coalesce(F.nanvl(_c(weight), F.lit(0.0)), F.lit(0.0))
    mean = df.agg(F.avg(clean).alias("_mean"))
    return df.join(F.broadcast(mean)).withColumn(  # one row
        name, F.when(_c("_mean") > 0, F.try_divide(clean, _c("_mean"))).otherwise(1.0)
    ).drop("_mean")


def sample_weights(df: DataFrame, keys, order, profit: str, time: str, half_life_days: float, use_volatility: bool = True) -> DataFrame:
    """Profit, decay and volatility weights combined, scaled to unit mean."""
    from tapeloom.operators.windows import volatility_scaler

    rows = decay_weights(profit_weights(df, profit), time, half_life_days)
    weight = _c("profit_weight") * _c("decay_weight")
    if use_volatility:
        rows = volatility_scaler(rows, keys, order, profit)
        weight = weight * _c("vol_scaler")
    return normalised(rows.withColumn("raw_weight", weight), "raw_weight", "weight")


def weight_summary(df: DataFrame, weight: str) -> DataFrame:
    return df.agg(F.min(weight).alias("min"), F.max(weight).alias("max"), F.avg(weight).alias("mean"), F.stddev_pop(weight).alias("std"))


def purged_folds(df: DataFrame, order: Sequence[str], n_splits: int, gap: int = 1) -> DataFrame:
    """(row, fold, role): everything before a point trains, the block after the gap validates."""
    total = df.count()
    size = total // (n_splits + 1)
    if size == 0:
        raise ValueError("too few rows for the number of splits")
    rows = row_index(df, [], order, "row_index")
    i = _c("row_index")
    roles = []
    for k in range(n_splits):
        train_end = size * (k + 1)
        start = train_end + gap
        if start >= total:
            break
        role = F.when(i < train_end, "train").when((i >= start) & (i < start + size), "validation")
        roles.append(F.when(role.isNotNull(), F.struct(F.lit(k).alias("fold"), role.alias("role"))))
    return rows.withColumn("_f", F.explode(F.array_compact(F.array(*roles)))).select(
        *[c for c in rows.columns], _c("_f.fold").alias("fold"), _c("_f.role").alias("role")
    )


def holdout(df: DataFrame, order: Sequence[str], max_splits: int = 5) -> DataFrame:
    """Chronological hold-out: the last of at most ``max_splits`` expanding splits."""
    total = df.count()
    splits = min(max_splits, total - 1)
    size = total // (splits + 1)
    rows = row_index(df, [], order, "row_index")
    return rows.withColumn("role", F.when(_c("row_index") >= total - size, "validation").otherwise("train"))


def pick_label(df: DataFrame, profit: str, label: str) -> DataFrame:
    """profit > 0, or the label column when all profits have one sign."""
    both = df.agg((F.count_if(_c(profit) > 0) > 0).alias("_u"), (F.count_if(_c(profit) <= 0) > 0).alias("_d"))
    return df.join(F.broadcast(both)).withColumn(  # one row
        "y", F.when(_c("_u") & _c("_d"), (_c(profit) > 0).cast("int")).otherwise(_c(label).cast("int"))
    ).drop("_u", "_d")


def curriculum(df: DataFrame, row_id: str, features: Sequence[str], profit: str, steps: int) -> DataFrame:
    """Phase 1..steps by rising difficulty = deviation of the features + |profit|.

    Near-equal parts, the first ones one row larger when the count does not divide.
    """
    total = df.count()
    vec = [_c(f).cast("double") for f in features]
    mean = sum(vec[1:], vec[0]) / len(vec)
    var = sum(((v - mean) * (v - mean) for v in vec[1:]), (vec[0] - mean) * (vec[0] - mean)) / len(vec)
    rows = df.withColumn("difficulty", F.sqrt(var) + F.abs(profit))
    rows = row_index(rows, [], ["difficulty", row_id], "_i")
    part, extra = divmod(total, steps)
    cut = extra * (part + 1)
    phase = F.when(_c("_i") < cut, F.floor(_c("_i") / (part + 1))).otherwise(
        extra + F.floor((_c("_i") - cut) / max(part, 1))
    )
    return rows.withColumn("phase", phase.cast("int") + 1).drop("_i")


def sentiment_views(df: DataFrame, vector: str) -> DataFrame:
    """Scalar view (mean of the components) next to the embedding columns."""
    total = F.aggregate(_c(vector).cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("sentiment_score", F.try_divide(total, F.size(vector)))


def task_sizes(df: DataFrame, symbol: str, label: str) -> DataFrame:
    """Per-symbol tasks: rows and positives."""
    return df.groupBy(symbol).agg(F.count(F.lit(1)).alias("rows"), F.sum(label).alias("positives"))


def feature_matrix(df: DataFrame, row_id: str, numeric: Sequence[str], texts: Sequence[str], vocabulary: DataFrame | None = None) -> DataFrame:
    """Long sparse matrix (row, feature, value): numbers as they are, texts as ``name=value``.

    Absent cells are zeros and not stored, so that the width does not grow the rows.
    """
    cells = [F.struct(F.lit(c).alias("feature"), _c(c).cast("double").alias("value")) for c in numeric]
    cells += [F.struct(F.concat(F.lit(f"{c}="), _c(c)).alias("feature"), F.lit(1.0).alias("value")) for c in texts]
    return df.select(row_id, F.explode(F.array(*cells)).alias("e")).select(row_id, "e.feature", "e.value").filter(
        _c("value").isNotNull() & _c("feature").isNotNull() & (_c("value") != 0)
    )


# --- augmentation ---------------------------------------------------------------------------


def _uniform(*parts) -> Column:
    """A uniform in (0, 1) that is a fixed function of its inputs."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) + 0.5) / float(1 << 53)


def _beta(row: str, shape: float, seed: int, trials: int = 24) -> Column:
    """A Beta(shape, shape) draw per row as a fixed function of its number (Johnk's method).

    Of pairs x = u^(1/shape), y = v^(1/shape) the first with x + y <= 1 gives x / (x + y).  A pair fails
    with probability 0.16 for a shape of 0.4, so that none is left after ``trials``.
    """
    def pair(i):
        x, y = (F.pow(_uniform(row, F.lit(seed), F.lit(1000 + 2 * i + j)), F.lit(1 / shape)) for j in (0, 1))
        return F.when(x + y <= 1, x / (x + y))

    return F.coalesce(*[pair(i) for i in range(trials)], F.lit(0.5))


def mixup(df: DataFrame, order: Sequence[str], columns: Sequence[str], time: str, ratio: float = 0.5, seed: int = 0) -> DataFrame:
    """Original rows plus ``ratio`` times as many mixtures of two random rows.

    Weight ~ Beta(0.4, 0.4), noise of 1 % of each column's deviation, time moved by up to a
    minute.  Every draw hashes the new row's number, so recomputed tasks agree.
    """
    rows = row_index(df, [], order, "_i")
    total = df.count()
    n_new = int(total * ratio)
    if n_new == 0:
        return df.withColumn("is_synthetic", F.lit(False))
    devs = df.agg(*[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    new = df.sparkSession.range(n_new).withColumnRenamed("id", "_k").withColumns(
        {"_a": F.floor(_uniform("_k", F.lit(seed), F.lit(1)) * total), "_b": F.floor(_uniform("_k", F.lit(seed), F.lit(2)) * total)}
    )

    new = new.withColumn("_lam", _beta("_k", 0.4, seed))
    cols = [*columns, time]
    left = rows.select(_c("_i").alias("_a"), *[_c(c).alias(f"_x_{c}") for c in cols])
    right = rows.select(_c("_i").alias("_b"), *[_c(c).alias(f"_y_{c}") for c in cols])
    pairs = new.join(left, "_a").join(right, "_b").join(F.broadcast(devs))  # one row

    def normal(i):
        return F.sqrt(-2 * F.log(_uniform("_k", F.lit(seed), F.lit(100 + 2 * i)))) * F.cos(
            2 * F.pi() * _uniform("_k", F.lit(seed), F.lit(101 + 2 * i))
        )

    lam = _c("_lam")
    out = pairs.select(
        *[
            (lam * _c(f"_x_{c}") + (1 - lam) * _c(f"_y_{c}") + normal(i) * 0.01 * _c(f"_s_{c}")).alias(c)
            for i, c in enumerate(columns)
        ],
        (_c(f"_x_{time}") + F.floor((_uniform("_k", F.lit(seed), F.lit(3)) * 2 - 1) * 60_000_000)).cast("long").alias(time),
        F.lit(True).alias("is_synthetic"),
    )
    return df.select(*columns, time).withColumn("is_synthetic", F.lit(False)).unionByName(out)
