"""Model fitting and model-based analysis on Spark.

Fits run as MLlib estimators or as repeated aggregations over the rows; only matrices whose
side is the number of features or symbols reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, RobustScaler, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.formula import evaluate_spec, spec_complexity
from tapeloom.functions.scoring import fit_clip, mahalanobis, sigmoid, total
from tapeloom.operators.classify import auc
from tapeloom.operators.graph import correlation_matrix, pair_sums
from tapeloom.operators.labels import purged_folds
from tapeloom.operators.ordered import drawdown, over_rows, quantiles
from tapeloom.session import pin


def _c(name: str) -> Column:
    return F.col(name)


def assembled(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    clean = df.withColumns({f: F.coalesce(_c(f).cast("double"), F.lit(0.0)) for f in features})
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(clean)


# --- classifiers ----------------------------------------------------------------------------


def classifier(name: str, features: Sequence[str], label: str, weight: str | None = None, **settings) -> Pipeline:
    """Pipeline of a classifier by registered name."""
    from tapeloom.registry import MODELS

    stages = [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")]
    stages.append(MODELS.get(name)(label, weight, **settings))
    return Pipeline(stages=stages)


def fit_classifier(train: DataFrame, name: str, features: Sequence[str], label: str, weight: str | None = None, C: float = 1.0, **settings) -> PipelineModel:
    """Fit a classifier on features clipped to their 1 % and 99 % quantiles, centred and scaled robustly.

    For logistic regression ``C`` weighs the summed loss against half the squared coefficients, as other
    libraries have it; MLlib averages the loss, so its penalty is 1 / (C * sum of weights).  Null features
    count as 0.
    """
    from tapeloom.registry import MODELS

    filled = train.withColumns({f: F.coalesce(_c(f).cast("double"), F.lit(0.0)) for f in features})
    bounds = fit_clip(filled, features)
    if name == "logreg":
        mass = train.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0]
        settings = {"standardization": False, "regParam": 1.0 / (C * float(mass)), **settings}
    clipped = ", ".join(
        f"least(greatest(coalesce(cast(`{f}` AS double), 0D), {lo!r}D), {hi!r}D) AS `_clipped_{f}`" for f, (lo, hi) in bounds.items()
    )
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {clipped} FROM __THIS__"),
        VectorAssembler(inputCols=[f"_clipped_{f}" for f in features], outputCol="_clipped"),
        RobustScaler(inputCol="_clipped", outputCol="features", withCentering=True),
        MODELS.get(name)(label, weight, **settings),
    ]).fit(train)


def positive_probability(df: DataFrame, name: str = "p") -> DataFrame:
    return df.withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def fold_fits(df: DataFrame, order: Sequence[str], features: Sequence[str], label: str, weight: str | None, model: str = "logreg", n_splits: int = 3, gap: int = 1, **settings) -> DataFrame:
    """Out-of-fold probabilities of purged walk-forward fits: (order, label, fold, p)."""
    rows = pin(purged_folds(df, order, n_splits, gap))
    out = None
    for k in range(n_splits):
        part = rows.filter(_c("fold") == k)
        fitted = fit_classifier(part.filter("role = 'train'"), model, features, label, weight, **settings)
        scored = positive_probability(fitted.transform(part.filter("role = 'validation'")))
        scored = scored.select(*order, _c(label).alias("y"), "fold", "p")
        out = scored if out is None else out.unionByName(scored)
    return out


def isotonic_calibration(scored: DataFrame) -> dict:
    """Isotonic map of probabilities as breakpoints, usable by ``scoring.calibrated``."""
    model = IsotonicRegression(labelCol="y", featuresCol="p").fit(scored.select(_c("y").cast("double").alias("y"), "p"))
    return {"method": "isotonic", "x": model.boundaries.toArray().tolist(), "y": model.predictions.toArray().tolist()}


def voting_probability(df: DataFrame, models: Mapping[str, PipelineModel], weights: Mapping[str, float]) -> DataFrame:
    """Weighted mean of the probabilities of several fitted models."""
    kept = df.columns
    for name, model in models.items():
        df = positive_probability(model.transform(df), f"_p_{name}").select(*df.columns, f"_p_{name}")
    p = total([_c(f"_p_{n}") * float(weights[n]) for n in models]) / float(sum(weights[n] for n in models))
    return df.select(*kept, p.alias("p"))


def grid_evaluation(df: DataFrame, order: Sequence[str], features: Sequence[str], label: str, profit: str, model: str, grid: Sequence[Mapping], max_drawdown: float | None = None, penalty: float = 0.0, var_limit: float | None = None, weight: str | None = None) -> DataFrame:
    """Out-of-fold AUC per parameter set, skipping sets that breach the drawdown or value-at-risk limit.

    The value at risk is the 5 % quantile of the returns taken, with its sign turned."""
    spark, rows = df.sparkSession, []
    for i, settings in enumerate(grid):
        scored = pin(fold_fits(df, order, features, label, weight, model, **settings).join(df.select(*order, profit), list(order)))
        taken = scored.withColumn("_r", F.when(_c("p") >= 0.5, _c(profit)).otherwise(0.0))
        area = auc(scored).first()["roc_auc"]
        worst = drawdown(taken, [], order, "_r").first()["max_drawdown"]
        at_risk = -(quantiles(taken, [], "_r", {"q": 0.05}).first()["q"] or 0.0)
        ok = (max_drawdown is None or worst <= max_drawdown) and (var_limit is None or at_risk <= var_limit)
        score = (area if area is not None else 0.0) - penalty * worst
        rows.append((i, str(dict(settings)), float(area or 0.0), float(worst), float(at_risk), bool(ok), float(score)))
    table = spark.createDataFrame(rows, "param_set int, settings string, roc_auc double, max_drawdown double, var_95 double, within_limits boolean, score double")
    best = table.filter("within_limits").agg(F.max_by("param_set", F.struct("score", -_c("param_set"))).alias("_b"))
    return table.join(F.broadcast(best)).withColumn("best", F.coalesce(_c("param_set") == _c("_b"), F.lit(False))).drop("_b")  # one row


# --- clustering and reduction ---------------------------------------------------------------


def regimes(df: DataFrame, features: Sequence[str], k: int = 3, seed: int = 0) -> tuple[DataFrame, PipelineModel]:
    """Rows with their regime, from standardised features and k-means."""
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_v"),
        StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True),
        KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="regime"),
    ])
    model = pipe.fit(df)
    return model.transform(df).drop("_v", "_z"), model


def regime_gate(assigned: DataFrame, features: Sequence[str]) -> PipelineModel:
    """Multinomial gate predicting the regime from the features."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features"),
        LogisticRegression(family="multinomial", labelCol="regime", predictionCol="gate"),
    ]).fit(assigned)


def linear_autoencoder(df: DataFrame, features: Sequence[str], k: int) -> dict:
    """Principal components as encoder and decoder: mean and component rows."""
    rows = assembled(df, features, "_v")
    mean = [float(x) for x in rows.agg(*[F.avg(f) for f in features]).first()]
    pc = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows).pc.toArray()
    return {"mean": mean, "components": pc.T.tolist()}


# --- covariance and feature selection -------------------------------------------------------


def _moments(df: DataFrame, features: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean, covariance and the mean of products of squared deviations; rows with a null have no part."""
    x = [_c(f).cast("double").alias(f) for f in features]
    clean = df.select(*x).dropna()
    sums, at = pair_sums(clean, features)
    p, n = len(features), 0
    first, second, fourth = np.zeros((p, p)), np.zeros((p, p)), np.zeros((p, p))
    for r in sums.collect():  # features x features rows
        i, j, n = r["i"], r["j"], int(r["n"])
        first[i, j], second[i, j], fourth[i, j] = r["si"], r["sij"], r["siijj"]
    mean = np.array(at, dtype=float)
    if not n:
        return 0, mean, second, fourth
    return n, mean + np.diag(first) / n, second / n - np.outer(np.diag(first), np.diag(first)) / n**2, fourth / n


def shrinkage_covariance(df: DataFrame, features: Sequence[str]) -> dict:
    """Covariance shrunk towards a scaled identity by the Ledoit-Wolf rule, and its inverse."""
    n, mean, cov, fourth = _moments(df, features)
    p = len(features)
    mu = np.trace(cov) / p
    spread = ((cov - mu * np.eye(p)) ** 2).sum()
    noise = (fourth - cov**2).sum() / max(n, 1)
    shrink = 0.0 if spread == 0 else min(1.0, noise / spread)
    out = (1 - shrink) * cov + shrink * mu * np.eye(p)
    return {"mean": mean.tolist(), "covariance": out.tolist(), "precision": np.linalg.pinv(out).tolist(), "shrinkage": float(shrink)}


def fold_ood(df: DataFrame, order: Sequence[str], features: Sequence[str], n_splits: int = 3, gap: int = 1) -> DataFrame:
    """Per fold: distance threshold (99 %), rate above it and above the median threshold."""
    folds = purged_folds(df, order, n_splits, gap)
    scored = None
    for k in range(n_splits):
        part = folds.filter(_c("fold") == k)
        est = shrinkage_covariance(part.filter("role = 'train'"), features)
        dist = mahalanobis([_c(f).cast("double") for f in features], est["mean"], est["precision"])
        one = part.filter("role = 'validation'").select("fold", dist.alias("score"))
        scored = one if scored is None else scored.unionByName(one)
    cuts = quantiles(scored, ["fold"], "score", {"threshold": 0.99})  # one row per fold
    overall = cuts.agg(F.median("threshold").alias("ood_threshold"))
    rows = scored.join(F.broadcast(cuts), "fold").join(F.broadcast(overall))
    return rows.groupBy("fold").agg(
        F.first("threshold").alias("threshold"), F.first("ood_threshold").alias("ood_threshold"),
        F.avg((_c("score") > _c("threshold")).cast("double")).alias("fold_rate"),
        F.avg((_c("score") > _c("ood_threshold")).cast("double")).alias("agg_rate"),
    )


def _matrix(df: DataFrame, features: Sequence[str], what: str) -> np.ndarray:
    at = {f: i for i, f in enumerate(features)}
    out = np.eye(len(features)) if what == "correlation" else np.zeros((len(features),) * 2)
    for r in correlation_matrix(df, features).collect():
        out[at[r["a"]], at[r["b"]]] = r[what] if r[what] is not None else 0.0
    return out


def vif(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Variance inflation factors: diagonal of the inverse correlation matrix."""
    corr = _matrix(df, features, "correlation")
    if np.linalg.matrix_rank(corr, tol=1e-10) < len(features):
        values = []
        for i in range(len(features)):
            rest = [j for j in range(len(features)) if j != i]
            r2 = corr[i, rest] @ np.linalg.pinv(corr[np.ix_(rest, rest)], rcond=1e-10) @ corr[rest, i]
            values.append(float("inf") if r2 >= 1 - 1e-10 else 1.0 / (1.0 - r2))
    else:
        values = np.diag(np.linalg.inv(corr)).tolist()
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, vif double")


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 16) -> DataFrame:
    """Mutual information of each binned feature with the label, from joint counts."""
    from tapeloom.operators.drift import melt

    cells = melt(df, features, keep=[label])
    names = {f"q{i}": i / bins for i in range(1, bins)}
    cuts = quantiles(cells, ["feature"], "value", names).select("feature", F.array_distinct(F.array(*names)).alias("cuts"))
    binned = cells.join(F.broadcast(cuts), "feature").withColumn("bin", F.size(F.filter("cuts", lambda c: c <= _c("value"))))  # one row per feature
    joint = binned.groupBy("feature", "bin", label).agg(F.count(F.lit(1)).alias("n"))
    # at most bins x classes rows per feature from here
    from pyspark.sql import Window

    def over(*k):
        return F.sum("n").over(Window.partitionBy("feature", *k))

    return joint.select(
        "feature", (_c("n") / over() * F.ln(_c("n") * over() / (over("bin") * over(label)))).alias("_t")
    ).groupBy("feature").agg(F.sum("_t").alias("mutual_information"))


def _linkage(dist: np.ndarray, cut: float = np.inf) -> list[list[int]]:
    """Average-linkage clusters, merged while closer than ``cut``; members stand in merging order.

    The mean distance of a merged cluster to the others is the size-weighted mean of its parts', so a
    merge updates one row of the matrix.
    """
    n = len(dist)
    far = dist.astype(float).copy()
    np.fill_diagonal(far, np.inf)
    sizes, members, born = np.ones(n), [[i] for i in range(n)], np.arange(n)
    for merge in range(n - 1):
        # Ties: the pair of the oldest clusters, as counted by when they were made.
        at = np.argwhere(far <= far.min())
        i, j = min(at.tolist(), key=lambda x: sorted((born[x[0]], born[x[1]])))
        i, j = sorted((i, j), key=lambda k: born[k])
        if not far[i, j] <= cut:
            break
        row = (sizes[i] * far[i] + sizes[j] * far[j]) / (sizes[i] + sizes[j])
        far[i], far[:, i], far[i, i] = row, row, np.inf
        far[j], far[:, j] = np.inf, np.inf
        members[i] += members[j]
        members[j] = []
        sizes[i] += sizes[j]
        born[i] = n + merge
    order = sorted((k for k in range(n) if members[k]), key=lambda k: born[k])
    return [members[k] for k in order]


def prune_correlated(df: DataFrame, features: Sequence[str], label: str, limit: float = 0.9) -> DataFrame:
    """(feature, cluster, kept): of each cluster of correlated features the most informative stays."""
    corr = _matrix(df, features, "correlation")
    info = {r["feature"]: r["mutual_information"] for r in mutual_information(df, features, label).collect()}
    rows = []
    for c, group in enumerate(_linkage(1.0 - np.abs(corr), 1.0 - limit)):
        keep = max(group, key=lambda i: (info.get(features[i], 0.0), -i))
        rows += [(features[i], c, i == keep) for i in group]
    return df.sparkSession.createDataFrame(rows, "feature string, cluster int, kept boolean")


def _halvings(n: int) -> list[np.ndarray]:
    """Level by level, rows (start, middle, end) of the segments that halve 0..n down to single places."""
    levels, now = [], np.array([[0, n]])
    while len(now := now[now[:, 1] - now[:, 0] > 1]):
        middle = now.sum(axis=1) // 2
        levels.append(np.column_stack([now[:, 0], middle, now[:, 1]]))
        now = np.concatenate([np.column_stack([now[:, 0], middle]), np.column_stack([middle, now[:, 1]])])
    return levels


def risk_parity(returns: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Hierarchical risk parity weights from returns; only the asset matrix is on the driver.

    Assets are put in the order of average-linkage clusters.  A segment's risk is the variance of its
    inverse-variance portfolio, read off two-dimensional running sums; each level of halvings then
    multiplies all weights by the share of their half.  Assets without variance share as if they had
    the least variance of any.
    """
    cov, corr = _matrix(returns, assets, "covariance"), _matrix(returns, assets, "correlation")
    order = np.array([i for group in _linkage(np.sqrt(np.maximum(0.5 * (1.0 - corr), 0.0))) for i in group])
    cov = cov[np.ix_(order, order)]
    variance = np.diag(cov).copy()
    least = variance[variance > 0].min(initial=np.inf)
    variance[variance <= 0] = least if np.isfinite(least) else 1.0
    inverse = 1.0 / variance
    scaled = np.pad((cov * np.outer(inverse, inverse)).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    mass = np.concatenate(([0.0], inverse.cumsum()))

    def risk(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (scaled[b, b] - scaled[a, b] - scaled[b, a] + scaled[a, a]) / (mass[b] - mass[a]) ** 2

    weight = np.ones(len(assets))
    for level in _halvings(len(assets)):
        left, right = risk(level[:, 0], level[:, 1]), risk(level[:, 1], level[:, 2])
        total = np.where(left + right > 0, left + right, 1.0)
        to_left = np.where(left + right > 0, right / total, 0.5)
        for (start, middle, end), share in zip(level, to_left):
            weight[start:middle] *= share
            weight[middle:end] *= 1.0 - share
    weight /= weight.sum()
    named = sorted(zip(order.tolist(), weight.tolist()))
    return returns.sparkSession.createDataFrame([(assets[i], w) for i, w in named], "asset string, weight double")


# --- explanation ----------------------------------------------------------------------------


def linear_attribution(df: DataFrame, coefficients: Mapping[str, float]) -> DataFrame:
    """|coefficient| x deviation, and mean |x x coefficient| against a zero baseline, ranked."""
    stats = df.agg(
        *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(coefficients)],
        *[F.avg(F.abs(_c(f) * float(w))).alias(f"g{i}") for i, (f, w) in enumerate(coefficients.items())],
    )
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), (_c(f"s{i}") * abs(float(w))).alias("importance"), _c(f"g{i}").alias("integrated_gradient"))
        for i, (f, w) in enumerate(coefficients.items())
    ])
    return stats.select(F.explode(cells).alias("e")).select("e.*").orderBy(_c("importance").desc(), "feature")


def partial_dependence(df: DataFrame, feature: str, grid: Sequence[float], score: Callable[[Column], Column]) -> DataFrame:
    """Mean score with the feature set to each grid value; all grid points in one pass."""
    row = df.agg(*[F.avg(score(F.lit(float(v)))).alias(f"a{i}") for i, v in enumerate(grid)])
    cells = F.array(*[F.struct(F.lit(float(v)).alias("value"), _c(f"a{i}").alias("average")) for i, v in enumerate(grid)])
    return row.select(F.explode(cells).alias("e")).select(F.lit(feature).alias("feature"), "e.*")


def permutation_importance(df: DataFrame, row_id: str, features: Sequence[str], label: str, score: Callable[[Mapping[str, Column]], Column], seed: int = 0) -> DataFrame:
    """Loss of accuracy when one feature is shuffled by a hashed order of the rows."""
    from tapeloom.operators.ordered import row_index

    base = row_index(df, [], [row_id], "_i")
    whole = {f: _c(f) for f in features}

    def accuracy(rows, cols):
        return rows.agg(F.avg(((score(cols) >= 0.5).cast("int") == _c(label)).cast("double")).alias("a"))

    plain = accuracy(base, whole).withColumnRenamed("a", "_plain")
    out = None
    for k, f in enumerate(features):
        mixed = df.select(_c(row_id), _c(f).alias("_x")).withColumn("_h", F.xxhash64(row_id, F.lit(seed), F.lit(k)))
        mixed = row_index(mixed, [], ["_h", row_id], "_i").select("_i", "_x")
        one = accuracy(base.join(mixed, "_i"), {**whole, f: _c("_x")}).select(F.lit(f).alias("feature"), _c("a"))
        out = one if out is None else out.unionByName(one)
    return out.join(F.broadcast(plain)).select("feature", (_c("_plain") - _c("a")).alias("importance"))  # one row


# --- regression -----------------------------------------------------------------------------


def heteroscedastic(df: DataFrame, features: Sequence[str], target: str, weight: str | None = None, kind: str = "linear") -> DataFrame:
    """Rows with the predicted mean and log-variance: a second fit on log squared residuals."""
    rows = assembled(df, features, "_v")
    make = {"linear": LinearRegression, "gbrt": GBTRegressor}[kind]
    extra = {"weightCol": weight} if weight else {}
    mean = make(featuresCol="_v", labelCol=target, predictionCol="mean", **extra).fit(rows)
    rows = mean.transform(rows).withColumn("_lr", F.ln(F.pow(_c(target) - _c("mean"), 2) + 1e-6))
    var = make(featuresCol="_v", labelCol="_lr", predictionCol="log_variance", **extra).fit(rows)
    return var.transform(rows).drop("_v", "_lr")


# Widths of the smoothed corner of the loss, in deviations of the target, from wide to narrow; rounds per width.
CORNERS, ROUNDS = (0.5, 0.1, 0.02, 0.004, 0.0008, 0.00016), 25


def quantile_regression(df: DataFrame, features: Sequence[str], target: str, quantiles: Sequence[float] | float = (0.05, 0.5, 0.95), tolerance: float = 1e-6) -> list[dict] | dict:
    """Linear fits of several quantiles at once, to the optimum: ``quantile, coefficients, intercept``; of one
    quantile given as a number, its fit alone.

    The corner of the loss at 0 is rounded over a width that shrinks step by step, which makes the loss
    twice differentiable and its optimum move to the exact one; each width starts from the optimum of the
    one before.  A round is one aggregation for all quantiles: the loss at the starting point and, summed
    up, gradient and curvature; a Newton step that does not lower the loss is halved, and rounds at a width
    end when the mean gradient is below ``tolerance``.  Features and target are scaled to deviations first;
    rows with a null in them take no part.  What is summed has the size of the features squared, whatever the rows.
    """
    stats = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate([*features, target]) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    size = len(features) + 1
    shift = np.array([stats[f"m_{i}"] or 0.0 for i in range(size)])
    scale = np.array([stats[f"s_{i}"] or 1.0 for i in range(size)])
    xs = [*[(_c(c) - float(shift[i])) / float(scale[i]) for i, c in enumerate(features)], F.lit(1.0)]
    y = (_c(target) - float(shift[-1])) / float(scale[-1])
    rows = pin(df.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)], y.alias("y")).dropna())
    names = [f"x{i}" for i in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]

    def summed(points: dict[float, np.ndarray], width: float) -> dict[float, tuple]:
        parts = []
        for n, (q, b) in enumerate(points.items()):
            r = _c("y") - total([_c(x) * float(v) for x, v in zip(names, b)])
            inside = F.abs(r) < width
            share = F.when(r >= width, q).when(r <= -width, q - 1).otherwise(q - 0.5 + r / (2 * width))
            # The check loss, and inside the corner the parabola that meets it at both ends.
            loss = F.when(inside, (q - 0.5) * r + (r * r + width * width) / (4 * width)).otherwise(F.when(r >= 0, q * r).otherwise((q - 1) * r))
            parts += [F.avg(loss).alias(f"l{n}"), *[F.avg(share * _c(x)).alias(f"g{n}_{i}") for i, x in enumerate(names)]]
            parts += [F.avg(F.when(inside, _c(names[i]) * _c(names[j])).otherwise(0.0) / (2 * width)).alias(f"h{n}_{i}_{j}") for i, j in pairs]
        got = rows.agg(*parts).first()
        out = {}
        for n, q in enumerate(points):
            curve = np.zeros((size, size))
            for i, j in pairs:
                curve[i, j] = curve[j, i] = got[f"h{n}_{i}_{j}"] or 0.0
            out[q] = (got[f"l{n}"] or 0.0, np.array([got[f"g{n}_{i}"] or 0.0 for i in range(size)]), curve)
        return out

    best = {float(q): np.zeros(size) for q in ([quantiles] if isinstance(quantiles, float) else quantiles)}
    for width in CORNERS:
        state = summed(best, width)
        step = {q: 1.0 for q in best}
        for _ in range(ROUNDS):
            going = [q for q in best if np.abs(state[q][1]).max() > tolerance and step[q] > 1e-6]
            if not going:
                break
            tried = {}
            for q in going:
                _, gradient, curve = state[q]
                move = np.linalg.lstsq(curve + 1e-9 * np.eye(size), gradient, rcond=None)[0]
                # Far from the corner the curvature says little; a step stays within a few deviations.
                tried[q] = best[q] + step[q] * move * min(1.0, 3.0 / max(np.abs(move).max(), 1e-12))
            seen = summed(tried, width)
            for q in going:
                if seen[q][0] < state[q][0]:
                    best[q], state[q], step[q] = tried[q], seen[q], min(1.0, 2 * step[q])
                else:
                    step[q] /= 4
    out = []
    for q, b in best.items():
        coefficients = b[:-1] * scale[-1] / scale[:-1]
        out.append({"quantile": q, "coefficients": coefficients.tolist(), "intercept": float(b[-1] * scale[-1] + shift[-1] - coefficients @ shift[:-1])})
    return out[0] if isinstance(quantiles, float) else out


# --- shared starts and candidate strategies -------------------------------------------------


def shared_start(df: DataFrame, symbol: str, features: Sequence[str], label: str, rounds: int = 3, inner_steps: int = 5, inner_lr: float = 0.1, meta_lr: float = 0.1) -> tuple[list[float], DataFrame]:
    """Logistic weights all symbols start from, and the weights each symbol ends with.

    Every inner step is one aggregation of gradients by symbol, so a symbol of any size is
    summed map-side; the weight table has one row per symbol.
    """
    spark = df.sparkSession
    names = [f"w{i}" for i in range(len(features))]
    rows = df.select(symbol, _c(label).cast("double").alias("_y"), *features)
    ids = pin(rows.select(symbol).distinct())
    start, table = [0.0] * len(features), None
    for _ in range(rounds):
        table = ids.withColumns({n: F.lit(v) for n, v in zip(names, start)})
        for _ in range(inner_steps):
            joined = rows.join(table, symbol)
            miss = sigmoid(total([_c(f) * _c(n) for f, n in zip(features, names)])) - _c("_y")
            grad = joined.groupBy(symbol, *names).agg(*[F.avg(miss * _c(f)).alias(f"g{i}") for i, f in enumerate(features)])
            table = pin(grad.select(symbol, *[(_c(n) - inner_lr * _c(f"g{i}")).alias(n) for i, n in enumerate(names)]))
        mean = table.agg(*[F.avg(n).alias(n) for n in names]).first()
        start = [s + meta_lr * (float(mean[n]) - s) for s, n in zip(start, names)]
    return start, table


def evaluate_candidates(df: DataFrame, specs: Mapping[str, Mapping], order: Sequence[str], price: str) -> DataFrame:
    """Return, risk and complexity of every strategy spec on one price series."""
    rows, names = df, list(specs)
    for i, n in enumerate(names):
        rows = evaluate_spec(rows, specs[n], [], order, price, f"_pos{i}")

    def build(r, lay):
        move = F.lead(price).over(lay.ordered()) - _c(price)
        return r.withColumn("_move", move)

    rows = over_rows(rows, [], order, build, after=1).filter(_c("_move").isNotNull())
    cells = F.array(*[F.struct(F.lit(n).alias("candidate"), F.coalesce(_c(f"_pos{i}") * _c("_move"), F.lit(0.0)).alias("pnl")) for i, n in enumerate(names)])
    long = rows.select(*order, F.explode(cells).alias("e")).select(*order, "e.*")
    sums = long.groupBy("candidate").agg(F.sum("pnl").alias("ret"))
    risk = drawdown(long, ["candidate"], order, "pnl", "risk", from_zero=False)
    size = df.sparkSession.createDataFrame([(n, spec_complexity(specs[n])) for n in names], "candidate string, complexity int")
    return sums.join(risk, "candidate").join(F.broadcast(size), "candidate")  # one row per spec
