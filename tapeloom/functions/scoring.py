"""Scoring rows with stored model parameters, as generated column expressions.

A model is a mapping read from its JSON file; parameters are literals of the plan, their
number is the number of features.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.scalar import yeo_johnson
from tapeloom.operators.ordered import quantiles


def _c(name: str) -> Column:
    return F.col(name)


def total(terms: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def feature(name: str) -> Column:
    return F.coalesce(_c(name).cast("double"), F.lit(0.0))


def fit_clip(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> dict[str, tuple[float, float]]:
    """Clip bounds per column: exact quantiles of all columns in one pass over (column, value) rows."""
    from tapeloom.operators.drift import melt

    found = quantiles(melt(df, columns), ["feature"], "value", {"lo": low, "hi": high}).collect()  # one row per column
    by_name = {r["feature"]: (r["lo"], r["hi"]) for r in found}
    return {c: by_name.get(c, (None, None)) for c in columns}


def clip(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi)) for c, (lo, hi) in bounds.items()})


def prepared(model: Mapping) -> list[Column]:
    """Features clipped, power-transformed and standardised as the model asks."""
    cols = []
    power = model.get("power_transformer") or {}
    at = {n: i for i, n in enumerate(power.get("features", []))}
    for i, name in enumerate(model["feature_names"]):
        x = feature(name)
        if model.get("clip_low"):
            x = F.least(F.greatest(x, F.lit(float(model["clip_low"][i]))), F.lit(float(model["clip_high"][i])))
        if name in at:
            j = at[name]
            x = (yeo_johnson(x, float(power["lambdas"][j])) - float(power["mean"][j])) / (float(power["scale"][j]) or 1.0)
        if model.get("feature_mean"):
            x = (x - float(model["feature_mean"][i])) / (float(model["feature_std"][i]) or 1.0)
        cols.append(x)
    return cols


def linear_logit(model: Mapping, xs: Sequence[Column] | None = None) -> Column:
    xs = prepared(model) if xs is None else xs
    return total([x * float(w) for x, w in zip(xs, model["coefficients"])]) + float(model.get("intercept", 0.0))


def calibrated(logit: Column, probability: Column, calibration: Mapping | None) -> Column:
    """Platt scaling of the logit, or isotonic interpolation of the probability."""
    if not calibration:
        return probability
    if calibration["method"] in ("sigmoid", "platt"):
        return sigmoid(logit * float(calibration["coef"]) + float(calibration["intercept"]))
    xs, ys = [float(v) for v in calibration["x"]], [float(v) for v in calibration["y"]]
    out = F.when(probability <= xs[0], F.lit(ys[0]))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        if x1 > x0:
            out = out.when(probability <= x1, y0 + (probability - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(ys[-1]))


def mahalanobis(xs: Sequence[Column], mean: Sequence[float], precision: Sequence[Sequence[float]]) -> Column:
    d = [x - float(m) for x, m in zip(xs, mean)]
    square = total([d[i] * d[j] * float(precision[i][j]) for i in range(len(d)) for j in range(len(d)) if precision[i][j]])
    return F.sqrt(F.greatest(square, F.lit(0.0)))


def logistic_probability(model: Mapping) -> Column:
    xs = prepared(model)
    logit = linear_logit(model, xs)
    p = calibrated(logit, sigmoid(logit), model.get("calibration"))
    ood = model.get("ood")
    if ood:
        p = F.when(mahalanobis(xs, ood["mean"], ood["precision"]) > float(ood["threshold"]), 0.0).otherwise(p)
    return p


def expected_value(model: Mapping) -> Column:
    """Probability times the linear profit estimate."""
    pnl = total([x * float(w) for x, w in zip(prepared(model), model["pnl_coefficients"])]) + float(model.get("pnl_intercept", 0.0))
    return logistic_probability(model) * pnl


def encode(xs: Sequence[Column], weights: Sequence[Sequence[float]], bias: Sequence[float], mean: Sequence[float], scale: Sequence[float]) -> list[Column]:
    z = [(x - float(m)) / (float(s) or 1.0) for x, m, s in zip(xs, mean, scale)]
    return [total([v * float(w) for v, w in zip(z, row)]) + float(b) for row, b in zip(weights, bias)]


def tanh_network(xs: Sequence[Column], w1, b1, w2, b2) -> Column:
    """Two layers: tanh hidden units, logistic output."""
    hidden = [F.tanh(total([x * float(w) for x, w in zip(xs, row)]) + float(b)) for row, b in zip(w1, b1)]
    return sigmoid(total([h * float(w) for h, w in zip(hidden, w2)]) + float(b2))


def expert_mixture(xs: Sequence[Column], gate_xs: Sequence[Column], gates, experts) -> Column:
    """Expert probabilities weighted by a softmax gate; each entry is (weights, bias)."""
    scores = [total([x * float(w) for x, w in zip(gate_xs, ws)]) + float(b) for ws, b in gates]
    top = F.greatest(*scores)
    parts = [F.exp(s - top) for s in scores]
    probs = [sigmoid(total([x * float(w) for x, w in zip(xs, ws)]) + float(b)) for ws, b in experts]
    return total([g * p for g, p in zip(parts, probs)]) / total(parts)


def gate_choice(xs: Sequence[Column], gates) -> Column:
    """Index of the gate with the largest score; the first wins a tie."""
    scores = F.array(
        *[
            F.struct((-(total([x * float(w) for x, w in zip(xs, ws)]) + float(b))).alias("s"), F.lit(i).alias("i"))
            for i, (ws, b) in enumerate(gates)
        ]
    )
    return F.array_min(scores)["i"]


def weighted_ensemble(scores: Sequence[Column], weights: Sequence[float], threshold: float) -> Column:
    """Weighted mean of the scores, 0 below the threshold."""
    mean = total([s * float(w) for s, w in zip(scores, weights)]) / float(sum(weights))
    return F.when(mean >= threshold, mean).otherwise(0.0)


def reconstruction_error(xs: Sequence[Column], mean: Sequence[float], components: Sequence[Sequence[float]]) -> Column:
    """Mean squared error after projecting on the components and back."""
    z = [x - float(m) for x, m in zip(xs, mean)]
    codes = [total([v * float(w) for v, w in zip(z, row)]) for row in components]
    back = [total([c * float(row[i]) for c, row in zip(codes, components)]) for i in range(len(z))]
    return total([(v - b) * (v - b) for v, b in zip(z, back)]) / float(len(z))


def score_log(df: DataFrame, model: Mapping, name: str = "new_probability") -> DataFrame:
    """Score a decision log with a stored model of any supported kind.

    Stored network weights have a row per input and a column per hidden unit; output weight and bias may be
    wrapped in lists.  A network without weights is scored as a logistic model.
    """
    kind = model.get("model_type", "logreg")
    if kind == "nn" and model.get("nn_weights"):
        w1, b1, w2, b2 = model["nn_weights"][:4]
        w2 = [w[0] if isinstance(w, Sequence) else w for w in w2]
        p = tanh_network(prepared(model), list(zip(*w1)), b1, w2, b2[0] if isinstance(b2, Sequence) else b2)
    elif kind == "moe":
        gate = model["regime_gating"]
        xs = [feature(n) for n in gate["feature_names"]]
        p = expert_mixture(prepared(model), xs, list(zip(gate["weights"], gate["intercepts"])),
                           [(e["coefficients"], e["intercept"]) for e in model["session_models"]])
    else:
        p = logistic_probability(model)
    return df.withColumn(name, p)


def power_grid(df: DataFrame, column: str, lambdas: Sequence[float]) -> DataFrame:
    """Yeo-Johnson log-likelihood of each candidate lambda, all in one pass."""
    x = _c(column).cast("double")
    base = F.sum(F.signum(x) * F.ln(F.abs(x) + 1.0))
    aggs = [F.var_pop(yeo_johnson(x, l)).alias(f"v{i}") for i, l in enumerate(lambdas)]
    row = df.filter(x.isNotNull()).agg(F.count(F.lit(1)).alias("n"), base.alias("b"), *aggs)
    cells = F.array(
        *[
            F.struct(F.lit(float(l)).alias("lambda"), (-_c("n") / 2.0 * F.ln(f"v{i}") + (l - 1.0) * _c("b")).alias("log_likelihood"))
            for i, l in enumerate(lambdas)
        ]
    )
    return row.select(F.explode(cells).alias("e")).select("e.*")


def skewness_screen(df: DataFrame, columns: Sequence[str], limit: float = 1.0) -> DataFrame:
    """Bias-corrected skewness per column and whether it exceeds the limit."""
    stats = df.agg(*[F.skewness(c).alias(f"s{i}") for i, c in enumerate(columns)], *[F.count(c).cast("double").alias(f"n{i}") for i, c in enumerate(columns)])
    cells = []
    for i, c in enumerate(columns):
        n = _c(f"n{i}")
        s = F.when(n > 2, _c(f"s{i}") * F.sqrt(n * (n - 1)) / (n - 2))
        cells.append(F.struct(F.lit(c).alias("feature"), s.alias("skew"), (F.abs(s) > limit).alias("skewed")))
    return stats.select(F.explode(F.array(*cells)).alias("e")).select("e.*")
