"""Extension points: features, metrics, report steps and model builders by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from importlib.metadata import entry_points

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Registry:
    """Named functions, from decorators or from an entry-point group."""

    def __init__(self, group: str):
        self.group, self._items = group, {}

    def register(self, name: str):
        def add(fn: Callable) -> Callable:
            self._items[name] = fn
            return fn

        return add

    def get(self, name: str) -> Callable:
        if name not in self._items:
            self.load()
        if name not in self._items:
            raise KeyError(f"{name} is not registered in {self.group}")
        return self._items[name]

    def names(self) -> list[str]:
        return list(self._items)

    def load(self, wanted: Sequence[str] | None = None) -> None:
        for point in entry_points(group=self.group):
            if (wanted is None or point.name in wanted) and point.name not in self._items:
                self._items[point.name] = point.load()


FEATURES = Registry("tapeloom.features")  # (df, **settings) -> df with new columns
METRICS = Registry("tapeloom.metrics")  # (y, p, profit, threshold) -> aggregate Column
STEPS = Registry("tapeloom.steps")  # (report, context) -> report
MODELS = Registry("tapeloom.models")  # (label, weight, **settings) -> pyspark.ml Estimator


def apply_features(df: DataFrame, names: Sequence[str], **settings) -> tuple[DataFrame, list[str]]:
    """Run features in order; later ones replace columns of the same name.  Returns new names."""
    base, added = set(df.columns), []
    for name in names:
        before = set(df.columns)
        df = FEATURES.get(name)(df, **settings.get(name, {}))
        added += [c for c in df.columns if c not in before and c not in base]
    return df, list(dict.fromkeys(added))


def merge_features(df: DataFrame, *outputs: dict[str, Column]) -> DataFrame:
    """Column-wise merge of feature outputs; the last of equal names wins."""
    merged: dict[str, Column] = {}
    for o in outputs:
        merged.update(o)
    return df.withColumns(merged)


def compute_metrics(df: DataFrame, y: str, p: str, profit: str, names: Sequence[str] | None = None, threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """All requested aggregate metrics in one pass."""
    cols = [
        METRICS.get(n)(F.col(y), F.col(p), F.col(profit), threshold).alias(n) for n in (names or METRICS.names())
    ]
    return df.groupBy(*keys).agg(*cols)


def run_steps(report: DataFrame, names: Sequence[str] | None, context: dict) -> DataFrame:
    for n in STEPS.names() if names is None else names:
        report = STEPS.get(n)(report, context)
    return report


# --- built-in entries -----------------------------------------------------------------------


@FEATURES.register("lag_diff")
def _lag_diff(df, columns=("price",), lags=(1, 2, 3), keys=("symbol",), order=("t", "id")):
    from tapeloom.operators.windows import lag_diff

    return lag_diff(df, keys, order, columns, lags)


@FEATURES.register("technical")
def _technical(df, price="price", keys=("symbol",), order=("t", "id"), lags=()):
    """Lags, moving average, bands, RSI and ATR over one shared layout."""
    from tapeloom.operators import windows as W
    from tapeloom.operators.ordered import lay_out

    rows = lay_out(df, keys, order, before=64 + max([0, *lags]))
    if lags:
        rows = W.lag_diff(rows, keys, order, [price], lags)
    for feature, size in ((W.sma, 5), (W.bollinger, 20), (W.rsi, 14)):
        rows = feature(rows, keys, order, price, size)
    return W.atr(rows, keys, order, price).finish()


@FEATURES.register("calendar")
def _calendar(df, ts="ts"):
    from tapeloom.functions.scalar import calendar_encoding

    return calendar_encoding(df, ts)


@METRICS.register("accuracy")
def _accuracy(y, p, profit, threshold):
    return F.avg(((p >= threshold).cast("int") == y).cast("double"))


@METRICS.register("brier_score")
def _brier(y, p, profit, threshold):
    return F.avg(F.pow(p - y, 2))


@METRICS.register("profit")
def _profit(y, p, profit, threshold):
    return F.sum(profit)


@METRICS.register("sharpe_ratio")
def _sharpe(y, p, profit, threshold):
    from tapeloom.operators.risk import ratio_columns

    return ratio_columns(profit)["sharpe_ratio"]


@METRICS.register("sortino_ratio")
def _sortino(y, p, profit, threshold):
    from tapeloom.operators.risk import ratio_columns

    return ratio_columns(profit)["sortino_ratio"]


@STEPS.register("precision")
def _precision(report, context):
    tp, fp = F.col("matched_events"), F.col("fp")
    return report.withColumn("precision", F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)))


@MODELS.register("logreg")
def _logreg(label, weight, **settings):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(labelCol=label, **({"weightCol": weight} if weight else {}), **settings)


@MODELS.register("gradient_boosting")
def _boosting(label, weight, **settings):
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(labelCol=label, seed=0, **({"weightCol": weight} if weight else {}), **settings)
