"""Quality classifier: a sparse ensemble of rules read off shallow trees."""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tapeloom.session import pin

STATISTICS = (
    "n_words", "mean_word", "distinct_words", "distinct_triples", "same_as_previous", "mean_line", "repeated_lines",
    "upper", "digits", "symbols", "exclamations", "bars", "sentence_marks", "not_ascii",
)
_BYTES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "symbols": b"#*$%&<>~^=_{}[]\\/@",
    "exclamations": b"!?", "bars": b"|", "sentence_marks": b".,;:", "not_ascii": bytes(range(128, 256)),
}
# Labelled rows that a fit may use, and the size of what it fits.
SAMPLE_ROWS, TREES, DEPTH, LASSO = 20_000, 24, 3, 0.002
SEED = 7


def statistics_of(text: str | None) -> tuple[float, ...]:
    """STATISTICS of one whole text: counts as shares of words, lines or bytes; zeros for no text."""
    raw = (text or "").encode("utf-8")
    found = raw.split()
    n, size = len(found), max(1, len(raw))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    triples = list(zip(found, found[1:], found[2:]))
    of_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    return (
        float(n),
        sum(map(len, found)) / max(1, n),
        len(set(found)) / max(1, n),
        len(set(triples)) / max(1, len(triples)),
        sum(map(operator.eq, found, found[1:])) / max(1, n),
        n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        *(float(of_byte[list(_BYTES[name])].sum()) / size for name in STATISTICS[7:]),
    )


def statistics(text: Column) -> Column:
    """Struct of STATISTICS (double)."""

    @pandas_udf(", ".join(f"{name} double" for name in STATISTICS))
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics_of(t) for t in texts], columns=list(STATISTICS), dtype="float64")

    return of(text)


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each (statistic, is_upper_bound, threshold), at most or above the threshold."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self, stats: str) -> Column:
        made = [F.col(f"{stats}.{s}") <= t if upper else F.col(f"{stats}.{s}") > t for s, upper, t in self.tests]
        return reduce(operator.and_, made)


_TEST = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)")


def rules_of(description: str) -> list[Rule]:
    """All conjunctions on the way from a root to an inner node or leaf, from a forest's description; tests
    that another one of the same rule implies are left out, equal rules come once."""
    rules: dict[Rule, None] = {}
    way: list[tuple[int, tuple[str, bool, float]]] = []
    for line in description.splitlines():
        if not (m := _TEST.match(line)):
            if line.lstrip().startswith("Tree"):
                way = []
            continue
        depth = len(m[1])
        way = [w for w in way if w[0] < depth] + [(depth, (STATISTICS[int(m[2])], m[3] == "<=", float(m[4])))]
        tight: dict[tuple[str, bool], float] = {}
        for _, (name, upper, bound) in way:
            known = tight.get((name, upper))
            tight[name, upper] = bound if known is None else (min if upper else max)(known, bound)
        rules[Rule(tuple(sorted((s, u, t) for (s, u), t in tight.items())))] = None
    return list(rules)


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; the score is the logistic function of the intercept and the weights of fitting rules."""

    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self, stats: str) -> Column:
        total = reduce(operator.add, [F.when(r.column(stats), F.lit(w)).otherwise(0.0) for r, w in self.weights], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``stats, label`` of up to ``rows`` labelled documents, chosen by a hash of the key.

    The chosen keys are at most ``rows`` pairs of numbers, which bounds the broadcast; statistics are
    made of the chosen documents only.  Null keys and labels are left out."""
    sound = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, F.col(label).cast("double").alias("label"))
    chosen = sound.orderBy(F.xxhash64(key), key, "label").limit(rows)
    return docs.select(key, text).join(F.broadcast(chosen), key).select(statistics(F.col(text)).alias("stats"), "label")


def fit(sample: DataFrame) -> RuleModel:
    """Trees on the sample give rules, and logistic regression with an L1 penalty weighs them; rules of
    weight zero are dropped.  With one class or none the score is the share of that class, or 0.5."""
    sample = pin(sample)
    n, ones = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or ones in (0.0, float(n)):
        share = (ones or 0.0) / n if n else 0.5
        return RuleModel(float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), ())
    flat = sample.select("label", *[F.col(f"stats.{s}") for s in STATISTICS])
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(flat).select("features", "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=SEED, maxBins=64)
    rules = rules_of(forest.fit(vectors).toDebugString)
    if not rules:
        return RuleModel(float(np.log(ones / (n - ones))), ())
    fired = sample.select("label", *[r.column("stats").cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    vectors = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(fired).select("features", "label")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(vectors)
    return RuleModel(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients) if w))


def scored(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1), one row per row; a column of that name is replaced.

    Whole texts are read; null and empty texts have the statistics of no text and a score like any other.
    No rows give no rows."""
    with_stats = docs.withColumn("_stats", statistics(F.col(text)))
    return with_stats.withColumn("score", model.score("_stats")).drop("_stats")
