"""Isolation forests grown level by level: one aggregation over all open nodes of all trees per level."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.resample import PRIME, replicate_factors, row_number_of
from tapeloom.session import pin

EULER = 0.5772156649015329


def _c(name: str) -> Column:
    return F.col(name)


def path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search among n values."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _path_norm_of(n: Column) -> Column:
    long = 2.0 * (F.log(n - 1) + EULER) - 2.0 * (n - 1) / n
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(long)


@dataclass(frozen=True)
class Forest:
    """Nodes by tree and number: the root is 1, the children of i are 2 i and 2 i + 1.  ``column`` is -1 at
    leaves, where ``length`` is the path length; rows below ``cut`` go to the first child."""

    column: np.ndarray
    cut: np.ndarray
    length: np.ndarray
    sample: int

    def depths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row of ``x``."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for column, cut, length in zip(self.column, self.cut, self.length):
            at = np.ones(len(x), dtype=np.int64)
            while True:
                c = column[at]
                inner = c >= 0
                if not inner.any():
                    break
                at = np.where(inner, 2 * at + (x[rows, np.maximum(c, 0)] >= cut[at]), at)
            total += length[at]
        return total / max(1, len(self.column))


def tree_samples(df: DataFrame, columns: Sequence[str], row_id: str, trees: int, sample: int, seed: int) -> tuple[DataFrame, int]:
    """``tree, x0, x1, ...``: for each tree the ``sample`` rows (all, if fewer) that come first by a number
    from row and tree.  Rows that no tree can need are left out before they meet the trees."""
    rows = df.select(row_number_of(_c(row_id)).alias("a"), _c(row_id).alias("id"), *[_c(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    total = rows.count()
    size = min(sample, total)
    factors = F.array(*[F.lit(f).cast("long") for f in replicate_factors(trees, seed)])
    # A share that holds the sample nearly always; if a tree falls short of it, all rows are ranked.
    share = min(1.0, (size + 6 * math.sqrt(size) + 12) / max(total, 1))
    for limit in (int(share * PRIME), PRIME):
        near = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: _c("a") * F.get(factors, t) % PRIME < limit)
        drawn = rows.withColumn("tree", F.explode(near)).withColumn("z", _c("a") * F.get(factors, _c("tree")) % PRIME)
        rank = F.row_number().over(Window.partitionBy("tree").orderBy("z", "id"))
        drawn = pin(drawn.withColumn("rank", rank).where(_c("rank") <= size).drop("a", "id", "z", "rank"))
        counts = drawn.groupBy("tree").count().agg(F.count(F.lit(1)).alias("trees"), F.min("count").alias("least")).first()
        if limit == PRIME or counts["trees"] == trees and counts["least"] == size:
            return drawn, size


def _uniform(seed: int, use: str) -> Column:
    text = F.concat_ws(":", F.lit(seed), "tree", "node", F.lit(use))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)


def fit_forest(df: DataFrame, columns: Sequence[str], row_id: str, trees: int = 100, sample: int = 256, seed: int = 0) -> Forest:
    """Grow ``trees`` isolation trees, each on its own ``sample`` of the rows.

    All trees grow together.  On each level one aggregation gives the size and the ranges of every open
    node; column and cut are uniform numbers from the MD5 of seed, tree and node, and the sampled rows
    move to the children.  A node is a leaf at the depth log2(sample), with one row, or where no column
    varies.  Rows with a null in ``columns`` take no part.  What comes to the driver is the forest, of at
    most ``trees`` times 4 ``sample`` nodes.
    """
    used = df.where(" and ".join(f"`{c}` is not null" for c in columns))
    drawn, size = tree_samples(used, columns, row_id, trees, sample, seed)
    depth = max(1, math.ceil(math.log2(max(size, 2))))
    names = [f"x{i}" for i in range(len(columns))]
    rows, nodes = drawn.withColumn("node", F.lit(1).cast("long")), []
    for level in range(depth + 1):
        ranges = rows.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.min(x).alias("low"), F.max(x).alias("high")).alias(x) for x in names])
        open_ = F.filter(F.array(*[F.when(_c(x)["high"] > _c(x)["low"], F.lit(i)).otherwise(-1) for i, x in enumerate(names)]), lambda i: i >= 0)
        ranges = ranges.withColumn("open", open_ if level < depth else F.array().cast("array<int>"))
        column = F.when((F.size("open") > 0) & (_c("n") > 1), F.get("open", F.floor(_uniform(seed, "column") * F.size("open")).cast("int"))).otherwise(-1)
        ranges = ranges.withColumn("column", column)
        span = F.get(F.array(*names), F.greatest("column", F.lit(0)))
        ranges = ranges.withColumn("cut", span["low"] + _uniform(seed, "cut") * (span["high"] - span["low"]))
        # A cut at the lowest value would leave one side empty.
        ranges = ranges.withColumn("column", F.when(_c("cut") > span["low"], _c("column")).otherwise(-1))
        made = pin(ranges.select("tree", "node", "column", "cut", (F.lit(float(level)) + _path_norm_of(_c("n").cast("double"))).alias("length")))
        nodes.append(made)
        if level < depth:
            cuts = made.where("column >= 0").select("tree", "node", "column", "cut")
            value = F.get(F.array(*names), _c("column"))
            rows = pin(rows.join(cuts, ["tree", "node"]).select("tree", *names, (_c("node") * 2 + F.when(value < _c("cut"), 0).otherwise(1)).alias("node")))
    width = 1 << (depth + 1)
    forest = Forest(np.full((trees, width), -1), np.zeros((trees, width)), np.zeros((trees, width)), size)
    for level in nodes:
        for r in level.collect():
            forest.column[r["tree"], r["node"]], forest.cut[r["tree"], r["node"]], forest.length[r["tree"], r["node"]] = r["column"], r["cut"], r["length"]
    return forest


def score_forest(df: DataFrame, columns: Sequence[str], forest: Forest, name: str = "anomaly_score") -> DataFrame:
    """Isolation score in (0, 1) per row; larger is more isolated."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float) for s in series])
        return pd.Series(np.power(2.0, -shared.value.depths(x) / (path_norm(shared.value.sample) or 1.0)))

    return df.withColumn(name, score(*[_c(c).cast("double") for c in columns]))


def forest_drift(baseline: DataFrame, recent: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """Share of recent rows that a forest of the baseline isolates (score above 0.5), per feature."""
    out = None
    for c in columns:
        scored = score_forest(recent.filter(_c(c).isNotNull()), [c], fit_forest(baseline, [c], row_id))
        one = scored.agg(F.avg((_c("anomaly_score") > 0.5).cast("double")).alias("drift")).select(F.lit(c).alias("feature"), "drift")
        out = one if out is None else out.unionByName(one)
    return out
