"""Bootstrap intervals of classification and risk metrics, without a row per row and replicate."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate
from math import ceil, exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.ordered import BLOCK, OWN, POS, lay_out
from tapeloom.session import pin

PRIME = 2**31 - 1
# Rows whose weights in all replicates are held at a time.
CHUNK = 2_048
# x in 0..PRIME-1 has the weight that counts the cuts not above it: the Poisson(1) distribution function.
CUTS = [c for c in (ceil(f * PRIME) for f in accumulate(exp(-1) / factorial(k) for k in range(20))) if c < PRIME]
METRICS = ("accuracy", "roc_auc", "pr_auc", "brier_score", "sharpe_ratio", "sortino_ratio", "max_drawdown", "var_95", "profit", "mean_return")


def _c(name: str) -> Column:
    return F.col(name)


def row_number_of(key: Column) -> Column:
    """A number from 0 to PRIME - 1 from the first 32 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % PRIME


def replicate_factors(replicates: int, seed: int) -> list[int]:
    """Per replicate a factor from 1 to PRIME - 1 from the MD5 of ``seed:replicate``."""
    return [int(hashlib.md5(f"{seed}:{b}".encode()).hexdigest()[:8], 16) % (PRIME - 1) + 1 for b in range(replicates)]


def _weights(numbers: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Rows x replicates: how often a row is drawn."""
    return np.searchsorted(CUTS, numbers[:, None] * factors[None, :] % PRIME, side="right").astype(float)


def _chunks(pdf: pd.DataFrame, factors: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for at in range(0, len(pdf), CHUNK):
        part = pdf.iloc[at : at + CHUNK]
        yield part, _weights(part["a"].to_numpy(), factors)


def _by_block(rows: DataFrame, order: Sequence[str], build: Callable, schema: str, carried: DataFrame | None = None) -> DataFrame:
    """Run ``build`` on each block of rows in order; ``carried`` has rows for blocks by ``block``."""
    lay = lay_out(rows, [], order)
    own = lay.df.filter(F.col(OWN)).withColumnRenamed(BLOCK, "block")
    return _again(own, build, schema, carried)


def _again(own: DataFrame, build: Callable, schema: str, carried: DataFrame | None = None) -> DataFrame:
    if carried is None:
        return own.groupBy("block").applyInPandas(lambda pdf: build(pdf.sort_values(POS, kind="mergesort")), schema)
    return own.groupBy("block").cogroup(carried.groupBy("block")).applyInPandas(lambda pdf, more: build(pdf.sort_values(POS, kind="mergesort"), more), schema)


def _sums_and_falls(rows: DataFrame, order: Sequence[str], factors: np.ndarray) -> DataFrame:
    """``rep`` with weighted sums and the largest fall of the running total in time order."""
    names = ("n", "hits", "se", "s", "q", "dq", "dn", "total", "high", "low", "fall")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        made = {name: np.zeros(len(factors)) for name in names}
        for part, w in _chunks(pdf, factors):
            y, p, r = (part[c].to_numpy(dtype=float) for c in ("y", "p", "r"))
            terms = {"n": np.ones(len(r)), "hits": (p >= 0.5) == (y == 1), "se": (p - y) ** 2, "s": r, "q": r * r, "dq": np.where(r < 0, r * r, 0), "dn": r < 0}
            sums = np.array([np.asarray(t, dtype=float) for t in terms.values()]) @ w
            for name, value in zip(terms, sums):
                made[name] += value
            # Drawing a row again goes on in one direction, so peaks and falls end at the rows.
            running = made["total"] + np.cumsum(w * r[:, None], axis=0)
            peak = np.maximum(np.maximum.accumulate(running, axis=0), made["high"])
            made["fall"] = np.maximum(made["fall"], (peak - running).max(axis=0))
            made["high"], made["low"], made["total"] = peak[-1], np.minimum(made["low"], running.min(axis=0)), running[-1]
        return pd.DataFrame({"block": int(pdf["block"].iloc[0]), "rep": np.arange(len(factors)), **made})

    schema = "block long, rep long, " + ", ".join(f"{n} double" for n in names)
    blocks = pin(_by_block(rows, order, block, schema))
    before = Window.partitionBy("rep").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    blocks = blocks.withColumn("top", F.greatest(F.lit(0.0), F.max(_c("base") + _c("high")).over(before)))
    fall = F.max(F.greatest(_c("fall"), _c("top") - _c("base") - _c("low")))
    return blocks.groupBy("rep").agg(*[F.sum(c).alias(c) for c in names[:7]], fall.alias("max_drawdown"))


def _areas(rows: DataFrame, factors: np.ndarray) -> DataFrame:
    """``rep, roc_auc, pr_auc``, ties counted half.

    Rows go by falling score in blocks.  The first and the last score of a block may go on in the blocks
    beside, so their weights are added up over blocks; what lies between is whole, and is summed in a
    second pass that knows the weights above it."""
    lay = lay_out(rows.withColumn("_neg", -_c("p")), [], ["_neg", "a"])
    own = lay.df.filter(F.col(OWN)).withColumnRenamed(BLOCK, "block").select("block", POS, "y", "p", "a")

    def grouped(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores from high to low with weights of positives and negatives, scores x replicates."""
        at = np.flatnonzero(np.r_[True, np.diff(pdf["p"].to_numpy()) != 0])
        which = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(pdf)]))
        return pdf["p"].to_numpy()[at], which, at

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        scores, which, _ = grouped(pdf)
        kind = np.where(which == 0, 0, np.where(which == len(scores) - 1, 2, 1))
        sums = np.zeros((3, 2, len(factors)))
        for k, (part, w) in enumerate(_chunks(pdf, factors)):
            y, own_kind = part["y"].to_numpy(), kind[k * CHUNK : k * CHUNK + len(part)]
            for i in range(3):
                for j in range(2):
                    sums[i, j] += w[(own_kind == i) & (y == 1 - j)].sum(axis=0)
        out = []
        for i in range(3):
            if (kind == i).any():
                key = scores[(0, min(1, len(scores) - 1), len(scores) - 1)[i]]
                out.append(pd.DataFrame({"block": int(pdf["block"].iloc[0]) if i == 1 else -1, "score": key, "rep": np.arange(len(factors)), "pos": sums[i, 0], "neg": sums[i, 1]}))
        return pd.concat(out)

    parts = pin(_again(own, edges, "block long, score double, rep long, pos double, neg double"))
    parts = parts.groupBy("rep", "score").agg(F.max("block").alias("block"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    upto = Window.partitionBy("rep").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    parts = pin(parts.withColumns({"tp": F.sum("pos").over(upto), "fp": F.sum("neg").over(upto)}))

    def inner(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        """Areas of what lies between the block's first and last score."""
        if not len(pdf) or not len(above):
            return pd.DataFrame({"rep": [], "beats": [], "ap": []})
        above = above.sort_values("rep")
        tp, fp = (above[c].to_numpy() for c in ("tp0", "fp0"))
        scores, which, at = grouped(pdf)
        low, high = at[1], at[-1]  # rows of the scores between
        body, which = pdf.iloc[low:high], which[low:high]
        beats, ap = np.zeros(len(factors)), np.zeros(len(factors))
        open_pos, open_neg = np.zeros(len(factors)), np.zeros(len(factors))
        for k, (part, w) in enumerate(_chunks(body, factors)):
            group = which[k * CHUNK : k * CHUNK + len(part)]
            last_group = which[k * CHUNK + len(part)] if k * CHUNK + len(part) < len(which) else None
            y = part["y"].to_numpy()
            starts = np.flatnonzero(np.r_[True, np.diff(group) != 0])
            pos, neg = (np.add.reduceat(w * (y == v)[:, None], starts, axis=0) for v in (1, 0))
            pos[0] += open_pos
            neg[0] += open_neg
            open_pos, open_neg = np.zeros(len(factors)), np.zeros(len(factors))
            if last_group is not None and last_group == group[-1]:  # goes on in the next chunk
                open_pos, open_neg, pos, neg = pos[-1], neg[-1], pos[:-1], neg[:-1]
            if len(pos):
                tps, fps = tp + np.cumsum(pos, axis=0), fp + np.cumsum(neg, axis=0)
                beats += (pos * (neg / 2 - fps)).sum(axis=0)
                ap += np.divide(pos * tps, tps + fps, out=np.zeros_like(pos), where=tps + fps > 0).sum(axis=0)
                tp, fp = tps[-1], fps[-1]
        return pd.DataFrame({"rep": np.arange(len(factors)), "beats": beats, "ap": ap})

    above = parts.where("block >= 0").select("block", "rep", (_c("tp") - _c("pos")).alias("tp0"), (_c("fp") - _c("neg")).alias("fp0"))
    between = _again(own, inner, "rep long, beats double, ap double", above)
    whole = parts.where("block < 0").select(
        "rep", (_c("pos") * (_c("neg") / 2 - _c("fp"))).alias("beats"), F.coalesce(F.try_divide(_c("pos") * _c("tp"), _c("tp") + _c("fp")), F.lit(0.0)).alias("ap")
    )
    ends = parts.groupBy("rep").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    areas = between.union(whole).groupBy("rep").agg(F.sum("beats").alias("beats"), F.sum("ap").alias("ap"))
    both = (_c("P") > 0) & (_c("N") > 0)
    return areas.join(ends, "rep").select(
        "rep", F.when(both, _c("beats") / (_c("P") * _c("N")) + 1).alias("roc_auc"), F.when(both, _c("ap") / _c("P")).alias("pr_auc")
    )


def _values_at_risk(rows: DataFrame, factors: np.ndarray, share: float) -> DataFrame:
    """``rep, var_95``: the return at place int(share * n) of each replicate's sorted returns."""
    lay = lay_out(rows, [], ["r", "a"])
    own = lay.df.filter(F.col(OWN)).withColumnRenamed(BLOCK, "block").select("block", POS, "r", "a")

    def drawn(pdf: pd.DataFrame) -> pd.DataFrame:
        n = sum(w.sum(axis=0) for _, w in _chunks(pdf, factors))
        return pd.DataFrame({"block": int(pdf["block"].iloc[0]), "rep": np.arange(len(factors)), "n": n})

    blocks = pin(_again(own, drawn, "block long, rep long, n double"))
    rep = Window.partitionBy("rep")
    before = F.coalesce(F.sum("n").over(rep.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = blocks.withColumns({"before": before, "place": F.floor(F.sum("n").over(rep) * share)})
    asked = placed.where("before <= place and place < before + n").select("block", "rep", (_c("place") - _c("before")).alias("left"))

    def find(pdf: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        left, reps = asks["left"].to_numpy(dtype=float), asks["rep"].to_numpy(dtype=int)
        for at in range(0, len(pdf), CHUNK):
            if not len(reps):
                break
            part = pdf.iloc[at : at + CHUNK]
            upto = np.cumsum(_weights(part["a"].to_numpy(), factors[reps]), axis=0)
            done = upto[-1] > left
            first = (upto > left).argmax(axis=0)
            out += zip(reps[done].tolist(), part["r"].to_numpy(dtype=float)[first[done]].tolist())
            left, reps = (left - upto[-1])[~done], reps[~done]
        return pd.DataFrame(out, columns=["rep", "var_95"])

    return _again(own, find, "rep long, var_95 double", asked)


def bootstrap(
    df: DataFrame, row_id: str, y: str, p: str, profit: str, order: Sequence[str] | None = None, replicates: int = 1000, seed: int = 0,
    var_share: float = 0.05,
) -> DataFrame:
    """``metric, mean, low, high``: mean and 2.5 / 97.5 % bounds of ten metrics over resamples in which each row
    has a Poisson(1) weight.

    The weight of a row in a replicate is a fixed function of ``row_id``, the replicate and ``seed``: a number
    from each one's MD5, multiplied modulo a prime and looked up in the distribution function.  So a
    recomputed task draws the same resample, and nothing is expanded: tasks draw the weights of a chunk
    of rows in all replicates, reduce them with one matrix product, and hand on one row per replicate and
    block.  Orders of time, score and return are cut into blocks with exact carries.

    Rows with a null label, probability or profit take no part.  ``order`` (by default the id) must be
    unique per row; a replicate with one class has no areas under curves.
    """
    factors = np.array(replicate_factors(replicates, seed), dtype=np.int64)
    order = list(order or [row_id])
    rows = pin(df.where(_c(y).isNotNull() & _c(p).isNotNull() & _c(profit).isNotNull()).select(
        *[_c(c).alias(f"_o{i}") for i, c in enumerate(order)],
        _c(y).cast("int").alias("y"), _c(p).cast("double").alias("p"), _c(profit).cast("double").alias("r"), row_number_of(_c(row_id)).alias("a"),
    ))
    sums = _sums_and_falls(rows, [f"_o{i}" for i in range(len(order))], factors)
    n, mean = _c("n"), _c("s") / _c("n")
    var = (_c("q") - n * mean * mean) / (n - 1)
    per = sums.where("n > 0").join(_areas(rows, factors), "rep", "left").join(_values_at_risk(rows, factors, var_share), "rep", "left").select(
        (_c("hits") / n).alias("accuracy"), "roc_auc", "pr_auc", (_c("se") / n).alias("brier_score"),
        F.when((n > 1) & (var > 1e-18), mean / F.sqrt(var)).otherwise(0.0).alias("sharpe_ratio"),
        F.when(_c("dq") > 0, mean / F.sqrt(_c("dq") / _c("dn"))).otherwise(0.0).alias("sortino_ratio"),
        "max_drawdown", "var_95", _c("s").alias("profit"), mean.alias("mean_return"),
    )
    long = per.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _c(m).alias("v")) for m in METRICS])).alias("e")).select("e.*")
    return long.groupBy("metric").agg(
        F.avg("v").alias("mean"), F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high")
    )
