"""Decision thresholds: every distinct probability as a threshold, with exact risk figures.

Trading on ``p >= threshold`` masks the returns of all other rows with zeros.  Sums over the rows taken are
running sums over falling scores.  The drawdown and the value at risk depend on the order of time and of
returns as well, and come from trees over that order whose nodes change as the threshold falls.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.ordered import BLOCK, OWN, last_known, lay_out, running_sums, value_ranks
from tapeloom.session import pin

# Histories merged in one pass over time blocks, and children of a node of the tree over returns.
FAN_IN, FAN_OUT = 8, 32
# Nodes that marks are in, up to which the rows of other nodes are left out of a level by a broadcast.
MOST_NODES = 65_536
_FALL = ("total", "high", "low", "fall")


def _c(name: str) -> Column:
    return F.col(name)


def threshold_candidates(df: DataFrame, p: str, grid: Sequence[float] = (), most: int | None = None) -> DataFrame:
    """Distinct probabilities of [0, 1] with the grid and 0, 0.5, 1 as ``threshold``; all of them, or ``most``
    evenly spread ones."""
    spark = df.sparkSession
    fixed = spark.createDataFrame([(float(g),) for g in {*grid, 0.0, 0.5, 1.0} if 0 <= g <= 1], "threshold double")
    probs = df.filter(_c(p).between(0.0, 1.0)).select(_c(p).cast("double").alias("threshold"))
    found = probs.unionByName(fixed).distinct()
    if most is None:
        return found
    ranks = value_ranks(found, [], "threshold")
    n = ranks.agg(F.max("upto").alias("n"))
    ranks = ranks.join(F.broadcast(n))  # one row
    i = _c("upto") - 1
    # Row i is kept when it is floor(j * (n-1) / (most-1)) for some j.
    step = (_c("n") - 1) / (most - 1)
    kept = (_c("n") <= most) | (F.floor(F.ceil(i / step) * step) == i)
    return ranks.filter(kept).select(_c("value").alias("threshold"))


def _merge_fall(left: Sequence, right: Sequence, high=np.maximum, low=np.minimum) -> tuple:
    """Summary of two adjoining stretches of time: sum, highest and lowest running total (the start counts),
    largest fall from a peak."""
    total = left[0] + right[0]
    return (
        total, high(left[1], left[0] + right[1]), low(left[2], left[0] + right[2]),
        high(high(left[3], right[3]), left[1] - left[0] - right[2]),
    )


def node_histories(returns: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The root of a tree over time positions after each distinct score, from the highest down.

    Rows enter by falling score and each entry changes the nodes above its leaf.  A node keeps the
    history of its values, a step per distinct score below it, which is one merge of its children's
    histories: the value of the one that did not change is the last one it had.  That is a sort and a
    few array passes per level.  Returns the scores and the columns of ``_FALL``."""
    node = np.arange(len(returns))
    order = np.argsort(-scores, kind="stable")
    node, score, value = node[order], scores[order], returns[order]
    state = (value, np.maximum(value, 0), np.minimum(value, 0), np.maximum(-value, 0))
    size = len(returns)
    while size > 1:
        side, node = node & 1, node >> 1
        order = np.lexsort((-score, node))
        side, node, score, state = side[order], node[order], score[order], tuple(s[order] for s in state)
        at = np.arange(len(node))
        start = np.maximum.accumulate(np.where(np.r_[True, node[1:] != node[:-1]], at, 0))

        def latest(which: int) -> tuple:
            last = np.maximum.accumulate(np.where(side == which, at, -1))
            known = last >= start
            return tuple(np.where(known, s[np.maximum(last, 0)], 0.0) for s in state)

        state = _merge_fall(latest(0), latest(1))
        # Of equal scores in a node only the state after all of them counts.
        keep = np.r_[(node[1:] != node[:-1]) | (score[1:] != score[:-1]), True]
        node, score, state = node[keep], score[keep], tuple(s[keep] for s in state)
        size = (size + 1) >> 1
    return score, state


def _falls(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``neg, fall``: the largest fall of the masked running total in time order once all rows of a score
    of -neg or more are in.

    Each block of time makes its history; histories of adjoining blocks are merged by FAN_IN until one is
    left.  A merge sorts the steps of a group by score in blocks of rows, whatever the group, so the work
    per level is that of the rows and no task holds more than its share."""
    lay = lay_out(rows, [], order)
    cols = list(lay.order)

    def history(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cols, kind="mergesort")
        score, state = node_histories(pdf["r"].to_numpy(dtype=float), pdf["p"].to_numpy(dtype=float))
        return pd.DataFrame({"node": int(pdf[BLOCK].iloc[0]), "neg": -score, **dict(zip(_FALL, state))})

    taken = lay.df.filter(F.col(OWN) & _c("p").isNotNull())
    steps = pin(taken.groupBy(BLOCK).applyInPandas(history, "node long, neg double, " + ", ".join(f"{c} double" for c in _FALL)))
    nodes = steps.agg(F.coalesce(F.max("node") + 1, F.lit(0))).first()[0]
    zero = F.struct(*[F.lit(0.0).alias(c) for c in _FALL])
    while nodes > 1:
        slots = [f"s{i}" for i in range(FAN_IN)]
        value = F.struct(*_FALL)
        wide = steps.groupBy(F.floor(_c("node") / FAN_IN).alias("node"), "neg").agg(
            *[F.max(F.when(_c("node") % FAN_IN == i, value)).alias(s) for i, s in enumerate(slots)]
        )
        filled = last_known(wide, ["node"], ["neg"], {s: _c(s) for s in slots})
        def join_on(made: Column, more: Column) -> Column:
            both = _merge_fall([made[c] for c in _FALL], [more[c] for c in _FALL], F.greatest, F.least)
            return F.struct(*[c.alias(n) for c, n in zip(both, _FALL)])

        merged = F.aggregate(F.array(*[F.coalesce(s, zero) for s in slots]), zero, join_on)
        steps = pin(filled.select("node", "neg", merged.alias("m")).select("node", "neg", "m.*"))
        nodes = -(-nodes // FAN_IN)
    return steps.select("neg", "fall")


def _order_statistics(rows: DataFrame, marks: DataFrame, share: float) -> DataFrame:
    """``neg, quantile``: for each mark (``neg, taken, row_count``) the value at place int(share * row_count)
    of the masked returns in rising order.

    A tree over the ranks of distinct returns is walked down by all marks together.  On a level each mark is
    in one node; running counts over falling scores tell how many rows each child of the node has by
    then, masked rows counting at zero, and with that the child to go on in.  A level is one ordered pass
    over marks and, of the nodes they are in, one row per score and child; the number of levels grows with
    the logarithm of the number of returns."""
    counts = pin(rows.filter(_c("p").isNotNull()).groupBy((-_c("p")).alias("neg"), _c("r").alias("value")).agg(F.count(F.lit(1)).alias("c")))
    spark = rows.sparkSession
    values = counts.select("value").union(spark.createDataFrame([(0.0,)], "value double")).distinct()
    ranks = pin(value_ranks(values, [], "value").select("value", (_c("upto") - 1).alias("rank")))
    zero, size = ranks.agg(F.max(F.when(_c("value") == 0, _c("rank"))), F.count(F.lit(1))).first()
    levels = 1
    while FAN_OUT**levels < size:
        levels += 1
    events = pin(counts.join(ranks, "value").select("neg", "rank", "c"))
    state = marks.select("neg", F.lit(0).cast("long").alias("node"), F.floor(_c("row_count") * share).cast("long").alias("place"), (_c("row_count") - _c("taken")).alias("idle"))
    fields = [f"c{d}" for d in range(FAN_OUT)]
    for level in reversed(range(levels)):
        below = FAN_OUT**level
        digit = F.floor(_c("rank") / below) % FAN_OUT
        null = F.lit(None).cast("long")
        seen = events.select("neg", F.floor(_c("rank") / (below * FAN_OUT)).alias("node"), digit.alias("digit"), "c")
        if level < levels - 1:
            entered = pin(state.select("node").distinct())
            if entered.count() <= MOST_NODES:
                seen = seen.join(F.broadcast(entered), "node", "left_semi")
        seen = seen.groupBy("neg", "node", "digit").agg(F.sum("c").alias("c")).select("neg", "node", F.lit(0).alias("ask"), "digit", "c", null.alias("place"), null.alias("idle"))
        asked = state.select("neg", "node", F.lit(1).alias("ask"), null.alias("digit"), F.lit(0).cast("long").alias("c"), "place", "idle")
        run = running_sums(
            seen.union(asked), ["node"], ["neg", "ask", "digit"], {f: F.when(_c("digit") == d, _c("c")).otherwise(0) for d, f in enumerate(fields)}
        ).where("ask = 1")
        here, at = zero // (below * FAN_OUT), zero // below % FAN_OUT
        idle = F.when(_c("node") == here, _c("idle")).otherwise(0)
        held = [_c(f) + idle if d == at else _c(f) for d, f in enumerate(fields)]
        # Children in order: those whose rows all come before the place are passed.
        start = F.struct(F.lit(0).cast("long").alias("child"), _c("place").alias("place"), F.lit(False).alias("found"))

        def step(at: Column, here: Column) -> Column:
            found = at["found"] | (here > at["place"])
            return F.struct(
                (at["child"] + F.when(found, 0).otherwise(1)).alias("child"), (at["place"] - F.when(found, 0).otherwise(here)).alias("place"), found.alias("found")
            )

        walked = run.select("neg", "node", "idle", F.aggregate(F.array(*held), start, step).alias("at"))
        state = pin(walked.select("neg", (_c("node") * FAN_OUT + _c("at.child")).alias("node"), "at.place", "idle"))
    return state.join(ranks.withColumnRenamed("rank", "node"), "node").select("neg", _c("value").alias("quantile"))


def threshold_table(df: DataFrame, candidates: DataFrame, order: Sequence[str], y: str, p: str, profit: str) -> DataFrame:
    """Metrics of trading on ``p >= threshold`` for every candidate: ``threshold, profit, sharpe_ratio,
    sortino_ratio, accuracy, active, max_drawdown, var_95``.

    ``order`` is unique per row.  A null probability is never taken, but its row counts.  Neither rows nor
    candidates are bounded: nothing here is rows times candidates.
    """
    rows = pin(df.select(*order, _c(y).cast("long").alias("y"), _c(p).cast("double").alias("p"), _c(profit).cast("double").alias("r")))
    r = _c("r")
    parts = {
        "n": F.count(F.lit(1)), "pos": F.sum("y"), "s": F.sum(r), "q": F.sum(r * r), "dq": F.sum(F.when(r < 0, r * r)),
        "dn": F.count_if(r < 0), "nz": F.count_if(r != 0),
    }
    per_score = rows.filter(_c("p").isNotNull()).groupBy((-_c("p")).alias("neg")).agg(*[c.alias(n) for n, c in parts.items()])
    falls = _falls(rows, order)
    wanted = candidates.select((-_c("threshold")).alias("neg"), F.lit(True).alias("wanted"))
    together = per_score.unionByName(falls, allowMissingColumns=True).unionByName(wanted, allowMissingColumns=True)
    by_score = pin(together.groupBy("neg").agg(*[F.sum(n).alias(n) for n in parts], F.max("fall").alias("fall"), F.max("wanted").alias("wanted")))
    lay = lay_out(by_score, [], ["neg"])
    lay = running_sums(lay, [], ["neg"], {f"upto_{n}": F.coalesce(_c(n), F.lit(0)) for n in parts})
    at = last_known(lay, [], ["neg"], {"_fall": _c("fall")}).finish().where("wanted")
    total = rows.agg(F.count(F.lit(1)).alias("row_count"), F.sum("y").alias("pos_count"))
    at = pin(at.join(F.broadcast(total)))  # one row
    n_all = _c("row_count").cast("double")
    mean = _c("upto_s") / n_all
    var = F.when(n_all > 1, (_c("upto_q") - n_all * mean * mean) / (n_all - 1))
    down = F.sqrt(F.try_divide(_c("upto_dq"), _c("upto_dn")))
    right = _c("upto_pos") + (n_all - _c("upto_n")) - (_c("pos_count") - _c("upto_pos"))
    risk = _order_statistics(rows, at.select("neg", _c("upto_n").alias("taken"), "row_count"), 0.05)
    out = at.join(risk, "neg", "left")
    return out.select(
        (-_c("neg")).alias("threshold"), _c("upto_s").cast("double").alias("profit"),
        F.when(var > 1e-18, mean / F.sqrt(var)).otherwise(0.0).alias("sharpe_ratio"),
        F.when(down > 0, F.try_divide(mean, down)).otherwise(0.0).alias("sortino_ratio"),
        (right / n_all).alias("accuracy"), (_c("upto_nz") > 0).alias("active"),
        F.coalesce("_fall", F.lit(0.0)).alias("max_drawdown"), F.coalesce("quantile", F.lit(0.0)).alias("var_95"),
    )


def best_threshold(table: DataFrame, objective: str = "profit", max_drawdown: float | None = None, var_limit: float | None = None) -> DataFrame:
    """The candidate with the highest objective within the risk limits; the lowest wins ties."""
    rows = table
    if max_drawdown is not None:
        rows = rows.filter((_c("max_drawdown") <= max_drawdown) & _c("active"))
    if var_limit is not None:
        rows = rows.filter((_c("var_95") <= var_limit) & _c("active"))
    return rows.orderBy(_c(objective).desc(), _c("threshold")).limit(1)
