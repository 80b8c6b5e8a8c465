"""Nearest earlier window by dynamic time warping over a whole series, and mixtures with it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators.ordered import BLOCK, OWN, POS, lay_out
from tapeloom.operators.resample import PRIME, row_number_of
from tapeloom.session import pin

# Windows of a cell, beyond which it is cut, and queries that a task holds beside it.
CELL, QUERIES = 131_072, 16_384


def _c(name: str) -> Column:
    return F.col(name)


def _warped_costs(gaps: np.ndarray) -> np.ndarray:
    """Least total gap from the first cell to each cell, over steps to the next row, column or both, for a
    stack of gap matrices; cells of one anti-diagonal are filled at once."""
    many, n, m = gaps.shape
    out = np.full((many, n + 1, m + 1), np.inf)
    out[:, 0, 0] = 0.0
    for diagonal in range(n + m - 1):
        i = np.arange(max(0, diagonal - m + 1), min(n, diagonal + 1))
        j = diagonal - i
        before = np.minimum(np.minimum(out[:, i, j + 1], out[:, i + 1, j]), out[:, i, j])
        out[:, i + 1, j + 1] = gaps[:, i, j] + before
    return out[:, 1:, 1:]


def warped_partners(windows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each place of each window the mean of the places of its other that a best warping pairs with it.

    A cell is on a best warping if the least costs to it from both ends make up the total.
    """
    gaps = np.abs(windows[:, :, None] - others[:, None, :])
    to = _warped_costs(gaps)
    back = _warped_costs(gaps[:, ::-1, ::-1])[:, ::-1, ::-1]
    paired = np.isclose(to + back - gaps, to[:, -1:, -1:], rtol=1e-9, atol=1e-12)
    return (paired * others[:, None, :]).sum(axis=2) / paired.sum(axis=2)


def warped_partner(window: np.ndarray, other: np.ndarray) -> np.ndarray:
    return warped_partners(window[None], other[None])[0]


# Ranges of all values, of the first and of the last ones.
ENVELOPE = ("low", "high", "low_first", "high_first", "low_last", "high_last")


def _least_cost_column(x: Column, window: int) -> Column:
    """A cost that no warping of ``x`` to a window inside an envelope, whose fields are columns, goes below: every
    place is paired with some place, the first with the first, the last with the last."""

    def gap(value: Column, low: str, high: str) -> Column:
        return F.greatest(F.lit(0.0), value - _c(high), _c(low) - value)

    total = gap(x[0], "low_first", "high_first")
    if window > 1:
        total = total + gap(x[window - 1], "low_last", "high_last")
        inner = F.slice(x, 2, window - 2) if window > 2 else F.array().cast("array<double>")
        total = total + F.aggregate(inner, F.lit(0.0), lambda t, v: t + gap(v, "low", "high"))
    return total


# Windows of a leaf (a segment of those in order), leaves of a node, cells of a table of queries by nodes, and pairs of queries and windows compared at once.
SEGMENT, FAN, CELLS, PAIRS = 32, 32, 1 << 19, 1 << 16


class _Shapes:
    """Windows as columns: a row per place, and what bounds of warping costs need of each."""

    def __init__(self, windows: np.ndarray) -> None:
        self.rows = np.ascontiguousarray(windows.T)
        inner = windows[:, 1:-1] if windows.shape[1] > 2 else windows[:, :1]
        self.low, self.high, self.inner_low, self.inner_high = windows.min(axis=1), windows.max(axis=1), inner.min(axis=1), inner.max(axis=1)


def _outside(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.maximum(value - high, low - value))


class _Boxes:
    """What the windows between ``starts`` and the next ones have in common."""

    def __init__(self, shapes: _Shapes, places: np.ndarray, starts: np.ndarray) -> None:
        least, most = (lambda v: np.minimum.reduceat(v, starts)), (lambda v: np.maximum.reduceat(v, starts))
        self.first_place = least(places)
        self.first, self.last = ((least(r), most(r)) for r in (shapes.rows[0], shapes.rows[-1]))
        self.low, self.high, self.least_top, self.most_bottom = least(shapes.low), most(shapes.high), least(shapes.inner_high), most(shapes.inner_low)


class WindowIndex:
    """Windows of a cell put in order by value: leaves of windows alike in their ends and inner extremes, and
    nodes of leaves.

    ``places`` are the rows at which the windows start."""

    def __init__(self, windows: np.ndarray, places: np.ndarray) -> None:
        n, self.size = windows.shape
        depth = max(0, math.ceil(math.log2(max(1, n) / SEGMENT)))
        shapes = _Shapes(windows)
        by = (shapes.rows[0], shapes.rows[-1], shapes.inner_high, shapes.inner_low)
        order, at = np.arange(n), np.arange(n)
        for level in range(depth):
            # Each node is sorted by one feature and halved.
            order = order[np.lexsort((by[level % len(by)][order], at * 2**level // n))]
        self.places, self.shapes = places[order], _Shapes(windows[order])
        self.starts = np.searchsorted(at * 2**depth // max(1, n), np.arange(2**depth if n else 0))
        self.fan = min(FAN, 2**depth)
        if n:
            self.leaves, self.nodes = _Boxes(self.shapes, self.places, self.starts), _Boxes(self.shapes, self.places, self.starts[:: self.fan])
            # What is asked first of each window, by leaf; short leaves end with a window that is never early.
            counts = np.diff(np.append(self.starts, n))
            at = np.minimum(self.starts[:, None] + np.arange(counts.max()), n - 1)
            y = self.shapes
            self.first_of, self.last_of, self.low_of, self.high_of, self.top_of, self.bottom_of = (v[at] for v in (y.rows[0], y.rows[-1], y.low, y.high, y.inner_high, y.inner_low))
            self.place_of = np.where(np.arange(counts.max()) < counts[:, None], self.places[at], np.iinfo(np.int64).max)

    def bounds(self, x: _Shapes, q: np.ndarray, boxes: _Boxes, b: np.ndarray) -> np.ndarray:
        """For queries and boxes, by number, a cost that no warping to a window of the box goes below.

        The first places are paired, so are the last; besides, every inner place of one side is paired with
        some place of the other."""
        total = _outside(x.rows[0][q], boxes.first[0][b], boxes.first[1][b])
        if self.size > 1:
            total = total + _outside(x.rows[-1][q], boxes.last[0][b], boxes.last[1][b])
        if self.size > 2:
            low, high = boxes.low[b], boxes.high[b]
            mine = sum(_outside(r[q], low, high) for r in x.rows[1:-1])
            theirs = np.maximum(0, boxes.least_top[b] - x.high[q]) + np.maximum(0, x.low[q] - boxes.most_bottom[b])
            total = total + np.maximum(mine, theirs)
        return total * (1 - 1e-12)

    def _costs(self, x: _Shapes, q: np.ndarray, w: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, windows and warping costs of the pairs ``q, w`` that can be as near as ``best``; bounds
        that cost more to find are taken for the pairs that the earlier ones leave."""
        y, size, slack = self.shapes, self.size, 1 - 1e-12
        ends = np.abs(x.rows[0][q] - y.rows[0][w])
        if size > 1:
            ends += np.abs(x.rows[-1][q] - y.rows[-1][w])
        if size > 2:
            mine = [_outside(r[q], y.low[w], y.high[w]) for r in x.rows[1:-1]]
            keep = np.flatnonzero((ends + sum(mine)) * slack <= best[q])
            q, w, ends, mine = q[keep], w[keep], ends[keep], [m[keep] for m in mine]
            theirs = [_outside(r[w], x.low[q], x.high[q]) for r in y.rows[1:-1]]
            least = np.maximum(sum(mine), sum(theirs))
            if size > 3:
                # The pairs after the first and before the last one are with a second place of one side at least.
                turns = sum(np.minimum(np.minimum(np.abs(x.rows[i][q] - y.rows[j][w]), np.abs(x.rows[j][q] - y.rows[i][w])), np.abs(x.rows[j][q] - y.rows[j][w])) for i, j in ((0, 1), (-1, -2)))
                least = np.maximum(least, turns + np.maximum(sum(mine[1:-1]), sum(theirs[1:-1])))
            keep = np.flatnonzero((ends + least) * slack <= best[q])
            q, w, ends = q[keep], w[keep], ends[keep]
        b = [r[w] for r in y.rows]
        row: list[np.ndarray] = []
        for i in range(size):
            a, above, row = x.rows[i][q], row, []
            for j in range(size):
                gap = np.abs(a - b[j])
                if i and j:
                    gap += np.minimum(np.minimum(above[j], row[j - 1]), above[j - 1])
                elif i or j:
                    gap += above[0] if i else row[j - 1]
                row.append(gap)
            if size > 4 and i == size // 2 - 1:
                keep = np.flatnonzero((np.minimum.reduce(row) + np.abs(x.rows[-1][q] - b[-1])) * slack <= best[q])
                q, w, b, row = q[keep], w[keep], [v[keep] for v in b], [v[keep] for v in row]
        return q, w, row[-1]

    def nearest(self, asks: np.ndarray, at: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``asks`` the cost and the number of the nearest window that ends before row ``at``,
        if it is no farther than ``best``, the earliest of equals; else the number is -1.

        Nodes are taken by their bounds, one after the other and then more at once, until none can hold a
        nearer window; many queries take their next nodes together, and in them leaf after leaf."""
        best, found = best.astype(float), np.full(len(asks), -1)
        if not len(self.places):
            return best, found
        chunk = max(1, CELLS // len(self.nodes.first_place))
        for start in range(0, len(asks), chunk):
            part = slice(start, start + chunk)
            self._nearest_of_chunk(_Shapes(asks[part]), at[part], best[part], found[part])
        return best, found

    def _nearest_of_chunk(self, x: _Shapes, at: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        bound = self.bounds(x, np.arange(len(at))[:, None], self.nodes, np.arange(len(self.nodes.first_place))[None, :])
        bound[self.nodes.first_place[None, :] + self.size > at[:, None]] = np.inf
        by_place = np.argsort(self.nodes.first_place, kind="stable")
        order = by_place[np.argsort(bound[:, by_place], axis=1, kind="stable")]
        bound = np.take_along_axis(bound, order, axis=1)
        done, width = 0, 1
        while done < order.shape[1]:
            some = bound[:, done : done + width]
            q, k = np.nonzero((some <= best[:, None]) & np.isfinite(some))
            if not len(q):
                break
            # Nodes in the order of their bounds for all queries.
            turn = np.argsort(k, kind="stable")
            q, k = q[turn], k[turn]
            step = max(1, CELLS // 4 // self.fan)
            for s in range(0, len(q), step):
                qs, ks = q[s : s + step], k[s : s + step]
                node = order[qs, done + ks]
                before = np.where(found[qs] >= 0, self.places[found[qs]], np.iinfo(np.int64).max)
                open_ = (some[qs, ks] < best[qs]) | (some[qs, ks] == best[qs]) & (self.nodes.first_place[node] < before)
                self._visit(x, qs[open_], node[open_], at, best, found)
            done, width = done + width, 2 * width

    def _visit(self, x: _Shapes, q: np.ndarray, node: np.ndarray, at: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        q, leaf = np.repeat(q, self.fan), (node[:, None] * self.fan + np.arange(self.fan)).ravel()
        bound = self.bounds(x, q, self.leaves, leaf)
        early = self.leaves.first_place[leaf]
        keep = np.flatnonzero((bound <= best[q]) & (early + self.size <= at[q]))
        keep = keep[np.lexsort((early[keep], bound[keep], q[keep]))]
        q, leaf, bound = q[keep], leaf[keep], bound[keep]
        # The nearest leaf of every query, then the next.
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        turn = np.argsort(rank, kind="stable")
        step = max(1, PAIRS // SEGMENT)
        for s in range(0, len(turn), step):
            some = turn[s : s + step]
            # Of leaves that can only be as near, those with an earlier window.
            before = np.where(found[q[some]] >= 0, self.places[found[q[some]]], np.iinfo(np.int64).max)
            some = some[(bound[some] < best[q[some]]) | (bound[some] == best[q[some]]) & (self.leaves.first_place[leaf[some]] < before)]
            # Ends and extremes first, for whole leaves.
            qs, ls = q[some], leaf[some]
            mine = lambda v: v[qs][:, None]
            least = np.abs(self.first_of[ls] - mine(x.rows[0]))
            if self.size > 1:
                least += np.abs(self.last_of[ls] - mine(x.rows[-1]))
            if self.size > 2:
                above = np.maximum(0, mine(x.inner_high) - self.high_of[ls]) + np.maximum(0, self.low_of[ls] - mine(x.inner_low))
                below = np.maximum(0, self.top_of[ls] - mine(x.high)) + np.maximum(0, mine(x.low) - self.bottom_of[ls])
                least += np.maximum(above, below)
            pair, k = np.divmod(np.flatnonzero((least * (1 - 1e-12) <= best[qs][:, None]) & (self.place_of[ls] <= mine(at) - self.size)), least.shape[1])
            self._improve(x, qs[pair], self.starts[ls[pair]] + k, best, found)

    def _improve(self, x: _Shapes, q: np.ndarray, w: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        q, w, cost = self._costs(x, q, w, best)
        place = self.places[w]
        order = np.lexsort((place, cost, q))
        first = order[np.r_[True, q[order][1:] != q[order][:-1]]] if len(q) else order
        q, w, cost, place = q[first], w[first], cost[first], place[first]
        before = np.where(found[q] >= 0, self.places[found[q]], np.iinfo(np.int64).max)
        nearer = np.isfinite(cost) & ((cost < best[q]) | (cost == best[q]) & (place < before))
        best[q[nearer]], found[q[nearer]] = cost[nearer], w[nearer]


def _cells(windows: DataFrame, values: Sequence[str]) -> DataFrame:
    """``cell, slab`` of each window: keys of over CELL windows are cut by first value, last value and inner
    extremes, at quantiles of the cell so far; what is still larger, as of equal windows, is cut by place, along
    the blocks.  Which window is in which cell changes no result.
    """
    inner = [_c(v) for v in values[1:-1]]
    by = [_c(values[0]), _c(values[-1]), *([F.greatest(*inner), F.least(*inner)] if len(inner) > 1 else inner)]
    most = windows.groupBy("_key").count().agg(F.max("count")).first()[0] or 1
    halvings = [0] * len(by)
    turns = [t for t in (0, 1, 0, 1, 2, 3) if t < len(by)]
    for i in range(math.ceil(math.log2(max(1, most / CELL)))):
        halvings[turns[i % len(turns)]] += 1
    cells = windows.withColumn("cell", F.lit(0).cast("long"))
    for value, parts in ((v, 2**h) for v, h in zip(by, halvings) if h):
        # One row per cell that is too large.
        cuts = cells.groupBy("_key", "cell").agg(F.count(F.lit(1)).alias("_many"), F.percentile_approx(value, [i / parts for i in range(1, parts)], 1_000).alias("_cuts"))
        cuts = cuts.where(_c("_many") > CELL).drop("_many")
        over = F.size(F.filter("_cuts", lambda c, value=value: c <= value))
        cells = cells.join(F.broadcast(cuts), ["_key", "cell"], "left").withColumn("cell", _c("cell") * parts + F.when(_c("_cuts").isNull(), 0).otherwise(over)).drop("_cuts")
    cells = pin(cells)
    before = Window.partitionBy("_key", "cell").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    slabs = cells.groupBy("_key", "cell", "block").count().select("_key", "cell", "block", F.floor(F.coalesce(F.sum("count").over(before), F.lit(0)) / CELL).alias("slab"))
    return pin(cells.join(slabs, ["_key", "cell", "block"]))


def nearest_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], price: str, window: int, chosen: Column) -> DataFrame:
    """For each window whose first row is ``chosen`` the nearest window of its key that ends before it starts:
    ``*keys, *order, x, partner_<order>, partner, distance``; distance by warping, the earliest of equals.

    The whole earlier series is searched.  Windows are put in cells alike in value (:func:`_cells`), whose
    envelopes give a least cost.  Each query first looks through its own cell, then through all cells that can
    still hold a nearer one; inside a cell the windows are indexed by value (:class:`WindowIndex`).  Queries
    meet a cell in chunks.  A query without an earlier window, or with a missing price in it, has no row;
    windows with a missing price are no partners.
    """
    lay = lay_out(df.select(*keys, *order, _c(price).cast("double").alias("_x"), chosen.alias("_chosen")), keys, order, after=window - 1)
    # One key that is never null: joins below are on it.
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    kept = lay.df.select(key.alias("_key"), *[_c(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[_c(o).alias(f"_o{i}") for i, o in enumerate(order)], "_x", "_chosen", POS, OWN, _c(BLOCK).alias("block"))
    kept = pin(kept)
    values = [f"_w{i}" for i in range(window)]
    ahead = Window.partitionBy("_key", "block").orderBy(POS)
    every = kept.select("*", *[F.lead("_x", i).over(ahead).alias(v) for i, v in enumerate(values)]).where(OWN)
    sound = reduce(lambda a, b: a & b, [_c(v).isNotNull() & ~F.isnan(v) & (F.abs(v) != math.inf) for v in values])
    windows = _cells(pin(every.where(sound).select("_key", "block", _c(POS).alias("first"), F.coalesce("_chosen", F.lit(False)).alias("asks"), *values)), values)
    cell = ["_key", "cell", "slab"]
    smallest, largest = (F.least(*values), F.greatest(*values)) if window > 1 else (_c(values[0]), _c(values[0]))
    sides = {"low": smallest, "high": largest, **{f"{side}_{end}": _c(v) for end, v in (("first", values[0]), ("last", values[-1])) for side in ("low", "high")}}
    boxes = pin(windows.groupBy(*cell).agg(F.min("first").alias("first"), *[(F.min if e.startswith("low") else F.max)(sides[e]).alias(e) for e in ENVELOPE]))
    queries = pin(windows.where("asks").select(*cell, _c("first").alias("at"), F.array(*values).alias("x")))

    def look(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame([], columns=["at", "distance", "from", "partner"])
        if not (len(rows) and len(asks)):
            return out
        index = WindowIndex(rows[values].to_numpy(dtype=float), rows["first"].to_numpy())
        cost, number = index.nearest(np.stack(asks["x"].tolist()).astype(float), asks["at"].to_numpy(), asks["best"].to_numpy())
        has = np.flatnonzero(number >= 0)
        if not len(has):
            return out
        return pd.DataFrame({"at": asks["at"].to_numpy()[has], "distance": cost[has], "from": index.places[number[has]], "partner": index.shapes.rows[:, number[has]].T.tolist()})

    def visit(pairs: DataFrame) -> DataFrame:
        """``pairs`` of queries and cells, in chunks of about QUERIES queries; ``at`` names a query."""
        pairs = pin(pairs)
        parts = pairs.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("_parts"))
        asked = pairs.join(parts, cell).withColumn("_part", F.pmod(F.xxhash64("at"), "_parts")).drop("_parts")
        placed = windows.select(*cell, "first", *values).join(parts, cell).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), _c("_parts") - 1))).drop("_parts")
        return placed.groupBy(*cell, "_part").cogroup(asked.groupBy(*cell, "_part")).applyInPandas(look, "at long, distance double, from long, partner array<double>")

    def better(found: Sequence[DataFrame]) -> DataFrame:
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        return pin(every.groupBy("at").agg(F.min(F.struct("distance", "from", "partner")).alias("f")).select("at", "f.*"))

    # One row per cell; which cells have windows before a query and may hold a nearer one, or an earlier one as near.
    def open_cells(best: DataFrame) -> DataFrame:
        known = queries.join(best.select("at", _c("distance").alias("best"), "from"), "at", "left").withColumn("best", F.coalesce("best", F.lit(math.inf)))
        known = known.withColumnsRenamed({"cell": "_cell", "slab": "_slab"})
        pairs = known.join(boxes, "_key").where(((_c("cell") != _c("_cell")) | (_c("slab") != _c("_slab"))) & (_c("first") + window <= _c("at")))
        least = _least_cost_column(_c("x"), window) * (1 - 1e-12)
        return pairs.where((least < _c("best")) | (least == _c("best")) & (_c("from").isNull() | (_c("first") < _c("from")))).select(*cell, "at", "x", "best")

    first = better([visit(queries.select(*cell, "at", "x", F.lit(math.inf).alias("best")))])
    done = better([first, visit(open_cells(first))])
    own_rows = kept.where(OWN)
    mine = own_rows.select(_c(POS).alias("at"), *[_c(f"_k{i}").alias(k) for i, k in enumerate(keys)], *[_c(f"_o{i}").alias(o) for i, o in enumerate(order)])
    theirs = own_rows.select(_c(POS).alias("from"), *[_c(f"_o{i}").alias(f"partner_{o}") for i, o in enumerate(order)])
    return done.join(queries.select("at", "x"), "at").join(mine, "at").join(theirs, "from").select(*keys, *order, "x", *[f"partner_{o}" for o in order], "partner", "distance")


def dtw_mixup(df: DataFrame, keys: Sequence[str], order: Sequence[str], price: str, window: int = 8, ratio: float = 0.5, seed: int = 0) -> DataFrame:
    """Windows mixed with the nearest earlier window by dynamic time warping: ``*keys, *order,
    partner_<order>, mixed, distance, lam``, named by the first rows of both.

    A window is chosen by the MD5 of seed and order, so draws don't depend on placement; ``ratio`` is the
    number of new rows per row.  The weight ~ Beta(0.4, 0.4) is drawn from the same number.
    """
    number = row_number_of(F.concat_ws(":", F.lit(seed), *order))
    found = nearest_windows(df, keys, order, price, window, number < int(PRIME * min(1.0, ratio / window)))
    schema = found.drop("x", "partner").schema.add("mixed", T.ArrayType(T.DoubleType())).add("lam", T.DoubleType())

    def mix(batches):
        for pdf in batches:
            lam = np.array([np.random.default_rng(int(n)).beta(0.4, 0.4) for n in pdf["_number"]])
            x, other = (np.array(pdf[c].tolist(), dtype=float).reshape(len(pdf), window) for c in ("x", "partner"))
            mixed = lam[:, None] * x + (1 - lam[:, None]) * warped_partners(x, other)
            yield pdf.drop(columns=["x", "partner", "_number"]).assign(mixed=list(mixed), lam=lam)[schema.names]

    return found.withColumn("_number", number).mapInPandas(mix, schema)
