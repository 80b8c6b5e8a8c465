"""Hard-negative mining: exact windows of inner products from cover trees."""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.search import integer_vectors
from tapeloom.session import pin, shuffle_partitions

# Rows of a tree, trees of a shelf and anchors of a block: what a task holds, by construction; anchors travel in bundles.
TREE_ROWS, SHELF_TREES, BLOCK_ROWS, BUNDLE = 8_192, 64, 65_536, 512
# Levels shrink by this factor; nodes of so few rows are leaves, and so are those whose children have fewer than CHILD_ROWS on average.
SHRINK, LEAF_ROWS, CHILD_ROWS = 1.3, 256, 16
# Anchors that descend a tree together, and rows of a leaf that they are multiplied with at once.
GROUP, PIECE = 1_024, 1_024
LONG = np.iinfo(np.int64)
# Sums of whole products are exact in floats and doubles below these: no part of a sum is above the product of the norms.
EXACT = {np.dtype(np.float32): 2.0**23, np.dtype(np.float64): 2.0**52}


class Asks:
    """Anchors with windows of scores (least and largest, a column each), and the ``k`` best rows in each so far."""

    def __init__(self, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.anchors, self.ids, self.labels, self.rows, self.high, self.k = anchors, ids, labels, rows, high, k
        self.norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        self.scores, self.found = np.zeros((k, *low.shape), dtype=np.int64), np.zeros((k, *low.shape), dtype=np.int64)
        self.many = np.zeros(low.shape, dtype=np.int64)
        # The least score that still counts; the id below which an equal one does.
        self.floor, self.before = low.copy(), np.full(low.shape, LONG.max)
        # Least and largest score that any window of an anchor still takes; none does if the first is above the second.
        self.least, self.most = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        self._reach(np.arange(len(ids)))

    def _reach(self, at: np.ndarray) -> None:
        live = self.floor[at] <= self.high[at]
        self.least[at] = np.where(live, self.floor[at], LONG.max).min(axis=1, initial=LONG.max)
        self.most[at] = np.where(live, self.high[at], LONG.min).max(axis=1, initial=LONG.min)

    def take(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Rows for the anchors ``at``; ties go to smaller ids."""
        if not len(at):
            return
        for w in range(self.high.shape[1]):
            floor = self.floor[at, w]
            full = self.many[at, w] == self.k
            hit = np.flatnonzero((scores <= self.high[at, w]) & ((scores > floor) | (scores == floor) & (~full | (ids < self.before[at, w]))))
            if not len(hit):
                continue
            own = np.unique(at[hit])
            rank, old = np.nonzero(np.arange(self.k)[:, None] < self.many[own, w])
            a = np.concatenate([own[old], at[hit]])
            s = np.concatenate([self.scores[rank, own[old], w], scores[hit]])
            n = np.concatenate([self.found[rank, own[old], w], ids[hit]])
            order = np.lexsort((n, ~s, a))
            a, s, n = a[order], s[order], n[order]
            starts = np.searchsorted(a, own)
            rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
            best = rank < self.k
            self.scores[rank[best], a[best], w], self.found[rank[best], a[best], w] = s[best], n[best]
            self.many[own, w] = np.minimum(self.k, np.diff(np.append(starts, len(a))))
            done = own[self.many[own, w] == self.k]
            self.floor[done, w], self.before[done, w] = self.scores[-1, done, w], self.found[-1, done, w]
        self._reach(np.unique(at))

    def rows_found(self) -> pd.DataFrame:
        rank, at, which = np.nonzero(np.arange(self.k)[:, None, None] < self.many)
        return pd.DataFrame({"anchor": self.anchors[at], "which": which, "id": self.found[rank, at, which], "score": self.scores[rank, at, which]}, dtype="int64")


class CoverTree:
    """Rows sorted so that each node is a slice, with its centre, covering radius and slice of children.

    Rows get one more component that makes all norms equal, so they lie on a sphere and the distance of two
    of them tells their inner product.  A node's children are centres among its rows, each more than the
    next level's radius from those before it, and every row hangs on the first centre within that radius.
    ``radius`` is the largest distance from the centre to any row below.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, tree: dict | None = None) -> None:
        self.ids, self.labels, self.rows = ids, labels, rows
        if tree is None:
            tree = self._grow()
        self.centre, self.radius, self.low, self.high, self.first, self.last = (tree[c] for c in ("centre", "radius", "low", "high", "first", "last"))
        self.norms = np.sqrt(np.einsum("ij,ij->i", rows, rows)) if len(rows) else np.zeros(0)
        self.sphere = float(self.norms.max(initial=0.0))
        # The angle that a node's radius, a chord of the sphere, spans.
        self.spread = 2 * np.arcsin(np.clip(self.radius / (2 * (self.sphere or 1.0)), 0.0, 1.0))

    def _grow(self) -> dict:
        """Level by level; also sorts the rows."""
        squares = np.einsum("ij,ij->i", self.rows, self.rows)
        top = squares.max(initial=0.0)
        points = np.column_stack([self.rows, np.sqrt(np.maximum(0.0, top - squares))])

        def far(centre: int, those: np.ndarray) -> np.ndarray:
            return np.sqrt(np.einsum("ij,ij->i", d := points[those] - points[centre], d))

        order = np.arange(len(points))
        nodes = {c: [] for c in ("centre", "radius", "low", "high", "first", "last")}

        def add(centre: int, radius: float, low: int, high: int) -> None:
            for name, value in zip(nodes, (centre, radius, low, high, 0, 0)):
                nodes[name].append(value)

        if len(order):
            add(0, float(far(0, order).max()), 0, len(order))
        at = 0
        while at < len(nodes["low"]):
            low, high, centre, radius = nodes["low"][at], nodes["high"][at], nodes["centre"][at], nodes["radius"][at]
            if high - low > LEAF_ROWS and radius > 0:
                # The level below the covering radius, on one scale for the whole tree.
                level = SHRINK ** (math.ceil(math.log(radius, SHRINK)) - 1)
                rest, children = order[low:high].copy(), []
                rest = np.concatenate(([centre], rest[rest != centre]))
                while len(rest) and (high - low - len(rest)) >= CHILD_ROWS * (len(children) - CHILD_ROWS):
                    distance = far(rest[0], rest)
                    inside = distance <= level
                    inside[0] = True
                    children.append((rest[inside], float(distance[inside].max())))
                    rest = rest[~inside]
                if not len(rest):
                    nodes["first"][at] = len(nodes["low"])
                    place = low
                    for own, reach in children:
                        order[place : place + len(own)] = own
                        add(int(own[0]), reach, place, place + len(own))
                        place += len(own)
                    nodes["last"][at] = len(nodes["low"])
            at += 1
        # Rows of a leaf lie by label.
        for low, high, last in zip(nodes["low"], nodes["high"], nodes["last"]):
            if not last:
                order[low:high] = order[low:high][np.argsort(self.labels[order[low:high]], kind="stable")]
        where = np.empty(len(order), dtype=np.int64)
        where[order] = np.arange(len(order))
        self.ids, self.labels, self.rows = self.ids[order], self.labels[order], self.rows[order]
        made = {name: np.asarray(values, dtype=float if name == "radius" else np.int64) for name, values in nodes.items()}
        made["centre"] = where[made["centre"]]
        return made

    def products(self, at: np.ndarray | slice, queries: np.ndarray) -> np.ndarray:
        """Queries x rows: exact inner products as whole numbers; beyond a long they count as its limit."""
        width = min(self.rows.shape[1], queries.shape[1])
        rows, queries = self.rows[at, :width], queries[:, :width]
        if rows.dtype == queries.dtype:
            return queries @ rows.T
        exact = [[sum(int(a) * int(b) for a, b in zip(row, query)) for row in rows] for query in queries]
        return np.array([min(max(s, LONG.min), LONG.max) for line in exact for s in line], dtype=np.int64).reshape(len(queries), len(rows))

    def bounds(self, nodes: np.ndarray, scores: np.ndarray, norm: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of any row below: the node's centre is at some angle from the
        query, and the radius is a chord of the sphere."""
        scale = norm * self.sphere
        angle = np.arccos(np.clip(scores / np.where(scale > 0, scale, 1.0), -1.0, 1.0))
        spread = self.spread[nodes]
        slack = 1e-6 * scale + 1
        return scale * np.cos(np.minimum(np.pi, angle + spread)) - slack, scale * np.cos(np.maximum(0.0, angle - spread)) + slack

    def search(self, asks: Asks, same: bool) -> None:
        """Gives ``asks`` the rows of their own label but not their own id, or the rows of other labels, that
        are among the best of a window.

        Anchors descend together, each to the nodes whose bounds meet the scores that its windows still take,
        which end at its ``k``-th best so far.  Leaves that few meet are taken by the largest score they can
        hold.  Rows of leaves are verified by exact products.
        """
        if not len(self.low):
            return
        if same:  # anchors of one label; only rows of that label count
            at = np.flatnonzero(np.isin(asks.labels, self.labels))
            at = at[np.argsort(asks.labels[at], kind="stable")]
            groups = [g[i : i + GROUP] for g in np.split(at, np.flatnonzero(np.diff(asks.labels[at])) + 1) for i in range(0, len(g), GROUP)]
        else:
            groups = [np.arange(i, min(i + GROUP, len(asks.ids))) for i in range(0, len(asks.ids), GROUP)]
        kind = next((k for k, most in EXACT.items() if self.sphere * asks.norms.max(initial=0.0) < most), None)
        mine = copy.copy(self)
        mine.rows = self.rows.astype(kind or float)
        for group in groups:
            # Doubles that are not exact are told from exact ones by their kind.
            mine._search_group(asks, group, asks.rows[group].astype(kind or object), same)

    def _search_group(self, asks: Asks, group: np.ndarray, queries: np.ndarray, same: bool) -> None:
        norms = asks.norms[group][:, None]
        width = min(self.rows.shape[1], asks.rows.shape[1])

        def meets(lowest: np.ndarray, highest: np.ndarray) -> np.ndarray:
            floor, end = asks.least[group], asks.most[group]
            return (lowest <= end[:, None]) & (highest >= floor[:, None]) & (floor <= end)[:, None]

        def below(n: int) -> np.ndarray:
            low, high = self.low[n], self.high[n]
            if same:
                low, high = low + np.searchsorted(self.labels[low:high], asks.labels[group[0]], "left"), low + np.searchsorted(self.labels[low:high], asks.labels[group[0]], "right")
            return np.arange(low, high)

        def verify(rows: np.ndarray, open_: np.ndarray) -> None:
            scores = self.products(rows, queries[open_])
            a, r = np.divmod(np.flatnonzero(scores >= asks.least[group[open_]][:, None].astype(scores.dtype)), max(1, len(rows)))
            scores, at, row = scores[a, r], group[open_[a]], rows[r]
            fits = scores <= asks.most[at].astype(scores.dtype)
            fits &= (self.ids[row] != asks.ids[at]) if same else (self.labels[row] != asks.labels[at])
            asks.take(at[fits], scores[fits].astype(np.int64), self.ids[row[fits]])

        nodes, above, leaves = np.array([0]), np.ones((len(group), 1), dtype=bool), []
        while len(nodes):
            scores = asks.rows[group][:, :width] @ self.rows[self.centre[nodes], :width].T.astype(float)
            lowest, highest = (np.clip(b, LONG.min, LONG.max) for b in self.bounds(nodes, scores, norms))
            use = above & meets(lowest, highest)
            some = use.any(axis=0)
            leaves += [(n, use[:, i], lowest[:, i], highest[:, i]) for i, n in enumerate(nodes) if some[i] and not self.last[n]]
            inner = [i for i, n in enumerate(nodes) if some[i] and self.last[n]]
            above = np.concatenate([np.repeat(use[:, i : i + 1], self.last[nodes[i]] - self.first[nodes[i]], axis=1) for i in inner], axis=1) if inner else None
            nodes = np.concatenate([np.arange(self.first[nodes[i]], self.last[nodes[i]]) for i in inner]) if inner else nodes[:0]
        # Leaves that most anchors meet are verified together, the others each for its own anchors.
        common, rare = [], []
        for leaf in leaves:
            (common if 2 * leaf[1].sum() > len(group) else rare).append(leaf)
        rows = np.concatenate([below(leaf[0]) for leaf in common]) if common else np.arange(0)
        start, many = 0, PIECE // 4
        while start < len(rows):
            open_ = np.flatnonzero(asks.least[group] <= asks.most[group])
            verify(rows[start : start + many], open_)
            start, many = start + many, PIECE
        for n, use, lowest, highest in sorted(rare, key=lambda leaf: -leaf[3][leaf[1]].max()):
            rows = below(n)
            for start in range(0, len(rows), PIECE):
                verify(rows[start : start + PIECE], np.flatnonzero(use & meets(lowest[:, None], highest[:, None])[:, 0]))


# Rows are whole numbers, in two bytes each if they fit; kind is numpy's name of the type.
_TREE = "tree long, width int, kind string, ids array<long>, labels array<long>, rows binary, centre array<long>, radius array<double>, low array<long>, high array<long>, first array<long>, last array<long>"


def _padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            width = max((len(v) for v in row.vectors), default=0)
            ids, labels = np.asarray(row.ids, dtype=np.int64), np.asarray(row.labels, dtype=np.int64)
            tree = CoverTree(ids, labels, _padded(row.vectors, width))
            made = {c: [getattr(tree, c)] for c in ("ids", "labels", "centre", "radius", "low", "high", "first", "last")}
            kind = "<i2" if np.abs(tree.rows).max(initial=0.0) < 2**15 else "<f8"
            yield pd.DataFrame({"tree": [row.tree], "width": [width], "kind": [kind], "rows": [tree.rows.astype(kind).tobytes()], **made})[[c.split(" ")[0] for c in _TREE.split(", ")]]


def cover_trees(rows: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """One row per tree over ``id, label, v``: rows are dealt to trees of about ``tree_rows`` by a hash of
    the whole row and its place, so that equal vectors or a frequent label are not one tree."""
    trees = max(1, math.ceil(rows.count() / tree_rows))
    number = F.pmod(F.xxhash64("id", "label", F.monotonically_increasing_id()), F.lit(trees))
    packed = rows.groupBy(number.alias("tree")).agg(F.collect_list(F.struct("id", "label", "v")).alias("r"))
    packed = packed.select("tree", F.col("r")["id"].alias("ids"), F.col("r")["label"].alias("labels"), F.col("r")["v"].alias("vectors"))
    return packed.mapInPandas(_plant, _TREE)


def _asks(bundles: pd.DataFrame, same: bool, k: int, percent: tuple[int, int]) -> Asks:
    """The anchors of a block: any score will do, or those in the windows that the positives' scores give."""
    ids, labels, anchors = (np.concatenate([np.asarray(v, dtype=np.int64) for v in bundles[c]]) for c in ("ids", "labels", "anchors"))
    sizes = np.concatenate([np.asarray(v, dtype=np.int64) for v in bundles["sizes"]])
    rows, place = np.zeros((len(ids), sizes.max(initial=0))), np.arange(sizes.max(initial=0))
    rows[place < sizes[:, None]] = np.concatenate([np.asarray(v, dtype=float) for v in bundles["components"]])
    if same:
        return Asks(anchors, ids, labels, rows, np.full((len(ids), 1), LONG.min), np.full((len(ids), 1), LONG.max), k)
    scores = [s for bundle in bundles["scores"] for s in bundle]
    low, high = np.ones((len(ids), max(map(len, scores))), dtype=np.int64), np.zeros((len(ids), max(map(len, scores))), dtype=np.int64)
    for i, some in enumerate(scores):
        for w, s in enumerate(some):
            least, most = -(-percent[0] * int(s) // 100), percent[1] * int(s) // 100
            if least <= most and least <= LONG.max and most >= LONG.min:
                low[i, w], high[i, w] = max(least, LONG.min), min(most, LONG.max)
    return Asks(anchors, ids, labels, rows, low, high, k)


def _ask(same: bool, k: int, percent: tuple[int, int]):
    """Search the trees of a shelf, one after the other, for the anchors of a block."""

    def run(trees: pd.DataFrame, bundles: pd.DataFrame) -> pd.DataFrame:
        if not (len(trees) and len(bundles)):
            return pd.DataFrame([], columns=["anchor", "which", "id", "score"], dtype="int64")
        asks = _asks(bundles, same, k, percent)
        for row in trees.itertuples(index=False):
            parts = {c: np.asarray(getattr(row, c)) for c in ("centre", "radius", "low", "high", "first", "last")}
            vectors = np.frombuffer(row.rows, dtype=row.kind).astype(float).reshape(len(row.ids), row.width)
            CoverTree(np.asarray(row.ids), np.asarray(row.labels), vectors, parts).search(asks, same)
        return asks.rows_found()

    return run


def _numbers(many: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))


def _asked(trees: DataFrame, anchors: DataFrame, same: bool, k: int, percent: tuple[int, int], block_rows: int) -> DataFrame:
    """``anchor, which, rank, id, score``: the ``k`` best of all trees per anchor and window.

    Every block of anchors meets every shelf of trees, the stated anchors against all rows, in a task that
    hands on at most ``k`` rows per anchor and window.  No table has a row per block and tree: what travels is
    each tree once per block and each bundle of anchors once per shelf.
    """
    most, many = trees.count(), anchors.count()
    blocks = max(1, math.ceil(many / block_rows))
    # Enough shelves for all tasks, but no more than trees.
    shelves = max(1, math.ceil(most / SHELF_TREES), min(most, math.ceil(shuffle_partitions(trees.sparkSession) / blocks)))
    bundle = F.pmod(F.xxhash64("anchor"), F.lit(blocks * math.ceil(min(block_rows, many or 1) / BUNDLE)))
    packed = anchors.groupBy(bundle.alias("bundle")).agg(F.collect_list(F.struct("anchor", "id", "label", "v", "scores")).alias("r"))
    packed = packed.select(
        F.pmod("bundle", F.lit(blocks)).alias("block"), F.explode(_numbers(shelves)).alias("shelf"), F.col("r")["anchor"].alias("anchors"), F.col("r")["id"].alias("ids"),
        F.col("r")["label"].alias("labels"), F.transform(F.col("r")["v"], F.size).alias("sizes"), F.flatten(F.col("r")["v"]).alias("components"), F.col("r")["scores"].alias("scores"),
    )
    placed = trees.withColumn("shelf", F.pmod("tree", F.lit(shelves))).withColumn("block", F.explode(_numbers(blocks)))
    found = placed.groupBy("shelf", "block").cogroup(packed.groupBy("shelf", "block")).applyInPandas(_ask(same, k, percent), "anchor long, which long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "which").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 3,
    percent: tuple[int, int] = (50, 95),
    key: str = "vec_id",
    vector: str = "embedding",
    tree_rows: int = TREE_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for every anchor and each
    of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose
    score is between ``percent`` of the positive's, both ends included.  Scores are integer inner products
    with the anchor, ties go to the smaller id.

    ``is_anchor`` and ``label`` (an integer, by default the column of that name) are expressions on
    ``vectors``.  Rows are dealt to cover trees, which are written once; anchors in blocks ask every tree
    twice, first for positives, then for negatives in the windows of the positives' scores, many at once.

    Rows with a null key or label, a null vector or a component that is null or not finite take no part.
    Vectors of different lengths count as ending in zeros.  Rows that are equal in key, label and vector
    are one anchor, but candidates each; an anchor is no positive of its own key.  A positive score below
    zero leaves an empty window.  Scores and components beyond a long count as its limit.  An anchor
    without positives, or a positive without negatives, has no row; neither has an empty table.
    """
    label = F.col("label") if label is None else label
    given = vectors.select(F.struct(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("ask")).alias("_key"), F.col(vector).alias("_vector"))
    rows = integer_vectors(given.withColumn("_id", F.monotonically_increasing_id()), "_id", "_vector", carry=["_key"])
    rows = pin(rows.select("_key.id", "_key.label", "_key.ask", "v").where("id is not null and label is not null"))
    trees = pin(cover_trees(rows.drop("ask"), tree_rows))
    anchors = rows.where("ask").select("id", "label", "v").distinct()
    anchors = pin(anchors.withColumn("anchor", F.monotonically_increasing_id()))
    first = anchors.withColumn("scores", F.array().cast("array<long>"))
    found = pin(_asked(trees, first, True, positives, percent, block_rows).drop("which"))
    scores = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))
    scored = anchors.join(scores, "anchor").withColumn("scores", F.col("found")["score"])
    hard = _asked(trees, scored.drop("found"), False, negatives, percent, block_rows)
    hard = hard.select("anchor", (F.col("which") + 1).cast("int").alias("positive_rank"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    positive = found.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    positive = positive.select("anchor", "anchor_id", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return positive.join(hard, ["anchor", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
