"""Exact top-k search by inner product with MaxScore pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import pin

# Vectors of a shard (64 components: 8 MB) and of a block of queries: both bounds hold by construction.
SHARD_ROWS = 32_768
BLOCK_ROWS = 1_024
PILOT = 64
LONG = np.iinfo(np.int64)


def integer_vectors(vectors: DataFrame, key: str, vector: str, carry: Sequence[str] = ()) -> DataFrame:
    """``id, v``: each component x as floor(256 * x), x as double, after the columns of ``carry``.  Rows with
    a null vector, or a component that is null or not finite, take no part; neither do rows with a null key."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = ~F.exists(F.col("x"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    got = vectors.select(*carry, F.col(key).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(sound)
    return got.select(*carry, "id", F.transform("x", lambda c: F.floor(c * 256).cast("double")).alias("v"))


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    if np.abs(out, where=out != 0, out=np.zeros_like(out)).max(initial=0) < 2**28 and width < 64 * 64:
        return out.astype(np.int64)
    exact = np.array([[int(c) for c in row] for row in out], dtype=object)
    return exact.reshape(out.shape)


class Postings:
    """Inverted lists of a shard: a term is a component and a sign, its list the rows whose component has
    that sign, by falling size.  ``top`` is the largest size in each list."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        self.ids, self.matrix = ids, matrix
        self.columns = [np.ascontiguousarray(c) for c in matrix.T]
        self.rows: dict[tuple[int, int], np.ndarray] = {}
        self.top: dict[tuple[int, int], int] = {}
        for d, column in enumerate(self.columns):
            for sign in (1, -1):
                listed = np.flatnonzero(sign * column > 0)
                listed = listed[np.argsort(-sign * column[listed], kind="stable")]
                self.rows[d, sign] = listed
                self.top[d, sign] = sign * column[listed[0]] if len(listed) else 0


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    order = np.lexsort((ids, -scores))[:k]
    return order


def max_score(index: Postings, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best rows but the query's own, ties to smaller ids.

    A query term is a component with its sign: only rows in that list gain from it, at most ``bound``;
    rows in the list of the other sign lose.  Terms with the smallest bounds, as long as their sum can't
    reach the threshold, are non-essential: a row in no essential list can't be among the best.
    Essential lists are traversed and summed up; the rows found are probed term by term, from the
    largest bound down, while what is known plus what is left can still reach the threshold.
    """
    n, width = index.matrix.shape
    terms = [(d, 1 if q > 0 else -1) for d, q in enumerate(query[:width].tolist()) if q]
    bound = {t: abs(query[t[0]]) * index.top[t] for t in terms}
    terms.sort(key=lambda t: -bound[t])
    everyone = np.flatnonzero(index.ids != query_id)
    if len(everyone) <= max(PILOT, k) or not terms:
        scores = index.matrix[everyone][:, : len(query)] @ query[:width]
        order = _best(index.ids[everyone], scores, k)
        return index.ids[everyone][order], scores[order]
    # A first threshold from rows that are strong in the strongest terms.
    pilot = np.unique(np.concatenate([index.rows[t][:PILOT] for t in terms[:4]]))
    pilot = pilot[index.ids[pilot] != query_id]
    threshold = None
    if len(pilot) >= k:
        scores = index.matrix[pilot] @ query[:width]
        threshold = scores[_best(index.ids[pilot], scores, k)[-1]]
    # Without a positive threshold every row can compete: a row in no list at all has 0 or less.
    left = 0
    essential = len(terms)
    if threshold is not None and threshold > 0:
        while essential and left + bound[terms[essential - 1]] < threshold:
            essential -= 1
            left += bound[terms[essential]]
        hit = np.zeros(n, dtype=bool)
        for t in terms[:essential]:
            hit[index.rows[t]] = True
        hit &= index.ids != query_id
        alive = np.flatnonzero(hit)
    else:
        alive = everyone
    sums = np.zeros(len(alive), dtype=index.matrix.dtype)
    for d, _ in terms[:essential]:
        sums += index.columns[d][alive] * query[d]
    for t in terms[essential:]:
        keep = sums + left >= threshold
        alive, sums = alive[keep], sums[keep] + index.columns[t[0]][alive[keep]] * query[t[0]]
        left -= bound[t]
    order = _best(index.ids[alive], sums, k)
    return index.ids[alive][order], sums[order]


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, index = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.shard != last:
                    ids = np.asarray(row.ids, dtype=np.int64)
                    width = max((len(v) for v in row.vectors), default=0)
                    last, index = row.shard, Postings(ids, _matrix(row.vectors, width))
                out = []
                queries = _matrix(row.query_vectors, max(max((len(v) for v in row.query_vectors), default=0), index.matrix.shape[1]))
                for number, query_id, query in zip(row.numbers.tolist(), row.query_ids.tolist(), queries):
                    ids, scores = max_score(index, query_id, query, k)
                    out += [(number, query_id, i, min(max(int(s), LONG.min), LONG.max)) for i, s in zip(ids.tolist(), scores.tolist())]
                yield pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score"], dtype="int64")

    return run


def _packed(rows: DataFrame, name: str, pieces: int, **columns: str) -> DataFrame:
    """One row per piece with the ``columns`` of its rows as arrays; pieces are of nearly equal size."""
    number = F.pmod(F.xxhash64("id"), F.lit(pieces))
    packed = rows.groupBy(number.alias(name)).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return packed.select(name, *[F.col("rows")[c].alias(a) for c, a in columns.items()])


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest integer inner products of every query with all
    other rows, ties to the smaller id; all of them if there are fewer.

    ``is_query`` is a condition on ``key``.  Candidates are cut into shards and queries into blocks;
    every block meets every shard, and shards return at most ``k`` rows per query, which are merged.
    What travels is each candidate once and each query once per shard.

    Rows with a null key, a null vector or a component that is null or not finite take no part.  Vectors
    of different lengths count as ending in zeros; an empty vector scores 0.  Rows that repeat a key are
    all skipped by queries of that key, and are candidates each; as queries, equal rows are asked once and
    different ones each for itself, with the same ``query_id``.  Scores beyond a long are given as
    its limit.  Other columns are ignored; no rows or no queries give no rows.
    """
    rows = integer_vectors(vectors, key, vector)
    # Numbers depend on placement, so the queries are written once.
    queries = pin(integer_vectors(vectors.where(is_query), key, vector).distinct().withColumn("query", F.monotonically_increasing_id()))
    shards = max(1, math.ceil(rows.count() / shard_rows))
    blocks = max(1, math.ceil(queries.count() / block_rows))
    pieces = _packed(rows, "shard", shards, id="ids", v="vectors")
    asked = _packed(queries, "block", blocks, query="numbers", id="query_ids", v="query_vectors")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = pieces.join(asked, "shard").select("shard", "ids", "vectors", "numbers", "query_ids", "query_vectors")
    found = found.mapInPandas(_search(k), "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
