"""Packing of documents into batches: length buckets with the least padding, token budgets inside."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tapeloom.llm.common import words
from tapeloom.session import pin

BUCKETS, BUDGET = 12, 16_384
# Lengths up to here are kept apart in the histogram; longer ones are rounded up by less than one part in
# this many, so that the histogram is bounded whatever the lengths are.
FINE = 2_048
# Rows that share a numbering, or PART_BATCHES full batches if that is more; a bucket is cut into as many
# parts as it has such.
PART_ROWS, PART_BATCHES = 2_000, 16


def grid(length: Column, fine: int = FINE) -> Column:
    """Round a length up to one that a bucket may end at: itself up to ``fine``, then to a multiple of the
    power of two that leaves ``fine`` steps in each doubling."""
    doublings = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1)) / F.lit(float(fine)))))
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), doublings - 1))
    return (F.ceil(length / step) * step).cast("long")


def best_bounds(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that pad the least in all.

    ``lengths`` rise strictly.  Dynamic programming over the histogram: the best cost of the first j
    lengths in k buckets is the least over i of that of the first i in k - 1, plus padding the others to
    the longest.  Where the last bucket best starts never moves left as j grows, so each layer is filled
    by halving: buckets * n log n steps for n lengths.
    """
    lengths, counts = np.asarray(lengths, dtype=np.float64), np.asarray(counts, dtype=np.float64)
    n = len(lengths)
    if not n:
        return []
    held = np.concatenate(([0.0], np.cumsum(counts)))
    used = np.concatenate(([0.0], np.cumsum(counts * lengths)))
    buckets = min(buckets, n)

    def padding(i: np.ndarray, j: int) -> np.ndarray:
        return lengths[j - 1] * (held[j] - held[i]) - (used[j] - used[i])

    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    starts = []
    for _ in range(buckets):
        now, start = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        work = [(1, n, 0, n - 1)]
        while work:
            low, high, first, last = work.pop()
            if low > high:
                continue
            j = (low + high) // 2
            tried = np.arange(first, min(last, j - 1) + 1)
            costs = cost[tried] + padding(tried, j)
            best = int(np.argmin(costs))
            now[j], start[j] = costs[best], tried[best]
            work += [(low, j - 1, first, int(start[j])), (j + 1, high, int(start[j]), last)]
        starts.append(start)
        # Fewer buckets may do as well: keep the layer's own cost, an empty start stays free.
        cost = now
        cost[0] = 0.0
    bounds, j = [], n
    for start in reversed(starts):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(start[j])
    return bounds[::-1]


def pack(
    docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, key: str = "doc_id", text: str = "text",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """``key, n_tokens, bucket, bound, batch, slot, padding``: one row per row of ``docs``.

    ``length`` is the number of tokens (by default words).  The histogram of all lengths, of bounded size,
    goes to the driver, where :func:`best_bounds` chooses the buckets.  In a bucket with upper bound b a
    batch takes max(1, budget div b) documents, each padded to b; a longer document than the budget has
    a batch of its own.  ``batch`` is unique over all buckets; ``slot`` counts from 0 inside a batch.

    Rows are numbered within parts of a bucket, chosen by a hash, so a bucket that holds most documents
    is not one task; each part of PART_BATCHES batches or more may leave one batch unfilled.  Order inside a part is by a hash of the
    key, the key and the length.  Null and empty texts have no tokens and need no room: they are in the
    first bucket.  Null and repeated keys are rows of their own; other columns are ignored; no rows give
    no rows.
    """
    size = F.size(words(F.col(text))) if length is None else length
    sized = pin(docs.select(F.col(key).alias("key"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("n")))
    histogram = sized.groupBy(grid(F.col("n")).alias("g")).agg(F.count(F.lit(1)).alias("rows")).orderBy("g").collect()
    bounds = best_bounds([r["g"] for r in histogram], [r["rows"] for r in histogram], buckets)
    if not bounds:
        bounds = [0]
    parts = []
    for low, high in pairwise([-1, *bounds]):
        rows = sum(r["rows"] for r in histogram if low < r["g"] <= high)
        parts.append(max(1, rows // max(part_rows, PART_BATCHES * max(1, budget // max(high, 1)))))
    firsts = [sum(parts[:i]) for i in range(len(parts))]

    def at(values: Sequence[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket"))

    bucket = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("n"))) + 1
    placed = sized.withColumn("bucket", bucket).withColumns({"bound": at(bounds), "hash": F.xxhash64("key", "n")})
    placed = placed.withColumn("part", at(firsts) + F.pmod(F.xxhash64(F.lit(1), "hash", F.monotonically_increasing_id()), at(parts)))
    number = F.row_number().over(Window.partitionBy("part").orderBy("hash", "key", "n")) - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bound"), F.lit(1))))
    numbered = placed.withColumns({"number": number, "room": room})
    return numbered.select(
        F.col("key").alias(key), F.col("n").alias("n_tokens"), (F.col("bucket") - 1).alias("bucket"), "bound",
        F.concat_ws("-", F.col("part").cast("string"), F.floor(F.col("number") / F.col("room")).cast("string")).alias("batch"),
        (F.col("number") % F.col("room")).cast("int").alias("slot"), (F.col("bound") - F.col("n")).alias("padding"),
    )
