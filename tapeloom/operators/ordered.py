"""Ordered processing of long series, with no task holding a whole hot key.

Most operators here are defined on rows in time order per key.  A plain
``Window.partitionBy(key)`` puts each key into one task.  Instead rows are numbered in (key, order) order
by a range shuffle, cut into blocks of equal size, and each block receives copies of the neighbouring
rows its frames reach into.  Unbounded frames are finished with a small table of block summaries.
There is this one way for every size of key and table; what a block is changes no value.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.session import block_rows, pin, shuffle_partitions

BLOCK, POS, OWN = "_block", "_pos", "_own"


# Range partitions of one numbering: bounds the collected sizes and the block summaries.
MOST_PARTS = 65_536


def number_rows(df: DataFrame, order: Sequence[str], pos: str = POS) -> tuple[DataFrame, int, int]:
    """Add the zero-based position of each row in the total order of ``order``.

    ``order`` must be unique per row.  The range shuffle balances skewed keys because the later order
    columns take part in the cut points; it makes as many parts as other shuffles do.  The sorted rows
    are stored once, so that the cut points stay the same when an executor is lost and nothing before
    is computed again.  Also returns the number of rows and how many a block should have.
    """
    spark = df.sparkSession
    parts = min(MOST_PARTS, shuffle_partitions(spark))
    ordered = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    stored = pin(ordered)
    slice_id = F.shiftright("_mid", 33)
    # One row per range partition: bounded by the partition count, not by the data.
    sizes = sorted(stored.groupBy(slice_id.alias("_slice")).count().collect())
    offsets, seen = [], 0
    for row in sizes:
        offsets.append((row["_slice"], seen - (row["_slice"] << 33)))
        seen += row["count"]
    table = spark.createDataFrame(offsets, "_slice long, _shift long")
    numbered = (
        stored.withColumn("_slice", slice_id)
        .join(F.broadcast(table), "_slice")
        .withColumn(pos, F.col("_mid") + F.col("_shift"))
        .drop("_slice", "_shift", "_mid")
    )
    return numbered, seen, block_rows(spark) or max(1, -(-seen // parts))


@dataclass(frozen=True)
class Layout:
    """Rows placed so that a frame of bounded reach can be computed per (key, block)."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    before: int = 0
    after: int = 0

    @property
    def group(self) -> list[str]:
        return [*self.keys, BLOCK]

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def rows(self, first: int, last: int) -> WindowSpec:
        return self.ordered().rowsBetween(first, last)

    def so_far(self) -> WindowSpec:
        return self.rows(Window.unboundedPreceding, Window.currentRow)

    def finish(self, df: DataFrame | None = None) -> DataFrame:
        """Drop the copies and the helper columns."""
        df = self.df if df is None else df
        return df.filter(F.col(OWN)).drop(BLOCK, POS, OWN)

    def carry(
        self,
        df: DataFrame,
        summary: Mapping[str, Column],
        fold: Mapping[str, Callable[[WindowSpec], Column]],
    ) -> DataFrame:
        """Add, per row, values folded over all earlier blocks of the row's key.

        ``summary`` aggregates one block; ``fold`` combines summaries of earlier blocks with
        a window; a key's first block gets nulls.
        """
        blocks = df.filter(F.col(OWN)).groupBy(*self.keys, BLOCK).agg(
            *[c.alias(n) for n, c in summary.items()]
        )
        before = (
            Window.partitionBy(*self.keys) if self.keys else Window.partitionBy(F.lit(0))
        ).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        carried = blocks.select(
            *[F.col(k).alias(f"_c_{k}") for k in (*self.keys, BLOCK)],
            *[fn(before).alias(n) for n, fn in fold.items()],
        )
        on = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in (*self.keys, BLOCK)]
        return df.join(carried, on, "left").drop(*[f"_c_{k}" for k in (*self.keys, BLOCK)])


def lay_out(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: int = 0,
    after: int = 0,
) -> Layout:
    """Prepare ``df`` for frames reaching ``before`` rows back and ``after`` rows ahead."""
    numbered, _, limit = number_rows(df, [*keys, *order])
    first = F.greatest(F.lit(0), F.floor((F.col(POS) - after) / limit))
    last = F.floor((F.col(POS) + before) / limit)
    placed = numbered.withColumn(BLOCK, F.explode(F.sequence(first, last))).withColumn(
        OWN, F.col(BLOCK) == F.floor(F.col(POS) / limit)
    )
    return Layout(placed, tuple(keys), (POS,), before, after)


def over_rows(
    df: DataFrame | Layout,
    keys: Sequence[str],
    order: Sequence[str],
    build: Callable[[DataFrame, Layout], DataFrame],
    before: int = 0,
    after: int = 0,
) -> DataFrame | Layout:
    """Run ``build`` on laid-out rows and return the original rows with its columns.

    Given a ``Layout`` the step runs inside it and returns it with the new columns, so that
    several features share one numbering, one shuffle and one sort.  Each step uses up its
    reach, because a later one may read the columns of an earlier one.
    """
    if isinstance(df, Layout):
        if df.before < before or df.after < after:
            raise ValueError("the shared layout does not reach far enough; lay it out with a larger reach")
        return replace(df, df=build(df.df, df), before=df.before - before, after=df.after - after)
    lay = lay_out(df, keys, order, before, after)
    return lay.finish(build(lay.df, lay))


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    """Inclusive running sums per key."""

    def build(rows: DataFrame, lay: Layout) -> DataFrame:
        rows = rows.withColumns({f"_v_{n}": c for n, c in sums.items()})
        rows = lay.carry(
            rows,
            {f"_s_{n}": F.sum(f"_v_{n}") for n in sums},
            {f"_b_{n}": (lambda w, n=n: F.sum(f"_s_{n}").over(w)) for n in sums},
        )
        rows = rows.withColumns(
            {
                n: F.coalesce(F.sum(f"_v_{n}").over(lay.so_far()), F.lit(0))
                + F.coalesce(F.col(f"_b_{n}"), F.lit(0))
                for n in sums
            }
        )
        return rows.drop(*[f"_v_{n}" for n in sums], *[f"_b_{n}" for n in sums])

    return over_rows(df, keys, order, build)


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column]
) -> DataFrame:
    """Last non-null value up to and including each row, per key."""

    def build(rows: DataFrame, lay: Layout) -> DataFrame:
        rows = rows.withColumns({f"_v_{n}": c for n, c in values.items()})
        rows = lay.carry(
            rows,
            {f"_s_{n}": F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(POS))) for n in values},
            {f"_b_{n}": (lambda w, n=n: F.last(f"_s_{n}", ignorenulls=True).over(w)) for n in values},
        )
        here = {n: F.last(f"_v_{n}", ignorenulls=True).over(lay.so_far()) for n in values}
        rows = rows.withColumns({n: F.coalesce(c, F.col(f"_b_{n}")) for n, c in here.items()})
        return rows.drop(*[f"_v_{n}" for n in values], *[f"_b_{n}" for n in values])

    return over_rows(df, keys, order, build)


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Zero-based position of each row within its key."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")}).withColumn(
        name, F.col(name) - 1
    )


def drawdown(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "max_drawdown",
    from_zero: bool = True,
) -> DataFrame:
    """Largest fall of the running total from its running peak.

    The peak starts at 0, or without ``from_zero`` at the first total.  No rows fall by 0.
    """
    lay = lay_out(df.select(*keys, *order, F.col(value).alias("_r")), keys, order)
    total = lay.df.withColumn("_cum", F.sum("_r").over(lay.so_far()))
    total = total.withColumn("_peak", F.max("_cum").over(lay.so_far()))
    blocks = total.groupBy(*lay.group).agg(
        F.sum("_r").alias("_sum"),
        F.max("_cum").alias("_hi"),
        F.min("_cum").alias("_lo"),
        F.max(F.col("_peak") - F.col("_cum")).alias("_drop"),
    )
    scope = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = scope.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    top = F.max(F.col("_base") + F.col("_hi")).over(before)
    blocks = blocks.withColumn("_top", F.greatest(F.lit(0.0), top) if from_zero else top)
    worst = F.greatest(F.lit(0.0), F.col("_drop"), F.col("_top") - F.col("_base") - F.col("_lo"))
    return blocks.groupBy(*keys).agg(F.coalesce(F.max(worst), F.lit(0.0)).alias(name))


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column] | None = None
) -> DataFrame:
    """Distinct values per key with counts, running counts and further running sums.

    Rows are pre-aggregated by value before the ordered pass, so a value shared by a third
    of all rows costs one row here.  Columns: keys, ``value``, ``cnt``, ``upto`` (rows with a
    value not above this one), and for each extra sum its per-value part and ``upto_<name>``.
    """
    sums = dict(sums or {})
    small = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("cnt"), *[F.sum(c).alias(n) for n, c in sums.items()])
    )
    return running_sums(
        pin(small), keys, ["value"], {"upto": F.col("cnt"), **{f"upto_{n}": F.col(n) for n in sums}}
    )


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are equal; without keys ``right`` has one row."""
    if not keys:
        return left.join(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"_j_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_j_{k}" for k in keys])


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact linear-interpolated quantiles per key; null for a key without a value."""
    ranks = value_ranks(df, keys, value)
    totals = ranks.groupBy(*keys).agg(F.max("upto").alias("_n"))
    ranks = join_on(ranks, totals, keys)
    picks = []
    for n, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(p)
        picks.append(F.min(F.when(F.col("upto") > F.floor(at), F.col("value"))).alias(f"_lo_{n}"))
        picks.append(F.min(F.when(F.col("upto") > F.ceil(at), F.col("value"))).alias(f"_hi_{n}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_w_{n}"))
    picked = ranks.groupBy(*keys).agg(*picks)
    if keys:
        picked = join_on(df.select(*keys).distinct(), picked, keys, "left")
    return picked.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in probs
        ],
    )


# Rows of one key that a sequential rule handles in one task.
SCAN_ROWS = 1_000_000


def scan_in_rounds(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Callable,
    out: str,
    state: Sequence[str],
    values: Sequence[str],
) -> DataFrame:
    """Sequential per-key scan for rules that no associative summary can express.

    ``step(pdf, state) -> (out_pdf, state)`` handles one ordered block of a key, where
    ``state`` is a tuple of floats or None.  Block ``i`` of every key runs in round ``i``, all
    keys in parallel, and the next round receives the state rows; a task never holds more
    than one block of a key.  Rounds = rows of the longest key / SCAN_ROWS; the rows are stored by
    round, so each is read once.
    """
    spark = df.sparkSession
    limit = block_rows(spark) or SCAN_ROWS
    src = df.select(*keys, *order, *values)
    rounds_of = row_index(src, keys, order, "_i").withColumn("_round", F.floor(F.col("_i") / limit))
    numbered = pin(rounds_of, by=["_round"])
    rounds = int(numbered.agg(F.coalesce(F.max("_round"), F.lit(0))).first()[0]) + 1
    key_types = [f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name in keys]
    carried = spark.createDataFrame(
        [], ", ".join([*key_types, *[f"{s} double" for s in state]])
    )
    result = None
    schema_out = T.StructType.fromDDL(out)
    for i in range(rounds):
        block = numbered.filter(F.col("_round") == i).drop("_round", "_i")
        full = T.StructType(
            [*schema_out.fields, *[T.StructField(s, T.DoubleType()) for s in state],
             T.StructField("_state", T.BooleanType())]
        )

        def run(rows_pdf, state_pdf):
            import pandas as pd

            pdf = rows_pdf.sort_values(list(order), kind="mergesort").reset_index(drop=True)
            prior = tuple(state_pdf.iloc[0][list(state)]) if len(state_pdf) else None
            if not len(pdf):
                tail = state_pdf[[*keys, *state]].copy()
                tail["_state"] = True
                return tail.reindex(columns=[f.name for f in full.fields])
            got, after = step(pdf, prior)
            got = got.assign(_state=False)
            last = {k: pdf[k].iloc[0] for k in keys}
            last.update(dict(zip(state, after)), _state=True)
            tail = pd.DataFrame([last])
            return pd.concat([got, tail], ignore_index=True).reindex(
                columns=[f.name for f in full.fields]
            )

        both = pin(block.groupBy(*keys).cogroup(carried.groupBy(*keys)).applyInPandas(run, full))
        part = both.filter(~F.col("_state")).select(*[f.name for f in schema_out.fields])
        carried = both.filter(F.col("_state")).select(*keys, *state)
        result = part if result is None else result.unionByName(part)
    return result
