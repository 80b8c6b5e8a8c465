"""As-of joins: nearest earlier or later right row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.ordered import last_known


def asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    left_id: str,
    right_id: str,
    direction: str = "backward",
    tolerance: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """Left rows with the nearest right row as struct column ``match`` (null if none).

    Times and tolerance are integers in one unit; ids break ties: of right rows at the same
    time a backward search takes the highest id, a forward search the lowest.  Both sides go
    through one ordered pass, so the cost is linear whatever the density of right rows.
    ``strict`` leaves out right rows at exactly the left time.
    """
    sign = {"backward": 1, "forward": -1}[direction]
    left_side, right_side = (0, 1) if strict else (1, 0)
    lcols, rcols = left.columns, right.columns
    l_rows = left.select(
        *by,
        (F.col(left_time) * sign).cast("long").alias("_t"),
        F.lit(left_side).alias("_side"),
        (F.col(left_id) * sign).cast("long").alias("_tie"),
        F.struct(*lcols).alias("_left"),
    )
    r_rows = right.select(
        *by,
        (F.col(right_time) * sign).cast("long").alias("_t"),
        F.lit(right_side).alias("_side"),
        (F.col(right_id) * sign).cast("long").alias("_tie"),
        F.struct(*rcols).alias("_right"),
    )
    rows = l_rows.unionByName(r_rows, allowMissingColumns=True)
    seen = last_known(rows, by, ["_t", "_side", "_tie"], {"_seen": F.col("_right")})
    hit = F.col("_seen")
    if tolerance is not None:
        gap = F.abs(F.col(f"_left.{left_time}") - F.col(f"_seen.{right_time}"))
        hit = F.when(gap <= tolerance, hit)
    return seen.filter(F.col("_left").isNotNull()).select("_left.*", hit.alias("match"))
