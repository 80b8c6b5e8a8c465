"""Scalar column functions: time encodings, casts, clipping, text and vector helpers."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US

# Time formats of the logs, tried in this order (fixed values).
TIME_FORMATS = ("yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm")


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a zoneless timestamp, independent of the session zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts.cast("timestamp_ntz"))


def parse_time(text: str | Column) -> Column:
    """Timestamp from either log format, null when neither fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS]).cast("timestamp_ntz")


def hour_of(us: str | Column) -> Column:
    us = F.col(us) if isinstance(us, str) else us
    return F.floor(F.pmod(us, F.lit(DAY_US)) / HOUR_US).cast("int")


def _cycle(x: Column, period: float) -> tuple[Column, Column]:
    angle = x * (2.0 * math.pi) / period
    return F.sin(angle), F.cos(angle)


def calendar_encoding(df: DataFrame, ts: str) -> DataFrame:
    """Sine and cosine of hour, weekday (Monday 0), month and day of month."""
    t = F.col(ts)
    parts = {
        "hour": (F.hour(t), 24.0),
        "dow": (F.weekday(t), 7.0),
        "month": (F.month(t) - 1, 12.0),
        "dom": (F.dayofmonth(t) - 1, 31.0),
    }
    out = {}
    for name, (value, period) in parts.items():
        out[f"{name}_sin"], out[f"{name}_cos"] = _cycle(value, period)
    return df.withColumns(out)


def safe_double(value: str | Column, default: float = 0.0) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(None).cast("double")), F.lit(default))


def session_tag(hour: Column) -> Column:
    return F.when(hour < 8, "asian").when(hour < 16, "london").otherwise("newyork")


def decision_id_in(comment: str | Column) -> Column:
    """Number after ``decision_id=`` in a trade comment, null when absent."""
    found = F.regexp_extract(comment, r"decision_id=(\d+)", 1)
    return F.when(found != "", found.cast("long"))


def json_vector(text: str | Column, dim: int) -> Column:
    """JSON array text as a double vector of exactly ``dim`` values, zero-padded."""
    parsed = F.coalesce(F.from_json(text, "array<double>"), F.array().cast("array<double>"))
    filled = F.transform(parsed, lambda x: F.coalesce(x, F.lit(0.0)))
    return F.slice(F.concat(filled, F.array_repeat(F.lit(0.0), dim)), 1, dim)


def squared_distance(vec: Column, centre: Sequence[float]) -> Column:
    centre_col = F.array(*[F.lit(float(c)) for c in centre])
    return F.aggregate(
        F.zip_with(vec, centre_col, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x
    )


def nearest_centroid(vec: Column, centres: Sequence[Sequence[float]]) -> Column:
    """Index of the nearest centre; the first wins a tie."""
    pairs = F.array(
        *[F.struct(squared_distance(vec, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    )
    return F.array_min(pairs)["i"]


def limit_fill(side: Column, limit: Column, bid: Column, ask: Column, remaining: Column) -> tuple[Column, Column]:
    """Filled quantity and price: a crossed limit fills all, a touched one half."""
    buy = side == 1
    quote = F.when(buy, ask).otherwise(bid)
    crossed = F.when(buy, ask < limit).otherwise(bid > limit)
    filled = F.when(crossed, remaining).when(quote == limit, remaining / 2.0).otherwise(0.0)
    return filled, F.when(filled > 0, quote).otherwise(0.0)


def log_variance(variance: Column) -> Column:
    return F.when(variance > 0, F.ln(variance))


def gaussian_nll(value: Column, mean: Column, log_var: Column) -> Column:
    return 0.5 * (math.log(2 * math.pi) + log_var + F.pow(value - mean, 2) / F.exp(log_var))


# Lower-tail 5 % point of the standard normal and its density divided by 0.05 (fixed values).
Z_05 = -1.6448536269514729
ES_FACTOR_05 = 2.0627128075074257


def predicted_shortfall(mean: Column, log_var: Column) -> Column:
    return mean - F.sqrt(F.exp(log_var)) * ES_FACTOR_05


def polynomial_terms(columns: Sequence[str], degree: int, excluded: Sequence[str] = ()) -> dict[str, Column]:
    """Products of 2..degree factors named like ``a*b^2``."""
    base = [c for c in columns if c not in set(excluded)]
    out: dict[str, Column] = {}
    for d in range(2, degree + 1):
        for combo in combinations_with_replacement(base, d):
            powers = Counter(combo)
            name = "*".join(c if p == 1 else f"{c}^{p}" for c, p in powers.items())
            product = F.lit(1.0)
            for c, p in powers.items():
                for _ in range(p):
                    product = product * F.col(c)
            out[name] = product
    return out


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.ln(x + 1.0) if abs(lam) < 1e-12 else (F.pow(x + 1.0, F.lit(lam)) - 1.0) / lam
    down = (
        -F.ln(1.0 - x)
        if abs(lam - 2.0) < 1e-12
        else -(F.pow(1.0 - x, F.lit(2.0 - lam)) - 1.0) / (2.0 - lam)
    )
    return F.when(x >= 0, up).otherwise(down)
