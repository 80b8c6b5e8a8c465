"""Formulas and strategy expressions given as specs, turned into Spark columns.

Formulas are Python call expressions over column names, e.g. ``mul(bid, add(volume, 1))``;
only the listed functions are accepted.  Strategy specs are nested dicts with a ``type``.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.ordered import Layout, over_rows


def _safe(c: Column) -> Column:
    return F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))


CALLS = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.try_divide(a, b),
    "max": F.greatest,
    "min": F.least,
    "neg": lambda a: -a,
    "abs": F.abs,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "log": lambda a: F.when(a > 0, F.ln(a)),
    "sqrt": lambda a: F.when(a >= 0, F.sqrt(a)),
}


def formula_column(text: str, columns: Sequence[str]) -> Column:
    """Column of an allow-listed formula; undefined results become 0."""

    def walk(node) -> Column:
        match node:
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in CALLS:
                return CALLS[name](*[walk(a) for a in args])
            case ast.Name(id=name) if name in columns:
                return F.col(name).cast("double")
            case ast.Constant(value=int() | float() as value) if not isinstance(value, bool):
                return F.lit(float(value))
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                return -walk(inner)
        raise ValueError(f"not allowed in a formula: {ast.dump(node)[:80]}")

    return _safe(walk(ast.parse(text, mode="eval").body))


def with_formulas(df: DataFrame, formulas: Mapping[str, str]) -> DataFrame:
    return df.withColumns({n: formula_column(t, df.columns) for n, t in formulas.items()})


# --- strategy specs -------------------------------------------------------------------------

BINARY = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: a / F.when(F.abs(b) < 1e-12, 1e-12).otherwise(b),
    "gt": lambda a, b: (a > b).cast("double"),
    "lt": lambda a, b: (a < b).cast("double"),
    "and": lambda a, b: ((a > 0) & (b > 0)).cast("double"),
    "or": lambda a, b: ((a > 0) | (b > 0)).cast("double"),
}
CHILDREN = ("left", "right", "child", "condition")


INDICATORS = ("sma", "ema", "rsi", "atr", "bollinger", "rolling_volatility", "cross_price")


def spec_complexity(spec: Mapping) -> int:
    """Cost of a strategy: constants 0.5, indicators 1.5, other nodes 1, rounded up."""

    def cost(s: Mapping) -> float:
        own = 0.5 if s["type"] == "const" else 1.5 if s["type"] in INDICATORS else 1.0
        return own + sum(cost(s[c]) for c in CHILDREN if c in s)

    return max(1, math.ceil(cost(spec)))


def spec_reach(spec: Mapping) -> int:
    """Rows a spec looks back or ahead."""
    own = int(spec.get("window", spec.get("lookback", 0))) + 2
    return own + sum(spec_reach(spec[c]) for c in CHILDREN if c in spec)


def _emas(spec: Mapping) -> set[int]:
    own = {int(spec["window"])} if spec["type"] == "ema" else set()
    return own.union(*[_emas(spec[c]) for c in CHILDREN if c in spec], set())


def evaluate_spec(
    df: DataFrame, spec: Mapping, keys: Sequence[str], order: Sequence[str], price: str, name: str = "signal",
    others: Mapping[str, str] | None = None, centred_sma: bool = False,
) -> DataFrame:
    """Add the value of a strategy spec per row; ``others`` maps symbols to price columns."""
    from tapeloom.operators.windows import ewm

    spans = sorted(_emas(spec))
    if spans:
        df = ewm(df, keys, order, {f"_ema{w}": (price, 2.0 / (w + 1)) for w in spans})
    made: list[str] = []

    def build(rows: DataFrame, lay: Layout) -> DataFrame:
        # Windows cannot be nested in one projection, so each window node becomes a column.
        def keep(c: Column) -> Column:
            nonlocal rows
            col = f"_n{len(made)}"
            made.append(col)
            rows = rows.withColumn(col, c)
            return F.col(col)

        def move() -> Column:
            return keep(F.coalesce(F.col(price) - F.lag(price).over(lay.ordered()), F.lit(0.0)))

        def walk(s: Mapping) -> Column:
            kind = s["type"]
            p = F.col(price).cast("double")
            if kind == "price":
                return p
            if kind == "const":
                return F.lit(float(s["value"]))
            if kind in BINARY:
                return BINARY[kind](walk(s["left"]), walk(s["right"]))
            if kind == "ema":
                return F.col(f"_ema{int(s['window'])}")
            if kind == "cross_price":
                other = F.col((others or {})[s["symbol"]])
                return other / F.when(F.abs(p) < 1e-12, 1e-12).otherwise(p) if s.get("normalize", True) else other
            if kind == "position":
                size = max(-1.0, min(1.0, float(s.get("size", 1.0))))
                return F.when(walk(s["condition"]) > 0, size).otherwise(0.0)
            if kind == "stop_loss":
                child = walk(s["child"])
                return F.when(move() >= -abs(float(s["limit"])), child).otherwise(0.0)
            if kind == "trailing_stop":
                child, buffer = keep(walk(s["child"])), abs(float(s.get("buffer", 0.0)))
                w = lay.rows(1 - max(1, int(s.get("lookback", 10))), 0)
                fall, rise = keep(F.max(p).over(w)) - p, p - keep(F.min(p).over(w))
                return F.when((child > 0) & (fall > buffer), 0.0).when((child < 0) & (rise > buffer), 0.0).otherwise(child)
            n = int(s["window"])
            if n <= 0:
                raise ValueError("window must be positive")
            w = lay.rows(1 - n, 0)
            if kind == "sma":
                if centred_sma:
                    return keep(F.sum(p).over(lay.rows(-(n // 2), (n - 1) // 2)) / n)
                return keep(F.avg(p).over(w))
            if kind == "bollinger":
                mid, dev = keep(F.avg(p).over(w)), keep(F.stddev_pop(p).over(w))
                scale = abs(float(s.get("num_std", 2.0)))
                return {"upper": mid + scale * dev, "lower": mid - scale * dev, "middle": mid}[s.get("band", "upper")]
            if kind == "rolling_volatility":
                return keep(F.stddev_pop(move()).over(w))
            if kind == "atr":
                return keep(F.avg(F.abs(move())).over(w))
            if kind == "rsi":
                d = move()
                up = keep(F.avg(F.greatest(d, F.lit(0.0))).over(w))
                down = keep(F.avg(F.greatest(-d, F.lit(0.0))).over(w))
                return 100.0 - 100.0 / (1.0 + up / F.greatest(down, F.lit(1e-12)))
            raise ValueError(f"unknown node type: {kind}")

        value = walk(spec)
        return rows.withColumn(name, value)

    reach = spec_reach(spec)
    out = over_rows(df, keys, order, build, before=reach, after=reach if centred_sma else 0)
    return out.drop(*made, *[f"_ema{w}" for w in spans])
