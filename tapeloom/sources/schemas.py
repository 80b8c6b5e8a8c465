"""Event schemas of the logs.  Field names, order and types are fixed values of the format."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 3


_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}


def struct(spec: str) -> T.StructType:
    """Schema from ``name type`` pairs; usable before a session exists."""
    pairs = (item.split() for item in spec.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Trade events.
TRADE = struct(
    "schema_version int, event_id int, trace_id string, event_time string, broker_time string, local_time string, "
    "action string, ticket int, magic int, source string, symbol string, order_type int, lots double, price double, "
    "sl double, tp double, profit double, profit_after_trade double, spread double, comment string, "
    "remaining_lots double, slippage double, volume int, open_time string, book_bid_vol double, book_ask_vol double, "
    "book_imbalance double, sl_hit_dist double, tp_hit_dist double, equity double, margin_level double, "
    "commission double, swap double, exit_reason string, decision_id int"
)

# The fields that a scan of several trade logs keeps.
TRADE_LOG = struct(
    "schema_version int, event_id int, event_time string, broker_time string, local_time string, action string, "
    "ticket int, magic int, source string, symbol string, order_type int, lots double, price double, sl double, "
    "tp double, sl_dist double, tp_dist double, sl_hit_dist double, tp_hit_dist double, executed_model_idx int, "
    "decision_id int, profit double, spread double, comment string, remaining_lots double, slippage double, "
    "volume int, open_time string, book_bid_vol double, book_ask_vol double, book_imbalance double, equity double, "
    "margin_level double, commission double, swap double, is_anomaly double, trend_estimate double, "
    "trend_variance double, exit_reason string, duration_sec int"
)

# Decision events; ``features`` is text.
DECISION = struct(
    "schema_version int, event_id int, timestamp string, model_version string, action string, probability double, "
    "sl_dist double, tp_dist double, model_idx int, regime int, chosen int, risk_weight double, variance double, "
    "lots_predicted double, executed_model_idx int, features string, trace_id string, span_id string"
)

# Metric events.
METRIC = struct(
    "schema_version int, time string, magic int, win_rate double, avg_profit double, trade_count int, "
    "drawdown double, sharpe double, file_write_errors int, socket_errors int, book_refresh_seconds int"
)

REPLAY_DECISION = struct("decision_id long, probability double, f1 double, profit double")

# Bounds of known engineered features: (column, lowest, highest); None is open.
FEATURE_BOUNDS = (
    ("atr", 0.0, None),
    ("sl_dist_atr", 0.0, None),
    ("tp_dist_atr", 0.0, None),
    ("book_bid_vol", 0.0, None),
    ("book_ask_vol", 0.0, None),
    ("book_imbalance", -1.0, 1.0),
    ("depth_vol_imbalance", -1.0, 1.0),
    ("equity", 0.0, None),
    ("margin_level", 0.0, None),
)


def schema_difference(spark, found: T.StructType, expected: T.StructType):
    """Rows (column, expected, found) for every column that is missing, extra or retyped."""
    got = {f.name: f.dataType.simpleString() for f in found}
    want = {f.name: f.dataType.simpleString() for f in expected}
    rows = [(n, want.get(n), got.get(n)) for n in sorted(got.keys() | want.keys()) if want.get(n) != got.get(n)]
    return spark.createDataFrame(rows, "name string, expected string, found string")


def require_columns(df, required, name="data") -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{name} is missing required columns: {', '.join(missing)}")
