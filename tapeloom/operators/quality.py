"""Row rules with a quarantine branch, duplicate and outlier removal, expectations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.scalar import parse_time, safe_double
from tapeloom.operators.ordered import over_rows
from tapeloom.sources.schemas import FEATURE_BOUNDS, SCHEMA_VERSION

# Fixed values of the log format.
ACTIONS = ("OPEN", "CLOSE", "MODIFY")
ZERO_FILLED = (
    "book_bid_vol", "book_ask_vol", "book_imbalance", "equity", "margin_level", "commission", "swap",
    "trend_estimate", "trend_variance", "is_anomaly",
)
TRUE_WORDS = ("1", "true", "yes")
BUY_WORDS, SELL_WORDS = ("1", "buy"), ("0", "-1", "sell")


def fill_defaults(df: DataFrame) -> DataFrame:
    """Numeric fields to 0, model index to -1, texts to '', upper-case exit reason."""
    have = set(df.columns)
    out: dict[str, Column] = {c: safe_double(c) for c in ZERO_FILLED if c in have}
    for c, default in (("magic", 0), ("decision_id", 0), ("executed_model_idx", -1)):
        if c in have:
            out[c] = F.coalesce(F.col(c).try_cast("double").try_cast("long"), F.lit(default))
    for c in ("source", "comment"):
        if c in have:
            out[c] = F.coalesce(F.col(c), F.lit(""))
    if "exit_reason" in have:
        out["exit_reason"] = F.upper(F.coalesce("exit_reason", F.lit("")))
    if "schema_version" in have:
        out["schema_version"] = F.lit(SCHEMA_VERSION)
    return df.withColumns(out)


def add_duration(df: DataFrame) -> DataFrame:
    """Seconds from open to event; fills a missing ``duration_sec``."""
    seconds = F.timestamp_diff("SECOND", F.col("open_ts"), F.col("event_ts")).cast("double")
    df = df.withColumn("trade_duration", F.coalesce(seconds, F.lit(0.0)))
    given = F.col("duration_sec").try_cast("double") if "duration_sec" in df.columns else F.col("trade_duration")
    return df.withColumn("duration_sec", F.coalesce(given, F.lit(0.0)).cast("long"))


def first_of_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """Flag ``is_first``: the row is the first of its id in source order.

    The first position per id is aggregated before the shuffle; joining it back leaves one
    small row per id, so an id repeated very often is split by adaptive skew handling.
    """
    firsts = df.groupBy(F.col(key).alias("_k")).agg(F.min(order).alias("_first"))
    return df.join(firsts, F.col(key).eqNullSafe(F.col("_k"))).withColumn("is_first", F.col(order) == F.col("_first")).drop("_k", "_first")


def clean_trades(df: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(clean rows, rejected rows with ``reject_reason``) of a raw text trade log.

    Rows with another action than OPEN, CLOSE, MODIFY or blank are left out.  Rejected: repeated event ids,
    missing ticket or action, negative lots or no price, and rows that don't fit the trade schema: an
    unusable time, no symbol, an id, ticket or order type that is no whole number, or an amount that is
    given but no number.  Rows of another schema version are coerced and stay; a copy of each is among
    the rejected rows, so that none is changed in silence.
    """
    numbers = [c for c in ("sl", "tp", "profit", "remaining_lots", "spread", "slippage") if c in df.columns]
    wholes = [c for c in ("event_id", "ticket", "order_type") if c in df.columns]
    unfit = F.lit(False)
    for c in wholes:
        unfit = unfit | F.col(c).try_cast("long").isNull()
    for c in numbers:
        unfit = unfit | (F.col(c).isNotNull() & F.col(c).try_cast("double").isNull())
    other = F.lit(False)
    if "schema_version" in df.columns:
        other = F.coalesce(F.col("schema_version").try_cast("double").try_cast("long"), F.lit(SCHEMA_VERSION)) != SCHEMA_VERSION
    df = df.withColumns({"_unfit": unfit, "_other": other})
    rows = df.withColumns(
        {
            "action": F.upper(F.coalesce("action", F.lit(""))),
            "event_ts": parse_time("event_time"),
            "open_ts": parse_time("open_time") if "open_time" in df.columns else F.lit(None).cast("timestamp_ntz"),
            "lots": F.col("lots").try_cast("double"),
            "price": F.col("price").try_cast("double"),
        }
    )
    rows = rows.filter((F.col("action") == "") | F.col("action").isin(*ACTIONS))
    rows = first_of_id(rows, "event_id", order)
    reason = (
        F.when(~F.col("is_first"), "duplicate event_id")
        .when(F.col("ticket").isNull() | (F.col("ticket") == "") | (F.col("action") == ""), "missing ticket or action")
        .when((F.col("lots") < 0) | F.col("price").isNull() | F.isnan("price"), "negative lots or no price")
        .when(F.col("event_ts").isNull() | F.col("symbol").isNull() | F.col("_unfit"), "row does not fit the trade schema")
    )
    rows = add_duration(fill_defaults(rows.withColumn("reject_reason", reason).drop("is_first", "_unfit")))
    rejected = rows.filter("reject_reason IS NOT NULL").unionByName(rows.filter("_other").withColumn("reject_reason", F.lit("other schema version")))
    return rows.filter("reject_reason IS NULL").drop("reject_reason", "_other"), rejected.drop("_other")


def direction_of(column: str | Column) -> Column:
    """1 for buy words, -1 for sell words, 1 for anything unknown."""
    c = F.lower(F.trim((F.col(column) if isinstance(column, str) else column).cast("string")))
    return F.when(c.isin(*BUY_WORDS), 1).when(c.isin(*SELL_WORDS), -1).otherwise(1)


def first_present(df: DataFrame, names: Sequence[str], default: Column | None = None) -> Column:
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(None).cast("double") if default is None else default


def prediction_columns(df: DataFrame) -> DataFrame:
    """Resolve alternative column names of prediction logs."""
    if "log_variance" in df.columns or "logvar" in df.columns:
        log_var = first_present(df, ["log_variance", "logvar"]).try_cast("double")
    elif "variance" in df.columns:
        v = F.col("variance").try_cast("double")
        log_var = F.when(v > 0, F.ln(v))
    else:
        log_var = F.lit(None).cast("double")
    return df.withColumns(
        {
            "probability": first_present(df, ["probability", "prob", "proba"]).try_cast("double"),
            "value": first_present(df, ["expected_value", "value", "pnl"]).try_cast("double"),
            "log_variance": log_var,
            "executed_model_idx": first_present(df, ["executed_model_idx", "model_idx", "model"]).try_cast("int"),
            "direction": direction_of(first_present(df, ["direction", "order_type"], F.lit(""))),
        }
    )


def exact_duplicates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rows, and the one-row count of removed copies (aggregated before the shuffle)."""
    counted = df.groupBy(*df.columns).count()
    removed = counted.agg((F.sum("count") - F.count(F.lit(1))).alias("duplicate_rows"))
    return counted.drop("count"), removed


def zscore_outliers(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Flag ``is_outlier``: any listed column further than ``limit`` population deviations."""
    stats = df.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    rows = df.join(F.broadcast(stats))  # one row
    far = F.lit(False)
    for c in columns:
        z = F.coalesce(F.abs(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))), F.lit(0.0))
        far = far | (z > limit)
    return rows.withColumn("is_outlier", far).select(*df.columns, "is_outlier")


def expectations(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row (rule, failed, total) per rule that applies to the columns of ``df``."""
    have = set(df.columns)
    rules: dict[str, Column] = {}
    if "event_time" in have:
        df = over_rows(
            df, [], order,
            lambda rows, lay: rows.withColumn("_prev", F.lag("event_time").over(lay.ordered())), before=1,
        )
        rules["event_time not null"] = F.col("event_time").isNull()
        rules["event_time increasing"] = F.col("event_time") <= F.col("_prev")
    if "hour" in have:
        rules["hour not null"] = F.col("hour").isNull()
        rules["hour in 0..23"] = ~F.col("hour").between(0, 23)
    if "volume" in have:
        rules["volume not null"] = F.col("volume").isNull()
        rules["volume not negative"] = F.col("volume") < 0
    if "meta_label" in have:
        rules["meta_label in 0..1"] = ~F.col("meta_label").between(0, 1)
    if "net_profit" in have:
        rules["net_profit not null"] = F.col("net_profit").isNull()
    return failures(df, rules)


def failures(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, failed, total) in one pass over the rows."""
    names = list(rules)
    counted = df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(rules[n]).alias(f"_f{i}") for i, n in enumerate(names)]
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_f{i}").alias("failed")) for i, n in enumerate(names)])
    return counted.select(F.explode(pairs).alias("r"), "total").select("r.rule", "r.failed", "total")


def feature_bounds(df: DataFrame, bounds=FEATURE_BOUNDS) -> DataFrame:
    """Out-of-range counts of the known feature columns present in ``df``."""
    rules = {}
    for name, lo, hi in bounds:
        if name in df.columns:
            bad = F.lit(False)
            if lo is not None:
                bad = bad | (F.col(name) < lo)
            if hi is not None:
                bad = bad | (F.col(name) > hi)
            rules[name] = bad
    return failures(df, rules)


def feature_subset(df: DataFrame, subset: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Listed columns in order without repeats; unknown names are an error."""
    names = list(dict.fromkeys(s.strip() for s in subset if s.strip()))
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown features: {', '.join(missing)}")
    return df.select(*keep, *names)


def not_flagged(df: DataFrame, column: str = "is_anomaly") -> DataFrame:
    return df.filter(~F.coalesce(F.lower(F.col(column).cast("string")), F.lit("0")).isin(*TRUE_WORDS))


def net_of_costs(profit: Column, fee: float, bps: float) -> Column:
    return profit - (F.lit(fee) + F.abs(profit) * (bps * 1e-4))


def relabel_uncertain(labelled: DataFrame, uncertain: DataFrame, label: int, weight: float = 2.0) -> DataFrame:
    """Labelled rows with weight 1 plus uncertain rows given ``label`` and a larger weight."""
    extra = uncertain.withColumns({"label": F.lit(label), "weight": F.lit(weight)})
    return labelled.withColumn("weight", F.lit(1.0)).unionByName(extra, allowMissingColumns=True)
