"""Query registry and the inputs the registered queries share.

A query is a function ``(spark, folder) -> DataFrame``; its oracle is SQL over the raw
tables.  ``doubles`` names the floating-point columns, rounded the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.scalar import HOUR_US, micros
from tapeloom.session import pin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SYMBOLS = ("click", "error", "purchase", "signup", "view")


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6, ctes: str = "", ints: str = ""):
    """Register a query; ``doubles`` are rounded on both sides, ``ints`` are 64-bit in the SQL."""
    cols = doubles.split()

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(spark, folder).withColumns(
                {c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols}
            ) if cols else fn(spark, folder)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            head = [CTES[c] for c in ctes.split()]
            casts = [f"round({c}::DOUBLE, {digits}) + 0.0 AS {c}" for c in cols] + [f"{c}::BIGINT AS {c}" for c in ints.split()]
            star = f"* REPLACE ({', '.join(casts)})" if casts else "*"
            body = sql.strip()
            if body.upper().startswith("WITH "):
                body = body[5:].lstrip()
                recursive = body.upper().startswith("RECURSIVE ")
                if recursive:
                    body = body[10:].lstrip()
                cut = body.rindex("\nSELECT")
                head.append(body[:cut].rstrip())
                body = body[cut:].strip()
                lead = "WITH RECURSIVE " if recursive else "WITH "
            else:
                lead = "WITH "
            text = f"SELECT {star} FROM (\n{body}\n) final"
            ORACLES[name] = (lead + ",\n".join(head) + "\n" + text) if head else text
        return run

    return register


# --- tables ---------------------------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ticks(spark, folder):
    """symbol, t (microseconds), id, bid, ask, user_id."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"),
        micros("ts").alias("t"),
        F.col("event_id").alias("id"),
        F.col("value").alias("bid"),
        (F.col("value") * 1.0002).alias("ask"),
        "user_id",
    )


def bars(spark, folder):
    """Hourly bars: symbol, hr, open, high, low, close, volume."""
    rows = ticks(spark, folder).withColumn("hr", F.floor(F.col("t") / HOUR_US))
    return rows.groupBy("symbol", "hr").agg(
        F.min_by("bid", "t").alias("open"),
        F.max("bid").alias("high"),
        F.min("bid").alias("low"),
        F.max_by("bid", "t").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def trade_log(spark, folder):
    """OPEN and CLOSE rows: ticket, action, symbol, event_time (s), order_type, profit."""
    orders = table(spark, folder, "orders")
    opens = orders.select(
        F.col("o_orderkey").alias("ticket"),
        F.lit("OPEN").alias("action"),
        F.col("o_orderpriority").alias("symbol"),
        (F.floor(micros("o_orderdate") / 1_000_000) + F.col("o_orderkey") % 86400).alias("event_time"),
        (F.col("o_custkey") % 2).cast("int").alias("order_type"),
        F.lit(0.0).alias("profit"),
    )
    sums = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.floor(micros(F.max("l_shipdate")) / 1_000_000).alias("_ship"),
        F.sum(F.col("l_extendedprice") * (0.05 - F.col("l_discount"))).alias("_p"),
    )
    closes = opens.join(sums, F.col("ticket") == F.col("l_orderkey")).select(
        "ticket",
        F.lit("CLOSE").alias("action"),
        "symbol",
        F.greatest(F.col("_ship"), F.col("event_time") + 86400).alias("event_time"),
        "order_type",
        F.round("_p", 4).alias("profit"),
    )
    return opens.unionByName(closes)


def closed_trades(spark, folder):
    """ticket, symbol, direction, open_time, close_time, profit, one row per closed order."""
    from tapeloom.operators.matching import pair_open_close

    pairs = pair_open_close(trade_log(spark, folder), "ticket", "event_time", ["symbol", "order_type"])
    return pairs.withColumns(
        {
            "direction": F.when(F.col("order_type") == 0, 1).otherwise(-1),
            "decision_id": F.when(F.col("ticket") % 4 == 0, F.col("ticket")),
        }
    )


def predictions(spark, folder):
    """pred_id, timestamp (s), symbol, direction, probability, decision_id, model."""
    opens = trade_log(spark, folder).filter(F.col("action") == "OPEN")
    cust = table(spark, folder, "orders").select(F.col("o_orderkey").alias("ticket"), "o_custkey")
    return (
        opens.filter(F.col("ticket") % 3 == 0)
        .join(cust, "ticket")
        .select(
            F.col("ticket").alias("pred_id"),
            (F.col("event_time") - 30).alias("timestamp"),
            "symbol",
            F.when(F.col("order_type") == 0, 1).otherwise(-1).alias("direction"),
            ((F.col("o_custkey") % 100) / 100.0).alias("probability"),
            F.when(F.col("ticket") % 6 == 0, F.col("ticket")).alias("decision_id"),
            (F.col("o_custkey") % 4).cast("int").alias("model"),
        )
    )


def matched(spark, folder, trades=None):
    """Every prediction with the trade it owns, if any; ``trades`` when already at hand."""
    from tapeloom.operators.matching import match_predictions

    trades = pin(closed_trades(spark, folder)) if trades is None else trades
    return match_predictions(predictions(spark, folder), trades, 60)


def matched_and_trades(spark, folder):
    """Both sides of the match, stored because reports read them several times."""
    trades = pin(closed_trades(spark, folder))
    return pin(matched(spark, folder, trades)), trades


def decisions(spark, folder):
    """decision_id, model_idx, chosen, action, probability, executed_model_idx, profit."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("decision_id"),
        (F.col("user_id") % 4).cast("int").alias("model_idx"),
        (F.col("event_id") % 2 == 0).cast("int").alias("chosen"),
        F.when(F.col("event_id") % 5 < 2, "shadow")
        .when(F.col("event_id") % 5 < 4, "buy")
        .otherwise("sell")
        .alias("action"),
        ((F.col("user_id") * 7 + F.col("event_id") % 13) % 100 / 100.0).alias("probability"),
        (F.floor(F.col("event_id") / 7) % 3).cast("int").alias("executed_model_idx"),
        F.round(F.col("value") - 20.0, 4).alias("profit"),
        micros("ts").alias("t"),
    )


CTES = {
    "ticks": """ticks AS (SELECT event_type AS symbol, epoch_us(ts) AS t, event_id AS id, value AS bid,
        value * 1.0002::DOUBLE AS ask, user_id FROM events)""",
    "bars": """bars AS (SELECT event_type AS symbol, epoch_us(ts) // 3600000000 AS hr,
        arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
        count(*) AS volume FROM events GROUP BY 1, 2)""",
    "trades": """opens AS (SELECT o_orderkey AS ticket, o_orderpriority AS symbol, o_custkey,
        epoch_us(o_orderdate) // 1000000 + o_orderkey % 86400 AS open_time, o_custkey % 2 AS order_type FROM orders),
    trades AS (SELECT ticket, symbol, CASE WHEN order_type = 0 THEN 1 ELSE -1 END AS direction, open_time,
        greatest(ship, open_time + 86400) AS close_time, round(p, 4) AS profit, order_type,
        CASE WHEN ticket % 4 = 0 THEN ticket END AS decision_id
        FROM opens JOIN (SELECT l_orderkey, max(epoch_us(l_shipdate) // 1000000) AS ship,
            sum(l_extendedprice * (0.05::DOUBLE - l_discount)) AS p FROM lineitem GROUP BY 1) l ON l_orderkey = ticket)""",
    "preds": """preds AS (SELECT ticket AS pred_id, open_time - 30 AS timestamp, symbol,
        CASE WHEN order_type = 0 THEN 1 ELSE -1 END AS direction, (o_custkey % 100) / 100.0::DOUBLE AS probability,
        CASE WHEN ticket % 6 = 0 THEN ticket END AS decision_id, (o_custkey % 4)::INT AS model FROM opens WHERE ticket % 3 = 0)""",
    "matched": """by_id AS (SELECT p.pred_id, arg_min(t.ticket, (t.open_time, t.ticket)) AS ticket FROM preds p JOIN trades t
        ON p.decision_id = t.decision_id GROUP BY 1),
    free_trades AS (SELECT * FROM trades WHERE ticket NOT IN (SELECT ticket FROM by_id)),
    near AS (SELECT p.pred_id, p.timestamp, arg_min(t.ticket, (t.open_time, t.ticket)) AS ticket FROM preds p JOIN free_trades t
        ON p.symbol = t.symbol AND p.direction = t.direction AND t.open_time BETWEEN p.timestamp AND p.timestamp + 60
        WHERE p.pred_id NOT IN (SELECT pred_id FROM by_id) GROUP BY 1, 2),
    owned AS (SELECT arg_min(pred_id, (timestamp, pred_id)) AS pred_id, ticket FROM near GROUP BY ticket
        UNION ALL SELECT pred_id, ticket FROM by_id),
    matched AS (SELECT p.*, o.ticket, t.open_time, t.close_time, t.profit, t.order_type, o.ticket IS NOT NULL AS is_match
        FROM preds p LEFT JOIN owned o USING (pred_id) LEFT JOIN trades t ON t.ticket = o.ticket)""",
    "decisions": """decisions AS (SELECT event_id AS decision_id, (user_id % 4)::INT AS model_idx,
        (event_id % 2 = 0)::INT AS chosen,
        CASE WHEN event_id % 5 < 2 THEN 'shadow' WHEN event_id % 5 < 4 THEN 'buy' ELSE 'sell' END AS action,
        ((user_id * 7 + event_id % 13) % 100) / 100.0::DOUBLE AS probability,
        ((event_id // 7) % 3)::INT AS executed_model_idx, round(value - 20.0::DOUBLE, 4) AS profit,
        epoch_us(ts) AS t FROM events)""",
}
