"""Source, sink and data-quality queries; text logs are written from the tables by Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapeloom.functions.scalar import hour_of, micros, session_tag
from tapeloom.operators import quality as Q
from tapeloom.plans import base
from tapeloom.plans.base import query, table, ticks
from tapeloom.session import shared_folder
from tapeloom.sources import readers as R
from tapeloom.sources import schemas as S
from tapeloom.sources import writers as W


def scratch(spark, name):
    """A new folder for one written log."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def raw_log(spark, sf):
    """A raw text trade log with every kind of flaw, derived from events."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    return e.select(
        i.alias("src"),
        F.when(i % 13 == 0, "2").otherwise("3").alias("schema_version"),
        F.when(i % 10 == 9, i - 1).otherwise(i).cast("string").alias("event_id"),
        F.when(i % 17 == 0, "not a time")
        .when(i % 2 == 0, F.date_format("ts", "yyyy.MM.dd HH:mm:ss"))
        .otherwise(F.date_format("ts", "yyyy.MM.dd HH:mm")).alias("event_time"),
        F.when(i % 7 == 0, "open").when(i % 7 < 3, "CLOSE").when(i % 7 < 5, "modify").when(i % 7 == 5, "hold").otherwise("").alias("action"),
        F.when(i % 23 != 0, (i % 97).cast("string")).alias("ticket"),
        F.col("event_type").alias("symbol"),
        (F.col("value") - 1).cast("string").alias("lots"),
        F.when(i % 11 == 0, "abc").otherwise(F.col("value").cast("string")).alias("price"),
        F.concat(F.lit("auto decision_id="), F.col("user_id").cast("string")).alias("comment"),
        F.when(i % 3 == 0, "sl").alias("exit_reason"),
        F.when(i % 29 == 0, "x").otherwise((i % 2).cast("string")).alias("order_type"),
        F.when(i % 31 == 0, "high").when(i % 5 > 0, F.col("value").cast("string")).alias("sl"),
        F.when(i % 4 == 0, F.date_format(F.expr("ts - INTERVAL 90 SECONDS"), "yyyy.MM.dd HH:mm:ss")).alias("open_time"),
    )


base.CTES["raw_log"] = """raw_log AS (SELECT event_id AS src, CASE WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END AS event_id,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE date_trunc('minute', ts) END AS event_ts,
    CASE WHEN event_id % 7 = 0 THEN 'OPEN' WHEN event_id % 7 < 3 THEN 'CLOSE' WHEN event_id % 7 < 5 THEN 'MODIFY' WHEN event_id % 7 = 5 THEN 'HOLD' ELSE '' END AS action,
    CASE WHEN event_id % 23 <> 0 THEN event_id % 97 END AS ticket, event_type AS symbol, value - 1 AS lots,
    CASE WHEN event_id % 11 <> 0 THEN value END AS price, user_id, event_id % 29 = 0 OR event_id % 31 = 0 AS unfit, CASE WHEN event_id % 3 = 0 THEN 'SL' ELSE '' END AS exit_reason,
    CASE WHEN event_id % 4 = 0 THEN date_trunc('second', ts - INTERVAL 90 SECONDS) END AS open_ts FROM events),
flagged AS (SELECT *, CASE WHEN src <> min(src) OVER (PARTITION BY event_id) THEN 'duplicate event_id'
    WHEN ticket IS NULL OR action = '' THEN 'missing ticket or action'
    WHEN lots < 0 OR price IS NULL THEN 'negative lots or no price'
    WHEN event_ts IS NULL OR unfit THEN 'row does not fit the trade schema' END AS reject_reason FROM raw_log WHERE action <> 'HOLD')"""


@query("trade_csv_scan", """
SELECT event_id, epoch_us(event_ts) AS t, lots, price, action, ticket::INT AS ticket FROM raw_log""",
    doubles="lots price", ctes="raw_log")
def trade_csv_scan(spark, sf):
    path = scratch(spark, "csv")
    raw_log(spark, sf).withColumnRenamed("symbol", "Symbol").write.option("header", True).csv(path)
    df = R.read_trades_csv(spark, path)
    return df.select(F.col("event_id").cast("long").alias("event_id"), micros("event_time").alias("t"), "lots", "price", F.upper(F.coalesce("action", F.lit(""))).alias("action"), "ticket")


def _scanned(spark, sf):
    """The log in two sets of files: one in reverse column order and without some of the columns."""
    path = scratch(spark, "trades")
    log = raw_log(spark, sf).withColumn("comment", F.col("src").cast("string"))
    even, odd = log.filter("src % 2 = 0").drop("src"), log.filter("src % 2 = 1").drop("src", "open_time")
    even.write.option("header", True).option("sep", ";").csv(f"{path}/a")
    odd.select(*reversed(odd.columns)).write.option("header", True).option("sep", ";").csv(f"{path}/b")
    return R.read_trade_files(spark, [f"{path}/a", f"{path}/b"]).withColumn("src", F.col("comment").cast("long"))


@query("trade_files_scan", """
SELECT src, event_id, symbol, price, NULL::VARCHAR AS swap FROM raw_log""", doubles="price", ctes="raw_log")
def trade_files_scan(spark, sf):
    return _scanned(spark, sf).select("src", F.col("event_id").cast("long").alias("event_id"), "symbol", F.col("price").try_cast("double").alias("price"), "swap")


@query("clean_trades", """
SELECT src, event_id, action, ticket::BIGINT AS ticket, lots, price, exit_reason, epoch_us(event_ts) AS t,
    CASE WHEN open_ts IS NULL THEN 0 ELSE date_diff('second', open_ts, event_ts) END AS trade_duration FROM flagged WHERE reject_reason IS NULL""",
    doubles="lots price trade_duration", ctes="raw_log")
def clean_trades(spark, sf):
    clean, _ = Q.clean_trades(_scanned(spark, sf), "src")
    return clean.select("src", F.col("event_id").cast("long").alias("event_id"), "action", F.col("ticket").cast("long").alias("ticket"),
                        "lots", "price", "exit_reason", micros("event_ts").alias("t"), "trade_duration")


@query("quarantine_sink", """
WITH r AS (SELECT reject_reason, event_id FROM flagged WHERE reject_reason IS NOT NULL UNION ALL SELECT 'other schema version', event_id FROM flagged WHERE src % 13 = 0)
SELECT reject_reason, count(*) AS n, count(DISTINCT event_id) AS ids FROM r GROUP BY 1""", ctes="raw_log")
def quarantine_sink(spark, sf):
    _, rejected = Q.clean_trades(_scanned(spark, sf), "src")
    path = scratch(spark, "invalid_rows")
    W.write_quarantine(rejected.select("event_id", "ticket", "action", "reject_reason"), path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query("duplicate_ids", """
SELECT src, event_id FROM flagged WHERE reject_reason = 'duplicate event_id'""", ctes="raw_log")
def duplicate_ids(spark, sf):
    rows = raw_log(spark, sf).filter(F.col("action") != "hold")
    return Q.first_of_id(rows, "event_id", "src").filter(~F.col("is_first")).select("src", F.col("event_id").cast("long").alias("event_id"))


@query("default_fill", """
SELECT event_id AS src, CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END AS equity, CASE WHEN event_id % 4 = 0 THEN event_id % 5 ELSE -1 END AS executed_model_idx,
    CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE '' END AS exit_reason, 0 AS decision_id FROM events""", doubles="equity")
def default_fill(spark, sf):
    i = F.col("event_id")
    raw = table(spark, sf, "events").select(
        i.alias("src"), F.when(i % 3 == 0, F.col("value").cast("string")).when(i % 3 == 1, "NaN").alias("equity"),
        F.when(i % 4 == 0, (i % 5).cast("string")).otherwise("x").alias("executed_model_idx"),
        F.when(i % 2 == 0, F.col("event_type")).alias("exit_reason"), F.lit(None).cast("string").alias("decision_id"))
    return Q.fill_defaults(raw).withColumn("decision_id", F.col("decision_id").cast("int"))


@query("incremental_scan", """
SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)""")
def incremental_scan(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    mark = scratch(spark, "mark")
    half = e.agg(F.floor(F.max("event_id") / 2).alias("event_id"))
    W.store_mark(half, mark)
    return W.newer_than_mark(e, mark)


@query("decision_parquet_scan", """
SELECT event_id AS decision_id, value / 500 AS probability, user_id::DOUBLE AS f1, value - 20 AS profit FROM events""", doubles="probability f1 profit")
def decision_parquet_scan(spark, sf):
    path = scratch(spark, "decisions")
    table(spark, sf, "events").select(
        F.col("event_id").alias("decision_id"), (F.col("value") / 500).alias("probability"),
        F.col("user_id").cast("double").alias("f1"), (F.col("value") - 20).alias("profit"), "props").write.parquet(path)
    return R.read_decisions(spark, path, S.REPLAY_DECISION)


@query("calendar_scan", """
SELECT row_number() OVER (ORDER BY o_orderdate) - 1 AS id, count(*) / 2.0::DOUBLE AS impact, epoch_us(o_orderdate) AS t FROM orders GROUP BY o_orderdate""", doubles="impact")
def calendar_scan(spark, sf):
    path = scratch(spark, "calendar")
    o = table(spark, sf, "orders").groupBy("o_orderdate").agg((F.count(F.lit(1)) / 2.0).alias("impact"))
    o.select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Time"), F.col("impact").alias("Impact")).write.option("header", True).csv(path)
    return R.read_calendar(spark, path).select("id", "impact", micros("time").alias("t"))


@query("news_embedding_scan", """
SELECT symbol, nid, score FROM news""", doubles="score", ctes="news")
def news_embedding_scan(spark, sf):
    from tapeloom.plans.joins import _news

    path = scratch(spark, "news")
    _news(spark, sf).select("symbol", F.col("nid").alias("Nid"), "score").write.option("header", True).csv(path)
    return R.read_news_embeddings(spark, path + "-missing.parquet", path).select("symbol", F.col("nid").cast("long").alias("nid"), F.col("score").cast("double").alias("score"))


@query("tick_scan", """
SELECT epoch_us(date_trunc('second', ts)) AS t, value AS bid, 0::DOUBLE AS ask, event_id::DOUBLE AS f0, user_id::DOUBLE AS f1 FROM events""", doubles="bid ask f0 f1")
def tick_scan(spark, sf):
    path = scratch(spark, "ticks")
    table(spark, sf, "events").select(
        F.date_format("ts", "yyyy.MM.dd HH:mm:ss").alias("time"), F.col("value").alias("bid"), F.lit("n/a").alias("ask"),
        F.col("user_id").alias("f1"), F.col("event_id").alias("f0")).write.option("header", True).option("sep", ";").csv(path)
    df = R.read_ticks(spark, path, ["f1", "f0"])
    return df.select(micros("time").alias("t"), "bid", "ask", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


@query("depth_by_position", """
WITH l AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT value, row_number() OVER (ORDER BY event_id) AS i FROM events)
SELECT event_id, value AS best_bid FROM l LEFT JOIN r USING (i)""", doubles="best_bid")
def depth_by_position(spark, sf):
    e = table(spark, sf, "events")
    left = e.select("event_id", "ts")
    right = e.select(F.col("event_id").alias("n"), F.concat(F.lit("["), F.col("value").cast("string"), F.lit("]")).alias("bid_depth"))
    df = R.join_depth(left, R.parse_depth(right, ["bid_depth"]), None, ["ts", "event_id"], ["n"])
    return df.select("event_id", F.col("bid_depth")[0].alias("best_bid"))


@query("file_hashes", """
SELECT count(DISTINCT event_type) AS files, count(*) AS matching FROM (SELECT DISTINCT event_type FROM events)""")
def file_hashes(spark, sf):
    path = scratch(spark, "hash")
    table(spark, sf, "events").select("event_type").distinct().select(F.col("event_type").alias("value"), F.col("event_type").alias("p")).write.partitionBy("p").text(path)
    h = R.file_hashes(spark, path + "/p=*/*.txt")
    same = F.sha2(F.concat(F.regexp_extract("path", r"p=(\w+)/", 1), F.lit("\n")), 256) == F.col("sha256")
    return h.agg(F.countDistinct("sha256").alias("files"), F.count_if(same).alias("matching"))


MESSAGE = "schema_version int, k long, event_id long"
JSON_LINES = """lines AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    CASE WHEN event_id % 13 = 0 THEN 'bad json' WHEN event_id % 11 = 0 THEN 'missing or mistyped field' WHEN event_id % 5 = 0 THEN 'schema version mismatch' END AS reason FROM events)"""


def json_lines(spark, sf):
    i = F.col("event_id")
    head = F.regexp_replace("props", r"\}$", "")
    return table(spark, sf, "events").select(
        F.when(i % 13 == 0, head)
        .when(i % 11 == 0, F.concat(head, F.lit(', "schema_version": 3}')))
        .otherwise(F.concat(head, F.lit(', "event_id": '), i.cast("string"), F.lit(', "schema_version": '), F.when(i % 5 == 0, "2").otherwise("3"), F.lit("}")))
        .alias("value"))


@query("json_log_accepted", f"""
WITH {JSON_LINES}
SELECT 3 AS schema_version, k, event_id FROM lines WHERE reason IS NULL""")
def json_log_accepted(spark, sf):
    path, out = scratch(spark, "wal"), scratch(spark, "accepted")
    json_lines(spark, sf).write.text(path)
    schema = S.struct(MESSAGE)
    good, _ = R.read_json_log(spark, path, schema, 3)
    return W.append_checked(good, schema, out)


@query("json_log_rejected", f"""
WITH {JSON_LINES}
SELECT reason, count(*) AS n FROM lines WHERE reason IS NOT NULL GROUP BY 1""")
def json_log_rejected(spark, sf):
    path = scratch(spark, "wal")
    json_lines(spark, sf).write.text(path)
    _, bad = R.read_json_log(spark, path, S.struct(MESSAGE), 3)
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("csv_to_parquet", """
SELECT event_id, value AS price, NULL::BIGINT AS volume FROM events""", doubles="price")
def csv_to_parquet(spark, sf):
    src, out = scratch(spark, "src"), scratch(spark, "out")
    table(spark, sf, "events").select("event_id", F.col("value").alias("price"), F.lit("many").alias("volume")).write.option("header", True).csv(src)
    return W.csv_to_parquet(spark, src, S.struct("event_id long, price double, volume long"), out)


@query("metric_store_last_rows", """
SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 50""", doubles="value")
def metric_store_last_rows(spark, sf):
    schema = S.struct("event_id long, value double")
    stored = W.append_checked(table(spark, sf, "events").select("event_id", "value"), schema, scratch(spark, "metrics"))
    return W.last_rows(stored, ["event_id"], 50)


@query("summary_append", """
SELECT count(*) AS trades, sum(value) AS total, true AS has_time FROM events""", doubles="total", digits=3)
def summary_append(spark, sf):
    s = table(spark, sf, "events").agg(F.count(F.lit(1)).alias("trades"), F.sum("value").alias("total"))
    return W.append_summary(s, scratch(spark, "summaries")).select("trades", "total", F.col("time").isNotNull().alias("has_time"))


@query("graph_tables", """
SELECT 'edge' AS kind, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) UNION ALL SELECT 'vertex', count(*) FROM supplier""")
def graph_tables(spark, sf):
    path = scratch(spark, "graph")
    v = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal")
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_orderkey").alias("dst")).distinct()
    W.export_graph(v, e, path)
    return W.graph_json(*W.import_graph(spark, path)).groupBy("kind").agg(F.count("value").alias("n"))


@query("rolling_retention", """
WITH r AS (SELECT event_type AS symbol, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT symbol, event_id FROM r WHERE n <= 20""")
def rolling_retention(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id")
    return W.newest_per_key(e, ["symbol"], ["ts", "event_id"], 20).select("symbol", "event_id")


@query("column_names", """
SELECT event_type AS event_name, event_id AS user_event_id FROM events""")
def column_names(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("eventName"), F.col("event_id").alias("userEventId"))
    return R.normalise_columns(e)


@query("time_parse", """
SELECT src, epoch_us(event_ts) AS t FROM raw_log""", ctes="raw_log")
def time_parse(spark, sf):
    from tapeloom.functions.scalar import parse_time

    return raw_log(spark, sf).select("src", micros(parse_time("event_time")).alias("t"))


@query("direction_decode", """
SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN 1 WHEN event_id % 5 IN (2, 3) THEN -1 ELSE 1 END AS direction FROM events""")
def direction_decode(spark, sf):
    i = F.col("event_id") % 5
    word = F.when(i == 0, " Buy ").when(i == 1, "1").when(i == 2, "SELL").when(i == 3, "0").otherwise("maybe")
    return table(spark, sf, "events").select("event_id", Q.direction_of(word).alias("direction"))


@query("prediction_aliases", """
SELECT event_id, value / 500 AS probability, ln(value) AS log_variance, (user_id % 4)::INT AS executed_model_idx,
    CASE WHEN event_id % 2 = 1 THEN 1 ELSE -1 END AS direction FROM events""", doubles="probability log_variance")
def prediction_aliases(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", (F.col("value") / 500).alias("prob"), F.col("value").cast("string").alias("variance"),
        (F.col("user_id") % 4).alias("model"), (F.col("event_id") % 2).alias("order_type"))
    return Q.prediction_columns(e).select("event_id", "probability", "log_variance", "executed_model_idx", "direction")


@query("action_filter", """
SELECT src, action FROM raw_log WHERE action <> 'HOLD'""", ctes="raw_log")
def action_filter(spark, sf):
    a = F.upper("action")
    return raw_log(spark, sf).filter((a == "") | a.isin(*Q.ACTIONS)).select("src", a.alias("action"))


@query("exact_duplicates", """
WITH c AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 3 = 0), d AS (SELECT DISTINCT * FROM c)
SELECT (SELECT count(*) FROM c) - (SELECT count(*) FROM d) AS duplicate_rows, (SELECT count(*) FROM d) AS kept_rows""")
def exact_duplicates(spark, sf):
    rows = table(spark, sf, "lineitem")
    kept, removed = Q.exact_duplicates(rows.unionByName(rows.filter("l_orderkey % 3 = 0")))
    return removed.join(F.broadcast(kept.agg(F.count(F.lit(1)).alias("kept_rows"))))  # one row each


@query("zscore_outliers", """
WITH s AS (SELECT avg(value) m, stddev_pop(value) d, avg(user_id) um, stddev_pop(user_id) ud FROM events)
SELECT event_id FROM events, s WHERE abs((value - m) / d) > 3 OR abs((user_id - um) / ud) > 3""")
def zscore_outliers(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", "user_id")
    return Q.zscore_outliers(e, ["value", "user_id"]).filter("is_outlier").select("event_id")


@query("expectation_report", """
WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 50 = 0 THEN NULL ELSE epoch_us(ts) END AS event_time, event_id % 25 AS hour, value - 1 AS volume, value / 300 AS meta_label,
    CASE WHEN event_id % 20 <> 0 THEN value END AS net_profit FROM events), p AS (SELECT *, lag(event_time) OVER (ORDER BY event_id) AS prev FROM e),
c AS (SELECT count(*) AS total, count_if(event_time IS NULL) a, count_if(event_time <= prev) b, count_if(hour IS NULL) c, count_if(hour NOT BETWEEN 0 AND 23) d,
    count_if(volume IS NULL) e, count_if(volume < 0) f, count_if(meta_label NOT BETWEEN 0 AND 1) g, count_if(net_profit IS NULL) h FROM p)
SELECT unnest(['event_time not null', 'event_time increasing', 'hour not null', 'hour in 0..23', 'volume not null', 'volume not negative', 'meta_label in 0..1', 'net_profit not null']) AS rule,
    unnest([a, b, c, d, e, f, g, h])::BIGINT AS failed, total FROM c""")
def expectation_report(spark, sf):
    i = F.col("event_id")
    e = table(spark, sf, "events").select(
        "event_id", F.when(i % 50 != 0, micros("ts")).alias("event_time"), (i % 25).alias("hour"), (F.col("value") - 1).alias("volume"),
        (F.col("value") / 300).alias("meta_label"), F.when(i % 20 != 0, F.col("value")).alias("net_profit"))
    return Q.expectations(e, ["event_id"])


@query("feature_bounds", """
SELECT 'atr' AS rule, count_if(value - 5 < 0) AS failed, count(*) AS total FROM events UNION ALL
SELECT 'book_imbalance', count_if(abs(value / 50) > 1), count(*) FROM events""", ints="failed")
def feature_bounds(spark, sf):
    e = table(spark, sf, "events").select((F.col("value") - 5).alias("atr"), (F.col("value") / 50).alias("book_imbalance"), "user_id")
    return Q.feature_bounds(e)


@query("data_contract", """
SELECT 'o_comment' AS name, 'string' AS expected, NULL::VARCHAR AS found UNION ALL SELECT 'o_orderstatus', 'int', 'string' UNION ALL
SELECT 'o_totalprice', NULL, 'double'""")
def data_contract(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return S.schema_difference(spark, o.schema, S.struct("o_orderkey long, o_orderstatus int, o_comment string"))


@query("message_validation", f"""
WITH {JSON_LINES}
SELECT count_if(reason IS NULL) AS accepted, count_if(reason IS NOT NULL) AS rejected, sum(k) FILTER (reason IS NULL)::BIGINT AS total_k FROM lines""", ints="accepted rejected")
def message_validation(spark, sf):
    p = R.parse_json_lines(json_lines(spark, sf), S.struct(MESSAGE), 3)
    ok = F.col("reason").isNull()
    return p.agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.sum(F.when(ok, F.col("row.k"))).alias("total_k"))


@query("feature_subset", """
SELECT event_id, value, user_id FROM events""", doubles="value")
def feature_subset(spark, sf):
    e = table(spark, sf, "events")
    S.require_columns(e, ["event_id", "value"])
    return Q.feature_subset(e, ["value", "user_id", " value"], keep=["event_id"])


@query("anomaly_flag_filter", """
SELECT event_id FROM events WHERE event_id % 6 NOT IN (0, 1, 2)""")
def anomaly_flag_filter(spark, sf):
    i = F.col("event_id") % 6
    flag = F.when(i == 0, "1").when(i == 1, "True").when(i == 2, "YES").when(i == 3, "0").when(i == 4, "no")
    return Q.not_flagged(table(spark, sf, "events").select("event_id", flag.alias("is_anomaly"))).select("event_id")


@query("cost_adjustment", """
SELECT ticket, profit - (1.5 + abs(profit) * 25 * 1e-4) AS net_profit, (profit - (1.5 + abs(profit) * 25 * 1e-4) > 0)::INT AS label FROM trades""",
    doubles="net_profit", digits=4, ctes="trades")
def cost_adjustment(spark, sf):
    t = base.closed_trades(spark, sf).withColumn("net_profit", Q.net_of_costs(F.col("profit"), 1.5, 25.0))
    return t.select("ticket", "net_profit", (F.col("net_profit") > 0).cast("int").alias("label"))


@query("session_tags", """
SELECT id, CASE WHEN (t // 3600000000) % 24 < 8 THEN 'asian' WHEN (t // 3600000000) % 24 < 16 THEN 'london' ELSE 'newyork' END AS session FROM ticks""", ctes="ticks")
def session_tags(spark, sf):
    return ticks(spark, sf).select("id", session_tag(hour_of("t")).alias("session"))


@query("uncertain_relabelled", """
SELECT decision_id, (profit > 0)::INT AS label, 1.0::DOUBLE AS weight FROM decisions WHERE abs(probability - 0.5::DOUBLE) >= 0.1 UNION ALL
SELECT decision_id, 1, 2.0::DOUBLE FROM decisions WHERE abs(probability - 0.5::DOUBLE) < 0.1""", ctes="decisions")
def uncertain_relabelled(spark, sf):
    d = base.decisions(spark, sf)
    sure = F.abs(F.col("probability") - 0.5) >= 0.1
    return Q.relabel_uncertain(
        d.filter(sure).select("decision_id", (F.col("profit") > 0).cast("int").alias("label")), d.filter(~sure).select("decision_id"), 1)


@query("union_of_logs", """
SELECT o_orderkey AS id, o_totalprice AS amount, NULL::DOUBLE AS tax FROM orders UNION ALL SELECT l_orderkey * 10 + l_linenumber, l_extendedprice, l_tax FROM lineitem""", doubles="amount tax")
def union_of_logs(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("amount"), F.col("l_tax").alias("tax"))
    return a.unionByName(b, allowMissingColumns=True)
