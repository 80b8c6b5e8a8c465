"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.scalar import micros
from tapeloom.operators import joins as J
from tapeloom.operators import matching as M
from tapeloom.plans import base
from tapeloom.plans.base import bars, query, table, ticks
from tapeloom.session import parts_for

HOUR, DAY = 3_600_000_000, 86_400_000_000


@query("open_close_pairs", """
SELECT ticket, symbol, order_type::INT AS order_type, open_time, close_time, profit FROM trades""", doubles="profit", digits=4, ctes="trades")
def open_close_pairs(spark, sf):
    return base.closed_trades(spark, sf).select("ticket", "symbol", "order_type", "open_time", "close_time", "profit")


@query("prediction_match", """
SELECT pred_id, ticket, open_time, close_time, profit, is_match FROM matched""", doubles="profit", digits=4, ctes="trades preds matched")
def prediction_match(spark, sf):
    return base.matched(spark, sf).select("pred_id", "ticket", "open_time", "close_time", "profit", "is_match")


@query("unused_trades", """
SELECT ticket, profit FROM trades WHERE ticket NOT IN (SELECT ticket FROM matched WHERE is_match)""",
    doubles="profit", digits=4, ctes="trades preds matched")
def unused_trades(spark, sf):
    matched, trades = base.matched_and_trades(spark, sf)
    return M.unused_trades(trades, matched).select("ticket", "profit")


@query("unmatched_predictions", """
SELECT pred_id, probability FROM matched WHERE NOT is_match""", doubles="probability", ctes="trades preds matched")
def unmatched_predictions(spark, sf):
    return base.matched(spark, sf).filter(~F.col("is_match")).select("pred_id", "probability")


def _purchases(spark, sf):
    return ticks(spark, sf).filter(F.col("symbol") == "purchase").select("user_id", "t", "id", "bid")


@query("point_in_time_features", f"""
WITH f AS (SELECT user_id, t, id, bid FROM ticks WHERE symbol = 'purchase'), l AS (SELECT user_id, t, id FROM ticks WHERE symbol = 'click')
SELECT l.id, CASE WHEN l.t - f.t <= {DAY} THEN f.bid END AS feature_value FROM l ASOF LEFT JOIN f ON l.user_id = f.user_id AND l.t >= f.t""",
    doubles="feature_value", ctes="ticks")
def point_in_time_features(spark, sf):
    left = ticks(spark, sf).filter(F.col("symbol") == "click").select("user_id", "t", "id")
    right = _purchases(spark, sf).withColumnsRenamed({"t": "ft", "id": "fid", "bid": "feature_value"})
    return J.point_in_time(left, right, ["user_id"], "t", "ft", "id", "fid", ["feature_value"], DAY).select("id", "feature_value")


@query("latest_feature", """
SELECT user_id, arg_max(bid, (t, id)) AS bid, max(t) AS t FROM ticks GROUP BY 1""", doubles="bid", ctes="ticks")
def latest_feature(spark, sf):
    return M.latest_per_key(ticks(spark, sf).select("user_id", "t", "id", "bid"), ["user_id"], ["t", "id"]).select("user_id", "bid", "t")


def _news(spark, sf):
    """News vectors: symbol from the label, one per hour from the start of 2024."""
    e = table(spark, sf, "embeddings")
    names = F.array(*[F.lit(s) for s in base.SYMBOLS])
    return e.select(
        F.get(names, F.col("label") % 5).alias("symbol"),
        (F.lit(1704067200000000) + F.col("vec_id") * HOUR).alias("nt"),
        F.col("vec_id").alias("nid"),
        F.col("embedding").alias("vec"),
        F.get("embedding", F.lit(0)).cast("double").alias("score"),
    )


base.CTES["news"] = f"""news AS (SELECT ['click','error','purchase','signup','view'][label % 5 + 1] AS symbol, 1704067200000000 + vec_id * {HOUR} AS nt,
    vec_id AS nid, embedding::DOUBLE[] AS vec, embedding[1]::DOUBLE AS score FROM embeddings)"""


@query("sentiment_asof", """
SELECT id, coalesce(score, 0) AS sentiment FROM ticks ASOF LEFT JOIN news ON ticks.symbol = news.symbol AND t >= nt""", doubles="sentiment", ctes="ticks news")
def sentiment_asof(spark, sf):
    news = _news(spark, sf).select("symbol", "nt", "nid", "score")
    return J.sentiment_asof(ticks(spark, sf).select("symbol", "t", "id"), news, ["symbol"], "t", "nt", "id", "nid", "score").select("id", "sentiment")


@query("sentiment_by_symbol", """
WITH s AS (SELECT symbol, avg(score) AS mean_score, count(*) AS headline_count FROM news GROUP BY 1)
SELECT id, mean_score, headline_count FROM ticks LEFT JOIN s USING (symbol)""", doubles="mean_score", ctes="ticks news")
def sentiment_by_symbol(spark, sf):
    s = _news(spark, sf).groupBy("symbol").agg(
        F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("headline_count"), F.max("symbol").alias("embedding")
    )
    return J.sentiment_by_symbol(ticks(spark, sf).select("symbol", "id"), s).select("id", "mean_score", "headline_count")


@query("news_sequence", f"""
WITH c AS (SELECT id, t, nt, nid, vec, row_number() OVER (PARTITION BY id ORDER BY nt DESC, nid DESC) AS age FROM ticks JOIN news
    ON ticks.symbol = news.symbol AND nt <= t AND nt >= t - {2 * DAY}),
g AS (SELECT id, count(*) AS n, max(vec[1]) FILTER (age = 1) AS newest, sum(list_sum(vec)) AS total FROM c WHERE age <= 3 GROUP BY 1)
SELECT t.id, coalesce(n, 0)::INT AS news_count, coalesce(newest, 0) AS newest, coalesce(total, 0) AS total, 3 AS steps FROM ticks t LEFT JOIN g ON g.id = t.id""",
    doubles="newest total", ctes="ticks news")
def news_sequence(spark, sf):
    df = J.news_sequence(ticks(spark, sf).select("symbol", "t", "id"), _news(spark, sf), "t", "nt", "id", "nid", "vec", 3, 64, 2 * DAY)
    seq = F.col("news_sequence")
    whole = F.aggregate(F.flatten(seq), F.lit(0.0), lambda x, y: x + y)
    return df.select("id", "news_count", seq[2][0].alias("newest"), whole.alias("total"), F.size(seq).alias("steps"))


@query("calendar_events", f"""
WITH cal AS (SELECT o_orderkey AS id, (epoch_us(o_orderdate) // 1000000 + o_orderkey % 86400) AS time, (o_custkey % 7) / 2.0::DOUBLE AS impact FROM orders WHERE o_totalprice > 400000),
rows AS (SELECT DISTINCT epoch_us(l_shipdate) // 1000000 AS rid, epoch_us(l_shipdate) // 1000000 AS t FROM lineitem),
j AS (SELECT rid, count(id) AS n, max(impact) FILTER (impact > 0) AS impact, arg_min(id, (-impact, id)) FILTER (impact > 0) AS ev
    FROM rows LEFT JOIN cal ON abs(t - time) <= 7200 GROUP BY rid)
SELECT rid, (n > 0)::INT::DOUBLE AS event_flag, coalesce(impact, 0) AS event_impact, coalesce(ev, 0) AS calendar_event_id FROM j""",
    doubles="event_flag event_impact")
def calendar_events(spark, sf):
    o = table(spark, sf, "orders").filter(F.col("o_totalprice") > 400000)
    cal = o.select(
        F.col("o_orderkey").alias("id"),
        (F.floor(micros("o_orderdate") / 1_000_000) + F.col("o_orderkey") % 86400).alias("time"),
        ((F.col("o_custkey") % 7) / 2.0).alias("impact"),
    )
    seconds = F.floor(micros("l_shipdate") / 1_000_000)
    rows = table(spark, sf, "lineitem").select(seconds.alias("t")).distinct().withColumn("rid", F.col("t"))
    return J.calendar_join(rows, cal, "t", "rid", 7200).select("rid", "event_flag", "event_impact", "calendar_event_id")


@query("depth_join", """
WITH d AS (SELECT epoch_us(ts) AS t, max('[' || round(value, 2) || ', 2.5, 1.25]') AS txt FROM events WHERE event_id % 2 = 0 GROUP BY 1)
SELECT id, ticks.t, CASE WHEN txt IS NULL THEN NULL ELSE bid + 3.75 END AS bid_vol FROM ticks LEFT JOIN d ON ticks.t = d.t""", doubles="bid_vol", ctes="ticks")
def depth_join(spark, sf):
    from tapeloom.sources.readers import join_depth, parse_depth

    e = table(spark, sf, "events").filter(F.col("event_id") % 2 == 0)
    depth = e.groupBy(micros("ts").alias("t")).agg(F.max(F.concat(F.lit("["), F.col("value").cast("string"), F.lit(", 2.5, 1.25]"))).alias("bid_depth"))
    df = join_depth(ticks(spark, sf).select("id", "t"), parse_depth(depth, ["bid_depth"]), "t")
    return df.select("id", "t", F.aggregate("bid_depth", F.lit(0.0), lambda a, x: a + x).alias("bid_vol"))


@query("metrics_join", """
WITH m AS (SELECT c_custkey % 40 AS magic, avg(c_acctbal) AS equity FROM customer GROUP BY 1)
SELECT ticket, equity FROM opens LEFT JOIN m ON m.magic = o_custkey % 50""", doubles="equity", digits=4, ctes="trades")
def metrics_join(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ticket"), (F.col("o_custkey") % 50).alias("magic"))
    m = table(spark, sf, "customer").groupBy((F.col("c_custkey") % 40).alias("model_id")).agg(F.avg("c_acctbal").alias("equity"))
    return J.metrics_join(o, m).select("ticket", "equity")


@query("decisions_with_profit", """
SELECT d.decision_id, coalesce(t.profit, 0) AS profit FROM (SELECT decision_id FROM decisions) d LEFT JOIN (SELECT decision_id, profit FROM trades WHERE decision_id IS NOT NULL) t USING (decision_id)""",
    doubles="profit", digits=4, ctes="decisions trades")
def decisions_with_profit(spark, sf):
    d = base.decisions(spark, sf).select("decision_id")
    return J.decisions_with_profit(d, base.closed_trades(spark, sf).filter(F.col("decision_id").isNotNull())).select("decision_id", "profit")


@query("trades_with_prediction", """
SELECT t.decision_id, t.profit, d.probability FROM trades t JOIN decisions d ON t.decision_id = d.decision_id""",
    doubles="profit probability", digits=4, ctes="decisions trades")
def trades_with_prediction(spark, sf):
    t = base.closed_trades(spark, sf).select("decision_id", "profit")
    return t.join(base.decisions(spark, sf).select("decision_id", "probability"), "decision_id")


@query("trace_metrics", """
WITH m AS (SELECT user_id AS trace_id, arg_max(bid, (t, id)) AS metric FROM ticks GROUP BY 1)
SELECT id, trace_id, metric FROM (SELECT id, user_id AS trace_id FROM ticks WHERE symbol = 'error') JOIN m USING (trace_id)""", doubles="metric", ctes="ticks")
def trace_metrics(spark, sf):
    t = ticks(spark, sf).withColumnRenamed("user_id", "trace_id")
    left = t.filter(F.col("symbol") == "error").select(F.col("id").alias("id_"), "trace_id")
    m = t.select("trace_id", "t", "id", F.col("bid").alias("metric"))
    return J.trace_join(left, m, ["t", "id"]).select(F.col("id_").alias("id"), "trace_id", "metric")


EDGES = [("click", "view"), ("click", "error"), ("purchase", "signup")]


def _edges(spark):
    """The symbol graph, a configuration of a few edges."""
    return spark.createDataFrame(EDGES, "src string, dst string")


@query("graph_price_pairs", """
WITH e(src, dst) AS (VALUES ('click', 'view'), ('click', 'error'), ('purchase', 'signup'))
SELECT a.symbol AS a, b.symbol AS b, a.hr, a.close AS x, b.close AS y FROM bars a JOIN e ON e.src = a.symbol JOIN bars b ON b.symbol = e.dst AND b.hr = a.hr""",
    doubles="x y", ctes="bars")
def graph_price_pairs(spark, sf):
    return J.graph_pairs(bars(spark, sf), _edges(spark), "hr", "close")


def _entity_graph(spark, sf):
    """Symbols = nations, entities = suppliers, sectors = balance bands, articles = orders."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("sym"), "n_nationkey").alias("id"), F.lit("symbol").alias("type"), F.lit(None).cast("double").alias("sentiment"))
    s = table(spark, sf, "supplier")
    ent = s.select(F.concat(F.lit("ent"), "s_suppkey").alias("id"), F.lit("company").alias("type"), F.lit(None).cast("double").alias("sentiment"))
    band = F.concat(F.lit("sec"), (F.col("s_suppkey") % 7).cast("string"))
    sec = s.select(band.alias("id"), F.lit("sector").alias("type"), F.lit(None).cast("double").alias("sentiment")).distinct()
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_discount")
    li = items.repartition(parts_for(items), "l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_discount").alias("d"))
    art = li.groupBy("l_orderkey").agg(F.max("d").alias("sentiment")).select(
        F.concat(F.lit("art"), "l_orderkey").alias("id"), F.lit("article").alias("type"), "sentiment")
    edges = (
        s.select(F.concat(F.lit("sym"), "s_nationkey").alias("src"), F.concat(F.lit("ent"), "s_suppkey").alias("dst"))
        .unionByName(s.select(F.concat(F.lit("ent"), "s_suppkey").alias("src"), band.alias("dst")))
        .unionByName(li.select(F.concat(F.lit("ent"), "l_suppkey").alias("src"), F.concat(F.lit("art"), "l_orderkey").alias("dst")))
    )
    return n.unionByName(ent).unionByName(sec).unionByName(art), edges


@query("entity_graph_features", """
WITH art AS (SELECT l_orderkey AS o, max(l_discount) AS s FROM lineitem GROUP BY 1),
ea AS (SELECT DISTINCT l_suppkey AS e, l_orderkey AS o FROM lineitem),
tot AS (SELECT s_suppkey AS e, s_nationkey AS n, s_suppkey % 7 AS sec, count(o) AS c, coalesce(sum(s), 0) AS s FROM supplier LEFT JOIN (SELECT e, ea.o, s FROM ea JOIN art ON art.o = ea.o) x ON e = s_suppkey GROUP BY 1, 2, 3),
peer AS (SELECT a.e, a.n, a.c, a.s, coalesce(sum(b.c), 0) AS pc, coalesce(sum(b.s), 0) AS ps FROM tot a LEFT JOIN tot b ON a.sec = b.sec AND a.e <> b.e GROUP BY 1, 2, 3, 4)
SELECT 'sym' || n_nationkey AS symbol, coalesce(sum(c + pc), 0)::BIGINT AS graph_article_count,
    coalesce(sum(s + ps) / nullif(sum(c + pc), 0), 0) AS graph_sentiment FROM nation LEFT JOIN peer ON n = n_nationkey GROUP BY 1""", doubles="graph_sentiment", digits=9)
def entity_graph_features(spark, sf):
    df = J.entity_paths(*_entity_graph(spark, sf))
    return df.withColumn("graph_article_count", F.col("graph_article_count").cast("long"))


@query("volatility_lookup", f"""
WITH d AS (SELECT symbol, t, id, bid - lag(bid) OVER (PARTITION BY symbol ORDER BY t, id) AS d FROM ticks),
h AS (SELECT symbol, t // {HOUR} AS hr, stddev_pop(d) AS v FROM d GROUP BY 1, 2 HAVING count(d) > 1),
y AS (SELECT symbol, t // {DAY} AS dy, stddev_pop(d) AS v FROM d GROUP BY 1, 2 HAVING count(d) > 1)
SELECT id, coalesce(h.v, y.v, 0) AS volatility FROM ticks LEFT JOIN h ON t // {HOUR} = hr AND h.symbol = ticks.symbol LEFT JOIN y ON t // {DAY} = dy AND y.symbol = ticks.symbol""", doubles="volatility", ctes="ticks")
def volatility_lookup(spark, sf):
    from tapeloom.operators.ticks import interval_volatility

    t = ticks(spark, sf)

    def table_for(span, name):
        v = interval_volatility(t, ["symbol"], ["t", "id"], "bid", "t", span, name)
        return v.filter(F.col("moves") > 1).select("symbol", name, "volatility")

    left = t.select("symbol", "id", F.floor(F.col("t") / HOUR).alias("hr"), F.floor(F.col("t") / DAY).alias("dy"))
    return J.volatility_lookup(left, table_for(HOUR, "hr"), table_for(DAY, "dy")).select("id", "volatility")


@query("completed_bar_lookup", f"""
WITH b AS (SELECT symbol, t // {6 * HOUR} AS bar, avg(bid) AS m, arg_max(bid, t) AS c, stddev_pop(bid) AS s FROM ticks GROUP BY 1, 2)
SELECT id, m AS htf_mean, c AS htf_close, s AS htf_std FROM ticks t LEFT JOIN b ON b.symbol = t.symbol AND b.bar = t.t // {6 * HOUR} - 1""",
    doubles="htf_mean htf_close htf_std", ctes="ticks")
def completed_bar_lookup(spark, sf):
    t = ticks(spark, sf)
    return J.completed_bar_lookup(t.select("symbol", "t", "id"), t, "t", "bid", 6 * HOUR).select("id", "htf_mean", "htf_close", "htf_std")


@query("transitions", """
WITH o AS (SELECT ticket, close_time, profit, order_type, symbol, hour AS h FROM (SELECT *, (open_time // 3600) % 24 AS hour FROM trades))
SELECT ticket, CASE WHEN order_type = 0 THEN 0 ELSE 1 END AS action, profit AS reward, h::INT AS hour,
    coalesce(lead(h) OVER w, h)::INT AS next_hour, symbol, coalesce(lead(symbol) OVER w, symbol) AS next_symbol FROM o WINDOW w AS (ORDER BY close_time, ticket)""",
    doubles="reward", digits=4, ctes="trades")
def transitions(spark, sf):
    t = base.closed_trades(spark, sf).select(
        "ticket", "close_time", "symbol", F.col("profit").alias("reward"),
        F.when(F.col("order_type") == 0, 0).otherwise(1).alias("action"),
        (F.floor(F.col("open_time") / 3600) % 24).cast("int").alias("hour"),
    )
    return M.transitions(t, ["close_time", "ticket"], ["hour", "symbol"], "action", "reward").select(
        "ticket", "action", "reward", "hour", "next_hour", "symbol", "next_symbol")
