"""Enrichment joins: point-in-time features, sentiment, news sequences, calendar, graph paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.asof import asof
from tapeloom.operators.matching import latest_per_key
from tapeloom.operators.ordered import OWN, POS, lay_out
from tapeloom.session import parts_for, pin


def point_in_time(left, right, by, left_time, right_time, left_id, right_id, features, ttl):
    """Left rows with the newest feature values not older than ``ttl``, null otherwise."""
    hit = asof(left, right, by, left_time, right_time, left_id, right_id, "backward", ttl)
    return hit.withColumns({f: F.col(f"match.{f}") for f in features}).drop("match")


def sentiment_asof(left, news, by, left_time, news_time, left_id, news_id, score):
    """Newest score at or before the row's time, 0 without one."""
    hit = asof(left, news, by, left_time, news_time, left_id, news_id)
    return hit.withColumn("sentiment", F.coalesce(F.col(f"match.{score}"), F.lit(0.0))).drop("match")


def sentiment_by_symbol(left: DataFrame, scores: DataFrame) -> DataFrame:
    """Numeric sentiment columns by symbol; text and embedding columns are left out."""
    numeric = [
        f.name for f in scores.schema.fields
        if f.dataType.typeName() in {"double", "float", "integer", "long"} and f.name not in {"symbol", "sentiment_timestamp"}
    ]
    return left.join(scores.select("symbol", *numeric), "symbol", "left")


def news_sequence(left, news, left_time, news_time, left_id, news_id, vector, window, dim, horizon):
    """Per row the last ``window`` news vectors within ``horizon``, zero-padded on the left.

    Each news row first collects itself and its predecessors, so that one lookup brings the whole
    sequence and no pairs of rows and news are formed.  The ordered pass over both sides carries only
    the place of a news row; sequences are joined to the rows that have one within ``horizon``.
    """
    lay = lay_out(news, ["symbol"], [news_time, news_id], before=window)
    item = F.struct(F.col(news_time).alias("t"), F.col(vector).alias("v"))
    packed = lay.df.withColumn("recent", F.collect_list(item).over(lay.rows(1 - window, 0))).filter(F.col(OWN))
    packed = pin(packed.select("symbol", F.col(news_time).alias("_nt"), F.col(POS).alias("_news"), "recent"))
    hit = asof(left, packed.drop("recent"), ["symbol"], left_time, "_nt", left_id, "_news")
    near = F.col("match._nt") >= F.col(left_time) - horizon if horizon > 0 else F.col("match").isNotNull()
    # Rows without news get places that no news has, all over, so that they don't meet in one task.
    none = -1 - F.pmod(F.xxhash64(left_id), F.lit(1 << 30))
    hit = hit.withColumn("_news", F.when(near, F.col("match._news")).otherwise(none)).drop("match")
    hit = hit.join(packed.select("_news", "recent"), "_news", "left").drop("_news")
    zero = F.array_repeat(F.lit(0.0), dim)
    recent = F.filter("recent", lambda x: x["t"] >= F.col(left_time) - horizon) if horizon > 0 else F.col("recent")
    vectors = F.transform(recent, lambda x: x["v"].cast("array<double>"))
    vectors = F.coalesce(vectors, F.array().cast("array<array<double>>"))
    return hit.withColumn("_vectors", vectors).withColumn("news_count", F.size("_vectors")).withColumn(
        "news_sequence", F.concat(F.array_repeat(zero, F.lit(window) - F.size("_vectors")), "_vectors")
    ).drop("recent", "_vectors")


def calendar_steps(calendar: DataFrame, window: int) -> DataFrame:
    """The calendar as a step function of time: flag, best impact and its event per interval.

    Each event covers ``[time - window, time + window]``.  The value can only change where an
    event starts or has just ended; at each such point the covering events are those in a
    range frame of the calendar alone.  Times are integers; ``id`` is in calendar order.
    Buckets of the calendar keep the frames apart, with neighbours copied over.
    """
    width = 64 * (window + 1)
    events = calendar.select(F.col("time").cast("long").alias("t"), "impact", F.col("id").cast("long").alias("id"))
    # Of events at one time only the best can win; this bounds the frame to distinct times.
    events = events.groupBy("t").agg(
        F.max(F.struct("impact", (-F.col("id")).alias("n"))).alias("best")
    )
    points = events.select((F.col("t") - window).alias("t")).unionByName(
        events.select((F.col("t") + window + 1).alias("t"))
    ).distinct()
    rows = points.withColumns({"best": F.lit(None).cast(events.schema["best"].dataType), "point": F.lit(True)})
    rows = rows.unionByName(events.withColumn("point", F.lit(False)))
    first, last = F.floor((F.col("t") - window) / width), F.floor((F.col("t") + window) / width)
    rows = rows.withColumn(
        "b", F.explode(F.when(F.col("point"), F.array(F.floor(F.col("t") / width))).otherwise(F.sequence(first, last)))
    )
    near = Window.partitionBy("b").orderBy("t").rangeBetween(-window, window)
    rows = rows.withColumn("top", F.max(F.when(F.col("best.impact") > 0, F.col("best"))).over(near))
    rows = rows.withColumn("hit", F.count("best").over(near) > 0)
    return rows.filter("point").select(
        F.col("t").alias("from_time"),
        F.col("hit").cast("int").cast("double").alias("event_flag"),
        F.coalesce("top.impact", F.lit(0.0)).alias("event_impact"),
        F.coalesce(-F.col("top.n"), F.lit(0)).alias("calendar_event_id"),
    )


def calendar_join(left: DataFrame, calendar: DataFrame, time: str, row_id: str, window: int) -> DataFrame:
    """Event flag, largest impact (> 0) and the first event attaining it, around each row."""
    steps = calendar_steps(calendar, window)
    hit = asof(left, steps, [], time, "from_time", row_id, "from_time")
    return hit.withColumns(
        {
            "event_flag": F.coalesce("match.event_flag", F.lit(0.0)),
            "event_impact": F.coalesce("match.event_impact", F.lit(0.0)),
            "calendar_event_id": F.coalesce("match.calendar_event_id", F.lit(0)),
        }
    ).drop("match")


def metrics_join(trades: DataFrame, metrics: DataFrame, left_key: str = "magic") -> DataFrame:
    """Left join on ``magic``, or on ``model_id`` when the metrics have no magic column."""
    key = "magic" if "magic" in metrics.columns else "model_id"
    side = metrics.withColumnRenamed(key, "_m")
    return trades.join(side, F.col(left_key) == F.col("_m"), "left").drop("_m")


def decisions_with_profit(decisions: DataFrame, trades: DataFrame) -> DataFrame:
    right = trades.select("decision_id", "profit")
    return decisions.join(right, "decision_id", "left").withColumn("profit", F.coalesce("profit", F.lit(0.0)))


def trace_join(telemetry: DataFrame, metrics: DataFrame, order: Sequence[str]) -> DataFrame:
    """Telemetry with the last metric of its trace."""
    return telemetry.join(latest_per_key(metrics, ["trace_id"], order), "trace_id")


def graph_pairs(prices: DataFrame, edges: DataFrame, time: str, value: str) -> DataFrame:
    """Values of both ends of every graph edge at equal times: (a, b, time, x, y)."""
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    left = prices.select(F.col("symbol").alias("a"), F.col(time).alias("_t"), F.col(value).alias("x"))
    right = prices.select(F.col("symbol").alias("b"), F.col(time).alias("_t"), F.col(value).alias("y"))
    return left.join(pairs, "a").join(right, ["b", "_t"]).select("a", "b", F.col("_t").alias(time), "x", "y")


def entity_paths(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Articles reached from each symbol through its entities and their sector peers.

    Paths are counted with multiplicity.  Counts and sentiment sums are aggregated at each
    hop, so that the number of rows stays bounded by the number of edges.  Edges are made distinct without
    direction and typed once, in parts of about PART_ROWS rows.
    """
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    ends = pin(edges.where("src IS NOT NULL AND dst IS NOT NULL").select(low.alias("a"), high.alias("b")))
    parts = parts_for(ends)
    pairs = ends.repartition(parts, "a", "b").distinct()
    way, back = F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))
    ways = F.when(F.col("a") == F.col("b"), F.array(way)).otherwise(F.array(way, back))
    both = pairs.select(F.explode(ways).alias("e")).select("e.*")
    kind = vertices.select(F.col("id").alias("dst"), "type", "sentiment")
    hop = pin(both.repartition(parts, "dst").join(kind.repartition(parts, "dst"), "dst").select("src", "dst", "type", "sentiment"))
    company = F.col("type").isin("entity", "company")
    start = vertices.filter(F.col("type") == "symbol").select(F.col("id").alias("symbol"))
    ents = vertices.filter(company).select(F.col("id").alias("ent"))
    # articles per entity: count and sentiment sum, summed before the join; a vertex may come more than once
    sums = hop.filter(F.col("type") == "article").groupBy(F.col("src").alias("ent")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("sentiment", F.lit(0.0))).alias("s")
    )
    articles = ents.groupBy("ent").agg(F.count(F.lit(1)).alias("k")).join(sums, "ent").select(
        "ent", (F.col("n") * F.col("k")).alias("n"), (F.col("s") * F.col("k")).alias("s")
    )
    to_sector = ents.join(hop.filter(F.col("type") == "sector"), F.col("ent") == F.col("src")).select(
        "ent", F.col("dst").alias("sector")
    )
    in_sector = to_sector.join(articles, "ent", "left").groupBy("sector").agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("sn"), F.sum(F.coalesce("s", F.lit(0.0))).alias("ss")
    )
    # Peers of an entity in a sector are all entities of the sector except itself.
    peers = to_sector.join(in_sector, "sector").join(articles, "ent", "left").groupBy("ent").agg(
        F.sum(F.col("sn") - F.coalesce("n", F.lit(0))).alias("pn"),
        F.sum(F.col("ss") - F.coalesce("s", F.lit(0.0))).alias("ps"),
    )
    reach = ents.join(articles, "ent", "left").join(peers, "ent", "left").select(
        "ent",
        (F.coalesce("n", F.lit(0)) + F.coalesce("pn", F.lit(0))).alias("n"),
        (F.coalesce("s", F.lit(0.0)) + F.coalesce("ps", F.lit(0.0))).alias("s"),
    )
    links = start.join(hop.filter(company), F.col("symbol") == F.col("src")).select("symbol", F.col("dst").alias("ent"))
    totals = links.join(reach, "ent").groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return start.join(totals, "symbol", "left").select(
        "symbol",
        F.coalesce("n", F.lit(0)).alias("graph_article_count"),
        F.coalesce(F.try_divide("s", "n"), F.lit(0.0)).alias("graph_sentiment"),
    )


def volatility_lookup(left: DataFrame, hourly: DataFrame, daily: DataFrame) -> DataFrame:
    """Volatility of the row's hour, else of its day, else 0."""
    h = hourly.withColumnRenamed("volatility", "_vh")
    d = daily.withColumnRenamed("volatility", "_vd")
    return (
        left.join(h, [c for c in hourly.columns if c != "volatility"], "left")
        .join(d, [c for c in daily.columns if c != "volatility"], "left")
        .withColumn("volatility", F.coalesce("_vh", "_vd", F.lit(0.0)))
        .drop("_vh", "_vd")
    )


def completed_bar_lookup(left: DataFrame, ticks: DataFrame, time: str, price: str, span: int) -> DataFrame:
    """Statistics of the bar completed before the one the row falls in."""
    bars = ticks.groupBy("symbol", F.floor(F.col(time) / span).alias("_bar")).agg(
        F.avg(price).alias("htf_mean"),
        F.max_by(price, time).alias("htf_close"),
        F.stddev_pop(price).alias("htf_std"),
    )
    done = bars.withColumn("_bar", F.col("_bar") + 1)
    return left.withColumn("_bar", F.floor(F.col(time) / span)).join(done, ["symbol", "_bar"], "left").drop("_bar")
