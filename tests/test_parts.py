"""Parts of stored tables, and vertices and news that come twice or not at all."""

from pyspark.sql import functions as F

from tapeloom import session
from tapeloom.operators import joins as J


def test_parts_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 10)
    assert session.parts_for(spark.range(1)) == session.shuffle_partitions(spark)
    assert session.parts_for(spark.range(95)) == 10


def test_paths_of_repeated_edges_and_vertices(spark):
    v = [("s", "symbol", None), ("e", "entity", None), ("f", "company", None), ("x", "sector", None), ("a1", "article", 0.5), ("a2", "article", None)]
    e = [("s", "e"), ("e", "s"), ("e", "a1"), ("a1", "e"), ("e", "a1"), ("f", "a2"), ("f", "f"), ("e", "x"), ("x", "f"), (None, "e"), ("f", None)]
    frames = spark.createDataFrame(v, "id string, type string, sentiment double"), spark.createDataFrame(e, "src string, dst string")
    assert tuple(J.entity_paths(*frames).first()) == ("s", 2, 0.25)


def test_ordered_pass_of_news_carries_no_vectors(spark, monkeypatch):
    widths, asof = [], J.asof
    monkeypatch.setattr(J, "asof", lambda left, right, *a: (widths.append([t for _, t in right.dtypes]), asof(left, right, *a))[1])
    news = spark.createDataFrame([("a", 10, 1, [1.0]), ("a", 20, 2, [2.0]), ("a", 20, 3, [3.0])], "symbol string, nt long, nid long, vec array<double>")
    left = spark.createDataFrame([("a", 5, 1), ("a", 20, 2), ("a", 29, 3), ("b", 20, 4), ("a", 99, 5)], "symbol string, t long, id long")
    got = J.news_sequence(left, news, "t", "nt", "id", "nid", "vec", 2, 1, 15)
    rows = {r["id"]: (r["news_count"], r["news_sequence"]) for r in got.select("id", "news_count", F.flatten("news_sequence").alias("news_sequence")).collect()}
    assert rows == {1: (0, [0.0, 0.0]), 2: (2, [2.0, 3.0]), 3: (2, [2.0, 3.0]), 4: (0, [0.0, 0.0]), 5: (0, [0.0, 0.0])}
    assert not any("array" in t for t in widths[0])
