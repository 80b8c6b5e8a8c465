"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.session import pin


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest one of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    turned = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return turned.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every linked node with the smallest node it can reach.

    ``edges`` holds links in either direction between nodes of an orderable type; repeated links and
    self links do no harm, rows with a null end are no links.  Returns ``node, label`` for every node
    that some other node links to but the smallest of its component; nodes that do not appear are
    their own label.  No links give no rows.  Each round is a fixed number of shuffles over the links
    and is written to the shared folder, so that lineage stays short; the number of rounds grows with
    the logarithm of the longest chain.
    """
    now = pin(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )
    state = F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))
    before, after = None, tuple(now.agg(*state).first())
    while after != before and after[0]:
        now = pin(_small_star(_large_star(now)))
        before, after = after, tuple(now.agg(*state).first())
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
