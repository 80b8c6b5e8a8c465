"""Symbol-graph analytics: edge weights, regressions, degree, PageRank, embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.ordered import over_rows, row_index
from tapeloom.operators.windows import _frame_corr
from tapeloom.session import pin


def _c(name: str) -> Column:
    return F.col(name)


def correlation_edges(pairs: DataFrame, time: str, window: int) -> DataFrame:
    """Mean absolute rolling correlation per (a, b) over full windows, both directions."""

    def build(rows, lay):
        frame = lay.rows(1 - window, 0)
        rows = rows.withColumn("_n", F.count(_c("x") + _c("y")).over(frame))
        return rows.withColumn("rho", F.when(_c("_n") >= window, _frame_corr("x", "y", frame)))

    rolled = over_rows(pairs, ["a", "b"], [time], build, before=window)
    w = rolled.groupBy("a", "b").agg(F.avg(F.abs("rho")).alias("weight")).filter("weight IS NOT NULL")
    return w.select(_c("a").alias("src"), _c("b").alias("dst"), "weight").unionByName(
        w.select(_c("b").alias("src"), _c("a").alias("dst"), "weight")
    )


def pair_regression(pairs: DataFrame) -> DataFrame:
    """Slope of x on y and of y on x over common times, with at least three of them."""
    both = _c("x").isNotNull() & _c("y").isNotNull()
    return pairs.filter(both).groupBy("a", "b").agg(
        F.regr_slope("x", "y").alias("beta"), F.regr_slope("y", "x").alias("beta_rev"), F.count(F.lit(1)).alias("n")
    ).filter("n >= 3")


def pair_residual(pairs: DataFrame, betas: DataFrame) -> DataFrame:
    return pairs.join(betas.select("a", "b", "beta"), ["a", "b"]).withColumn("residual", _c("x") - _c("beta") * _c("y"))


def weighted_degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    d = edges.groupBy(_c("src").alias("id")).agg(F.sum("weight").alias("degree"))
    return vertices.join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))


def pagerank(vertices: DataFrame, edges: DataFrame, alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 100) -> DataFrame:
    """Weighted PageRank; rank of vertices without outgoing weight is not passed on.

    Each step is one join and one partially aggregated groupBy, and its ranks are stored next
    to the previous ones: the plan stays one step long and a lost executor restarts from
    stored rows.
    """
    n = vertices.count()
    out = edges.groupBy("src").agg(F.sum("weight").alias("_out"))
    if not n:
        return vertices.select("id").withColumn("rank", F.lit(0.0))
    links = pin(edges.join(out, "src").filter("_out > 0").select("src", "dst", (_c("weight") / _c("_out")).alias("share")))
    ranks = pin(vertices.select("id").distinct().withColumn("rank", F.lit(1.0 / n)))
    for _ in range(max_iter):
        got = links.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(_c("dst").alias("id")).agg(
            F.sum(_c("share") * _c("rank")).alias("_in")
        )
        new = F.lit((1 - alpha) / n) + alpha * F.coalesce("_in", F.lit(0.0))
        step = pin(ranks.join(got, "id", "left").select("id", _c("rank").alias("_old"), new.alias("rank")))
        moved = step.agg(F.sum(F.abs(_c("rank") - _c("_old")))).first()[0]
        ranks = step.select("id", "rank")
        if moved < tol:
            break
    return ranks


def spectral_embedding(edges: DataFrame, vertices: DataFrame, dim: int = 8) -> DataFrame:
    """Left singular vectors of the adjacency scaled by singular values, per vertex.

    Rows of the adjacency are distributed; MLlib takes the small Gram matrix to the driver, or iterates
    on vectors of one number per vertex when there are many.
    """
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    spark = edges.sparkSession
    index = pin(row_index(vertices.select("id").distinct(), [], ["id"], "i"))
    n = index.count()
    cells = edges.join(index.select(_c("id").alias("src"), _c("i").alias("si")), "src").join(
        index.select(_c("id").alias("dst"), _c("i").alias("di")), "dst"
    ).groupBy("si", "di").agg(F.max("weight").alias("w"))
    packed = pin(cells.groupBy("si").agg(F.collect_list(F.struct("di", "w")).alias("row")))
    rows = packed.rdd.map(lambda r: IndexedRow(r["si"], Vectors.sparse(n, sorted((e["di"], e["w"]) for e in r["row"]))))
    svd = IndexedRowMatrix(rows, n, n).computeSVD(min(dim, n), computeU=True)
    scale = [float(x) for x in svd.s]
    out = svd.U.rows.map(lambda r: (int(r.index), [float(v) * s for v, s in zip(r.vector.toArray(), scale)]))
    emb = spark.createDataFrame(out, "i long, embedding array<double>")
    return emb.join(index, "i").select("id", "embedding")


def pair_sums(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[float]]:
    """Sums over the rows where both columns of a pair have a value, for all pairs: ``i, j, n, si, sj, sij,
    siijj`` of deviations from the column means, which are returned too.

    A task adds up matrices over its rows and returns one row per pair, so the plan has one expression
    per column and rows are not multiplied.
    """
    cols = [_c(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    rows = df.select(*cols)
    names = rows.columns
    mean = [float(m) if m is not None else 0.0 for m in rows.agg(*[F.avg(F.nanvl(c, F.lit(None).cast("double"))) for c in names]).first()]

    def add(batches):
        import numpy as np
        import pandas as pd

        p = len(names)
        out = np.zeros((5, p, p))
        for batch in batches:
            x = batch[names].to_numpy(dtype=float) - np.array(mean)
            has = ~np.isnan(x)
            x, has = np.where(has, x, 0.0), has.astype(float)
            squares = x * x
            out += np.array([has.T @ has, x.T @ has, has.T @ x, x.T @ x, squares.T @ squares])
        i, j = np.indices((p, p)).reshape(2, -1)
        yield pd.DataFrame({"i": i, "j": j, **dict(zip(("n", "si", "sj", "sij", "siijj"), out.reshape(5, -1)))})

    parts = rows.mapInPandas(add, "i int, j int, n double, si double, sj double, sij double, siijj double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij", "siijj")]), mean


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long matrix (a, b, covariance, correlation) of the listed columns; a pair counts rows with both."""
    sums, _ = pair_sums(df, columns)
    cov = F.when(_c("n") > 1, (_c("sij") - _c("si") * _c("sj") / _c("n")) / (_c("n") - 1))
    cells = sums.select("i", "j", cov.alias("covariance"))
    spread = cells.filter("i = j").select(_c("i").alias("k"), _c("covariance").alias("v"))  # one row per column
    cells = cells.join(F.broadcast(spread.selectExpr("k AS i", "v AS vi")), "i").join(F.broadcast(spread.selectExpr("k AS j", "v AS vj")), "j")
    base = F.sqrt(_c("vi") * _c("vj"))
    name = F.array(*[F.lit(c) for c in columns])
    rho = F.when(base > 0, F.try_divide("covariance", base))
    return cells.select(F.get(name, _c("i")).alias("a"), F.get(name, _c("j")).alias("b"), "covariance", rho.alias("correlation"))


def average_volume(df: DataFrame, symbol: str, volume: str) -> DataFrame:
    return df.groupBy(symbol).agg(F.avg(volume).alias("avg_volume"))
