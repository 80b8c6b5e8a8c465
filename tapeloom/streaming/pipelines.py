"""Streaming jobs without custom state: routing, deduplication, windows, joins, alarms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators.resample import PRIME, row_number_of
from tapeloom.sources.readers import parse_json_lines
from tapeloom.streaming.runner import Versions, new_folder, run_batches


def route_json(lines: DataFrame, schema: T.StructType, version: int) -> tuple[DataFrame, DataFrame]:
    """Validate JSON lines of a stream; returns the accepted and rejected tables.

    Each micro-batch is parsed once, kept, and written to one folder per batch and side, so a
    repeated batch replaces its own output.
    """
    spark = lines.sparkSession
    path = new_folder(spark, "routed")

    def handle(batch: DataFrame, n: int) -> None:
        parsed = parse_json_lines(batch, schema, version).persist()
        parsed.filter("reason IS NULL").select("row.*").write.mode("overwrite").parquet(f"{path}/accepted/batch={n}")
        parsed.filter("reason IS NOT NULL").select("value", "reason").write.mode("overwrite").parquet(f"{path}/rejected/batch={n}")
        parsed.unpersist()

    run_batches(lines, handle, "routed")
    accepted = spark.read.schema(schema).parquet(f"{path}/accepted").select(*schema.names)
    return accepted, spark.read.schema("value string, reason string").parquet(f"{path}/rejected").select("value", "reason")


def deduplicated(stream: DataFrame, key: Sequence[str], time: str, delay: str) -> DataFrame:
    """First occurrence of each key within the watermark delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def window_metrics(stream: DataFrame, keys: Sequence[str], time: str, value: str, size: str, slide: str | None, delay: str) -> DataFrame:
    """Count, mean and range of a metric per tumbling or sliding window."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    rows = stream.withWatermark(time, delay).groupBy(w, *keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    return rows.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "low", "high")


def activity_sessions(stream: DataFrame, keys: Sequence[str], time: str, gap: str, delay: str) -> DataFrame:
    rows = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def predictions_with_truth(preds: DataFrame, truth: DataFrame, keys: Sequence[str], pred_time: str, true_time: str, within: int, delay: str) -> DataFrame:
    """Predictions joined to outcomes of the same keys up to ``within`` seconds later.

    The join key carries the time bucket, so that rows of a busy key meet only neighbours in
    time; an outcome lies in the bucket of its prediction or the next one.
    """
    def bucket(time):
        return F.floor(F.unix_seconds(time) / within)

    left = preds.withWatermark(pred_time, delay).withColumn("_pb", F.explode(F.array(bucket(pred_time), bucket(pred_time) + 1)))
    right = truth.withWatermark(true_time, delay).withColumnsRenamed({k: f"_{k}" for k in keys}).withColumn("_tb", bucket(true_time))
    cond = F.expr(f"{true_time} >= {pred_time} AND {true_time} <= {pred_time} + INTERVAL {within} SECONDS AND _pb = _tb")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    return left.join(right, cond).drop("_pb", "_tb", *[f"_{k}" for k in keys])


def strategy_totals(stream: DataFrame, strategy: str, metric: str) -> DataFrame:
    """Running count, mean and last extremes per strategy; returns the final table."""
    spark = stream.sparkSession
    agg = stream.groupBy(strategy).agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean"), F.max(metric).alias("high"))
    store = Versions(spark, new_folder(spark, "totals"), agg.schema)
    run_batches(agg, store.write, "totals", mode="complete")  # one row per strategy
    return store.read()


def metric_alarms(stream: DataFrame, keys: Sequence[str], order: Sequence[str], metric: str, threshold: float, alpha: float = 0.3) -> DataFrame:
    """After each micro-batch, the newest value of each key against its weighted mean, as ``batch_no``.

    What is kept between batches is one row of weighted sums per key, which all rows so far are part of.
    """
    from tapeloom.operators.windows import ewm_sums, ewm_verdict, join_ewm_sums

    spark = stream.sparkSession
    cols = [*keys, *order, metric]
    fields = "last_value double, rows long, w double, w2 double, ewm_mean double, ss double"
    schema = T.StructType([*[stream.schema[k] for k in keys], *T.StructType.fromDDL(fields)])
    history = Versions(spark, new_folder(spark, "history"), schema)
    out = new_folder(spark, "alarms")

    def handle(batch: DataFrame, n: int) -> None:
        rows = batch.select(*cols).withColumn(metric, F.col(metric).cast("double"))
        newer = ewm_sums(rows, keys, order, metric, alpha)
        history.write(join_ewm_sums(history.read(before=n), newer, keys, alpha).select(*schema.names), n)
        seen = ewm_verdict(history.read(), keys, threshold)
        seen.withColumn("batch_no", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    run_batches(stream, handle, "alarms")
    return spark.read.parquet(out).drop("batch")


def sgd_updates(stream: DataFrame, features: Sequence[str], label: str, rate: float = 0.1) -> DataFrame:
    """Logistic weights after each micro-batch of one gradient step; versions are kept.

    The gradient is one aggregation over the batch.  Features not seen before start at 0.
    """
    from tapeloom.functions.scoring import sigmoid, total

    spark = stream.sparkSession
    store = Versions(spark, new_folder(spark, "weights"), T.StructType.fromDDL("feature string, weight double"))
    names = [*features, "intercept"]

    def handle(batch: DataFrame, n: int) -> None:
        now = {r["feature"]: r["weight"] for r in store.read(before=n).collect()}  # one row per feature
        xs = {**{f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}, "intercept": F.lit(1.0)}
        miss = sigmoid(total([xs[f] * float(now.get(f, 0.0)) for f in names])) - F.col(label)
        grad = batch.agg(*[F.coalesce(F.avg(miss * xs[f]), F.lit(0.0)).alias(f) for f in names]).first()
        store.write(spark.createDataFrame([(f, float(now.get(f, 0.0) - rate * grad[f])) for f in names], store.schema), n)

    run_batches(stream, handle, "weights")
    return store.read()


def replay_weight(score: str, label: str) -> Column:
    """How much a scored row has to teach: its log loss plus the distance of its score from its label."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(score).cast("double")))
    hit = F.col(label) == 1
    return -F.ln(F.when(hit, p).otherwise(1 - p)) + F.abs(F.col(score) - F.col(label))


def replay_sample(stream: DataFrame, order: Sequence[str], weight: str, capacity: int, k: int, seed: int = 0) -> DataFrame:
    """Keep the newest ``capacity`` rows of a stream and draw ``k`` by weight at the end.

    ``capacity`` is the feature: a bounded memory where the oldest rows leave first.
    """
    from tapeloom.sources.writers import last_rows

    spark = stream.sparkSession
    store = Versions(spark, new_folder(spark, "replay"), stream.schema)

    def handle(batch: DataFrame, n: int) -> None:
        store.write(last_rows(store.read(before=n).unionByName(batch), list(order), capacity), n)

    run_batches(stream, handle, "replay")
    return weighted_sample(store.read(), order, weight, k, seed)


def weighted_sample(df: DataFrame, row_id: Sequence[str], weight: str, k: int, seed: int = 0, floor: float = 1e-6) -> DataFrame:
    """``k`` rows without replacement with probability by weight (exponential-key method).

    A row's uniform number comes from the MD5 of seed and id, so a recomputed task draws the same."""
    u = (row_number_of(F.concat_ws(":", F.lit(seed), *row_id)) + 0.5) / float(PRIME)
    key = -F.ln(u) / F.greatest(F.col(weight).cast("double"), F.lit(floor))
    return df.withColumn("_key", key).orderBy("_key", *row_id).limit(k).drop("_key")


def running_calibration(stream: DataFrame, order: Sequence[str], score: str, label: str, window: int = 1000) -> DataFrame:
    """Per batch: Platt fit of the newest scores and their 5 % / 95 % bounds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from tapeloom.sources.writers import last_rows

    spark = stream.sparkSession
    cols = [*order, score, label]
    recent = Versions(spark, new_folder(spark, "recent"), stream.select(*cols).schema)
    done = Versions(spark, new_folder(spark, "calibration"), T.StructType.fromDDL(
        "batch_no long, n long, conformal_lower double, conformal_upper double, coef double, intercept double"))

    def handle(batch: DataFrame, n: int) -> None:
        recent.write(last_rows(recent.read(before=n).unionByName(batch.select(*cols)), list(order), window), n)
        rows = recent.read()  # at most ``window`` rows
        b = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("classes"),
                     F.percentile(score, F.lit(0.05)).alias("lo"), F.percentile(score, F.lit(0.95)).alias("hi")).first()
        coef, icpt = None, None
        if b["classes"] > 1:
            pairs = rows.select(F.col(score).alias("_score"), F.col(label).alias("_label"))
            fit = LogisticRegression(labelCol="_label").fit(VectorAssembler(inputCols=["_score"], outputCol="features").transform(pairs))
            coef, icpt = float(fit.coefficients[0]), float(fit.intercept)
        row = spark.createDataFrame([(n, b["n"], b["lo"], b["hi"], coef, icpt)], done.schema)
        done.write(done.read(before=n).unionByName(row), n)

    run_batches(stream, handle, "calibration")
    return done.read()
