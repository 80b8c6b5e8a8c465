"""Corpus pipeline: documents to batches in five stages, each one operator of ``tapeloom.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's ``docs``.  All but the last return the columns of ``docs`` as they came, whatever they are
called; texts change where a stage says so, and ``n_chars`` with them.  Repeated rows and null keys are
rows like any other; an empty table passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import classifier, packing, quality, secrets, simhash
from tapeloom.llm.common import table
from tapeloom.llm.queries import ACCEPT, quality_model, tokenizer
from tapeloom.session import shared_folder


def _whole(docs: DataFrame) -> DataFrame:
    """All columns as the struct ``doc``, so that no result clashes with them, and the text."""
    return docs.select(F.struct(*docs.columns).alias("doc"), F.col("text"))


def _with_text(docs: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns of ``doc`` with another text and, if it is there, its new length."""
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return docs.select(*[changed[c].alias(c) if c in changed else F.col(f"doc.`{c}`") for c in columns])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier scores below ACCEPT."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return classifier.scored(_whole(docs), model).where(F.col("score") >= ACCEPT).select("doc.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or are depleted; remove boilerplate lines from the others."""
    judged = quality.judge(docs, carry=docs.columns).where("kept")
    return _with_text(judged, docs.columns, quality.remove_lines(F.col("doc.text"), F.col("removed")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, five words and a similarity of 0.8 or more.

    Documents are named by a hash of key and text, so that repeated rows are copies as well and rows that
    share no more than a key are not."""
    named = docs.withColumn("_name", F.xxhash64("doc_id", "text"))
    groups = simhash.near_duplicates(named, simhash.SIMILAR, key="_name")
    kept = groups.select(F.col("component_id").alias("_name")).distinct()
    return named.join(kept, "_name", "left_semi").dropDuplicates(["_name"]).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets, encoded ones included; every document stays."""
    found = secrets.scan_documents(_whole(docs))
    return _with_text(found, docs.columns, secrets.redacted(F.col("text"), F.col("secrets")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every document its bucket, batch and place by its number of tokens."""
    return packing.pack(docs, tokenizer(spark).count(F.col("text")))


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("simhash_near_dedup", near_duplicates), ("secret_scan", redact), ("packing", pack)]
# Fits, hashes and decoders have no SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what is between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
