"""Quality rules from line frequencies across documents, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import words
from tapeloom.session import pin

SYMBOLS = "#*$%&|<>"
WINDOW = 3


@dataclass(frozen=True)
class Limits:
    """A line is boilerplate of its host if over ``min_docs`` different documents and over ``share`` of
    the host's different documents have it.  A document is depleted if boilerplate leaves it less
    than ``left`` of its lines' characters.  Documents of under ``min_words`` words, or with over ``repeat_pct``
    per cent of their words in repeated windows, fail the base rule."""

    min_docs: int = 20
    share: float = 0.05
    left: float = 0.2
    min_words: int = 50
    repeat_pct: int = 50


# Up to so many repeated windows are looked up one by one, more are found by sorting pairs.
FEW = 48


def _repeated_hashes(ordered: Column) -> Column:
    """Of a sorted array column, the values that occur twice or more."""
    return F.array_distinct(F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i - 1) == x, F.lit(False))))


def _starts_by_sort(pairs: Column) -> Column:
    """Of (hash, start) pairs sorted already, the starts of windows that occur again, in order."""

    def again(x: Column, i: Column) -> Column:
        before, after = F.get(pairs, i - 1)["h"], F.get(pairs, i + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    return F.sort_array(F.transform(F.filter(pairs, again), lambda x: x["i"]))


def _starts_by_lookup(windows: Column, repeated: Column) -> Column:
    at = F.transform(windows, lambda h, i: F.when(F.array_contains(repeated, h), i))
    return F.filter(at, lambda i: i.isNotNull())


def _span(starts: Column) -> Column:
    """Words that windows with these starts cover: each up to three, less what the next one covers."""
    steps = F.transform(starts, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda x, y: x + y)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) for whole texts, and
    ``lines``, the array of lines with a word.

    ``word_chars`` counts the code points of words, ``n_symbols`` the characters of SYMBOLS,
    ``n_dup_lines`` the lines with a word that equal an earlier line, ``n_repeat_words`` the words in
    3-word windows found twice or more, first ones included.  A null or empty text has zeros."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.withColumns({"_words": words(F.col(text)), "lines": lines})
    out = out.withColumns({"_hashes": F.transform("_words", lambda w: F.xxhash64(w)), "_n": F.size("_words")})
    starts = F.sequence(F.lit(0), F.col("_n") - WINDOW)
    window = F.transform(starts, lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)]))
    out = out.withColumn("_windows", F.when(F.col("_n") >= WINDOW, window))
    different = F.size(F.array_distinct("_windows"))
    # Arrays that a lambda looks into are columns of their own, else they are made anew for each element.
    out = out.withColumn("_sorted", F.when(different < F.col("_n") - WINDOW + 1, F.sort_array("_windows")))
    out = out.withColumn("_repeated", _repeated_hashes(F.col("_sorted")))
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_pairs", F.when(F.size("_repeated") > FEW, pairs))
    by_sort, by_lookup = _starts_by_sort(F.col("_pairs")), _starts_by_lookup(F.col("_windows"), F.col("_repeated"))
    out = out.withColumn("_starts", F.when(F.col("_pairs").isNotNull(), by_sort).when(F.col("_repeated").isNotNull(), by_lookup))
    return out.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit("[" + SYMBOLS + "]")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": F.coalesce(_span(F.col("_starts")), F.lit(0)).cast("long"),
        }
    ).drop("_words", "_hashes", "_n", "_windows", "_sorted", "_repeated", "_pairs", "_starts")


def base_failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_pct * F.col("n_words"))


def normal_line(line: Column) -> Column:
    """Lower case, no white space at the ends."""
    return F.trim(F.lower(line), F.lit(" \t\n\x0b\f\r"))


def judge(docs: DataFrame, limits: Limits = Limits(), host: str = "source", text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: ``doc`` (a struct of the ``carry`` columns), the text statistics,
    ``base_failed``, ``removed`` (hashes of the lines to remove), ``line_chars``, ``left_chars`` and ``kept``.

    ``kept`` is false if the base rule fails or the document is depleted.  Documents with equal texts
    count once, so copies don't turn their own text into boilerplate.  Null and empty texts have no words
    and fail.  A null host is a host of its own; null and repeated keys are judged row by row.  Columns
    that clash with a result are safe inside ``doc``, others are ignored.  No rows give no rows.

    Hashes of lines, not texts, are shuffled: one row per different line of a different document,
    counted before the shuffle.  A line that every document has is one row per task; looking lines up
    again is a plain join, whose large partitions adaptive execution splits.
    """
    lean = docs.select(F.struct(*carry).alias("doc"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(text, F.lit("")).alias("text"))
    stats = text_statistics(lean).withColumns({"row": F.monotonically_increasing_id(), "copy": F.xxhash64("host", "text")})
    normal = F.transform(F.transform("lines", normal_line), lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n")))
    found = pin(stats.withColumn("lines", normal).drop("text"))
    # Rows of one copy have the same lines: a line counts once for each copy.
    held = F.array_distinct(F.transform("lines", lambda x: x["h"]))
    seen = found.select("host", "copy", F.explode(held).alias("h")).distinct()
    sizes = found.select("host", "copy").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    counts = seen.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limits.min_docs)
    frequent = counts.join(sizes, "host").where(F.col("n") > limits.share * F.col("docs")).select("host", "h")
    lines = found.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.n")
    lost = lines.join(frequent, ["host", "h"]).groupBy("row").agg(F.sum("n").alias("lost"), F.collect_set("h").alias("removed"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda x, y: x + y["n"])
    judged = found.withColumn("line_chars", total).drop("lines", "copy", "host").join(lost, "row", "left")
    judged = judged.withColumn("left_chars", F.col("line_chars") - F.coalesce("lost", F.lit(0)))
    judged = judged.withColumn("base_failed", base_failed(limits))
    kept = ~F.col("base_failed") & (F.col("left_chars") >= limits.left * F.col("line_chars"))
    removed = F.coalesce("removed", F.array().cast("array<bigint>"))
    return judged.withColumn("removed", removed).withColumn("kept", kept).drop("row", "lost")


def remove_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose normalised hash is in ``removed``."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(removed, F.xxhash64(normal_line(x))))
    return F.when(F.size(removed) == 0, text).otherwise(F.array_join(kept, "\n"))
