"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tapeloom.operators.ordered import value_ranks
from tapeloom.session import pin

ORDER = 4
SPACE = 32
# Characters of one numpy pass, and keys gathered before they are counted.
PASS_CHARS, GATHER = 1 << 19, 1 << 20
# Slots of the hash array of one order and language: bounds a model to 2**SLOT_BITS * 8 bytes for each.
SLOT_BITS = 21
# The share of training texts that the rejection accepts.
ACCEPT = 0.995
# How fast a language's share falls with its entropy per symbol.
SHARPNESS = 20.0
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Code point to symbol: letters up to U+FFFF are themselves, later ones share the private use area,
    everything else is a space."""
    table = np.full(0x110000, SPACE, dtype=np.uint64)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = c if c < 0x10000 else 0xE000 + c % 0x1900
    return table


def symbols(text: str | None) -> np.ndarray:
    """Lower-cased letters with one space between runs of them; empty if there is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    mapped = _letters()[points]
    blank = mapped == SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    mapped = mapped[keep]
    if not len(mapped) or (mapped == SPACE).all():
        return mapped[:0]
    return mapped[int(mapped[0] == SPACE) :]


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Packed 4-grams (16 bits a symbol), one per symbol, over whole texts in passes of bounded size; a text
    starts after three spaces."""
    found = symbols(text)
    padded = np.concatenate([np.full(ORDER - 1, SPACE, dtype=np.uint64), found])
    for start in range(0, len(found), PASS_CHARS):
        part = padded[start : start + PASS_CHARS + ORDER - 1]
        n = len(part) - ORDER + 1
        out = np.zeros(n, dtype=np.uint64)
        for k in range(ORDER):
            out = out << np.uint64(16) | part[k : k + n]
        yield out


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of 4-grams by language, merged over a bounded number of keys at a time."""
    held: dict[str, list[np.ndarray]] = {}

    def counted(lang: str) -> pd.DataFrame:
        keys, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
        return pd.DataFrame({"lang": lang, "key": keys.view(np.int64), "n": n})

    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            for part in grams(text):
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part)
                if sizes[lang] >= GATHER:
                    sizes[lang] = 0
                    yield counted(lang)
    for lang in list(held):
        yield counted(lang)


def gram_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, key, n`` over all rows with a language."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    parts = rows.mapInPandas(_count_grams, "lang string, key long, n long")
    return parts.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """``lang, size, key, log_p, log_back``: for every gram of one to four symbols the interpolated log
    probability of its last symbol, and for every context the log weight of the next shorter one.

    The longest grams count occurrences, shorter ones the different symbols before them.  Discounts are
    n1 / (n1 + 2 n2) from the grams seen once and twice, by language and length.  ``counts``
    is read several times: a stored table."""
    levels = {ORDER: counts}
    for size in range(ORDER - 1, 0, -1):
        mask = F.lit((1 << 16 * size) - 1)
        levels[size] = pin(levels[size + 1].groupBy("lang", F.col("key").bitwiseAND(mask).alias("key")).agg(F.count(F.lit(1)).alias("n")))
    symbols_of = levels[1].groupBy("lang").agg(F.count(F.lit(1)).alias("alphabet"))
    lower, made = None, []
    for size in range(1, ORDER + 1):
        level = levels[size]
        one, two = (F.sum((F.col("n") == i).cast("long")) for i in (1, 2))
        discount = F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.try_divide(one, one + 2 * two)))
        context = F.shiftrightunsigned("key", 16) if size > 1 else F.lit(0).cast("long")
        rows = level.withColumn("context", context).join(level.groupBy("lang").agg(F.coalesce(discount, F.lit(0.5)).alias("d")), "lang")
        totals = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum(F.least("d", "n")) / F.sum("n")).alias("back"))
        rows = rows.join(totals, ["lang", "context"])
        if size == 1:
            # One more symbol stands for all that were never seen.
            base = rows.join(symbols_of, "lang").withColumn("p0", 1 / (F.col("alphabet") + 1))
        else:
            tail = F.col("key").bitwiseAND(F.lit((1 << 16 * (size - 1)) - 1))
            base = rows.withColumn("tail", tail).join(lower.select("lang", F.col("key").alias("tail"), F.col("p").alias("p0")), ["lang", "tail"])
        p = F.greatest(F.lit(0.0), F.col("n") - F.col("d")) / F.col("total") + F.col("back") * F.col("p0")
        lower = pin(base.select("lang", "key", p.alias("p")))
        made.append(lower.select("lang", F.lit(size).alias("size"), "key", F.log("p").alias("log_p"), F.lit(None).cast("double").alias("log_back")))
        backs = totals.select("lang", F.lit(size - 1).alias("size"), F.col("context").alias("key"), F.lit(None).cast("double").alias("log_p"), F.log("back").alias("log_back"))
        made.append(backs)
    unseen = symbols_of.select("lang", F.lit(0).alias("size"), F.lit(0).cast("long").alias("key"), F.log(1 / (F.col("alphabet") + 1)).alias("log_p"), F.lit(None).cast("double").alias("log_back"))
    made.append(unseen)
    whole = made[0]
    for part in made[1:]:
        whole = whole.unionByName(part)
    return whole


_P1, _P2, _P3, _P4, _P5 = map(
    np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def slots_of(keys: np.ndarray) -> np.ndarray:
    """Slot numbers as :func:`slot` has them: the top bits of Spark's xxhash64 of a long."""
    h = np.uint64(42) + _P5 + np.uint64(8) ^ _turned(keys.astype(np.uint64) * _P2, 31) * _P1
    h = _turned(h, 27) * _P1 + _P4
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return ((h ^ h >> np.uint64(32)) >> np.uint64(64 - SLOT_BITS)).astype(np.uint32)


def slot(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - SLOT_BITS)


def folded(table: DataFrame) -> DataFrame:
    """At most one row per language, size and slot; keys that share a slot share the larger values."""
    return table.groupBy("lang", F.col("size").cast("byte").alias("size"), slot(F.col("key")).cast("int").alias("slot")).agg(
        F.max("log_p").cast("float").alias("log_p"), F.max("log_back").cast("float").alias("log_back")
    )


class HashArray:
    """Values by slot number, slots sorted; lookups are binary searches."""

    def __init__(self, slots: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(slots, kind="stable")
        self.slots, self.values = slots[order], values[order]

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        if not len(self.slots):
            return np.full(len(keys), default, dtype=np.float32)
        slots = slots_of(keys)
        at = np.minimum(np.searchsorted(self.slots, slots), len(self.slots) - 1)
        return np.where(self.slots[at] == slots, self.values[at], np.float32(default))


class LanguageModels:
    """Sorted hash arrays of log probabilities and back-off weights, by language and gram size."""

    def __init__(self, languages: list[str], rows: pa.Table) -> None:
        """``rows`` as :func:`folded` makes them, with the language's place in ``languages``."""
        self.languages = languages
        self.p, self.back, self.unseen = {}, {}, {}
        place, sizes, slots = (rows[name].to_numpy() for name in ("place", "size", "slot"))
        for name, into in (("log_p", self.p), ("log_back", self.back)):
            values = rows[name].to_numpy()  # nulls are NaN
            for i, lang in enumerate(languages):
                for size in range(ORDER + 1):
                    has = (place == i) & (sizes == size) & ~np.isnan(values)
                    into[lang, size] = HashArray(slots[has].astype(np.uint32), values[has])
        for lang in languages:
            self.unseen[lang] = float(self.p[lang, 0].values[0])

    def log_p(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each 4-gram: that of the longest gram known, less the
        weights of the contexts given up on the way."""
        none = HashArray(np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.float32))
        known = np.full(len(keys), self.unseen[lang], dtype=np.float32)
        for size in range(1, ORDER + 1):
            part = keys & np.uint64((1 << 16 * size) - 1) if size < ORDER else keys
            context = part >> np.uint64(16) if size > 1 else np.zeros_like(part)
            shorter = known + self.back.get((lang, size - 1), none).get(context, 0.0)
            found = self.p.get((lang, size), none).get(part, np.inf)
            known = np.where(np.isinf(found), shorter, found)
        return known

    def cross_entropies(self, texts: list[str | None]) -> np.ndarray:
        """Nats per symbol, texts by languages; NaN for a text without a letter.  Texts are taken together up
        to a bounded number of symbols, and every different gram is looked up once."""
        totals = np.zeros((len(texts), len(self.languages)))
        lengths = np.zeros(len(texts))
        held: list[np.ndarray] = []
        owner: list[int] = []

        def settle() -> None:
            if not held:
                return
            sizes = [len(h) for h in held]
            keys, inverse = np.unique(np.concatenate(held), return_inverse=True)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            np.add.at(lengths, owner, sizes)
            for j, lang in enumerate(self.languages):
                np.add.at(totals[:, j], owner, np.add.reduceat(self.log_p(lang, keys)[inverse].astype(np.float64), starts))
            held.clear()
            owner.clear()

        size = 0
        for i, text in enumerate(texts):
            for part in grams(text):
                held.append(part)
                owner.append(i)
                size += len(part)
                if size >= PASS_CHARS:
                    settle()
                    size = 0
        settle()
        with np.errstate(invalid="ignore"):
            return -totals / np.where(lengths > 0, lengths, np.nan)[:, None]


def upper_limits(told: DataFrame, share: float = ACCEPT) -> DataFrame:
    """``lang, limit``: the lowest entropy that at least ``share`` of a language's rows do not exceed."""
    ranks = value_ranks(told, ["lang"], "entropy")
    totals = ranks.groupBy("lang").agg(F.max("upto").alias("rows"))  # one row per language
    return ranks.join(F.broadcast(totals), "lang").where(F.col("upto") >= F.ceil(F.col("rows") * share)).groupBy("lang").agg(F.min("value").alias("limit"))


class LanguageIdentifier:
    """Models and the entropy above which each language is rejected, as measured on training texts."""

    def __init__(self, models: LanguageModels, limits: dict[str, float]) -> None:
        self.models, self.limits = models, limits

    @classmethod
    def fit(cls, docs: DataFrame, lang: str = "lang", text: str = "text") -> LanguageIdentifier:
        """Learn from all rows with a language.  Spark counts and weighs the grams; what reaches the driver,
        and the executors from there, is at most one number pair per slot, gram size and language.  The
        limits are exact quantiles over all texts that the models tell right."""
        known = docs.where(F.col(lang).isNotNull())
        counts = pin(gram_counts(docs, lang, text))
        languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
        place = F.array_position(F.array(*map(F.lit, languages)).cast("array<string>"), F.col("lang")) - 1
        rows = folded(kneser_ney(counts)).select(place.cast("short").alias("place"), "size", "slot", "log_p", "log_back")
        models = LanguageModels(languages, rows.toArrow())
        learned = cls(models, {})
        if not languages:
            return learned
        own = known.withColumn("_told", learned.predict(F.col(text))).where(F.col("_told.best") == F.col(lang))
        # One row per language.
        cut = upper_limits(own.select(F.col(lang).alias("lang"), F.col("_told.entropy").alias("entropy")))
        return cls(models, {r["lang"]: r["limit"] for r in cut.collect()})

    def predict(self, text: Column) -> Column:
        """Struct of ``best`` (null without a letter), its ``entropy`` and ``score``."""
        sent = SparkSession.active().sparkContext.broadcast(self.models)

        @pandas_udf("best string, entropy double, score double")
        def told(texts: pd.Series) -> pd.DataFrame:
            models = sent.value
            if not models.languages:
                return pd.DataFrame({"best": [None] * len(texts), "entropy": np.nan, "score": 0.0})
            entropies = models.cross_entropies(texts.tolist())
            none = np.isnan(entropies[:, 0])
            filled = np.where(none[:, None], 0.0, entropies)
            best = filled.argmin(axis=1)
            low = filled.min(axis=1)
            score = 1 / np.exp(-SHARPNESS * (filled - low[:, None])).sum(axis=1)
            names = np.array(models.languages, dtype=object)[best]
            return pd.DataFrame({"best": np.where(none, None, names), "entropy": np.where(none, np.nan, low), "score": np.where(none, 0.0, score)})

        return told(text)


def identify(docs: DataFrame, model: LanguageIdentifier, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``, one row per row.

    ``lang_pred`` is the learned language of the lowest cross-entropy per symbol over the whole text, ties
    to the first by name; ``und`` if the text is null or has no letter, or nothing was learned.  ``score``
    is the share of that language among all, weighted by their entropies; 0 for ``und``.  ``rejected``
    tells that the entropy is above what nearly all training texts of the language have, or that there is
    no language.  Columns named like a result are replaced, others stay; no rows give no rows.
    """
    limits = F.create_map(*[F.lit(x) for pair in model.limits.items() for x in pair]) if model.limits else None
    out = docs.withColumn("_told", model.predict(F.col(text)))
    limit = F.try_element_at(limits, F.col("_told.best")) if limits is not None else F.lit(None).cast("double")
    out = out.withColumns(
        {
            "lang_pred": F.coalesce(F.col("_told.best"), F.lit(UNKNOWN)),
            "score": F.coalesce(F.col("_told.score"), F.lit(0.0)),
            "rejected": F.col("_told.best").isNull() | F.coalesce(F.col("_told.entropy") > limit, F.lit(False)),
        }
    )
    return out.drop("_told")
