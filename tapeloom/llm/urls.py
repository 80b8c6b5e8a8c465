"""URL filters by a Bloom filter cascade, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.session import pin

BITS_PER_KEY = 12
HASHES = 6
# Bound of one level; a fuller filter lets more keys through to the next level, and stays exact.
MAX_BYTES = 16 << 20
MAX_LEVELS = 40
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path
    (from there up to ``?``, ``#`` or the end); both empty for a null url or one without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_keys(host: Column, path: Column, most_labels: int, lengths: Sequence[int]) -> Column:
    """All rules that could fit a url: host suffixes of up to ``most_labels`` labels, each followed by the
    path's first characters in every length that some rule has."""
    labels = F.split(host, "\\.")
    size = F.size(labels)
    takes = F.sequence(F.lit(1), F.least(size, F.lit(most_labels)))
    suffixes = F.transform(takes, lambda n: F.array_join(F.slice(labels, size - n + 1, n), "."))
    cuts = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length(path))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(cuts, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))


class Level:
    """One Bloom filter: ``bits`` as bytes, tested by a column expression."""

    def __init__(self, bits: bytes, salt: int) -> None:
        self.bits, self.salt = bits, salt

    @staticmethod
    def positions(key: Column, salt: int, size: int) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(salt), F.lit(j), key), F.lit(size)) for j in range(HASHES)]

    @classmethod
    def build(cls, keys: DataFrame, n: int, salt: int, max_bytes: int = MAX_BYTES) -> Level:
        """``keys`` has the column ``key``; the bytes come back as one row per byte that is not zero,
        at most ``max_bytes`` rows."""
        n_bytes = min(max_bytes, max(8, n * BITS_PER_KEY // 8))
        spots = keys.select(F.explode(F.array(*cls.positions(F.col("key"), salt, 8 * n_bytes))).alias("p"))
        mask = F.expr("shiftleft(1, cast(p % 8 as int))")
        filled = bytearray(n_bytes)
        for row in spots.groupBy(F.expr("p div 8").alias("at")).agg(F.bit_or(mask).alias("byte")).toLocalIterator():
            filled[row["at"]] = row["byte"]
        return cls(bytes(filled), salt)

    def has(self, key: Column) -> Column:
        def is_set(p: Column) -> Column:
            byte = F.conv(F.hex(F.substring(F.lit(self.bits), (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (p % 8 + 1).cast("int"))) != 0

        return reduce(lambda x, y: x & y, map(is_set, self.positions(key, self.salt, 8 * len(self.bits))))


class Cascade:
    """Exact membership of a list among the keys of a corpus.

    Level 1 holds the listed keys, level 2 the keys of the corpus that level 1 wrongly lets through,
    level 3 the listed keys that level 2 wrongly lets through, and so on until a level has no false
    positives.  The first level that lacks a key tells whether it is listed, so a test is a column
    expression without a join.  Exact for every key of the universe it was built over.
    """

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES, salt: int = 0) -> Cascade:
        """Both have the column ``key``; null keys are in neither.  ``universe`` is read once: only keys
        that pass the first level are written and looked at again."""
        listed = pin(listed.select("key").where("key is not null").distinct())
        if not (n := listed.count()):
            return cls([])
        first = Level.build(listed, n, salt + 1, max_bytes)
        passed = universe.select("key").where("key is not null").where(first.has(F.col("key"))).distinct()
        passed = pin(passed.join(listed.withColumn("on_list", F.lit(True)), "key", "left").withColumn("on_list", F.coalesce("on_list", F.lit(False))))
        levels, wrong = [first], passed.where("not on_list")
        while n := wrong.count():
            if len(levels) == MAX_LEVELS:
                raise ValueError(f"{n} keys left after {MAX_LEVELS} levels: raise max_bytes")
            held = len(levels) % 2 == 0  # the next level holds listed keys
            level = Level.build(wrong, n, salt + len(levels) + 1, max_bytes)
            other = passed.where(F.col("on_list") if not held else ~F.col("on_list"))
            for earlier in levels[1:]:
                other = other.where(earlier.has(F.col("key")))
            levels.append(level)
            wrong = other.where(level.has(F.col("key")))
        return cls(levels)

    def has(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(~self.levels[i].has(key), F.lit(i % 2 == 1)).otherwise(answer)
        return answer


def filter_urls(
    pages: DataFrame,
    allow: Sequence[tuple[str, str]],
    block: Sequence[tuple[str, str]],
    blocked_hosts: DataFrame | None = None,
    url: str = "url",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the
    longest fitting rule, as host and path together, decides (of equally long ones the greater string;
    a rule on both lists blocks).  Without a fitting rule the page is blocked if its host or a parent
    domain is among ``blocked_hosts`` (column ``key``, any size), and allowed otherwise.  Membership is
    tested by cascades over all host suffixes and path starts that occur in ``pages``.

    A null url or one without ``://`` has an empty host and path, no rule, and is allowed.  Columns of
    ``pages`` named like a result are replaced; repeated rows stay; no rows give no rows.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    parted = pages.withColumns({"host": host, "path": path})
    rules = [(h.translate(str.maketrans(UPPER, LOWER)), p) for h, p in [*allow, *block]]
    keys = rule_keys(F.col("host"), F.col("path"), max((h.count(".") + 1 for h, _ in rules), default=1), {len(p) for _, p in rules} or {0})

    def listed(pairs: Sequence[tuple[str, str]]) -> DataFrame:
        named = F.array(*[F.lit(h.translate(str.maketrans(UPPER, LOWER)) + p) for h, p in pairs]).cast("array<string>")
        return spark.range(1).select(F.explode(named).alias("key"))

    seen = parted.select(F.explode(keys).alias("key"))
    allows, blocks = (Cascade.build(listed(pairs), seen, max_bytes, salt) for pairs, salt in ((allow, 0), (block, 100)))
    fits = F.filter(keys, lambda k: allows.has(k) | blocks.has(k))
    best = F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    # Parent domains of any depth; a suffix starts after a dot.
    labels = F.split(F.col("host"), "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = Cascade([])
    if blocked_hosts is not None:
        hosts = Cascade.build(blocked_hosts, parted.select(F.explode(parents).alias("key")), max_bytes, 200)
    default = F.when(F.exists(parents, hosts.has), "block").otherwise("allow")
    verdict = F.when(F.col("rule").isNull(), default).when(blocks.has(F.col("rule")), "block").otherwise("allow")
    return parted.withColumn("rule", best).withColumn("verdict", verdict)
