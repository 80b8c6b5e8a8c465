"""Near duplicates by SimHash fingerprints and a byte-position inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat
from random import Random

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tapeloom.llm.components import components
from tapeloom.session import pin

SEED = 42
CHUNK = 1 << 12
# Rows of one posting list that meet in one task; longer lists are cut into pairs of parts.
LIST_ROWS = 20_000
# Rows, and features in all, of one part of a candidate group whose texts are compared; every two parts of
# a larger group meet.
GROUP_ROWS, GROUP_FEATURES = 1_000, 4_000_000


@dataclass(frozen=True)
class Scheme:
    """How texts become fingerprints and which fingerprints link.

    ``shingle`` words make a feature, ``n_bytes`` the fingerprint, ``max_bits`` may differ between
    linked fingerprints.  A posting list is named by ``key_bytes`` positions and their values.  With
    ``lists`` unset, lists are kept for all choices among the first ``max_bits + key_bytes``
    positions: ``max_bits`` differing bits spoil at most as many bytes, so every link meets in a list
    and none is lost.  With ``lists`` set, so many choices are drawn with a fixed seed, for
    fingerprints too wide for a guarantee; recall is then a matter of measurement.  ``distinct``
    counts every feature of a text once.

    With ``similarity`` set, fingerprints only propose groups: a link holds if the Jaccard similarity of the
    two texts' feature sets, counted in full, reaches it.
    """

    shingle: int = 3
    n_bytes: int = 8
    max_bits: int = 3
    key_bytes: int = 4
    lists: int | None = None
    distinct: bool = False
    similarity: float | None = None

    @property
    def least_shared(self) -> int:
        """Positional bytes that a pair must share to be worth verifying."""
        return max(self.key_bytes, self.n_bytes - self.max_bits)

    def choices(self) -> list[tuple[int, ...]]:
        if self.lists is None:
            if self.max_bits + self.key_bytes > self.n_bytes:
                raise ValueError("no byte is sure to be shared: set lists")
            return list(combinations(range(self.max_bits + self.key_bytes), self.key_bytes))
        every = list(combinations(range(self.n_bytes), self.key_bytes))
        return sorted(Random(SEED).sample(every, min(self.lists, len(every))))


# Three words, 64 bits, three of which may differ: every link is found.
EXACT = Scheme()
# Five words and a Jaccard similarity J of 0.8: at angle theta two fingerprints differ in a share theta / pi
# of their bits, and cos(theta) = 2 J / (1 + J); 0.8 makes 116 of 768 bits on average with a standard
# deviation of 10 to 11, and up to 144 for texts of few features, where votes tie.  160 bits propose nearly
# all such pairs, and the texts decide.  A list of three bytes has a pair with probability 0.02, so 256
# lists miss few; the more bytes to choose from, the less the lists depend on each other.
SIMILAR = Scheme(shingle=5, n_bytes=96, max_bits=160, key_bytes=3, lists=256, distinct=True, similarity=0.8)


def _features(text: str | None, size: int) -> np.ndarray:
    found = (text or "").encode("utf-8").lower().split()
    if len(found) < size:
        found = [b" ".join(found)] if found else []
    else:
        found = map(b" ".join, zip(*(found[i:] for i in range(size))))
    return np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), dtype=np.uint64)


def _more_bits(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """Widen 64-bit hashes to ``n_words`` columns; the first column is the hash itself."""
    out = np.empty((len(hashes), n_words), dtype=np.uint64)
    out[:, 0] = hashes
    for k in range(1, n_words):
        x = hashes + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def fingerprint(text: str | None, scheme: Scheme = EXACT) -> bytes:
    """The fingerprint of one text: bit i is 1 if over half the feature hashes have it set."""
    return _fingerprint(_hashes(text, scheme), scheme)


def _hashes(text: str | None, scheme: Scheme) -> np.ndarray:
    hashes = _features(text, scheme.shingle)
    return np.unique(hashes) if scheme.distinct else hashes


def _fingerprint(hashes: np.ndarray, scheme: Scheme) -> bytes:
    votes = np.zeros(8 * scheme.n_bytes, dtype=np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = _more_bits(hashes[start : start + CHUNK], scheme.n_bytes // 8).astype(">u8")
        votes += np.unpackbits(part.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * votes > len(hashes)).tobytes()


def fingerprints(text: Column, scheme: Scheme = EXACT) -> Column:
    @pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, scheme))

    return of(text)


def posting_keys(fp: Column, scheme: Scheme) -> Column:
    """The names of the lists a fingerprint goes to.

    A name is a hash of the choice and its bytes; two names that clash only put more rows into a
    list, as every pair is verified.
    """
    choices = F.array(*[F.array(*[F.lit(p + 1) for p in c]) for c in scheme.choices()])
    byte = [lambda c, k=k: F.substring(fp, F.get(c, k), F.lit(1)) for k in range(scheme.key_bytes)]
    return F.transform(choices, lambda c, i: F.xxhash64(i, *[b(c) for b in byte]))


class _Forest:
    """Union-find over the nodes that a task has seen."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y

    def links(self) -> pd.DataFrame:
        """One link for every connected node but the least of its tree, to which it leads: tasks that meet the
        same nodes mostly return the same links."""
        pairs = [(x, self.find(x)) for x in list(self.parent)]
        return pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["a", "b"], dtype="int64")


class _Linker:
    """Connects the nodes of the posting lists that a task goes through; pairs that are connected already are
    not looked at again."""

    def __init__(self, scheme: Scheme) -> None:
        self.scheme, self.forest = scheme, _Forest()

    def known(self, x: int, y: int) -> bool:
        return self.forest.find(x) == self.forest.find(y)

    def few(self, names: list[int], prints: list[int]) -> None:
        for i, j in combinations(range(len(names)), 2):
            differ = prints[i] ^ prints[j]
            if differ.bit_count() <= self.scheme.max_bits and differ.to_bytes(self.scheme.n_bytes, "big").count(0) >= self.scheme.least_shared:
                self.forest.join(names[i], names[j])

    def many(self, names: list[int], prints: np.ndarray) -> None:
        """Each row against all later ones that are not connected with it, at once."""
        roots = np.array([self.forest.find(x) for x in names])
        for i in range(len(names) - 1):
            rest = np.flatnonzero(roots[i + 1 :] != roots[i]) + i + 1
            if not len(rest):
                if (roots == roots[i]).all():
                    break
                continue
            differ = prints[rest] ^ prints[i]
            bits = np.bitwise_count(differ).sum(axis=1)
            shared = (differ.view(np.uint8).reshape(len(rest), -1) == 0).sum(axis=1)
            fits = (shared >= self.scheme.least_shared) & (bits <= self.scheme.max_bits)
            for j in rest[fits].tolist():
                self.forest.join(names[i], names[j])
                if roots[j] != roots[i]:
                    least, most = sorted((roots[i], roots[j]))
                    roots[roots == most] = least

    def links(self) -> pd.DataFrame:
        return self.forest.links()


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Of batches of rows sorted by ``key`` and ``part``: rows that end with a group, and the groups' edges."""
    tail = None
    for batch in batches:
        if tail is not None:
            batch = pd.concat([tail, batch], ignore_index=True)
        key, part = batch["key"].to_numpy(), batch["part"].to_numpy()
        edges = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        if not len(edges):
            tail = batch
            continue
        yield batch.iloc[: edges[-1]], np.concatenate(([0], edges))
        tail = batch.iloc[edges[-1] :].reset_index(drop=True)
    if tail is not None and len(tail):
        yield tail, np.array([0, len(tail)])


def _link_lists(scheme: Scheme):
    """For ``mapInPandas`` over rows sorted by list: links that connect what the lists of a task connect."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        linker = _Linker(scheme)
        for rows, edges in _groups(batches):
            connect(rows, edges, linker)
        yield linker.links()

    def connect(rows: pd.DataFrame, edges: np.ndarray, linker: _Linker) -> None:
        nodes, prints = rows["node"].to_numpy(), rows["fp"].to_numpy()
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            names = nodes[start:end].tolist()
            if len(names) == 2 and linker.known(*names):
                continue
            if len(names) <= 8:
                linker.few(names, [int.from_bytes(p, "big") for p in prints[start:end]])
            else:
                linker.many(names, np.frombuffer(b"".join(prints[start:end]), dtype=np.uint64).reshape(len(names), -1))

    return run


def similar_pairs(sets: list[np.ndarray], own: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each feature set the later ones whose Jaccard similarity with it is ``least`` or more; sets of
    different ``own`` only, unless all are the same.  Empty sets are equal."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, features = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *sets]), return_inverse=True)
    order = np.argsort(features, kind="stable")
    holders, starts = rows[order], np.searchsorted(features[order], np.arange(features.max(initial=-1) + 2))
    apart, at = (own != own[0]).any(), np.concatenate(([0], np.cumsum(sizes)))
    for i in range(len(sets) - 1):
        mine = features[at[i] : at[i + 1]]
        held = [holders[a:b] for a, b in zip(starts[mine].tolist(), starts[mine + 1].tolist()) if b - a > 1]
        both = np.bincount(np.concatenate([np.empty(0, dtype=np.int64), *held]), minlength=len(sets))
        either = sizes + sizes[i] - both
        fits = (both >= least * either) if sizes[i] else sizes == 0
        if apart:
            fits &= own != own[i]
        yield i, np.flatnonzero(fits[i + 1 :]) + i + 1


def _link_similar(least: float):
    """For ``mapInPandas`` over rows sorted by group: links that connect what similar texts connect."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = _Forest()
        for rows, edges in _groups(batches):
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                group = rows.iloc[start:end]
                nodes, own = group["node"].tolist(), group["own"].to_numpy()
                sets = [np.frombuffer(x, dtype=np.uint64) for x in group["features"]]
                for i, others in similar_pairs(sets, own, least):
                    for j in others.tolist():
                        forest.join(nodes[i], nodes[j])
        yield forest.links()

    return run


def _feature_sets(scheme: Scheme):
    """For ``mapInPandas``: the feature set of each node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(_hashes(t, scheme)) for t in batch.pop("text")]
            yield batch.assign(n=[len(x) for x in sets], features=[x.tobytes() for x in sets])

    return run


def candidate_lists(nodes: DataFrame, scheme: Scheme, list_rows: int = LIST_ROWS) -> DataFrame:
    """Rows ``key, part, node, fp`` of all posting lists with two or more nodes.

    A list of over ``list_rows`` rows is cut into parts, and every two of its parts meet in a task of
    their own: no pair is lost and no task holds more than two parts.
    """
    lists = nodes.select("node", F.explode(posting_keys(F.col("fp"), scheme)).alias("key"))
    shared = pin(lists.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1"))
    cuts = F.ceil(F.col("n") / list_rows)
    own = F.pmod(F.xxhash64("node"), cuts)
    parts = F.transform(F.sequence(F.lit(0).cast("long"), cuts - 1), lambda o: F.least(own, o) * cuts + F.greatest(own, o))
    return shared.select("key", "node", F.explode(parts).alias("part")).join(nodes.select("node", "fp"), "node")


def _verified(links: DataFrame, nodes: DataFrame, texts: DataFrame, scheme: Scheme, group_rows: int, group_features: int) -> DataFrame:
    """Links between the nodes of each group that ``links`` connect whose texts are similar.

    Every two texts of a group are compared, whether they met in a list or not.  A group of over
    ``group_rows`` texts or ``group_features`` features is cut into parts, every two of which meet in a
    task of their own.
    """
    groups = components(links)
    groups = groups.union(groups.select("label", "label")).distinct()
    members = pin(groups.join(nodes.select("node", "copy"), "node").select("node", F.col("label").alias("key"), "copy"))
    # One text names a fingerprint's node: others of the same 768 bits have all but the same features.
    found = texts.groupBy("copy").agg(F.first("text").alias("text")).join(members, "copy").select("node", "key", "text")
    sets = pin(found.mapInPandas(_feature_sets(scheme), "node long, key long, n long, features binary"))
    sizes = sets.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    cuts = F.greatest(F.ceil(F.col("rows") / group_rows), F.ceil(F.col("n") / group_features))
    # At most one row for each group_rows texts or group_features features, so bounded by the table's part of that.
    large = F.broadcast(pin(sizes.select("key", cuts.alias("cuts")).where("cuts > 1")))
    cut = sets.join(large, "key", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1).cast("long")))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")))
    others = F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)
    parts = F.transform(others, lambda o: F.least("own", o) * F.col("cuts") + F.greatest("own", o))
    met = cut.select("key", "node", "own", "features", F.explode(parts).alias("part"))
    return met.repartition("key", "part").sortWithinPartitions("key", "part").mapInPandas(_link_similar(scheme.similarity), "a long, b long")


def near_duplicates(
    docs: DataFrame, scheme: Scheme = EXACT, text: str = "text", key: str = "doc_id", list_rows: int = LIST_ROWS, group_rows: int = GROUP_ROWS,
    group_features: int = GROUP_FEATURES,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``fp`` (binary) and ``component_id``.

    Equal fingerprints become one node before anything is compared, so a text copied a million times
    costs one row.  Nodes go to the posting lists of their positional bytes; pairs that meet are
    tallied by shared bytes, verified by differing bits, and each task returns one link per connected
    node only.  With ``scheme.similarity`` these links only tell which texts to compare, and links of
    similar texts count.  ``component_id`` is the smallest key reachable over links, itself included.

    A null or empty text has the zero fingerprint and links like any other.  Rows with a null key keep
    their fingerprint and take part; ``component_id`` is null only if no row of the component has a
    key.  Repeated keys are rows of their own.  Other columns are ignored; no rows give no rows.
    """
    copy = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    prints = pin(docs.select(F.col(key).alias("doc"), fingerprints(F.col(text), scheme).alias("fp"), copy.alias("copy")))
    nodes = pin(prints.groupBy("fp").agg(F.min("doc").alias("least"), F.min("copy").alias("copy")).withColumn("node", F.monotonically_increasing_id()))
    lists = candidate_lists(nodes, scheme, list_rows).select("key", "part", "node", "fp")
    found = lists.repartition("key", "part").sortWithinPartitions("key", "part").mapInPandas(_link_lists(scheme), "a long, b long")
    links = found.distinct()
    if scheme.similarity is not None:
        texts = docs.select(copy.alias("copy"), F.col(text).alias("text"))
        links = _verified(links, nodes, texts, scheme, group_rows, group_features).distinct()
    # Nodes are named by their smallest key first, so a label tells the component's key: looking it up by
    # label would bring a large component to one task.  Missing keys come last.
    for end in "ab":
        name = F.struct(F.col("least").isNull(), "least", "node").alias(f"{end}_name")
        links = links.join(nodes.select(F.col("node").alias(end), name), end)
    reached = components(links, "a_name", "b_name").select("node.node", F.col("label.least").alias("reached"))
    of_print = nodes.join(reached, "node", "left").select("fp", F.coalesce("reached", "least").alias("component_id"))
    return prints.join(of_print, "fp").select(F.col("doc").alias(key), "fp", "component_id")
