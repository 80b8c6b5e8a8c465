"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import pin, shuffle_partitions

CAPACITY, END = 2_048, 0
# Short chunks that a worker remembers; others are encoded each time.
CACHE_CHUNKS, CACHE_CHARS = 1_200_000, 40
# Pieces that a task gives back at a time.
GROUP_PIECES = 4_096
# A round serves the lengths of which one sequence holds so many at least, and fewer than the next number.
ROOMS = (1, 2, 3, 4, 6, 8, 12, 16, 32, 64, 256)
# Rounds of a class before what is left opens new sequences.
SWEEPS = 2


class ChunkEncoder(dict):
    """Ids of whole texts by a tokenizer of lower-cased words that drops white space.

    Such a tokenizer gives a text the ids of its chunks between spaces, one after the other, so a chunk is
    encoded by the library once and remembered as packed ids, up to a bound.  If the tokenizer's file
    says that it normalizes to NFC and lower case, takes the matches of a pattern and spells them in
    bytes, then a chunk of Latin-1 characters, which has no other normal form, is cut by that pattern
    here and its matches, most of them known, go straight to the model.  All other chunks go through all
    steps of the library."""

    STEPS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]

    def __init__(self, file: str) -> None:
        super().__init__()
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self[""] = b""
        made = json.loads(file)
        steps = [[s["type"] for s in (made[kind] or {}).get(of, [])] for kind, of in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.find = None
        if steps == list(self.STEPS):
            split = made["pre_tokenizer"]["pretokenizers"][0]
            if split["behavior"] == "Removed" and split["invert"]:
                self.find = regex.compile(split["pattern"]["Regex"]).findall
                spelled = self.tokenizer.pre_tokenizer.pre_tokenize_str
                # Printable Latin-1; of the others some are white space to one library and not to another.
                self.plain = regex.compile(r"[\x21-\x7e\xa1-\xff]+").fullmatch
                self.spelling = str.maketrans({c: spelled(c)[0][0] for c in map(chr, (*range(0x21, 0x7F), *range(0xA1, 0x100)))})

    def __missing__(self, chunk: str) -> bytes:
        if self.find and self.plain(chunk):
            found = self.find(chunk.lower())
            if found == [chunk]:
                ids = [token.id for token in self.model.tokenize(chunk.translate(self.spelling))]
                packed = struct.pack(f"<{len(ids)}I", *ids)
            else:
                packed = b"".join(map(self.__getitem__, found))
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < CACHE_CHUNKS and len(chunk) <= CACHE_CHARS:
            self[chunk] = packed
        return packed

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def token_pieces(docs: DataFrame, file: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens: ``key, piece, start, length, ids_crc32`` (and
    ``ids``, packed as little-endian unsigned 32-bit integers, ``with_ids``).

    ``file`` is the path of a tokenizer that drops white space; it is read here and sent to the tasks.  A document is its ids, whole texts,
    and the end id 0, so a null or empty text is one piece of one token; only documents longer than a
    piece are cut, and the last piece may be shorter.  Null and repeated keys are documents of their own;
    other columns are ignored; no rows give no pieces.
    """
    spark = docs.sparkSession
    with open(file, encoding="utf-8") as source:
        sent = spark.sparkContext.broadcast({"file": source.read()})
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    end, step = struct.pack("<I", END), 4 * capacity

    columns = ["key", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = sent.value
        encoder = held.get("encoder") or held.setdefault("encoder", ChunkEncoder(held["file"]))
        for batch in batches:
            out = []
            for name, value in zip(batch["key"].astype(object).where(batch["key"].notna(), None), batch["text"]):
                ids = encoder.packed(value) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    out.append((name, piece, at // 4, len(own) // 4, zlib.crc32(own), *([own] if with_ids else ())))
                if len(out) >= GROUP_PIECES:
                    yield pd.DataFrame(out, columns=columns, dtype=object)
                    out = []
            yield pd.DataFrame(out, columns=columns, dtype=object)

    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.mapInPandas(cut, schema).withColumnRenamed("key", key)


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Match pieces to gaps inside one range of sizes, from the largest down.

    Rows come sorted: gaps before the pieces that fit them.  The gap seen last is the smallest that fits,
    so a stack of gaps gives every piece its successor; pieces of a higher rank choose first.  What finds
    none here (with its number) and the gaps left (as runs of places in the stack) go on to the ranges
    beside."""
    stack: list[list[int]] = []
    late, block = 0, 0
    columns = ["state", "block", "id", "size", "gap", "first", "places"]
    for batch in batches:
        out = []
        for kind, ident, size, places, block in zip(batch["kind"].tolist(), batch["id"].tolist(), batch["size"].tolist(), batch["places"].tolist(), batch["block"].tolist()):
            if not kind:
                stack.append([ident, places])
            elif stack:
                top = stack[-1]
                out.append((0, block, ident, size, top[0], 0, 0))
                top[1] -= 1
                if not top[1]:
                    stack.pop()
            else:
                out.append((1, block, ident, size, 0, late, 0))
                late += 1
        yield pd.DataFrame(out, columns=columns)
    first, out = 0, []
    for ident, places in stack:
        out.append((2, block, ident, 0, ident, first, places))
        first += places
    yield pd.DataFrame(out, columns=columns)


def _hand_over(ranges: Sequence[tuple[int, int, int]]) -> tuple[list[tuple], list[tuple], list[tuple], int]:
    """Give pieces left in a range the smallest gaps left in the ranges before it.

    ``ranges`` is (block, pieces left, gaps left), from large sizes to small.  Returns the shares (block,
    first piece, block of the gaps, place of the first gap, number of pieces), the gaps that stay free
    (block, number), the first piece without any gap per block, and the number of such pieces in all.
    There are at most two shares per range."""
    stack, shares, none, missed = [], [], [], 0
    for block, late, left in ranges:
        given = 0
        while given < late and stack:
            source, free = stack[-1]
            taken = min(free, late - given)
            shares.append((block, given, source, free - 1, taken))
            given += taken
            stack[-1][1] -= taken
            if not stack[-1][1]:
                stack.pop()
        none.append((block, given))
        missed += late - given
        if left:
            stack.append([block, left])
    free = dict(map(tuple, stack))
    return shares, [(block, free.get(block, 0)) for block, _, left in ranges if left], none, missed


def _match(pieces: DataFrame, gaps: DataFrame, smallest: int, largest: int) -> tuple[DataFrame, DataFrame, int]:
    """One sweep: pieces of ``smallest`` to ``largest`` tokens into gaps.

    A gap offers as many places as pieces of the largest length fit, one at least.  Returns the places
    found (``id, size, sequence, opens``), what found none (``block, id, size, first``) and its number."""
    spark = pieces.sparkSession
    places = F.greatest(F.lit(1), F.floor(F.col("gap") / largest)).cast("long")
    offers = gaps.where(F.col("gap") >= smallest).withColumn("places", places)
    offers = offers.select(F.lit(0).alias("kind"), F.col("sequence").alias("id"), F.floor(F.col("gap") / F.col("places")).cast("long").alias("size"), "places")
    wants = pieces.select(F.lit(1).alias("kind"), "id", "size", F.lit(0).cast("long").alias("places"))
    in_order = offers.union(wants).repartitionByRange(shuffle_partitions(spark), F.desc("size"), "kind", "id").sortWithinPartitions(F.desc("size"), "kind", "id")
    swept = in_order.withColumn("block", F.spark_partition_id()).mapInPandas(
        _sweep, "state int, block int, id long, size long, gap long, first long, places long"
    )
    swept = pin(swept)
    left = swept.where("state > 0").groupBy("block").agg(
        F.count(F.when(F.col("state") == 1, 1)).alias("late"), F.coalesce(F.sum("places"), F.lit(0)).alias("left")
    )
    # One row per range: bounded by the number of shuffle partitions.
    shares, free, none, missed = _hand_over(sorted((r["block"], r["late"], r["left"]) for r in left.collect()))
    here = swept.where("state = 0").select("id", "size", F.col("gap").alias("sequence"))
    late = swept.where("state = 1").select("block", "id", "size", "first")
    shares_table = spark.createDataFrame(shares, "block int, since long, source int, top long, taken long")
    beside = late.join(F.broadcast(shares_table), "block").where("first >= since and first < since + taken")
    beside = beside.select("id", "size", F.col("source").alias("at"), (F.col("top") - (F.col("first") - F.col("since"))).alias("place"))
    runs = swept.where("state = 2").join(F.broadcast(spark.createDataFrame(free, "block int, free long")), "block")
    runs = runs.where("first + places > free").select(
        F.col("block").alias("at"), F.col("gap").alias("sequence"), F.explode(F.sequence(F.greatest("first", "free"), F.col("first") + F.col("places") - 1)).alias("place")
    )
    beside = beside.join(runs, ["at", "place"]).select("id", "size", "sequence")
    given = spark.createDataFrame(none, "block int, given long")
    unmatched = late.join(F.broadcast(given), "block").where("first >= given").drop("given")
    return here.union(beside).withColumn("opens", F.lit(False)), unmatched, missed


def _open(pieces: DataFrame, capacity: int, named: int) -> tuple[DataFrame, int]:
    """New sequences for what :func:`_match` left over: as many pieces each as fit of their length."""
    spark = pieces.sparkSession
    sized = pieces.withColumn("room", F.floor(F.lit(capacity) / F.col("size")))
    # Ranges hold falling lengths, so there are at most as many rows as ranges and different rooms together.
    counts = sized.groupBy("room", "block").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("low")).collect()
    table, free, last = [], 0, -1
    for room, blocks in groupby(sorted(counts), key=lambda r: r["room"]):
        blocks, longest = list(blocks), capacity // room
        rows = sum(r["n"] for r in blocks)
        # The first go to the sequence that was opened last, as long as they fit at their longest.
        joining = min(rows, free // longest)
        full, rest = divmod(rows - joining, room)
        seen = 0
        for r in blocks:
            table.append((room, r["block"], seen - r["low"], joining, last, named))
            seen += r["n"]
        named += full + bool(rest)
        if rows == joining:
            free -= joining * longest
        else:
            free, last = capacity - (rest or room) * longest, named - 1
    schema = "room long, block int, shift long, joining long, last long, named long"
    placed = sized.join(F.broadcast(spark.createDataFrame(table, schema)), ["room", "block"])
    number = F.col("first") + F.col("shift") - F.col("joining")
    sequence = F.when(number < 0, F.col("last")).otherwise(F.floor(number / F.col("room")) + F.col("named"))
    return placed.select("id", "size", sequence.alias("sequence"), ((number >= 0) & (number % F.col("room") == 0)).alias("opens")), named


def _updated(gaps: DataFrame, placed: DataFrame, capacity: int) -> DataFrame:
    """``sequence, gap, used``: what is free after a round, and whether the round took some of it."""
    change = placed.select("sequence", (F.when(F.col("opens"), capacity).otherwise(0) - F.col("size")).cast("long").alias("gap"), F.lit(True).alias("used"))
    both = gaps.withColumn("used", F.lit(False)).union(change)
    return pin(both.groupBy("sequence").agg(F.sum("gap").alias("gap"), F.max("used").alias("used")).where("gap > 0"))


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, rooms: Sequence[int] = ROOMS, sweeps: int = SWEEPS) -> DataFrame:
    """``id, sequence_id, offset`` for ``pieces`` with a unique long ``id`` and a ``length`` from 1 to
    ``capacity``: each has a place in a sequence, gapless from 0, and no sequence is over its capacity.

    Lengths are served from long to short, a class of lengths at a time.  A round sorts pieces and gaps by
    size into ranges, sweeps each range for the smallest gap that fits, where longer pieces choose first,
    hands what is left over to the ranges before it, and makes the gaps anew.  What fits nowhere after at
    most ``sweeps`` rounds opens new sequences.  The number of rounds is bounded by ``rooms``, whatever
    the data; a length that many pieces have is cut into ranges like others, so none is hot.  The driver
    sees a row or two per range.
    """
    spark = pieces.sparkSession
    sized = pin(pieces.select(F.col("id").cast("long").alias("id"), F.col("length").cast("long").alias("size")))
    tops = sorted({capacity // r for r in rooms if r <= capacity}, reverse=True)
    nth = F.size(F.filter(F.array(*[F.lit(t) for t in tops]), lambda t: t >= F.col("size"))).alias("nth")
    # At most one row per class, the one of lengths over ``capacity``, and null.
    classes = sorted(sized.groupBy(nth).agg(F.min("size").alias("low"), F.max("size").alias("high"), F.count(F.when(F.col("size").isNull(), 1)).alias("bad")).collect())
    if any(c["bad"] or c["low"] < 1 or c["high"] > capacity for c in classes):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    gaps = spark.createDataFrame([], "sequence long, gap long, used boolean")
    rounds, named = [], 0
    for _, low, high, _ in classes:
        waiting = sized.where(F.col("size").between(low, high))
        for _ in range(sweeps):
            found, waiting, missed = _match(waiting, gaps, low, high)
            rounds.append(pin(found))
            gaps = _updated(gaps, rounds[-1], capacity)
            # A gap that took nothing fits none of the pieces that are left.
            if not missed or gaps.where(F.col("used") & (F.col("gap") >= low)).isEmpty():
                break
        if missed:
            opened, named = _open(waiting, capacity, named)
            rounds.append(pin(opened))
            gaps = _updated(gaps, rounds[-1], capacity)
    if not rounds:
        return spark.createDataFrame([], "id long, sequence_id long, offset long")
    placed = rounds[0]
    for more in rounds[1:]:
        placed = placed.union(more)
    # A sequence holds ``capacity`` pieces at most.
    before = Window.partitionBy("sequence").orderBy(F.desc("size"), "id").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("size").over(before), F.lit(0).cast("long"))
    return placed.select("id", F.col("sequence").alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, file: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """:func:`token_pieces` with the place of each piece: ``sequence_id, offset``.

    Pieces are written once, as their numbers depend on placement.  See there for odd rows."""
    pieces = pin(token_pieces(docs, file, capacity, key, text, with_ids).withColumn("_id", F.monotonically_increasing_id()))
    places = best_fit(pieces.select(F.col("_id").alias("id"), "length"), capacity)
    return pieces.join(places.withColumnRenamed("id", "_id"), "_id").drop("_id")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids, lengths``, where ``ids`` are the pieces' packed ids
    one after the other and ``lengths`` where each ends, from :func:`pack_documents` ``with_ids``."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("rows"))
    ids = F.aggregate("rows", F.lit(b""), lambda made, r: F.concat(made, r["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.col("rows")["length"].alias("lengths"))
