"""Byte-level BPE encoding and decoding with a segment tree over byte positions."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

NONE = 1 << 62
# Pieces of up to so many characters are remembered; so many of them, then the memory starts anew.
CACHE_CHARS, CACHE_PIECES = 40, 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one token per line, in base64, and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one piece.

    Leaf i of the tree holds the rank of the pair that the token at byte i makes with its live right
    neighbour, and i itself, so that the root is the leftmost pair of the lowest rank.  A merge takes
    the right token out of the chain of live tokens and updates three leaves, each up to the root or
    to where the least stays: n log n steps for n bytes, whatever the piece.  A piece that is a token is
    not split.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    width = 1 << (n - 2).bit_length() if n > 2 else 1  # the last byte starts no pair
    end = list(range(1, n + 1))  # where the token at i ends, which is where its neighbour starts
    before = list(range(-1, n))
    rank = ranks.get
    tree = [NONE] * (2 * width)
    at = width
    for i in range(n - 1):
        found = rank(piece[i : i + 2])
        if found is not None:
            tree[at] = found << 32 | i
        at += 1
    for k in range(width - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right
    while (top := tree[1]) != NONE:
        i = top & 0xFFFFFFFF
        gone = end[i]
        end[i] = after = end[gone]
        value = NONE
        if after < n:
            before[after] = i
            found = rank(piece[i : end[after]])
            if found is not None:
                value = found << 32 | i
        k = width + i
        if gone < width:
            if gone == i + 1 and not i & 1:  # both leaves have one parent
                tree[k + 1] = NONE
            else:
                g, least = width + gone, NONE
                tree[g] = NONE
                while g > 1:
                    beside = tree[g ^ 1]
                    if beside < least:
                        least = beside
                    g >>= 1
                    if tree[g] == least:
                        break
                    tree[g] = least
        tree[k] = value
        while k > 1:
            beside = tree[k ^ 1]
            if beside < value:
                value = beside
            k >>= 1
            if tree[k] == value:
                break
            tree[k] = value
        j = before[i]
        if j >= 0:
            found = rank(piece[j:after])
            value = NONE if found is None else found << 32 | j
            k = width + j
            if tree[k] != value:
                tree[k] = value
                while k > 1:
                    beside = tree[k ^ 1]
                    if beside < value:
                        value = beside
                    k >>= 1
                    if tree[k] == value:
                        break
                    tree[k] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder(dict):
    """Splits texts by a pattern and merges each match; remembers short ones as packed ids, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.ranks, self.find = ranks, regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        ids = merge(piece.encode("utf-8"), self.ranks)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = packed
        return packed

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.find(text or "")))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text), dtype="<u4").astype(np.int32)


def _encoder(held: dict) -> Encoder:
    if "encoder" not in held:
        held["encoder"] = Encoder(held["ranks"], held["pattern"])
    return held["encoder"]


def decoder(ranks: dict[bytes, int]) -> dict[int, bytes]:
    return {i: token for token, i in ranks.items()}


class Tokenizer:
    """A rank file and its pattern, sent to the executors once; a file has one row per token, so its size
    is that of the vocabulary."""

    def __init__(self, spark: SparkSession, path: str, pattern: str) -> None:
        # A worker keeps its copy of a broadcast between tasks, and with it the encoder put there.
        self.sent = spark.sparkContext.broadcast({"ranks": read_ranks(path), "pattern": pattern})

    def encode(self, text: Column) -> Column:
        """Token ids of whole texts as an array of int; a null or empty text has none."""
        sent = self.sent

        @pandas_udf("array<int>")
        def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = _encoder(sent.value)
            for texts in batches:
                yield texts.map(encoder.encode)

        return ids(text)

    def count(self, text: Column) -> Column:
        """The number of token ids of whole texts; a null or empty text has none.  Ids stay in the task.

        Only their number is wanted here, so the ids are the tokenizer library's, by the same ranks and
        pattern; :func:`merge` gives the same ones."""
        sent = self.sent

        @pandas_udf("long")
        def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held = sent.value
            if "library" not in held:
                held["library"] = tiktoken.Encoding("ranks", pat_str=held["pattern"], mergeable_ranks=held["ranks"], special_tokens={})
            encode = held["library"].encode_ordinary
            for texts in batches:
                yield pd.Series([len(encode(t or "")) for t in texts], dtype="int64")

        return n_tokens(text)

    def round_trip(self, text: Column) -> Column:
        """Struct of the number of token ids, their digest as little-endian unsigned 32-bit integers, and the
        digest of the bytes they decode to.  Ids stay in the task: one text's are held at a time."""
        sent = self.sent

        @pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
        def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            encoder, token = _encoder(sent.value), decoder(sent.value["ranks"])
            for texts in batches:
                made = []
                for text in texts:
                    packed = encoder.packed(text)
                    raw = b"".join(map(token.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))
                    made.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(raw).hexdigest()))
                yield pd.DataFrame(made, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

        return digests(text)

    def decode(self, ids: Column) -> Column:
        """The bytes of token ids; null ids give no bytes, an unknown id is an error."""
        sent = self.sent

        @pandas_udf("binary")
        def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            token = decoder(sent.value["ranks"])
            for rows in batches:
                yield rows.map(lambda r: b"" if r is None else b"".join(map(token.__getitem__, r)))

        return raw(ids)


def encoded(docs: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``: whole texts encoded, one row per row, other columns as they are (one named
    ``ids`` is replaced).  Null and empty texts have no ids; no rows give no rows."""
    return docs.withColumn("ids", tokenizer.encode(F.col(text)))
