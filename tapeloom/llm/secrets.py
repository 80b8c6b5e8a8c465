"""Secret scans with a worklist of nested encodings."""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Failing shorter runs would be dropped: a run starts where no run goes on, so both read the same.
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\[uUx]([0-9A-Fa-f]+)")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
# What one compressed layer may expand to, and all layers of a document together: bounds memory against
# inputs made to explode; a layer cut off there is scanned up to the bound.
LAYER_BYTES, DOCUMENT_BYTES = 16 << 20, 256 << 20


class Span(NamedTuple):
    """Code points of the original text, end exclusive; ``layers`` names the encodings around it."""

    kind: str
    start: int
    end: int
    layers: str


class Layer(NamedTuple):
    """A text to scan.  Character i stands for the original characters starts[i] to ends[i]; the original
    itself has no maps."""

    text: str
    starts: array | None
    ends: array | None
    path: tuple[str, ...]
    ancestors: frozenset[bytes]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return min(self.starts[start:end]), max(self.ends[start:end])


def scan(text: str) -> list[tuple[str, int, int]]:
    """Plain secrets of one text, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _percent(run: str) -> Iterator[tuple[str, int, int]]:
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        chars, sizes = raw.decode("utf-8"), None
    except UnicodeDecodeError:
        chars, sizes = raw.decode("latin-1"), 1
    at = 0
    for c in chars:
        size = 3 * (sizes or len(c.encode("utf-8")))
        yield c, at, at + size
        at += size


def _unicode(run: str) -> Iterator[tuple[str, int, int]]:
    high = None
    for m in _ESCAPE.finditer(run):
        code = int(m[1], 16)
        if high is not None and 0xDC00 <= code < 0xE000:
            yield chr(0x10000 + (high[0] - 0xD800 << 10) + code - 0xDC00), high[1], m.end()
            high = None
            continue
        if high is not None:
            yield "�", *high[1:]
            high = None
        if 0xD800 <= code < 0xDC00:
            high = code, *m.span()
        else:
            sound = code < 0x110000 and not 0xDC00 <= code < 0xE000
            yield chr(code) if sound else "�", *m.span()
    if high is not None:
        yield "�", *high[1:]


def _unescaped(layer: Layer, name: str, runs: re.Pattern, decode) -> Iterator[Layer]:
    """A layer for each group of neighbouring lines with such escapes, the rest of them as it is."""
    text, done = layer.text, 0
    while m := runs.search(text, done):
        first = text.rfind("\n", 0, m.start()) + 1
        done = text.find("\n", m.end()) + 1 or len(text) + 1
        out, starts, ends, at = [], array("q"), array("q"), first

        def plain(start: int, end: int) -> None:
            out.append(text[start:end])
            if layer.starts is None:
                starts.extend(range(start, end))
                ends.extend(range(start + 1, end + 1))
            else:
                starts.extend(layer.starts[start:end])
                ends.extend(layer.ends[start:end])

        for run in runs.finditer(text, first, min(done - 1, len(text))):
            plain(at, run.start())
            for c, start, end in decode(run[0]):
                out.append(c)
                start, end = layer.origin(run.start() + start, run.start() + end)
                starts.append(start)
                ends.append(end)
            at = run.end()
        plain(at, min(done - 1, len(text)))
        yield Layer("".join(out), starts, ends, (*layer.path, name), layer.ancestors)


def _unpacked(raw: bytes, limit: int) -> tuple[str, bytes] | None:
    for name, magic, make in (
        ("zlib", (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda"), lambda: zlib.decompressobj(47)),
        ("bz2", (b"BZh",), bz2.BZ2Decompressor),
        ("xz", (b"\xfd7zXZ\x00",), lzma.LZMADecompressor),
    ):
        if raw.startswith(magic):
            try:
                return name, make().decompress(raw, limit)
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                return None
    return None


def _as_text(raw: bytes, cut: bool = False) -> str | None:
    try:
        text = raw.decode("utf-8", "ignore" if cut else "strict")
    except UnicodeDecodeError:
        return None
    return None if not text or _CONTROL.search(text) else text


def _base64(layer: Layer) -> Iterator[Layer]:
    for m in _BASE64.finditer(layer.text):
        body = m[0].rstrip("=").translate({ord("-"): "+", ord("_"): "/"})
        body = body[: len(body) - (len(body) % 4 == 1)]
        try:
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
        except binascii.Error:
            continue
        path = (*layer.path, "base64")
        start, end = layer.origin(*m.span())
        packed = False
        while got := _unpacked(raw, LAYER_BYTES):
            if got[1] == raw or len(path) > len(layer.path) + 64:
                break
            path, raw, packed = (*path, got[0]), got[1], True
        text = _as_text(raw, len(raw) == LAYER_BYTES)
        if text is None:
            continue
        starts, ends = array("q"), array("q")
        if packed:  # a place inside is the whole run
            starts.extend([start] * len(text))
            ends.extend([end] * len(text))
        else:
            at = 0
            for c in text:
                size = len(c.encode("utf-8"))
                # Byte b is made of characters 4 (b // 3) + b % 3 and the next.
                s, e = (4 * (b // 3) + b % 3 for b in (at, at + size - 1))
                s, e = layer.origin(m.start() + s, m.start() + e + 2)
                starts.append(s)
                ends.append(e)
                at += size
        yield Layer(text, starts, ends, path, layer.ancestors)


def find_secrets(text: str | None) -> list[Span]:
    """All spans of one text, plain ones with empty ``layers`` first.

    The worklist starts with the text.  Each layer is scanned, its spans are mapped to the original, and
    whatever it holds in URL, Unicode, base64 or compressed form becomes a layer, until none is left.
    A layer that repeats one of its ancestors is a cycle and not followed.
    """
    spans: dict[tuple[str, int, int], Span] = {}
    work, spent = [Layer(text or "", None, None, (), frozenset())], 0
    while work:
        layer = work.pop()
        digest = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest() if layer.path else b""
        if digest in layer.ancestors:
            continue
        layer = layer._replace(ancestors=layer.ancestors | {digest})
        for kind, start, end in scan(layer.text):
            start, end = layer.origin(start, end)
            spans.setdefault((kind, start, end), Span(kind, start, end, ">".join(layer.path)))
        inner: list[Layer] = []
        if "%" in layer.text:
            inner += _unescaped(layer, "url", _PERCENT, _percent)
        if "\\" in layer.text:
            inner += _unescaped(layer, "unicode", _UNICODE, _unicode)
        for part in (*inner, *_base64(layer)):
            spent += len(part.text)
            if spent <= DOCUMENT_BYTES:
                work.append(part)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans.values(), key=lambda s: (s.start, order[s.kind], s.end))


def secret_spans(text: Column) -> Column:
    """Array of (kind, start, end, layers) of whole texts, by start, then kind; a null or empty text has none."""

    @pandas_udf("array<struct<kind: string, start: long, end: long, layers: string>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [s._asdict() for s in find_secrets(t)])

    return spans(text)


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by ``[secret]``."""

    @pandas_udf("string")
    def redact(texts: pd.Series, found: pd.Series) -> pd.Series:
        def one(t: str | None, spans) -> str | None:
            if t is None or spans is None or not len(spans):
                return t
            out, at = [], 0
            for s in spans:
                if s["start"] >= at:
                    out += [t[at : s["start"]], "[secret]"]
                at = max(at, s["end"])
            return "".join([*out, t[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, found)])

    return redact(text, spans)


def scan_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets`` (the spans of :func:`secret_spans`) for whole texts.

    One row per row, whatever the keys; a column named ``secrets`` is replaced, others stay.  Null and
    empty texts have no secrets; no rows give no rows.
    """
    return docs.withColumn("secrets", secret_spans(F.col(text)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
