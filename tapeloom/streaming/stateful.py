"""Keyed state processors: change detectors, online drift, regimes, confidence-weighted updates.

Besides what a rule keeps, a key's state holds the rows that the watermark has not passed yet: they are
released in time order by event-time timers, so the order of arrival within the delay changes nothing, and
rows later than that are dropped.  Processors without a time column take each micro-batch in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.operators.drift import START, alarm_places, sample_gaps
from tapeloom.streaming.runner import use_rocksdb


def _in_order(parts, order):
    import pandas as pd

    pdf = pd.concat(list(parts), ignore_index=True)
    return pdf.sort_values(order, kind="mergesort")


WAITS = "waits_us"
# A piece of waiting rows as the state holds it: its first and last time and the rows as an Arrow batch.
HELD = "first long, last long, rows binary"
# Waiting rows of one piece, and released rows that a rule takes at once.
PIECE_ROWS, RELEASE_ROWS = 10_000, 100_000


def _packed(pdf) -> tuple:
    import pyarrow as pa

    batch = pa.RecordBatch.from_pandas(pdf, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return int(pdf[WAITS].min()), int(pdf[WAITS].max()), sink.getvalue().to_pybytes()


def _unpacked(rows):
    import pyarrow as pa

    return pa.ipc.open_stream(rows).read_all().to_pandas()


class _OrderedProcessor(StatefulProcessor):
    """Holds one tuple of state per key and passes ordered rows to ``advance``.

    With ``waiting``, the columns of a row, rows wait in packed pieces until the watermark passes their
    time, which is there as microseconds in ``waits_us``.  They are never objects of their own, and a
    rule gets them in stretches of bounded length."""

    state_schema = ""
    waiting: Sequence[str] | None = None

    def __init__(self, keys: Sequence[str], order: Sequence[str], out: Sequence[str]):
        self.keys, self.order, self.out = list(keys), list(order), list(out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)
        if self.waiting is not None:
            self.held = handle.getListState("held", HELD)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        if self.waiting is None:
            yield from self._advanced([_in_order(rows, self.order)])
            return
        first = None
        for part in rows:
            pdf = part[self.waiting].dropna(subset=[WAITS])
            if len(pdf):
                pieces = [_packed(pdf.iloc[s : s + PIECE_ROWS]) for s in range(0, len(pdf), PIECE_ROWS)]
                self.held.appendList(pieces)
                first = min([p[0] for p in pieces] if first is None else [first, *(p[0] for p in pieces)])
        if first is not None:
            self._wait_for(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        if self.waiting is None or not self.held.exists():
            return
        now = 1_000 * timerValues.getCurrentWatermarkInMs()
        due, later, kept = [], [], []
        for piece in self.held.get():
            if piece[0] > now:
                kept.append(tuple(piece))
                continue
            pdf = _unpacked(piece[2])
            passed = pdf[WAITS] <= now
            due.append(pdf[passed])
            if piece[1] > now:
                later.append(pdf[~passed])
        if not due:
            return
        if later:
            rest = pd.concat(later, ignore_index=True)
            kept += [_packed(rest.iloc[s : s + PIECE_ROWS]) for s in range(0, len(rest), PIECE_ROWS)]
        if kept:
            self.held.put(kept)
            self._wait_for(min(p[0] for p in kept))
        else:
            self.held.clear()
        rows = _in_order(due, self.order)
        del due, later
        yield from self._advanced(rows.iloc[s : s + RELEASE_ROWS] for s in range(0, len(rows), RELEASE_ROWS))

    def _wait_for(self, time) -> None:
        # The first millisecond at which all of the row's microseconds have passed.
        self.handle.registerTimer(int(-(-int(time) // 1_000)))

    def _advanced(self, parts):
        import pandas as pd

        before = self.state.get() if self.state.exists() else None
        for pdf in parts:
            out, before = self.advance(pdf, before)
            if len(out):
                yield pd.DataFrame(out)[self.out]
        self.state.update(before)

    def advance(self, pdf, before):
        raise NotImplementedError

    def close(self) -> None:
        pass


def _process(stream: DataFrame, keys, processor, fields: list[T.StructField], time: str | None = None) -> DataFrame:
    """Run a processor; ``time`` is a timestamp column with a watermark, by which rows are put in order."""
    use_rocksdb(stream.sparkSession)
    if time is not None:
        stream = stream.withColumn(WAITS, F.unix_micros(time))
        processor.waiting = [c for c in stream.columns if c != time]
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType(fields), outputMode="Append", timeMode="None" if time is None else "EventTime"
    )


def _fields(stream: DataFrame, names) -> list[T.StructField]:
    return [stream.schema[n] for n in names]


class _Detector(_OrderedProcessor):
    state_schema = "s0 double, s1 double, s2 double, s3 double"

    def __init__(self, keys, order, value, rule, settings):
        super().__init__(keys, order, [*keys, *order, value])
        self.value, self.rule, self.settings = value, rule, settings

    def advance(self, pdf, before):
        state = START if before is None else tuple(before)
        places, after = alarm_places(pdf[self.value].to_numpy(dtype=float), state, self.rule, **self.settings)
        return pdf.iloc[places], tuple(float(s) for s in after)


def change_alarms(stream: DataFrame, keys, order, value: str, rule: str, time: str | None = None, **settings) -> DataFrame:
    """Rows at which the detector raised an alarm, in the order of ``time`` if it is given."""
    return _process(stream, keys, _Detector(keys, order, value, rule, settings), _fields(stream, [*keys, *order, value]), time)


class _Drift(_OrderedProcessor):
    state_schema = "ref array<double>, recent array<double>"

    def __init__(self, keys, order, value, size, least, psi_limit, ks_limit):
        super().__init__(keys, order, [*keys, *order, "psi", "ks"])
        self.value, self.size, self.least = value, size, least
        self.psi_limit, self.ks_limit = psi_limit, ks_limit

    def _due(self, held: int) -> int:
        """Rows until the next comparison, when ``held`` recent values are kept."""
        every = max(self.least // 4, 1)
        if held >= self.size:
            return 1 if self.size % every == 0 else 1 << 62
        first = max(held + 1, self.least // 2, 1)
        at = -(-first // every) * every
        return at - held if at <= self.size else 1 << 62

    def advance(self, pdf, before):
        import numpy as np

        held = (np.zeros(0), np.zeros(0)) if before is None else tuple(np.asarray(x or [], dtype=float) for x in before)
        reference, recent = held
        values, out, at = pdf[self.value].to_numpy(dtype=float), [], 0
        while at < len(values):
            if len(reference) < self.least:
                take = min(self.least - len(reference), len(values) - at)
                reference = np.concatenate([reference, values[at : at + take]])
                at += take
                continue
            due = self._due(len(recent))
            take = min(due, len(values) - at)
            recent = np.concatenate([recent, values[at : at + take]])[-self.size :]
            at += take
            if take < due:
                continue
            psi, ks = sample_gaps(reference, recent)
            if psi > self.psi_limit or ks > self.ks_limit:
                out.append({**pdf.iloc[at - 1].to_dict(), "psi": psi, "ks": ks})
                reference, recent = recent, np.zeros(0)
        return out, (reference.tolist(), recent.tolist())


def online_drift(stream: DataFrame, keys, order, value: str, size: int = 500, least: int = 100, psi_limit: float = 0.2, ks_limit: float = 0.2) -> DataFrame:
    """Drift events of one value per key, against a sliding reference of at most ``size``.

    The reference fills first; recent values replace it when an event is raised.  Melt wide
    rows first so that each (stream, feature) is its own key.
    """
    fields = _fields(stream, [*keys, *order]) + [T.StructField(n, T.DoubleType()) for n in ("psi", "ks")]
    return _process(stream, keys, _Drift(keys, order, value, size, least, psi_limit, ks_limit), fields)


class _Regime(_OrderedProcessor):
    state_schema = "prices array<double>, spreads array<double>, last int"

    def __init__(self, keys, order, bid, ask, window, centres):
        super().__init__(keys, order, [*keys, *order, "regime"])
        self.bid, self.ask, self.window, self.centres = bid, ask, window, centres

    def advance(self, pdf, before):
        import numpy as np

        held = ([], [], -1) if before is None else before
        bid, ask = (pdf[c].to_numpy(dtype=float) for c in (self.bid, self.ask))
        prices, spreads = np.concatenate([held[0], (bid + ask) / 2.0]), np.concatenate([held[1], ask - bid])
        out, last = [], int(held[2])
        if len(prices) >= self.window:
            view = np.lib.stride_tricks.sliding_window_view
            x = np.column_stack([view(prices, self.window).std(axis=1), view(spreads, self.window).mean(axis=1)])
            now = ((np.asarray(self.centres, dtype=float)[None] - x[:, None]) ** 2).sum(axis=2).argmin(axis=1)
            changed = np.flatnonzero(now != np.r_[last, now[:-1]])
            out = pdf.iloc[len(pdf) - len(now) + changed].assign(regime=now[changed].astype("int32"))
            last = int(now[-1])
        kept = max(0, len(prices) - self.window + 1)
        return out, (prices[kept:].tolist(), spreads[kept:].tolist(), last)


def regime_changes(stream: DataFrame, keys, order, bid: str, ask: str, window: int, centres, time: str | None = None) -> DataFrame:
    """Emit the nearest centre of (deviation of mid price, mean spread) whenever it changes, in the order of
    ``time`` if it is given."""
    fields = _fields(stream, [*keys, *order]) + [T.StructField("regime", T.IntegerType())]
    return _process(stream, keys, _Regime(keys, order, bid, ask, window, centres), fields, time)


class _ConfidenceWeighted(_OrderedProcessor):
    """Adaptive regularisation of weights with a diagonal covariance (Crammer, Kulesza and Dredze, 2009)."""

    state_schema = "mean array<double>, variance array<double>, n long"

    def __init__(self, keys, order, features, label, weight, r):
        super().__init__(keys, order, [*keys, "n", "margin", "weights", "bias"])
        self.features, self.label, self.weight, self.r = list(features), label, weight, r

    def advance(self, pdf, before):
        import numpy as np

        size = len(self.features) + 1  # the last one is the bias, with a constant input of 1
        mean, variance, n = np.zeros(size), np.full(size, 1.0 / self.r), 0
        if before is not None:
            # Features added since the state was written start fresh; the bias stays last.
            old, spread, n = np.array(before[0]), np.array(before[1]), int(before[2])
            mean[: len(old) - 1], mean[-1] = old[:-1], old[-1]
            variance[: len(old) - 1], variance[-1] = spread[:-1], spread[-1]
        x = np.column_stack([pdf[self.features].to_numpy(dtype=float), np.ones(len(pdf))])
        side = np.where(pdf[self.label].to_numpy() == 1, 1.0, -1.0)
        importance = np.ones(len(pdf)) if self.weight is None else pdf[self.weight].to_numpy(dtype=float)
        used = importance > 0
        if used.any():
            importance = importance / importance[used].mean()
        margins = []
        for row, y, w in zip(x[used], side[used], importance[used]):
            moved = variance * row
            confidence = row @ moved
            margin = y * (mean @ row)
            margins.append(margin / np.sqrt(confidence))
            beta = 1.0 / (confidence + self.r / w)
            if margin < 1.0:
                mean = mean + (1.0 - margin) * beta * y * moved
                variance = variance - beta * moved**2
        n += int(used.sum())
        key = {c: pdf[c].iloc[0] for c in self.keys}
        average = float(np.mean(margins)) if margins else None
        out = [{**key, "n": n, "margin": average, "weights": mean[:-1].tolist(), "bias": float(mean[-1])}]
        return out, (mean.tolist(), variance.tolist(), n)


def confidence_weighted(stream: DataFrame, keys, order, features, label: str, r: float = 1.0, weight: str | None = None) -> DataFrame:
    """Weights of a confidence-weighted classifier per key after each micro-batch.

    A row's ``weight``, scaled to a mean of 1 in its micro-batch, divides the regularisation; rows of weight 0
    or less are skipped.  Unlike detectors that keep the first confidence for good, each update shrinks
    the variance of the weights it moved.
    """
    fields = _fields(stream, keys) + [
        T.StructField("n", T.LongType()), T.StructField("margin", T.DoubleType()),
        T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("bias", T.DoubleType()),
    ]
    return _process(stream, keys, _ConfidenceWeighted(keys, order, features, label, weight, r), fields)
