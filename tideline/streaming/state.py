"""State that streams keep per key: the last accepted dispatch until it expires, the newest rows, the last severity.

Rows of a key reach a processor in frames. They are taken slice by slice of time: one frame is held in memory,
further ones wait in map state, so that a hot key of a micro-batch needs no more memory than a frame.
"""

from __future__ import annotations

import heapq
import json
import sys
from collections.abc import Iterator, Sequence
from decimal import Decimal
from itertools import chain, islice

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Ship the stateful processors with the task; executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How late a dispatch may come; what is later than that behind the newest one is dropped.
LATENESS = "1 day"
#: Severity reports of a key are sorted an hour at a time.
REPORT_SLICE = 3_600_000_000
#: Rows that are held at once, where the session sets no bound for a batch of Arrow.
FRAME_ROWS = 10_000
#: Rows that wait in a task to be thinned out, and the parts that a key's rows are thinned out in once more.
TRIM_ROWS = 40_000
PARTS = 8


class Slices:
    """Frames of one key by slices of time, in order."""

    def __init__(self, handle: StatefulProcessorHandle, width: int) -> None:
        self.width = width
        self.waiting = handle.getMapState("waiting", "slice bigint, place bigint", "rows binary")

    def of(self, frames: Iterator[pd.DataFrame]) -> Iterator[Iterator[pd.DataFrame]]:
        """The frames' parts in each slice, slice by slice; every part has to be taken."""
        first = next(frames)
        second = next(frames, None)
        if second is None:
            for _, part in first.groupby(first["t"] // self.width, sort=True):
                yield iter([part])
            return
        places: dict[int, int] = {}
        for frame in self._all(first, second, frames):
            for at, part in frame.groupby(frame["t"] // self.width, sort=True):
                place = places[int(at)] = places.get(int(at), -1) + 1
                sink = pa.BufferOutputStream()
                table = pa.Table.from_pandas(part, preserve_index=False)
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table)
                self.waiting.updateValue((int(at), place), (sink.getvalue().to_pybytes(),))
        for at in sorted(places):
            yield self._take(at, places[at] + 1)

    @staticmethod
    def _all(first: pd.DataFrame, second: pd.DataFrame, rest: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield first
        yield second
        yield from rest

    def _take(self, at: int, places: int) -> Iterator[pd.DataFrame]:
        for place in range(places):
            blob = bytes(self.waiting.getValue((at, place))[0])
            self.waiting.removeKey((at, place))
            yield pa.ipc.open_stream(blob).read_pandas()


class LastAccepted(StatefulProcessor):
    """Per key: time of the last accepted dispatch, until the watermark is a TTL beyond it.

    No two accepted rows lie within a TTL, so a slice of one TTL has one at most: the first row that is a TTL or
    more after the last accepted one. Most keys have a few rows; they come as plain rows, as a data frame for
    each key costs more than all else. Only a key with more than ``frame`` rows is taken slice by slice.
    """

    def __init__(self, ttl_micros: int, frame: int = FRAME_ROWS) -> None:
        self.ttl = ttl_micros
        self.frame = frame

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t bigint")
        self.slices = Slices(handle, self.ttl)

    def _expiry(self, t: int) -> int:
        return -(-(t + self.ttl) // 1000)

    def _frames(self, rows: Iterator[Row]) -> Iterator[pd.DataFrame]:
        while part := [(r["t"], r["id"]) for r in islice(rows, self.frame)]:
            yield pd.DataFrame(part, columns=["t", "id"])

    def _in_order(self, rows: Iterator[Row]) -> Iterator[Iterator[tuple]]:
        """``t, id is null, id`` in parts, of which every next one is later by a slice or has a single row."""
        few = list(islice(rows, self.frame + 1))
        if len(few) <= self.frame:
            for one in sorted((r["t"], r["id"] is None, r["id"]) for r in few):
                yield iter([one])
            return
        for parts in self.slices.of(self._frames(chain(few, rows))):
            yield ((t, ident is None, ident) for part in parts for t, ident in zip(part["t"].tolist(), part["id"].tolist(), strict=True))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.last.get()
        before = last = known[0] if known else None
        taken = []
        for part in self._in_order(rows):
            best = min((one for one in part if last is None or one[0] >= last + self.ttl), default=None)
            if best is not None:
                last = best[0]
                taken.append(Row(idempotency_key=key[0], id=best[2], t=last))
        if taken:
            if before is not None:
                self.handle.deleteTimer(self._expiry(before))
            self.last.update((last,))
            self.handle.registerTimer(self._expiry(last))
        return iter(taken)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.last.get()
        if known and self._expiry(known[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


class SeverityState(StatefulProcessor):
    """Per key: last severity. Emits a row for every change, the first report included."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "severity string")
        self.slices = Slices(handle, REPORT_SLICE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        for parts in self.slices.of(rows):
            batch = pd.concat(list(parts)).sort_values(["t", "report_id"], kind="stable")
            out = []
            for t, report, severity in zip(batch["t"], batch["report_id"], batch["severity"], strict=True):
                if severity != last:
                    out.append((key[0], report, severity, last, int(t)))
                    last = severity
            if out:
                yield pd.DataFrame(out, columns=["key", "report_id", "severity", "previous_severity", "t"])
        self.last.update((last,))

    def close(self) -> None:
        pass


def _place(rank: str) -> tuple:
    """What a row is ordered by; a missing value comes before all others, so it is the first to leave a window."""
    return tuple((v is not None, v) for v in json.loads(rank, parse_float=Decimal).values())


class NewestRows(StatefulProcessor):
    """Per key: a ring of the ``n`` newest rows in map state. Only slots whose row changes are written.

    Every key that has new rows emits its whole window.
    """

    def __init__(self, n: int) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getMapState("ring", "slot int", "rank string, row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(_place(rank), row, slot[0], rank) for slot, (rank, row) in self.ring.iterator()] if self.ring.exists() else []
        free = list(range(len(held), self.n))[::-1]
        heapq.heapify(held)
        for frame in rows:
            for rank, row in zip(frame["rank"], frame["row"], strict=True):
                new = (_place(rank), row, -1, rank)
                if len(held) < self.n:
                    heapq.heappush(held, new)
                elif new > held[0] and (gone := heapq.heapreplace(held, new))[2] >= 0:
                    free.append(gone[2])
        for _, row, slot, rank in held:
            if slot < 0:
                self.ring.updateValue((free.pop(),), (rank, row))
        yield pd.DataFrame({"row": [h[1] for h in held]})

    def close(self) -> None:
        pass


def _trim(n: int):
    """The ``n`` newest rows of each key among a task's rows, so that a hot key reaches its state thinned out.

    Rows wait up to a bound, then all but the newest leave. Where most stay, as there are many keys, they
    are passed on; so a task never holds more than the bound.
    """
    bound = max(4 * n, TRIM_ROWS)

    def newest(frames: list[pd.DataFrame]) -> pd.DataFrame:
        held = pd.concat(frames, ignore_index=True)
        if len(held) <= n:
            return held
        held = held.assign(place=[_place(r) for r in held["rank"]]).sort_values(["place", "row"], ascending=False, kind="stable")
        return held.groupby("key", sort=False, dropna=False).head(n).drop(columns="place")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for frame in frames:
            held.append(frame)
            rows += len(frame)
            if rows > bound:
                held = [newest(held)]
                rows = len(held[0])
                if rows > bound // 2:
                    yield held.pop()
                    rows = 0
        if rows:
            yield newest(held)

    return run


def _exact(column: Column, kind: str) -> Column:
    return F.unix_micros(column.cast("timestamp")) if kind in ("timestamp", "date", "timestamp_ntz") else column


def newest_rows(stream: DataFrame, n: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rows of every key (of the stream, without keys) that has new ones, after each micro-batch.

    Rows are ordered by ``order``, then by their content; null values come first. A late row takes its place in
    the order. Needs the RocksDB state store. Rows travel as JSON text, in which all of Spark's
    scalar types come back as they were.
    """
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    kinds = dict(stream.dtypes)
    rank = F.to_json(F.struct(*[_exact(F.col(c), kinds[c]).alias(f"o{i}") for i, c in enumerate(order)]), options)
    name = F.to_json(F.struct(*keys), options) if keys else F.lit("")
    packed = stream.select(name.alias("key"), rank.alias("rank"), F.to_json(F.struct(*stream.columns), options).alias("row"))
    kind = "key string, rank string, row string"
    # Each task of the source sends n rows of a key at most, and each part of a key n again: the state's task gets n times the parts.
    parts = packed.mapInPandas(_trim(n), kind).repartition("key", F.pmod(F.xxhash64("row"), F.lit(PARTS)))
    kept = parts.mapInPandas(_trim(n), kind).groupBy("key").transformWithStateInPandas(NewestRows(n), "row string", "Update", "None")
    return kept.select(F.from_json("row", stream.schema, options).alias("r")).select("r.*")


def dedupe_stream(
    stream: DataFrame, ttl_seconds: int = 86_400, key: str = "idempotency_key", ts: str = "ts", tie: str = "id", lateness: str = LATENESS
) -> DataFrame:
    """Accepted dispatches of a stream: none within the TTL of the last accepted one of its key.

    Within a micro-batch rows are taken in order of (time, id); rows without a time are not accepted. Event time
    drives expiry: once the watermark, ``lateness`` behind the newest row, is a TTL past a key's last accepted
    dispatch, its state leaves; from then on any row of the key would be accepted. Rows behind the watermark
    are dropped. Needs the RocksDB state store.
    """
    rows = stream.select(
        F.col(key).cast("string").alias("idempotency_key"), F.col(tie).cast("string").alias("id"),
        F.col(ts).cast("timestamp").alias("at"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"),
    ).where("t is not null")
    frame = int(stream.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    return rows.withWatermark("at", lateness).groupBy("idempotency_key").transformWithState(
        LastAccepted(ttl_seconds * 1_000_000, frame if frame > 0 else FRAME_ROWS), "idempotency_key string, id string, t long", "Append", "EventTime"
    )


def severity_change_events(reports: DataFrame, key: str = "key", ts: str = "ts") -> DataFrame:
    """Change events as a streaming DataFrame with one state row per key, for very many keys.

    Needs the RocksDB state store. State moves with the micro-batch; where delivery has to succeed
    first, use ``jobs.severity_change_stream``.
    """
    rows = reports.select(F.col(key).cast("string").alias("key"), "report_id", "severity", F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    return rows.groupBy("key").transformWithStateInPandas(
        SeverityState(), "key string, report_id string, severity string, previous_severity string, t long", "Append", "None"
    )
