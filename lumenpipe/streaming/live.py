"""Live queries: a snapshot, then deltas as rows arrive, on Structured Streaming.

Queries of row-wise stages append: every micro-batch runs through the stages and gives the new rows; rows
that leave the sliding window are expired. All other queries are replaced: the plan runs again over
the stored table, with the time bounds of that moment. The stream's checkpoint makes both repeatable: a
micro-batch that is run again gives the same deltas under the same number.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..plans import ast as A
from ..plans import catalog as C
from ..plans.errors import ResourceLimit
from ..plans.planner import _State

ROW_WISE = (A.Where, A.Select, A.Compute, A.Within)


@dataclass(frozen=True)
class Delta:
    """kind: snapshot, ready, append, expire, replace, heartbeat, warning or error; alias is None for the primary table.

    ``ready`` follows the snapshot. ``warning`` and ``error`` have a message: a batch in an order or of a kind that the result cannot follow exactly,
    and one that failed (the stream fails too, and runs the batch again when it is started anew).
    """

    kind: str
    alias: str | None
    rows: DataFrame | None
    batch: int
    watermark_ns: int | None = None
    message: str | None = None


def strategy(query: A.Query) -> str:
    """append if every stage works row by row (merges aside), else replace."""
    return "append" if all(isinstance(s, (*ROW_WISE, A.Merge)) for s in query.stages) else "replace"


class Subscriptions:
    """At most so many live queries at a time."""

    def __init__(self, most: int = 1000) -> None:
        self.most, self.active, self._lock = most, 0, threading.Lock()

    def __enter__(self) -> Subscriptions:
        with self._lock:
            if self.active >= self.most:
                raise ResourceLimit(f"there are {self.most} live queries already")
            self.active += 1
        return self

    def __exit__(self, *_: object) -> None:
        with self._lock:
            self.active -= 1


class LiveQuery:
    """One live query. ``stream`` has the scanned signal's rows; ``engine`` reads the tables as they are stored.

    ``on_delta`` is called on the driver with lazy DataFrames; a sink that writes them by ``batch`` is
    idempotent. Rows with times ahead of the clock are let through, as the upper bound is dropped.
    """

    def __init__(self, engine: Engine, text: str, on_delta: Callable[[Delta], None], clock: Callable[[], int] | None = None) -> None:
        self.engine, self.text, self.on_delta = engine, text, on_delta
        self.clock = clock or engine.now
        self.query = engine.parse(text)
        self.strategy = strategy(self.query)
        self.lower: int | None = None

    def _engine_at(self, now: int) -> Engine:
        e = self.engine
        return Engine(e.spark, e.cold, e.hot, now, e.approx, e.compat)

    def _time(self) -> str | None:
        return C.TIME_COLUMN.get(self.query.scan.signal)

    def _lower(self, now: int) -> int | None:
        t = self.query.scan.time
        if self._time() is None:
            return None
        return max(0, now - t.ns) if isinstance(t, A.Last) else t.start

    def snapshot(self) -> None:
        now = self.clock()
        self.lower = self._lower(now)
        result = self._engine_at(now).planner().run(self.query)
        self.on_delta(Delta("snapshot", None, result.primary, -1))
        for alias, df in result.aux.items():
            self.on_delta(Delta("snapshot", alias, df, -1))
        self.on_delta(Delta("ready", None, None, -1, now))

    def _rows(self, df: DataFrame, now: int) -> DataFrame:
        """The row-wise stages over some rows of the signal, without an upper time bound."""
        planner = self._engine_at(now).planner()
        st = _State(df, self.query.scan.signal, self.query.scan.time)
        for s in self.query.stages:
            if isinstance(s, A.Within):
                t = planner.time(st).col
                st = replace(st, df=st.df.where(t >= planner.bounds(s.time)[0]))
            elif isinstance(s, ROW_WISE):
                st = planner.apply(st, s)
        return st.df

    def process(self, batch: DataFrame, number: int) -> None:
        """The deltas of one micro-batch (for ``foreachBatch``)."""
        try:
            self._process(batch, number)
        except Exception as e:
            self.on_delta(Delta("error", None, None, number, message=f"{type(e).__name__}: {str(e)[:500]}"))
            raise

    def _process(self, batch: DataFrame, number: int) -> None:
        now, time = self.clock(), self._time()
        if self.lower is not None and (self._lower(now) or 0) < self.lower:
            self.on_delta(Delta("warning", None, None, number, now, "the clock went back: rows that have expired do not come again"))
        lower = self._lower(now)
        if self.strategy == "append":
            fresh = batch if lower is None else batch.where(F.col(time) >= lower)
            if isinstance(self.query.scan.time, A.Span) and time:
                fresh = fresh.where(F.col(time) <= self.query.scan.time.end)
            self.on_delta(Delta("append", None, self._rows(fresh, now), number))
            if lower is not None and self.lower is not None and lower > self.lower:
                stored = self.engine.table(C.table_of(self.query.scan.signal))
                gone = stored.where((F.col(time) >= self.lower) & (F.col(time) < lower))
                self.on_delta(Delta("expire", None, self._rows(gone, now), number))
        result = None
        if self.strategy == "replace" or any(isinstance(s, A.Merge) for s in self.query.stages):
            result = self._engine_at(now).planner().run(self.query)
        if self.strategy == "replace":
            self.on_delta(Delta("replace", None, result.primary, number))
        for alias, df in (result.aux if result else {}).items():
            self.on_delta(Delta("replace", alias, df, number))
        self.lower = lower
        self.on_delta(Delta("heartbeat", None, None, number, now))

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False, interval: str = "1 second"):
        """Snapshot first, then the stream; returns the streaming query."""
        self.snapshot()
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        trigger = {"availableNow": True} if available_now else {"processingTime": interval}
        return writer.trigger(**trigger).start()


class Reducer:
    """A client's view of a live query: rows by key, kept up by deltas; callbacks get what changed."""

    def __init__(self, key: str, on_change: Callable[[str, dict], None] | None = None) -> None:
        self.key, self.on_change = key, on_change or (lambda op, row: None)
        self.rows: dict[object, dict] = {}
        self.aux: dict[str, list[dict]] = {}
        self.watermark_ns: int | None = None
        self.ready, self.messages = False, []

    def apply(self, delta: Delta) -> None:
        """Take in one delta; its rows are fetched, as a client shows them."""
        if delta.kind == "heartbeat":
            self.watermark_ns = delta.watermark_ns
            return
        if delta.kind in ("ready", "warning", "error"):
            self.ready = self.ready or delta.kind == "ready"
            if delta.message is not None:
                self.messages.append((delta.kind, delta.message))
            return
        new = [r.asDict() for r in delta.rows.toLocalIterator()]
        if delta.alias is not None:
            self.aux[delta.alias] = new
            return
        if delta.kind == "expire":
            for r in new:
                if self.rows.pop(r[self.key], None) is not None:
                    self.on_change("removed", r)
            return
        if delta.kind in ("snapshot", "replace"):
            keys = {r[self.key] for r in new}
            for k in [k for k in self.rows if k not in keys]:
                self.on_change("removed", self.rows.pop(k))
        for r in new:
            old = self.rows.get(r[self.key])
            self.rows[r[self.key]] = r
            if old is None:
                self.on_change("created", r)
            elif old != r:
                self.on_change("updated", r)


def delta_writer(path: str) -> Callable[[Delta], None]:
    """A sink that writes the rows of every delta as JSON text to its own folder, replaced if the batch is run again."""

    def write(d: Delta) -> None:
        if d.rows is not None:
            out = d.rows.select(F.lit(d.kind).alias("op"), F.to_json(F.struct(*d.rows.columns)).alias("row"))
            out.write.mode("overwrite").parquet(f"{path}/batch={d.batch}/table={d.alias or 'primary'}/op={d.kind}")

    return write
