"""Debounced, suppressed and changed-only view events, over tables and streams (STR-1 to STR-5).

Waits are in milliseconds. A stream's state is bounded by a watermark, which is this engine's own rule: events later than LATENESS are dropped.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from notemill.operators.ranks import running

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

WAIT_MS, QUIET_MS, LATENESS = 180, 600, "10 minutes"
NEVER = -(1 << 62)


def debounced(events: DataFrame, keys: list[str], ts: str, order: str, keep: Callable[[DataFrame], DataFrame], wait_ms: int = WAIT_MS) -> DataFrame:
    """STR-1: the events that no other of their keys follows within the wait. Rows are compared with the ones after them over ranges (see ranks.running), so a key may have any number of events."""
    back = events.withColumns({"__us": F.unix_micros(F.col(ts).cast("timestamp")), "__last": -F.unix_micros(F.col(ts).cast("timestamp")), "__back": -F.col(order)})
    rows = running(back, keys, ["__last", "__back"], keep, {"__next": ("lag", "__us")})
    return rows.where(F.col("__next").isNull() | (F.col("__next") - F.col("__us") >= wait_ms * 1000)).select(*events.columns)


def debounced_stream(events: DataFrame, keys: list[str], ts: str, value: str, wait_ms: int = WAIT_MS, lateness: str = LATENESS) -> DataFrame:
    """STR-1 on a stream: the last value of each burst, when the watermark has passed the burst.

    Sessions that touch are merged, so the gap is a microsecond less than the wait: an event exactly at the wait starts a new burst, as in debounced()."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return rows.groupBy(*keys, F.session_window(ts, f"{wait_ms * 1000 - 1} microseconds").alias("burst")).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts)).drop("burst")


@dataclass
class Viewer:
    """One session's state, its events given in order: the current value, the end of its quiet time, and for each side the value that waits for its time.

    Times are microseconds. An event is ignored in the quiet time, or if its value is null, 0 or current; another replaces what waits on its side and begins the wait anew. What has waited long enough becomes
    current, if it isn't by then, and a quiet time begins.
    """

    wait_us: int
    quiet_us: int
    current: Any = None
    quiet_until: int = NEVER
    waiting: dict[Any, tuple[int, Any, Any]] = field(default_factory=dict)  # side: (due, value, what comes with the event)

    def due(self) -> int | None:
        """When the next waiting value is due."""
        return min((w[0] for w in self.waiting.values()), default=None)

    def fired(self, until: int | None = None) -> Iterator[tuple[int, Any, Any, Any]]:
        """(time, side, value, what came with its event) of what becomes current up to a time, or until nothing waits."""
        while self.waiting:
            due, side = min(((w[0], s) for s, w in self.waiting.items()), key=lambda x: (x[0], str(x[1])))
            if until is not None and due > until:
                return
            _, value, event = self.waiting.pop(side)
            if value != self.current:
                self.current, self.quiet_until = value, due + self.quiet_us
                yield due, side, value, event

    def event(self, at: int, side: Any, value: Any, event: Any) -> Iterator[tuple[int, Any, Any, Any]]:
        """Take one event; what was due until then comes first."""
        yield from self.fired(at)
        if at >= self.quiet_until and value is not None and value != 0 and value != self.current:
            self.waiting[side] = (at + self.wait_us, value, event)


def synced(events: DataFrame, keys: list[str], side: str | None, ts: str, value: str, order: str, wait_ms: int = WAIT_MS, quiet_ms: int = QUIET_MS) -> DataFrame:
    """STR-1 to STR-3 together, over a table: the events whose value became current, with fired_at (microseconds since the epoch).

    Each side of a session has its own wait; the quiet time and the current value are the session's. What is taken depends on what was taken before, so a session's events are read in order; they
    are streamed through a sorted partition, and only the session's state is held.
    """
    names = events.columns
    rows = events.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    schema = T.StructType([*events.schema.fields, T.StructField("fired_at", T.LongType())])
    at = {c: names.index(c) for c in {*keys, value, *([side] if side else [])}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viewer, session = None, None
        last: pa.RecordBatch | None = None
        for batch in batches:
            # events that wait over the end of a batch are kept as one-row batches
            done: list[tuple[pa.RecordBatch, int]] = []
            columns = {c: batch.column(i).to_pylist() for c, i in at.items()}
            stamps = batch.column(len(names)).to_pylist()
            for i, us in enumerate(stamps):
                own = tuple(columns[k][i] for k in keys)
                if viewer is None or own != session:
                    done += [(row, due) for due, _, _, row in viewer.fired()] if viewer is not None else []
                    viewer, session = Viewer(wait_ms * 1000, quiet_ms * 1000), own
                if us is not None:
                    done += [(row, due) for due, _, _, row in viewer.event(us, columns[side][i] if side else None, columns[value][i], batch.slice(i, 1))]
            last = batch
            yield from _fired_rows(done, len(names), schema)
        if viewer is not None and last is not None:
            yield from _fired_rows([(row, due) for due, _, _, row in viewer.fired()], len(names), schema)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "__us", order).mapInArrow(run, schema)


def _fired_rows(done: list[tuple[pa.RecordBatch, int]], width: int, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    if done:
        rows = pa.Table.from_batches([r for r, _ in done]).combine_chunks()
        columns = [rows.column(i).combine_chunks() for i in range(width)] + [pa.array([due for _, due in done], pa.int64())]
        yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=schema.names)


def suppressed(events: DataFrame, keys: list[str], ts: str, value: str, order: str, quiet_ms: int = QUIET_MS) -> DataFrame:
    """STR-2, STR-3 over a table: the events taken; those in the quiet time after a taken one, of the current value, null or 0 are not."""
    return synced(events, keys, None, ts, value, order, 0, quiet_ms).drop("fired_at")


class _Viewers(StatefulProcessor):
    """The viewers of a stream. Events wait in a buffer until the watermark has passed them, so they are taken in order of their times, however they arrive."""

    def __init__(self, session: str, side: str | None, ts: str, value: str, order: str | None, wait_ms: int, quiet_ms: int, kinds: dict[str, str], columns: list[str]):
        self.session, self.side, self.ts, self.value, self.order = session, side, ts, value, order
        self.wait_us, self.quiet_us, self.kinds, self.columns = wait_ms * 1000, quiet_ms * 1000, kinds, columns

    def init(self, handle: Any) -> None:
        self.handle = handle
        kind = lambda c: f"{c} {self.kinds[self.names()[c]]}"
        some = ", ".join(kind(c) for c in self.names() if c != "session")
        self.state = handle.getValueState("viewer", f"current {self.kinds[self.value]}, quiet_until long")
        self.buffer = handle.getListState("events", f"us long, {some}")
        self.waits = handle.getListState("waiting", f"due long, us long, {some}")

    def names(self) -> dict[str, str]:
        """The names in the state of the columns that are held."""
        return {k: c for k, c in (("session", self.session), ("side", self.side), ("value", self.value), ("place", self.order)) if c is not None}

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Any]:  # noqa: N802, N803
        fresh = []
        columns = [c for c in self.names() if c != "session"]
        for frame in rows:
            stamps = frame[self.ts].astype("datetime64[us]").astype("int64").tolist()
            fresh += list(zip(stamps, *([plain(v, self.kinds[n]) for v in frame[n]] for c in columns for n in [self.names()[c]]), strict=True))
        yield from self.released(key, fresh, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Any]:  # noqa: N802, N803
        yield from self.released(key, [], timerValues)

    def released(self, key: Any, fresh: list[tuple[Any, ...]], timers: Any) -> Iterator[Any]:
        import pandas as pd

        mark = max(timers.getCurrentWatermarkInMs(), 0) * 1000
        columns = [c for c in self.names() if c != "session"]
        at = {c: i + 1 for i, c in enumerate(columns)}
        side = lambda e: e[at["side"]] if "side" in at else None
        events = sorted([*(tuple(e) for e in self.buffer.get()), *fresh], key=lambda e: (e[0], e[at["place"]] if "place" in at else 0))
        ready = [e for e in events if e[0] < mark]
        current, quiet = self.state.get() if self.state.exists() else (None, NEVER)
        viewer = Viewer(self.wait_us, self.quiet_us, current, quiet, {side(w[1:]): (w[0], w[1:][at["value"]], tuple(w[1:])) for w in self.waits.get()})
        made = [f for e in ready for f in viewer.event(e[0], side(e), e[at["value"]], e)]
        made += viewer.fired(mark)
        self.state.update((viewer.current, viewer.quiet_until))
        self.buffer.put([e for e in events if e[0] >= mark]) if len(ready) < len(events) else self.buffer.clear()
        waiting = [(due, *event) for due, _, event in viewer.waiting.values()]
        self.waits.put(waiting) if waiting else self.waits.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        following = [e[0] + 1 for e in events[len(ready) :][:1]] + [due for due in [viewer.due()] if due is not None]
        if following:
            self.handle.registerTimer(-(-min(following) // 1000))
        if made:
            out = {self.session: [key[0]] * len(made), self.ts: pd.to_datetime([e[0] for *_, e in made], unit="us"), "fired_at": [due for due, *_ in made]}
            out |= {self.names()[c]: [e[at[c]] for *_, e in made] for c in columns}
            yield pd.DataFrame(out)[self.columns]

    def close(self) -> None:
        pass


def plain(v: Any, kind: str) -> Any:
    """A value of a frame as the state takes it: no NumPy types, missing as None, and whole numbers whole (a frame with missing ones has them as floats)."""
    v = v.item() if hasattr(v, "item") else v
    if v is None or v != v:
        return None
    return int(v) if kind in ("tinyint", "smallint", "int", "bigint") else v


def synced_stream(events: DataFrame, session: str, side: str | None, ts: str, value: str, order: str | None = None, wait_ms: int = WAIT_MS, quiet_ms: int = QUIET_MS, lateness: str = LATENESS) -> DataFrame:
    """STR-1 to STR-3 on a stream: the rows that synced() gives for the same events, each when the watermark has passed it, in any order of arrival within the lateness.

    A session keeps its current value for good, as a viewer does; besides, it holds the events that the watermark hasn't passed. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    held = [c for c in dict.fromkeys((session, ts, side, value, order)) if c is not None]
    kinds = {c: events.schema[c].dataType.simpleString() for c in held}
    columns = [*held, "fired_at"]
    schema = ", ".join(f"`{c}` {'timestamp' if c == ts else kinds[c]}" for c in held) + ", fired_at long"
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).select(*held)
    return rows.groupBy(session).transformWithStateInPandas(statefulProcessor=_Viewers(session, side, ts, value, order, wait_ms, quiet_ms, kinds, columns), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def suppressed_stream(events: DataFrame, key: str, ts: str, value: str, quiet_ms: int = QUIET_MS, lateness: str = LATENESS, order: str | None = None) -> DataFrame:
    """STR-2, STR-3 on a stream: (key, ts, value and order) of the events that suppressed() takes."""
    return synced_stream(events, key, None, ts, value, order, 0, quiet_ms, lateness).drop("fired_at")


def changed_files(spark: SparkSession, folder: str, pattern: str = "*.md", settle_ms: int | None = None, files_per_task: int | None = None) -> DataFrame:
    """STR-4: a stream of the files (path, name below the folder, content, modified) that come to a folder or change in it, once for each time that they are found changed."""
    from notemill.streaming.files import ChangedFiles

    spark.dataSource.register(ChangedFiles)
    options = {"folder": folder, "pattern": pattern, "settle_ms": settle_ms, "files_per_task": files_per_task}
    return spark.readStream.format(ChangedFiles.name()).options(**{k: v for k, v in options.items() if v is not None}).load()


def page_of_heading(heading: Column, label: str = "슬라이드") -> Column:
    """STR-5: the page that a slide's heading names; null if it names none."""
    return F.try_to_number(F.nullif(F.regexp_extract(heading, rf"{label}\s+(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int")
