"""Keyed state of streams: the log of status changes, failure streaks, silent sources, the review cursor and the expected range of runs.

Each is a processor on the state API with its own state per key, and a function that puts it on a stream (or, in one go, on a batch frame). Times go in as
milliseconds (``ms``), so no session's time zone touches them. Rows of a key that come in one micro-batch are taken in the order of ``ms`` and ``id``; between
micro-batches the order of arrival counts. A trigger's size bounds what a micro-batch brings of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from roleflow import vocabulary as V

DAY = 86_400_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """The state store that keyed state needs, with rows that may gain columns between two starts of a query.

    State over a batch frame needs the driver's coordinator of state stores as well, which a session without a stream has only once its streams are asked for.
    """
    _ = spark.streams
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.encodingFormat", "avro")


def _plain(column: pd.Series) -> list:
    return [None if pd.isna(x) else x for x in column.tolist()] if column.hasnans else column.tolist()


def in_order(rows: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """What a micro-batch brings of a key, as tuples in order; nulls are None."""
    found: list[tuple] = []
    for frame in rows:
        found += zip(*[_plain(frame[c]) for c in columns])
    return sorted(found, key=lambda r: r[:2])


def _put(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str, time: str = "None", initial: DataFrame | None = None) -> DataFrame:
    keyed_state(df.sparkSession)
    state = initial.groupBy(key) if initial is not None else None
    return df.groupBy(key).transformWithStateInPandas(processor, schema, mode, time, state)


class StatusLog(StatefulProcessor):
    """Value state: the status a key has, since when, and ``extra`` columns that came with it. Map state: how often it came to each status."""

    def __init__(self, extra: tuple[str, ...] = ()):
        self.extra = list(extra)

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", ", ".join(["status string", "ms long", *(f"{c} string" for c in self.extra)]))
        self.times = handle.getMapState("times", "status string", "n long")

    def _enter(self, status: str | None, counted: dict[tuple, int]) -> int:
        """How often the key has come to ``status``; ``counted`` spares the state a call for each event, and is stored at the end."""
        # A map's key is never null.
        name = ("null",) if status is None else (f"= {status}",)
        if name not in counted:
            counted[name] = self.times.getValue(name)[0] if self.times.containsKey(name) else 0
        counted[name] += 1
        return counted[name]

    def _store(self, counted: dict[tuple, int]) -> None:
        for name, n in counted.items():
            self.times.updateValue(name, (n,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.exists()
        last = self.last.get() if known else None
        out, counted = [], {}
        for ms, id_, status, *extra in in_order(rows, ["ms", "id", "status", *self.extra]):
            if known and last[0] == status:
                continue
            out.append((key[0], id_, ms, last[0] if known else None, status, last[1] if known else None, self._enter(status, counted)))
            known, last = True, (status, ms, *extra)
        if out:
            self.last.update(last)
            self._store(counted)
            yield pd.DataFrame(out, columns=["key", "id", "ms", "previous", "status", "since", "times"]).astype({"since": "Int64"})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        value = lambda c: None if c not in initialState or pd.isna(row[c]) else row[c]
        self.last.update((value("status"), None if value("ms") is None else int(value("ms")), *(value(c) for c in self.extra)))
        counted: dict[tuple, int] = {}
        self._enter(value("status"), counted)
        self._store(counted)

    def close(self) -> None:
        pass


def status_log(events: DataFrame, initial: DataFrame | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Changes in a stream ``key, ms, id, status``: ``key, id, ms, previous, status, since, times``.

    ``since`` is when the previous status began, ``times`` how often the key has come to the new one. ``initial`` has a row ``key, status, ms`` for each key of the
    stored table, whose status then is the one before the first event. A query that restarts with more ``extra`` columns than before goes on from its old state.
    """
    return _put(events, "key", StatusLog(extra), "key long, id long, ms long, previous string, status string, since long, times long", "append", initial=initial)


class FailureStreak(StatefulProcessor):
    """Value state: failures in a row, and the longest such row."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("streak", "n long, longest long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, longest = self.state.get() if self.state.exists() else (0, 0)
        for _, _, ok in in_order(rows, ["ms", "id", "ok"]):
            n = 0 if ok else n + 1
            longest = max(longest, n)
        self.state.update((n, longest))
        yield pd.DataFrame({"key": [key[0]], "failures": [n], "longest": [longest]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        n = int(initialState["failures"].iloc[0])
        self.state.update((n, n))

    def close(self) -> None:
        pass


def failure_streaks(events: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """``key, failures, longest`` of a stream ``key, ms, id, ok`` after each micro-batch that touched the key; ``initial`` is ``key, failures``."""
    return _put(events, "key", FailureStreak(), "key long, failures long, longest long", "update", initial=initial)


class Silence(StatefulProcessor):
    """Value state: the newest sighting of a source and whether the silence after it has been told; a timer goes off where none follows in time."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ms long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, told = self.seen.get() if self.seen.exists() else (None, False)
        first, out = last, []
        for ms in sorted({int(ms) for frame in rows for ms in frame["ms"]}):
            if last is not None and ms <= last:
                continue
            # Sightings far apart may come at once, before the time between them has gone by for the stream.
            if last is not None and ms - last > self.span and not told:
                out.append((key[0], last, last + self.span))
            last, told = ms, False
        if last != first:
            if first is not None:
                self.handle.deleteTimer(first + self.span)
            self.seen.update((last, told))
            self.handle.registerTimer(last + self.span)
        if out:
            yield pd.DataFrame(out, columns=["source", "last_ms", "stale_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, told = self.seen.get()
        if not told:
            self.seen.update((last, True))
            yield pd.DataFrame({"source": [key[0]], "last_ms": [last], "stale_ms": [last + self.span]})

    def close(self) -> None:
        pass


def silent_sources(events: DataFrame, days: float = V.STALE_DAYS, late: str = "1 day") -> DataFrame:
    """``source, last_ms, stale_ms`` of a stream ``source, ts``: once for each time that a source falls silent for ``days`` of event time.

    No new event of the source is needed: event time goes on with the other sources'. A source that speaks again is watched again.
    """
    marked = events.select("source", "ts", F.unix_millis("ts").alias("ms")).withWatermark("ts", late)
    return _put(marked, "source", Silence(round(days * DAY)), "source long, last_ms long, stale_ms long", "append", "EventTime")


class ReviewCursor(StatefulProcessor):
    """Value state: when the last review was completed. List state: the decisions after it, oldest first."""

    def init(self, handle) -> None:
        self.cursor = handle.getValueState("cursor", "ms long")
        self.open = handle.getListState("open", "ms long, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cursor = self.cursor.get()[0] if self.cursor.exists() else None
        new, moved = [], False
        for ms, id_, kind in in_order(rows, ["ms", "id", "kind"]):
            if kind == "reviewed":
                if cursor is None or ms > cursor:
                    cursor, moved = ms, True
            elif kind == "decided":
                new.append((ms, id_))
        new = [r for r in new if cursor is None or r[0] > cursor]
        if moved:
            self.cursor.update((cursor,))
            new = sorted([r for r in self.open.get() if r[0] > cursor] + new) if self.open.exists() else new
            self.open.clear()
        if new:
            self.open.appendList(new)
        waiting = list(self.open.get()) if self.open.exists() else []
        yield pd.DataFrame({"key": [key[0]], "cursor_ms": pd.array([cursor], "Int64"), "open": [len(waiting)], "first_id": pd.array([min(waiting)[1] if waiting else None], "Int64")})

    def close(self) -> None:
        pass


def review_cursor(events: DataFrame) -> DataFrame:
    """``key, cursor_ms, open, first_id`` of a stream ``key, ms, id, kind`` after each micro-batch that touched the key.

    ``open`` counts the decisions after the newest completed review, ``first_id`` is the oldest of them. A ``reviewed`` event empties the list up to its time; a skipped
    review, or one that arrives late, leaves what is after the cursor.
    """
    return _put(events, "key", ReviewCursor(), "key long, cursor_ms long, open long, first_id long", "update")


class ExpectedRange(StatefulProcessor):
    """List state: what the last ``last`` finished runs of a source brought."""

    def __init__(self, last: int):
        self.last = last

    def init(self, handle) -> None:
        self.ring = handle.getListState("ring", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ring = [r[0] for r in self.ring.get()] if self.ring.exists() else []
        out = []
        for ms, run, n, enabled, errored, live in in_order(rows, ["ms", "id", "n", "enabled", "errored", "live"]):
            low, high = (min(ring), max(ring)) if ring else (None, None)
            if n == 0 and enabled:
                verdict = "nothing new"
            elif errored and not live:
                verdict = "all failed"
            else:
                verdict = "no baseline" if low is None else "in range" if low <= n <= high else "out of range"
            out.append((key[0], run, ms, n, low, high, verdict))
            ring = [*ring, n][-self.last :]
        self.ring.put([(x,) for x in ring])
        yield pd.DataFrame(out, columns=["source", "run", "ms", "n", "low", "high", "verdict"]).astype({"low": "Int64", "high": "Int64"})

    def close(self) -> None:
        pass


def run_verdicts(runs: DataFrame, last: int = 10) -> DataFrame:
    """``source, run, ms, n, low, high, verdict`` of a stream of finished runs ``source, ms, id, n, enabled, errored, live``.

    A run that brings less or more than each of the ``last`` before it is out of range; whatever they brought, none may bring nothing while its sources are enabled
    (``nothing new``), or have errors and no live source (``all failed``).
    """
    return _put(runs, "source", ExpectedRange(last), "source long, run long, ms long, n long, low long, high long, verdict string", "append")


#: Verdicts that need no one's attention.
CALM = ("in range", "no baseline")


def watched(verdicts: DataFrame, name: str) -> DataFrame:
    """The same stream, with the metrics ``runs`` and ``alarms`` of each micro-batch under ``name``."""
    return verdicts.observe(name, F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("verdict").isin(*CALM)).alias("alarms"))


class Alarm(StreamingQueryListener):
    """Calls ``raise_alarm(batch_id, alarms)`` for each micro-batch of a watched stream with alarms."""

    def __init__(self, name: str, raise_alarm: Callable[[int, int], None]):
        self.name, self.raise_alarm = name, raise_alarm

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and row["alarms"]:
            self.raise_alarm(event.progress.batchId, row["alarms"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

