"""Event streams: idempotent ingest, status changes, streaks and sessions; each also runs on a batch frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roleflow.session import cut

KEY = ("run_id", "source_key", "external_id")


def observed(spark: SparkSession, folder: str, schema: str, name: str | None = None) -> DataFrame:
    """Files of events as they land, with ``ts`` as an instant that a watermark accepts; with ``name`` those of one table in ``folder``, a file or a folder of files."""
    # A stream takes a single file only by a pattern.
    path = f"{folder}/{{{name}}}" if name else folder
    return spark.readStream.format("parquet").schema(schema).load(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _plain_state(events: DataFrame) -> DataFrame:
    """The stream with state rows of the plain format: these operators refuse the one that keyed state sets for the session."""
    if events.isStreaming:
        events.sparkSession.conf.set("spark.sql.streaming.stateStore.encodingFormat", "unsaferow")
    return events


def once(events: DataFrame, key: tuple[str, ...] = KEY, late: str = "2 days") -> DataFrame:
    """Each event once by its key, within the time that events may be late; state is dropped behind the watermark."""
    events = _plain_state(events)
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(key)) if events.isStreaming else events.dropDuplicates(list(key))


def windowed(events: DataFrame, length: str, late: str = "1 hour") -> DataFrame:
    return _plain_state(events).withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of a source: events less than ``gap`` apart."""
    grouped = _plain_state(events).groupBy("source", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("start_ts"), F.count(F.lit(1)).alias("n"))
    return grouped.select("source", "start_ts", "n")


def in_order(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a key in a batch by time, in one frame; a batch holds few rows of a key, since its trigger bounds it."""
    frames = [f for f in rows if len(f)]
    if frames:
        yield pd.concat(frames).sort_values("ts", kind="stable", ignore_index=True)


def changes(events: DataFrame) -> DataFrame:
    """Status changes of a stream of ``key, ts, status``: the last status of each key is its state."""

    def emit(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for frame in in_order(frames):
            now = frame["status"].astype(object).where(frame["status"].notna(), None)
            before = now.shift()
            before.iloc[0] = last
            before = before.where(before.notna(), None)
            changed = ~((now == before) | (now.isna() & before.isna()))
            state.update((now.iloc[-1],))
            yield pd.DataFrame({"key": key[0], "ts": frame["ts"], "previous": before, "status": now})[changed.to_numpy()]

    return _plain_state(events).groupBy("key").applyInPandasWithState(emit, "key long, ts timestamp, previous string, status string", "last string", "append", "NoTimeout")


def failure_counts(events: DataFrame) -> DataFrame:
    """Failures in a row of each key of a stream ``key, ts, ok``, after each batch that touched it."""

    def count(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for frame in in_order(frames):
            good = frame["ok"].to_numpy(bool).nonzero()[0]
            n = len(frame) - 1 - int(good[-1]) if len(good) else n + len(frame)
        state.update((n,))
        yield pd.DataFrame({"key": [key[0]], "failures": [n]})

    return _plain_state(events).groupBy("key").applyInPandasWithState(count, "key long, failures long", "n long", "update", "NoTimeout")


def without_recent_tombstones(events: DataFrame, days: int = 90, late: str = "2 days") -> DataFrame:
    """Events of a stream ``key, ts, status`` but for archivals, and for what follows one for ``days`` of the events' own time; then the state goes."""

    def keep(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        for frame in in_order(frames):
            archived = (frame["status"] == "archived").to_numpy()
            before = archived.cumsum() - archived
            yield frame[~archived & (before == 0) & (not state.exists)][["key", "ts", "status"]]
            if archived.any():
                state.update(("archived",))
                state.setTimeoutTimestamp(int(frame["ts"][archived].max().timestamp() * 1000) + days * 86_400_000)

    marked = _plain_state(events).withWatermark("ts", late)
    return marked.groupBy("key").applyInPandasWithState(keep, "key long, ts timestamp, status string", "reason string", "append", "EventTimeTimeout")


def write_once(frame: DataFrame, batch_id: int, folder: str) -> None:
    """For foreachBatch: a batch lands in a folder of its own, so a replay overwrites what it wrote."""
    frame.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def resurrect_into(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the state of rows ``id, status, last_seen`` after each batch of sightings ``id, ts``, a version a batch.

    A row that is seen again is alive: archived and expiring ones are unseen again. A replayed batch starts from the version before
    it and writes the same one.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{folder}/version={batch_id}")
        seen = batch.groupBy("id").agg(F.max(F.to_date("ts")).alias("_seen"))
        joined = before.join(seen, "id", "full")
        status = F.when(F.col("_seen").isNotNull() & F.coalesce(F.col("status").isin("archived", "expiring"), F.lit(True)), "unseen").otherwise(F.col("status"))
        after = joined.select("id", status.alias("status"), F.greatest("last_seen", "_seen").alias("last_seen"))
        after.write.mode("overwrite").parquet(f"{folder}/version={batch_id + 1}")

    return put


def deliver(folder: str, send: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows ``id, ...`` are claimed before they are sent, and stamped after.

    What an earlier batch stamped is not sent again; a claim without a stamp, of a run that failed between the two, is released by the replay of its batch.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stamped = spark.read.schema("id long, batch long").parquet(f"{folder}/stamped") if _there(spark, f"{folder}/stamped") else None
        fresh = batch.dropDuplicates(["id"])
        if stamped is not None:
            fresh = fresh.join(stamped.where(F.col("batch") != batch_id), "id", "left_anti")
        claims = f"{folder}/claims/batch={batch_id}"
        fresh.write.mode("overwrite").parquet(claims)
        claimed = spark.read.schema(fresh.schema).parquet(claims)
        send(claimed)
        claimed.select("id").write.mode("overwrite").parquet(f"{folder}/stamped/batch={batch_id}")

    return put


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def unseen(messages: DataFrame, key: str = "message_id", kept: str = "30 days") -> DataFrame:
    """Messages that no earlier poll brought, by their id, for as long as ids are kept."""
    return once(messages, (key,), kept)


def log_events(spark: SparkSession, folder: str, events: DataFrame) -> DataFrame:
    """Append the events ``kind, ref, detail, ts`` that the ledger lacks by kind, ref and ts; what was appended."""
    known = spark.read.schema(events.schema).parquet(folder) if _there(spark, folder) else None
    fresh = events.dropDuplicates(["kind", "ref", "ts"])
    if known is not None:
        fresh = fresh.join(known.select("kind", "ref", "ts"), ["kind", "ref", "ts"], "left_anti")
    fresh = cut(fresh)
    fresh.write.mode("append").parquet(folder)
    return fresh
