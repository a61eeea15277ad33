"""Streams: request limits, windows, job states, dead letters, growing indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.checkpoints import shared_folder
from tessera.operators.store import TRANSITIONS


def stream_of(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream; its schema is that of the files."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    first = table.select(F.input_file_name().alias("f")).first()
    if first and first["f"].rpartition("/")[2] == name:
        # a stream reads folders only
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def drained(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], checkpoint: str, settings: dict[str, str] | None = None) -> None:
    """Process all that is there and stop; a second call goes on from the checkpoint. The settings hold for this stream only."""
    conf, before = stream.sparkSession.conf, {}
    try:
        for name, value in (settings or {}).items():
            before[name] = conf.get(name, None)
            conf.set(name, value)
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def result(stream: DataFrame, mode: str, keys: list[str] | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """What a stream says once all that is there is read, as a table in the shared folder.

    complete: the last state; append: all rows; update: the last row of each of
    the keys. Each batch has a folder of its own, so that one that is written
    again after a failure replaces itself.
    """
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    out = f"{folder}/out"
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")

    drained(stream, mode, write, f"{folder}/checkpoint", settings)
    rows = spark.read.parquet(out)
    if mode != "update":
        return rows.select(*stream.columns)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*keys, "row.*").select(*stream.columns)


def counts(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Events of a key in tumbling or sliding windows.

    In append and update mode a window's state is dropped once the watermark
    has passed its end, and what comes later is left out; complete mode keeps
    all windows for good.
    """
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(key, window.alias("w")).agg(F.count(F.lit(1)).alias("n"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Events of a key in sessions. Spark has no update mode for these: append says a session once it is over, complete keeps all for good."""
    return events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))


#: The window of requests without a time.
TIMELESS = -(1 << 62)


def limited(requests: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """(client, request_id, n, allowed, retry_after) of requests (client, request_id, ts): a tumbling window's first `limit` pass.

    Those of one batch are counted in order of time and request. The state of a
    client has a count for each window that is not over; a count is dropped when
    the watermark passes the window's end. Requests without a time share a
    window that does not end, and have no retry_after.
    """

    def kept(state: GroupState, counts: dict[int, int]) -> None:
        ends = {w: int((w + 1) * seconds * 1000) for w in counts if w != TIMELESS}
        now = state.getCurrentWatermarkMs()
        counts = {w: n for w, n in counts.items() if ends.get(w, now + 1) > now}
        if not counts:
            if state.exists:
                state.remove()
            return
        state.update((list(counts), list(counts.values())))
        if ends := [ends[w] for w in counts if w in ends]:
            state.setTimeoutTimestamp(min(ends))

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = dict(zip(*state.get, strict=True)) if state.exists else {}
        if state.hasTimedOut:
            kept(state, counts)
            return
        # a client's requests of one batch: they come in parts, not in order
        parts = list(batches)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        ids, window = rows["request_id"].to_numpy(), rows["window_no"].to_numpy()
        order = np.lexsort((ids, rows["ts"].to_numpy(), window))
        window = window[order]
        starts = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        sizes, own = np.diff(np.r_[starts, len(window)]), window[starts].tolist()
        seen = np.array([counts.get(w, 0) for w in own], np.int64)
        n = np.arange(1, len(window) + 1) + np.repeat(seen - starts, sizes)
        counts.update(zip(own, (seen + sizes).tolist(), strict=True))
        kept(state, counts)
        yield pd.DataFrame({"client": key[0], "request_id": ids[order], "n": n, "allowed": n <= limit, "retry_after": rows["left"].to_numpy()[order]})

    at = F.unix_timestamp("ts")
    keyed = requests.withWatermark("ts", "1 minute").select(
        "client", "request_id", "ts", F.coalesce(F.floor(at / seconds), F.lit(TIMELESS)).alias("window_no"), (seconds - F.pmod(at, F.lit(seconds))).alias("left")
    )
    return keyed.groupBy("client").applyInPandasWithState(
        judge, "client long, request_id long, n long, allowed boolean, retry_after long", "windows array<long>, seen array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


#: A job that says nothing for so long (in event time) is forgotten, so that state does not grow for good.
IDLE_DAYS = 30


def job_states(events: DataFrame, idle_days: int = IDLE_DAYS) -> DataFrame:
    """(job_id, status, n_refused) from status events (job_id, status, ts, event_id): a change that is not allowed is refused and counted.

    A job's state is dropped when the watermark has passed its last event by
    `idle_days`; a later event begins it anew.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, refused, last = state.get if state.exists else ("", 0, 0)
        for rows in batches:
            rows = rows.sort_values(["ts", "event_id"])
            for new in rows["status"]:
                if (not status and new == "queued") or new in TRANSITIONS.get(status, ()):
                    status = new
                else:
                    refused += 1
            if len(rows):
                last = max(last, int((rows["ts"].max() - pd.Timestamp(0)).total_seconds() * 1000))
        state.update((status, refused, last))
        end = last + idle_days * 86_400_000
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "n_refused": [refused]})

    return events.withWatermark("ts", "1 day").groupBy("job_id").applyInPandasWithState(
        follow, "job_id long, status string, n_refused long", "status string, refused long, last long", "update", GroupStateTimeout.EventTimeTimeout
    )


def with_dead_letters(good: str, bad: str, is_bad: str, most: int = 3) -> Callable[[DataFrame, int], None]:
    """A writer that puts rows that failed `most` times into a side table and the others into the main one.

    A condition that is null is no failure. Each batch has a folder of its own
    in both tables: one that is written again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        dead = F.coalesce(F.expr(is_bad) & (F.col("retry_count") >= most), F.lit(False))
        for path, rows in ((good, batch.filter(~dead)), (bad, batch.filter(dead))):
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def requeued(bad: DataFrame) -> DataFrame:
    """Dead letters as new work: without their failures, and without the batch that they were in."""
    return bad.drop("batch").withColumn("retry_count", F.lit(0).cast(bad.schema["retry_count"].dataType))
