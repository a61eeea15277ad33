"""A cache as a stream: entries live for some time from their last use and then go from the state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: transformWithState needs this store.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
UNIX = pd.Timestamp(0)


class SlidingCache(StatefulProcessor):
    """Of each key the last use, as milliseconds; a timer takes it away once the watermark is past its time."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "used long, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a key's lookups of one batch; they come in parts, not in order
        frame = pd.concat(list(rows)).sort_values(["ts", "request_id"])
        used, timer = self.last.get() if self.last.exists() else (None, None)
        now, hits, ages = ((frame["ts"] - UNIX) // pd.Timedelta(milliseconds=1)).tolist(), [], []
        for ms in now:
            alive = used is not None and ms < used + self.ttl_ms
            hits.append(alive)
            ages.append((ms - used) / 1000 if alive else None)
            # a lookup that is late does not shorten the entry's time
            used = ms if used is None else max(used, ms)
        end = used + self.ttl_ms
        if end != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if end > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(end)
        self.last.update((used, end))
        if end <= timerValues.getCurrentWatermarkInMs():
            self.last.clear()
        yield pd.DataFrame({"key": key[0], "request_id": frame["request_id"].to_numpy(), "hit": hits, "idle": pd.array(ages, "Float64").astype(object)})

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        used, timer = self.last.get() if self.last.exists() else (None, None)
        if timer is not None and timer <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def cached(lookups: DataFrame, ttl: int, late: str = "1 minute") -> DataFrame:
    """(key, request_id, hit, idle) of a stream of lookups (key, request_id, ts): whether the key's entry is alive, and how long it was not used.

    An entry lives `ttl` seconds from its last use, a miss makes a new one, and
    each lookup renews it. Once the watermark, `late` behind the newest lookup,
    is past an entry's time, its state goes, so that state holds the keys of one
    time to live. Lookups with a null key or time take no part; those of one
    batch and key are taken in order of time and request. The stream must be
    started with the settings ROCKS.
    """
    seconds = lookups.schema["key"].dataType.simpleString(), lookups.schema["request_id"].dataType.simpleString()
    kept = lookups.filter("key IS NOT NULL AND ts IS NOT NULL").select("key", "request_id", "ts").withWatermark("ts", late)
    return kept.groupBy("key").transformWithStateInPandas(SlidingCache(ttl * 1000), "key {}, request_id {}, hit boolean, idle double".format(*seconds), "append", "eventtime")


def hit_rates(found: DataFrame, key: str = "key") -> DataFrame:
    """(key, n, hits, rate) of the lookups of a table."""
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits")).withColumn("rate", F.round(F.col("hits") / F.col("n"), 4))
