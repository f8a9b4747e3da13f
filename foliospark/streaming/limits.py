"""Rate limits and expiry as keyed state of a stream.

``paced`` holds the limiter of each provider in state: requests of any query wait in one queue a
provider, and a timer lets out one at a time, never closer together than the provider's delay and not before what a
Retry-After answer asked for. Queue, last call and hold survive restarts with the checkpoint, so
two queries of a provider can't each keep a clock of their own. ``remembered`` tells for each page whether
its cache key was seen within the time to live; the state expires by itself. A provider's
queue is one key, since its limit is; keys of the cache are spread by the key.
Both need the RocksDB state store (``state_store``) and a query that keeps running: state of processing time always
asks for another batch, so one that is to stop when nothing is new (``availableNow``) would not.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A request to pace, or (with ``retry_after`` seconds) an answer that asks for a wait.
SIGNAL = "provider_name string, query string, page int, records_per_page int, retry_after double"
PACED = "provider_name string, query string, page int, records_per_page int, slot long, send_at timestamp"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Sets the state store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class Pacer(StatefulProcessor):
    """One provider's queue: requests by number, which one is next, the last call and the earliest next one (milliseconds)."""

    def __init__(self, delays: Mapping[str, float], default: float) -> None:
        self.delays, self.default = dict(delays), default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getMapState("queue", "number long", "query string, page int, records_per_page int")
        self.clock = handle.getValueState("clock", "head long, tail long, last long, hold long, timer long")

    def _read(self) -> list[int]:
        return list(self.clock.get()) if self.clock.exists() else [0, 0, -1, 0, -1]

    def _set_timer(self, clock: list[int], delay: int, now: int) -> None:
        """The one timer of a queue that isn't empty: when its next request may go."""
        head, tail, last, hold, timer = clock
        due = max(now + 1, hold, last + delay if last >= 0 else 0)
        if timer >= 0 and (head == tail or timer != due):
            self.handle.deleteTimer(timer)
            clock[4] = timer = -1
        if head < tail and timer < 0:
            self.handle.registerTimer(due)
            clock[4] = due

    def _delay(self, key: Any) -> int:
        return round(1000 * self.delays.get(key[0], self.default))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        clock, now = self._read(), timerValues.getCurrentProcessingTimeInMs()
        for frame in rows:
            for r in frame.sort_values(["query", "page"], kind="stable").itertuples():
                if pd.notna(r.retry_after):
                    clock[3] = max(clock[3], now + round(1000 * r.retry_after))
                else:
                    size = None if pd.isna(r.records_per_page) else int(r.records_per_page)
                    self.queue.updateValue((clock[1],), (r.query, int(r.page), size))
                    clock[1] += 1
        self._set_timer(clock, self._delay(key), now)
        self.clock.update(tuple(clock))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        clock, now = self._read(), timerValues.getCurrentProcessingTimeInMs()
        clock[4] = -1
        number = clock[0]
        query, page, size = self.queue.getValue((number,))
        self.queue.removeKey((number,))
        clock[0], clock[2] = number + 1, max(now, expiredTimerInfo.getExpiryTimeInMs())
        self._set_timer(clock, self._delay(key), now)
        self.clock.update(tuple(clock))
        row = {"provider_name": key[0], "query": query, "page": page, "records_per_page": size, "slot": number, "send_at": pd.Timestamp(clock[2], unit="ms")}
        yield pd.DataFrame([row]).astype({"page": "int32", "records_per_page": "Int32"})

    def close(self) -> None:
        """Nothing is open."""


def paced(signals: DataFrame, delays: Mapping[str, float], default: float = 6.1) -> DataFrame:
    """A stream of requests and of Retry-After answers (columns of ``SIGNAL``) -> the requests when they may be sent."""
    named = signals.where(F.col("provider_name").isNotNull() & (F.col("retry_after").isNotNull() | F.col("page").isNotNull()))
    return named.groupBy("provider_name").transformWithStateInPandas(Pacer(delays, default), PACED, "append", "processingTime")


class Memory(StatefulProcessor):
    """What a key's page held, for ``ttl`` milliseconds from when it was last stored."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.content = handle.getValueState("content", "content string", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            kept = []
            for content in frame["content"]:
                hit = self.content.exists()
                if not hit and content is not None:
                    self.content.update((content,))
                kept.append((key[0], self.content.get()[0] if hit else content, hit))
            yield pd.DataFrame(kept, columns=["cache_key", "content", "hit"])

    def close(self) -> None:
        """Nothing is open."""


def remembered(pages: DataFrame, ttl: float) -> DataFrame:
    """A stream of pages(cache_key, content) -> the same with ``hit``: a page of that key came within ``ttl`` seconds.

    A hit has the content that was stored; a miss stores its own, unless it is null. Rows without a key are left out.
    """
    keyed = pages.where(F.col("cache_key").isNotNull()).select("cache_key", "content")
    return keyed.groupBy("cache_key").transformWithStateInPandas(Memory(round(1000 * ttl)), "cache_key string, content string, hit boolean", "append", "processingTime")
