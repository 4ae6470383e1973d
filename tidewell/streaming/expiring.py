"""Caches with a time to live as keyed state of a stream.

An entry is held in a value state and goes by itself: at its own time by an
event-time timer, when the watermark passes it (entries are held and timed by
slots of many keys), or, with `clock_seconds`, after a fixed time by the state
store's time to live. What has gone takes no state, so that the store holds what
lives and no more. `transformWithState` needs the RocksDB
state store: start such queries inside `rocksdb()`.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What happens to an entry, by operation: put writes, get reads and counts a
#: hit, clear removes.
PUT, GET, CLEAR = "put", "get", "clear"
ORDER = {PUT: 0, GET: 1, CLEAR: 2}
#: Slots that keys are dealt out to, unless a stream says how many.
SLOTS = 4096
OUT = "cache_key string, at timestamp, outcome string, value string, hits long"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, now and after a
    restart."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def applied(held: tuple | None, r: Row) -> tuple[tuple | None, list[tuple]]:
    """An entry (value, written, expires, hits; none: null) after an operation,
    and what came of it: (at, outcome, value, hits)."""
    kind, at = r.kind, r.at_ms
    came = []
    if held is not None and held[2] is not None and held[2] < at:  # the watermark is behind
        came.append((held[2], "expired", held[0], held[3]))
        held = None
    if kind == PUT and (held is None or held[1] <= at):  # late writes change nothing
        held = (r.value, at, None if r.ttl_ms is None else int(at + r.ttl_ms), 0)
    elif kind == GET:
        if held is None:
            came.append((at, "miss", None, 0))
        else:
            held = (*held[:3], held[3] + 1)
            came.append((at, "hit", held[0], held[3]))
    elif kind == CLEAR and held is not None:
        came.append((at, "cleared", held[0], held[3]))
        held = None
    return held, came


def in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r.at_ms, ORDER[r.kind]))


def outcome(cache_key: str, found: tuple) -> Row:
    at, what, value, hits = found
    return Row(cache_key=cache_key, at=EPOCH + timedelta(milliseconds=at), outcome=what, value=value, hits=hits)


class Clocked(StatefulProcessor):
    """One key's entry, which goes `clock_ms` after its last write by the clock:
    the state store's time to live."""

    def __init__(self, clock_ms: int):
        self.clock_ms = clock_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "value string, written long, expires long, hits long", self.clock_ms)

    def handleInputRows(self, key, rows, timerValues):
        before = held = self.entry.get()
        for r in in_order(rows):
            held, came = applied(held, r)
            yield from (outcome(r.cache_key, c) for c in came)
        if held is None and before is not None:
            self.entry.clear()
        elif held is not None and held != before:
            self.entry.update(held)

    def close(self) -> None:
        pass


class Slot(StatefulProcessor):
    """The live entries of a slot's keys in one value, and one timer for the
    first of them to go: what a batch costs are a few calls to the state store
    for each slot that it touches, and none for each key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", "entries array<struct<cache_key: string, value: string, written: bigint, expires: bigint, hits: bigint>>")

    def _read(self) -> dict[str, tuple]:
        stored = self.entries.get()
        return {e[0]: tuple(e[1:]) for e in stored[0]} if stored else {}

    def _write(self, entries: dict[str, tuple]) -> None:
        if entries:
            self.entries.update(([(k, *e) for k, e in entries.items()],))
        else:
            self.entries.clear()

    @staticmethod
    def _due(entries: dict[str, tuple]) -> int | None:
        """When the first entry goes: a timer fires at a watermark that has
        reached it, an entry lives until it is passed."""
        return min((e[2] + 1 for e in entries.values() if e[2] is not None), default=None)

    def handleInputRows(self, key, rows, timerValues):
        entries = self._read()
        due = self._due(entries)
        for r in in_order(rows):
            held, came = applied(entries.get(r.cache_key), r)
            yield from (outcome(r.cache_key, c) for c in came)
            if held is None:
                entries.pop(r.cache_key, None)
            else:
                entries[r.cache_key] = held
        self._write(entries)
        new = self._due(entries)
        if new != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if new is not None:
                self.handle.registerTimer(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        entries = self._read()
        left = {}
        for cache_key, e in entries.items():
            if e[2] is not None and e[2] < passed:
                yield outcome(cache_key, (e[2], "expired", e[0], e[3]))
            else:
                left[cache_key] = e
        self._write(left)
        due = self._due(left)
        if due is not None:
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


def cache_stream(operations: DataFrame, late: str = "0 seconds", clock_seconds: float | None = None, slots: int = SLOTS) -> DataFrame:
    """operations: cache_key, kind (put, get, clear), at (timestamp), value, ttl
    (seconds, null: for ever) -> what came of them: hits and misses, cleared and
    expired entries. Rows of a key and batch are taken in order of time (at one
    time puts, then gets, then clears); with `clock_seconds` entries go by the
    clock and without a row.

    Keys are dealt out to `slots` by a hash. A batch reads and writes the live
    entries of each slot that it touches: some 1,000 entries a slot are good.
    The number is part of a stream's checkpoint."""
    rows = operations.withWatermark("at", late).select(F.col("cache_key").cast("string").alias("cache_key"), "kind", "at", F.unix_millis(F.col("at")).alias("at_ms"), F.col("value").cast("string").alias("value"), (F.col("ttl") * 1000).cast("double").alias("ttl_ms"))
    if clock_seconds is not None:
        return rows.groupBy("cache_key").transformWithState(Clocked(int(clock_seconds * 1000)), OUT, "append", "processingTime")
    return rows.withColumn("slot", F.pmod(F.xxhash64("cache_key"), F.lit(slots))).groupBy("slot").transformWithState(Slot(), OUT, "append", "eventTime")
