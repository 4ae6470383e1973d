"""Polling queries under supervision: started again after a failure, stopped
between two batches, their progress observed.

A query that fails is started anew from its checkpoint after a pause (five
minutes by default), any number of times or up to a limit; what its last batch
had not committed is delivered again under the same number, which `ledger` makes
harmless. A stop is asked for by an event or, from another process, by a marker
file in a store that all see; the batch that runs then is waited for.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

PAUSE = 300.0


class Marker:
    """Stands for an event that is set by creating a file."""

    def __init__(self, spark: SparkSession, path: str, poll: float = 1.0):
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path, self.poll = hadoop.Path(path), poll
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def set(self) -> None:
        self._fs.create(self._path, True).close()

    def clear(self) -> None:
        self._fs.delete(self._path, False)

    def is_set(self) -> bool:
        return self._fs.exists(self._path)

    def wait(self, timeout: float) -> bool:
        end = time.monotonic() + timeout
        while not self.is_set():
            left = end - time.monotonic()
            if left <= 0:
                return False
            time.sleep(min(self.poll, left))
        return True


class Progress(StreamingQueryListener):
    """Counts by query name: starts, batches, rows, failures and the last
    error. `rows()` gives them as tuples for a report."""

    def __init__(self):
        self.counts: dict[str, dict] = {}
        self._names: dict[str, str] = {}

    def _of(self, run: str, name: str | None = None) -> dict:
        name = self._names.setdefault(str(run), name or str(run))
        return self.counts.setdefault(name, {"starts": 0, "batches": 0, "rows": 0, "failures": 0, "error": None})

    def onQueryStarted(self, event) -> None:
        self._of(event.runId, event.name)["starts"] += 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        own = self._of(p.runId, p.name)
        own["batches"] += 1
        own["rows"] += max(0, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            own = self._of(event.runId)
            own["failures"] += 1
            own["error"] = event.exception[:300]

    def rows(self) -> list[tuple]:
        return [(name, c["starts"], c["batches"], c["rows"], c["failures"], c["error"]) for name, c in sorted(self.counts.items())]


def drain(query: StreamingQuery, grace: float = 600.0, poll: float = 0.2) -> None:
    """Stop a query when its batch has ended, after `grace` seconds anyway (the
    batch is then delivered again)."""
    end = time.monotonic() + grace
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < end:
        time.sleep(poll)
    query.stop()


def supervise(start: Callable[[], StreamingQuery], stop: threading.Event | Marker | None = None, pause: float = PAUSE, most: int | None = None, grace: float = 600.0, poll: float = 1.0, failed: Callable[[int, Exception], None] | None = None) -> int:
    """Keep a query running until it ends by itself (a trigger of what is
    there), a stop is asked for, or it has failed more than `most` times, which
    raises. Returns the number of failures."""
    stop = stop or threading.Event()
    failures = 0
    while not stop.is_set():
        try:
            query = start()
            while not query.awaitTermination(poll):
                if stop.is_set():
                    drain(query, grace)
                    return failures
            return failures
        except StreamingQueryException as e:
            failures += 1
            if failed:
                failed(failures, e)
            if most is not None and failures > most:
                raise
            stop.wait(pause)
    return failures


def polling(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, name: str, every: str | None = None) -> Callable[[], StreamingQuery]:
    """A start for supervise(): batches go to `each`, from where the checkpoint
    says; every interval, or what is there now."""

    def start() -> StreamingQuery:
        writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(each)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    return start
