"""Side effects of a stream exactly once, by batch number and id.

A batch's new rows, those whose id no other batch has claimed, are written
under the batch's number before anything is sent: an outbox. A batch that is
delivered again finds its claim and takes it as it stands. Every handler leaves
two markers for a batch, begun and done; what is done is not sent again, and
what a handler failed to send is sent before the next batch.

After a crash between a send and its marker nobody knows whether it arrived. A
handler that says it is `repeatable` (the same token again changes nothing, as
with files written under the token's name) is asked again; any other is not:
its batch counts as sent, and is listed by `unknown()`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """Claims and markers in a folder that all nodes see. `run` names a stream:
    batch numbers start again with a new checkpoint. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, run: str = "main", key: str = "id"):
        self.spark, self.path, self.run, self.key = spark, path.rstrip("/"), run, key
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- claims

    def _claim(self, n: int) -> str:
        return f"{self.path}/claims/run={self.run}/batch={n:012d}"

    def _there(self, path: str) -> bool:
        return self._fs.exists(self._hadoop.Path(path))

    def _others(self, n: int, key_type: str) -> DataFrame | None:
        """Keys that other batches have claimed."""
        folder = f"{self.path}/claims"
        if not self._there(folder):
            return None
        rows = self.spark.read.schema(f"`{self.key}` {key_type}, run string, batch long").option("basePath", folder).parquet(folder)
        return rows.where(~((F.col("run") == self.run) & (F.col("batch") == n))).select(self.key)

    def _names(self, folder: str) -> list[str]:
        if not self._there(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(folder)))

    def claim(self, batch: DataFrame, n: int) -> DataFrame:
        """The rows that batch n sends, one for each new id (of several rows
        of an id the least), written and read back."""
        if not self._there(f"{self._claim(n)}/_SUCCESS"):
            rest = [c for c in batch.columns if c != self.key]
            rows = batch.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(F.struct(*rest)).alias("_row")).select(self.key, *[F.col(f"_row.`{c}`").alias(c) for c in rest]) if rest else batch.where(F.col(self.key).isNotNull()).distinct()
            others = self._others(n, dict(batch.dtypes)[self.key])
            if others is not None:
                rows = rows.join(others.distinct(), self.key, "left_anti")
            rows.write.mode("overwrite").parquet(self._claim(n))
        return self.claimed(n)

    def claimed(self, n: int) -> DataFrame:
        return self.spark.read.parquet(self._claim(n))

    def batches(self) -> list[int]:
        """Batches of this run that have claimed; only the newest claim can be
        unfinished."""
        found = [int(b[len("batch=") :]) for b in self._names(f"{self.path}/claims/run={self.run}")]
        return [n for n in found if n < found[-1] or self._there(f"{self._claim(n)}/_SUCCESS")]

    def forget(self, before: int) -> None:
        """Drop claims of batches below a number that all handlers are done
        with: their ids count as new from then on."""
        for n in self.batches():
            if n < before:
                self._fs.delete(self._hadoop.Path(self._claim(n)), True)

    # -- markers

    def _mark(self, handler: str, n: int, what: str) -> str:
        return f"{self.path}/marks/{handler}/run={self.run}/{n:012d}.{what}"

    def is_marked(self, handler: str, n: int, what: str) -> bool:
        return self._there(self._mark(handler, n, what))

    def mark(self, handler: str, n: int, what: str) -> None:
        self._fs.create(self._hadoop.Path(self._mark(handler, n, what)), True).close()

    def unmark(self, handler: str, n: int, what: str) -> None:
        self._fs.delete(self._hadoop.Path(self._mark(handler, n, what)), False)

    def _marked(self, handler: str, what: str) -> set[int]:
        names = self._names(f"{self.path}/marks/{handler}/run={self.run}")
        return {int(x[:12]) for x in names if x.endswith(f".{what}")}

    def open(self, handler: str) -> list[int]:
        """Claimed batches that a handler has not taken, ascending."""
        return sorted(set(self.batches()) - self._marked(handler, "done"))

    def unknown(self, handler: str) -> list[int]:
        return sorted(self._marked(handler, "unknown"))

    def token(self, n: int) -> str:
        """Names a batch's send: the same whenever it is repeated."""
        return f"{self.run}-{n:012d}"


class FileAlerts:
    """Alerts as JSON files in a folder named by the token: a repeated send
    writes the same folder again."""

    repeatable = True

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def __call__(self, rows: DataFrame, token: str) -> None:
        rows.write.mode("overwrite").json(f"{self.path}/token={token}")


def exactly_once(ledger: Ledger, handlers: dict[str, Callable[[DataFrame, str], None]], failed: Callable[[str, int, Exception], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A step for foreachBatch. One handler that fails stops no other; its
    batch stays open and is sent before the next one. When all fail, the step
    fails, and the batch comes again."""

    def deliver(name: str, n: int) -> bool:
        handler = handlers[name]
        if ledger.is_marked(name, n, "done"):
            return True
        if ledger.is_marked(name, n, "begun") and not getattr(handler, "repeatable", False):
            ledger.mark(name, n, "unknown")
            ledger.mark(name, n, "done")
            return True
        ledger.mark(name, n, "begun")
        try:
            handler(ledger.claimed(n), ledger.token(n))
        except Exception as e:
            ledger.unmark(name, n, "begun")
            if failed:
                failed(name, n, e)
            return False
        ledger.mark(name, n, "done")
        return True

    def step(batch: DataFrame, n: int) -> None:
        ledger.claim(batch, n)
        sent = False
        for name in handlers:
            for earlier in ledger.open(name):
                if earlier < n:
                    deliver(name, earlier)
            sent |= deliver(name, n)
        if not sent:
            raise RuntimeError(f"no handler took batch {n}")

    return step
