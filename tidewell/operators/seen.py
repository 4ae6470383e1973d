"""Seen urls without end, behind Bloom filters by day.

A day's url hashes are a folder of files, and so is its filter: blocks of eight
64-bit words, a row a block that has any bit. A url sets one bit in each word of
its block, so the filters of all days together are the bitwise or of their
blocks, and a candidate is looked up by one join on the block. Only candidates
that the filter may know are compared with the hashes themselves, and they are
sent to the files: what was seen is not shuffled, and not read at all where the
filter knows nobody. At eight bytes a url and day-old urls forgotten by folders,
nothing is rewritten.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

WORDS = 8
#: Rows that are sent to every task; beyond, a join by shuffles.
FEW = 2_000_000


def block_of(url_hash: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url_hash), F.lit(blocks))


def bits_of(url_hash: Column) -> list[Column]:
    """One bit for each word of the block, from a second hash."""
    other = F.xxhash64(F.lit(1), url_hash)
    place = lambda i: F.shiftrightunsigned(other, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place(i)) for i in range(WORDS)]


def blocks_of(hashes: DataFrame, blocks: int) -> DataFrame:
    """The filter of url_hash: block, w0, w1, ...; partial results first."""
    key = F.col("url_hash")
    rows = hashes.select(block_of(key, blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits_of(key))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


class SeenUrls:
    """Url hashes by day in a folder. `blocks` is fixed when the folder is new:
    64 bytes each, one for about 30 urls keeps false hits below one in 100."""

    def __init__(self, spark: SparkSession, path: str, blocks: int = 1 << 20):
        self.spark, self.path, self.blocks = spark, path.rstrip("/"), blocks
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        known = self._names("_blocks")
        if known:
            self.blocks = int(known[0])
        else:
            self._fs.create(self._hadoop.Path(f"{self.path}/_blocks/{blocks}"), True).close()

    def _names(self, folder: str) -> list[str]:
        path = self._hadoop.Path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def days(self) -> list[str]:
        """Days whose hashes and filter are written; the filter comes last."""
        return [x[len("day=") :] for x in self._names("filters") if x.startswith("day=")]

    def add(self, hashes: DataFrame, day: str) -> None:
        """Write a day's url_hash rows, in place of what the day had."""
        rows = hashes.select("url_hash").where("url_hash is not null").distinct()
        rows.write.mode("overwrite").parquet(f"{self.path}/hashes/day={day}")
        written = self.spark.read.schema("url_hash string").parquet(f"{self.path}/hashes/day={day}")
        blocks_of(written, self.blocks).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/filters/day={day}")

    def forget(self, before: str) -> list[str]:
        """Drop days before one, filters first."""
        old = [d for d in self.days() if d < before]
        for kind in ("filters", "hashes"):
            for d in old:
                self._fs.delete(self._hadoop.Path(f"{self.path}/{kind}/day={d}"), True)
        return old

    def read(self) -> DataFrame:
        """url_hash of all days."""
        days = self.days()
        if not days:
            return self.spark.createDataFrame([], "url_hash string")
        return self.spark.read.schema("url_hash string").parquet(*[f"{self.path}/hashes/day={d}" for d in days])

    def filter(self) -> DataFrame:
        """The filters of all days as one."""
        schema = "block long, " + ", ".join(f"w{i} long" for i in range(WORDS))
        days = self.days()
        if not days:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/filters/day={d}" for d in days])
        return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])

    def possible(self, hashes: DataFrame) -> DataFrame:
        """Of url_hash those that the filter may know: all that were seen, and
        a few others."""
        key = F.col("url_hash")
        asked = hashes.select("url_hash").where("url_hash is not null").distinct()
        asked = asked.select("url_hash", block_of(key, self.blocks).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits_of(key))])
        held = reduce(Column.__and__, [F.col(f"w{i}").bitwiseAND(F.col(f"b{i}")) != 0 for i in range(WORDS)])
        return asked.join(_few(self.filter()), "block").where(held).select("url_hash")

    def hits(self, hashes: DataFrame) -> DataFrame:
        """Of url_hash those that were seen, exactly: the few that may be are
        sent to where the hashes are read."""
        return self.read().join(_few(self.possible(hashes)), "url_hash", "left_semi").distinct()

    def unseen(self, df: DataFrame, url: str = "url") -> DataFrame:
        """Rows whose url hash was not seen, with url_hash: dedup.unseen()
        without a shuffle of what was seen."""
        rows = df.withColumn("url_hash", T.url_hash(F.col(url)))
        return rows.join(self.hits(rows), "url_hash", "left_anti")
