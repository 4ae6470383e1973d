"""Duplicates across batches and inside one.

`greedy` accepts rows in arrival order unless an accepted row has their url or
(for titles that are no template) their title. A row rejected for its title
never claims its url, so this is no pair of window functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .store import release, staged


def unseen(df: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose url hash is not among seen (url_hash)."""
    return df.withColumn("url_hash", T.url_hash(F.col(url))).join(seen.select("url_hash").distinct(), "url_hash", "left_anti")


def fresh_titles(df: DataFrame, events: DataFrame, as_of: Column, hours: int, title: str = "title", found: str = "discovered_date") -> DataFrame:
    """Rows whose title no event within the horizon has; templated and empty
    titles always stay."""
    known = events.where(F.col(found) >= as_of - F.expr(f"INTERVAL {int(hours)} HOURS")).select(T.title_key(F.col(title)).alias("_title")).distinct()
    key = T.title_key(F.col(title))
    kept = F.when((key != "") & ~T.is_templated(F.col(title)), key)
    return df.withColumn("_title", kept).join(known, "_title", "left_anti").drop("_title")


def title_groups(df: DataFrame, key: str = "id", title: str = "title", companies: Column | None = None, graded: Column | None = None, found: str = "discovered_at") -> DataFrame:
    """Groups of equal titles: keep_rank 1 is the copy to keep (enriched, then
    graded, then oldest), 2 any other, copies the size of the group. Rows that
    cannot be duplicates have keep_rank 1. One aggregation with partial results
    and a join, so that a title with very many copies stays in pieces."""
    t = T.title_key(F.col(title))
    real = (t != "") & ~T.is_templated(F.col(title))
    rich = F.lit(0) if companies is None else F.coalesce(companies.cast("int"), F.lit(0))
    good = F.lit(0) if graded is None else F.coalesce(graded.cast("int"), F.lit(0))
    place = F.struct((-rich).alias("rich"), (-good).alias("good"), F.col(found).alias("found"), F.col(key).alias("key"))
    out = df.withColumns({"_group": F.when(real, F.md5(t.cast("binary"))), "_place": place})
    best = out.where("_group is not null").groupBy("_group").agg(F.min("_place").alias("_best"), F.count("*").alias("copies")).where("copies > 1")
    out = out.join(best, "_group", "left")
    rank = F.when(F.col("_best").isNull() | F.col("_place").eqNullSafe(F.col("_best")), 1).otherwise(2)
    return out.withColumns({"keep_rank": rank, "copies": F.coalesce("copies", F.lit(1).cast("long"))}).drop("_group", "_place", "_best")


def greedy(df: DataFrame, url: str = "url", title: str = "title", order: str = "arrival_seq") -> DataFrame:
    """Rows accepted by the greedy rule; `order` is unique and a whole number.

    In rounds, by joins alone: of the rows that are undecided, each that comes
    first under all its keys is accepted, and whoever shares a key with it is
    rejected. An accepted row is the first of its keys whatever is decided
    elsewhere, so all rounds together accept what a scan in order would. Rows
    that share no key never move. A round settles every key whose first row is
    settled; the number of rounds is that of the longest chain of rows each of
    which waits for the one before it."""
    t = T.title_key(F.col(title))
    real = F.when((t != "") & ~T.is_templated(F.col(title)), F.concat(F.lit("t"), F.md5(t.cast("binary"))))
    keys = F.array_compact(F.array(F.concat(F.lit("u"), T.url_hash(F.col(url))), real))
    flat = df.select(F.col(order).cast("long").alias("at"), F.explode(keys).alias("key"))
    shared = flat.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    flat = flat.join(shared, "key")
    left = staged(flat.join(flat.groupBy("at").agg(F.count("*").alias("keys")), "at"))  # keys: how many a row has
    gone = []
    while True:
        first = left.groupBy("key").agg(F.min(F.struct("at", "keys")).alias("f")).select("key", F.col("f.at").alias("at"), F.col("f.keys").alias("keys"))
        accepted = first.groupBy("at", "keys").agg(F.count("*").alias("n")).where("n = keys").select("at")
        claimed = first.join(accepted, "at").select("key")
        decided = left.join(claimed, "key").select("at").distinct()
        decided = staged(decided.join(accepted.withColumn("accepted", F.lit(True)), "at", "left"))
        gone.append(decided.where("accepted is null").select("at"))
        before, left = left, staged(left.join(decided.select("at"), "at", "left_anti"))
        release(before)
        if left.isEmpty():
            release(left)
            break
    rejected = reduce(DataFrame.union, gone)
    return df.withColumn("_at", F.col(order).cast("long")).join(rejected.withColumnRenamed("at", "_at"), "_at", "left_anti").drop("_at")
