"""Joins: caches with a time to live, provider fallbacks, search spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.text import nz, strip


def firm_key(name: Column, hint: Column) -> Column:
    return F.concat(F.lower(strip(nz(name))), F.lit("||"), F.lower(strip(nz(hint))))


def fresh_cache(cache: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Entries that are younger than `days` whole days."""
    return cache.where(D.whole_days(F.col("cached_at"), as_of) < days)


def from_cache(keys: DataFrame, cache: DataFrame, as_of: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(hits with results_json, keys to look up)."""
    fresh = fresh_cache(cache, as_of, days)
    return keys.join(fresh.select("cache_key", "results_json"), "cache_key"), keys.join(fresh.select("cache_key"), "cache_key", "left_anti")


def live(entries: DataFrame, as_of: Column) -> DataFrame:
    """Cache entries (created_at, ttl seconds) that have not expired."""
    return entries.where(D.seconds_between(F.col("created_at"), as_of) <= F.col("ttl"))


def expire(entries: DataFrame, as_of: Column, category: str | None = None) -> DataFrame:
    """What a clean-up leaves: entries that live, and with a category nothing
    of it (a cleared cache keeps the others')."""
    left = live(entries, as_of)
    return left if category is None else left.where(F.col("category") != category)


def put_results(cache: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """The search cache after new answers (cache_key, results_json): an answer
    replaces the entry of its key, an empty one writes nothing."""
    full = results.where(~nz(F.col("results_json")).isin("", "[]", "null")).select("cache_key", "results_json", as_of.alias("cached_at"))
    return full.unionByName(cache.join(full.select("cache_key"), "cache_key", "left_anti").select("cache_key", "results_json", "cached_at"))


def cache_stats(entries: DataFrame, lookups: DataFrame, as_of: Column) -> DataFrame:
    """One row: entries, expired, bytes; and of lookups (hit) the hit rate."""
    old = D.seconds_between(F.col("created_at"), as_of) > F.col("ttl")
    a = entries.agg(F.count("*").alias("entries"), F.count_if(old).alias("expired"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes"))
    b = lookups.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return a.join(b).withColumn("hit_rate", F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)))  # one row each


def fill_missing(first: Column, second: Column, fields: list[str]) -> Column:
    """A record field by field: the first source's value unless blank."""
    return F.struct(*[F.coalesce(F.nullif(first[f], F.lit("")), F.nullif(second[f], F.lit(""))).alias(f) for f in fields])


def with_fallback(df: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """`info` of provider a, else of provider b."""
    return df.join(a.select(key, F.col("info").alias("_a")), key, "left").join(b.select(key, F.col("info").alias("_b")), key, "left").withColumn("info", F.coalesce("_a", "_b")).drop("_a", "_b")


def once_per_firm(events: DataFrame, companies: str, enrich) -> DataFrame:
    """Look every distinct company up once (enrich: DataFrame of firm, hint ->
    firm, facts) and join the facts back; the first hint of a firm wins."""
    rows = events.select("id", F.posexplode(companies).alias("pos", "c")).withColumn("firm", F.lower(strip(nz(F.col("c.name")))))
    firms = rows.groupBy("firm").agg(F.min_by("c.descriptor", F.struct("id", "pos")).alias("hint"))
    return rows.join(enrich(firms).select("firm", "facts"), "firm", "left")


MOST_PLACES = 10_000


def search_space(titles: DataFrame, places: DataFrame) -> DataFrame:
    """All queries of job titles and places. Places are a small dimension: they
    become an array literal, after a check of their number."""
    found = [r[0] for r in places.select("place").distinct().orderBy("place").limit(MOST_PLACES + 1).collect()]
    if len(found) > MOST_PLACES:
        raise ValueError("too many places for a search space")
    rows = titles.select("title", F.explode(F.array(*map(F.lit, found)).cast("array<string>")).alias("place"))
    return rows.withColumn("query", F.format_string("%s jobs in %s", F.col("title"), F.col("place")))
