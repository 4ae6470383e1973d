"""External services: page fetches, searches and model calls, as partition
functions with an injected callable. They are the only Python on row data here,
run once per distinct key after all cheap filters, and sit behind a staged
table, so the optimiser neither repeats nor reorders them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.store import staged

Fetch = Callable[[str], tuple[int, str]]
Ask = Callable[[str], str]


def fetch(urls: DataFrame, get: Fetch, partitions: int = 32) -> DataFrame:
    """urls: url -> url, status_code, body, error. One partition serves a
    domain, so that a source is asked by one caller at a time."""
    rows = urls.select("url").distinct().withColumn("_domain", T.authority(F.col("url"))).repartition(partitions, "_domain")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for url in b["url"]:
                try:
                    code, body = get(url)
                    out.append((url, code, body, None if code < 400 else f"HTTP {code}"))
                except Exception as e:  # a failed source must not fail the batch
                    out.append((url, None, None, str(e)[:300]))
            yield pd.DataFrame(out, columns=["url", "status_code", "body", "error"])

    return staged(rows.mapInPandas(run, "url string, status_code int, body string, error string"))


def ask(prompts: DataFrame, models: list[Ask], key: str = "id") -> DataFrame:
    """prompts: key, prompt -> key, answer: the JSON object of the first model
    that gives one, else "{}"."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = []
            for p in b["prompt"]:
                found = "{}"
                for model in models:
                    try:
                        text = model(p) or ""
                        start, end = text.find("{"), text.rfind("}")
                        if 0 <= start < end:
                            json.loads(text[start : end + 1])
                            found = text[start : end + 1]
                            break
                    except Exception:
                        continue
                answers.append(found)
            yield pd.DataFrame({key: b[key], "answer": answers})

    return staged(prompts.select(key, "prompt").mapInPandas(run, f"{key} {dict(prompts.dtypes)[key]}, answer string"))


def search_ladder(keys: DataFrame, cache: DataFrame, free: Ask, paid: Ask | None, as_of, budget: int = 900, days: int = 30) -> DataFrame:
    """keys: cache_key, query, tier -> cache_key, results_json, backend. Fresh
    cache entries first; then the free backend; then, for tier 1 and within the
    budget of calls, the paid one for what is still empty; tier 3 asks nobody."""
    from ..operators.lookups import from_cache

    hits, rest = from_cache(keys.dropDuplicates(["cache_key"]), cache, as_of, days)

    def call(backend: Ask):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for q in b["query"]:
                    try:
                        out.append(backend(q) or "[]")
                    except Exception:
                        out.append("[]")
                yield pd.DataFrame({"cache_key": b["cache_key"], "tier": b["tier"], "query": b["query"], "results_json": out})

        return run

    schema = "cache_key string, tier int, query string, results_json string"
    first = staged(rest.where("tier < 3").select("cache_key", "tier", "query").mapInPandas(call(free), schema))
    empty = F.col("results_json") == "[]"
    out = hits.select("cache_key", "results_json", F.lit("cache").alias("backend")).union(first.where(~empty).select("cache_key", "results_json", F.lit("free")))
    if paid is not None:
        again = first.where(empty & (F.col("tier") == 1)).orderBy("cache_key").limit(budget)
        second = staged(again.select("cache_key", "tier", "query").mapInPandas(call(paid), schema))
        out = out.union(second.where(~empty).select("cache_key", "results_json", F.lit("paid")))
    done = out.select("cache_key")
    return out.union(keys.dropDuplicates(["cache_key"]).join(done, "cache_key", "left_anti").select("cache_key", F.lit("[]"), F.lit("none")))
