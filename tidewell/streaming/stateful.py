"""Streams: counts by window, de-duplication, rate limits, breakers, budgets
and the micro-batch cycle. Each state machine is one pure function that both
the batch twin (`applyInPandas`) and the stream (`applyInPandasWithState`) use.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import slices

BACKOFF_CODES = (429, 503, 502, 500)


def windowed_counts(df: DataFrame, ts: str, late: str, size: str, keys: tuple[str, ...] = (), slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; works on streams and tables."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, size, slide or size), *keys).agg(F.count("*").alias("n"))


def sessions(df: DataFrame, ts: str, late: str, gap: str, key: str) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def first_by_key(df: DataFrame, ts: str, horizon: str, keys: list[str]) -> DataFrame:
    """First rows by key within the horizon (bounded state)."""
    return df.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


def not_too_old(df: DataFrame, ts: str, as_of: Column, hours: int) -> DataFrame:
    """Explicit age filter; the watermark only bounds state."""
    return df.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {int(hours)} HOURS"))


# ---------------------------------------------------------------- budgets


def sliding_cap(df: DataFrame, ts: str, tie: str, key: str, cap: int, window: str = "1 hour") -> DataFrame:
    """n_window: calls of the key in the hour up to each call; within: under
    the cap. A day of a key is counted at a time."""
    return slices.over_time(df, key, ts, _micros(window), F.count("*"), "n_window").withColumn("within", F.col("n_window") <= cap)


def _micros(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")] * 1_000_000


def month_budget(df: DataFrame, ts: str, tie: str, budget: int, key: str | None = None) -> DataFrame:
    """n_month: running count inside the calendar month; over: beyond it. The
    count before each hour comes from the hours' totals, so that no task holds
    more than an hour of a month."""
    own = [key] if key else []
    rows = df.withColumns({"month": F.date_format(ts, "yyyy-MM"), "_hour": F.date_trunc("hour", ts)})
    hours = rows.groupBy(*own, "month", "_hour").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*own, "month").orderBy("_hour").rowsBetween(W.unboundedPreceding, -1)
    hours = hours.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = W.partitionBy(*own, "month", "_hour").orderBy(ts, tie).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("_n", F.count("*").over(inside)).join(hours, [*own, "month", "_hour"])
    return out.withColumn("n_month", F.col("_before") + F.col("_n")).withColumn("over", F.col("n_month") > budget).drop("_hour", "_before", "_n")


# ---------------------------------------------------------------- state machines


def limiter(state: tuple, attempt: tuple, base: float = 1.0, most: float = 300.0, factor: float = 2.0, retries: int = 4, memory: float = 3600.0) -> tuple[tuple, tuple]:
    """One attempt of a source. state: (last, failures, blocked_until); attempt:
    (seconds, ok, code or None). Returns the state after it and (wait, decision,
    backoff)."""
    last, failures, until = state
    now, ok, code = attempt
    wait = max(0.0, until - now)
    begin = now + wait
    if failures >= retries:
        if last is not None and begin - last < memory:
            return state, (wait, "give_up", 0.0)
        failures = 0
    if last is not None and begin - last < base:
        wait += base - (begin - last)
        begin = now + wait
    if ok:
        return (begin, 0, 0.0), (wait, "ok", 0.0)
    if code is None or code in BACKOFF_CODES:
        failures += 1
        backoff = min(base * factor**failures, most)
        return (begin, failures, begin + backoff), (wait, "backoff", backoff)
    return (begin, failures, until), (wait, "failed", 0.0)


def breaker(state: tuple, attempt: tuple, empties: int = 6, rest: float = 900.0) -> tuple[tuple, tuple]:
    """state: (streak, open_until); attempt: (seconds, got). Six empty answers
    in a row open the breaker for fifteen minutes."""
    streak, until = state
    now, got = attempt
    if now < until:
        return state, ("skipped", streak)
    streak = 0 if got else streak + 1
    if streak >= empties:
        return (0, now + rest), ("opened", empties)
    return (streak, until), ("called", streak)


def health_step(state: tuple, check: tuple) -> tuple[tuple, tuple]:
    """state: (total, good, fails in a row, events); check: (ok, events)."""
    total, good, streak, events = state
    ok, found = check
    total, good = total + 1, good + bool(ok)
    streak, events = (0, events + found) if ok else (streak + 1, events)
    rate = good / total
    label = "unknown" if total < 3 else "unhealthy" if streak >= 3 or rate < 0.5 else "degraded" if rate < 0.9 else "healthy"
    return (total, good, streak, events), (total, good, streak, events, label)


MACHINES: dict[str, tuple[Callable, tuple, list[str], str, str]] = {
    # name: (step, first state, columns of an attempt, output columns, state schema)
    "limiter": (limiter, (None, 0, 0.0), ["seconds", "ok", "code"], "wait double, decision string, backoff double", "last double, failures int, until double"),
    "breaker": (breaker, (0, 0.0), ["seconds", "got"], "decision string, streak int", "streak int, until double"),
    "health": (health_step, (0, 0, 0, 0), ["ok", "events"], "total long, good long, streak long, events_total long, status string", "total long, good long, streak long, events long"),
}


def _plain(row: tuple) -> tuple:
    return tuple(None if v is None or v != v else v for v in row)


def replay(df: DataFrame, machine: str, key: str, order: list[str]) -> DataFrame:
    """The batch twin: each key's rows in order through the machine; order
    columns and the machine's outputs."""
    step, first, columns, out, _ = MACHINES[machine]
    types = dict(df.dtypes)
    schema = ", ".join([f"{key} {types[key]}", *(f"{o} {types[o]}" for o in order), out])
    names = [x.split()[0] for x in out.split(", ")]
    kept = [key, *order]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        state, rows = first, []
        for attempt in pdf[columns].itertuples(index=False, name=None):
            state, result = step(state, _plain(attempt))
            rows.append(result)
        return pd.concat([pdf[kept].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return df.select(*dict.fromkeys([*kept, *columns])).groupBy(key).applyInPandas(run, schema)


def live(df: DataFrame, machine: str, key: str, order: list[str]) -> DataFrame:
    """The stream: the same machine with its state kept by key. Rows of one
    micro-batch are taken in order; update mode."""
    step, first, columns, out, state_schema = MACHINES[machine]
    types = dict(df.dtypes)
    kept = [key, *order]
    schema = ", ".join([*(f"{c} {types[c]}" for c in kept), out])
    names = [x.split()[0] for x in out.split(", ")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        state = _plain(store.get) if store.exists else first
        pdf = pd.concat(list(batches)).sort_values(order)
        rows = []
        for attempt in pdf[columns].itertuples(index=False, name=None):
            state, result = step(state, _plain(attempt))
            rows.append(result)
        store.update(state)
        yield pd.concat([pdf[kept].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return df.select(*dict.fromkeys([*kept, *columns])).groupBy(key).applyInPandasWithState(run, schema, state_schema, "update", "NoTimeout")


# ---------------------------------------------------------------- the cycle


def run_stream(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """foreachBatch with a checkpoint; available data once, or every interval."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def alert_once(sent: Callable[[], DataFrame], send: list[Callable[[DataFrame], None]], mark: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A batch step that alerts what was not alerted before, hands it to every
    handler (one that fails does not stop the others), and marks it."""

    def step(batch: DataFrame, _: int) -> None:
        new = batch.join(sent().select("id"), "id", "left_anti").dropDuplicates(["id"]).persist()
        done = 0
        for handler in send:
            try:
                handler(new)
                done += 1
            except Exception as e:
                print(f"alert handler failed: {e}")
        if done:
            mark(new.select("id"))
        new.unpersist()

    return step
