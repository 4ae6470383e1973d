"""Source health: counters, states, streaks, checks and their verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import dates as D
from ..functions import vocab as V
from ..functions.text import nz
from . import slices


def error_class(message: Column) -> Column:
    """First class whose words the message contains; other without one."""
    t = F.lower(message)
    out = F.lit("other")
    for name, values in reversed(V.ERROR_CLASSES):
        out = F.when(V.holds_any(t, values), name).otherwise(out)
    return F.when(nz(message) != "", out)


def status(total: Column, successes: Column, streak: Column) -> Column:
    """unknown, unhealthy, degraded or healthy; streak: failures at the end."""
    rate = F.coalesce(F.try_divide(successes, total), F.lit(0.0))
    return F.when(total < 3, "unknown").when((streak >= 3) | (rate < 0.5), "unhealthy").when(rate < 0.9, "degraded").otherwise("healthy")


def final_streaks(checks: DataFrame, source: str, ts: str, ok: str, tie: str) -> DataFrame:
    """source, consecutive_failures, consecutive_successes at the end of each
    source's checks: rows after the last check of the other kind. Two
    aggregations, no window over a source."""
    at = F.struct(F.col(ts).alias("t"), F.col(tie).alias("i"))
    rows = checks.select(F.col(source), at.alias("_at"), F.col(ok).alias("_ok"))
    last = rows.groupBy(source).agg(F.max(F.when(F.col("_ok"), F.col("_at"))).alias("_good"), F.max(F.when(~F.col("_ok"), F.col("_at"))).alias("_bad"))
    joined = rows.join(last, source)
    after = lambda own, other: F.count_if(own & (F.col(other).isNull() | (F.col("_at") > F.col(other))))
    return joined.groupBy(source).agg(after(~F.col("_ok"), "_good").alias("consecutive_failures"), after(F.col("_ok"), "_bad").alias("consecutive_successes"))


def health(checks: DataFrame, source: str = "source_name", ts: str = "check_ts", ok: str = "success", tie: str = "check_id", response: str = "response_time_ms", found: str = "events_found", error: str = "error_message") -> DataFrame:
    """A row a source: counts, rate, streaks, events, last checks, mean of the
    last 100 positive response times, status."""
    good = F.col(ok)
    totals = checks.groupBy(source).agg(
        F.count("*").alias("total_requests"),
        F.count_if(good).alias("successful_requests"),
        F.count_if(~good).alias("failed_requests"),
        F.sum(F.when(good, nz_long(F.col(found))).otherwise(0)).alias("events_found_total"),
        F.max(ts).alias("last_check"),
        F.max(F.when(good, F.col(ts))).alias("last_success"),
        F.max(F.when(~good, F.col(ts))).alias("last_failure"),
        F.max_by(F.when(~good, F.col(error)), F.when(~good, F.struct(ts, tie))).alias("last_error_message"),
    )
    recent = W.partitionBy(source).orderBy(F.desc(ts), F.desc(tie))
    times = checks.where(good & (F.col(response) > 0)).withColumn("_n", F.row_number().over(recent)).where("_n <= 100")
    mean = times.groupBy(source).agg(F.avg(response).alias("avg_response_time_ms"))
    out = totals.join(final_streaks(checks, source, ts, ok, tie), source).join(mean, source, "left")
    rate = F.coalesce(F.try_divide(F.col("successful_requests"), F.col("total_requests")), F.lit(0.0))
    return out.withColumns({"success_rate": rate, "status": status(F.col("total_requests"), F.col("successful_requests"), F.col("consecutive_failures"))})


def nz_long(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(0).cast("long"))


def error_counts(checks: DataFrame, source: str = "source_name", error: str = "error_message") -> DataFrame:
    """source, error_counts: map of error class to count."""
    by = checks.withColumn("_c", error_class(F.col(error))).where("_c is not null").groupBy(source, "_c").agg(F.count("*").alias("n"))
    return by.groupBy(source).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_c", "n")))).alias("error_counts"))


def summary(states: DataFrame) -> DataFrame:
    """One row over all sources."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return states.agg(
        F.count("*").alias("total"), of("healthy"), of("degraded"), of("unhealthy"), of("unknown"),
        F.coalesce(F.try_divide(F.sum("successful_requests"), F.sum("total_requests")), F.lit(0.0)).alias("overall_success_rate"),
        F.coalesce(F.sum("events_found_total"), F.lit(0)).alias("total_events"),
        F.max("last_check").alias("last_check"),
    )


def troubled(states: DataFrame, of: str = "unhealthy") -> DataFrame:
    """Sources of a status, by name."""
    return states.where(F.col("status") == of).orderBy("source_name")


def statuses(rows: DataFrame) -> DataFrame:
    """Source statuses in the order of their display."""
    return rows.orderBy("source_type", "source_name")


def search_counters(searches: DataFrame) -> DataFrame:
    """Searches of a run by backend: all, answered and empty ones."""
    got = F.col("n_results") > 0
    return searches.groupBy("backend").agg(F.count("*").alias("searches"), F.count_if(got).alias("answered"), F.count_if(~got).alias("empty"))


def dashboard(states: DataFrame, as_of: Column) -> DataFrame:
    # One division, and one rounding of its exact value (a tie goes to the even
    # digit): a rate times 100, or a rounded number's shortest text, is off.
    percent = F.coalesce(F.try_divide(F.col("successful_requests") * 100.0, F.col("total_requests")), F.lit(0.0))
    return states.select(
        F.col("source_name").alias("name"), "status",
        F.concat(F.call_function("format_number", percent, F.lit("0.0")), F.lit("%")).alias("uptime"),
        D.check_age_text(F.col("last_check"), as_of).alias("last_check"),
        F.col("events_found_total").alias("events_total"),
        F.format_string("%.0fms", F.coalesce("avg_response_time_ms", F.lit(0.0))).alias("avg_response_ms"),
        "consecutive_failures",
        F.left(F.col("last_error_message"), F.lit(50)).alias("last_error"),
    ).orderBy("name")


def rolling_mean(checks: DataFrame, source: str, ts: str, tie: str, value: str, rows: int = 100) -> DataFrame:
    """Mean of a source's last positive values, slice by slice of its rows."""
    return slices.over_rows(checks.where(F.col(value) > 0), source, ts, tie, rows, F.avg(value), "rolling_mean")


def running(checks: DataFrame, source: str, ts: str, tie: str, ok: str, events: str) -> DataFrame:
    """A source's state after each of its checks: total, good, streak (failures
    in a row), events_total, status. What the stream's state machine keeps, by
    running sums: a streak is the distance to the last good check."""
    good = F.col(ok).cast("int")
    rows = slices.running(checks, source, ts, tie, {"total": F.lit(1), "good": good, "events_total": F.when(F.col(ok), F.col(events)).otherwise(0)})
    rows = slices.running(rows, source, ts, tie, tops={"_last": F.when(F.col(ok), F.col("total"))})
    rows = rows.withColumn("streak", F.col("total") - F.coalesce("_last", F.lit(0))).drop("_last")
    rate = F.col("good") / F.col("total")
    label = F.when(F.col("total") < 3, "unknown").when((F.col("streak") >= 3) | (rate < 0.5), "unhealthy").when(rate < 0.9, "degraded").otherwise("healthy")
    return rows.withColumn("status", label)


# ---------------------------------------------------------------- checks


def _verdict(name: str, df: DataFrame, fail: Column, warn: Column, message: Column) -> DataFrame:
    """One row: check, verdict, message."""
    return df.select(F.lit(name).alias("check"), F.when(fail, "FAIL").when(warn, "WARN").otherwise("PASS").alias("verdict"), message.alias("message"))


def check_sources(statuses: DataFrame) -> DataFrame:
    found = F.coalesce(F.col("events_found"), F.lit(0))
    one = statuses.agg(F.count("*").alias("n"), F.count_if(found > 0).alias("productive"), F.count_if((found == 0) & (F.col("status") == "success")).alias("silent"), F.count_if(F.col("status") == "error").alias("errored"))
    text = F.format_string("%d producing, %d silent, %d errored of %d", F.col("productive"), F.col("silent"), F.col("errored"), F.col("n"))
    return _verdict("source_health", one, F.col("errored") > 5, (F.col("n") == 0) | (F.col("productive") < 2), text)


def volume_trend(events: DataFrame, ts: str, as_of: Column, days: int = 7) -> DataFrame:
    """recent, prior, change in percent (100 where there was nothing before)."""
    back = lambda n: as_of - F.expr(f"INTERVAL {n} DAYS")
    c = F.col(ts)
    one = events.where(c >= back(2 * days)).agg(F.count_if(c >= back(days)).alias("recent"), F.count_if(c < back(days)).alias("prior"))
    change = F.when(F.col("prior") == 0, 100.0).otherwise((F.col("recent") - F.col("prior")) * 100.0 / F.greatest(F.col("prior"), F.lit(1)))
    return one.withColumn("change", change)


def check_volume(events: DataFrame, ts: str, as_of: Column) -> DataFrame:
    one = volume_trend(events, ts, as_of)
    warn = (F.col("recent") < 10) | (F.col("change") < -50)
    return _verdict("event_volume", one, F.lit(False), warn, F.format_string("last 7d: %d, prior 7d: %d, change: %+.0f%%", F.col("recent"), F.col("prior"), F.col("change")))


def check_freshness(statuses: DataFrame, events: DataFrame, as_of: Column, checked: str = "last_check", found: str = "discovered_at") -> DataFrame:
    """Age of the last run decides; that of the last event is told."""
    one = statuses.agg(F.max(checked).alias("_run")).join(events.agg(F.max(found).alias("_event")))  # one row each
    hours = D.seconds_between(F.col("_run"), as_of) / 3600
    told = F.format_string("last run %.1fh ago, last event %.1fh ago", hours, D.seconds_between(F.col("_event"), as_of) / 3600)
    return _verdict("freshness", one, F.coalesce(hours > 10, F.lit(False)), F.col("_run").isNull() | (hours > 6), F.coalesce(told, F.lit("never run")))


def check_lag(events: DataFrame, as_of: Column, hours: int = 5) -> DataFrame:
    old = F.col("discovered_at") < as_of - F.expr(f"INTERVAL {hours} HOURS")
    one = events.agg(F.count_if(F.col("enriched_at").isNull() & F.col("blocked_at").isNull() & old).alias("n"))
    return _verdict("enrichment_lag", one, F.col("n") > 10, F.col("n") > 3, F.format_string("%d events unenriched after %d hours", F.col("n"), F.lit(hours)))


def check_cleanup(judged: DataFrame) -> DataFrame:
    one = judged.agg(F.count_if(F.col("drop_reason").isNotNull()).alias("n"))
    return _verdict("cleanup", one, F.lit(False), F.col("n") > 25, F.format_string("%d events would be dropped", F.col("n")))


def overall(checks: DataFrame) -> DataFrame:
    """The worst verdict."""
    rank = F.when(F.col("verdict") == "FAIL", 2).when(F.col("verdict") == "WARN", 1).otherwise(0)
    return checks.agg(F.max(rank).alias("_r")).select(F.when(F.col("_r") == 2, "FAIL").when(F.col("_r") == 1, "WARN").otherwise("PASS").alias("overall"))


def feed_summary(statuses: DataFrame, slow_ms: float = 5000.0) -> DataFrame:
    rt = F.col("response_time_ms")
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return statuses.agg(F.count("*").alias("total"), of("ok"), of("warning"), of("error"), F.avg(F.when(rt > 0, rt)).alias("avg_ms"), F.max(F.when(rt > 0, rt)).alias("max_ms"), F.count_if(rt > slow_ms).alias("slow"))


def check_that(name: str, df: DataFrame, bad: Column, fail_over: int, warn_over: int = 0) -> DataFrame:
    """Any check that counts bad rows: FAIL over one limit, WARN over another."""
    one = df.agg(F.count_if(bad).alias("n"))
    return _verdict(name, one, F.col("n") > fail_over, F.col("n") > warn_over, F.format_string("%d rows", F.col("n")))


def limiter_stats(attempts: DataFrame, source: str = "source", backoff_codes: tuple[int, ...] = (429, 503, 502, 500)) -> DataFrame:
    """Requests, failures, failure rate and last code of each source."""
    bad = ~F.col("ok")
    return attempts.groupBy(source).agg(
        F.count("*").alias("total_requests"), F.count_if(bad).alias("total_failures"),
        F.coalesce(F.try_divide(F.count_if(bad), F.count("*")), F.lit(0.0)).alias("failure_rate"),
        F.count_if(bad & (F.col("code").isNull() | F.col("code").isin(*backoff_codes))).alias("backoffs"),
        F.max_by("code", "seconds").alias("last_code"),
    )


def import_stats(results: DataFrame) -> DataFrame:
    """One row: imported, skipped and failed of import results (outcome)."""
    of = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    return results.agg(F.count("*").alias("total"), of("imported"), of("skipped"), of("failed"))


def table_status(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.max(ts).alias("newest"))
