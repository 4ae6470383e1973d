"""Date expressions. "Now" is always the argument as_of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rfc2822(c: Column) -> Column:
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},?\s+", "")
    zoned = F.regexp_replace(bare, r"\s*(?:GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(*[F.try_to_timestamp(zoned, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss")])


def parse_date(*tags: Column, as_of: Column) -> Column:
    """The first tag that is a date, RFC 2822 or ISO; as_of without one."""
    return F.coalesce(*[x for t in tags for x in (rfc2822(t), t.try_cast("timestamp"))], as_of)


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end.cast("timestamp")) / 1_000_000 - F.unix_micros(start.cast("timestamp")) / 1_000_000


def whole_days(start: Column, end: Column) -> Column:
    return F.floor(seconds_between(start, end) / 86_400).cast("long")


def age_text(then: Column, as_of: Column) -> Column:
    """"5 min ago", "3 hours ago", "2 days ago"."""
    s = seconds_between(then, as_of)
    say = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return F.when(s < 3600, say(s / 60, " min ago")).when(s < 86_400, say(s / 3600, " hours ago")).otherwise(say(s / 86_400, " days ago"))


def check_age_text(then: Column, as_of: Column) -> Column:
    """"Never", "Just now", "5m ago", "3h ago", "2d ago"."""
    s = seconds_between(then, as_of)
    say = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return F.when(then.isNull(), F.lit("Never")).when(s < 60, F.lit("Just now")).when(s < 3600, say(s / 60, "m ago")).when(s < 86_400, say(s / 3600, "h ago")).otherwise(say(s / 86_400, "d ago"))


def age_colour(then: Column, as_of: Column) -> Column:
    d = whole_days(then, as_of)
    return F.when(d <= 7, "fresh").when(d <= 14, "aging").otherwise("stale")


def since(as_of: Column, hours: int) -> Column:
    return as_of - F.expr(f"INTERVAL {int(hours)} HOURS")


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def day_text(c: Column) -> Column:
    return F.date_format(c, "MMM dd, yyyy")


def minute_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm")
