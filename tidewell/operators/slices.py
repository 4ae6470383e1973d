"""Running windows over keys of any size: a key's time line is cut into slices,
each slice is given the rows before it that its first windows reach back to, and
windows run over one slice at a time. A source with a third of all rows is then
as many tasks as it has slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _copied(df: DataFrame, slice_: Column, late: Column) -> DataFrame:
    """df with _slice and _own: each row in its slice, rows near a slice's end
    in the next one as well, as its context."""
    here = F.struct(slice_.alias("_slice"), F.lit(True).alias("_own"))
    after = F.struct((slice_ + 1).alias("_slice"), F.lit(False).alias("_own"))
    copies = F.explode(F.when(late, F.array(here, after)).otherwise(F.array(here)))
    return df.withColumn("_copy", copies).select("*", "_copy._slice", "_copy._own").drop("_copy")


def _own(df: DataFrame, *helpers: str) -> DataFrame:
    return df.where("_own").drop("_slice", "_own", *helpers)


def over_time(df: DataFrame, key: str, ts: str, span: int, measure: Column, name: str, length: int | None = None) -> DataFrame:
    """`measure` over the rows of the key in the `span` microseconds up to each
    row, peers included. Slices of `length` (24 spans) take 1/24 more rows."""
    length = length or 24 * span
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("_at", at)
    rows = _copied(rows, F.floor(F.col("_at") / length).cast("long"), F.pmod("_at", F.lit(length)) >= length - span)
    w = W.partitionBy(key, "_slice").orderBy("_at").rangeBetween(-span, 0)
    return _own(rows.withColumn(name, measure.over(w)), "_at")


def running(df: DataFrame, key: str, ts: str, tie: str, sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None) -> DataFrame:
    """df with running sums and running greatest values of a key's rows by (ts,
    tie), each row included; nulls of ts first. What lies before an hour comes
    from the hours' own sums, so no task holds more than an hour of a key."""
    sums, tops = sums or {}, tops or {}
    hour = F.coalesce(F.date_trunc("hour", F.col(ts)), F.lit("0001-01-01").cast("timestamp"))
    rows = df.withColumn("_hour", hour)
    own = [F.sum(c).alias(f"_{n}") for n, c in sums.items()] + [F.max(c).alias(f"_{n}") for n, c in tops.items()]
    hours = rows.groupBy(F.col(key).alias("_key"), F.col("_hour").alias("_of")).agg(*own)
    earlier = W.partitionBy("_key").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)  # a row an hour
    hours = hours.select("_key", "_of", *[F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in sums], *[F.max(f"_{n}").over(earlier).alias(f"_{n}") for n in tops])
    inside = W.partitionBy(key, "_hour").orderBy(ts, tie).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"_own_{n}": F.sum(c).over(inside) for n, c in sums.items()} | {f"_own_{n}": F.max(c).over(inside) for n, c in tops.items()})
    both = rows.join(hours, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_hour") == F.col("_of")))
    added = {n: F.coalesce(F.col(f"_{n}"), F.lit(0)) + F.col(f"_own_{n}") for n in sums} | {n: F.greatest(f"_{n}", f"_own_{n}") for n in tops}
    return both.select(*df.columns, *[c.alias(n) for n, c in added.items()])


def numbered(df: DataFrame, key: str, ts: str, tie: str, name: str = "_pos") -> DataFrame:
    """Places of the rows of a key by (ts, tie), from 0; nulls first."""
    return running(df, key, ts, tie, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)


def over_rows(df: DataFrame, key: str, ts: str, tie: str, rows: int, measure: Column, name: str, length: int | None = None) -> DataFrame:
    """`measure` over each row and the rows - 1 before it in the key's order.
    Slices of `length` rows (a hundred windows, 10,000 at least)."""
    length = length or max(10_000, 100 * rows)
    placed = numbered(df, key, ts, tie)
    placed = _copied(placed, F.floor(F.col("_pos") / length).cast("long"), F.pmod("_pos", F.lit(length)) > length - rows)
    w = W.partitionBy(key, "_slice").orderBy("_pos").rowsBetween(-(rows - 1), 0)
    return _own(placed.withColumn(name, measure.over(w)), "_pos")
