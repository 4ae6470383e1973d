"""Windows by slices say what windows over whole keys say."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.operators import slices


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    data = [(i, "hot" if i % 3 else rng.choice(["a", "b", None]), None if rng.random() < 0.02 else start + dt.timedelta(seconds=rng.randrange(0, 40_000, 10)), rng.random()) for i in range(1200)]
    return spark.createDataFrame(data, "id long, key string, ts timestamp, value double")


def same(a, b):
    order = lambda df: sorted(map(str, df.collect()))
    assert order(a) == order(b)


@pytest.mark.parametrize("length", [None, 3600, 4000, 7200])
def test_over_time(rows, length):
    span = 3600 * 10**6
    w = W.partitionBy("key").orderBy(F.unix_micros("ts")).rangeBetween(-span, 0)
    same(slices.over_time(rows, "key", "ts", span, F.count("*"), "n", length and length * 10**6), rows.withColumn("n", F.count("*").over(w)))


@pytest.mark.parametrize("n, length", [(1, 1), (5, 5), (5, 7), (20, 50), (100, None)])
def test_over_rows(rows, n, length):
    w = W.partitionBy("key").orderBy("ts", "id").rowsBetween(-(n - 1), 0)
    got = slices.over_rows(rows, "key", "ts", "id", n, F.sum("id"), "s", length)
    same(got, rows.withColumn("s", F.sum("id").over(w)))


def test_numbered(rows):
    w = W.partitionBy("key").orderBy("ts", "id")
    same(slices.numbered(rows, "key", "ts", "id", "n"), rows.withColumn("n", (F.row_number().over(w) - 1).cast("long")))


def test_running(rows):
    w = W.partitionBy("key").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)
    top = F.when(F.col("id") % 7 == 0, F.col("id"))
    got = slices.running(rows, "key", "ts", "id", {"s": F.col("id")}, {"m": top})
    same(got, rows.withColumns({"s": F.sum("id").over(w), "m": F.max(top).over(w)}))


def test_no_window_over_a_key_alone(rows):
    plan = slices.over_rows(rows, "key", "ts", "id", 5, F.sum("id"), "s")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "_slice" in plan
    for line in plan.splitlines():
        assert "hashpartitioning(key" not in line or "_slice" in line or "_hour" in line
