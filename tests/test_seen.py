"""Seen urls behind filters say what the plain anti-join says."""

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import dedup, seen


def urls(spark, ids):
    return spark.createDataFrame([(i, f"http://x/{i}" if i % 50 else None) for i in ids], "id long, url string")


def hashed(df):
    return df.select(T.url_hash(F.col("url")).alias("url_hash"))


def test_unseen(spark, tmp_path):
    store = seen.SeenUrls(spark, f"file://{tmp_path}/seen", blocks=256)
    new = urls(spark, range(400, 700))
    assert store.unseen(new).count() == 300 and store.days() == []
    store.add(hashed(urls(spark, range(0, 500))), "2024-01-01")
    store.add(hashed(urls(spark, range(300, 550))), "2024-01-02")
    store.add(hashed(urls(spark, range(300, 560))), "2024-01-02")  # again, in place
    got = sorted(r.id for r in store.unseen(new).collect())
    assert got == sorted(r.id for r in dedup.unseen(new, store.read()).collect()) == [i for i in range(560, 700) if i % 50]
    again = seen.SeenUrls(spark, f"file://{tmp_path}/seen")
    assert again.blocks == 256 and again.forget("2024-01-02") == ["2024-01-01"]
    assert sorted(r.id for r in again.unseen(urls(spark, range(200, 400))).collect()) == [i for i in range(200, 300) if i % 50]


def test_filter(spark, tmp_path):
    """Nothing that was seen is missed, few others are asked about, and what
    was seen is neither shuffled nor (for nobody) read."""
    store = seen.SeenUrls(spark, f"file://{tmp_path}/seen", blocks=1024)
    known = spark.range(20_000).select(F.md5(F.concat(F.lit("k"), "id").cast("binary")).alias("url_hash"))
    other = spark.range(20_000).select(F.md5(F.concat(F.lit("o"), "id").cast("binary")).alias("url_hash"))
    store.add(known, "2024-01-01")
    assert store.possible(known).count() == 20_000
    wrong = store.possible(other).count()
    assert wrong < 200
    assert store.hits(other).count() == 0 and store.hits(known.limit(50).union(other)).count() == 50
    plan = store.hits(other)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan
