"""Queries and operators on rows that the given tables do not have."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.operators import health
from tidewell.plans import catalogue


@pytest.fixture
def same(spark, tmp_path):
    """Write a table; whether a query over it gives what its SQL gives."""

    def check(name, table, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con = duckdb.connect()
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        df = catalogue.queries()[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(df.columns)} from ({catalogue.oracle_sql()[name]})").fetchall()
        assert want and sorted(map(tuple, df.collect())) == sorted(want)

    return check


def test_uptime_is_rounded_once(spark):
    """Ties and near ties: 23 of 80 is 28.75 %, a rate of 0.2875 times 100 is
    less; a tie goes to the even digit."""
    pairs = [(g, n) for n in (3, 7, 8, 16, 80, 160, 400) for g in range(n + 1)] + [(0, 0)]
    states = spark.createDataFrame([(f"{g}/{n}", g, n, g / max(n, 1)) for g, n in pairs], "source_name string, successful_requests long, total_requests long, success_rate double")
    none = F.lit(None)
    states = states.select("*", F.lit("healthy").alias("status"), none.cast("timestamp").alias("last_check"), F.lit(0).alias("events_found_total"), none.cast("double").alias("avg_response_time_ms"), F.lit(0).alias("consecutive_failures"), none.cast("string").alias("last_error_message"))
    got = {r.name: r.uptime for r in health.dashboard(states, none.cast("timestamp")).collect()}
    assert got == {f"{g}/{n}": f"{g * 100.0 / max(n, 1):.1f}%" for g, n in pairs}


def test_hashtags_of_large_ids(same):
    """Products beyond 2^53, which doubles cannot hold."""
    rows = [(i, i % 7) for i in range(5_000_000, 5_000_200)] + [(i, 1) for i in range(20)]
    same("hashtag_grade", "events", rows, "event_id long, user_id long")


def test_companies_with_repeated_line_numbers(same):
    """Equal line, name and role: the score decides, whatever the revenue."""
    rows = [(k, 100 + k, s, 1, float(q)) for k in range(40) for s, q in ((1 + k, 30), (1 + k + 8 * 7, 20), (1 + k + 8 * 9, 10))]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"
    same("prompt_blocks", "lineitem", rows, schema)


def test_cache_entries_share_state(spark, tmp_path):
    """Many keys cost a few state rows: those of their slots; an entry that goes
    when the stream ends still lives."""
    from tidewell.streaming import expiring

    rows = [(f"k{i}", "put", 1000 + i, "v", None if i % 3 else 100) for i in range(600)]
    spark.createDataFrame(rows, "cache_key string, kind string, s int, value string, ttl int").withColumn("at", F.timestamp_seconds("s")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("cache_key string, kind string, s int, value string, ttl int, at timestamp").parquet(f"{tmp_path}/in")
    out = []
    with expiring.rocksdb(spark):
        q = expiring.cache_stream(stream, slots=10).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda df, n: out.extend(df.collect())).start()
        q.awaitTermination()
    assert sorted(r.cache_key for r in out) == sorted(f"k{i}" for i in range(0, 600, 3) if i + 100 < 599)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 30


def test_cache_by_the_clock():
    """One key's operations against a state that only holds a value."""
    from pyspark.sql import Row

    from tidewell.streaming import expiring

    class State:
        value = None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    cache = expiring.Clocked(1000)
    cache.entry = State()
    rows = [Row(cache_key="a", kind=k, at_ms=at, value=v, ttl_ms=ttl) for k, at, v, ttl in [("get", 20, None, None), ("put", 10, "v", None), ("clear", 30, None, None), ("put", 40, "w", 3.0), ("get", 50, None, None), ("put", 60, "x", None)]]
    out = list(cache.handleInputRows(("a",), iter(rows), None))
    assert [(r.outcome, r.value, r.hits) for r in out] == [("hit", "v", 1), ("cleared", "v", 1), ("expired", "w", 0), ("miss", None, 0)]
    assert cache.entry.get() == ("x", 60, None, 0)


def test_keywords_within_words(spark):
    """Keywords without a blank are looked for in words, others in whole texts;
    both may overlap."""
    from tidewell.operators import keywords

    rows = spark.createDataFrame([(1, "xabcdefx abcdef"), (2, "abc def"), (3, "ABCDEF g")], "id long, text string")
    words = spark.createDataFrame([("abcdef",), ("bcdefx a",), ("c d",), ("bcd",)], "keyword string")
    got = {(r.id, r.keyword) for r in keywords.matches(rows, words).collect()}
    assert got == {(1, "abcdef"), (1, "bcdefx a"), (1, "bcd"), (2, "c d"), (3, "abcdef"), (3, "bcd")}
    low = rows.selectExpr("id as _key", "lower(text) as _text")
    inside = keywords.within_words(low, words.where("keyword in ('abcdef', 'bcd')"), True, 3)
    assert {(r._key, r.keyword) for r in inside.collect()} == {(1, "abcdef"), (1, "bcd"), (3, "abcdef"), (3, "bcd")}


def test_connector_batches_are_bounded(spark, tmp_path):
    """Long payloads leave a task before many of them are held."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.types import StructType

    from tidewell.sources import connectors

    feed = "<rss><channel><item><title>t</title><description>" + "x" * (1 << 20) + "</description></item></channel></rss>"
    (tmp_path / "cycle=1").mkdir()
    pq.write_table(pa.table({"name": [f"f{i}" for i in range(40)], "payload": [feed] * 40}), f"{tmp_path}/cycle=1/part-0.parquet")
    (tmp_path / "cycle=1" / "_SUCCESS").touch()
    columns = f"cycle string, name string, pos int, {connectors.FeedSource.columns}, error string"
    reader = connectors.PayloadReader(connectors.feed_entries, StructType.fromDDL(columns), {"path": str(tmp_path)})
    batches = [b for piece in reader.partitions() for b in reader.read(piece)]
    assert sum(b.num_rows for b in batches) == 40 and max(b.nbytes for b in batches) < 6 << 20
