"""Streams say what their batch twins say; state machines step by step."""

import pytest
from pyspark.sql import functions as F

from tidewell.plans import catalogue
from tidewell.streaming import stateful

DATA = "/root/testdata/sf0.001"


def steps(machine, attempts):
    step, state = stateful.MACHINES[machine][:2]
    out = []
    for a in attempts:
        state, r = step(state, a)
        out.append(r)
    return out


def test_limiter_ladder():
    got = steps("limiter", [(0.0, False, 429), (0.0, False, 429), (0.0, False, 429)])
    assert [r[2] for r in got] == [2.0, 4.0, 8.0]
    got = steps("limiter", [(float(i * 100), False, 503) for i in range(6)])
    assert [r[1] for r in got] == ["backoff"] * 4 + ["give_up"] * 2
    assert steps("limiter", [(0.0, False, 429), (10.0, True, None), (11.0, False, 429)])[-1][2] == 2.0
    assert steps("limiter", [(0.0, False, 404)])[0] == (0.0, "failed", 0.0)
    assert steps("limiter", [(0.0, True, None), (0.25, True, None)])[1][0] == 0.75


def test_breaker():
    got = steps("breaker", [(float(i), False) for i in range(8)] + [(920.0, True)])
    assert [r[0] for r in got] == ["called"] * 5 + ["opened", "skipped", "skipped", "called"]


@pytest.mark.parametrize("machine", ["limiter", "breaker", "health"])
def test_stream_equals_batch(spark, tmp_path, machine):
    rows = catalogue.attempts(spark, DATA)
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    live = catalogue.drained(stateful.live(stream, machine, "user_id", ["seconds", "event_id"]), "update")
    batch = stateful.replay(rows, machine, "user_id", ["seconds", "event_id"])
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def test_running_health_equals_the_machine(spark):
    from tidewell.operators import health

    rows = catalogue.attempts(spark, DATA)
    columns = ["user_id", "event_id", "total", "good", "streak", "events_total", "status"]
    machine = stateful.replay(rows, "health", "user_id", ["seconds", "event_id"]).select(columns)
    running = health.running(rows.withColumn("at", F.timestamp_micros((F.col("seconds") * 1_000_000).cast("long"))), "user_id", "at", "event_id", "ok", "events").select(columns)
    assert sorted(map(tuple, running.collect())) == sorted(map(tuple, machine.collect()))


def test_alerts_once(spark, tmp_path):
    sent, out = [], []
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "id int")

    def broken(df):
        raise OSError("no mail")

    step = stateful.alert_once(lambda: frame(sent), [broken, lambda df: out.extend(r.id for r in df.collect())], lambda df: sent.extend(r.id for r in df.collect()))
    step(frame([1, 2, 2]), 0)
    step(frame([2, 3]), 1)
    assert sorted(out) == [1, 2, 3]


def test_cycle(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    seen = []
    q = stateful.run_stream(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), lambda df, n: seen.append(df.count()), f"{tmp_path}/c")
    q.awaitTermination()
    assert sum(seen) == 5


def cached(operations):
    """The cache by a plain loop: what comes out, in order of time."""
    held, out = {}, []
    for key, kind, at, value, ttl in sorted(operations, key=lambda o: o[2]):
        e = held.get(key)
        if e and e[1] is not None and e[1] < at:
            out.append((key, "expired", e[0], e[2]))
            e = held.pop(key) and None
        if kind == "put":
            held[key] = [value, None if ttl is None else at + ttl, 0]
        elif kind == "get":
            if e:
                e[2] += 1
            out.append((key, "hit", e[0], e[2]) if e else (key, "miss", None, 0))
        elif e:
            out.append((key, "cleared", e[0], e[2]))
            del held[key]
    end = max(o[2] for o in operations)
    out += [(k, "expired", e[0], e[2]) for k, e in held.items() if e[1] is not None and e[1] < end]
    return out, sum(e[1] is None or e[1] >= end for e in held.values())


def test_cache_stream(spark, tmp_path):
    """Hits, misses, replaced, cleared and expired entries over several
    batches; what has gone takes no state."""
    import random

    rng = random.Random(4)
    operations = [(f"k{rng.randrange(8)}", rng.choice(["put", "put", "get", "get", "get", "clear"]), t, f"v{t}", rng.choice([None, 3, 10, 40])) for t in range(1000, 1240, 2)]
    schema = "cache_key string, kind string, s int, value string, ttl int"
    for i in range(3):
        spark.createDataFrame(operations[i * 40 : i * 40 + 40], schema).withColumn("at", F.timestamp_seconds("s")).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    from tidewell.streaming import expiring

    stream = spark.readStream.schema(schema + ", at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    out = []
    with expiring.rocksdb(spark):
        q = expiring.cache_stream(stream).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda df, n: out.extend(df.collect())).start()
        q.awaitTermination()
    want, left = cached(operations)
    text = lambda rows: sorted(map(str, rows))
    got = [(r.cache_key, r.outcome, r.value, r.hits) for r in out]
    assert text(got) == text(want)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4 * left + 4  # entries and their timers
