"""The flow against a plain one, targets and cuts against loops, many sources."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidewell.llm import mixing


def cost(capacity, sent):
    """Least cost of what each pattern sends: uses fill up one by one."""
    total = 0
    for p, c in capacity.items():
        u, r = sum(sent[p].values()), 0
        while u > 0:
            total += min(u, c) * r * r
            u, r = u - c, r + 1
    return total


def plain_flow(capacity, quota, uses):
    """One unit at a time along cheapest paths by Bellman and Ford; (flow, cost)."""
    patterns, sources = list(capacity), list(quota)
    edges, node = [], {"s": 0, "t": 1} | {("p", p): 2 + i for i, p in enumerate(patterns)} | {("q", s): 2 + len(patterns) + i for i, s in enumerate(sources)}
    add = lambda a, b, c, w: edges.extend([[node[a], node[b], c, w], [node[b], node[a], 0, -w]])
    for p in patterns:
        for r in range(uses):
            add("s", ("p", p), capacity[p], r * r)
        for s in p:
            add(("p", p), ("q", s), uses * capacity[p], 0)
    for s in sources:
        add(("q", s), "t", quota[s], 0)
    flow = price = 0
    while True:
        far = {0: 0}
        via = {}
        for _ in range(len(node)):
            for i, (a, b, c, w) in enumerate(edges):
                if c and a in far and far[a] + w < far.get(b, 10**9):
                    far[b], via[b] = far[a] + w, i
        if 1 not in far:
            return flow, price
        v = 1
        while v:
            e = via[v]
            edges[e][2] -= 1
            edges[e ^ 1][2] += 1
            v = edges[e][0]
        flow, price = flow + 1, price + far[1]


@pytest.mark.parametrize("seed", range(25))
def test_flow(seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", None]
    patterns = {tuple(sorted(rng.sample(names, rng.randint(1, 3)), key=str)) for _ in range(6)}
    capacity = {p: rng.randint(0, 12) for p in patterns}
    quota = {s: rng.randint(0, 25) for s in names}
    uses = rng.randint(1, 3)
    sent = mixing.route(capacity, quota, uses)
    flow, price = plain_flow(capacity, quota, uses)
    assert all(set(sent[p]) <= set(p) and sum(sent[p].values()) <= uses * c for p, c in capacity.items())
    assert all(sum(x.get(s, 0) for x in sent.values()) <= quota[s] for s in names)
    assert sum(sum(x.values()) for x in sent.values()) == flow and cost(capacity, sent) == price


def test_flow_of_many_patterns():
    rng = random.Random(1)
    capacity = {tuple(sorted(rng.sample(range(3000), 2))): rng.randint(1, 1000) for _ in range(3000)}
    quota = {s: rng.randint(0, 3000) for s in range(3000)}
    begin = time.perf_counter()
    mixing.route(capacity, quota)
    assert time.perf_counter() - begin < 20


@pytest.mark.parametrize("seed", range(4))
def test_source_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:03d}": rng.choice([0, 1, 5, 50, 5000]) for i in range(rng.randint(1, 60))} | {None: 9}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(3)
    got = {r.source: r.target for r in mixing.source_targets(df, [3, 1, 2], 1.5, 2).collect()}
    want = mixing.targets(sizes, [3, 1, 2], 1.5, 2)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_cut_by_hand(spark):
    """What is taken of a source is a front of its seeded order, document by
    document, those at the cut by more than half."""
    rng = random.Random(8)
    docs = [(i, rng.choice(["a", "b", None]), " ".join(["w"] * rng.choice([0, 1, 7, 30]))) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    rows = mixing.mix(df, [3, 1, 2]).join(df.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), "doc_id", "text"), 1).alias("at")), "doc_id").collect()
    for source in ("a", "b", None):
        mine = sorted((r for r in rows if r.source == source), key=lambda r: (r["at"], r.doc_id))
        size, target = sum(r.size for r in mine), mine[0].target
        base, rest = divmod(min(round(target), 2 * size), size)
        before, cut = 0, False
        for r in mine:
            cut = cut or before + r.size / 2 >= rest
            assert r.size == 0 or r.copies == base + (not cut and rest > 0), (source, r)
            before += r.size
        assert mine[0].source_size == size and abs(sum(r.taken for r in mine) - target) <= 30


def test_many_sources(spark):
    """A source for each document, and two large ones: nothing is limited."""
    n = 20_000
    df = spark.range(n).selectExpr("id as doc_id", "case when id % 3 = 0 then 'big' else concat('s', id) end as source", "repeat('w ', cast(id % 7 as int)) as text")
    rows = mixing.mix(df, [3, 1, 2])
    total = rows.agg(F.count("*"), F.sum("taken"), F.sum("size"), F.max(F.col("taken") - 2 * F.col("size"))).first()
    assert total[0] == n and abs(total[1] - 1.5 * total[2]) < 0.02 * total[2] and total[3] <= 0
