"""Mixing sources to target weights (operator 8).

Documents are aggregated by membership pattern (the set of sources that a
document belongs to). A min-cost flow sends token capacity from patterns to
source quotas: the first use of a pattern's tokens costs nothing, each
repetition more than the one before (convex costs), up to the greatest number
of uses. What a pattern sends is then cut into whole documents along a seeded
order: with capacity S and u sent, every document is used floor(u / S) times,
and those at the front of the order once more until the rest is spent; a
document at the cut is taken when more than half of it fits.

The place in a pattern's order where the rest is spent is found level by level:
sums of 2**BITS buckets by the leading bits of the seeded hash, then of the
buckets inside the one where the rest ends, until that holds few rows. No task
holds a pattern, however many rows it has, and no window more than one level;
then each document compares its own place with what was found. Sources and
patterns are tables and may be any number. A pattern of one source that no
document shares with another needs no flow: it sends what its quota and its
capacity allow. The flow, on the driver, is over the patterns that overlap, a
row each.

Defined cases: a null or empty text has size 0 and is never taken; a null
source is a source of its own, ordered last; repeated rows are documents of
their own that are taken alike, in the mix or not as one; an empty table gives
an empty table; other columns stay, but a column of a result's name (size,
source_size, target, copies, taken) is replaced by the result.
"""

from __future__ import annotations

from collections import deque
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import _common as C

#: Rows, one a pattern, that are sent to every task.
FEW = 200_000
SEED = 20_240_601
BITS, BUCKET_ROWS = 10, 1_000


def targets(sizes: dict, weights: list[float], share: float, most: float) -> dict:
    """source_targets() of a few sources, given in order."""
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(sizes)}
    left, open_ = share * sum(sizes.values()), dict.fromkeys(sizes)
    out = dict.fromkeys(sizes, 0.0)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not above:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in above:
            out[s] = float(most * sizes[s])
            left -= out[s]
            del open_[s]
    return out


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """sizes (source, size) with target: share `share` of all sizes by weight
    (cyclic, sources in code point order, null last); no target is above `most`
    times its source's size, the excess is shared again by weight until none
    is above. Sources stay a table; a row of sums comes back in each round."""
    sources = _weighed(sizes, weights)
    total = sources.agg(F.sum("size"), F.sum("weight")).first()
    if not total[0]:
        return sources.select("source", "size", F.lit(0.0).alias("target"))
    cap, closed, unit = F.col("size") * float(most), 0, share * total[0] / total[1]
    while True:
        # The unit grows from round to round: what was above stays above.
        above = F.lit(unit) * F.col("weight") > cap
        n, capped, open_ = sources.agg(F.count_if(above), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == closed or not open_:
            break
        closed, unit = n, (share * total[0] - (capped or 0.0)) / open_
    return sources.select("source", "size", F.when(above, cap).otherwise(F.lit(unit) * F.col("weight")).alias("target"))


def _weighed(sizes: DataFrame, weights: list[float]) -> DataFrame:
    """sizes with weight: a source's place in the order of all decides, found
    from ranges of sources and their counts."""
    spark = sizes.sparkSession
    order = F.col("source").asc_nulls_last()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = C.staged(sizes.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "mix-sources")
    before, starts = 0, []
    for part, n in sorted(ranges.groupBy("_part").agg(F.count("*")).collect()):  # a row a partition
        starts.append((part, before))
        before += n
    starts = spark.createDataFrame(starts, "_part int, _start long")
    place = F.col("_start") + F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    out = ranges.join(F.broadcast(starts), "_part").select("source", "size", F.get(cycle, (place % len(weights)).cast("int")).alias("weight"))
    return C.staged(out, "mix-weights")


class MinCostFlow:
    """Primal-dual: shortest distances by Dijkstra over reduced costs, then all
    flow that fits along shortest paths at once (blocking flows). Capacities
    and costs are whole numbers, costs not negative. There are as many rounds
    as path costs, few where costs are levels of use."""

    def __init__(self, n: int):
        self.graph: list[list[int]] = [[] for _ in range(n)]
        self.to, self.capacity, self.cost = [], [], []

    def edge(self, a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.graph[x].append(len(self.to))
            self.to.append(y)
            self.capacity.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        total, potential = 0, [0] * len(self.graph)
        while self._potentials(source, sink, potential):
            while pushed := self._blocking(source, sink, potential):
                total += pushed
        return total

    def _potentials(self, source: int, sink: int, potential: list[int]) -> bool:
        """Make every edge's reduced cost at least 0, and 0 along shortest
        paths; whether the sink can be reached."""
        far = float("inf")
        distance = [far] * len(self.graph)
        distance[source], heap = 0, [(0, source)]
        while heap:
            d, v = heappop(heap)
            if d > distance[v]:
                continue
            for e in self.graph[v]:
                w = self.to[e]
                there = d + self.cost[e] + potential[v] - potential[w]
                if self.capacity[e] > 0 and there < distance[w]:
                    distance[w] = there
                    heappush(heap, (there, w))
        if distance[sink] == far:
            return False
        for v, d in enumerate(distance):
            potential[v] += min(d, distance[sink])
        return True

    def _blocking(self, source: int, sink: int, potential: list[int]) -> int:
        """A blocking flow over edges of reduced cost 0, by levels."""
        free = lambda v, e: self.capacity[e] > 0 and self.cost[e] + potential[v] == potential[self.to[e]]
        level, queue = {source: 0}, deque([source])
        while queue and sink not in level:
            v = queue.popleft()
            for e in self.graph[v]:
                if self.to[e] not in level and free(v, e):
                    level[self.to[e]] = level[v] + 1
                    queue.append(self.to[e])
        if sink not in level:
            return 0
        at, path, v, total = dict.fromkeys(level, 0), [], source, 0
        while True:
            if v == sink:
                push = min(self.capacity[e] for e in path)
                total += push
                for e in path:
                    self.capacity[e] -= push
                    self.capacity[e ^ 1] += push
                # Back to before the first edge that is full now.
                cut = next(i for i, e in enumerate(path) if not self.capacity[e])
                v, path = self.to[path[cut] ^ 1], path[:cut]
                continue
            edges = self.graph[v]
            while at[v] < len(edges):
                e = edges[at[v]]
                if level.get(self.to[e]) == level[v] + 1 and free(v, e):
                    break
                at[v] += 1
            if at[v] < len(edges):
                path.append(edges[at[v]])
                v = self.to[path[-1]]
            elif path:
                v = self.to[path.pop() ^ 1]
                at[v] += 1
            else:
                return total


def route(capacity: dict[tuple, int], quota: dict, uses: int = 2) -> dict[tuple, dict]:
    """Tokens that each pattern sends to each of its sources."""
    patterns, sources = list(capacity), list(quota)
    p0, s0 = 2, 2 + len(patterns)
    flow = MinCostFlow(s0 + len(sources))
    place = {s: s0 + i for i, s in enumerate(sources)}
    sent = {}
    for i, p in enumerate(patterns):
        for r in range(uses):
            flow.edge(0, p0 + i, capacity[p], r * r)
        for s in p:
            sent[p, s] = flow.edge(p0 + i, place[s], uses * capacity[p], 0)
    for s in sources:
        flow.edge(place[s], 1, quota[s], 0)
    flow.run(0, 1)
    out: dict[tuple, dict] = {p: {} for p in patterns}
    for (p, s), e in sent.items():
        if flow.capacity[e ^ 1]:
            out[p][s] = flow.capacity[e ^ 1]
    return out


def _plans(patterns: DataFrame, goals: DataFrame, uses: int) -> DataFrame:
    """patterns (_p, _pattern, size, n) with _source_size and _target of the
    first source, and how its tokens are spent: _base uses of each document,
    and _rest tokens once more. A source that no document shares with another
    takes what its quota and its own pattern allow; the flow is over those
    that overlap."""
    spark = patterns.sparkSession
    first = goals.select(F.col("source").alias("_source"), F.col("size").alias("_source_size"), F.col("target").alias("_target"), F.bround("target", 0).cast("long").alias("_quota"))
    known = patterns.join(first, F.get("_pattern", 0).eqNullSafe(F.col("_source")), "left")
    spend = lambda u: [F.when(F.col("size") > 0, F.floor(u / F.col("size"))).otherwise(0).cast("long").alias("_base"), F.when(F.col("size") > 0, u % F.col("size")).otherwise(0).cast("long").alias("_rest")]
    columns = ["_p", "n", F.coalesce("_source_size", F.lit(0)).cast("long").alias("_source_size"), F.coalesce("_target", F.lit(0.0)).alias("_target")]
    shared = patterns.where(F.size("_pattern") > 1).select(F.explode("_pattern").alias("_shared")).distinct().withColumn("_hit", F.lit(True))
    alone = known.where(F.size("_pattern") == 1).join(shared, F.col("_source").eqNullSafe(F.col("_shared")), "left")
    closed = F.least(F.col("_quota"), uses * F.col("size"))
    plans = alone.where("_hit is null").select(*columns, *spend(closed))
    none = known.where(F.size("_pattern") == 0).select(*columns, F.lit(0).cast("long").alias("_base"), F.lit(0).cast("long").alias("_rest"))
    meet = known.where(F.size("_pattern") > 1).select("_p", "_pattern", "size").union(alone.where("_hit").select("_p", "_pattern", "size"))
    found = meet.collect()  # a row for each pattern that overlaps another
    if found:
        capacity = {tuple(r["_pattern"]): r["size"] for r in found}
        quota = goals.join(shared, F.col("source").eqNullSafe(F.col("_shared")), "left_semi").select("source", F.bround("target", 0).cast("long")).collect()
        sent = route(capacity, dict(sorted(quota, key=lambda r: (r[0] is None, r[0] or ""))), uses)
        flows = spark.createDataFrame([(r["_p"], sum(sent[tuple(r["_pattern"])].values())) for r in found], "_p string, _sent long")
        plans = plans.union(known.join(flows, "_p").select(*columns, *spend(F.col("_sent"))))
    return plans.union(none)


def _placed(df: DataFrame, sources: str, text: str, key: str, seed: int) -> DataFrame:
    """_row (all columns of df), _p (the pattern as JSON: arrays with nulls
    cannot be joined), _pattern, _size, and _at, the document's place in the
    seeded order."""
    several = dict(df.dtypes)[sources].startswith("array")
    names = F.sort_array(F.array_distinct(F.col(sources)), asc=True) if several else F.array(F.col(sources))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(C.WORD)), F.lit(0)).cast("long")
    # Rows of one key (or of none) are spread by their texts.
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), 1)
    at = F.struct(place.alias("hash"), F.coalesce(F.col(key), F.lit(-(2**62))).alias("key"), F.col("_size").alias("size"))
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), names.alias("_pattern"), size.alias("_size"), F.col(key), F.col(text))
    return out.select("_row", F.to_json(F.struct("_pattern")).alias("_p"), "_pattern", "_size", at.alias("_at"))


def _leading(bits: int):
    """The first bits of the (63-bit) hash of a place."""
    return F.shiftright("_at.hash", 63 - bits) if bits else F.lit(0).cast("long")


def _met(rows: DataFrame, plans: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with a row a pattern: sent to every task while those are
    few, else joined by shuffles, where a pattern with very many rows is
    split."""
    few = plans.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(plans) if few else plans, on)


def _stops(rows: DataFrame, plans: DataFrame) -> tuple[DataFrame, int]:
    """_p, _cut and _stop: where each pattern's rest is spent. The bucket, what
    lies before it and its rows are found one level of hash bits after the
    other, until no bucket has many rows."""
    spent = plans.where("_rest > 0")
    cuts = C.staged(spent.select("_p", F.lit(0).cast("long").alias("_bucket"), F.lit(0).cast("long").alias("_before"), "_rest", "n"), "mix-cuts")
    bits = 0
    while bits < 60 and (cuts.agg(F.max("n")).first()[0] or 0) > BUCKET_ROWS:
        near = _met(rows.withColumn("_bucket", _leading(bits)), cuts.drop("n"), ["_p", "_bucket"]).drop("_bucket")
        bits += BITS
        sums = near.groupBy("_p", "_before", "_rest", _leading(bits).alias("_bucket")).agg(F.sum("_size").alias("_sum"), F.count("*").alias("n"))
        order = W.partitionBy("_p").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)  # 2**BITS rows at most
        sums = sums.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_sum").over(order), F.lit(0)))
        held, cuts = cuts, C.staged(sums.where("_start < _rest and _start + _sum >= _rest").select("_p", "_bucket", F.col("_start").alias("_before"), "_rest", "n"), "mix-cuts")
        C.free(held)
    # Equal places are taken alike: the first that is not taken, none if all are.
    near = _met(rows.withColumn("_bucket", _leading(bits)), cuts.drop("n"), ["_p", "_bucket"])
    near = near.groupBy("_p", "_bucket", "_before", "_rest", "_at").agg(F.sum("_size").alias("_size"))
    order = W.partitionBy("_p").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    middle = F.col("_before") + F.coalesce(F.sum("_size").over(order), F.lit(0)) + F.col("_size") / 2
    return near.withColumn("_middle", middle).groupBy("_p").agg(F.min("_bucket").alias("_cut"), F.min(F.when(F.col("_middle") >= F.col("_rest"), F.col("_at"))).alias("_stop")), bits


def mix(df: DataFrame, weights: list[float], share: float = 1.5, uses: int = 2, sources: str = "source", text: str = "text", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """df with size, source_size and target (of the document's first source),
    copies and taken in place of columns of these names. `sources` is a string
    column or an array of the sources that a document belongs to. Only keys
    and sizes are shuffled."""
    placed = _placed(df, sources, text, key, seed)
    rows = C.staged(placed.select("_p", "_pattern", "_size", "_at"), "mix-sizes")
    patterns = C.staged(rows.groupBy("_p").agg(F.first("_pattern").alias("_pattern"), F.sum("_size").alias("size"), F.count("*").alias("n")), "mix-patterns")
    # A document of several sources counts for each of them.
    sizes = patterns.select(F.explode("_pattern").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size"))
    once, often = patterns.agg(F.sum("size"), F.sum(F.col("size") * F.size("_pattern"))).first()
    goals = C.staged(source_targets(sizes, weights, share * (once or 0) / max(1, often or 0), uses), "mix-targets")
    plans = C.staged(_plans(patterns, goals, uses), "mix-plans")
    stops, bits = _stops(rows, plans)
    full = C.staged(plans.join(stops, "_p", "left"), "mix-stops")
    decided = _met(placed, full.drop("n"), ["_p"])
    again = (F.col("_rest") > 0) & F.when(F.col("_stop").isNotNull(), F.col("_at") < F.col("_stop")).otherwise(_leading(bits) <= F.col("_cut"))
    copies = F.when(F.col("_size") == 0, 0).otherwise(F.least(F.col("_base") + F.when(again, 1).otherwise(0), F.lit(uses))).cast("int")
    others = [F.col(f"_row.`{c}`") for c in df.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    return decided.select(*others, F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), copies.alias("copies"), (copies * F.col("_size")).cast("long").alias("taken"))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs.select("doc_id", "source", "text"), [3, 1, 2], share=1.5, uses=2)
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
