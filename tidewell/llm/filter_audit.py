"""Filter interaction audit by lattice-edge aggregation (operator 12).

What filters do to a corpus depends on their order. A document is known by the
set of filters that it fails. With k filters there are k * 2**(k-1) edges
(filters already applied, next filter): 80 for five. Documents are counted by
part and failed set, each count goes to every edge, and an edge's sums say what
its filter does after those filters in whatever order. An order of the filters
is a path of k edges; the edges' sums are joined to the k steps of all k! orders
(600 rows for five, broadcast). A filter's Shapley sum weighs each of its edges
by the orders that run through it, |applied|! * (k - 1 - |applied|)!.

Texts are read once; what is shuffled are keys, digests and failed sets, with
equal rows counted together first. Whether a text stands under a smaller key
is settled by a join on digest and key, so that a text which a third of all
rows share is spread over all tasks.

Defined cases: a null text is empty; a null or empty part is the part ''; rows
without a key repeat nothing and are repeated by nothing, and have no labels;
repeated rows (equal key and text) are documents of their own, none of which
repeats the other; a key with several labels has a label if one row says so; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import _common as C

MOST_FILTERS = 7  # 7! * 7 steps are 35,280 rows
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column, least_words: int = 100, least_distinct: int = 80, most_capitals: int = 10) -> dict[str, Column]:
    """Failure conditions of a text that is not null: A few words, B few
    distinct words (percent), C many capitals (percent), D symbols."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    # Named once, so that a text is split once for A and B.
    both = F.transform(F.array(counted), lambda c: F.struct((c["n"] < least_words).alias("a"), (100 * c["distinct"] < least_distinct * c["n"]).alias("b")))[0]
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {"A": both["a"], "B": both["b"], "C": 100 * capitals > most_capitals * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def failed_sets(df: DataFrame, filters: dict[str, Column], repeats: str | None, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """_id, _part, _mask (bit i: the i-th filter fails) and the number of rows
    alike, n. The filter named by `repeats` comes last and fails rows whose
    text stands under a smaller key."""
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.coalesce(fails.cast("int"), F.lit(0)) * (1 << i)
    digest = F.unhex(F.sha2(C.text_of(text).cast("binary"), 256))
    rows = df.select(F.col(key).alias("_id"), digest.alias("_digest"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"), mask.alias("_mask"))
    rows = C.staged(rows.groupBy("_id", "_digest", "_part", "_mask").agg(F.count("*").alias("n")), "failed-sets")
    if repeats is None:
        return rows.drop("_digest")
    firsts = rows.groupBy("_digest").agg(F.min("_id").alias("_id")).where("_id is not null").withColumn("_first", F.lit(True))
    known = rows.join(firsts, ["_digest", "_id"], "left")
    again = F.col("_id").isNotNull() & F.col("_first").isNull()
    return known.select("_id", "_part", (F.col("_mask") + F.when(again, 1 << len(filters)).otherwise(0)).alias("_mask"), "n")


def labelled(sets: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """_part, _mask, n documents, of which `good` and `toxic` are labelled so;
    2**k rows a part at most."""
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id"))
    marks = marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # Rows without a key have no partner: spread them by their part and set.
    pad = F.when(F.col("_id").isNull(), F.xxhash64("_part", "_mask", "n")).otherwise(0)
    known = sets.withColumn("_pad", pad).join(marks.withColumn("_pad", F.lit(0).cast("long")), ["_id", "_pad"], "left")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return known.groupBy("_part", "_mask").agg(F.sum("n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))


def edges(counts: DataFrame, k: int) -> DataFrame:
    """_part, _applied (bits of the filters applied before), _next (the bit of
    the next one), the measures of this edge, and the filter's Shapley sum. A
    part has all its edges, with zeros where nothing happens."""
    every = [(s, 1 << f) for s in range(1 << k) for f in range(k) if not s >> f & 1]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s, f in every]))
    rows = counts.select("*", each.alias("_edge")).select("*", F.col("_edge.applied").alias("_applied"), F.col("_edge.next").alias("_next"))
    before, here = F.col("_mask").bitwiseAND(F.col("_applied")) != 0, F.col("_mask").bitwiseAND(F.col("_next")) != 0
    when = {"kept": ~before & ~here, "removed": ~before & here, "redundant": before & here, "unique_fails": F.col("_mask") == F.col("_next")}
    sums = [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in when.items()]
    sums += [F.sum(F.when(~before & here, F.col(c)).otherwise(0)).alias(f"{c}_lost") for c in ("good", "toxic")]
    out = rows.groupBy("_part", "_applied", "_next").agg(*sums)
    # Orders that run through an edge; a part and filter have 2**(k-1) edges.
    orders = F.array(*[F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)])[F.bit_count("_applied")]
    return out.withColumn("shapley", F.sum(F.col("removed") * orders).over(W.partitionBy("_part", "_next")).cast("long"))


def audit(df: DataFrame, labels: DataFrame, filters: dict[str, Column], repeats: str | None = None, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, filter, the measures and shapley, for every
    part, order of the filters and step."""
    names = [*filters, *([repeats] if repeats else [])]
    if not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters can be audited")
    bit = {name: 1 << i for i, name in enumerate(names)}
    steps = [("".join(order), i + 1, name, sum(bit[x] for x in order[:i]), bit[name]) for order in permutations(names) for i, name in enumerate(order)]
    paths = df.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, _applied int, _next int")
    found = edges(labelled(failed_sets(df, filters, repeats, key, text, part), labels, key), len(names))
    return found.join(F.broadcast(paths), ["_applied", "_next"]).select(F.col("_part").alias("part"), "filter_order", "step", "filter", *MEASURES, "shapley")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return audit(docs, labels, text_filters(C.text_of("text")), repeats="E")


ORACLE_SQL = r"""with d as (select doc_id, coalesce(text, '') t, coalesce(lang, '') part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
 m as (select doc_id, part, (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::int
   + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int m from d),
 l as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id),
 g as (select part, m, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from m left join l using (doc_id) group by part, m),
 f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(c, b)),
 o as (select p.c || q.c || r.c || s.c || t.c filter_order, [p.b, q.b, r.b, s.b, t.b] b from f p, f q, f r, f s, f t where p.b + q.b + r.b + s.b + t.b = 31 and (p.b | q.b | r.b | s.b | t.b) = 31),
 s as (select filter_order, step::int step, filter_order[step] "filter", coalesce(list_sum(b[1:step - 1]), 0)::int a, b[step] b from (select *, unnest([1, 2, 3, 4, 5]) step from o)),
 x as (select part, filter_order, step, "filter", sum(n) filter (m & (a | b) = 0) kept, sum(n) filter (m & a = 0 and m & b <> 0) removed, sum(n) filter (m & a <> 0 and m & b <> 0) redundant,
   sum(n) filter (m = b) unique_fails, sum(good) filter (m & a = 0 and m & b <> 0) good_lost, sum(toxic) filter (m & a = 0 and m & b <> 0) toxic_lost from g, s group by part, filter_order, step, "filter")
 select part, filter_order, step, "filter", coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed, coalesce(redundant, 0)::bigint redundant, coalesce(unique_fails, 0)::bigint unique_fails,
  coalesce(good_lost, 0)::bigint good_lost, coalesce(toxic_lost, 0)::bigint toxic_lost, (sum(coalesce(removed, 0)) over (partition by part, "filter"))::bigint shapley from x"""
