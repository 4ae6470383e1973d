"""Target-distribution importance resampling (operator 13).

A document's features are its words and pairs of neighbouring words, hashed
into buckets. A bucket's gain is 1000 times the log of how much likelier it is
in target texts than in the corpus, floored; a document's weight is the floored
mean of the gains of its features, its score the weight plus Gumbel noise that
its key seeds, both whole numbers. The documents of the highest scores are
drawn.

Gains are an array of one number a bucket; a batch of texts is scored by
looking its features up there. Ranks follow from an exact histogram: scores are
whole numbers within bounds that do not depend on the corpus (some 100,000
values), so the counts of all scores, summed from the highest down, fit on the
driver and say where each score's ranks begin and at which score the draw ends.
Only rows at or over that score are shuffled. Within a score they are numbered
by key; so that a score which many rows share is no single task, its rows are
dealt out by ranges of keys, and each range starts where those before it end.

Words are runs of ASCII letters, A-Z lower-cased, digits and characters beyond
ASCII. The CRC of a pair goes on from that of its first word, so all CRCs of a
batch are computed byte by byte over arrays; very long words go through zlib.

Defined cases: a null or empty text, or one without words, has no features and
weight 0; a missing key seeds as an empty string and ranks behind the others of
its score; rows of equal key and score rank by their number of features, rows
alike in that, too, in any order; without target texts gains are those of
counts of zero; an empty table gives an empty table; other columns stay out.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import _common as C

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Ranges of keys into which the rows of one score are dealt.
RANGES = 200

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1)
_TABLE.setflags(write=False)
#: Words of more bytes are hashed one by one.
LONG = 48
_ONES = np.uint32(0xFFFFFFFF)


def _crc(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """CRC-32 of text[start : start + size] that goes on from crc."""
    state = crc ^ _ONES
    long = np.flatnonzero(sizes > LONG)
    order = np.argsort(-np.where(sizes > LONG, 0, sizes), kind="stable")  # longest first
    at, state = starts[order], state[order]
    left = np.bincount(np.where(sizes > LONG, 0, sizes), minlength=LONG + 1)
    alive = len(sizes) - np.cumsum(left)  # words of more than j bytes
    for j in range(LONG):
        n = int(alive[j])
        if not n:
            break
        s = state[:n]
        state[:n] = _TABLE[(s ^ text[at[:n] + j]) & 255] ^ (s >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ _ONES
    for i in long:
        a = starts[i]
        out[i] = zlib.crc32(text[a : a + sizes[i]], int(crc[i]))
    return out


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of all words and pairs of words, and words by text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edge = np.diff(_WORD[raw].view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    doc = np.searchsorted(firsts, starts, side="right") - 1
    words = np.bincount(doc, minlength=len(texts))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), words
    low, sizes = _LOWER[raw], ends - starts
    one = _crc(low, starts, sizes, np.zeros(len(starts), np.uint32))
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    blank = one[pair] ^ _ONES
    blank = _TABLE[(blank ^ np.uint32(32)) & 255] ^ (blank >> np.uint32(8)) ^ _ONES
    two = _crc(low, starts[pair + 1], sizes[pair + 1], blank)
    return (np.concatenate([one, two]) % np.uint32(buckets)).astype(np.int64), np.concatenate([doc, doc[pair]]), words


def _pieces(batches, most: int = 1 << 20):
    """(batch, texts) of about `most` bytes; a longer text comes alone."""
    for batch in C.sliced(batches, "_text", most):
        yield batch, [t or b"" for t in batch.column(batch.schema.get_field_index("_text")).to_pylist()]


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> list[int]:
    """Features by bucket over all rows: a row a bucket and task at most."""
    C.small_batches(df.sparkSession)

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for _, texts in _pieces(batches):
            sums += np.bincount(features(texts, buckets)[0], minlength=buckets)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(sums[seen], pa.int64())], names=["b", "n"])

    out = [0] * buckets
    for b, n in df.select(C.text_of(text).cast("binary").alias("_text")).mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n")).collect():
        out[b] = n
    return out


def gains(raw: list[int], target: list[int], scale: int = 1000) -> list[int]:
    """Floored log ratios with one added to each count."""
    k, s, t = float(len(raw)), float(sum(raw)), float(sum(target))
    return [math.floor(scale * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(raw, target)]


def noise(key: Column, seed: int = SEED, scale: int = 1000) -> Column:
    """Floored Gumbel noise of a key."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weights(df: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, n_words, n_features, weight."""
    C.small_batches(df.sparkSession)
    table = np.array(gain, np.int64)

    def run(batches):
        for batch, texts in _pieces(batches):
            found, doc, words = features(texts, len(table))
            n = np.bincount(doc, minlength=len(texts))
            total = np.zeros(len(texts), np.int64)
            np.add.at(total, doc, table[found])
            weight = np.floor_divide(total, np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, n, weight))], names=["_id", "n_words", "n_features", "weight"])

    rows = df.select(F.col(key).cast("long").alias("_id"), C.text_of(text).cast("binary").alias("_text"))
    return rows.mapInArrow(run, "_id long, n_words long, n_features long, weight long")


def offsets(scored: DataFrame, fits: Column, percent: int) -> tuple[list[tuple[int, int]], int]:
    """(score, rows of higher scores) of every score that is drawn, and the
    number of rows drawn. A row for each whole number that is a score."""
    counts = dict(scored.where(fits).groupBy("score").agg(F.count("*")).collect())
    most, above, out = percent * sum(counts.values()) // 100, 0, []
    for score in sorted(counts, reverse=True):
        if above >= most:
            break
        out.append((score, above))
        above += counts[score]
    return out, most


def ranked(rows: DataFrame, starts: list[tuple[int, int]]) -> DataFrame:
    """rows (of the scores in starts) with `rank`: by score down, then by key.
    The rows of a score are numbered range by range of keys."""
    spark = rows.sparkSession
    table = spark.createDataFrame(starts, "score long, _start long")  # a row a score
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    bounds = rows.agg(F.percentile_approx("_id", shares, F.lit(10 * RANGES))).first()[0]  # one sketch
    bounds = sorted(set(bounds or []))
    # Any bounds give right ranks; these make ranges of like size.
    place = F.lit(0) if not bounds else F.when(F.col("_id").isNull(), len(bounds) + 1).otherwise(F.array_size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_id"))))
    rows = rows.withColumn("_range", place.cast("int"))
    group = ["score", "_range"]
    sums = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    before = W.partitionBy("score").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # RANGES rows
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(table), "score")
    sums = sums.select(*group, (F.col("_start") + F.col("_before")).alias("_start"))
    own = F.row_number().over(W.partitionBy(*group).orderBy(F.col("_id").asc_nulls_last(), "n_features"))
    return rows.withColumn("_own", own).join(sums, group).withColumn("rank", F.col("_start") + F.col("_own")).drop("_range", "_own", "_start")


def resample(df: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """key, n_words, n_features, weight, score and rank of every row; rank is
    null where the row is not drawn."""
    gain = gains(bucket_counts(df, text, buckets), bucket_counts(target, target_text, buckets))
    scored = weights(df, gain, key, text)
    scored = C.staged(scored.withColumn("score", F.col("weight") + noise(F.col("_id"), seed)), "target-scores")
    fits = F.col("n_words") >= least_words
    starts, most = offsets(scored, fits, percent)
    drawn = fits & (F.col("score") >= (starts[-1][0] if starts else 0)) & F.lit(bool(starts))
    first = ranked(scored.where(drawn), starts) if starts else scored.limit(0).withColumn("rank", F.lit(None).cast("long"))
    rest = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    rank = F.when(F.col("rank") <= most, F.col("rank")).alias("rank")
    return first.unionByName(rest).select(F.col("_id").alias(key), "n_words", "n_features", "weight", "score", rank)


def op13_target_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(docs, benchmark)


#: CRC-32 by the table method over each distinct feature's bytes.
ORACLE_SQL = r"""with recursive t0 as (select i::uinteger v, i::uinteger i, 0 k from range(256) r(i) union all select case when v & 1 = 1 then xor(v >> 1, 3988292384::uinteger) else v >> 1 end, i, k + 1 from t0 where k < 8),
 tab as materialized (select list(v order by i) t from t0 where k = 8),
 d as materialized (select 0 s, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
   union all select 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
 f as materialized (select s, doc_id, unnest(w) f from d union all select s, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from d),
 c as materialized (select s, doc_id, f, count(*) n from f group by all),
 z as (select f, hex(encode(f)) h from (select distinct f from c)),
 b as materialized (select f, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::uinteger),
   lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8), 4294967295::uinteger), 4294967295::uinteger) % 10000 b from z, tab),
 g0 as (select b, sum(n) filter (s = 0) s, sum(n) filter (s = 1) t from c join b using (f) group by b), tot as (select coalesce(sum(s), 0)::double s, coalesce(sum(t), 0)::double t from g0),
 g as (select b, floor(1000 * ln((coalesce(g0.t, 0) + 1.0::double) * (tot.s + 10000) / ((coalesce(g0.s, 0) + 1.0::double) * (tot.t + 10000))))::bigint g from g0, tot),
 w as (select doc_id, sum(n)::bigint n, floor(sum(n * g)::double / sum(n))::bigint w from c join b using (f) join g using (b) where s = 0 group by doc_id),
 r as (select d.doc_id, len(d.w) k, coalesce(w.n, 0) n, coalesce(w.w, 0) w, ('0x' || left(sha256('7:' || d.doc_id), 8))::bigint h from d left join w using (doc_id) where s = 0),
 q as (select *, w + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint score from r),
 o as (select doc_id, row_number() over (order by score desc, doc_id) rank, count(*) over () total from q where k >= 20)
 select q.doc_id, k::bigint n_words, n n_features, w weight, score, case when rank <= 25 * total // 100 then rank end rank from q left join o using (doc_id)"""
