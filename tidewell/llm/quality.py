"""Quality classifier by importance resampling (operator 9).

Two generative models of hashed n-grams are counted: one over all documents
(raw), one over documents known to be good (target). A document's log weight
is the sum over its n-grams of log(target / raw); documents are then drawn
without replacement in proportion to their weights by adding Gumbel noise,
seeded by document, and taking the k greatest keys. By default k is the number
of documents that the target model explains at least as well as the raw one.

The n-grams are words and pairs of words, lower-cased, and one to three word
shapes in a row: the letter case, digits and punctuation of a word, and whether
it repeats the word before it. Words tell what a text is about; prose in any
language has few shapes, while menus, shouting, symbol noise and stuttering
have others. Per bucket the ratio is (t + s) / (e + s), where t is the target
count, e what the raw model expects of it and s a prior, so that n-grams seen a
few times (also those that only the document itself has) count for little
either way.

The raw model counts all rows. The target model counts the labelled good
documents among at most `most_labels` labelled rows, those with the smallest
hashes of their ids: a stated bound on what is sent to the tasks. The k-th
greatest key is found by counting keys in ever narrower bins, not by a sort.

Defined cases: a null or empty text has log weight 0 and counts as one that
the target model explains as well; rows of equal doc_id and text get equal
keys and are kept or rejected together (ties at the cut are all kept); without
labels all weights are 0; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import _words as words

BUCKETS = 1 << 15
MOST_LABELS = 50_000
PRIOR = 200.0
SEED = 7_919


def ngrams(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of the word and shape n-grams of each text."""
    w = words.split(texts)
    shape, name, word = w.shapes(), w.hashes(lower=False), w.hashes()
    if not len(shape):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.zeros(len(name), np.uint64)
    same[1:] = (name[1:] == name[:-1]) & (w.doc[1:] == w.doc[:-1])
    own = words.mix(shape + same)
    found = [(own, w.doc), words.ngrams(own, w.doc, 2), words.ngrams(own, w.doc, 3)]
    found += [(words.mix(word + np.uint64(1)), w.doc), words.ngrams(word, w.doc, 2)]
    return (np.concatenate([f[0] for f in found]) % np.uint64(buckets)).astype(np.int64), np.concatenate([f[1] for f in found])


def good_ids(labels: DataFrame, most: int = MOST_LABELS, key: str = "doc_id", label: str = "quality") -> list[int]:
    """Ids labelled good among the `most` labelled rows of smallest hash."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, label)
    first = rows.orderBy(F.xxhash64(F.lit(SEED), key), key).limit(most).collect()
    return sorted({r[0] for r in first if r[1] == 1})


def fit(df: DataFrame, good: list[int], buckets: int = BUCKETS, prior: float = PRIOR, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """log(target / raw) by bucket."""
    rows = df.select(F.col(key).cast("long").alias("_id"), C.text_of(text).cast("binary").alias("_text"))

    def run(batches):
        chosen = np.array(good, np.int64)
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in C.sliced(batches, "_text", 2 << 20):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            hit = np.isin(np.where(ids == ids, ids, -(2**62)).astype(np.int64), chosen) if len(chosen) else np.zeros(len(ids), bool)
            found, doc = ngrams(batch.column(1).to_pylist(), buckets)
            raw += np.bincount(found, minlength=buckets)
            target += np.bincount(found[hit[doc]], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (seen, raw[seen], target[seen])], names=["b", "raw", "target"])

    sums = rows.mapInArrow(run, "b long, raw long, target long").groupBy("b").agg(F.sum("raw"), F.sum("target")).collect()  # `buckets` rows at most
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for b, r, t in sums:
        raw[b], target[b] = r, t
    if not target.sum():
        return np.zeros(buckets)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + prior) / (expected + prior))


def gumbel(seed: int, key, text_digest: bytes) -> float:
    """Standard Gumbel noise from the document's id and text."""
    h = hashlib.blake2b(f"{seed}:{key}:".encode() + text_digest, digest_size=8).digest()
    u = (int.from_bytes(h, "little") + 0.5) / 2.0**64
    return -math.log(-math.log(u))


def scores(df: DataFrame, ratio: np.ndarray, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of df, n_grams, log_weight, sample_key."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = dict(df.dtypes)
    kept = [c for c in df.columns if c not in ("n_grams", "log_weight", "sample_key")]
    full = ", ".join([f"`{c}` {types[c]}" for c in kept] + ["n_grams long, log_weight double, sample_key double"])
    arrow = to_arrow_schema(StructType.fromDDL(full))

    def run(batches):
        for batch in C.sliced(batches, "_text", 2 << 20):
            texts = batch.column(len(kept)).to_pylist()
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            found, doc = ngrams(texts, len(ratio))
            weights = np.round(np.bincount(doc, ratio[found], minlength=len(texts)), 9)
            sampled = [w + gumbel(seed, k, hashlib.md5(t).digest()) for w, k, t in zip(weights.tolist(), keys, texts)]
            new = [pa.array(np.bincount(doc, minlength=len(texts)), pa.int64()), pa.array(weights, pa.float64()), pa.array(sampled, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], schema=arrow)

    return df.select(*kept, C.text_of(text).cast("binary").alias("_text")).mapInArrow(run, full)


def kth_greatest(df: DataFrame, column: str, k: int, bins: int = 4096, few: int = 4096) -> float:
    """The k-th greatest value, exactly, by counting in narrower bins."""
    if k <= 0:
        return math.inf
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if low is None:
        return math.inf
    if k >= n:
        return low
    above = 0  # rows over `high`
    while low < high:
        width = (high - low) / bins
        inside = df.where(F.col(column).between(low, high))
        if not width or low + width == low:
            break
        b = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width)).alias("b")
        counts = inside.groupBy(b).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("b")).collect()
        for r in counts:
            if above + r.n >= k:
                low, high = r.low, r.high
                break
            above += r.n
        if r.n <= few:
            rest = sorted((x[0] for x in df.where(F.col(column).between(low, high)).select(column).collect()), reverse=True)
            return rest[k - above - 1]
    return low


def resample(df: DataFrame, labels: DataFrame, k: int | None = None, most_labels: int = MOST_LABELS, seed: int = SEED, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] | None = None, prior: float = PRIOR) -> DataFrame:
    """Fit, score and draw: `columns` of df (key alone by default), n_grams,
    log_weight, sample_key, kept."""
    C.small_batches(df.sparkSession)
    ratio = fit(df, good_ids(labels, most_labels), prior=prior, key=key, text=text)
    wide = df.select(*dict.fromkeys([*(columns or (key,)), key, text]))
    scored = scores(wide, ratio, seed, key, text)
    scored = C.staged(scored.select(*(columns or (key,)), "n_grams", "log_weight", "sample_key"), "quality-scores")
    if k is None:
        k = scored.where("log_weight >= 0").count()
    least = kth_greatest(scored, "sample_key", k)
    return scored.withColumn("kept", F.col("sample_key") >= F.lit(least))


def op9_quality_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(docs, labels)
