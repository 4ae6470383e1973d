"""Document fingerprints: bottom-k sketches of shingle hashes (operator 5).

DataFrame functions only. A text's fingerprint is the k smallest distinct
64-bit hashes of its five-word shingles, with the number of hashes where there
are fewer. Fingerprints merge: the sketch of a union is made from the sketches
of its parts. From two of them follow resemblance (Jaccard), containment and
the number of distinct shingles.

Words are maximal runs of anything but ASCII white space, lower-cased; a text of
fewer words has its whole sequence as its only shingle.

Defined cases: a null or empty text, or one of blanks, has an empty sketch; two
empty sketches resemble each other fully (1), an empty and another not at all
(0); equal texts have equal sketches; repeated rows keep one row each; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import _common as C

K = 128
SHINGLE = 5


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of the n-word shingles, repeats included."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        last = F.greatest(F.size(h) - n, F.lit(0))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        )

    # Through an array of one, so that a text's words are hashed once.
    return F.element_at(F.transform(F.array(hashed), shingles), 1)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """The k smallest distinct shingle hashes, ascending; all if fewer."""
    return bottom(shingle_hashes(F.coalesce(text, F.lit("")), n), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what a and b are sketches of."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(hash_column: str, k: int = K) -> Column:
    """Aggregate: the sketch of exploded hashes of many parts. Collects the
    distinct hashes of a group; for large groups aggregate twice, over parts
    of the group first."""
    return F.slice(F.sort_array(F.collect_set(hash_column)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the merged sketch that both
    hold. Exact while both texts have at most k shingles together."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = F.element_at(a, -1).cast("double")
    share = (top + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    j = resemblance(a, b, k)
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / (1 + j) / na))


def as_text(a: Column) -> Column:
    """A sketch as a string of 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


KEY = ("_null", "_id", "_hash")


def keyed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_null, _id, _hash (which sort and join rows, null keys first) and text.
    Rows of equal key and text are one document."""
    t = C.text_of(text)
    return df.select(F.col(key).isNotNull().alias("_null"), F.coalesce(F.col(key), F.lit(0)).alias("_id"), F.xxhash64(t).alias("_hash"), t.alias("text"))


def followers(rows: DataFrame) -> DataFrame:
    """For each document its key, n_chars and the key of the next document,
    the first one's after the last. Only keys are sorted: one range
    partitioning, where the first row of each partition crosses over."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    small = rows.groupBy(*KEY).agg(F.max(F.length("text")).alias("n_chars"))
    small = small.repartitionByRange(parts, *KEY).withColumn("_part", F.spark_partition_id())
    small = C.staged(small, "by-key")
    name = F.struct(*KEY)
    firsts = small.groupBy("_part").agg(F.min(name).alias("_first"))
    w = W.orderBy("_part")  # a row for each partition that has any
    around = F.first("_first").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    heads = firsts.select("_part", F.coalesce(F.lead("_first").over(w), around).alias("_following"))
    own = F.lead(name).over(W.partitionBy("_part").orderBy(*KEY))
    return small.withColumn("_next", own).join(heads, "_part").select(*KEY, "n_chars", F.coalesce("_next", "_following").alias("_next"))


def with_next(df: DataFrame, k: int = K, n: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, and of the next document its sketch and its first
    floor(n_chars / 4) code points: texts are shuffled once, and those heads."""
    rows = keyed(df, key, text)
    nexts = followers(rows).select(*(F.col(c).alias(f"_of{c}") for c in KEY), "n_chars", *(F.col("_next")[c].alias(c) for c in KEY))
    head = F.substring(F.col("text"), F.lit(1), F.floor(F.col("n_chars") / 4).cast("int"))
    sent = rows.join(nexts, list(KEY)).select(*(F.col(f"_of{c}").alias(c) for c in KEY), head.alias("next_head"), sketch(F.col("text"), k, n).alias("next_sketch"))
    sent = sent.groupBy(*KEY).agg(F.first("next_head").alias("next_head"), F.first("next_sketch").alias("next_sketch"))
    return rows.join(sent, list(KEY)).select(F.when(F.col("_null"), F.col("_id")).alias(key), "text", "next_head", "next_sketch")


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    kept = F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))")
    rows = rows.select("doc_id", "n_chars", F.concat(kept, "next_head").alias("edited"), sketch(F.col("text")).alias("own"), "next_sketch")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "next_sketch", sketch(F.col("edited")).alias("changed"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed")).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_sketch")).alias("near_next"),
        F.round(distinct_shingles(F.col("own")), 1).alias("n_shingles"),
    )
