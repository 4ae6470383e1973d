"""A corpus pipeline of five stages. Each takes what its predecessor kept, as a
table, and all but the last return the columns of documents.

Defined cases, for every stage: a null text counts as empty; empty and very long
texts, rows without a key, repeated rows and columns of any name pass through
unless the stage's rule drops them; an empty table gives an empty table with the
same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import _common, byte_bpe, jaccard, mixing, quality, toxicity

#: Near-duplicates: shingles of five words, similarity of 0.8 or more.
SHINGLE, NUM, DEN = 5, 80, 100
#: Weights of the sources in code point order, repeating; words that the mix
#: takes as a share of all; uses of a document at most.
WEIGHTS, SHARE, USES = [3, 1, 2], 1.5, 2


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _neutral(docs: DataFrame) -> tuple[DataFrame, str, str, str]:
    """docs under names that clash with no result column, and the new names of
    doc_id, text and source."""
    names = {c: f"col{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names["doc_id"], names["text"], names["source"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws stay. Empty texts are as
    likely in both models and stay in the draw; rows of equal key and text are
    kept or rejected together, ties at the cut are all kept."""
    rows, key, text, _ = _neutral(docs)
    scored = quality.resample(rows, _labels(spark, sf_dir), key=key, text=text, columns=tuple(rows.columns))
    return scored.where("kept").select(*rows.columns).toDF(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5 stay, empty ones among them;
    equal texts have equal scores."""
    rows, _, text, _ = _neutral(docs)
    lexicon = toxicity.learn(docs.select("doc_id", "text"), _labels(spark, sf_dir))
    return toxicity.score(rows, lexicon, text=text, keep=tuple(rows.columns)).where("score < 0.5").select(*rows.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the least
    key, of rows with equal keys one, rows without a key last. Empty texts are
    no duplicates of each other."""
    return jaccard.first_of_each(docs, SHINGLE, NUM, DEN)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go, stay or come twice, so that sources meet their targets.
    Empty texts have no words to take and go; a null source is a source of its
    own; rows alike are taken alike."""
    rows, key, text, source = _neutral(docs)
    mixed = mixing.mix(rows, WEIGHTS, SHARE, USES, sources=source, text=text, key=key).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*rows.columns).toDF(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, encoded and decoded; an empty
    text has no tokens, repeated rows a result each."""
    import public_tokenizers as P

    return byte_bpe.digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: Learned models and components are beyond SQL; tests compare the stages with
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, _common.staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        _common.free(before)
    return docs
