"""Texts by thousands of keywords: an index of rare parts, then exact tests.

A text holds a keyword (as `contains` says, anywhere) only if it holds each
three-letter part of it. Every keyword is filed under its rarest part that lies
between blanks, by counts over all texts; a text's distinct parts are looked up
in that table, and only the keywords found there are searched for in the text.
What a text costs grows with its parts and its candidates, not with the list.
Keywords that hold no blank lie inside a word, so they are looked for in the
distinct words of all texts, and a text costs a look-up of its words. Keywords without such a part (of one or two letters between blanks) are searched
for in every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nz
from .store import staged

PART = 3
BLANKS = r"[\x20\x09-\x0D]+"
#: Rows of the table of parts that are sent to every task; beyond, it is joined
#: by shuffles.
FEW = 500_000


def parts(text: Column, n: int = PART) -> Column:
    """The distinct n-letter parts of a text that have no blank in them."""
    words = F.array_distinct(F.split(text, BLANKS))
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - n + 1), lambda i: F.substr(w, i, F.lit(n)))
    # Words of any length are cut in pieces first: a letter is found by
    # counting from the start.
    pieces = F.flatten(F.transform(words, lambda w: F.when(F.char_length(w) <= 64, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(w), F.lit(48)), lambda i: F.substr(w, i, F.lit(48 + n - 1))))))
    return F.array_distinct(F.flatten(F.transform(F.filter(pieces, lambda w: F.char_length(w) >= n), cut)))


def _few(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() <= FEW


def index(keywords: DataFrame, texts: DataFrame | None = None, text: str = "text", keyword: str = "keyword", n: int = PART) -> tuple[DataFrame, DataFrame]:
    """(part, keyword) with each keyword under its rarest part, in as many
    `texts` as possible counts, else among the keywords themselves; and the
    keywords that have none. Keywords are lower-case, distinct and not blank."""
    rows = keywords.select(F.lower(F.col(keyword)).alias("keyword")).where("keyword <> ''").distinct()
    cut = rows.select("keyword", F.explode_outer(parts(F.col("keyword"), n)).alias("part"))
    short = cut.where("part is null").select("keyword")
    cut = cut.where("part is not null")
    wanted = cut.select("part").distinct()
    if texts is None:
        counts = cut.groupBy("part").agg(F.count("*").alias("n"))
    else:
        own = texts.select(F.explode(parts(F.lower(nz(F.col(text))), n)).alias("part"))
        counts = own.join(F.broadcast(wanted) if _few(wanted) else wanted, "part").groupBy("part").agg(F.count("*").alias("n"))
    ranked = cut.join(counts, "part", "left").groupBy("keyword").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part")).alias("best"))
    return ranked.select(F.col("best.part").alias("part"), "keyword"), short


def matches(df: DataFrame, keywords: DataFrame, key: str = "id", text: str = "text", keyword: str = "keyword", counted: bool = True, n: int = PART) -> DataFrame:
    """key, keyword: the keywords that each (lower-cased) text contains, those
    of all rows of a key together. Parts of n letters: where texts are alike in
    their short parts, longer ones tell more; keywords without a part of n
    letters are searched for everywhere."""
    rows = df.select(F.col(key).alias("_key"), F.lower(nz(F.col(text))).alias("_text"))
    wanted = keywords.select(F.lower(F.col(keyword)).alias("keyword")).where("keyword <> ''").distinct()
    inner = F.rlike("keyword", F.lit(BLANKS))
    found = within_words(rows, wanted.where(~inner), counted, n)
    phrases = staged(wanted.where(inner))
    if not phrases.isEmpty():
        table, short = index(phrases, df if counted else None, text, n=n)
        table = F.broadcast(table) if _few(phrases) else table
        # Candidates are tested where they are found: the text stays in its row.
        parted = rows.select("_key", "_text", F.explode(parts(F.col("_text"), n)).alias("part"))
        found = found.union(parted.join(table, "part").where(F.contains(F.col("_text"), F.col("keyword"))).select("_key", "keyword"))
        found = _everywhere(found, rows, short)
    found = _everywhere(found, rows, wanted.where(~inner & (F.char_length("keyword") < n)))
    return found.distinct().withColumnRenamed("_key", key)


def _everywhere(found: DataFrame, rows: DataFrame, short: DataFrame) -> DataFrame:
    """Keywords with nothing of n letters between blanks: few."""
    tiny = sorted(r[0] for r in short.collect())
    if not tiny:
        return found
    held = F.filter(F.array(*map(F.lit, tiny)), lambda k: F.contains(F.col("_text"), k))
    return found.union(rows.select("_key", F.explode(held).alias("keyword")))


def within_words(rows: DataFrame, keywords: DataFrame, counted: bool, n: int) -> DataFrame:
    """_key, keyword for keywords of n letters or more without a blank: such a
    keyword is held by a text if one of its words holds it. Words of all texts
    are looked at once each; texts only look up which of theirs hold any."""
    own = F.filter(F.array_distinct(F.split("_text", BLANKS)), lambda w: F.char_length(w) >= n)
    words = rows.select("_key", F.explode(own).alias("word"))
    long = keywords.where(F.char_length("keyword") >= n)
    vocabulary = words.select("word").distinct()
    table, _ = index(long, vocabulary if counted else None, "word", n=n)
    table = F.broadcast(table) if _few(long) else table
    parted = vocabulary.select("word", F.explode(parts(F.col("word"), n)).alias("part"))
    pairs = staged(parted.join(table, "part").where(F.contains(F.col("word"), F.col("keyword"))).select("word", "keyword"))
    return words.join(F.broadcast(pairs) if _few(pairs) else pairs, "word").select("_key", "keyword")


def first_matches(df: DataFrame, keywords: DataFrame, most: int, key: str = "id", text: str = "text", keyword: str = "keyword", rank: str = "rank", n: int = PART) -> DataFrame:
    """key, n (keywords that its text contains) and the first `most` of them in
    the order of `rank`; texts without any are left out."""
    order = keywords.select(F.lower(F.col(keyword)).alias("keyword"), F.col(rank).alias("_rank")).groupBy("keyword").agg(F.min("_rank").alias("_rank"))
    found = matches(df, keywords, key, text, keyword, n=n).join(order, "keyword")
    place = F.array_sort(F.collect_list(F.struct("_rank", "keyword")))
    return found.groupBy(key).agg(F.count("*").alias("n"), F.transform(F.slice(place, 1, most), lambda x: x["keyword"]).alias("keywords"))
