"""The scrape cycle parses and judges each entry once, and cheaper forms of its
steps give what the plain ones give."""

import random
import re

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import vocab as V
from tidewell.operators import gates
from tidewell.plans.articles import CFG
from tidewell.sources import readers


def filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if re.match(r"[ :+-]*Filter ", line)]


def test_filters_hold_no_copy_of_the_parser(spark):
    payloads = spark.createDataFrame([("a", "<rss><item><title>t</title></item></rss>")], "feed_name string, payload string")
    as_of = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    judged = readers.to_events(gates.feed_gate(readers.feed_entries(payloads), CFG), as_of)
    found = filters(judged.where(gates.recent(F.col("published_date"), as_of, 72)))
    assert any("_low" in f for f in found)
    assert not any("regexp_extract" in f or "concat_ws" in f for f in found)


def test_made_stays_below_filters(spark):
    df = spark.range(20).select(F.md5(F.col("id").cast("string").cast("binary")).alias("k"), "id")
    made = V.made(df)
    assert made.dtypes == df.dtypes
    kept = made.where("k > '8' and k < 'c'")
    assert not any("md5" in f for f in filters(kept)) and any("md5" in f for f in filters(df.where("k > '8' and k < 'c'")))
    assert sorted(kept.collect()) == sorted(df.where("k > '8' and k < 'c'").collect())


def plain_strip_html(t):
    t = re.sub(r"<[^>]+>", "", t or "")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        t = t.replace(entity, char)
    return re.sub(r"\s+", " ", t, flags=re.ASCII).strip(" \t\n\x0b\f\r")


def test_strip_html(spark):
    rng = random.Random(4)
    parts = ["a", "é", " ", "  ", "\n", "\t", "\r\n", "\x0b", " ", "<", ">", "<b>", "</p>", "&", "&amp;", "&lt;", "&nbsp;", "&amp;lt;", "&#39;", "x y"]
    texts = [None, "", " ", "\n", "a b", "a\nb", "\ta  b\t"] + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.strip_html(F.col("t")).alias("s"))
    assert {r.i: r.s for r in df.collect()} == {i: plain_strip_html(t) for i, t in enumerate(texts)}


def test_children_of_entries(spark):
    rows = [
        (0, "<item><title> A &amp;amp; B </title><dc:date>d</dc:date></item>", "A &amp; B", "d"),
        (1, "<item><title><![CDATA[ <b>&amp;</b> ]]></title ></item>", None, None),
        (2, "<item><title type='x'>\n<![CDATA[ <b>&amp;</b> ]]> </title><date/></item>", "<b>&amp;</b>", None),
        (3, "<item><subtitle>s</subtitle>title></item>", None, None),
        (4, None, None, None),
        (5, "<item><media:title>m</media:title><title>t</title><date>  </date></item>", "m", None),
    ]
    df = spark.createDataFrame([(i, x) for i, x, _, _ in rows], "i int, x string").select("i", readers.child(F.col("x"), "title").alias("a"), readers.child(F.col("x"), "date").alias("b"))
    assert {r.i: (r.a, r.b) for r in df.collect()} == {i: (a, b) for i, _, a, b in rows}
