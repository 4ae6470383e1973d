"""What analysts ask for: filters, statistics, the work queue, scorecards and
alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import dates as D
from ..functions import scoring as S
from ..functions import text as T
from ..functions import vocab as V
from ..functions.text import joined, nz, strip


def by_region(df: DataFrame, words: list[str]) -> DataFrame:
    """Rows that name any of the words in title, description, company or
    regions; all rows without words."""
    t = F.lower(joined(F.col("title"), F.col("description"), F.col("company_name"), F.array_join(F.coalesce("matched_regions", F.array().cast("array<string>")), " ")))
    return df.where(V.holds_any(t, [w.lower() for w in words])) if words else df


def by_grade(df: DataFrame, grades: list[str], ungraded: bool = True) -> DataFrame:
    g = F.upper(strip(nz(F.col("grade"))))
    return df.where(F.when(g.isin("", "NONE", "NAN"), F.lit(ungraded)).otherwise(g.isin([x.upper() for x in grades]))) if grades else df


def by_band(df: DataFrame, bands: list[str], unknown: bool = True) -> DataFrame:
    """By the revenue segment of the first listed primary company."""
    band = T.revenue_band(S.listed_primary(F.col("companies_data"))["revenue"])
    return df.where(F.when(nz(band) == "", F.lit(unknown)).otherwise(band.isin(bands))) if bands else df


def search(df: DataFrame, needle: str, columns: tuple[str, ...] = ("title", "company_name", "description")) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(nz(F.col(c))), F.lit(needle.lower()))
    return df.where(hit) if needle else df


def display_company(df_fit: Column, scraped: Column, companies: Column) -> Column:
    """The company to show: the account, the scraped name, the first listed
    primary company, or "Unknown Company"."""
    clean = strip(nz(scraped))
    return F.coalesce(T.blank_to_null(strip(nz(df_fit["account_name"]))), F.when(~F.lower(clean).isin(V.UNKNOWN_NAMES), clean), T.blank_to_null(strip(nz(S.listed_primary(companies)["name"]))), F.lit("Unknown Company"))


def finance_leader(event_type: Column, hashtags: Column) -> Column:
    return (event_type == "cfo_hire") | F.coalesce(F.array_contains(hashtags, "#NewController"), F.lit(False))


def undecided(df: DataFrame, dispositions: DataFrame, key: str = "id", company: str = "display_company", companies: str = "companies_data") -> DataFrame:
    """Events none of whose two account keys has a disposition: two equi-joins
    through exploded keys instead of an OR."""
    both = F.array(T.account_key(F.col(company)), T.account_key(S.pick_primary(F.col(companies))["name"]))
    keys = df.select(key, F.explode(F.array_distinct(both)).alias("company_key")).where("company_key <> ''")
    hidden = keys.join(dispositions.select("company_key").distinct(), "company_key", "left_semi").select(key).distinct()
    return df.join(hidden, key, "left_anti")


def work_queue(df: DataFrame, company: str, grade: str, score: str, found: str, key: str, most: int = 10) -> DataFrame:
    """The best event of each company (grade, score, oldest first) with the
    number of its others; companies by their best event.

    One aggregation with partial results instead of a window, so that a company
    with very many events stays in pieces."""
    name = F.lower(strip(nz(F.col(company))))
    who = F.when(name.isin("", "unknown company"), F.concat(F.lit("__solo_"), F.col(key).cast("string"))).otherwise(name)
    place = F.struct(S.queue_rank(F.col(grade)).alias("grade_rank"), (-F.coalesce(F.col(score).cast("long"), F.lit(-1))).alias("minus_score"), F.col(found).alias("found"), F.col(key).alias("key"))
    best = df.select(who.alias("company_key"), place.alias("_place")).groupBy("company_key").agg(F.min("_place").alias("best"), (F.count("*") - 1).alias("others"))
    return best.select("company_key", F.col("best.key").alias(key), F.col("best.grade_rank").alias("grade_rank"), (-F.col("best.minus_score")).alias("score"), F.col("best.found").alias(found), "others").orderBy("grade_rank", F.desc("score"), found, key).limit(most)


def remaining(df: DataFrame, company: str, key: str, most: int = 10) -> DataFrame:
    """One row: how many companies the queue's first `most` leave out."""
    name = F.lower(strip(nz(F.col(company))))
    who = F.when(name.isin("", "unknown company"), F.concat(F.lit("__solo_"), F.col(key).cast("string"))).otherwise(name)
    return df.select(who.alias("c")).distinct().agg(F.greatest(F.count("*") - most, F.lit(0)).alias("remaining"))


def page(df: DataFrame, ts: str, key: str, size: int, after: tuple | None = None) -> DataFrame:
    """The newest `size` rows, or those that follow (ts, key) of the last row
    of the page before: no page costs more than the first."""
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        df = df.where((F.col(ts) < at) | (F.col(ts) == at) & (F.col(key) > last))
    return df.orderBy(F.desc(ts), key).limit(size)


def newest(df: DataFrame, ts: str, key: str, most: int = 200) -> DataFrame:
    return df.orderBy(F.desc(ts), key).limit(most)


def since_hours(df: DataFrame, ts: str, key: str, as_of: Column, hours: int, kind: str | None = None, most: int | None = None) -> DataFrame:
    """Events of the last hours (of a type), newest first."""
    out = df.where(F.col(ts) > D.since(as_of, hours))
    out = out if kind is None else out.where(F.col("event_type") == kind)
    out = out.orderBy(F.desc(ts), key)
    return out.limit(most) if most else out


def with_disposition(df: DataFrame, dispositions: DataFrame, company: str = "display_company") -> DataFrame:
    """Each row with its company's disposition (status and time), if any."""
    known = dispositions.select("company_key", F.col("status").alias("disposition"), F.col("updated_at").alias("disposition_at"))
    return df.withColumn("company_key", T.account_key(F.col(company))).join(known, "company_key", "left")


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def stats(df: DataFrame, kind: str, ts: str, as_of: Column, hours: int = 24) -> DataFrame:
    """Events of each type, and of those the ones of the last hours."""
    return df.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(F.col(ts) >= D.since(as_of, hours)).alias("n_recent"))


def scorecard(df: DataFrame, as_of: Column, found: str = "discovered_at", blocked: str = "blocked_at") -> DataFrame:
    """One row: this week's and last week's events, tombstones of the week."""
    week = lambda n: as_of - F.expr(f"INTERVAL {7 * n} DAYS")
    f, b = F.col(found), F.col(blocked)
    return df.agg(F.count_if(f >= week(1)).alias("this_week"), F.count_if((f >= week(2)) & (f < week(1))).alias("last_week"), F.count_if(b >= week(1)).alias("removed")).withColumn("delta", F.col("this_week") - F.col("last_week"))


def top_counts(df: DataFrame, label: Column, most: int) -> DataFrame:
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most)


def note_budget(notes: DataFrame, key: str, pos: str, length: Column, budget: int = 1000, most: int = 8) -> DataFrame:
    """Notes in order while their lengths fit into the budget, at most `most`.
    Lengths add up, so the first overflow ends the prefix."""
    w = W.partitionBy(key).orderBy(pos)
    out = notes.withColumn("_sum", F.sum(length).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return out.where((F.col("_sum") <= budget) & (F.col("_n") <= most)).drop("_sum", "_n")


def enrichment_queue(df: DataFrame, again: bool = False, missing_fit: bool = False, unverified: bool = False, complexity: bool = False, limit: int | None = None) -> DataFrame:
    """Events to enrich, oldest first; the modes add up."""
    out = df.where("blocked_at is null")
    out = out if again else out.where("enriched_at is null")
    out = out.where("fit is null") if missing_fit else out
    out = out.where("fit.verdict = 'unverified'") if unverified else out
    if complexity:
        out = out.where((F.col("grade") == "B") & (F.col("fit.verdict") == "pass") & F.col("event_type").isin("cfo_hire", "merger_acquisition", "funding"))
    out = out.orderBy("discovered_at", "id")
    return out.limit(limit) if limit else out


# ---------------------------------------------------------------- alerts


def alert_text(df: DataFrame) -> Column:
    """A plain alert of an event."""
    line = lambda label, c: F.when(nz(c) != "", F.concat(F.lit(label), c))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.upper(F.col("event_type")), F.lit("] "), F.col("title")),
        line("Company: ", F.col("company_name")),
        line("Published: ", D.minute_text(F.col("published_date"))),
        line("Relevance: ", F.format_string("%.0f", F.col("relevance_score"))),
        line("URL: ", F.col("url")),
        line("", F.left(F.col("description"), F.lit(200))),
    )


def _shown(df: DataFrame, order: list, each: int, entry: Column) -> DataFrame:
    """event_type, n (all rows of the type), and `shown`: the entries of its
    first `each` rows. The limit is applied before the shuffle as well, so a
    type's rows never meet in one task."""
    place = F.row_number().over(W.partitionBy("event_type").orderBy(*order))
    top = df.withColumn("_n", place).where(F.col("_n") <= each)
    top = top.groupBy(F.col("event_type").alias("_type")).agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), entry.alias("entry")))).alias("_e"))  # `each` at most
    counts = df.groupBy("event_type").agg(F.count("*").alias("n"))
    both = counts.join(top, F.col("event_type").eqNullSafe(F.col("_type")))
    return both.select("event_type", "n", F.transform("_e", lambda x: x["entry"]).alias("shown"))


def batch_alerts(df: DataFrame, order: str = "relevance_score", each: int = 500) -> DataFrame:
    """event_type, n, body: the first `each` alerts of a type, types in the
    display order; n counts all."""
    grouped = _shown(df, [F.desc(order), "id"], each, alert_text(df))
    at = F.array_position(V.words(V.EVENT_TYPES), F.col("event_type"))
    return grouped.select("event_type", "n", F.array_join("shown", "\n\n").alias("body"), at.alias("_at")).orderBy("_at").drop("_at")


def slack_blocks(df: DataFrame, each: int = 3) -> DataFrame:
    """event_type, block: JSON with a count and the top entries."""
    grouped = _shown(df.select("event_type", "relevance_score", "id", "title", "url"), [F.desc("relevance_score"), "id"], each, F.struct("title", "url"))
    top = F.transform("shown", lambda x, i: F.struct((i + 1).alias("n"), x["title"].alias("title"), x["url"].alias("url")))
    return grouped.select("event_type", F.to_json(F.struct("event_type", "n", top.alias("top"))).alias("block"))


def run_summary(df: DataFrame, as_of: Column, most: int = 10) -> DataFrame:
    return df.orderBy(F.desc("published_date"), F.desc("relevance_score"), "id").limit(most).select("id", "title", "event_type", D.age_text(F.col("published_date"), as_of).alias("age"), "relevance_score")


def desktop_text(df: DataFrame) -> DataFrame:
    """One row: the text of a notification with counts of the types there are."""
    of = lambda t, label: F.when(F.count_if(F.col("event_type") == t) > 0, F.concat(F.count_if(F.col("event_type") == t).cast("string"), F.lit(" " + label)))
    parts = F.concat_ws(", ", of("cfo_hire", "CFO hires"), of("executive_hire", "executive hires"), of("merger_acquisition", "deals"), of("funding", "fundings"))
    return df.agg(F.count("*").alias("n"), parts.alias("text"))


def html_mail(df: DataFrame, as_of: Column, each: int = 500) -> DataFrame:
    """event_type, n, html: the newest `each` entries of a type; n counts all,
    so a reader sees what a mail has left out."""
    esc = lambda c: F.replace(F.replace(F.replace(nz(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    item = F.concat(F.lit('<li><a href="'), esc(F.col("url")), F.lit('">'), esc(F.col("title")), F.lit("</a> <i>"), D.age_text(F.col("published_date"), as_of), F.lit("</i><p>"), esc(F.left(F.col("description"), F.lit(200))), F.lit("</p></li>"))
    grouped = _shown(df, [F.col("published_date").cast("timestamp").desc_nulls_first(), "id"], each, item)
    return grouped.select("event_type", "n", F.concat(F.lit("<ul>"), F.array_join("shown", ""), F.lit("</ul>")).alias("html"))
