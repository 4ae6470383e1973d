"""Readers: feeds, search results, filings, jobs, leads, sheets and health
files. Payloads are columns (fetched by `providers.fetch` or read from files);
parsing is done by Spark's own JSON and XML functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..functions.text import nz, strip

LEAD_SCHEMA = (
    "title string, company_name string, url string, event_type string, description string, company_location string, "
    "person_name string, person_title string, relevance_score double, published_date string, lead_status string, notes string"
)
NEWS_SCHEMA = "value array<struct<name: string, url: string, description: string, datePublished: string, provider: array<struct<name: string>>>>"
FILING_SCHEMA = (
    "hits struct<hits: array<struct<_source: struct<ciks: array<string>, display_names: array<string>, adsh: string, file_type: string, "
    "items: array<string>, biz_states: array<string>, file_date: string>>>>"
)
JOB_SCHEMA = (
    "results array<struct<title: string, company: struct<display_name: string>, location: struct<area: array<string>, display_name: string>, "
    "redirect_url: string, description: string, created: string>>"
)
FILER_SCHEMA = "addresses struct<business: struct<stateOrCountry: string>>, sic string, sicDescription string"
NONPROFIT_SCHEMA = "organization struct<name: string, ein: string>, filings_with_data array<struct<tax_prd_yr: int, totrevenue: double, totfuncexpns: double>>"
HEALTH_SCHEMA = (
    "source_name string, source_type string, total_requests long, successful_requests long, failed_requests long, consecutive_failures long, "
    "consecutive_successes long, events_found_total long, last_error_message string, error_counts map<string, bigint>"
)


# ---------------------------------------------------------------- feeds


def entries(payload: Column) -> Column:
    """The <item> or, without one, <entry> elements of a feed, as strings."""
    pick = lambda text, tag: F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>"), 0)
    return V.once(payload, lambda p: V.once(pick(p, "item"), lambda items: F.when(F.size(items) > 0, items).otherwise(pick(p, "entry"))))


def child(entry: Column, *tags: str) -> Column:
    """Text of the first of the child elements that has any, any prefix."""
    def plain(bare: Column) -> Column:
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
            bare = F.replace(bare, F.lit(entity), F.lit(char))
        return bare

    def text(raw: Column) -> Column:
        bare = F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
        return V.once(bare, lambda b: strip(F.when(b == raw, plain(b)).otherwise(b)))

    def one(tag: str) -> Column:
        raw = F.regexp_extract(entry, rf"(?s)<(?:[\w-]+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:[\w-]+:)?{tag}>", 1)
        return F.when(F.contains(entry, F.lit(f"{tag}>")), V.once(V.once(raw, text), lambda t: F.when(t != "", t)))

    return F.coalesce(*[one(t) for t in tags])


def attribute(entry: Column, tag: str, name: str) -> Column:
    return F.nullif(F.regexp_extract(entry, rf"<(?:[\w-]+:)?{tag}\b[^>]*?\b{name}\s*=\s*[\"']([^\"']*)", 1), F.lit(""))


def feed_entries(payloads: DataFrame, most: int | None = None) -> DataFrame:
    """payloads: feed_name, payload (null where the fetch failed) -> feed_name,
    pos, title, link, summary, published (text). Repairs undeclared prefixes;
    `most` keeps the first entries of each feed."""
    rows = payloads.where(F.col("payload").isNotNull()).select("feed_name", F.posexplode(entries(T.repair_feed(F.col("payload")))).alias("pos", "entry"))
    rows = rows.where(F.col("pos") < most) if most else rows
    e = F.col("entry")
    return rows.select(
        "feed_name", "pos",
        nz(child(e, "title")).alias("title"),
        F.coalesce(child(e, "link"), attribute(e, "link", "href"), child(e, "id"), child(e, "guid")).alias("link"),
        F.coalesce(child(e, "encoded"), child(e, "description", "summary", "content")).alias("summary"),
        child(e, "pubDate").alias("pub_date"), child(e, "published").alias("published"), child(e, "updated").alias("updated"), child(e, "date").alias("date"),
    )


def feed_statuses(payloads: DataFrame) -> DataFrame:
    """feed_name, status (ok, warning without entries, error), item_count."""
    n = F.size(entries(nz(F.col("payload"))))
    broken = F.col("payload").isNull() | ~F.rlike(nz(F.col("payload")), F.lit(r"<(?:rss|feed|rdf:RDF)\b"))
    return payloads.select("feed_name", F.when(broken, "error").when(n == 0, "warning").otherwise("ok").alias("status"), F.when(broken, 0).otherwise(n).alias("item_count"))


def search_queries(phrases: list[tuple[str, str | None, bool]], regions: list[str]) -> list[tuple[str, str | None, bool]]:
    """(query, type hint, skips territory): each phrase for each region, or
    once where it needs no territory."""
    return [q for text, hint, skip in phrases for q in ([(text, hint, True)] if skip else [(f"{text} {r}", hint, False) for r in regions])]


def news_catalogue(regions: int = 3) -> list[tuple[str, str, bool]]:
    """(query, type hint, skips territory) of the news search: hires first,
    then mergers by the first regions, industries, and the fixed queries."""
    hires = search_queries([(t, "cfo_hire", True) for t in V.NEWS_CFO_TERMS], [])
    mergers = search_queries([(t, "merger_acquisition", False) for t in V.NEWS_MERGER_TERMS], V.NEWS_REGIONS[:regions])
    industries = [(f"{i} {suffix}", hint, False) for i in V.NEWS_INDUSTRIES for suffix, hint in V.NEWS_INDUSTRY_SUFFIXES]
    return [*((q, h, False) for q, h, _ in hires), *mergers, *industries, *V.NEWS_QUERIES]


def asked(spark: SparkSession, catalogue: list[tuple[str, str | None, bool]]) -> DataFrame:
    """A catalogue as a table: place, query, hint, skips_territory."""
    return spark.createDataFrame([(i, *q) for i, q in enumerate(catalogue)], "place int, query string, hint string, skips_territory boolean")


def search_statuses(asked_: DataFrame, answers: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """answers: query, payload (null where it failed) -> the first `most` items
    of each query with its hint, and one row: queries, failed, status (success,
    partial, or error when all failed)."""
    small = F.broadcast(asked_)  # a catalogue
    items = answers.where("payload is not null").select("query", F.posexplode(F.slice(F.from_json("payload", NEWS_SCHEMA)["value"], 1, most)).alias("pos", "v"))
    items = items.join(small, "query").select("place", "query", "hint", "skips_territory", "pos", F.col("v.name").alias("title"), F.col("v.url").alias("url"), F.col("v.description").alias("summary"))
    one = answers.agg(F.count("*").alias("queries"), F.count_if(F.col("payload").isNull()).alias("failed"))
    status = F.when(F.col("failed") == 0, "success").when(F.col("failed") < F.col("queries"), "partial").otherwise("error")
    return items, one.withColumn("status", status)


# ---------------------------------------------------------------- JSON services


def news_items(payloads: DataFrame) -> DataFrame:
    """payloads: query, payload -> query, title, url, summary, published."""
    v = F.from_json("payload", NEWS_SCHEMA)["value"]
    return payloads.select("query", F.explode(v).alias("v")).select("query", F.col("v.name").alias("title"), "v.url", F.col("v.description").alias("summary"), F.col("v.datePublished").try_cast("timestamp").alias("published"))


def filing_hits(payloads: DataFrame, most: int = 60) -> DataFrame:
    """payloads: item, payload -> the first `most` filings of each item."""
    hits = F.from_json("payload", FILING_SCHEMA)["hits"]["hits"]
    rows = payloads.select("item", F.posexplode(F.slice(hits, 1, most)).alias("pos", "h")).select("item", "pos", F.col("h._source").alias("s"))
    return rows.select("item", "pos", F.get("s.ciks", 0).alias("cik"), F.get("s.display_names", 0).alias("display_name"), "s.adsh", "s.file_type", "s.items", "s.biz_states", "s.file_date")


def filer_facts(payloads: DataFrame) -> DataFrame:
    """payloads: cik, payload -> one row a filer: cik, state, sic,
    sic_description; broken answers have no facts."""
    p = F.from_json("payload", FILER_SCHEMA)
    rows = payloads.select("cik", p.alias("p")).select("cik", F.col("p.addresses.business.stateOrCountry").alias("state"), "p.sic", F.col("p.sicDescription").alias("sic_description"))
    return rows.groupBy("cik").agg(F.max("state").alias("state"), F.max("sic").alias("sic"), F.max("sic_description").alias("sic_description"))


def phrase_filings(texts: DataFrame, phrase: str) -> DataFrame:
    """Accession numbers of the texts that contain a phrase."""
    return texts.where(F.contains(F.col("text"), F.lit(phrase))).select("adsh").distinct()


def job_results(payloads: DataFrame) -> DataFrame:
    """payloads: country, payload -> one row a posting."""
    return payloads.select("country", F.explode(F.from_json("payload", JOB_SCHEMA)["results"]).alias("r")).select("country", "r.*").withColumn("created", F.col("created").try_cast("timestamp"))


def job_schedule(queries: DataFrame, as_of: Column, hours: list[int]) -> DataFrame:
    """queries: country, titles (array) -> country, title to ask for now: all
    titles at home, one a day elsewhere, nothing outside the run hours."""
    day = F.get("titles", F.pmod(F.dayofyear(as_of), F.size("titles")))
    chosen = F.when(F.col("country") == "us", F.col("titles")).otherwise(F.array(day))
    return queries.where(F.array_contains(F.array(*map(F.lit, hours)), F.hour(as_of))).select("country", F.explode(chosen).alias("title"))


def nonprofit_block(payload: Column) -> Column:
    """Evidence text of the latest nonprofit filing; null without any."""
    p = F.from_json(payload, NONPROFIT_SCHEMA)
    last = F.get(p["filings_with_data"], 0)
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    text = F.concat_ws("; ", F.concat(F.lit("Filing year "), last["tax_prd_yr"].cast("string")), F.concat(F.lit("revenue "), money(last["totrevenue"])), F.concat(F.lit("expenses "), money(last["totfuncexpns"])), F.concat(F.size(p["filings_with_data"]).cast("string"), F.lit(" filings")))
    return F.when(last.isNotNull(), text)


def evidence_block(title: str, results: Column, most: int = 3, cut: int = 200) -> Column:
    """The first results' snippets, cut, as a text block; null without any."""
    lines = F.transform(F.slice(results, 1, most), lambda r: F.concat(F.lit("- "), F.left(nz(r["content"]), F.lit(cut)), F.lit(" ["), nz(r["url"]), F.lit("]")))
    return F.when(F.size(results) > 0, F.concat(F.lit(title + ":\n"), F.array_join(lines, "\n")))


def evidence(vertical: Column, event_type: Column, funding: Column, assets: Column, complexity: Column, nonprofit: Column) -> Column:
    """The blocks that matter for the event, those that exist."""
    return F.concat_ws("\n\n", F.when(event_type.isin("funding", "merger_acquisition", "cfo_hire"), funding), F.when(vertical == "Financial Services", assets), complexity, F.when(vertical == "Nonprofits & Organizations", nonprofit))


# ---------------------------------------------------------------- leads, sheets, health


def read_leads(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Leads of a JSON file (an array or an object) or of one object a line;
    broken lines are left out."""
    reader = spark.read.schema(LEAD_SCHEMA + ", _broken string").option("columnNameOfCorruptRecord", "_broken")
    rows = reader.option("mode", "PERMISSIVE").json(path, multiLine=not lines)
    return rows.where("_broken is null").drop("_broken")


def leads_of(texts: DataFrame, column: str = "text") -> DataFrame:
    """Leads of arbitrary text: every flat {...} that parses."""
    found = F.explode(F.regexp_extract_all(F.col(column), F.lit(r"\{[^{}]*\}"), 0))
    return texts.select(found.alias("j")).select(F.from_json("j", LEAD_SCHEMA).alias("l")).where("l.title is not null").select("l.*")


def read_sheet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A sheet exported as CSV; short rows are padded with ""."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", True)
    df = reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(path) if columns else reader.csv(path)
    return df.fillna("")


def write_sheet(df: DataFrame, path: str, append: bool = False, most: int = 500) -> None:
    """df as CSV; arrays as JSON, description cut."""
    flat = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))}
    if "description" in df.columns:
        flat["description"] = F.left(nz(F.col("description")), F.lit(most))
    df.withColumns(flat).write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').csv(path)


def read_health(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEALTH_SCHEMA).json(path)


def read_events(spark: SparkSession, path: str, as_of: Column, days: int = 30, ts: str = "discovered_at", columns: tuple[str, ...] | None = None) -> DataFrame:
    """The events of a table's window; filter and columns reach the scan."""
    rows = spark.read.parquet(path).where(F.col(ts) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    return rows.select(*columns) if columns else rows


def write_health(states: DataFrame, path: str, reset: DataFrame | None = None) -> None:
    """States as JSON lines without computed fields; with `reset` (source_name)
    all but these, which start again from nothing."""
    stored = [f.split()[0] for f in HEALTH_SCHEMA.replace("map<string, bigint>", "map").split(", ")]
    kept = states if reset is None else states.join(reset.select("source_name").distinct(), "source_name", "left_anti")
    kept.select(*[c for c in stored if c in states.columns]).write.json(path)


def unwrapped(raw: Column, schema: str) -> Column:
    """A JSON array column that may be null, blank or broken, as an array."""
    parsed = F.from_json(raw, schema)
    return F.coalesce(parsed, F.from_json(F.lit("[]"), schema))


# ---------------------------------------------------------------- event rows


def published(as_of: Column) -> Column:
    """When a feed's entry was published; as_of without a date."""
    from ..functions.dates import parse_date

    return parse_date(F.col("pub_date"), F.col("published"), F.col("updated"), F.col("date"), as_of=as_of)


def to_events(entries_: DataFrame, as_of: Column) -> DataFrame:
    """Judged feed entries as events: id and published date added."""
    return entries_.where("drop_reason is null").withColumn("published_date", published(as_of)).withColumn("id", T.event_id(F.col("link"), F.col("title"))).withColumnRenamed("link", "url").drop("pub_date", "published", "updated", "date")
