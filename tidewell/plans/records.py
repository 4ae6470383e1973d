"""Registered queries of readers, stores, health, alerts and state machines, on
payloads and tables that are made of whole rows of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import scoring as S
from ..functions import text as T
from ..functions import vocab as V
from ..operators import dedup, gates, health, lookups, ranking, store
from ..sources import connectors, readers
from ..streaming import expiring, ledger, stateful, supervise
from .articles import strip
from .catalogue import _SQL, CFG, HEADLINES, attempts, drained, health_rows, now, pick, picked, query, quoted, sql_any, stream_of, table

L = F.lit


# ---------------------------------------------------------------- payloads


_FEEDS = f"""with d as (select *, {strip("coalesce(text, '')")} s from documents) select 'feed ' || doc_id as feed_name, 0 as pos, md5(coalesce(text, '')) as title, 'http://x/' || doc_id as link, nullif(s, '') as summary, 'Mon, 01 Jan 2024 00:00:00 GMT' as pub_date from d
 union all select 'feed ' || doc_id, 1, 'a & b', 'http://y/' || doc_id, nullif({strip("replace(coalesce(lang, ''), '<', '')")}, ''), null from d"""
_FEED_COLUMNS = ["feed_name", "pos", "title", "link", "summary", "pub_date"]


def feed_payloads(d: DataFrame) -> DataFrame:
    """A feed for each document, with an undeclared prefix, an entry with
    CDATA and one with attributes and character references."""
    key, text = F.col("doc_id").cast("string"), T.nz(F.col("text"))
    first = F.concat(L("<item><title>"), F.md5(text.cast("binary")), L("</title><link>http://x/"), key, L("</link><media:thumbnail url='u'/><content:encoded><![CDATA["), text, L("]]></content:encoded><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item>"))
    second = F.concat(L("<item><title>a &amp; b</title><link>http://y/"), key, L("</link><description>"), T.nz(F.col("lang")), L("</description></item>"))
    payload = F.concat(L("<rss version='2.0'><channel>"), first, second, L("</channel></rss>"))
    return d.select(F.concat(L("feed "), key).alias("feed_name"), payload.alias("payload"))


@query(_FEEDS)
def feed_roundtrip(spark, sf_dir):
    return readers.feed_entries(feed_payloads(table(spark, sf_dir, "documents"))).select(*_FEED_COLUMNS)


def _archived(spark, payloads: DataFrame, cycles: list[str]) -> str:
    """An archive of payloads (feed_name, payload), dealt out over cycles by
    name."""
    connectors.register(spark)
    path = f"{store.shared_dir(spark)}/archive/{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("feed_name"), L(len(cycles)))
    for i, cycle in enumerate(cycles):
        connectors.archive(payloads.where(part == i).withColumnRenamed("feed_name", "name"), path, cycle)
    return path


@query(_FEEDS)
def feed_source(spark, sf_dir):
    """The connector over an archive of all feeds, in three cycles."""
    path = _archived(spark, feed_payloads(table(spark, sf_dir, "documents")), ["20240101", "20240102", "20240103"])
    rows = spark.read.format("feed").option("path", path).load().where("cycle >= '20240101' and error is null")
    return rows.withColumnRenamed("name", "feed_name").select(*_FEED_COLUMNS)


@query("""select 'page ' || page_id as name, nullif(trim(url), '') as link, replace(html, ']]>', '') as html from pages where page_id % 5 >= 2""")
def feed_since(spark, sf_dir):
    """Pages as Atom feeds in five cycles; the cut reaches the connector, which
    reads the later ones only."""
    connectors.register(spark)
    p = table(spark, sf_dir, "pages")
    path = f"{store.shared_dir(spark)}/archive/{uuid.uuid4().hex}"
    entry = F.concat(L("<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>page</title><link href='"), F.replace(F.replace(T.nz(F.col("url")), L("&"), L("&amp;")), L("'"), L("&#39;")), L("'/><content><![CDATA["), F.replace(T.nz(F.col("html")), L("]]>"), L("")), L("]]></content></entry></feed>"))
    for day in range(5):
        connectors.archive(p.where(F.col("page_id") % 5 == day).select(F.concat(L("page "), F.col("page_id")).alias("name"), entry.alias("payload")), path, f"2024010{day + 1}")
    rows = spark.read.format("feed").option("path", path).load().where("cycle >= '20240103'")
    return rows.select("name", F.nullif("link", L("")).alias("link"), F.col("summary").alias("html"))


@query(_FEEDS)
def feed_polling(spark, sf_dir):
    """The same feeds as a stream over an archive that grows between two runs
    under supervision."""
    feeds = feed_payloads(table(spark, sf_dir, "documents"))
    path = _archived(spark, feeds.where("length(feed_name) % 2 = 0"), ["20240101", "20240102"])
    out, state = f"{path}-out", f"{path}-state"
    stream = spark.readStream.format("feed").option("path", path).load()
    start = supervise.polling(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), state, f"feeds-{uuid.uuid4().hex[:8]}")
    supervise.supervise(start, most=0, poll=0.2)
    connectors.archive(feeds.where("length(feed_name) % 2 = 1").withColumnRenamed("feed_name", "name"), path, "20240103")
    supervise.supervise(start, most=0, poll=0.2)
    rows = spark.read.schema(stream.schema).parquet(out).where("error is null")
    return rows.withColumnRenamed("name", "feed_name").select(*_FEED_COLUMNS)


@query("""select doc_id, 'http://n/' || doc_id as link, text as summary from documents""")
def news_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    item = F.struct(F.md5(T.nz(F.col("text")).cast("binary")).alias("name"), F.concat(L("http://n/"), F.col("doc_id")).alias("url"), F.col("text").alias("description"), L("2024-01-01T05:06:07Z").alias("datePublished"))
    path = _archived(spark, d.select(F.col("doc_id").cast("string").alias("feed_name"), F.to_json(F.struct(F.array(item).alias("value"))).alias("payload")), ["1"])
    return spark.read.format("news").option("path", path).load().select(F.col("name").cast("long").alias("doc_id"), "link", "summary")


@query("""select event_type, event_id, count(*) as n from events where event_type in ('error', 'purchase') group by 1, 2""")
def alerts_exactly_once(spark, sf_dir):
    """Alerts of a stream in four batches, each of which is delivered twice, as
    files of the handler."""
    base = f"{store.shared_dir(spark)}/alerts/{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')").select(F.col("event_id").alias("id"), "event_type")
    e.repartition(4).write.parquet(f"{base}/in")
    book = ledger.Ledger(spark, f"{base}/ledger")
    step = ledger.exactly_once(book, {"file": ledger.FileAlerts(f"{base}/out")})

    def twice(batch: DataFrame, n: int) -> None:
        step(batch, n)
        step(batch, n)

    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    supervise.supervise(supervise.polling(stream, twice, f"{base}/state", f"alerts-{uuid.uuid4().hex[:8]}"), most=0, poll=0.2)
    sent = spark.read.schema(e.schema).json(f"{base}/out")
    return sent.groupBy("event_type", F.col("id").alias("event_id")).agg(F.count("*").alias("n"))


@query("""select doc_id, case doc_id % 4 when 0 then 'error' when 1 then 'warning' when 2 then 'ok' else 'error' end as status, case when doc_id % 4 = 2 then 2 else 0 end as items from documents""")
def feed_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    body = F.concat(L("<rss><channel><item>"), F.md5(T.nz(F.col("text")).cast("binary")), L("</item><item></item></channel></rss>"))
    payload = F.when(k == 1, "<rss><channel></channel></rss>").when(k == 2, body).when(k == 3, "<html>no feed</html>")
    out = readers.feed_statuses(d.select(F.col("doc_id").cast("string").alias("feed_name"), payload.alias("payload")))
    return out.select(F.col("feed_name").cast("long").alias("doc_id"), "status", F.col("item_count").alias("items"))


@query("""select count(*) as total, count(*) filter (event_type = 'view') as ok, count(*) filter (event_type = 'click') as warning, count(*) filter (event_type = 'error') as error,
 round(avg(value) filter (value > 0), 6)::double as avg_ms, max(value) filter (value > 0) as max_ms, count(*) filter (value > 20) as slow from events""")
def feed_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "click", "warning").otherwise(F.col("event_type"))
    return health.feed_summary(e.select(kind.alias("status"), F.col("value").alias("response_time_ms")), 20.0).withColumn("avg_ms", F.round("avg_ms", 6))


@query("""select o_orderkey, strftime(case o_orderkey % 4 when 3 then (select max(o_orderdate) from orders) else date_trunc('second', o_orderdate) end, '%Y-%m-%d %H:%M:%S') as at from orders""")
def feed_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, at = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("timestamp")
    rfc, iso = F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    o = o.select("o_orderkey", F.when(k == 0, rfc).when(k == 3, "soon").alias("a"), F.when(k == 1, iso).when(k == 2, "?").alias("b"), F.when(k == 2, F.date_format(at, "dd MMM yyyy HH:mm:ss '+0000'")).alias("c"))
    as_of = now(table(spark, sf_dir, "orders"), "o_orderdate").cast("timestamp")
    return o.select("o_orderkey", F.date_format(D.parse_date(F.col("a"), F.col("b"), F.col("c"), as_of=as_of), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""select doc_id::varchar as query, md5(coalesce(text, '')) as title, 'http://n/' || doc_id as url, text as summary, '2024-01-01 05:06:07' as published from documents""")
def news_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    item = F.struct(F.md5(T.nz(F.col("text")).cast("binary")).alias("name"), F.concat(L("http://n/"), F.col("doc_id")).alias("url"), F.col("text").alias("description"), L("2024-01-01T05:06:07Z").alias("datePublished"))
    out = readers.news_items(d.select(F.col("doc_id").cast("string").alias("query"), F.to_json(F.struct(F.array(item).alias("value"))).alias("payload")))
    return out.withColumn("published", F.date_format("published", "yyyy-MM-dd HH:mm:ss"))


@query("""select item, pos::int as pos, cik, display_name, adsh, file_type, file_date, state from (select case o_orderkey % 3 when 0 then '5.02' when 1 then '2.01' else '1.01' end || '/' || o_custkey as item, row_number() over (partition by o_custkey, o_orderkey % 3 order by o_orderkey) - 1 as pos,
 o_custkey::varchar as cik, 'FIRM ' || o_custkey || ' (CIK 1)' as display_name, o_orderkey::varchar as adsh, '8-K' as file_type, strftime(o_orderdate, '%Y-%m-%d') as file_date, 'OH' as state from orders) where pos < 2""")
def filing_roundtrip(spark, sf_dir):
    """Search answers by item code; the first filings of each are kept."""
    o = table(spark, sf_dir, "orders")
    code = F.when(F.col("o_orderkey") % 3 == 0, "5.02").when(F.col("o_orderkey") % 3 == 1, "2.01").otherwise("1.01")
    source = F.struct(F.array(F.col("o_custkey").cast("string")).alias("ciks"), F.array(F.concat(L("FIRM "), F.col("o_custkey"), L(" (CIK 1)"))).alias("display_names"), F.col("o_orderkey").cast("string").alias("adsh"), L("8-K").alias("file_type"), F.array(L("5.02")).alias("items"), F.array(L("OH")).alias("biz_states"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("file_date"))
    hits = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), source.alias("_source"))))
    answers = o.groupBy(F.concat(code, L("/"), F.col("o_custkey")).alias("item")).agg(hits.alias("h"))
    answers = answers.select("item", F.to_json(F.struct(F.struct(F.transform("h", lambda x: F.struct(x["_source"].alias("_source"))).alias("hits")).alias("hits"))).alias("payload"))
    return readers.filing_hits(answers, 2).select("item", "pos", "cik", "display_name", "adsh", "file_type", "file_date", F.get("biz_states", 0).alias("state"))


@query("""select 'us' as country, md5(coalesce(text, '')) as title, source as firm, lang as place, text as description, '2024-02-03 00:00:00' as created from documents""")
def job_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    posting = F.struct(F.md5(T.nz(F.col("text")).cast("binary")).alias("title"), F.struct(F.col("source").alias("display_name")).alias("company"), F.struct(F.array(L("US"), F.col("lang")).alias("area")).alias("location"), F.col("text").alias("description"), L("2024-02-03T00:00:00Z").alias("created"))
    out = readers.job_results(d.select(L("us").alias("country"), F.to_json(F.struct(F.array(posting).alias("results"))).alias("payload")))
    return out.select("country", "title", F.col("company.display_name").alias("firm"), F.get("location.area", 1).alias("place"), "description", F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("""select case when n_nationkey % 2 = 0 then 'us' else n_name end as country, unnest(case when n_nationkey % 2 = 0 then ['cfo', 'controller', 'vp finance'] else [['cfo', 'controller', 'vp finance'][(45 % 3) + 1]] end) as title from nation""")
def job_schedule(spark, sf_dir):
    """What to ask for in a run hour: all titles at home, the day's elsewhere."""
    country = F.when(F.col("n_nationkey") % 2 == 0, "us").otherwise(F.col("n_name"))
    asked = table(spark, sf_dir, "nation").select(country.alias("country"), V.words(["cfo", "controller", "vp finance"]).alias("titles"))
    return readers.job_schedule(asked, F.to_timestamp(L("2024-02-14 06:30:00")), [6, 18])


@query("""select c_custkey, case when c_custkey % 4 <> 0 then 'Filing year ' || (2000 + c_custkey % 20) || '; revenue $' || format('{:,}', (c_custkey * 1000)::bigint) || '; expenses $' || format('{:,}', (c_custkey * 900)::bigint) || '; 2 filings' end as block from customer""")
def nonprofit_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    year = lambda back: F.struct((2000 + k % 20 - back).cast("int").alias("tax_prd_yr"), (k * 1000).cast("double").alias("totrevenue"), (k * 900).cast("double").alias("totfuncexpns"))
    payload = F.to_json(F.struct(F.when(k % 4 != 0, F.array(year(0), year(1))).otherwise(F.array().cast("array<struct<tax_prd_yr: int, totrevenue: double, totfuncexpns: double>>")).alias("filings_with_data")))
    return c.select("c_custkey", readers.nonprofit_block(payload).alias("block"))


@query(r"""with b as (select doc_id, 'Funding:' || chr(10) || '- ' || left(coalesce(text, ''), 200) || ' [http://x]' || chr(10) || '- ' || left(coalesce(lang, ''), 200) || ' []' f, 'Signals:' || chr(10) || '- ' || left(coalesce(source, ''), 200) || ' [s]' c from documents)
 select doc_id, concat_ws(chr(10) || chr(10), case when doc_id % 3 = 0 then f end, c, case when doc_id % 2 = 0 then 'filing' end) as evidence from b""")
def evidence_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    hit = lambda c, u: F.struct(c.alias("content"), L(u).cast("string").alias("url"))
    funding = readers.evidence_block("Funding", F.array(hit(F.col("text"), "http://x"), hit(F.col("lang"), None)))
    signals = readers.evidence_block("Signals", F.array(hit(F.col("source"), "s"), hit(F.col("lang"), "t")), most=1)
    vertical = F.when(F.col("doc_id") % 2 == 0, "Nonprofits & Organizations").otherwise("other")
    kind = F.when(F.col("doc_id") % 3 == 0, "funding").otherwise("expansion")
    return d.select("doc_id", readers.evidence(vertical, kind, funding, L("assets"), signals, L("filing")).alias("evidence"))


@query("""select md5(coalesce(text, '')) as title, lang as company_name, doc_id::double as relevance_score from documents where doc_id % 5 <> 4""")
def lead_objects(spark, sf_dir):
    """Flat objects rescued from free text; broken ones and those without a
    title are left out."""
    d = table(spark, sf_dir, "documents")
    good = F.to_json(F.struct(F.md5(T.nz(F.col("text")).cast("binary")).alias("title"), F.col("lang").alias("company_name"), F.col("doc_id").cast("double").alias("relevance_score")))
    rest = F.when(F.col("doc_id") % 5 == 4, L('{"title": } {"url": "x"}')).otherwise(F.concat(L("see {\"url\": \"y\"}, "), good, L(" and so on")))
    plain = F.translate(T.nz(F.col("text")), "{}", "")
    return readers.leads_of(d.select(F.concat(plain, L(" "), rest).alias("text"))).select("title", "company_name", "relevance_score")


@query("""select doc_id from documents where doc_id % 3 <> 2""")
def lead_lines(spark, sf_dir):
    """One lead a line, as a file; broken lines are left out."""
    d = table(spark, sf_dir, "documents")
    line = F.when(F.col("doc_id") % 3 == 2, L('{"title": broken')).otherwise(F.to_json(F.struct(F.col("doc_id").cast("string").alias("title"), F.col("text").alias("description"))))
    path = f"{store.shared_dir(spark)}/leads/{uuid.uuid4().hex}"
    d.select(line.alias("value")).write.text(path)
    return readers.read_leads(spark, path, lines=True).select(F.col("title").cast("long").alias("doc_id"))


@query("""select doc_id, case doc_id % 4 when 0 then 2 when 1 then 0 when 2 then 0 else 0 end as n, case when doc_id % 4 = 0 then lang end as first from documents""")
def json_lists(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.to_json(F.array("lang", "source"))).when(k == 1, "nan").when(k == 2, "")
    return d.select("doc_id", readers.unwrapped(raw, "array<string>").alias("v")).select("doc_id", F.size("v").alias("n"), F.get("v", 0).alias("first"))


@query("""select doc_id::varchar as adsh from documents where contains(text, 'tion of')""")
def phrase_sets(spark, sf_dir):
    return readers.phrase_filings(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("adsh"), "text"), "tion of")


# ---------------------------------------------------------------- stores


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'A' else 'C' end as grade, case when c_custkey % 3 = 0 and c_custkey % 2 = 0 then 9 else 1 end as score from customer""")
def enrichment_write(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    old = c.select(k.alias("id"), L("C").alias("grade"), L(1).alias("numeric_score"))
    news = c.where(k % 3 == 0).select(k.alias("id"), L("A").alias("grade"), F.when(k % 2 == 0, 9).alias("numeric_score"))
    return store.write_enrichment(old, news).select(F.col("id").alias("c_custkey"), "grade", F.col("numeric_score").alias("score"))


@query("""select c_custkey, case when c_acctbal < 0 then 1 else 0 end as alert_sent from customer""")
def flag_update(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return store.set_flag(c.select("c_custkey", L(0).alias("alert_sent")), c.where("c_acctbal < 0"), "alert_sent", L(1), "c_custkey")


@query("""select o_orderkey, case o_orderkey % 4 when 0 then 'NOT RELEVANT' when 1 then 'WORKING' else 'NEW' end as lead_status, case when o_orderkey % 8 = 1 then 'mine' else 'old' end as notes,
 case when o_orderkey % 4 = 0 and o_orderstatus <> 'F' then 'dismissed by rep (NOT RELEVANT)' when o_orderstatus = 'F' then 'fit_gate' end as blocked_reason from orders""")
def status_update(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, done = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    rows = o.select("o_orderkey", L("NEW").alias("lead_status"), L("old").alias("notes"), F.when(done, F.col("o_orderdate")).alias("blocked_at"), F.when(done, "fit_gate").alias("blocked_reason"))
    changes = o.where(k % 4 < 2).select("o_orderkey", F.when(k % 4 == 0, "NOT RELEVANT").otherwise("WORKING").alias("status"), F.when(k % 8 == 1, "mine").alias("notes"))
    return store.set_status(rows, changes, now(o, "o_orderdate"), "o_orderkey").select("o_orderkey", "lead_status", "notes", "blocked_reason")


@query("""select 'firm ' || c_custkey as company_key, case when c_custkey % 3 = 0 then 'CUSTOMER' else 'DEAD' end as status from customer where c_custkey % 3 <> 1""")
def disposition_writes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    old = c.select(F.concat(L("firm "), k).alias("company_key"), F.concat(L("Firm "), k).alias("company_name"), L("DEAD").alias("status"), L(None).cast("timestamp").alias("updated_at"))
    changes = c.where(k % 3 < 2).select(F.concat(L("Firm "), k, L(", Inc.")).alias("company_name"), F.when(k % 3 == 0, "CUSTOMER").otherwise("—").alias("status"))
    return store.set_dispositions(old, changes, F.to_timestamp(L("2024-01-01 00:00:00"))).select("company_key", "status")


@query("""select c_custkey, case when c_custkey % 2 = 0 then 'old' else 'new' end as seen, null::varchar as extra from customer""")
def seen_and_migrated(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 2 = 0").select("c_custkey", L("old").alias("seen"))
    new = c.select("c_custkey", L("new").alias("seen"))
    return store.add_columns(store.insert_absent(old, new.union(new), "c_custkey"), {"extra": "string", "seen": "int"})


@query("""with a as (select max(ts) m from events), e as (select event_id, epoch(m - ts) > 3600 * (user_id % 5) old, props from events, a) select count(*) as entries, count(*) filter (old) as expired, sum(strlen(props))::bigint as bytes,
 (select count(*) filter (event_type = 'view') from events) as hits, (select count(*) filter (event_type <> 'view') from events) as misses, (select round(count(*) filter (event_type = 'view') / count(*), 9)::double from events) as hit_rate from e""")
def cache_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    entries = e.select(F.col("ts").alias("created_at"), (3600 * (F.col("user_id") % 5)).alias("ttl"), F.col("props").alias("value"))
    out = lookups.cache_stats(entries, e.select((F.col("event_type") == "view").alias("hit")), now(e, "ts"))
    return out.withColumn("hit_rate", F.round("hit_rate", 9))


@query("""select event_id from events, (select max(ts) m from events) where epoch(m - ts) <= 3600 * 24 * (user_id % 5) and event_type <> 'click'""")
def cache_expiry(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    entries = e.select("event_id", F.col("ts").alias("created_at"), (3600 * 24 * (F.col("user_id") % 5)).alias("ttl"), F.col("event_type").alias("category"))
    return lookups.expire(entries, now(e, "ts"), "click").select("event_id")


@query("""select event_id from events, (select max(ts) m from events) where epoch(m - ts) <= 3600 * 24 * (user_id % 5) and event_type <> 'click'""")
def cache_stream(spark, sf_dir):
    """The same by a stream: entries with timers of their own; clicks are
    cleared when they come."""
    e = stream_of(spark, sf_dir)
    ttl = (3600 * 24 * (F.col("user_id") % 5)).cast("double")
    kinds = F.explode(F.when(F.col("event_type") == "click", F.array(L("put"), L("clear"))).otherwise(F.array(L("put"))))
    operations = e.select(F.col("event_id").cast("string").alias("cache_key"), kinds.alias("kind"), F.col("ts").alias("at"), F.col("event_type").alias("value"), ttl.alias("ttl"))
    slots = max(64, table(spark, sf_dir, "events").count() // 1000)
    with expiring.rocksdb(spark):
        gone = drained(expiring.cache_stream(operations, slots=slots), "append")
    left = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("cache_key")).join(gone.select("cache_key"), "cache_key", "left_anti")
    return left.select(F.col("cache_key").cast("long").alias("event_id"))


@query("""select c_custkey::varchar as cache_key, case when c_custkey % 3 = 0 then '[1]' else '[0]' end as results_json from customer""")
def search_cache_writes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string").alias("cache_key")
    old = c.select(key, L("[0]").alias("results_json"), L(None).cast("timestamp").alias("cached_at"))
    new = c.select(key, F.when(F.col("c_custkey") % 3 == 0, "[1]").when(F.col("c_custkey") % 3 == 1, "[]").alias("results_json"))
    return lookups.put_results(old, new, F.to_timestamp(L("2024-01-01 00:00:00"))).select("cache_key", "results_json")


@query("""select user_id::varchar as source_name, count(*) as total_requests, count(*) filter (event_type = 'purchase')::bigint as events_found_total from events where user_id % 10 <> 3 group by 1""")
def health_files(spark, sf_dir):
    """States written as JSON without computed fields, some reset, and read."""
    states = health_rows(spark, sf_dir).withColumn("source_name", F.col("user_id").cast("string"))
    path = f"{store.shared_dir(spark)}/health/{uuid.uuid4().hex}"
    readers.write_health(states, path, states.where("cast(source_name as long) % 10 = 3"))
    return readers.read_health(spark, path).select("source_name", "total_requests", "events_found_total")


# ---------------------------------------------------------------- companies and queues


@query("""select o_orderkey, case when o_custkey % 3 = 0 then 'DEAD' end as disposition from orders""")
def disposition_join(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    firm = lambda k: F.concat(L("Firm "), k)
    known = c.where("c_custkey % 3 = 0").select(T.account_key(firm(F.col("c_custkey"))).alias("company_key"), L("DEAD").alias("status"), L(None).cast("timestamp").alias("updated_at"))
    return ranking.with_disposition(o.select("o_orderkey", F.concat(firm(F.col("o_custkey")), L(" Inc")).alias("display_company")), known).select("o_orderkey", "disposition")


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders order by o_orderdate desc, o_orderkey limit 50 offset 50""")
def second_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    last = ranking.page(o, "o_orderdate", "o_orderkey", 50).orderBy("o_orderdate", F.desc("o_orderkey")).select("o_orderdate", "o_orderkey").first()
    return ranking.page(o, "o_orderdate", "o_orderkey", 50, after=tuple(last)).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""select greatest(count(distinct o_custkey) - 10, 0) as remaining from orders""")
def queue_rest(spark, sf_dir):
    return ranking.remaining(table(spark, sf_dir, "orders").withColumn("company", F.concat(L("Firm "), F.col("o_custkey"))), "company", "o_orderkey")


@query("""select c_custkey from customer where case c_custkey % 5 when 0 then false when 1 then true when 2 then true else false end and c_acctbal >= 0""")
def grade_filters(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    g = F.when(F.col("c_custkey") % 5 == 0, "d").when(F.col("c_custkey") % 5 == 1, " a ").when(F.col("c_custkey") % 5 == 3, "C").when(F.col("c_custkey") % 5 == 4, "B-")
    company = F.struct(L("x").alias("name"), L("target").alias("role"), F.when(F.col("c_acctbal") < 0, "Enterprise").when(F.col("c_acctbal") > 5000, "$15M").alias("revenue"))
    rows = c.select("c_custkey", g.alias("grade"), F.array(company).alias("companies_data"))
    return ranking.by_band(ranking.by_grade(rows, ["A"]), ["MM"]).select("c_custkey")


_NAMES = ["Acme", " unknown ", "", "NaN", "x", "Beta Co", "Unknown Company"]
_CN = picked(_NAMES, "c_custkey")


@query(f"""with c as (select c_custkey, {strip(_CN)} n, case when c_custkey % 9 = 0 then 'Fit Co' else '' end f from customer) select c_custkey, case when f <> '' then f when lower(n) not in ({', '.join("'" + x + "'" for x in V.UNKNOWN_NAMES)}) then n else 'Listed' end as shown,
 (length(n) > 1 and lower(n) not in ('unknown', 'nan', 'none'))::int + 1 as valid from c""")
def company_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("n", pick(_NAMES, F.col("c_custkey")))
    fit = F.struct(F.when(F.col("c_custkey") % 9 == 0, " Fit Co ").otherwise("").alias("account_name"))
    listed = F.array(F.struct(F.col("n").alias("name"), L("advisor").alias("role")), F.struct(L("Listed").alias("name"), L("Target").alias("role")))
    return c.select("c_custkey", ranking.display_company(fit, F.col("n"), listed).alias("shown"), F.size(gates.valid_companies(listed)).alias("valid"))


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'b' || c_custkey else 'target' end as account, case when c_custkey % 2 = 0 and c_custkey % 4 = 0 then 'OH' when c_custkey % 2 = 0 then null else 'Boston, MA' end as hq from customer""")
def account_picks(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    rows = F.array(F.struct(F.concat(L("B"), k).alias("name"), L("advisor").alias("role")), F.struct(L("target").alias("name"), L("Target").alias("role")))
    hq = F.when(k % 2 != 0, "Boston, MA")
    return c.select("c_custkey", F.lower(S.account_by_name(rows, F.when(k % 3 == 0, F.concat(L(" b"), k)))["name"]).alias("account"), S.seeded_hq(L("Acme"), hq, F.when(k % 4 == 0, "ACME "), L("OH")).alias("hq"))


@query("""select page_id, regexp_extract(url, '://(?:www\\.)?([^/?#:]*)', 1) <> '' and page_id % 4 in (0, 1) as publisher from pages""")
def publishers(spark, sf_dir):
    """A page's own host (or its stem) as company name is the publisher."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"://(?:www\.)?([^/?#:]*)", 1)
    name = F.when(F.col("page_id") % 4 == 0, F.upper(host)).when(F.col("page_id") % 4 == 1, F.initcap(F.get(F.split(host, r"\."), 0))).when(F.col("page_id") % 4 == 2, "Acme Incorporated").otherwise("")
    return p.select("page_id", F.coalesce(gates.is_publisher(name, F.col("url"), CFG), L(False)).alias("publisher"))


_TAGS = [t for t in V.HASHTAG_POINTS if t != "#HyperGrowth"][:6] + ["#HyperGrowth", "#Made"]


@query(f"""with t as (select event_id, list_filter({quoted(_TAGS)}, lambda x, i: (event_id // i) % 2 = 0) g, user_id % 2 = 0 ev, case event_id % 3 when 0 then 'A' when 1 then 'B' else 'C' end l, case when user_id % 3 = 0 then 'unverified' else 'pass' end v from events)
 select event_id, array_to_string(list_filter(g, lambda h: list_contains({quoted(list(V.HASHTAG_POINTS))}, h) and (ev or h <> '#HyperGrowth')), ' ') as tags, case when l = 'A' and v = 'unverified' then 'B' else l end as letter,
 case when l = 'A' and v = 'unverified' then '[Capped A→B: fit unverified] why' else 'why' end as note from t""")
def tag_guards(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    tags = F.transform(F.filter(F.transform(V.words(_TAGS), lambda t, i: F.struct(t.alias("t"), (i + 1).alias("i"))), lambda p: F.floor(k / p["i"]) % 2 == 0), lambda p: p["t"])
    letter = F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").otherwise("C")
    fit = F.when(F.col("user_id") % 3 == 0, "unverified").otherwise("pass")
    return e.select("event_id", F.array_join(S.closed_tags(F.array_distinct(tags), F.col("user_id") % 2 == 0), " ").alias("tags"), S.capped(letter, fit).alias("letter"), S.capped_note(letter, fit, L("why")).alias("note"))


@query("""select c_custkey, case when c_custkey % 7 = 0 then 'Public company (TICK)' when e > 2000 then 'Too large (' || format('{:,}', e) || ' employees, max 2,000)' when e > 0 and e < 20 then 'Too small (' || format('{:,}', e) || ' employees, min 20)'
 when m > 500 then 'Revenue too high ($' || format('{:.0f}', m) || 'M, max $500M)' when m > 0 and m < 5 then 'Revenue too low ($' || format('{:.0f}', m) || 'M, min $5M)' else 'Meets criteria' end as reason
 from (select c_custkey, (c_custkey * 37) % 3000 as e, ((c_custkey * 13) % 700)::double as m from customer)""")
def company_criteria(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey", S.verify_company(k % 7 == 0, L("TICK"), (k * 37) % 3000, ((k * 13) % 700).cast("double"), CFG)["reason"].alias("reason"))


@query("""select c_custkey, case when c_custkey % 2 = 0 then 'soft' when c_custkey % 3 = 0 then 'private equity venture capital' else 'company' end as hint, nullif(concat_ws(', ', case when c_custkey % 2 = 0 then 'Boston' end, case when c_custkey % 3 = 0 then 'MA' end, case when c_custkey % 5 = 0 then 'Canada' end), '') as place,
 case when c_custkey % 2 = 0 then 'a' when c_custkey % 3 = 0 then 'b' end as name, case when c_custkey % 5 = 0 then 'h' end as hq from customer""")
def company_fields(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    two, three, five = k % 2 == 0, k % 3 == 0, k % 5 == 0
    first = F.struct(F.when(two, "a").otherwise("").alias("name"), L("").alias("hq"))
    second = F.struct(F.when(three, "b").alias("name"), F.when(five, "h").alias("hq"))
    merged = lookups.fill_missing(first, second, ["name", "hq"])
    place = T.location_text(F.when(two, "Boston"), F.when(three, "MA"), F.when(five, "Canada").otherwise("United States"))
    return c.select("c_custkey", S.industry_hint(F.when(two, " soft "), F.when(three, "Lead Investor")).alias("hint"), place.alias("place"), merged["name"].alias("name"), merged["hq"].alias("hq"))


@query("""select l_orderkey, 'c' || (l_partkey % 500) || '/' || first_value(l_suppkey % 7) over (partition by l_partkey % 500 order by l_orderkey, l_linenumber, l_suppkey % 7 rows between unbounded preceding and unbounded following) as facts from lineitem""")
def firm_lookups(spark, sf_dir):
    """Each firm is looked up once, with the hint of its first mention."""
    li = table(spark, sf_dir, "lineitem")
    one = F.struct(F.col("l_linenumber").alias("n"), (F.col("l_suppkey") % 7).cast("string").alias("descriptor"), F.concat(L("C"), F.col("l_partkey") % 500, L(" ")).alias("name"))
    events = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("companies"))
    out = lookups.once_per_firm(events, "companies", lambda firms: firms.withColumn("facts", F.concat("firm", L("/"), "hint")))
    return out.select(F.col("id").alias("l_orderkey"), "facts")


# ---------------------------------------------------------------- filings


@query(f"""with f as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') d, case when o_orderkey % 11 = 0 then 'D/A' else 'D' end ft, o_orderkey % 7 = 0 fund, case when o_orderkey % 13 = 0 then 'Delta Fund LP' else 'Firm ' || o_custkey end n, case o_custkey % 3 when 0 then 'OH' when 1 then 'TX' else 'ma' end st, o_custkey from orders),
 j as (select *, case when ft <> 'D' then 'drop' when fund then 'fund' when {sql_any("(' ' || lower(n) || ' ')", V.FUND_NAMES)} then 'fund' when upper(st) not in ({', '.join("'" + x + "'" for x in [*V.TERRITORY_CODES, *V.FILING_PROVINCES])}) or {sql_any('lower(n)', CFG.public_companies + CFG.public_indicators)} then 'drop' else 'keep' end o from f),
 k as (select *, row_number() over (partition by o order by d desc, o_orderkey::varchar) r from j)
 select o_orderkey::varchar as adsh, n as company_name, st as state, case when o <> 'keep' then o when o_custkey % 5 = 0 then 'fund' else 'keep' end as outcome,
 case when o = 'keep' then 'SEC Form D filed by ' || n || ' (' || st || ') — private capital raise (Reg D exempt offering). Total offering: $' || format('{{:,}}', o_orderkey * 1000) || '. Form D industry group: Other. Filing date: ' || d || '.' end as description from k where o <> 'keep' or r <= 50""")
def offerings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    xml = F.concat(L("<x><totalOfferingAmount>"), (k * 1000).cast("string"), L("</totalOfferingAmount><industryGroupType>Other</industryGroupType>"), F.when(c % 5 == 0, "<investmentFundInfo>").otherwise(""), L("</x>"))
    rows = o.select(
        k.cast("string").alias("adsh"), c.cast("string").alias("cik"), F.when(k % 13 == 0, "Delta Fund LP").otherwise(F.concat(L("Firm "), c)).alias("display_name"), F.when(k % 11 == 0, "D/A").otherwise("D").alias("file_type"),
        F.when(k % 7 == 0, F.array(L(V.FUND_ITEMS[0]))).otherwise(F.array(L("06b"))).alias("items"), F.array(F.when(c % 3 == 0, "OH").when(c % 3 == 1, "TX").otherwise("ma")).alias("biz_states"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("file_date"), xml.alias("detail_xml"),
    )
    filers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cik"), L("7372").alias("sic"))
    return gates.offering_gate(rows, filers, CFG).select("adsh", "company_name", "state", "outcome", "description")


# ---------------------------------------------------------------- health and alerts


@query("""select user_id, count(*) as total_requests, count(*) filter (event_type = 'error') as total_failures, round(count(*) filter (event_type = 'error') / count(*), 9)::double as failure_rate, count(*) filter (event_type = 'error' and value > 20) as backoffs,
 max_by(case when value > 20 then 429 else 404 end, ts) as last_code from events group by user_id""")
def limiter_totals(spark, sf_dir):
    return health.limiter_stats(attempts(spark, sf_dir), "user_id").withColumn("failure_rate", F.round("failure_rate", 9))


@query("""select count(*) as total, count(*) filter (c_custkey % 3 = 0) as imported, count(*) filter (c_custkey % 3 = 1) as skipped, count(*) filter (c_custkey % 3 = 2) as failed from customer""")
def import_totals(spark, sf_dir):
    kind = F.when(F.col("c_custkey") % 3 == 0, "imported").when(F.col("c_custkey") % 3 == 1, "skipped").otherwise("failed")
    return health.import_stats(table(spark, sf_dir, "customer").select(kind.alias("outcome")))


@query("""select count(*) as n, strftime(max(o_orderdate), '%Y-%m-%d') as newest from orders""")
def table_totals(spark, sf_dir):
    return health.table_status(table(spark, sf_dir, "orders"), "o_orderdate").select("n", F.date_format("newest", "yyyy-MM-dd").alias("newest"))


@query("""with a as (select max(o_orderdate) m from orders), n as (select count(*) filter (o_orderstatus <> 'F' and o_orderkey % 2 = 0 and o_orderdate < m - interval 5 hours) lag, count(*) filter (o_orderkey % 50 = 0) drops, count(*) filter (o_totalprice < 1000) cheap from orders, a)
 select 'enrichment_lag' as "check", case when lag > 10 then 'FAIL' when lag > 3 then 'WARN' else 'PASS' end as verdict, lag || ' events unenriched after 5 hours' as message from n union all
 select 'cleanup', case when drops > 25 then 'WARN' else 'PASS' end, drops || ' events would be dropped' from n union all select 'prices', case when cheap > 5 then 'FAIL' when cheap > 0 then 'WARN' else 'PASS' end, cheap || ' rows' from n""")
def table_checks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    lag = o.select(F.col("o_orderdate").alias("discovered_at"), F.when(k % 2 != 0, L("x")).alias("enriched_at"), F.when(F.col("o_orderstatus") == "F", "x").alias("blocked_at"))
    judged = o.select(F.when(k % 50 == 0, "x").alias("drop_reason"))
    return health.check_lag(lag, now(o, "o_orderdate")).union(health.check_cleanup(judged)).union(health.check_that("prices", o, F.col("o_totalprice") < 1000, 5))


_H = picked(HEADLINES, "event_id")


@query(f"""with r as (select event_id, event_type, {_H} title, value, row_number() over (partition by event_type order by value desc, event_id) n from events), g as (select event_type, count(*) c from events group by 1)
 select r.event_type, c as n, md5(string_agg('[' || upper(r.event_type) || '] ' || title || chr(10) || 'Company: Acme' || chr(10) || 'Relevance: ' || format('{{:.0f}}', value) || chr(10) || 'URL: u', chr(10) || chr(10) order by r.n)) as body from r join g using (event_type) where r.n <= 5 group by 1, 2""")
def alert_bodies(spark, sf_dir):
    """The alert file of each type: its first five events as texts."""
    out = ranking.batch_alerts(_alerts(spark, sf_dir), each=5)
    return out.select("event_type", "n", F.md5(F.col("body").cast("binary")).alias("body"))


def _alerts(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "event_type", pick(HEADLINES, F.col("event_id")).alias("title"), L("Acme").alias("company_name"), L(None).cast("timestamp").alias("published_date"), F.col("value").alias("relevance_score"), L("u").alias("url"), L(None).cast("string").alias("description"))


@query(f"""with t as (select case event_type when 'view' then 'cfo_hire' when 'click' then 'funding' else 'other' end ty from events) select count(*) as n, concat_ws(', ', case when count(*) filter (ty = 'cfo_hire') > 0 then count(*) filter (ty = 'cfo_hire') || ' CFO hires' end, case when count(*) filter (ty = 'funding') > 0 then count(*) filter (ty = 'funding') || ' fundings' end) as text from t""")
def notification(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ranking.desktop_text(e.select(F.when(F.col("event_type") == "view", "cfo_hire").when(F.col("event_type") == "click", "funding").otherwise("other").alias("event_type")))


@query(f"""select event_id as id, {_H} as title, event_type, case when epoch(m - ts) < 3600 then floor(epoch(m - ts) / 60)::bigint || ' min ago' when epoch(m - ts) < 86400 then floor(epoch(m - ts) / 3600)::bigint || ' hours ago' else floor(epoch(m - ts) / 86400)::bigint || ' days ago' end as age, value as relevance_score
 from events, (select max(ts) m from events) order by ts desc, value desc, event_id limit 10""")
def run_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("id"), pick(HEADLINES, F.col("event_id")).alias("title"), "event_type", F.col("ts").alias("published_date"), F.col("value").alias("relevance_score"))
    return ranking.run_summary(rows, now(e, "ts"))


@query("""select event_id from events, (select max(ts) m from events) where ts >= m - interval 72 hours""")
def not_too_old(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return stateful.not_too_old(e, "ts", now(e, "ts"), 72).where(gates.recent(F.col("ts"), now(e, "ts"), 72)).select("event_id")


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders order by o_orderdate desc, o_orderkey limit 200""")
def newest_dispositions(spark, sf_dir):
    return ranking.newest(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""select event_id from events where ts > (select max(ts) from events) - interval 48 hours and event_type = 'click'""")
def recent_of_type(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ranking.since_hours(e, "ts", "event_id", now(e, "ts"), 48, "click").select("event_id")


@query("""with e as (select user_id, event_type <> 'error' ok, ts, event_id from events), g as (select user_id, max((ts, event_id)) filter (ok) lg from e group by user_id),
 s as (select e.user_id, count(*) total, count(*) filter (ok) good, count(*) filter (not ok and (lg is null or (ts, event_id) > lg)) cf from e join g using (user_id) group by e.user_id)
 select user_id::varchar as source_name from s where total >= 3 and not (cf >= 3 or good / total < 0.5) and good / total < 0.9""")
def degraded_sources(spark, sf_dir):
    states = health_rows(spark, sf_dir).withColumn("source_name", F.col("user_id").cast("string"))
    return health.troubled(states, "degraded").select("source_name")


@query("""with h as (select user_id::varchar as name, count(*) n, count(*) filter (event_type <> 'error') good, count(*) filter (event_type = 'purchase')::bigint p from events group by 1)
 select name, format('{:.1f}%', good * 100.0 / n) as uptime, p as events_total from h""")
def dashboard_rows(spark, sf_dir):
    states = health_rows(spark, sf_dir).withColumns({"source_name": F.col("user_id").cast("string"), "last_check": L(None).cast("timestamp"), "last_error_message": L(None).cast("string")})
    return health.dashboard(states, L(None).cast("timestamp")).select("name", "uptime", "events_total")


@query("""select event_type as source_type, user_id::varchar as source_name, count(*) as n from events group by 1, 2""")
def source_statuses(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source_type"), F.col("user_id").cast("string").alias("source_name")).agg(F.count("*").alias("n"))
    return health.statuses(rows)


@query("""select event_type as backend, count(*) as searches, count(*) filter (value > 10) as answered, count(*) filter (not value > 10) as empty from events group by 1""")
def search_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return health.search_counters(e.select(F.col("event_type").alias("backend"), (F.col("value") > 10).cast("int").alias("n_results")))


@query("""select c_custkey::varchar as cik, case when c_custkey % 4 <> 3 then 'OH' end as state, case when c_custkey % 4 <> 3 then (c_custkey % 9000)::varchar end as sic, case when c_custkey % 4 <> 3 then c_mktsegment end as sic_description from customer""")
def filer_lookup(spark, sf_dir):
    """Answers about filers, each asked for twice, some broken."""
    c = table(spark, sf_dir, "customer")
    full = F.to_json(F.struct(F.struct(F.struct(L("OH").alias("stateOrCountry")).alias("business")).alias("addresses"), (F.col("c_custkey") % 9000).cast("string").alias("sic"), F.col("c_mktsegment").alias("sicDescription")))
    asked = c.select(F.col("c_custkey").cast("string").alias("cik"), F.when(F.col("c_custkey") % 4 != 3, full).otherwise("<html>").alias("payload"))
    return readers.filer_facts(asked.union(asked))


@query("""select o_orderkey, o_orderstatus from orders where o_orderdate >= (select max(o_orderdate) from orders) - interval 60 days""")
def event_window(spark, sf_dir):
    as_of = now(table(spark, sf_dir, "orders"), "o_orderdate")
    return readers.read_events(spark, f"{sf_dir}/orders.parquet", as_of, 60, "o_orderdate", ("o_orderkey", "o_orderstatus"))


@query("""select n_nationkey, case when n_nationkey % 2 = 0 then upper(n_name) else n_name end as n_name from nation""")
def table_sync(spark, sf_dir):
    """A table is merged, pushed to another store and pulled back."""
    base = f"{store.shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    here = store.Table(spark, f"{base}/here")
    here.merge(n, "n_nationkey")
    here.merge(n.where("n_nationkey % 2 = 0").withColumn("n_name", F.upper("n_name")), "n_nationkey")
    here.push(f"{base}/remote")
    return store.Table(spark, f"{base}/again").pull(f"{base}/remote").read()


@query("""select event_type, count(*) as n, least(count(*), 3) * 4 as lines from events group by 1""")
def mail_bodies(spark, sf_dir):
    """The mail of each type: all counted, the newest three shown."""
    rows = _alerts(spark, sf_dir).withColumn("published_date", F.to_timestamp(L("2024-01-01 00:00:00")))
    out = ranking.html_mail(rows, F.to_timestamp(L("2024-01-02 00:00:00")), each=3)
    return out.select("event_type", "n", (F.regexp_count("html", L("<li>|</li>|<a |<i>")).cast("long")).alias("lines"))


@query(f"""with e as (select event_type, {picked(HEADLINES, 'event_id')} title, value, event_id from events), r as (select *, row_number() over (partition by event_type order by value desc, event_id) n from e)
 select event_type, (select count(*) from e f where f.event_type = r.event_type) as n, string_agg(title, '|' order by n) as top from r where n <= 3 group by event_type""")
def slack_tops(spark, sf_dir):
    out = ranking.slack_blocks(_alerts(spark, sf_dir))
    top = F.transform(F.from_json(F.get_json_object("block", "$.top"), "array<struct<n: int, title: string>>"), lambda t: t["title"])
    return out.select("event_type", F.get_json_object("block", "$.n").cast("long").alias("n"), F.array_join(top, "|").alias("top"))


# ---------------------------------------------------------------- state machines in SQL

_STEPS = """with recursive e as (select user_id, event_id, epoch_us(ts) / 1000000.0::double s, event_type <> 'error' ok, case when value > 20 then 429 else 404 end code, row_number() over (partition by user_id order by epoch_us(ts), event_id) n from events), """

_SQL["breaker_replay"] = _STEPS + """r as (select user_id, event_id, n, case when not ok and 1 >= 6 then 0 when ok then 0 else 1 end as streak, 0.0::double as until, 'called' as decision, (case when ok then 0 else 1 end) as shown from e where n = 1
 union all select e.user_id, e.event_id, e.n, case when e.s < r.until then r.streak when e.ok then 0 when r.streak + 1 >= 6 then 0 else r.streak + 1 end, case when e.s >= r.until and not e.ok and r.streak + 1 >= 6 then e.s + 900.0 else r.until end,
  case when e.s < r.until then 'skipped' when not e.ok and r.streak + 1 >= 6 then 'opened' else 'called' end, case when e.s < r.until then r.streak when e.ok then 0 else r.streak + 1 end from r join e on e.user_id = r.user_id and e.n = r.n + 1)
 select user_id, event_id, decision, shown as streak from r"""

_SQL["greedy_dedup"] = """with recursive d as (select doc_id, source || '|' || lang || '|' || (doc_id % 40) as u, nullif(lower(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')), '') as t, row_number() over (order by doc_id) n from documents),
 k as (select doc_id, n, u, case when t is not null and not starts_with(t, 'sec 8-k') and not contains(t, ' hiring: ') then md5(t) end h from d),
 r as (select 0::bigint as n, null::bigint as doc_id, false as kept, []::varchar[] as seen union all select k.n, k.doc_id, not list_contains(r.seen, 'u' || k.u) and (k.h is null or not list_contains(r.seen, 't' || k.h)),
  case when not list_contains(r.seen, 'u' || k.u) and (k.h is null or not list_contains(r.seen, 't' || k.h)) then list_concat(r.seen, list_filter(['u' || k.u, 't' || k.h], lambda x: x is not null)) else r.seen end from r join k on k.n = r.n + 1)
 select doc_id from r where kept"""

_SQL["limiter_replay"] = _STEPS + """r as (select user_id, event_id, n, s as last, case when not ok and code = 429 then 1 else 0 end as fails, case when not ok and code = 429 then s + 2.0 else 0.0 end as until, case when ok then 'ok' when code = 429 then 'backoff' else 'failed' end as decision,
  0.0::double as wait, case when not ok and code = 429 then 2.0 else 0.0 end::double as backoff from e where n = 1
 union all select user_id, event_id, n, case when give then last else s + w1 end, case when give then fails when ok then 0 when code = 429 then f1 + 1 else f1 end, case when give then until when ok then 0.0 when code = 429 then s + w1 + least(pow(2.0, f1 + 1), 300.0) else until end,
  case when give then 'give_up' when ok then 'ok' when code = 429 then 'backoff' else 'failed' end, case when give then w0 else w1 end, case when not give and not ok and code = 429 then least(pow(2.0, f1 + 1), 300.0) else 0.0 end
  from (select *, case when s + w0 - last < 1.0 then w0 + 1.0 - (s + w0 - last) else w0 end w1 from (select *, fails >= 4 and s + w0 - last < 3600.0 give, case when fails >= 4 then 0 else fails end f1
   from (select e.*, r.last, r.fails, r.until, greatest(0.0, r.until - e.s) w0 from r join e on e.user_id = r.user_id and e.n = r.n + 1))))
 select user_id, event_id, decision, round(wait, 3)::double as wait, backoff::double as backoff from r"""
