"""Registered queries of whole cycles: a scrape cycle, the analysts' view,
clean-up, the news search's catalogue, prompts and error counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions import vocab as V
from ..operators import health
from ..sources import readers
from . import pipelines
from .articles import _PLACES, _PUBLIC, _TITLE, _TYPE, CFG, has, held
from .catalogue import _COMPANIES, HEADLINES, companies_of_orders, pick, query, quoted, sql_any, table

L = F.lit

_HEAD = f"{_TITLE} || ' ' || coalesce(source, '') || ' ' || coalesce(lang, '')"
_ROWS = f"d as (select doc_id, lang, source, n_chars, text, {_HEAD} as title from documents), a as (select *, title || ' ' || coalesce(text, '') as f, lower(title || ' ' || coalesce(text, '')) as t from d)"
_REAL = "not starts_with(lower(title), 'sec 8-k') and not contains(lower(title), ' hiring: ')"


def _titled(spark, sf_dir) -> DataFrame:
    head = F.concat(pick(HEADLINES, F.col("doc_id")), L(" "), T.nz(F.col("source")), L(" "), T.nz(F.col("lang")))
    return table(spark, sf_dir, "documents").withColumn("title", head)


@query(f"""with {_ROWS}, b as (select *, {_TYPE} ty, {_PLACES} p, {held(CFG.target_companies)}[1] is not null wanted from a), g as (select *, len(p) > 0 inside from b),
 k as (select * from g where not {has(CFG.excluded_industries)} and not {_PUBLIC} and not {has(CFG.excluded_locations)} and not (ty is null and not (wanted or ({has(V.PE_WORDS)} and inside))) and (inside or wanted) and doc_id % 5 <> 4),
 n as (select *, 'feed ' || lpad((doc_id // 40)::varchar, 9, '0') as feed, {_REAL} as real from k where doc_id not in (select doc_id from labels where quality = 0)
  and ({_REAL} = false or lower(title) not in (select lower({_HEAD}) from documents join labels using (doc_id) where toxic = 1))),
 r as (select *, row_number() over (partition by real, lower(title) order by feed, doc_id) c from n)
 select 'http://x/' || doc_id as url, title, coalesce(ty, 'stable_target') as event_type, array_to_string(p, '|') as places from r where not real or c = 1""")
def scrape_cycle(spark, sf_dir):
    """All documents as items of feeds through the whole cycle: parsed, judged,
    without old, seen and known ones, accepted in order of arrival."""
    rows = _titled(spark, sf_dir)
    old = F.when(F.col("doc_id") % 5 == 4, "Mon, 01 Jan 2018 00:00:00 GMT").otherwise("Mon, 01 Jan 2024 00:00:00 GMT")
    item = F.concat(L("<item><title>"), F.col("title"), L("</title><link>http://x/"), F.col("doc_id"), L("</link><description><![CDATA["), T.nz(F.col("text")), L("]]></description><pubDate>"), old, L("</pubDate></item>"))
    feed = F.concat(L("feed "), F.lpad(F.floor(F.col("doc_id") / 40).cast("string"), 9, "0"))
    items = rows.groupBy(feed.alias("feed_name")).agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("items"))  # 40 at most
    payloads = items.select("feed_name", F.concat(L("<rss><channel>"), F.array_join(F.transform("items", lambda x: x["item"]), ""), L("</channel></rss>")).alias("payload"))
    labels = table(spark, sf_dir, "labels")
    seen = labels.where("quality = 0").select(T.url_hash(F.concat(L("http://x/"), F.col("doc_id"))).alias("url_hash"))
    as_of = F.to_timestamp(L("2024-01-02 00:00:00"))
    known = rows.join(labels.where("toxic = 1").select("doc_id"), "doc_id").select("title", as_of.alias("discovered_date"))
    out = pipelines.scrape_cycle(payloads, seen, known, CFG, as_of)
    return out.select("url", "title", "event_type", F.array_join("matched_regions", "|").alias("places"))


@query(f"""with {_ROWS}, j as (select *, case when {held(CFG.excluded_industries)}[1] is not null then 'excluded_industry: "' || {held(CFG.excluded_industries)}[1] || '"' when {_PUBLIC} then 'excluded_company: "' || coalesce({held(CFG.public_companies)}[1], 'public-co') || '"' end as reason from a),
 r as (select doc_id, row_number() over (partition by lower(title) order by lang = 'en' desc, length(coalesce(text, '')) % 3 = 0 desc, n_chars, doc_id) n from j where reason is null and {_REAL})
 select doc_id, reason as drop_reason from j where reason is not null union all select doc_id, 'duplicate_title' from r where n > 1""")
def cleanup_reasons(spark, sf_dir):
    """What today's rules and title duplicates would drop of stored events."""
    e = _titled(spark, sf_dir)
    firm = F.array(F.struct(L("Acme").alias("name"), L("target").alias("role"), L("").alias("industry")))
    events = e.select(F.col("doc_id").alias("id"), "title", F.col("text").alias("description"), L("").alias("company_name"), F.when(F.col("lang") == "en", firm).otherwise(F.array().cast("array<struct<name:string,role:string,industry:string>>")).alias("companies_data"), F.when(F.length(T.nz(F.col("text"))) % 3 == 0, "B").otherwise("").alias("grade"), F.col("n_chars").alias("discovered_at"))
    return pipelines.cleanup(events, CFG).withColumnRenamed("id", "doc_id")


@query("""with m as (select max(o_orderdate) m from orders), e as (select o_orderkey id, 'Customer#' || o_custkey as firm, o_clerk_text title, o_orderdate found, case o_orderpriority when '1-URGENT' then 'A' when '2-HIGH' then 'B' when '3-MEDIUM' then '' else 'C' end grade,
   floor(o_totalprice / 1000)::int score, o_custkey from (select *, 'order of ' || o_orderpriority as o_clerk_text from orders), m where o_orderdate >= m - interval 700 days and o_orderstatus <> 'F'),
 s as (select * from e where grade <> 'C' and lower(title) like '%order%' and o_custkey not in (select c_custkey from customer where c_acctbal < 0)),
 q as (select *, row_number() over (partition by firm order by case grade when 'A' then 0 when 'B' then 1 else 2 end, score desc, found, id) n, count(*) over (partition by firm) - 1 others from s)
 select id, lower(firm) as company_key, score::bigint as score, others from q where n = 1 order by case grade when 'A' then 0 when 'B' then 1 else 2 end, q.score desc, found, id limit 25""")
def analyst_view(spark, sf_dir):
    """New, undecided events of a window after the analyst's filters, as the
    ranked queue."""
    o = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    grade = F.when(p == "1-URGENT", "A").when(p == "2-HIGH", "B").when(p == "3-MEDIUM", "").otherwise("C")
    firm = F.concat(L("Customer#"), F.col("o_custkey"))
    company = "array<struct<name:string,role:string,revenue:string>>"
    events = o.select(
        F.col("o_orderkey").alias("id"), F.concat(L("order of "), p).alias("title"), L("").alias("description"), firm.alias("company_name"), L(None).cast("array<string>").alias("matched_regions"), grade.alias("grade"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("numeric_score"), F.col("o_orderdate").cast("timestamp").alias("discovered_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("blocked_at"), L("NEW").alias("lead_status"),
        F.array().cast(company).alias("companies_data"), F.struct(L(None).cast("string").alias("account_name")).alias("fit"),
    )
    decided = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(T.account_key(F.concat(L("Customer#"), F.col("c_custkey"))).alias("company_key"))
    newest = o.agg(F.max("o_orderdate")).first()[0]
    view = pipelines.analyst_view(events, decided, F.lit(newest).cast("timestamp"), 700, needle="order", grades=["A", "B"], most=25)
    return view.select("id", "company_key", "score", "others")


_CATALOGUE = readers.news_catalogue()
_ASKED = "(values " + ", ".join(f"({i}, '{q.replace(chr(39), chr(39) * 2)}', '{h}', {str(s).lower()})" for i, (q, h, s) in enumerate(_CATALOGUE)) + ") q(place, query, hint, skips)"


@query(f"""with a as (select *, row_number() over (partition by doc_id % {len(_CATALOGUE)} order by doc_id) n from documents), s as (select count(*) filter (place % 9 = 5) f, count(*) c from {_ASKED} where place in (select doc_id % {len(_CATALOGUE)} from documents))
 select place, query, hint, skips as skips_territory, n - 1 as pos, 'http://n/' || doc_id as url, case when f = 0 then 'success' when f < c then 'partial' else 'error' end as status from a join {_ASKED} on place = doc_id % {len(_CATALOGUE)}, s where n <= 10 and place % 9 <> 5""")
def news_search(spark, sf_dir):
    """Every query of the catalogue with all documents as answers: the first
    ten items of each, and the run's status."""
    d = table(spark, sf_dir, "documents")
    n = len(_CATALOGUE)
    asked = readers.asked(spark, _CATALOGUE)
    # What a service would send: its first items, here the least ids.
    item = F.struct("doc_id", F.struct(L("t").alias("name"), F.concat(L("http://n/"), F.col("doc_id")).alias("url")).alias("v"))
    spread = d.groupBy((F.col("doc_id") % n).alias("place"), F.floor(F.col("doc_id") / (n * 50)).alias("_part")).agg(F.slice(F.array_sort(F.collect_list(item)), 1, 12).alias("v"))
    sent = spread.groupBy("place").agg(F.array_sort(F.flatten(F.collect_list(F.when(F.col("_part") < 2, F.col("v"))))).alias("v"))
    body = F.to_json(F.struct(F.transform("v", lambda x: x["v"]).alias("value")))
    answers = sent.join(F.broadcast(asked.select("place", "query")), "place").select("query", F.when(F.col("place") % 9 != 5, body).alias("payload"))
    items, status = readers.search_statuses(asked, answers)
    state = status.select("status")
    return items.join(F.broadcast(state)).select("place", "query", "hint", "skips_territory", F.col("pos").cast("long").alias("pos"), "url", "status")  # one row


@query(f"""with m as (select conv_id, lower(coalesce(text, '')) t from conversations), c as (select conv_id, case when t = '' then null {' '.join(f"when {sql_any('t', w)} then '{c}'" for c, w in V.ERROR_CLASSES)} else 'other' end c from m),
 g as (select conv_id, c, count(*) n from c where c is not null group by conv_id, c) select conv_id, string_agg(c || '=' || n, ' ' order by c) as errors from g group by conv_id""")
def error_counts(spark, sf_dir):
    """Turns of conversations as error messages: counts by class and source."""
    turns = table(spark, sf_dir, "conversations").where("coalesce(text, '') <> ''")
    out = health.error_counts(turns, "conv_id", "text")
    pairs = F.array_sort(F.transform(F.map_entries("error_counts"), lambda e: F.concat(e["key"], L("="), e["value"])))
    return out.select("conv_id", F.array_join(pairs, " ").alias("errors"))


_SCHOOL = f"(' ' || lower(name) || ' ')"


@query(f"""with c as (select *, list_contains({quoted(V.WORKABLE_ROLES)}, lower(role)) w from {_COMPANIES}), k as (select *, bool_or(w) over (partition by l_orderkey) anyone from c)
 select l_orderkey, string_agg('"' || name || '" ' || role || ' company official website headquarters employees annual revenue size', chr(10) order by pos) as queries, count(*) as n from k where not (role <> '' and not w and anyone) and not {sql_any(_SCHOOL, V.SCHOOL_DISTRICTS)} group by l_orderkey""")
def firm_searches(spark, sf_dir):
    """Which companies of an event are searched for, and what is asked."""
    chosen = companies_of_orders(spark, sf_dir).select("l_orderkey", S.searchable(F.col("companies")).alias("c")).where("size(c) > 0")
    asked = F.transform("c", lambda c: T.firm_query(c["name"], c["role"]))
    return chosen.select("l_orderkey", F.array_join(asked, "\n").alias("queries"), F.size("c").cast("long").alias("n"))


@query(f"""select l_orderkey, string_agg('  - Name: ' || name || chr(10) || '    Role: ' || role || chr(10) || '    URL: None' || chr(10) || '    Industry: None' || chr(10) || '    Size: None, Revenue: ' || revenue || ', HQ: ' || hq || chr(10) || '    Revenue Source: n/a', chr(10) order by pos) as block from {_COMPANIES} group by l_orderkey""")
def prompt_blocks(spark, sf_dir):
    none = L(None).cast("string")
    o = companies_of_orders(spark, sf_dir)
    full = F.transform("companies", lambda c: F.struct(c["name"].alias("name"), c["role"].alias("role"), none.alias("url"), none.alias("industry"), none.alias("size"), c["revenue"].alias("revenue"), c["hq"].alias("hq"), L("").alias("revenue_source")))
    return o.select("l_orderkey", T.companies_block(full).alias("block"))
