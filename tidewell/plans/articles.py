"""Registered queries of detection, extraction and gates over whole texts: each
document is an article, its text after a headline of a fixed list. Words of the
configuration occur in some of the texts, so that outcomes differ by text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scoring as S
from ..functions import text as T
from ..functions import vocab as V
from ..operators import gates, keywords, ranking
from .catalogue import HEADLINES, pick, picked, query, quoted, sql_any, table

CFG = Config.of({
    "territory": {
        "regions": ["Ontario", "Ohio", "enier", "euxai"], "cities": ["Boston", "Atlanta", "iertion"], "industries": ["health", "bank", "airé", "onou"],
        "excluded_industries": ["mining", "school district", "éonpa"], "excluded_locations": ["london", "çtre"], "target_companies": ["Kappa Ltd", "Theta Bank", "tionè"],
        "company_filters": {"public_company_indicators": ["nasdaq", "éieré"], "excluded_public_companies": ["zeta capital"], "target_size_indicators": ["mid-market", "family-owned", "ouoi"]},
    },
    "keywords": {"executive_hires": ["controller", "vice president", "cfo", "mentou"], "mergers_acquisitions": ["acquisition of", "merger with", "queeux"], "funding_events": ["raises", "series a", "funding", "anan", "reon", "enen", "onan"]},
    "excluded_content": ["concert", "tickets", "chvi"],
    "blocked_industries": ["erat", "anin"],
    "publishers": ["acme corp", "business daily"],
})
_TITLE = picked(HEADLINES, "doc_id")
_A = f"a as (select doc_id, lang, source, {_TITLE} as title, text, {_TITLE} || ' ' || coalesce(text, '') as f, lower({_TITLE} || ' ' || coalesce(text, '')) as t from documents)"


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def held(values, most: int | None = None, text: str = "t") -> str:
    return f"list_filter({quoted(values)}, lambda x: contains({text}, x))" + (f"[1:{most}]" if most else "")


def has(values, text: str = "t") -> str:
    return sql_any(text, values)


_TYPE = f"""case when {has(CFG.excluded_content)} then null when {has(V.CFO_WORDS)} and {has(V.CFO_VERBS)} then 'cfo_hire' when {has(CFG.executive_words)} and {has(V.HIRE_VERBS)} then 'executive_hire'
 when {has(CFG.merger_words)} then 'merger_acquisition' when {has(V.STRONG_FUNDING)} then 'funding' end"""
_PUBLIC = has((*CFG.public_companies, *CFG.public_indicators))
_INDUSTRY = f"({has(CFG.industries)} and not {has(CFG.excluded_industries)})"
_PLACES = f"case when {has(CFG.excluded_locations)} then []::varchar[] else list_concat({held(CFG.regions)}, {held(CFG.cities)}) end"
_KEYS = f"""case when ty in ('cfo_hire', 'executive_hire') then {held(CFG.executive_words, 5)} when ty = 'merger_acquisition' then {held(CFG.merger_words, 5)} when ty = 'funding' then {held(CFG.funding_words, 5)} else []::varchar[] end"""
_SIGNALS = "list_transform(list_filter([" + ", ".join("{'k': '%s', 'r': '%s'}" % (k.replace("'", "''"), r.replace("'", "''")) for k, r in V.SIGNALS) + "], lambda x: contains(t, x.k)), lambda x: x.r)"


def first_of(values: str) -> str:
    """A list without repeats, in order."""
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def articles(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("title", pick(HEADLINES, F.col("doc_id")))
    return d.withColumn("f", T.joined(F.col("title"), F.col("text")))


@query(f"with {_A} select doc_id, {_TYPE} as type from a")
def text_types(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", T.detect_type(F.col("f"), CFG).alias("type"))


@query(f"""with {_A}, b as (select *, lower(title) lt from a) select doc_id, case when {has(CFG.excluded_content)} then null when {' or '.join(f"regexp_matches(lt, '{p.replace("'", "''")}')" for p in V.SITE_FUNDING)} then 'funding'
 when {' or '.join(f"regexp_matches(lt, '{p.replace("'", "''")}')" for p in V.SITE_MERGERS)} then 'merger_acquisition' else {_TYPE} end as site_type,
 case when lang = 'de' then lang when {has(['cfo', 'chief financial'])} then 'cfo_hire' when {has(['acqui', 'merger', 'buyout'])} then 'merger_acquisition' when {has(['funding', 'raises', 'series'])} then 'funding'
 when {has(['hire', 'appoint', 'named'])} then 'executive_hire' else 'other' end as import_type from b""")
def text_site_types(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.select("doc_id", T.detect_site_type(F.col("title"), F.col("f"), CFG).alias("site_type"), T.infer_import_type(F.col("f"), F.when(F.col("lang") == "de", F.col("lang"))).alias("import_type"))


@query(f"""with {_A}, b as (select *, {_TYPE} ty from a) select doc_id, array_to_string({_KEYS}, '|') as words, array_to_string({held(CFG.industries, 5)}, '|') as industries,
 array_to_string({first_of(_SIGNALS)}, '|') as signals from b""")
def text_keywords(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("ty", T.detect_type(F.col("f"), CFG))
    f = F.col("f")
    return a.select("doc_id", F.array_join(T.keywords(f, F.col("ty"), CFG), "|").alias("words"), F.array_join(T.industries(f, CFG), "|").alias("industries"), F.array_join(T.signals(f), "|").alias("signals"))


@query(f"with {_A} select doc_id, {has(CFG.size_indicators)} as sized, {has(V.PE_WORDS)} as pe_backed, {held(CFG.blocked_industries)}[1] as blocked, {held(CFG.target_companies)}[1] as target from a")
def text_flags(spark, sf_dir):
    f = F.col("f")
    return articles(spark, sf_dir).select("doc_id", gates.target_size(f, CFG).alias("sized"), gates.pe_backed(f).alias("pe_backed"), gates.blocked_industry(f, CFG).alias("blocked"), gates.target_company(f, CFG).alias("target"))


@query(f"""with {_A}, b as (select *, {_PLACES} p, {held(CFG.industries, 5)} i, {first_of(_SIGNALS)} s, {held(CFG.target_companies)}[1] c, {has(CFG.size_indicators)} z from a),
 r as (select doc_id, concat_ws(' | ', 'Company: ' || c, case when len(p) > 0 then 'Territory match: ' || array_to_string(p[1:3], ', ') end, case when len(i) > 0 then 'Industry match: ' || array_to_string(i[1:3], ', ') end,
 case when z then 'Appears to be mid-market/private company' end, case when len(s) > 0 then 'Signals: ' || array_to_string(s[1:4], '; ') end) x from b)
 select doc_id, case when x = '' then 'Matches territory and industry criteria' else x end as why from r""")
def text_reasoning(spark, sf_dir):
    f = F.col("f")
    a = articles(spark, sf_dir)
    return a.select("doc_id", T.reasoning(gates.target_company(f, CFG), gates.territory(f, CFG), T.industries(f, CFG), T.signals(f), gates.target_size(f, CFG)).alias("why"))


# ---------------------------------------------------------------- gates

_FEEDS = ["PR Newswire", "Business Wire East", "GlobeNewswire", "Tech Daily"]
_FEED = picked(_FEEDS, "doc_id")
_SOURCE = f"case when contains(lower({_FEED}), 'business wire') then 'business_wire' when contains(lower({_FEED}), 'pr newswire') then 'pr_newswire' when contains(lower({_FEED}), 'globe newswire') or contains(lower({_FEED}), 'globenewswire') then 'globe_newswire' else 'other' end"


_PLAIN = strip(r"""regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g')""")


@query(f"""with {_A}, b as (select *, {_TYPE} ty, {_PLACES} p, {held(CFG.target_companies)}[1] c, {_SOURCE} src from a), g as (select *, len(p) > 0 inside, c is not null wanted,
  {_PLAIN} sm from b)
 select doc_id, case when {has(CFG.excluded_industries)} then 'excluded_industry' when {_PUBLIC} then 'public_company' when {has(CFG.excluded_locations)} then 'excluded_location'
  when ty is null and not (wanted or ({has(V.PE_WORDS)} and inside)) then 'no_type' when not (inside or wanted) then 'out_of_territory' end as drop_reason, coalesce(ty, 'stable_target') as kind, src as source, array_to_string(p, '|') as places,
  array_to_string({_KEYS}, '|') as words, nullif(left(sm, 500), '') as description,
  least(100, least(100, case ty when 'cfo_hire' then 40 when 'executive_hire' then 30 when 'merger_acquisition' then 35 when 'funding' then 25 else 10 end + least(15 * len(p), 30) + case when {_INDUSTRY} then 20 else 0 end + case when wanted then 50 else 0 end)
   + case src when 'pr_newswire' then 15 when 'business_wire' then 10 when 'globe_newswire' then 10 else 0 end)::double as score from g""")
def feed_gate_texts(spark, sf_dir):
    """The composite gate of feed entries over all articles; no text has a
    dateline (see text_datelines)."""
    e = articles(spark, sf_dir).select("doc_id", "title", pick(_FEEDS, F.col("doc_id")).alias("feed_name"), F.col("text").alias("summary"))
    out = gates.feed_gate(e, CFG)
    return out.select("doc_id", "drop_reason", F.col("event_type").alias("kind"), "source", F.array_join("matched_regions", "|").alias("places"), F.array_join("matched_keywords", "|").alias("words"), "description", F.col("relevance_score").alias("score"))


@query(f"""with {_A}, b as (select *, coalesce({_TYPE}, case when source = 'src1' then 'expansion' end) ty, {_PLACES} p, {held(CFG.target_companies)}[1] is not null wanted from a)
 select doc_id, ty as type, array_to_string(p, '|') as places, case when ty is null then 'no_type' when {has(CFG.excluded_industries)} then 'excluded_industry' when {_PUBLIC} then 'public_company' when {has(CFG.excluded_locations)} then 'excluded_location'
 when lang <> 'de' and not (len(p) > 0 or wanted) then 'out_of_territory' end as reason from b""")
def search_gate_texts(spark, sf_dir):
    e = articles(spark, sf_dir).withColumnRenamed("text", "summary")
    out = gates.search_gate(e, CFG, skip_territory=F.col("lang") == "de", hint=F.when(F.col("source") == "src1", "expansion"))
    return out.select("doc_id", F.col("event_type").alias("type"), F.array_join("matched_regions", "|").alias("places"), F.col("drop_reason").alias("reason"))


_JOBS = ["Chief Financial Officer", "Corporate Controller", "Document Controller", "VP Finance", "Sales Manager", "CFO"]
_AREAS = ["Ohio", "Ontario", "Texas", ""]
_FIRMS = ["Acme", "", "Robert Half", "Zeta Mining", "Beta Health"]
_WANTED = ["cfo", "controller", "chief financial officer", "vp finance"]
JOBS = Config.of({"territory": {"regions": ["Ohio", "enier"], "cities": ["iertion"], "industries": ["health"], "excluded_industries": ["mining", "éonpa"], "excluded_locations": ["çtre"], "company_filters": {"public_company_indicators": ["éieré"]}}, "job_titles": _WANTED})


@query(f"""with j as (select doc_id, {picked(_JOBS, 'doc_id')} ti, {picked(_AREAS, 'doc_id // 6')} ar, {picked(_FIRMS, 'doc_id // 24')} co, left(coalesce(text, ''), 600) body, case when doc_id % 11 = 0 then '' else 'http://x' end u from documents)
 select doc_id, ar as region, case when {has(['cfo', 'chief financial'], 'lower(ti)')} then 'cfo_hire' else 'executive_hire' end as kind, co || ' hiring: ' || ti as event_title,
 case when ar not in ('Ohio', 'Ontario') then 'out_of_territory' when not {has(_WANTED, 'lower(ti)')} then 'other_title' when {has(V.OTHER_CONTROLLERS, 'lower(ti)')} then 'not_finance' when u = '' then 'no_url' when co = '' then 'no_company'
 when {has(V.RECRUITERS, 'lower(co)')} then 'recruiter' when {has(JOBS.excluded_industries, "lower(ti || ' ' || co || ' ' || body)")} then 'excluded_industry' end as reason from j""")
def job_gate_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    rows = d.select("doc_id", pick(_JOBS, k).alias("title"), F.struct(pick(_FIRMS, F.floor(k / 24)).alias("display_name")).alias("company"), F.struct(F.array(F.lit("US"), pick(_AREAS, F.floor(k / 6))).alias("area")).alias("location"), F.when(k % 11 == 0, "").otherwise("http://x").alias("redirect_url"), F.col("text").alias("description"))
    out = gates.job_gate(rows, JOBS, ["Ohio", "Ontario"])
    return out.select("doc_id", "region", F.col("event_type").alias("kind"), "event_title", F.col("drop_reason").alias("reason"))


_BOARD_TITLES = ["Controller - Acme Inc - Boston", "CFO at Beta Health", "Sales Lead - Zeta - Ohio", "VP Finance needed", "Chief Financial Officer - Mu Co - Remote"]
_BT = picked(_BOARD_TITLES, "doc_id")


@query(f"""with j as (select doc_id, {_BT} ti, lower({_BT} || ' ' || coalesce(text, '')) t from documents),
 h as (select *, list_filter({quoted(_WANTED)}, lambda x: contains(lower(ti), x)) hit, case when {has(JOBS.excluded_locations)} then []::varchar[] else list_concat({held(JOBS.regions)}, {held(JOBS.cities)}) end own from j),
 k as (select *, case when len(own) = 0 then ['Ohio'] else own end p from h)
 select doc_id, array_to_string(p, '|') as places, array_to_string(hit, '|') as words, case when len(hit) = 0 then 'other_title' when {has(JOBS.public_indicators)} then 'public_company' when {has(JOBS.excluded_industries)} then 'excluded_industry' end as reason,
 least(100, case when {has(V.CFO_WORDS, 'lower(ti)')} then 45 when contains(lower(ti), 'controller') then 40 when {has(['director', 'vp', 'vice president', 'head of finance'], 'lower(ti)')} then 35 else 25 end
  + least(10 * len(p), 20) + case when {has(JOBS.industries)} and not {has(JOBS.excluded_industries)} then 15 else 0 end + least(5 * len(hit), 15))::double as score,
 case when len(string_split(ti, ' - ')) >= 2 then string_split(ti, ' - ')[2] when ti like '% at %' then 'Beta Health' end as company from k""")
def board_gate_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", pick(_BOARD_TITLES, F.col("doc_id")).alias("title"), F.col("text").alias("description"))
    out = gates.board_gate(d, JOBS, "board", F.lit("Ohio"))
    return out.select("doc_id", F.array_join("matched_regions", "|").alias("places"), F.array_join("matched_keywords", "|").alias("words"), F.col("drop_reason").alias("reason"), F.col("relevance_score").alias("score"), F.col("company_name").alias("company"))


@query(f"""with {_A} select doc_id, case when {held(CFG.excluded_industries)}[1] is not null then 'excluded_industry: "' || {held(CFG.excluded_industries)}[1] || '"' when {_PUBLIC} then 'excluded_company: "' || coalesce({held(CFG.public_companies)}[1], 'public-co') || '"' end as reason from a""")
def retro_reasons(spark, sf_dir):
    a = articles(spark, sf_dir).select("doc_id", "title", F.col("text").alias("description"), F.lit("").alias("company_name"))
    return gates.retro_reason(a, CFG).select("doc_id", F.col("drop_reason").alias("reason"))


_DATELINES = [
    "BOSTON, MA and ATLANTA, Jan. 5 /News/ -- ", "NEW YORK, N.Y., Feb 3 - ", "TORONTO / OTTAWA, ON, Mar 9 (Wire) ", "Berlin, Apr 2 - ", "ST. LOUIS May 1 ", "no place here ", "DALLAS & AUSTIN, TX- Dec 9 ",
]
_D = f"{picked(_DATELINES, 'doc_id')} || coalesce(text, '')"
_NAMES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in V.STATE_NAMES.items()) + "}"


@query(rf"""with d as (select doc_id, {strip(f"regexp_extract({strip(_D)}, '^(.+?)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)', 1)")} h from documents),
 p as (select doc_id, unnest(string_split_regex(h, '\s+and\s+|\s+AND\s+|\s*&\s*|\s*/\s*')) x, generate_subscripts(string_split_regex(h, '\s+and\s+|\s+AND\s+|\s*&\s*|\s*/\s*'), 1) i from d),
 s as (select doc_id, i, {strip(f"rtrim(rtrim({strip('x')}, ','), '-')")} s from p),
 c as (select *, lower({strip(r"regexp_extract(s, '^([A-Z][A-Z\s]+),\s*([A-Za-z]\.?[A-Za-z]?\.?)$', 1)")}) city, replace(lower(regexp_extract(s, '^([A-Z][A-Z\s]+),\s*([A-Za-z]\.?[A-Za-z]?\.?)$', 2)), '.', '') code from s),
 r as (select doc_id, i, case when city <> '' then city || '/' || coalesce({_NAMES}[code], code) when upper(s) = s and regexp_matches(s, '\p{{L}}') then lower(s) || '/' end pl from c)
 select d.doc_id, coalesce(string_agg(pl, '|' order by i), '') as places from d left join r on d.doc_id = r.doc_id and pl is not null group by 1""")
def text_datelines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(pick(_DATELINES, F.col("doc_id")), T.nz(F.col("text"))).alias("t"))
    return d.select("doc_id", F.array_join(F.transform(T.datelines(F.col("t")), lambda p: F.concat(p["city"], F.lit("/"), T.nz(p["state"]))), "|").alias("places"))


# ---------------------------------------------------------------- texts of any kind


@query(r"""select doc_id, case when contains(text, ' - ') then left(text, length(text) - length(list_last(string_split(text, ' - '))) - 3) else text end as title, case when contains(text, ' - ') then list_last(string_split(text, ' - ')) end as source
 from (select doc_id, replace(coalesce(text, ''), '. ', ' - ') as text from documents)""")
def text_split_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("t", F.replace(T.nz(F.col("text")), F.lit(". "), F.lit(" - ")))
    title, source = T.split_source(F.col("t"))
    return d.select("doc_id", title.alias("title"), source.alias("source"))


@query(f"""with t as (select doc_id, case doc_id % 3 when 0 then 'SEC 8-K ' when 1 then 'Acme hiring: ' else '' end || coalesce(text, '') x from documents) select doc_id, (starts_with(lower({strip('x')}), 'sec 8-k') or contains(lower({strip('x')}), ' hiring: ')) as templated, md5(lower({strip('x')})) as title_key from t""")
def text_title_keys(spark, sf_dir):
    x = F.concat(F.when(F.col("doc_id") % 3 == 0, "SEC 8-K ").when(F.col("doc_id") % 3 == 1, "Acme hiring: ").otherwise(""), T.nz(F.col("text")))
    d = table(spark, sf_dir, "documents").withColumn("x", x)
    return d.select("doc_id", T.is_templated(F.col("x")).alias("templated"), F.md5(T.title_key(F.col("x")).cast("binary")).alias("title_key"))


_MONEY = ["raised $6.8 Million in", "a $1.2B fund", "$500K seed", "no sum", "about $3,400,000.50 and $2 billion"]


@query(rf"""with m as (select doc_id, {picked(_MONEY, 'doc_id')} || ' ' || coalesce(text, '') x from documents) select doc_id,
 coalesce(nullif({strip(r"regexp_extract(x, '(?i)(\$[\d,.]+\s*(?:billion|million|B|M)\b)', 1)")}, ''), nullif({strip(r"regexp_extract(x, '(?i)(\$[\d,.]+[BbMm]\b)', 1)")}, '')) as amount from m""")
def text_first_amount(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("x", F.concat_ws(" ", pick(_MONEY, F.col("doc_id")), T.nz(F.col("text"))))
    return d.select("doc_id", T.first_amount(F.col("x")).alias("amount"))


@query(r"""with t as (select doc_id, coalesce(text, '') || case doc_id % 3 when 0 then ' ```json {"a": {"b": 1}} ``` end' when 1 then ' #CFO #New Grade# high' else ' HIGH' end x from documents)
 select doc_id, nullif(regexp_extract(x, '(?s)\{.*\}', 0), '') as object, array_to_string(list_filter(string_split_regex(x, '\s+'), lambda h: starts_with(h, '#')), ' ') as tags,
 case when lower(right(x, 4)) = 'high' then 'High' else 'Low' end as confidence from t""")
def model_answers(spark, sf_dir):
    """Objects, hashtags and confidence out of free text."""
    k = F.col("doc_id") % 3
    tail = F.when(k == 0, ' ```json {"a": {"b": 1}} ``` end').when(k == 1, " #CFO #New Grade# high").otherwise(" HIGH")
    d = table(spark, sf_dir, "documents").withColumn("x", F.concat(T.nz(F.col("text")), tail))
    return d.select("doc_id", T.json_object(F.col("x")).alias("object"), F.array_join(T.hashtags_of(F.col("x")), " ").alias("tags"), T.confidence(F.right(F.col("x"), F.lit(4))).alias("confidence"))


@query(f"""with {_A}, b as (select *, {_TYPE} ty from a), c as (select *, {has(V.CONTROLLER_WORDS)} ctl, {has(V.TRIGGER_VERBS)} and {has(V.FINANCE_LEADERS)} trig from b),
 r as (select *, case when not coalesce(ty = 'cfo_hire' or trig, trig) then null when ctl then case when {has(V.CFO_DESTINATIONS)} then 'cfo' else 'controller' end when ty = 'cfo_hire' or {has(V.CFO_LIKE)} then 'cfo' end role from c)
 select doc_id, case when ty in ('cfo_hire', 'merger_acquisition') or role is not null then 1 when ty = 'funding' then case when m is null then 2 when m >= 10000000 then 1 when m >= 1000000 then 2 else 3 end else 2 end as tier
 from (select *, list_max(list_transform(list_zip(regexp_extract_all(f, '(?i)\\$\\s?([\\d][\\d,]*(?:\\.\\d+)?)\\s*(billion|bn|million|mm|[bmk])?\\b', 1), regexp_extract_all(f, '(?i)\\$\\s?([\\d][\\d,]*(?:\\.\\d+)?)\\s*(billion|bn|million|mm|[bmk])?\\b', 2)),
  lambda z: replace(z[1], ',', '')::double * case lower(z[2]) when 'billion' then 1e9 when 'bn' then 1e9 when 'b' then 1e9 when 'million' then 1e6 when 'mm' then 1e6 when 'm' then 1e6 when 'k' then 1e3 else 1 end)) m from r)""".replace("\\\\", "\\"))
def text_search_tiers(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("ty", T.detect_type(F.col("f"), CFG))
    return a.select("doc_id", S.search_tier(F.col("ty"), F.col("title"), F.col("text")).alias("tier"))


@query(f"with {_A} select doc_id from a where {has(['enier', 'boston', 'onou'])}")
def by_region_texts(spark, sf_dir):
    a = articles(spark, sf_dir).select("doc_id", "title", F.col("text").alias("description"), F.lit(None).cast("string").alias("company_name"), F.array(F.lit("x")).alias("matched_regions"))
    return ranking.by_region(a, ["enier", "Boston", "onou"]).select("doc_id")


@query(f"with {_A} select doc_id from a where contains(lower(title), 'tion') or contains(lower(coalesce(text, '')), 'tion')")
def search_texts(spark, sf_dir):
    a = articles(spark, sf_dir).select("doc_id", "title", F.col("text").alias("description"), F.col("lang").alias("company_name"))
    return ranking.search(a, "Tion").select("doc_id")


_SCHOOLS = ["Boston Public Schools", "Springfield School District", "Acme Inc", "Unified School Supply", "Lakeview ISD", "Charter Schools of Ohio"]


@query(f"select doc_id, {sql_any(f"(' ' || lower({picked(_SCHOOLS, 'doc_id')} || ' ' || coalesce(text, '')) || ' ')", V.SCHOOL_DISTRICTS)} as district from documents")
def school_districts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", S.is_school_district(F.concat_ws(" ", pick(_SCHOOLS, F.col("doc_id")), T.nz(F.col("text")))).alias("district"))


_PEOPLE = ["Acme names Jane Doe as Chief Financial Officer", "Beta has appointed President Smith", "Carla Ruiz joins Gamma", "new VP Sales at Delta", "nobody"]


@query(rf"""with p as (select doc_id, {picked(_PEOPLE, 'doc_id')} || '. ' || coalesce(text, '') x from documents) select doc_id,
 nullif(regexp_extract(x, '([A-Z][a-z]+\s+[A-Z][a-z]+)(?:\s+(?:as|named|appointed|joins))', 1), '') as person, nullif(regexp_extract(x, '(?i)(?:as|named|appointed|new)\s+((?:Chief\s+)?(?:Financial|Executive|Operating|Technology)\s+Officer|CFO|CEO|COO|CTO|VP\s+\w+|President|Director)', 1), '') as person_title from p""")
def text_people(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("x", F.concat(pick(_PEOPLE, F.col("doc_id")), F.lit(". "), T.nz(F.col("text"))))
    return d.select("doc_id", T.person_name(F.col("x")).alias("person"), T.person_title(F.col("x")).alias("person_title"))


_SITE_TITLES = ["Acme Robotics Raises $5M", "Beta Health Secures Series A", "the future of work", "Gamma Closes Round", "X Wins"]


@query(rf"""with s as (select doc_id, {strip(rf"regexp_extract({picked(_SITE_TITLES, 'doc_id')}, '^(.+?)\s+(?:Raises?|Secures?|Closes?|Completes?|Acquires?|Announces?|Launches?|Receives?|Gets?|Lands?|Nabs?|Bags?|Snags?|Wins?)\b', 1)")} c from documents)
 select doc_id, case when length(c) > 2 and length(c) < 80 then c end as company from s""")
def site_companies(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.site_company(pick(_SITE_TITLES, F.col("doc_id"))).alias("company"))


_SNIPS = ["located in Boston, Massachusetts and has 1,200-1,500 employees", "It has 45+ employees and is located in Main St, Toronto, Ontario", "nothing", "with 9 employees"]


@query(f"""select doc_id, case doc_id % 4 when 0 then 'Boston, MA' when 1 then 'Toronto, ON' end as hq, case doc_id % 4 when 0 then '1200-1500' when 1 then '45' when 3 then '9' end as size from documents""")
def snippet_facts(spark, sf_dir):
    """Headquarters and head counts of snippets after each text."""
    d = table(spark, sf_dir, "documents").withColumn("s", T.hq_and_size(F.array(T.nz(F.col("text")), pick(_SNIPS, F.col("doc_id")))))
    return d.select("doc_id", "s.hq", "s.size")


@query("""with k as (select w, min(item_id) r from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) w from benchmark) group by w),
 m as (select doc_id, w, r from documents, k where contains(lower(coalesce(text, '')), w))
 select doc_id, count(*) as n, array_to_string(list(w order by r, w)[1:5], ',') as first from m group by doc_id""")
def text_many_keywords(spark, sf_dir):
    """Texts by all longer words of the benchmark, thousands at scale."""
    b = table(spark, sf_dir, "benchmark")
    words = b.select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0)).alias("keyword")).groupBy("keyword").agg(F.min("item_id").alias("rank"))
    found = keywords.first_matches(table(spark, sf_dir, "documents"), words, 5, key="doc_id", n=6)
    return found.select("doc_id", "n", F.array_join("keywords", ",").alias("first"))
