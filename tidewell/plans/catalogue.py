"""All registered queries of the library and their SQL twins, on the driver's
tables: `events` stand in for source checks and event rows, `documents` for
articles, `orders`, `customer` and `lineitem` for accounts and companies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import dates as D
from ..functions import scoring as S
from ..functions import text as T
from ..functions import vocab as V
from ..operators import ddl, dedup, gates, health, lookups, ranking, seen, store
from ..streaming import stateful

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from . import articles, cycles, records  # noqa: F401 - they register their queries here


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now(df: DataFrame, column: str) -> Column:
    """The newest value of a column, as a literal: the queries' as_of."""
    return F.lit(df.agg(F.max(column)).first()[0])


def quoted(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_any(text: str, values) -> str:
    return f"(len(list_filter({quoted(values)}, lambda x: contains({text}, x))) > 0)"


def picked(values, index: str) -> str:
    return f"{quoted(values)}[({index}) % {len(list(values))} + 1]"


def pick(values, index: Column) -> Column:
    return F.get(V.words(values), F.pmod(index, F.lit(len(list(values)))).cast("int"))


# Headlines that event ids are mapped to, and the configuration they are judged by.
HEADLINES = [
    "Acme Corp appointed Jane Doe as CFO",
    "Beta Health names new CFO after $12M raise",
    "Gamma Partners welcomes vice president of sales",
    "Delta Group announces acquisition of Omega Inc",
    "Epsilon raises $6.8 Million in Series A funding round",
    "Zeta Capital closes $1.2B fund in Ontario",
    "Eta Foundation named top employer in Boston",
    "Theta Bank hired controller in Ohio",
    "Iota concert tickets on sale in London",
    "Kappa Ltd opens new location in Atlanta",
    "SEC 8-K Item 5.02 (Departure) — Lambda Inc",
    "Mu Company hiring: Chief Financial Officer",
    "Nu School District board of education elects chair",
    "Xi Holdings secured $500K seed round",
    "Omicron merger with Pi Trust completed",
    "Rho joins the board of directors of Sigma",
]
CFG = Config.of({
    "territory": {
        "regions": ["Ontario", "Ohio", "Massachusetts"], "cities": ["Boston", "Atlanta"], "industries": ["health", "bank", "foundation", "trust"],
        "excluded_industries": ["mining", "school district"], "excluded_locations": ["london"], "target_companies": ["Kappa Ltd", "Theta Bank"],
        "company_filters": {"exclude_public_companies": True, "public_company_indicators": ["nasdaq", "nyse:"], "excluded_public_companies": ["zeta capital"]},
    },
    "keywords": {"executive_hires": ["controller", "vice president", "cfo", "chief financial officer"], "mergers_acquisitions": ["acquisition of", "merger with"], "funding_events": ["raises", "series a", "funding", "seed round", "closes"]},
    "excluded_content": ["concert", "tickets"],
})
_TITLE = picked(HEADLINES, "event_id")
_LOW = f"lower({_TITLE})"
_TYPE = f"""case when {sql_any(_LOW, CFG.excluded_content)} then null
  when {sql_any(_LOW, V.CFO_WORDS)} and {sql_any(_LOW, V.CFO_VERBS)} then 'cfo_hire'
  when {sql_any(_LOW, CFG.executive_words)} and {sql_any(_LOW, V.HIRE_VERBS)} then 'executive_hire'
  when {sql_any(_LOW, CFG.merger_words)} then 'merger_acquisition'
  when {sql_any(_LOW, V.STRONG_FUNDING)} then 'funding' end"""
_REGIONS = f"""case when {sql_any(_LOW, CFG.excluded_locations)} then []::varchar[] else
  list_concat(list_filter({quoted(CFG.regions)}, lambda x: contains({_LOW}, x)), list_filter({quoted(CFG.cities)}, lambda x: contains({_LOW}, x))) end"""
_EXCLUDED = sql_any(_LOW, CFG.excluded_industries)
_INDUSTRY = f"({sql_any(_LOW, CFG.industries)} and not {_EXCLUDED})"


def headline_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("title", pick(HEADLINES, F.col("event_id")))


# ---------------------------------------------------------------- events: windows of time


@query("""select event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') as at from events
 where ts > (select max(ts) from events) - interval 24 hours order by ts desc, event_id limit 50""")
def recent_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    new = e.where(F.col("ts") > D.since(now(e, "ts"), 24)).orderBy(F.desc("ts"), "event_id").limit(50)
    return new.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""select event_type, count(*) as n, count(*) filter (ts >= (select max(ts) from events) - interval 24 hours) as n_recent from events group by event_type""")
def stats_by_type(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ranking.stats(e, "event_type", "ts", now(e, "ts"))


@query("""with a as (select max(ts) m from events), c as (select count(*) filter (ts >= m - interval 7 days) r, count(*) filter (ts < m - interval 7 days and ts >= m - interval 14 days) p from events, a)
 select r as recent, p as prior, round(case when p = 0 then 100.0 else (r - p) * 100.0 / greatest(p, 1) end, 6)::double as change from c""")
def volume_trend(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return health.volume_trend(e, "ts", now(e, "ts")).withColumn("change", F.round("change", 6))


@query("""with a as (select max(ts) m from events)
 select count(*) filter (ts >= m - interval 7 days) as this_week, count(*) filter (ts >= m - interval 14 days and ts < m - interval 7 days) as last_week,
  count(*) filter (event_type = 'error' and ts >= m - interval 7 days) as removed,
  count(*) filter (ts >= m - interval 7 days) - count(*) filter (ts >= m - interval 14 days and ts < m - interval 7 days) as delta from events, a""")
def scorecard(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("ts").alias("discovered_at"), F.when(F.col("event_type") == "error", F.col("ts")).alias("blocked_at"))
    return ranking.scorecard(rows, now(e, "ts"))


@query("""select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as n_window,
 count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) <= 2 as within from events""")
def sliding_hour_cap(spark, sf_dir):
    return stateful.sliding_cap(table(spark, sf_dir, "events"), "ts", "event_id", "user_id", 2).select("event_id", "user_id", "n_window", "within")


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m') as month, count(*) over (partition by strftime(o_orderdate, '%Y-%m') order by o_orderdate, o_orderkey rows unbounded preceding) as n_month,
 count(*) over (partition by strftime(o_orderdate, '%Y-%m') order by o_orderdate, o_orderkey rows unbounded preceding) > 100 as over from orders""")
def month_budget(spark, sf_dir):
    return stateful.month_budget(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 100).select("o_orderkey", "month", "n_month", "over")


@query("""with e as (select *, count(*) filter (event_type <> 'error') over (partition by user_id order by ts, event_id) g from events),
 s as (select event_id, user_id, count(*) filter (event_type = 'error') over (partition by user_id, g order by ts, event_id) streak from e)
 select event_id, streak, case when streak = 0 then 0.0::double else least(pow(2, streak), 300.0)::double end as backoff from s""")
def backoff_ladder(spark, sf_dir):
    from pyspark.sql.window import Window as W

    bad = F.col("event_type") == "error"
    order = [F.col("ts"), F.col("event_id")]
    e = table(spark, sf_dir, "events").withColumn("_g", F.count_if(~bad).over(W.partitionBy("user_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    streak = F.count_if(bad).over(W.partitionBy("user_id", "_g").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    e = e.withColumn("streak", streak)
    return e.select("event_id", "streak", F.when(F.col("streak") == 0, F.lit(0.0)).otherwise(F.least(F.pow(F.lit(2.0), "streak"), F.lit(300.0))).alias("backoff"))


@query("""with e as (select user_id, event_id, ts, event_type <> 'error' ok, value from events),
 t as (select user_id, count(*) total, count(*) filter (ok) good, count(*) filter (not ok) bad, max(ts) lc from e group by user_id),
 g as (select user_id, max((ts, event_id)) filter (ok) lg, max((ts, event_id)) filter (not ok) lb from e group by user_id),
 s as (select e.user_id, count(*) filter (not ok and (lg is null or (ts, event_id) > lg)) cf, count(*) filter (ok and (lb is null or (ts, event_id) > lb)) cs from e join g using (user_id) group by e.user_id),
 m as (select user_id, avg(value) a from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) n from e where ok and value > 0) where n <= 100 group by user_id)
 select t.user_id, total as total_requests, good as successful_requests, bad as failed_requests, cf as consecutive_failures, cs as consecutive_successes, round(good / total, 6)::double as success_rate, round(a, 6)::double as avg_response_time_ms,
  case when total < 3 then 'unknown' when cf >= 3 or good / total < 0.5 then 'unhealthy' when good / total < 0.9 then 'degraded' else 'healthy' end as status
 from t join s using (user_id) left join m using (user_id)""")
def source_health(spark, sf_dir):
    return health_rows(spark, sf_dir).select("user_id", "total_requests", "successful_requests", "failed_requests", "consecutive_failures", "consecutive_successes", F.round("success_rate", 6).alias("success_rate"), F.round("avg_response_time_ms", 6).alias("avg_response_time_ms"), "status")


def health_rows(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error").withColumn("found", (F.col("event_type") == "purchase").cast("long"))
    return health.health(e.withColumn("message", F.when(~F.col("ok"), F.col("props"))), "user_id", "ts", "ok", "event_id", "value", "found", "message")


@query("""with e as (select user_id, event_type <> 'error' ok, event_type = 'purchase' p, ts, event_id from events),
 g as (select user_id, max((ts, event_id)) filter (ok) lg from e group by user_id),
 s as (select e.user_id, count(*) total, count(*) filter (ok) good, count(*) filter (p) ev, count(*) filter (not ok and (lg is null or (ts, event_id) > lg)) cf from e join g using (user_id) group by e.user_id),
 c as (select *, case when total < 3 then 'unknown' when cf >= 3 or good / total < 0.5 then 'unhealthy' when good / total < 0.9 then 'degraded' else 'healthy' end st from s)
 select count(*) as total, count(*) filter (st = 'healthy') as healthy, count(*) filter (st = 'degraded') as degraded, count(*) filter (st = 'unhealthy') as unhealthy, count(*) filter (st = 'unknown') as unknown,
 round(sum(good) / sum(total), 6)::double as overall_success_rate, sum(ev)::bigint as total_events from c""")
def health_summary(spark, sf_dir):
    return health.summary(health_rows(spark, sf_dir)).drop("last_check").withColumn("overall_success_rate", F.round("overall_success_rate", 6))


@query("""select user_id, count(*) filter (g is null or (ts, event_id) > g) as failures from (select e.*, max((ts, event_id)) filter (event_type <> 'error') over (partition by user_id) g from events e) where event_type = 'error' group by user_id""")
def failure_streak(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    bad = e.where(~F.col("ok")).select("user_id").distinct()
    return health.final_streaks(e, "user_id", "ts", "ok", "event_id").join(bad, "user_id", "left_semi").select("user_id", F.col("consecutive_failures").alias("failures"))


@query("""select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 99 preceding and current row) + 1e-7, 4)::double as rolling_mean from events where value > 0""")
def rolling_mean_100(spark, sf_dir):
    return health.rolling_mean(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value").select("event_id", F.round(F.col("rolling_mean") + 1e-7, 4).alias("rolling_mean"))


_MESSAGES = ["Connection timeout", "HTTP 429", "403 Forbidden", "page not found", "Bad gateway 502", "network unreachable", "SSL handshake", "invalid XML", "boom", "Rate limit hit"]


@query(f"""with m as (select lower({picked(_MESSAGES, 'event_id')}) t from events where event_type = 'error')
 select case {' '.join(f"when {sql_any('t', w)} then '{c}'" for c, w in V.ERROR_CLASSES)} else 'other' end as error_class, count(*) as n from m group by 1""")
def error_categories(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.groupBy(health.error_class(pick(_MESSAGES, F.col("event_id"))).alias("error_class")).agg(F.count("*").alias("n"))


@query("""with a as (select max(ts) m from events), s as (select user_id, max(ts) lc, count(*) filter (event_type = 'purchase') ev, case when count(*) filter (event_type = 'error') > count(*) * 0.3 then 'error' else 'success' end st from events group by user_id),
 v as (select case when count(*) filter (st = 'error') > 5 then 2 when count(*) = 0 or count(*) filter (ev > 0) < 2 then 1 else 0 end r from s
 union all select case when epoch(max(m) - max(lc)) / 3600 > 10 then 2 when max(lc) is null or epoch(max(m) - max(lc)) / 3600 > 6 then 1 else 0 end from s, a
 union all select case when count(*) filter (ts >= m - interval 7 days) < 10 or (count(*) filter (ts >= m - interval 7 days) - count(*) filter (ts >= m - interval 14 days and ts < m - interval 7 days)) * 100.0 / greatest(count(*) filter (ts >= m - interval 14 days and ts < m - interval 7 days), 1) < -50 then 1 else 0 end from events, a)
 select case max(r) when 2 then 'FAIL' when 1 then 'WARN' else 'PASS' end as overall from v""")
def health_overall(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    as_of = now(e, "ts")
    s = e.groupBy("user_id").agg(F.max("ts").alias("last_check"), F.count_if(F.col("event_type") == "purchase").alias("events_found"), F.when(F.count_if(F.col("event_type") == "error") > F.count("*") * 0.3, "error").otherwise("success").alias("status"))
    checks = health.check_sources(s).union(health.check_freshness(s, e, as_of, found="ts")).union(health.check_volume(e, "ts", as_of))
    return health.overall(checks)


@query("""with a as (select max(o_orderdate) m from orders) select case when d <= 7 then 'fresh' when d <= 14 then 'aging' else 'stale' end as colour,
 case when s < 3600 then floor(s / 60)::bigint || ' min ago' when s < 86400 then floor(s / 3600)::bigint || ' hours ago' else floor(s / 86400)::bigint || ' days ago' end as age, count(*) as n
 from (select epoch(m - o_orderdate) s, floor(epoch(m - o_orderdate) / 86400) d from orders, a) group by 1, 2""")
def age_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    as_of = now(o, "o_orderdate")
    return o.groupBy(D.age_colour(F.col("o_orderdate"), as_of).alias("colour"), D.age_text(F.col("o_orderdate"), as_of).alias("age")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- pages and texts


@query("select page_id, md5(url || ':' || page_id) as event_id, md5(url) as url_hash from pages")
def event_id_md5(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.event_id(F.col("url"), F.col("page_id").cast("string")).alias("event_id"), T.url_hash(F.col("url")).alias("url_hash"))


@query("select regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) as domain, count(*) as n from pages group by 1")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(T.authority(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query("""select label, count(*) as n from (select substr(replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), 'www.', ''), 1, 28) as label from pages) group by 1 order by 2 desc, 1 limit 8""")
def source_label_top(spark, sf_dir):
    return ranking.top_counts(table(spark, sf_dir, "pages"), T.source_label(F.col("url")), 8)


@query(r"""select page_id, md5(t) as text_md5, length(t)::bigint as n from (select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
 regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g')) t from pages)""")
def html_strip(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("t"))
    return p.select("page_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").cast("long").alias("n"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages")
def page_title_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"))


_WORDS = ["idiot", "scum", "clown", "worthless", "tionen", "ierung", "ment que", "ación", "the of", "and the"]


@query(f"select doc_id, array_to_string(list_filter({quoted(_WORDS)}, lambda x: contains(lower(text), x))[1:5], '|') as words from documents")
def keyword_match_top5(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("_t", F.lower("text"))
    return d.select("doc_id", F.array_join(F.slice(V.held(F.col("_t"), _WORDS), 1, 5), "|").alias("words"))


@query(f"""select event_id, {_TYPE} as type from events""")
def detect_type(spark, sf_dir):
    return headline_rows(spark, sf_dir).select("event_id", T.detect_type(F.col("title"), CFG).alias("type"))


@query(f"""select event_id, case when {sql_any(_LOW, CFG.excluded_content)} then 'content' when {sql_any(_LOW, CFG.excluded_locations)} then 'location'
 when {_EXCLUDED} then 'industry' when {sql_any(_LOW, CFG.public_companies + CFG.public_indicators)} then 'public' else 'keep' end as reason from events""")
def gate_exclusions(spark, sf_dir):
    t = F.col("title")
    reason = F.when(gates.excluded_content(t, CFG), "content").when(gates.excluded_location(t, CFG), "location").when(gates.excluded_industry(t, CFG), "industry").when(gates.public_company(t, CFG), "public").otherwise("keep")
    return headline_rows(spark, sf_dir).select("event_id", reason.alias("reason"))


@query(f"""select event_id, array_to_string({_REGIONS}, '|') as places, {_INDUSTRY} as industry,
 list_filter({quoted(CFG.target_companies)}, lambda x: contains({_LOW}, x))[1] as company from events""")
def territory_match(spark, sf_dir):
    t = F.col("title")
    return headline_rows(spark, sf_dir).select("event_id", F.array_join(gates.territory(t, CFG), "|").alias("places"), gates.target_industry(t, CFG).alias("industry"), gates.target_company(t, CFG).alias("company"))


@query(f"""select event_id, least(100, case {_TYPE} when 'cfo_hire' then 40 when 'executive_hire' then 30 when 'merger_acquisition' then 35 when 'funding' then 25 else 10 end
 + least(15 * len({_REGIONS}), 30) + case when {_INDUSTRY} then 20 else 0 end + case when {sql_any(_LOW, CFG.target_companies)} then 50 else 0 end)::double as score from events""")
def relevance_score(spark, sf_dir):
    t = F.col("title")
    return headline_rows(spark, sf_dir).select("event_id", S.relevance(T.detect_type(t, CFG), F.size(gates.territory(t, CFG)), gates.target_industry(t, CFG), gates.target_company(t, CFG).isNotNull()).alias("score"))


@query(rf"""select event_id, case when amount = '' then null else replace(amount, ',', '')::double * case lower(unit) when 'b' then 1e9 when 'billion' then 1e9 when 'm' then 1e6 when 'million' then 1e6 when 'k' then 1e3 else 1 end end as amount
 from (select event_id, regexp_extract({_TITLE}, '\$\s?([\d][\d,]*(?:\.\d+)?)\s*(?i:billion|bn|million|mm|[bmk])?', 1) amount, regexp_extract({_TITLE}, '\$\s?[\d][\d,]*(?:\.\d+)?\s*((?i:billion|bn|million|mm|[bmk]))\b', 1) unit from events)""")
def funding_amount(spark, sf_dir):
    return headline_rows(spark, sf_dir).select("event_id", T.largest_amount(F.col("title")).alias("amount"))


@query(f"""with e as (select event_id, {_TYPE} ty, {_LOW} t, {_TITLE} h from events),
 f as (select *, ty = 'cfo_hire' or ({sql_any('t', V.TRIGGER_VERBS)} and {sql_any('t', V.FINANCE_LEADERS)}) trig from e)
 select event_id, case when not coalesce(trig, false) then null when {sql_any('t', V.CONTROLLER_WORDS)} then case when {sql_any('t', V.CFO_DESTINATIONS)} then 'cfo' else 'controller' end
  when ty = 'cfo_hire' or {sql_any('t', V.CFO_LIKE)} then 'cfo' end as role,
  coalesce(ty = 'executive_hire' and {sql_any('t', V.BOARD_WORDS)} and not {sql_any('t', V.FINANCE_LEADERS)}, false) as board_only from f""")
def finance_roles(spark, sf_dir):
    e = headline_rows(spark, sf_dir).withColumn("ty", T.detect_type(F.col("title"), CFG))
    none = F.lit(None).cast("string")
    return e.select("event_id", S.finance_role(F.col("ty"), F.col("title"), none).alias("role"), F.coalesce(S.board_only(F.col("ty"), F.col("title"), none), F.lit(False)).alias("board_only"))


def _company_sql(title: str) -> str:
    """company_name over ASCII headlines: the same patterns, with classes that
    RE2 knows."""
    plain = lambda p: p.replace("(?U)", "").replace("'", "''")
    cleaned = title
    for p in T._PREFIXES:
        cleaned = f"regexp_replace({cleaned}, '(?i){plain(p)}', '', 'g')"
    found = "[" + ", ".join(f"regexp_extract(subject, '{plain(p)}', 1)" for p in T._COMPANY_PATTERNS) + "]"
    tidy = r"list_transform(raws, lambda r: regexp_replace(regexp_replace(trim(r), '[,;:\.\s]+$', ''), '^[Tt]he\s+', ''))"
    good = rf"list_filter({tidy}, lambda c: length(c) between 3 and 79 and not list_contains({quoted(T._NO_COMPANY)}, lower(c)) and 2 * length(regexp_replace(c, '\D', '', 'g')) <= length(c) and not (upper(c) = c and regexp_matches(c, '[A-Za-z]') and len(string_split_regex(c, '\s+')) <= 3))"
    return rf"(select case when cleaned <> '' and not regexp_matches(cleaned, '(?i)^\d+\s+(?:Press|Releases|Stories|Headlines|Hires|Deals|Moves)\b') then {good}[1] end from (select *, {found} raws from (select cleaned, regexp_replace(cleaned, '^[A-Z][\w\s&\.\-''’]{{1,40}}?-backed\s+', '') subject from (select {cleaned} cleaned))))"


@query(rf"""with h as (select distinct {_TITLE} title from events), c as (select title, {_company_sql('title')} company, nullif(regexp_extract(title, '([A-Z][a-z]+\s+[A-Z][a-z]+)(?:\s+(?:as|named|appointed|joins))', 1), '') person,
 nullif(regexp_extract(title, '(?i)(?:as|named|appointed|new)\s+((?:Chief\s+)?(?:Financial|Executive|Operating|Technology)\s+Officer|CFO|CEO|COO|CTO|VP\s+\w+|President|Director)', 1), '') person_title from h)
 select event_id, company, person, person_title from events join c on c.title = {_TITLE}""")
def company_extract(spark, sf_dir):
    t = F.col("title")
    return headline_rows(spark, sf_dir).select("event_id", T.company_name(t).alias("company"), T.person_name(t).alias("person"), T.person_title(t).alias("person_title"))


@query(f"""with h as (select distinct {_TITLE} title from events), a as (select title, lower(title || ' ' || title) t from h), b as (select *, case when {sql_any('t', CFG.excluded_content)} then null
  when {sql_any('t', V.CFO_WORDS)} and {sql_any('t', V.CFO_VERBS)} then 'cfo_hire' when {sql_any('t', CFG.executive_words)} and {sql_any('t', V.HIRE_VERBS)} then 'executive_hire' when {sql_any('t', CFG.merger_words)} then 'merger_acquisition' when {sql_any('t', V.STRONG_FUNDING)} then 'funding' end ty,
  case when {sql_any('t', CFG.excluded_locations)} then 0 else len(list_filter({quoted([*CFG.regions, *CFG.cities])}, lambda x: contains(t, x))) end n, list_filter({quoted(CFG.target_companies)}, lambda x: contains(t, x))[1] c from a),
 g as (select title, coalesce(ty, 'stable_target') kind, c, case when {sql_any('t', CFG.excluded_industries)} then 'excluded_industry' when {sql_any('t', CFG.public_companies + CFG.public_indicators)} then 'public_company' when {sql_any('t', CFG.excluded_locations)} then 'excluded_location'
  when ty is null and not (c is not null or ({sql_any('t', V.PE_WORDS)} and n > 0)) then 'no_type' when n = 0 and c is null then 'out_of_territory' end drop_reason,
  least(100, least(100, case ty when 'cfo_hire' then 40 when 'executive_hire' then 30 when 'merger_acquisition' then 35 when 'funding' then 25 else 10 end + least(15 * n, 30) + case when {sql_any('t', CFG.industries)} and not {sql_any('t', CFG.excluded_industries)} then 20 else 0 end + case when c is not null then 50 else 0 end) + 15)::double relevance_score,
  array_to_string(case when ty in ('cfo_hire', 'executive_hire') then list_filter({quoted(CFG.executive_words)}, lambda x: contains(t, x)) when ty = 'merger_acquisition' then list_filter({quoted(CFG.merger_words)}, lambda x: contains(t, x)) when ty = 'funding' then list_filter({quoted(CFG.funding_words)}, lambda x: contains(t, x))
   else []::varchar[] end[1:5], '|') words, coalesce(c, {_company_sql("(title || ' ' || title)")}) company_name from b)
 select event_id, drop_reason, kind, company_name, relevance_score, words from events join g on g.title = {_TITLE}""")
def feed_gates(spark, sf_dir):
    """The composite gate of feed entries over all events' headlines."""
    e = headline_rows(spark, sf_dir).select("event_id", "title", F.lit("PR Newswire").alias("feed_name"), F.concat(F.lit("<p>"), F.col("title"), F.lit("</p>")).alias("summary"))
    out = gates.feed_gate(e, CFG)
    return out.select("event_id", "drop_reason", F.col("event_type").alias("kind"), "company_name", "relevance_score", F.array_join("matched_keywords", "|").alias("words"))


_SUFFIXED = ["Acme, Inc.", "Acme Inc", "Beta LLC", "Gamma Corp.", "Delta Company", "Epsilon Co.", " Zeta, LLC ", "Eta Ltd", "Theta", "iota."]


@query(f"""with n as (select event_id, lower(trim({picked(_SUFFIXED, 'event_id')})) s from events)
 select event_id, trim(case {' '.join(f"when ends_with(s, '{x}') then left(s, length(s) - {len(x)})" for x in V.ACCOUNT_SUFFIXES)} else s end, ' .,') as account_key from n""")
def account_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.account_key(pick(_SUFFIXED, F.col("event_id"))).alias("account_key"))


@query("""select c_custkey, case when c_acctbal < 0 then '' when c_acctbal < 10 * 100 then 'LMM' when c_acctbal < 20 * 100 then 'MM' when c_acctbal < 100 * 100 then 'Corp' else 'Enterprise' end as band from customer""")
def revenue_band(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    text = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("$"), F.format_string("%.4f", F.col("c_acctbal") / 100), F.lit("M"))).otherwise("none")
    return c.select("c_custkey", T.revenue_band(text).alias("band"))


@query("""select c_custkey, case when d >= 1e9 then '$' || format('{:.1f}', d / 1e9) || 'B' when d >= 1e6 then '$' || format('{:.1f}', d / 1e6) || 'M' when d >= 1e3 then '$' || format('{:.1f}', d / 1e3) || 'K' else '$' || format('{:.0f}', d) end as revenue
 from (select c_custkey, c_custkey * 1237.31::double d from customer)""")
def revenue_texts(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.revenue_text(F.col("c_custkey") * F.lit(1237.31)).alias("revenue"))


# ---------------------------------------------------------------- companies of orders

_HQS = ["Boston, MA", "Austin, TX", "Toronto, Ontario", "Berlin, Germany", "", "Ohio", "somewhere"]
_BANDS = ["MM", "Corp", "Enterprise", "", "LMM"]
_SUBS = ["Banking", "OTHER", "Childcare", "", "Real Estate"]
_ROLES = ["Target", "Advisor", "Acquirer", "Investor", "Partner", "Primary", "Hiring Company", "mentioned"]


def companies_of_orders(spark, sf_dir) -> DataFrame:
    """o_orderkey, companies: the lines of an order as companies, by line, name,
    role and score (line numbers may repeat). Orders have a few lines; nothing
    else is gathered."""
    li = table(spark, sf_dir, "lineitem")
    text = lambda name: F.lit(None).cast("string").alias(name)
    company = F.struct(
        F.col("l_linenumber").alias("pos"),
        F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("name"),
        pick(_ROLES, F.col("l_suppkey") + F.col("l_linenumber")).alias("role"),
        pick(_HQS, F.col("l_partkey")).alias("hq"),
        pick(_BANDS, F.col("l_partkey") + F.col("l_suppkey")).alias("revenue"),
        pick(_SUBS, F.col("l_suppkey")).alias("zi_subindustry"),
        text("industry"),
        F.struct(pick(["A", "B", "C", "D", "E"], F.col("l_partkey")).alias("grade"), F.col("l_quantity").cast("int").alias("score")).alias("tal"),
    )
    rows = li.select("l_orderkey", company.alias("c"))
    placed = F.struct("c.pos", "c.name", "c.role", "c.tal.score", "c")
    return rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(placed)), lambda p: p["c"]).alias("companies"))


_COMPANIES = f"""(select *, row_number() over (partition by l_orderkey order by line, name, role, score) pos from (select l_orderkey, l_linenumber line, 'c' || l_partkey as name, {picked(_ROLES, 'l_suppkey + l_linenumber')} as role, {picked(_HQS, 'l_partkey')} as hq,
 {picked(_BANDS, 'l_partkey + l_suppkey')} as revenue, {picked(_SUBS, 'l_suppkey')} as zi, {picked(['A', 'B', 'C', 'D', 'E'], 'l_partkey')} as grade, l_quantity::int as score from lineitem))"""
_FIT = f"""(select *, case when hq in ('Boston, MA', 'Toronto, Ontario', 'Ohio') then 'in' when hq in ('Austin, TX', 'Berlin, Germany') then 'out' else 'unknown' end terr,
 case when revenue in ('LMM', 'MM', 'Corp') then 'in' when revenue = 'Enterprise' then 'out' else 'unknown' end rev, case when zi = 'OTHER' then 'out' when zi = '' then 'unknown' else 'in' end vert,
 list_position({quoted(V.WORKABLE_ROLES)}, lower(role)) wrole, list_position({quoted(V.PRIMARY_ROLES)}, lower(role)) prole from {_COMPANIES})"""


@query(f"""with f as (select *, case when 'out' in (terr, rev, vert) then 'fail' when terr = 'in' and rev = 'in' and vert = 'in' then 'pass' else 'unverified' end v from {_FIT}),
 a as (select *, row_number() over (partition by l_orderkey order by case when wrole > 0 then 0 else 1 end, case when wrole > 0 then case v when 'pass' then 0 when 'unverified' then 1 else 2 end else 0 end, case when wrole > 0 then wrole else 0 end, pos) n,
  count(*) filter (wrole > 0) over (partition by l_orderkey) w, count(*) filter (wrole > 0 and v = 'fail') over (partition by l_orderkey) wf from f)
 select l_orderkey, case when w > 0 and w = wf then 'fail' else v end as verdict, name as account_name, terr as territory, rev as revenue, vert as vertical from a where n = 1""")
def fit_gate(spark, sf_dir):
    return gates.event_fits(companies_of_orders(spark, sf_dir), "l_orderkey")


@query(f"""select l_orderkey, max(name) filter (n = 1) as primary_name, max(name) filter (m = 1) as listed_name from (select *,
 row_number() over (partition by l_orderkey order by case when prole > 0 then prole else 99 end, pos) n, row_number() over (partition by l_orderkey order by case when prole > 0 then 0 else 1 end, pos) m from {_FIT}) group by l_orderkey""")
def primary_pick(spark, sf_dir):
    o = companies_of_orders(spark, sf_dir)
    return o.select("l_orderkey", S.pick_primary(F.col("companies"))["name"].alias("primary_name"), S.listed_primary(F.col("companies"))["name"].alias("listed_name"))


@query(f"""select l_orderkey, name as headline, grade, score from (select *, row_number() over (partition by l_orderkey order by case grade when 'A' then 0 when 'B' then 1 when 'C' then 2 when 'D' then 3 else 4 end, score desc, pos) n from {_COMPANIES}) where n = 1""")
def headline_best(spark, sf_dir):
    o = companies_of_orders(spark, sf_dir).withColumn("h", S.headline(F.col("companies")))
    return o.select("l_orderkey", F.col("h.name").alias("headline"), F.col("h.tal.grade").alias("grade"), F.col("h.tal.score").alias("score"))


_TAGS = list(V.HASHTAG_POINTS)


@query(f"""with t as (select event_id, list_filter({quoted(_TAGS)}, lambda x: ((event_id * 2654435761) // (1 << (list_position({quoted(_TAGS)}, x) - 1))) % 3 = 0) tags, {picked(['High', 'Medium', 'Low', ''], 'user_id')} conf from events),
 p as (select *, list_sum(list_transform(tags, lambda x: case when x = '#NewCFO' then 5 when list_contains({quoted(V.HIGH_INTENT)}, x) then 3 else 2 end)) s0, len(list_filter(tags, lambda x: list_contains({quoted(V.HIGH_INTENT)}, x))) hi,
  2 * len(list_filter(tags, lambda x: list_contains({quoted(V.COMPLEXITY)}, x))) cx from t),
 g as (select *, coalesce(s0, 0)::int s, case when len(tags) = 0 then 'D' when hi > 0 then case when s0 >= 8 then 'A' when s0 >= 5 then 'B' when s0 >= 2 then 'C' else 'D' end when cx >= 8 then 'B' when s0 >= 2 then 'C' else 'D' end gr from p)
 select event_id, s as score, case when conf not in ('High', 'Medium') and gr in ('A', 'B') then 'C' else gr end as grade from g""")
def hashtag_grade(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tags = F.transform(F.filter(F.transform(V.words(_TAGS), lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda p: F.call_function("shiftright", F.col("event_id") * 2654435761, p["i"]) % 3 == 0), lambda p: p["t"])
    g = S.grade(tags, pick(["High", "Medium", "Low", ""], F.col("user_id")))
    return e.select("event_id", g["score"].alias("score"), g["grade"].alias("grade"))


# ---------------------------------------------------------------- duplicates and stores


@query("""select doc_id, row_number() over (partition by lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) order by doc_id) = 1 as kept, count(*) over (partition by lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) as copies from documents where trim(text) <> ''""")
def title_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("trim(text) <> ''").withColumn("found", F.col("doc_id"))
    return dedup.title_groups(d, "doc_id", "text", found="found").select("doc_id", (F.col("keep_rank") == 1).alias("kept"), "copies")


@query()
def greedy_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("|", "source", "lang", F.col("doc_id") % 40).alias("url"), F.col("text").alias("title"))
    return dedup.greedy(d, order="doc_id").select("doc_id")


@query("""select page_id from pages where page_id not in (select page_id from pages p where exists (select 1 from pages q where q.url = p.url and q.page_id % 3 = 0))""")
def url_anti_join(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    seen = p.where("page_id % 3 = 0").select(T.url_hash(F.col("url")).alias("url_hash"))
    return dedup.unseen(p, seen).select("page_id")


@query("""select page_id from pages where page_id not in (select page_id from pages p where exists (select 1 from pages q where q.url = p.url and q.page_id % 3 = 0))""")
def seen_filters(spark, sf_dir):
    """The same behind Bloom filters of three days."""
    import uuid

    p = table(spark, sf_dir, "pages")
    known = seen.SeenUrls(spark, f"{store.shared_dir(spark)}/seen/{uuid.uuid4().hex}", 1 << 12)
    for day in range(3):
        known.add(p.where(f"page_id % 9 = {3 * day}").select(T.url_hash(F.col("url")).alias("url_hash")), f"2024-01-0{day + 1}")
    return known.unseen(p).select("page_id")


@query("""with a as (select max(o_orderdate) m from orders) select o_orderkey from orders x where not exists (select 1 from orders y, a where y.o_orderkey % 2 = 0 and y.o_orderdate >= m - interval 4000 hours
 and y.o_custkey = x.o_custkey) """)
def title_horizon_anti_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("title", F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")))
    return dedup.fresh_titles(o, o.where("o_orderkey % 2 = 0"), now(o, "o_orderdate"), 4000, found="o_orderdate").select("o_orderkey")


@query("""select c.c_custkey, c.c_name as title, case when st is null or lower(st) = 'new' or trim(st) = '' then 'NEW' else st end as lead_status, case when coalesce(nt, '') = '' then 'fresh' else nt end as notes, g as grade
 from customer c left join (select c_custkey, case c_custkey % 4 when 0 then 'new' when 1 then 'REVIEWED' when 2 then '' else 'NOT RELEVANT' end st, case when c_custkey % 3 = 0 then 'note' else '' end nt, 'B' g from customer where c_custkey % 2 = 0 or c_custkey % 4 = 1) h using (c_custkey)""")
def state_preserving_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    scraped = c.select("c_custkey", F.col("c_name").alias("title"), F.lit("fresh").alias("notes"))
    k = F.col("c_custkey")
    hosted = c.where((k % 2 == 0) | (k % 4 == 1)).select("c_custkey", F.when(k % 4 == 0, "new").when(k % 4 == 1, "REVIEWED").when(k % 4 == 2, "").otherwise("NOT RELEVANT").alias("lead_status"), F.when(k % 3 == 0, "note").otherwise("").alias("notes"), F.lit("B").alias("grade"))
    return store.keep_state(scraped, hosted, "c_custkey").select("c_custkey", "title", "lead_status", "notes", "grade")


@query("""select c_custkey, 'local' as side from customer where c_custkey % 3 <> 0 union all select c_custkey, 'remote' from customer where c_custkey % 3 = 0""")
def keyed_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return store.keyed_union(c.where("c_custkey % 3 <> 0").select("c_custkey", F.lit("local").alias("side")), c.select("c_custkey", F.lit("remote").alias("side")), "c_custkey")


@query("""select c_custkey, case when c_custkey % 5 = 0 then c_acctbal + 1 else c_acctbal end as balance from customer where c_custkey % 7 <> 1""")
def merge_and_delete(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    merged = store.merge_on(c, c.where("c_custkey % 5 = 0").withColumn("balance", F.col("balance") + 1), "c_custkey")
    return store.delete_keys(merged, c.where("c_custkey % 7 = 1"), "c_custkey")


@query("""select c_custkey, case when c_custkey % 5 = 0 then c_acctbal + 1 else c_acctbal end as balance from customer where c_custkey % 7 <> 1 and not (c_custkey % 11 = 2 and c_acctbal < 0)
 union all select c_custkey + 10000000, c_acctbal from customer where c_nationkey = 3 and not (c_custkey % 11 = 2 and c_acctbal < 0)""")
def bucket_merges(spark, sf_dir):
    """A bucketed table: a merge, a delete, an append, and compaction that
    retains some rows."""
    import uuid

    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), (F.col("c_custkey") % 11 == 2).alias("old"), "c_nationkey")
    own = store.Buckets(spark, f"{store.shared_dir(spark)}/buckets/{uuid.uuid4().hex}", "c_custkey", 8)
    own.merge(c)
    own.merge(c.where("c_custkey % 5 = 0").withColumn("balance", F.col("balance") + 1))
    own.delete(c.where("c_custkey % 7 = 1"))
    own.append(c.where("c_nationkey = 3").withColumn("c_custkey", F.col("c_custkey") + 10_000_000))
    own.compact(keep=~(F.col("old") & (F.when(F.col("c_custkey") < 10_000_000, F.col("balance") - F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0)).otherwise(F.col("balance")) < 0)))
    own.vacuum(1)
    return own.read().select("c_custkey", "balance")


@query("""select 'analyst' as role, c_custkey, c_name as name, case when c_custkey % 2 = 0 then 'LATE' else 'NEW' end as lead_status, '***' as phone from customer where c_acctbal >= 0
 union all select 'service', c_custkey, c_name, case when c_custkey % 2 = 0 then 'LATE' else 'NEW' end, c_phone_text from (select *, 'p' || c_nationkey as c_phone_text from customer)""")
def role_views(spark, sf_dir):
    """A bucketed table that gained a column, as two roles see it."""
    import uuid

    name = f"customers_{uuid.uuid4().hex[:12]}"
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.concat(F.lit("p"), F.col("c_nationkey")).alias("phone"), F.col("c_acctbal").alias("balance"))
    ddl.create(spark, name, dict(c.dtypes), "c_custkey", f"{store.shared_dir(spark)}/tables/{name}", 8)
    ddl.insert(c.where("c_custkey % 2 = 1"), name)
    ddl.migrate(spark, name, {"lead_status": ("string", "'NEW'"), "name": ("string", None)})
    ddl.insert(c.where("c_custkey % 2 = 0").withColumn("lead_status", F.lit("LATE")), name)
    views = ddl.apply_policies(spark, name, [ddl.Policy("analyst", "balance >= 0", ("c_custkey", "name", "lead_status", "phone"), (("phone", "'***'"),)), ddl.Policy("service")])
    shown = [spark.table(v).select(F.lit(role).alias("role"), "c_custkey", "name", "lead_status", "phone") for role, v in views.items()]
    return shown[0].union(shown[1])


@query("""select o_orderkey, case when o_orderkey % 9 = 0 then 'old' when o_orderkey % 4 = 0 then 'gate' end as blocked_reason from orders""")
def tombstones(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    as_of = now(o, "o_orderdate")
    k = F.col("o_orderkey")
    t = o.select("o_orderkey", F.when(k % 9 == 0, F.col("o_orderdate")).alias("blocked_at"), F.when(k % 9 == 0, "old").alias("blocked_reason"))
    return store.tombstone(t, o.where(k % 4 == 0).select("o_orderkey", F.lit("gate").alias("reason")), as_of, "o_orderkey").select("o_orderkey", "blocked_reason")


@query("""select o_orderkey from orders where o_orderdate >= (select max(o_orderdate) from orders) - interval 30 days""")
def retention(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return store.retain(o, "o_orderdate", now(o, "o_orderdate"), 30).select("o_orderkey")


@query(f"""with l as (select event_id, {_TITLE} t from events), u as (select t, count(*) c from l group by t)
 select md5('https://lead.local/' || left(md5(t), 8) || ':' || t) as id, t as title, case when {sql_any('lower(t)', ['cfo', 'chief financial'])} then 'cfo_hire' when {sql_any('lower(t)', ['acqui', 'merger', 'buyout'])} then 'merger_acquisition'
 when {sql_any('lower(t)', ['funding', 'raises', 'series'])} then 'funding' when {sql_any('lower(t)', ['hire', 'appoint', 'named'])} then 'executive_hire' else 'other' end as event_type, 50.0::double as relevance_score from u""")
def import_leads(spark, sf_dir):
    e = headline_rows(spark, sf_dir)
    none = spark.createDataFrame([], "url_hash string")
    return store.import_leads(e.select("title"), none, now(e, "ts")).select("id", "title", "event_type", "relevance_score")


# ---------------------------------------------------------------- joins


@query("""select doc_id from documents where doc_id not in (select doc_id from labels where quality = 0) and source not in (select source from documents join labels using (doc_id) where toxic = 1 and quality = 0)""")
def disposition_anti_join(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.select(F.col("doc_id").alias("id"), F.col("source").alias("display_company"), F.array(F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.lit("target").alias("role"))).alias("companies_data"))
    noted = d.select("doc_id", "source").join(lab.where("toxic = 1 and quality = 0"), "doc_id").select(F.col("source").alias("company_key"))
    keys = noted.union(lab.where("quality = 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"))))
    return ranking.undecided(rows, keys).select(F.col("id").alias("doc_id"))


@query("""select o_orderkey, case when o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') then 'cfo_hire' when o_orderkey in (select l_orderkey from lineitem where l_quantity > 45) then 'executive_hire' else 'dropped' end as route from orders""")
def mark_join(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    adsh = lambda df, c: df.select(F.col(c).cast("string").alias("adsh"))
    filings = o.select(F.lit("7").alias("cik"), F.lit("ACME (1)").alias("display_name"), F.col("o_orderkey").cast("string").alias("adsh"), F.lit("8-K").alias("file_type"), F.lit("5.02").alias("item"), F.col("o_orderdate").alias("file_date"))
    filers = spark.createDataFrame([("7", "OH", "6021")], "cik string, state string, sic string")
    out = gates.filing_gate(filings, filers, adsh(li.where("l_returnflag = 'R'"), "l_orderkey"), adsh(li.where("l_returnflag = 'R' or l_quantity > 45"), "l_orderkey"), CFG)
    return out.select(F.col("adsh").cast("long").alias("o_orderkey"), F.when(F.col("drop_reason").isNotNull(), "dropped").otherwise(F.col("event_type")).alias("route"))


@query("""select r_name as place, s as title, s || ' jobs in ' || r_name as query from region, (select distinct c_mktsegment s from customer)""")
def cross_queries(spark, sf_dir):
    titles = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("title")).distinct()
    return lookups.search_space(titles, table(spark, sf_dir, "region").select(F.col("r_name").alias("place")))


@query("""with a as (select max(o_orderdate) m from orders), k as (select o_custkey, max(o_orderdate) d from orders group by 1) select c_custkey, coalesce(floor(epoch(m - d) / 86400) < 30, false) as cached from customer left join k on c_custkey = o_custkey, a""")
def cache_ttl_join(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    cache = o.groupBy(F.col("o_custkey").cast("string").alias("cache_key")).agg(F.max("o_orderdate").alias("cached_at")).withColumn("results_json", F.lit("[]"))
    hits, rest = lookups.from_cache(c.select(F.col("c_custkey").cast("string").alias("cache_key")), cache, now(o, "o_orderdate"))
    out = hits.select("cache_key", F.lit(True).alias("cached")).union(rest.select("cache_key", F.lit(False)))
    return out.select(F.col("cache_key").cast("long").alias("c_custkey"), "cached")


@query("""select c_custkey, case when c_custkey % 2 = 0 then 'a' || c_custkey when c_custkey % 3 = 0 then 'b' || c_custkey end as info from customer""")
def provider_fallback(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    info = lambda n, p: c.where(f"c_custkey % {n} = 0").select("c_custkey", F.concat(F.lit(p), F.col("c_custkey").cast("string")).alias("info"))
    return lookups.with_fallback(c.select("c_custkey"), info(2, "a"), info(3, "b"), "c_custkey")


# ---------------------------------------------------------------- queues and rankings


@query("""with g as (select *, case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 when '4-NOT SPECIFIED' then 3 else 4 end gr, floor(o_totalprice / 1000)::bigint sc from orders),
 r as (select *, row_number() over (partition by o_custkey order by gr, sc desc, o_orderdate, o_orderkey) n, count(*) over (partition by o_custkey) - 1 others from g)
 select o_orderkey, o_custkey::varchar as company_key, gr as grade_rank, sc as score, strftime(o_orderdate, '%Y-%m-%d') as found, others from r where n = 1 order by gr, sc desc, o_orderdate, o_orderkey limit 10""")
def work_queue(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    grade = F.when(p == "1-URGENT", "A").when(p == "2-HIGH", "B").when(p == "3-MEDIUM", "").when(p == "4-NOT SPECIFIED", "C").otherwise("D")
    rows = o.select("o_orderkey", F.col("o_custkey").cast("string").alias("company"), grade.alias("grade"), F.floor(F.col("o_totalprice") / 1000).alias("score"), "o_orderdate")
    q = ranking.work_queue(rows, "company", "grade", "score", "o_orderdate", "o_orderkey", 10)
    return q.select("o_orderkey", "company_key", "grade_rank", "score", F.date_format("o_orderdate", "yyyy-MM-dd").alias("found"), "others")


@query("""select event_id, event_type, n as rank from (select *, row_number() over (partition by event_type order by value desc, event_id) n from events) where n <= 3""")
def topn_per_group(spark, sf_dir):
    top = ranking.top_per_group(table(spark, sf_dir, "events"), "event_type", [F.desc("value"), F.col("event_id")], 3)
    return top.select("event_id", "event_type", F.col("rank").cast("long").alias("rank"))


@query("""select event_id, (json_extract_string(props, '$.k')::int % 10 = 3 or event_type = 'signup') as leader from events""")
def finance_mask(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tags = F.when(F.get_json_object("props", "$.k").cast("int") % 10 == 3, F.array(F.lit("#NewController"))).otherwise(F.array().cast("array<string>"))
    return e.select("event_id", ranking.finance_leader(F.when(F.col("event_type") == "signup", "cfo_hire").otherwise("other"), tags).alias("leader"))


@query("""select event_id, json_extract_string(props, '$.k')::bigint as k from events""")
def json_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.select("event_id", F.from_json(F.to_json("p"), "k bigint")["k"].alias("k"))


@query("""select conv_id, turn from (select *, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) s, row_number() over (partition by conv_id order by turn) n from conversations) where s <= 1000 and n <= 8""")
def note_budget(spark, sf_dir):
    return ranking.note_budget(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text")).select("conv_id", "turn")


@query("""select o_orderkey from orders where o_orderstatus <> 'F' and o_orderkey % 3 <> 0 order by o_orderdate, o_orderkey limit 100""")
def enrichment_queue(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("discovered_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("blocked_at"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("enriched_at"))
    return ranking.enrichment_queue(rows, limit=100).select(F.col("id").alias("o_orderkey"))


@query(f"""select event_type, count(*) as n from (select coalesce({_TYPE}, 'other') as event_type from events) group by 1""")
def alert_groups(spark, sf_dir):
    e = headline_rows(spark, sf_dir).select(F.col("event_id").alias("id"), "title", F.coalesce(T.detect_type(F.col("title"), CFG), F.lit("other")).alias("event_type"), F.col("value").alias("relevance_score"), F.lit("u").alias("url"))
    return ranking.slack_blocks(e).select("event_type", F.get_json_object("block", "$.n").cast("long").alias("n"))


# ---------------------------------------------------------------- sets, files, streams


@query("""select 'union' as op, count(*) as n from (select n_regionkey k from nation union select r_regionkey from region) union all
 select 'intersect', count(*) from (select c_nationkey from customer intersect select s_nationkey from supplier) union all
 select 'except', count(*) from (select c_custkey from customer except select o_custkey from orders) union all
 select 'overlap', count(*) from (select l_orderkey from lineitem group by 1 having bool_or(l_returnflag = 'R') and bool_or(l_returnflag = 'A'))""")
def set_ops(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    both = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f")).where(F.size(F.array_except(V.words(["R", "A"]), F.col("f"))) == 0)
    parts = {
        "union": t("nation").select("n_regionkey").union(t("region").select("r_regionkey")).distinct(),
        "intersect": t("customer").select("c_nationkey").intersect(t("supplier").select("s_nationkey")),
        "except": t("customer").select("c_custkey").subtract(t("orders").select("o_custkey")),
        "overlap": both,
    }
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.union(row)
    return out


@query("select n_nationkey, n_name, n_regionkey from nation")
def csv_roundtrip(spark, sf_dir):
    import uuid

    from ..sources.readers import read_sheet, write_sheet

    path = f"{store.shared_dir(spark)}/csv/{uuid.uuid4().hex}"
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    write_sheet(n, path)
    back = read_sheet(spark, path, n.columns)
    return back.select(*[F.col(c).cast(t).alias(c) for c, t in n.dtypes])


def stream_of(spark, sf_dir) -> DataFrame:
    """The events table as a stream of files (a shared copy: the source takes
    folders)."""
    import uuid

    folder = f"{store.shared_dir(spark)}/stream/{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(folder)
    return spark.readStream.schema(e.schema).parquet(folder)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what there is; its output as a table."""
    import uuid

    base = f"{store.shared_dir(stream.sparkSession)}/stream/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("append").parquet(f"{base}/out")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


@query("""select event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as n from events group by 1, 2""")
def stream_counts(spark, sf_dir):
    counts = stateful.windowed_counts(stream_of(spark, sf_dir), "ts", "1 day", "1 day", ("event_type",))
    return drained(counts, "complete").select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


@query("select count(*) as n from (select distinct user_id, event_type from events)")
def stream_dedup(spark, sf_dir):
    return drained(stateful.first_by_key(stream_of(spark, sf_dir), "ts", "60 days", ["user_id", "event_type"]), "append").agg(F.count("*").alias("n"))


@query("""with e as (select *, lag(ts) over (partition by user_id order by ts, event_id) p from events), s as (select user_id, ts, sum(case when p is null or ts - p >= interval 6 hours then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) g from e)
 select user_id, count(*) as n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start from s group by user_id, g""")
def session_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stateful.sessions(e, "ts", "1 day", "6 hours", "user_id").select("user_id", "n", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"))


def attempts(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return e.select("user_id", "event_id", seconds.alias("seconds"), (F.col("event_type") != "error").alias("ok"), (F.col("event_type") != "error").alias("got"), F.when(F.col("value") > 20, 429).otherwise(404).alias("code"), F.lit(1).alias("events"))


@query()
def limiter_replay(spark, sf_dir):
    """The rate limiter as a state machine, over all attempts of each source."""
    return stateful.replay(attempts(spark, sf_dir), "limiter", "user_id", ["seconds", "event_id"]).select("user_id", "event_id", "decision", F.round("wait", 3).alias("wait"), "backoff")


@query()
def breaker_replay(spark, sf_dir):
    return stateful.replay(attempts(spark, sf_dir), "breaker", "user_id", ["seconds", "event_id"]).select("user_id", "event_id", "decision", "streak")


@query("""with e as (select user_id, event_id, ts, event_type <> 'error' ok, count(*) filter (event_type <> 'error') over (partition by user_id order by ts, event_id) g from events)
 select user_id, event_id, count(*) over w as total, count(*) filter (ok) over w as good, count(*) filter (not ok) over (partition by user_id, g order by ts, event_id rows unbounded preceding) as streak from e window w as (partition by user_id order by ts, event_id rows unbounded preceding)""")
def health_replay(spark, sf_dir):
    """The health of every source after each check, by running sums; the
    stream's state machine says the same (tests)."""
    rows = attempts(spark, sf_dir).withColumn("at", F.timestamp_micros((F.col("seconds") * 1_000_000).cast("long")))
    return health.running(rows, "user_id", "at", "event_id", "ok", "events").select("user_id", "event_id", "total", "good", "streak")
