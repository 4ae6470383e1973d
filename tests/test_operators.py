"""Operators on small tables: duplicates, stores, health, queues, gates."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewell.config import Config
from tidewell.operators import dedup, gates, graph, health, lookups, ranking, store
from tidewell.plans import pipelines
from tidewell.sources import providers, readers

NOW = dt.datetime(2026, 2, 10, 12)
def as_of():
    return F.lit(NOW)

CFG = Config.of({
    "territory": {"regions": ["Ohio", "virginia"], "cities": ["Boston", "arlington"], "industries": ["bank"], "excluded_industries": ["mining"], "excluded_locations": ["london"], "target_companies": ["Theta Bank"], "company_filters": {"excluded_public_companies": ["apple"], "public_company_indicators": ["nyse:"]}},
    "keywords": {"executive_hires": ["cfo", "controller"], "mergers_acquisitions": ["acquires"], "funding_events": ["raises"]},
    "scraper": {"max_age_hours": 72},
})


def greedy(rows):
    urls, titles, out = set(), set(), []
    for i, u, t in rows:
        key = (t or "").strip().lower()
        templated = key.startswith("sec 8-k") or " hiring: " in key
        if u in urls or key and not templated and key in titles:
            continue
        urls.add(u)
        if key and not templated:
            titles.add(key)
        out.append(i)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    titles = [f"T{i}" for i in range(12)] + ["", "SEC 8-K x", "A hiring: CFO", None]
    rows = [(i, f"u{rng.randrange(15)}", rng.choice(titles)) for i in range(60)]
    if seed == 1:
        rows = [(0, "A", "T1"), (1, "B", "T1"), (2, "B", "T3")]
    df = spark.createDataFrame(rows, "arrival_seq long, url string, title string")
    assert sorted(r.arrival_seq for r in dedup.greedy(df).collect()) == greedy(rows)


@pytest.mark.parametrize("kind", ["chain", "star", "one component"])
def test_greedy_over_one_component(spark, kind):
    """A chain in which each row waits for the one before it; one url or title
    of all rows; all rows in one component."""
    rng = random.Random(5)
    if kind == "chain":
        rows = [(i, f"u{(i + 1) // 2}", f"T{i // 2}") for i in range(12)]
    elif kind == "star":
        rows = [(i, "same" if i % 2 else f"u{i}", "Same" if i % 3 else f"T{i}") for i in range(300)]
    else:
        rows = [(i, f"u{rng.randrange(40)}", f"T{rng.randrange(200)}") for i in range(300)]
    df = spark.createDataFrame(rows, "arrival_seq long, url string, title string")
    out = dedup.greedy(df)
    assert sorted(r.arrival_seq for r in out.collect()) == greedy(rows)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (3, 9)], "a long, b long")
    assert {r.node: r.component for r in graph.components(links).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7}


def test_titles(spark):
    rows = [("1", "Same", None, "B", 3), ("2", "same ", "x", None, 2), ("3", "SEC 8-K a", None, None, 1), ("4", "SEC 8-K a", None, None, 1), ("5", "", None, None, 1)]
    df = spark.createDataFrame(rows, "id string, title string, c string, grade string, discovered_at int")
    got = {r.id: r.keep_rank for r in dedup.title_groups(df, companies=F.col("c").isNotNull(), graded=F.col("grade").isNotNull()).collect()}
    assert got == {"1": 2, "2": 1, "3": 1, "4": 1, "5": 1}


def test_stores(spark, tmp_path):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    b = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(store.merge_on(a, b, "id")) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(store.keyed_union(a, b, "id")) == [(1, "a"), (2, "b"), (3, "C")]
    t = store.Table(spark, f"{tmp_path}/t")
    assert not t.exists()
    t.merge(a, "id")
    t.merge(b, "id")
    t.merge(b, "id")
    assert rows(t.read().select("id", "v")) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(store.write_enrichment(a.withColumn("grade", F.lit("C")), b.select("id", F.lit(None).cast("string").alias("grade")))) == [(1, "a", "C"), (2, "b", "C")]
    assert store.add_columns(a, {"x": "int", "v": "int"}).columns == ["id", "v", "x"]


def test_sync_policy(spark):
    scraped = spark.createDataFrame([(1, "t", "n", "d" * 3000), (2, "t", "n", "d"), (3, "t", "n", None)], "id int, title string, notes string, description string")
    hosted = spark.createDataFrame([(1, "REVIEWED", "mine", "A"), (2, "new", "", "B")], "id int, lead_status string, notes string, grade string")
    got = {r.id: r for r in store.keep_state(scraped, hosted).collect()}
    assert (got[1].lead_status, got[1].notes, got[1].grade, len(got[1].description)) == ("REVIEWED", "mine", "A", 2000)
    assert (got[2].lead_status, got[2].notes) == ("NEW", "n") and (got[3].lead_status, got[3].grade, got[3].description) == ("NEW", None, "")


def test_tombstones_and_status(spark):
    t = spark.createDataFrame([(1, None, None, None, None), (2, NOW, "old", None, None)], "id int, blocked_at timestamp, blocked_reason string, lead_status string, notes string")
    ids = spark.createDataFrame([(1, "gate"), (2, "gate")], "id int, reason string")
    got = {r.id: r for r in store.tombstone(t, ids, as_of()).collect()}
    assert got[1].blocked_reason == "gate" and got[2].blocked_reason == "old" and got[2].blocked_at == NOW
    changes = spark.createDataFrame([(1, "NOT RELEVANT", "no")], "id int, status string, notes string")
    r = store.set_status(t, changes, as_of()).where("id = 1").first()
    assert (r.lead_status, r.notes) == ("NOT RELEVANT", "no") and r.blocked_at is not None
    d = spark.createDataFrame([("acme", "Acme", "Picked Up", NOW)], "company_key string, company_name string, status string, updated_at timestamp")
    new = spark.createDataFrame([("Acme Inc", "—"), ("Beta LLC", "Not a Fit")], "company_name string, status string")
    assert [r.company_key for r in store.set_dispositions(d, new, as_of()).collect()] == ["beta"]


def test_health(spark):
    rows = [(i, "a", i, True, 100.0 * i, 2, None) for i in range(1, 6)] + [(10 + i, "b", i, False, 0.0, 0, "Connection timeout") for i in range(5)] + [(20, "c", 1, True, 5.0, 1, None)]
    df = spark.createDataFrame(rows, "check_id int, source_name string, check_ts int, success boolean, response_time_ms double, events_found int, error_message string")
    states = {r.source_name: r for r in health.health(df).collect()}
    assert [states[s].status for s in "abc"] == ["healthy", "unhealthy", "unknown"]
    assert (states["a"].avg_response_time_ms, states["a"].consecutive_successes, states["b"].consecutive_failures) == (300.0, 5, 5)
    one = health.summary(health.health(df)).first()
    assert (one.total, one.healthy, one.unhealthy, one.unknown, one.total_events) == (3, 1, 1, 1, 11)
    assert health.error_counts(df).first().error_counts == {"timeout": 5}
    assert health.summary(health.health(df.limit(0))).first().overall_success_rate == 0.0


def test_checks(spark):
    s = spark.createDataFrame([("a", "success", 3, NOW - dt.timedelta(hours=7)), ("b", "success", 1, NOW - dt.timedelta(hours=9))], "source_name string, status string, events_found int, last_check timestamp")
    e = spark.createDataFrame([(i, NOW - dt.timedelta(days=i), None, None) for i in range(13)], "id int, discovered_at timestamp, enriched_at timestamp, blocked_at timestamp")
    assert health.check_sources(s).first().verdict == "PASS"
    assert health.check_freshness(s, e, as_of()).first().verdict == "WARN"
    assert health.check_volume(e, "discovered_at", as_of()).first().verdict == "WARN"
    assert health.check_lag(e, as_of()).first().verdict == "FAIL"
    assert health.check_that("gaps", e, F.col("enriched_at").isNull(), 20, 5).first().verdict == "WARN"
    tries = spark.createDataFrame([("a", 1.0, True, None), ("a", 2.0, False, 429), ("a", 3.0, False, 404)], "source string, seconds double, ok boolean, code int")
    stats = health.limiter_stats(tries).first()
    assert (stats.total_requests, stats.total_failures, stats.backoffs, stats.last_code) == (3, 2, 1, 404)
    assert health.table_status(e, "discovered_at").first().newest == NOW
    assert health.overall(health.check_sources(s).union(health.check_lag(e, as_of()))).first().overall == "FAIL"


def test_cache(spark):
    e = spark.createDataFrame([("a", "vv", NOW - dt.timedelta(seconds=5), 10.0), ("b", "v", NOW - dt.timedelta(seconds=50), 10.0)], "key string, value string, created_at timestamp, ttl double")
    assert [r.key for r in lookups.live(e, as_of()).collect()] == ["a"]
    hits = spark.createDataFrame([(True,), (True,), (False,)], "hit boolean")
    r = lookups.cache_stats(e, hits, as_of()).first()
    assert (r.entries, r.expired, r.bytes, round(r.hit_rate, 6)) == (2, 1, 3, 0.666667)


FEED = """<?xml version="1.0"?><rss version="2.0"><channel><title>F</title>
<item><title>ARLINGTON, Va., Feb. 10 Beta names new CFO</title><link>https://x.org/1</link><description><![CDATA[<p>Beta &amp; Co. of Arlington</p>]]></description><pubDate>Tue, 10 Feb 2026 09:00:00 GMT</pubDate></item>
<item><title>Mining firm named CFO</title><link>https://x.org/2</link><description>d</description></item>
<item><title>Old: Gamma named CFO in Ohio</title><link>https://x.org/3</link><pubDate>Tue, 03 Feb 2026 09:00:00 GMT</pubDate></item>
<item><title>Delta named CFO in Ohio</title><link>https://x.org/4</link><media:content url="u"/></item>
<item><title>Delta named CFO in Ohio</title><link>https://x.org/5</link></item>
<item><title>Apple appointed CFO in Ohio</title><link>https://x.org/6</link></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Theta Bank news</title><link href="https://a.org/1"/><summary>Boston</summary><updated>2026-02-10T08:00:00Z</updated></entry></feed>'


def test_scrape_cycle(spark):
    payloads = spark.createDataFrame([("PR Newswire", FEED), ("Atom", ATOM), ("Down", None), ("Empty", "<rss></rss>")], "feed_name string, payload string")
    assert {r.feed_name: (r.status, r.item_count) for r in readers.feed_statuses(payloads).collect()} == {"PR Newswire": ("ok", 6), "Atom": ("ok", 1), "Down": ("error", 0), "Empty": ("warning", 0)}
    seen = spark.createDataFrame([], "url_hash string")
    events = spark.createDataFrame([], "title string, discovered_date timestamp")
    got = {r.url: r for r in pipelines.scrape_cycle(payloads, seen, events, CFG, as_of()).collect()}
    assert set(got) == {"https://x.org/1", "https://x.org/4", "https://a.org/1"}
    a = got["https://x.org/1"]
    assert (a.event_type, a.relevance_score, a.matched_regions, a.published_date) == ("cfo_hire", 100.0, ["arlington", "virginia"], dt.datetime(2026, 2, 10, 9))
    assert got["https://a.org/1"].event_type == "stable_target" and got["https://a.org/1"].company_name == "theta bank"


def test_filings(spark):
    hits = '{"hits": {"hits": [{"_source": {"ciks": ["7"], "display_names": ["ACME CORP  (0007) (Filer)"], "adsh": "1-2-3", "file_type": "8-K", "file_date": "2026-02-09"}}, {"_source": {"ciks": ["8"], "display_names": ["FAR CO (8)"], "adsh": "9-9-9", "file_type": "8-K"}}]}}'
    filings = readers.filing_hits(spark.createDataFrame([("5.02", hits)], "item string, payload string"))
    filers = spark.createDataFrame([("7", "OH", "6021"), ("8", "CA", "1000")], "cik string, state string, sic string")
    none = spark.createDataFrame([], "adsh string")
    cfo = spark.createDataFrame([("1-2-3",)], "adsh string")
    got = {r.adsh: r for r in gates.filing_gate(filings, filers, cfo, cfo, CFG).collect()}
    assert (got["1-2-3"].event_type, got["1-2-3"].company_name, got["1-2-3"].drop_reason) == ("cfo_hire", "ACME CORP", None)
    assert got["1-2-3"].url.endswith("/7/123/1-2-3-index.htm") and got["9-9-9"].drop_reason == "out_of_territory"
    open_ = {r.adsh: r for r in gates.filing_gate(filings, filers, none, none, CFG).collect()}
    assert (open_["1-2-3"].event_type, open_["1-2-3"].drop_reason) == ("executive_hire", None)
    other = spark.createDataFrame([("0",)], "adsh string")
    assert {r.adsh: r.drop_reason for r in gates.filing_gate(filings, filers, none, other, CFG).collect()}["1-2-3"] == "no_finance_leader"


def test_offerings(spark):
    xml = "<totalOfferingAmount>2500000</totalOfferingAmount><industryGroupType>Other</industryGroupType>"
    rows = [("1", "Acme Co (1)", "a", "D", None, ["OH"], "2026-02-01", xml), ("2", "Big Fund LP (2)", "b", "D", None, ["OH"], "2026-02-02", ""), ("3", "X (3)", "c", "D/A", None, ["OH"], "2026-02-03", ""), ("4", "Y (4)", "d", "D", ["3C"], ["OH"], "2026-02-03", ""), ("5", "Z (5)", "e", "D", None, ["CA"], "2026-02-03", "")]
    df = spark.createDataFrame(rows, "cik string, display_name string, adsh string, file_type string, items array<string>, biz_states array<string>, file_date string, detail_xml string")
    filers = spark.createDataFrame([("1", "6021")], "cik string, sic string")
    got = {r.adsh: r for r in gates.offering_gate(df, filers, CFG).collect()}
    assert {k: r.outcome for k, r in got.items()} == {"a": "keep", "b": "fund", "c": "drop", "d": "fund", "e": "drop"}
    assert "Total offering: $2,500,000." in got["a"].description


def test_jobs(spark):
    payload = '{"results": [{"title": "CFO", "company": {"display_name": "Acme"}, "location": {"area": ["US", "Ohio"]}, "redirect_url": "u", "created": "2026-02-09T00:00:00Z"}, {"title": "Document Controller", "company": {"display_name": "B"}, "location": {"area": ["US", "Ohio"]}, "redirect_url": "u"}, {"title": "Controller", "company": {"display_name": "Robert Half"}, "location": {"area": ["US", "Ohio"]}, "redirect_url": "u"}, {"title": "CFO", "location": {"area": ["US"]}}]}'
    jobs = readers.job_results(spark.createDataFrame([("us", payload)], "country string, payload string"))
    assert [r.drop_reason for r in gates.job_gate(jobs, CFG, ["Ohio"]).collect()] == [None, "not_finance", "recruiter", "out_of_territory"]
    board = spark.createDataFrame([("CFO - Acme - Columbus", "a bank in Ohio"), ("Cook", "x")], "title string, description string")
    got = gates.board_gate(board, CFG, "ladders").collect()
    assert (got[0].drop_reason, got[0].company_name, got[0].relevance_score) == (None, "Acme", 85.0) and got[1].drop_reason == "other_title"
    asks = spark.createDataFrame([("us", ["a", "b"]), ("ca", ["a", "b"])], "country string, titles array<string>")
    assert readers.job_schedule(asks, as_of(), [12]).count() == 3 and readers.job_schedule(asks, as_of(), [3]).count() == 0


def test_leads(spark, tmp_path):
    (tmp_path / "l.ndjson").write_text('{"title": "A names CFO", "url": "u1"}\nbroken\n{"title": "B raises $5M"}\n{"url": "no title"}\n')
    leads = readers.read_leads(spark, str(tmp_path / "l.ndjson"), lines=True)
    seen = spark.createDataFrame([("u9",)], "url string").select(F.md5("url").alias("url_hash"))
    got = {r.title: r for r in store.import_leads(leads, seen, as_of()).collect()}
    assert {t: r.event_type for t, r in got.items()} == {"A names CFO": "cfo_hire", "B raises $5M": "funding"}
    assert got["B raises $5M"].url.startswith("https://lead.local/") and got["A names CFO"].relevance_score == 50.0
    text = spark.createDataFrame([('junk {"title": "C"} and {bad} {"title": "D"}',)], "text string")
    assert [r.title for r in readers.leads_of(text).collect()] == ["C", "D"]


def test_enrichment_and_view(spark):
    company = "name string, role string, industry string, hq string, revenue string, zi_subindustry string".replace(" string", ": string")
    ok = [("Acme", "target", "Banking", "Boston, MA", "MM", "Banking")]
    out = [("Far", "target", "x", "Austin, TX", "MM", "Banking")]
    rows = [(1, "Acme names CFO", ok, ["#NewCFO", "#Funding"], "High"), (2, "Far names CFO", out, ["#NewCFO"], "High"), (3, "X joins the board", ok, [], "Low")]
    df = spark.createDataFrame(rows, f"id int, title string, companies_data array<struct<{company}>>, hashtags array<string>, confidence_level string")
    df = df.withColumns({"event_type": F.lit("executive_hire"), "description": F.lit(""), "grade_justification": F.lit("why"), "blocked_at": F.lit(None).cast("timestamp"), "blocked_reason": F.lit(None).cast("string"), "company_name": F.lit(None).cast("string"), "lead_status": F.lit("NEW"), "discovered_at": as_of(), "matched_regions": F.array().cast("array<string>")})
    done = pipelines.enrich(df, as_of(), CFG)
    got = {r.id: r for r in done.collect()}
    assert (got[1].grade, got[1].numeric_score, got[1].blocked_reason, got[1].search_tier) == ("A", 8, None, 1)
    assert got[2].blocked_reason.startswith("fit_gate: ") and got[3].blocked_reason == "board_change_only"
    none = spark.createDataFrame([], "company_key string")
    assert [r.id for r in pipelines.analyst_view(done, none, as_of()).collect()] == [1]
    decided = spark.createDataFrame([("acme",)], "company_key string")
    assert pipelines.analyst_view(done, decided, as_of()).count() == 0
    assert {r.id: r.drop_reason for r in pipelines.cleanup(done.withColumn("title", F.when(F.col("id") == 2, "mining co").otherwise("same")), CFG).collect()} == {2: 'excluded_industry: "mining"', 3: "duplicate_title"}


def test_alerts(spark):
    rows = [(i, f"t{i}", "funding" if i % 2 else "cfo_hire", "Acme", NOW, float(i), "u", "d") for i in range(9)]
    df = spark.createDataFrame(rows, "id int, title string, event_type string, company_name string, published_date timestamp, relevance_score double, url string, description string")
    got = ranking.batch_alerts(df).collect()
    assert [r.event_type for r in got] == ["cfo_hire", "funding"] and got[0].n == 5 and got[0].body.startswith("[CFO_HIRE] t8")
    assert '"n":4' in ranking.slack_blocks(df).where("event_type = 'funding'").first().block
    assert ranking.run_summary(df, as_of()).first().id == 8
    assert ranking.desktop_text(df).first().text == "5 CFO hires, 4 fundings"
    mail = ranking.html_mail(df, as_of()).where("event_type = 'funding'").first()
    assert mail.n == 4 and mail.html.startswith('<ul><li><a href="u">t1</a>')


def test_providers(spark):
    urls = spark.createDataFrame([("https://a.org/1",), ("https://b.org/1",)], "url string")

    def get(url):
        if "b.org" in url:
            raise OSError("down")
        return 200, "body"

    assert {r.url: (r.status_code, r.error) for r in providers.fetch(urls, get, 2).collect()} == {"https://a.org/1": (200, None), "https://b.org/1": (None, "down")}
    prompts = spark.createDataFrame([(1, "p")], "id int, prompt string")
    assert providers.ask(prompts, [lambda p: "no json", lambda p: 'x {"a": 1} y']).first().answer == '{"a": 1}'
    keys = spark.createDataFrame([("k1", "q1", 1), ("k2", "q2", 2), ("k3", "q3", 3), ("k4", "q4", 1)], "cache_key string, query string, tier int")
    cache = spark.createDataFrame([("k4", '["c"]', NOW)], "cache_key string, results_json string, cached_at timestamp")
    got = {r.cache_key: r.backend for r in providers.search_ladder(keys, cache, lambda q: "[]", lambda q: '["p"]', as_of()).collect()}
    assert got == {"k1": "paid", "k2": "none", "k3": "none", "k4": "cache"}


def _files(path):
    import os

    return {os.path.relpath(os.path.join(d, f), path): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_buckets(spark, tmp_path):
    """Merges rewrite what they touch; versions, appends, compaction, lookups
    and two writers."""
    rng = random.Random(9)
    path = f"{tmp_path}/t"
    own = store.Buckets(spark, f"file://{path}", "id", 8)
    frame = lambda rows: spark.createDataFrame(rows, "id long, v string")
    held = {i: f"a{i}" for i in range(300)}
    assert own.version() == 0 and own.delete(frame([(1, "x")])) == []
    own.merge(frame(list(held.items())))
    before = _files(path)
    touched = own.merge(frame([(3, "new"), (1000, "added")]))
    held |= {3: "new", 1000: "added"}
    assert len(touched) <= 2 and before.items() <= _files(path).items()
    folders, old = own.folders(), own.folders(1)
    assert all(folders[b] == old[b] for b in folders if b not in touched)
    assert own.delete(frame([(5, "x")])) and held.pop(5)
    own.insert_absent(frame([(3, "kept out"), (2000, "in"), (2000, "twice")]))
    assert own.read().where("id = 2000").count() == 1
    held[2000] = own.read().where("id = 2000").first().v
    own.append(frame([(i, "late") for i in range(5000, 5040)]))
    held |= {i: "late" for i in range(5000, 5040)}
    got = lambda t: {r.id: r.v for r in t.collect()}
    assert got(own.read()) == held and own.read().count() == len(held)
    assert max(map(len, own.folders().values())) == 2
    assert own.compact() and max(map(len, own.folders().values())) == 1 and own.compact() == []
    assert got(own.read()) == held and got(own.read(1)) == {i: f"a{i}" for i in range(300)}
    assert got(own.lookup([3, 5, 5001])) == {3: "new", 5001: "late"}
    own.compact(keep=F.col("id") < 5000)
    held = {i: v for i, v in held.items() if i < 5000}
    other = store.Buckets(spark, f"file://{path}", "id")
    assert other.buckets == 8 and got(other.read()) == held
    stale = other.version()
    own.merge(frame([(7, "first")]))
    other.version = lambda: stale
    with pytest.raises(RuntimeError):
        other.merge(frame([(7, "second")]))
    own.vacuum(1)
    assert own.read().where("id = 7").first().v == "first" and own._versions() == [own.version()]
    assert own.read().count() == len(held) and len(_files(path)) == sum(map(len, own.folders().values()))
