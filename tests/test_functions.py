"""Golden rows for text, date and scoring expressions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell.config import Config
from tidewell.functions import dates as D
from tidewell.functions import scoring as S
from tidewell.functions import text as T

CFG = Config.of({
    "territory": {
        "regions": ["New York", "Virginia"], "cities": ["Boston", "Arlington"], "industries": ["nonprofit", "financial services"], "excluded_industries": ["oil"],
        "company_filters": {"exclude_public_companies": True, "public_company_indicators": ["NYSE:", "publicly traded"], "excluded_public_companies": ["Apple", "Microsoft"]},
    },
    "keywords": {"executive_hires": ["cfo", "chief financial officer", "vice president"], "mergers_acquisitions": ["acquisition of", "acquires"], "funding_events": ["raises"]},
})


def values(spark, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_event_types(spark):
    rows = ["Company names new CFO to team", "John was appointed Chief Financial Officer", "X announces acquisition of Y", "Startup raises $50M in Series A funding", "CFO comments on weather", "", None]
    assert values(spark, rows, lambda c: T.detect_type(c, CFG)) == ["cfo_hire", "cfo_hire", "merger_acquisition", "funding", None, None, None]


def test_site_event_types(spark):
    df = spark.createDataFrame([("Acme Raises $10M in Series B Funding",), ("Acme Completes Acquisition of Beta",), ("Acme news",)], "t string")
    assert [r[0] for r in df.select(T.detect_site_type(F.col("t"), F.col("t"), CFG)).collect()] == ["funding", "merger_acquisition", None]


def test_datelines(spark):
    rows = ["ARLINGTON, Va., Feb. 10, 2026 /PRNewswire/", "NEW YORK and BOSTON, Feb. 10", "NEW YORK and ARLINGTON, Va., Feb. 10", "CHICAGO, IL and RICHMOND, Va., Feb. 10", "CHARLOTTE, N.C., Mar. 3", "BOSTON, Mass., Feb. 1", "no dateline here"]
    got = values(spark, rows, T.datelines)
    assert [[(x.city, x.state) for x in r] for r in got] == [
        [("arlington", "virginia")], [("new york", None), ("boston", None)], [("new york", None), ("arlington", "virginia")],
        [("chicago", "illinois"), ("richmond", "virginia")], [("charlotte", "north carolina")], [], [],
    ]


def test_companies(spark):
    rows = [
        "Blink Grabs $17M Financing Round", "Nautic-backed Integrated Home Care Services scoops up Dina Care", "MikeWorldWide Appoints Dave Aglar as CIO", "Acme Corp Announces results",
        "Deals & Moves: Beacon Pointe Acquires X", "White Cap to acquire Y", "10 Press Releases you missed", "Québec Capital raises $5M", "", None, "nothing here at all",
    ]
    assert values(spark, rows, T.company_name) == ["Blink", "Integrated Home Care Services", "MikeWorldWide", "Acme Corp", "Beacon Pointe", "White Cap", None, "Québec Capital", None, None, None]


def test_people(spark):
    rows = ["Acme named Jane Doe as CFO", "Jane Doe named Chief Financial Officer"]
    assert values(spark, rows, T.person_name) == ["Jane Doe", "Jane Doe"]
    assert values(spark, rows, T.person_title) == ["CFO", "Chief Financial Officer"]


def test_job_companies(spark):
    assert values(spark, ["CFO - Acme - Boston", "CFO at Beta Group", "Gamma hires controller", "CFO"], T.job_company) == ["Acme", "Beta Group", "Gamma", None]


def test_amounts(spark):
    rows = ["raises $6.8 Million and $37M", "a $1.2B deal", "$2,500,000 offering", "$500K", "no money", None]
    assert values(spark, rows, T.largest_amount) == [37e6, 1.2e9, 2.5e6, 5e5, None, None]
    assert values(spark, ["takes $5.2 Million now", "a $10M round", "none"], T.first_amount) == ["$5.2 Million", "$10M", None]


def test_bands(spark):
    rows = ["MM", "$10M-50M", "$27.9B", "$50M", "18M", "900K", "junk", None]
    assert values(spark, rows, T.revenue_band) == ["MM", "MM", "Enterprise", "Corp", "MM", "LMM", "", ""]
    assert values(spark, ["LMM", "Enterprise", "x"], T.band_index) == [0, 3, -1]
    assert values(spark, ["$1.5B", "$10M - $50M", "5,000,000", "12", None], lambda c: T.revenue_millions(c, F.lit(None).cast("string"))) == [1500.0, 10.0, 5.0, 12.0, None]


def test_keys(spark):
    assert values(spark, [" Acme, Inc. ", "Acme Inc", "Acme LLC", "ACME Co.", None], T.account_key) == ["acme", "acme", "acme", "acme", ""]
    assert values(spark, ["SEC 8-K Item 5.02 x", "Acme hiring: CFO", "News", None], T.is_templated) == [True, True, False, False]
    assert values(spark, ["https://example.com/feed.xml", "https://api.example.com:8080/v1/data", "bad", None], T.authority) == ["example.com", "api.example.com:8080", "", ""]
    assert values(spark, ["https://www.sec.gov/x", "https://adzuna.com/y", "https://www.news.org/a", None], T.source_label) == ["SEC EDGAR", "Adzuna", "news.org", "other"]


def test_cleaning(spark):
    assert values(spark, ["<p>A &amp; B&nbsp;</p>\n c", None], T.strip_html) == ["A & B c", ""]
    title = values(spark, ["One - Two - Site", "Plain"], lambda c: T.split_source(c)[0])
    source = values(spark, ["One - Two - Site", "Plain"], lambda c: T.split_source(c)[1])
    assert (title, source) == (["One - Two", "Plain"], ["Site", None])
    assert values(spark, ["Business Wire", "GlobeNewswire Canada", "X"], T.feed_source) == ["business_wire", "globe_newswire", "other"]
    assert values(spark, ['```json\n{"a": {"b": 1}}\n``` done', "none"], T.json_object) == ['{"a": {"b": 1}}', None]
    assert values(spark, ["#NewCFO text #Funding"], T.hashtags_of) == [["#NewCFO", "#Funding"]]
    assert values(spark, ["high", "odd", None], T.confidence) == ["High", "Low", "Low"]


def test_feed_repair(spark):
    raw = '<rss version="2.0"><item><media:content/><odd:x/></item></rss>'
    fixed = values(spark, [raw, "<rss><a/></rss>", "none"], T.repair_feed)
    assert fixed[0].startswith('<rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:odd="urn:ns:odd"><item>')
    assert fixed[1:] == ["<rss><a/></rss>", "none"]


def test_snippets(spark):
    df = spark.createDataFrame([(["x", "is located in 850 X Pkwy Ste 200, Birmingham, Alabama, 35209 and has 1,178 employees", "located in Boston, Massachusetts"],)], "s array<string>")
    r = df.select(T.hq_and_size(F.col("s")).alias("r")).first().r
    assert (r.hq, r.size) == ("Birmingham, AL", "1178")


def test_dates(spark):
    now = dt.datetime(2026, 2, 10, 12)
    rows = ["Tue, 10 Feb 2026 09:30:00 GMT", "2026-02-09T10:00:00Z", "Mon, 2 Feb 2026 01:00:00 +0100", "junk"]
    got = values(spark, rows, lambda c: F.date_format(D.parse_date(c, as_of=F.lit(now)), "yyyy-MM-dd HH:mm"))
    assert got == ["2026-02-10 09:30", "2026-02-09 10:00", "2026-02-02 00:00", "2026-02-10 12:00"]
    ages = values(spark, ["2026-02-10 11:55:00", "2026-02-10 09:00:00", "2026-02-01 12:00:00", None], lambda c: D.check_age_text(c.cast("timestamp"), F.lit(now)))
    assert ages == ["5m ago", "3h ago", "9d ago", "Never"]


@pytest.mark.parametrize("kind,regions,industry,company,want", [("cfo_hire", 1, True, False, 75), ("cfo_hire", 1, True, True, 100), (None, 5, False, False, 40), ("funding", 0, False, False, 25)])
def test_relevance(spark, kind, regions, industry, company, want):
    r = spark.range(1).select(S.relevance(F.lit(kind).cast("string"), F.lit(regions), F.lit(industry), F.lit(company))).first()[0]
    assert r == want


@pytest.mark.parametrize("tags,conf,want", [([], "High", (0, "D")), (["#NewCFO"], "High", (5, "B")), (["#NewCFO", "#Funding"], "Medium", (8, "A")), (["#NewCFO", "#Funding"], "Low", (8, "C")), (["#100EE", "#Global", "#Legacy", "#HoldCo"], "High", (8, "B")), (["#Global"], "High", (2, "C")), (["#Nope"], "High", (0, "D")), (["#NewCFO"], None, (5, "C"))])
def test_grades(spark, tags, conf, want):
    g = spark.range(1).select(S.grade(F.array(*map(F.lit, tags)).cast("array<string>"), F.lit(conf).cast("string")).alias("g")).first().g
    assert (g.score, g.grade) == want


def test_territory_of(spark):
    rows = ["Boston, MA", "Austin, TX", "Toronto, Ontario", "Québec", "Berlin, Germany", "Atlantis", "", None]
    assert values(spark, rows, S.territory_of) == ["in", "out", "in", "in", "out", "unknown", "unknown", "unknown"]


COMPANY = "name string, role string, industry string, hq string, revenue string, zi_subindustry string"


def fit_of(spark, companies):
    df = spark.createDataFrame([(companies,)], f"c array<struct<{COMPANY.replace(' string', ': string')}>>")
    return df.select(S.event_fit(S.with_fit(F.col("c"))).alias("f")).first().f


def test_event_fit(spark):
    good, bad = ("Boston, MA", "MM", "Banking"), ("Austin, TX", "MM", "Banking")
    c = lambda n, role, f: (n, role, None, *f)
    assert fit_of(spark, [c("Big", "Acquirer", bad), c("Small", "Target", good)]).account_name == "Small"
    f = fit_of(spark, [c("A", "Acquirer", bad), c("B", "Target", bad)])
    assert f.verdict == "fail" and f.reasons[0] == "A: HQ out of territory (Austin, TX)"
    assert fit_of(spark, [c("A", "Advisor", bad)]).verdict == "fail"
    assert fit_of(spark, [c("U", "Investor", ("", "MM", "Banking"))]).reasons == ["territory unverified"]
    assert fit_of(spark, []).reasons == ["no companies identified"]
    assert fit_of(spark, [c("Springfield School District", "primary", good)]).verdict == "fail"


def test_primary_picks(spark):
    rows = [("t", "Target", None, "", "", ""), ("a", "acquirer", None, "", "", "")]
    df = spark.createDataFrame([(rows,)], f"c array<struct<{COMPANY.replace(' string', ': string')}>>")
    r = df.select(S.pick_primary(F.col("c"))["name"], S.listed_primary(F.col("c"))["name"]).first()
    assert tuple(r) == ("a", "t")


def test_roles_and_tiers(spark):
    rows = ["Acme hires controller", "Controller promoted to CFO, Acme names him", "Acme names VP finance", "Acme wins award"]
    none = F.lit(None).cast("string")
    assert values(spark, rows, lambda c: S.finance_role(none, c, none)) == ["controller", "cfo", "cfo", None]
    assert values(spark, ["raises $12M", "raises $2M", "raises $300K", "raises money"], lambda c: S.search_tier(F.lit("funding"), c, none)) == [1, 2, 3, 2]
    assert values(spark, ["Joins the board of Acme", "CFO joins the board"], lambda c: S.board_only(F.lit("executive_hire"), c, none)) == [True, False]


def test_verify_company(spark):
    df = spark.createDataFrame([(True, "ABC", 10, 5.0), (False, None, 5000, None), (None, None, 3, None), (False, None, 100, 900.0), (False, None, None, None)], "p boolean, s string, e int, m double")
    got = [r[0].reason for r in df.select(S.verify_company(F.col("p"), F.col("s"), F.col("e"), F.col("m"), CFG)).collect()]
    assert got == ["Public company (ABC)", "Too large (5,000 employees, max 2,000)", "Too small (3 employees, min 20)", "Revenue too high ($900M, max $500M)", "Meets criteria"]


def test_signals(spark):
    got = values(spark, ["Acme expands and its expansion wins contract; CEO happy"], T.signals)[0]
    assert got == ["Company expansion mentioned", "Contract win announced", "CEO/leadership mentioned"]
    e = F.array().cast("array<string>")
    assert values(spark, ["Acme", None], lambda c: T.reasoning(c, F.array(F.lit("ohio")), e, e, F.lit(True))) == ["Company: Acme | Territory match: ohio | Appears to be mid-market/private company", "Territory match: ohio | Appears to be mid-market/private company"]
