"""Predicates and composite gates. Each gate is one projection: it adds an
outcome (and the reason of a drop) instead of looping over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scoring as S
from ..functions import text as T
from ..functions import vocab as V
from ..functions.text import joined, nz, strip


low = T.lowered


def _prepared(df: DataFrame) -> DataFrame:
    """df with _summary (without HTML), _full (title and summary) and its lower
    case: every rule looks at these, so they are columns, made once."""
    rows = df.withColumn("_summary", T.strip_html(F.col("summary")))
    rows = rows.withColumn("_full", joined(F.col("title"), F.col("_summary")))
    return rows.withColumn(T.LOWERED, F.lower(F.col("_full")))


def excluded_content(text: Column, cfg: Config) -> Column:
    return V.holds_any(low(text), cfg.excluded_content)


def excluded_location(text: Column, cfg: Config) -> Column:
    return V.holds_any(low(text), cfg.excluded_locations)


def dateline_places(line: Column, cfg: Config) -> Column:
    """City and state of a dateline, as far as they are territory."""
    places = lambda p: F.array_compact(F.array(F.when(p["city"].isin(list(cfg.cities)), p["city"]), F.when(p["state"].isin(list(cfg.regions)), p["state"])))
    return V.once(line, places)


def territory(text: Column, cfg: Config, small: Column | None = None, line: Column | None = None) -> Column:
    """Territory places of a text: none with an excluded location; those of the
    dateline if any; else all regions, then all cities that it contains.
    `small` is the text in lower case and `line` its first dateline, where they
    are known."""
    small = text if small is None else small
    anywhere = lambda t: F.concat(V.held(t, cfg.regions), V.held(t, cfg.cities))
    first = T.first_dateline(text) if line is None else line
    own = V.once(dateline_places(first, cfg), lambda p: F.when(F.size(p) > 0, p).otherwise(V.once(low(small), anywhere)))
    return F.when(excluded_location(small, cfg), F.array().cast("array<string>")).otherwise(own)


def any_dateline(lines: Column, cfg: Config) -> Column:
    """Whether any of a text's dateline places is in the territory."""
    return F.exists(lines, lambda p: F.coalesce(p["city"].isin(list(cfg.cities)), F.lit(False)) | F.coalesce(p["state"].isin(list(cfg.regions)), F.lit(False)))


def excluded_industry(text: Column, cfg: Config) -> Column:
    return V.holds_any(low(text), cfg.excluded_industries)


def target_industry(text: Column, cfg: Config) -> Column:
    return V.holds_any(low(text), cfg.industries) & ~excluded_industry(text, cfg)


def public_company(text: Column, cfg: Config) -> Column:
    return V.holds_any(low(text), (*cfg.public_companies, *cfg.public_indicators)) if cfg.exclude_public else F.lit(False)


def target_size(text: Column, cfg: Config) -> Column:
    return V.holds_any(low(text), cfg.size_indicators)


def target_company(text: Column, cfg: Config) -> Column:
    return V.first_held(low(text), cfg.target_companies)


def pe_backed(text: Column) -> Column:
    return V.holds_any(low(text), V.PE_WORDS)


def blocked_industry(industry: Column, cfg: Config) -> Column:
    """The blocked keyword in an industry text, or null."""
    return V.first_held(low(industry), cfg.blocked_industries)


def recent(published: Column, as_of: Column, hours: int) -> Column:
    return published >= as_of - F.expr(f"INTERVAL {int(hours)} HOURS")


def is_publisher(name: Column, url: Column, cfg: Config) -> Column:
    """Whether a company name is only the site that published the article."""
    squish = lambda c: F.regexp_replace(F.lower(nz(c)), r"[^\p{L}\p{N}]", "")
    host = F.regexp_replace(F.lower(T.authority(url)), r"^www\.|:\d+$", "")
    stem = F.get(F.split(host, r"\."), 0)
    return (squish(name) != "") & (F.lower(strip(nz(name))).isin(list(cfg.publishers)) | (F.lower(strip(nz(name))) == host) | (squish(name) == squish(stem)) | (squish(name) == squish(host)))


def valid_companies(companies: Column, most: int = 5) -> Column:
    good = lambda c: (F.length(strip(nz(c["name"]))) > 1) & ~F.lower(strip(nz(c["name"]))).isin("unknown", "nan", "none")
    return F.slice(F.filter(companies, good), 1, most)


def event_fits(df: DataFrame, key: str, companies: str = "companies") -> DataFrame:
    """key and the parts of `scoring.event_fit` (verdict, territory, revenue,
    vertical, account_name) for events with arrays of companies. Companies are
    judged as rows, each once, and the account is the least by one order in one
    aggregation."""
    c = F.col("c")
    rows = df.select(key, F.posexplode_outer(companies).alias("pos", "c"))
    rows = rows.select(key, "pos", c["name"].alias("name"), c["role"].alias("role"), S.is_school_district(c["name"]).alias("_district"), strip(nz(c["hq"])).alias("_hq"), strip(nz(c["revenue"])).alias("_rev"), strip(nz(c["zi_subindustry"])).alias("_zi"))
    rows = rows.withColumns({"_tail": strip(F.element_at(F.split("_hq", ","), -1)), "_rank": S.role_rank(F.col("role"), V.WORKABLE_ROLES)})
    rows = rows.withColumns({"territory": S.territory_rule(F.col("_hq"), F.upper("_tail"), F.lower("_tail"), F.lower("_hq")), "revenue": S.revenue_rule(F.col("_rev")), "vertical": S.vertical_rule(F.col("_zi"))})
    own = F.struct(S.verdict_rule(F.col("territory"), F.col("revenue"), F.col("vertical")).alias("verdict"), "territory", "revenue", "vertical")
    district = F.struct(F.lit("fail").alias("verdict"), F.lit("n/a").alias("territory"), F.lit("n/a").alias("revenue"), F.lit("out").alias("vertical"))
    rows = rows.select(key, "pos", "name", "_rank", F.when(F.col("_district"), district).otherwise(own).alias("fit"))
    verdict = F.col("fit.verdict")
    tier = F.when(verdict == "pass", 0).when(verdict == "unverified", 1).otherwise(2)
    works = F.col("_rank").isNotNull()
    order = F.struct((~works).alias("a"), F.when(works, tier).alias("b"), F.col("_rank").alias("c"), F.col("pos").alias("d"))
    best = rows.groupBy(key).agg(F.min_by(F.struct("fit", "name", "pos"), order).alias("best"), F.count_if(works).alias("_works"), F.count_if(works & (verdict == "fail")).alias("_fail"))
    nobody, unknown = F.col("best.pos").isNull(), F.lit("unknown")
    return best.select(
        key,
        F.when(nobody, "unverified").when((F.col("_works") > 0) & (F.col("_works") == F.col("_fail")), "fail").otherwise(F.col("best.fit.verdict")).alias("verdict"),
        *[F.when(nobody, unknown).otherwise(F.col(f"best.fit.{f}")).alias(f) for f in ("territory", "revenue", "vertical")],
        F.col("best.name").alias("account_name"),
    )


def feed_gate(df: DataFrame, cfg: Config) -> DataFrame:
    """title, summary -> outcome of a feed entry: event_type, drop_reason (null
    if kept), matched_regions, company_name, person_*, keywords, description,
    relevance_score. First reason that holds wins."""
    f, t = F.col("_full"), F.col(T.LOWERED)
    base = V.made(_prepared(df).withColumn("_lines", T.datelines(f)).select(
        "*",
        any_dateline(F.col("_lines"), cfg).alias("_line"),
        territory(f, cfg, t, F.get("_lines", 0)).alias("matched_regions"),
        target_company(t, cfg).alias("_target"),
        T.detect_type(t, cfg).alias("_type"),
    ))
    inside, wanted = F.size("matched_regions") > 0, F.col("_target").isNotNull()
    none = F.col("_type").isNull()
    reason = (
        F.when(excluded_industry(t, cfg), "excluded_industry")
        .when(public_company(t, cfg), "public_company")
        .when(F.col("_line") & none & ~wanted, "no_type")
        .when(F.col("_line"), F.lit(None))
        .when(excluded_location(t, cfg), "excluded_location")
        .when(none & ~(wanted | (pe_backed(t) & inside)), "no_type")
        .when(F.lit(cfg.require_territory) & ~(inside | wanted), "out_of_territory")
    )
    kind = F.coalesce(F.col("_type"), F.lit("stable_target"))
    source = T.feed_source(F.col("feed_name"))
    summary = F.col("_summary")
    why = T.reasoning(F.col("_target"), F.col("matched_regions"), T.industries(t, cfg), T.signals(t), target_size(t, cfg))
    recommended = F.col("_line") & none & wanted
    description = F.when(recommended, F.concat(F.lit("RECOMMENDATION: "), why, F.lit("\n\n"), F.left(summary, F.lit(400)))).otherwise(T.blank_to_null(F.left(summary, F.lit(500))))
    score = S.boosted(S.relevance(kind, F.size("matched_regions"), target_industry(t, cfg), wanted), S.feed_boost(source, F.col("_line")))
    return base.select(
        *df.columns,
        reason.alias("drop_reason"),
        kind.alias("event_type"),
        source.alias("source"),
        "matched_regions",
        F.coalesce(F.col("_target"), T.company_name(f)).alias("company_name"),
        T.person_name(f).alias("person_name"),
        T.person_title(f).alias("person_title"),
        T.keywords(t, kind, cfg).alias("matched_keywords"),
        description.alias("description"),
        score.alias("relevance_score"),
    )


def search_gate(df: DataFrame, cfg: Config, site: bool = False, skip_territory: Column | None = None, hint: Column | None = None) -> DataFrame:
    """Entries of news searches (or, with `site`, of the funding site): title,
    summary -> event_type, matched_regions, drop_reason."""
    rows, f, t = _prepared(df), F.col("_full"), F.col(T.LOWERED)
    detected = T.detect_site_type(F.col("title"), t, cfg) if site else T.detect_type(t, cfg)
    kind = detected if hint is None or site else F.coalesce(detected, hint)
    skip = F.lit(False) if skip_territory is None else skip_territory
    base = rows.select("*", kind.alias("event_type"), territory(f, cfg, t).alias("matched_regions"), target_company(t, cfg).isNotNull().alias("_wanted"))
    inside = F.size("matched_regions") > 0
    place = F.when(excluded_location(t, cfg), "excluded_location")
    field = F.when(excluded_industry(t, cfg), "excluded_industry").when(public_company(t, cfg), "public_company")
    keep = inside | F.col("_wanted") if cfg.require_territory or site else inside | target_industry(t, cfg) | F.col("_wanted")
    reason = F.coalesce(F.when(F.col("event_type").isNull(), "no_type"), place if site else field, field if site else place, F.when(~skip & ~keep, "out_of_territory"))
    return base.withColumn("drop_reason", reason).drop("_wanted", "_summary", "_full", T.LOWERED)


def filing_gate(filings: DataFrame, filers: DataFrame, cfo: DataFrame, finance: DataFrame, cfg: Config, codes: list[str] | None = None) -> DataFrame:
    """8-K filings (cik, display_name, adsh, file_type, item, file_date) with
    filers (cik, state, sic) and the accession numbers that mention a CFO or
    any finance leader. With no finance mention at all (a failed search),
    officer filings stay."""
    codes = codes or V.TERRITORY_CODES + list(V.FILING_PROVINCES)
    marked = (
        filings.join(filers, "cik", "left")
        .join(cfo.select("adsh").distinct().withColumn("_cfo", F.lit(True)), "adsh", "left")
        .join(finance.select("adsh").distinct().withColumn("_finance", F.lit(True)), "adsh", "left")
    )
    any_finance = finance.agg((F.count("*") > 0).alias("_any"))
    marked = marked.join(F.broadcast(any_finance))  # one row
    name = T.filer_name(F.col("display_name"))
    officer = F.col("item") == "5.02"
    reason = (
        F.when(nz(F.col("cik")).eqNullSafe("") | (nz(F.col("display_name")) == "") | (nz(F.col("adsh")) == ""), "incomplete")
        .when(~F.coalesce(F.upper(F.col("state")).isin(codes), F.lit(False)), "out_of_territory")
        .when(F.col("sic").isin(list(V.BLOCKED_SIC)), "blocked_sic")
        .when(excluded_industry(joined(name, F.col("file_type")), cfg), "excluded_industry")
        .when(public_company(name, cfg), "public_company")
        .when(officer & F.col("_cfo").isNull() & F.col("_finance").isNull() & F.col("_any"), "no_finance_leader")
    )
    item_name = V.mapping({k: v[0] for k, v in V.FILING_ITEMS.items()})
    item_type = V.mapping({k: v[1] for k, v in V.FILING_ITEMS.items()})
    kind = F.when(officer & F.col("_cfo"), "cfo_hire").otherwise(F.try_element_at(item_type, F.col("item")))
    label = F.try_element_at(item_name, F.col("item"))
    return marked.select(
        *filings.columns,
        "state",
        name.alias("company_name"),
        kind.alias("event_type"),
        filing_url(F.col("cik"), F.col("adsh")).alias("url"),
        F.format_string("SEC 8-K Item %s (%s) — %s", F.col("item"), label, name).alias("title"),
        F.format_string("SEC 8-K filing by %s (%s) — Item %s: %s. Filing date: %s.", name, F.col("state"), F.col("item"), label, F.col("file_date").cast("string")).alias("description"),
        F.lit(75.0).alias("relevance_score"),
        reason.alias("drop_reason"),
    )


def filing_url(cik: Column, adsh: Column) -> Column:
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.try_cast("long").cast("string"), F.lit("/"), F.replace(adsh, F.lit("-"), F.lit("")), F.lit("/"), adsh, F.lit("-index.htm"))


def offering_gate(df: DataFrame, filers: DataFrame, cfg: Config, most: int = 50, codes: list[str] | None = None) -> DataFrame:
    """Form D filings -> outcome keep, drop or fund, from free facts first; of
    what they leave the newest `most` get their filer facts and details."""
    codes = codes or V.TERRITORY_CODES + list(V.FILING_PROVINCES)
    name = T.filer_name(F.col("display_name"))
    padded = F.concat(F.lit(" "), F.lower(name), F.lit(" "))
    state = F.get(F.col("biz_states"), 0)
    free = (
        F.when(nz(F.col("file_type")) != "D", "drop")
        .when(F.arrays_overlap(F.coalesce(F.col("items"), F.array().cast("array<string>")), V.words(V.FUND_ITEMS)), "fund")
        .when((nz(F.col("cik")) == "") | (nz(F.col("display_name")) == "") | (nz(F.col("adsh")) == ""), "drop")
        .when(V.holds_any(padded, V.FUND_NAMES), "fund")
        .when(~F.coalesce(F.upper(state).isin(codes), F.lit(False)) | public_company(name, cfg), "drop")
        .otherwise("keep")
    )
    judged = df.select("*", free.alias("_free"), name.alias("company_name"), state.alias("state"))
    chosen = judged.where("_free = 'keep'").orderBy(F.desc("file_date"), "adsh").limit(most).join(filers.select("cik", "sic"), "cik", "left")
    xml = nz(F.col("detail_xml")) if "detail_xml" in df.columns else F.lit("")
    late = F.when(F.col("sic").isin(V.FUND_SIC), "fund").when(F.col("sic").isin(list(V.BLOCKED_SIC)), "drop").when(F.contains(xml, F.lit("<investmentFundInfo>")) | F.contains(xml, F.lit("Pooled Investment Fund")), "fund").otherwise("keep")
    raw = strip(F.regexp_extract(xml, r"<totalOfferingAmount>([^<]+)</totalOfferingAmount>", 1))
    amount = F.when(F.lower(raw) == "indefinite", "Indefinite").when(raw.try_cast("double").isNotNull(), F.concat(F.lit("$"), F.format_number(F.floor(raw.try_cast("double")), 0))).otherwise(raw)
    done = chosen.select("*", late.alias("outcome"), amount.alias("amount"), strip(F.regexp_extract(xml, r"<industryGroupType>([^<]+)</industryGroupType>", 1)).alias("industry_group"))
    bits = F.concat_ws(
        " ",
        F.format_string("SEC Form D filed by %s (%s) — private capital raise (Reg D exempt offering).", F.col("company_name"), F.col("state")),
        F.when(F.col("amount") != "", F.format_string("Total offering: %s.", F.col("amount"))),
        F.when(F.col("industry_group") != "", F.format_string("Form D industry group: %s.", F.col("industry_group"))),
        F.format_string("Filing date: %s.", F.col("file_date").cast("string")),
    )
    out = ["adsh", "cik", "company_name", "state", "file_date", "outcome"]
    rest = judged.where("_free <> 'keep'").withColumn("outcome", F.col("_free")).select(*out, F.lit(None).cast("string").alias("description"))
    return done.select(*out, bits.alias("description")).unionByName(rest)


def job_gate(df: DataFrame, cfg: Config, states: list[str]) -> DataFrame:
    """Postings of the jobs API -> event_type, drop_reason."""
    title, company = strip(nz(F.col("title"))), strip(nz(F.col("company")["display_name"]))
    place = strip(nz(F.get(F.col("location")["area"], 1)))
    titles = [t.lower() for t in cfg.job_titles or V.JOB_TITLES]
    body = F.left(nz(F.col("description")), F.lit(600))
    reason = (
        F.when(~place.isin(states), "out_of_territory")
        .when(~V.holds_any(F.lower(title), titles), "other_title")
        .when(V.holds_any(F.lower(title), V.OTHER_CONTROLLERS), "not_finance")
        .when(strip(nz(F.col("redirect_url"))) == "", "no_url")
        .when(company == "", "no_company")
        .when(V.holds_any(F.lower(company), V.RECRUITERS), "recruiter")
        .when(excluded_industry(joined(title, company, body), cfg), "excluded_industry")
    )
    cfo = V.holds_any(F.lower(title), ["cfo", "chief financial"])
    return df.select("*", reason.alias("drop_reason"), F.when(cfo, "cfo_hire").otherwise("executive_hire").alias("event_type"), place.alias("region"), F.concat(company, F.lit(" hiring: "), title).alias("event_title"), F.lit(72.0).alias("relevance_score"))


def board_gate(df: DataFrame, cfg: Config, kind: str = "board", search_location: Column | None = None) -> DataFrame:
    """Job-board entries; kind is board, google, ladders or cfo."""
    title, f = nz(F.col("title")), joined(F.col("title"), F.col("description"))
    titles = list(cfg.job_titles or V.JOB_TITLES)
    hit = F.filter(V.words(titles), lambda t: F.contains(F.lower(title), F.lower(t)))
    regions = territory(f, cfg)
    if kind in ("board", "google") and search_location is not None:
        regions = F.when((F.size(regions) == 0) & (nz(search_location) != ""), F.array(search_location)).otherwise(regions)
    base = df.select("*", hit.alias("_hit"), regions.alias("matched_regions"))
    keys = F.array_distinct(F.concat(F.array(F.lit("CFO")), F.col("_hit"))) if kind == "cfo" else F.col("_hit")
    reason = F.when(F.lit(kind != "cfo") & (F.size("_hit") == 0), "other_title").when(public_company(f, cfg), "public_company").when(excluded_industry(f, cfg), "excluded_industry").when(F.lit(cfg.require_territory) & (F.size("matched_regions") == 0), "out_of_territory")
    score = S.job_relevance(title, F.size("matched_regions"), target_industry(f, cfg), F.size(keys))
    score = S.boosted(score, F.lit(10)) if kind in ("ladders", "cfo") else score
    return base.select(*df.columns, "matched_regions", keys.alias("matched_keywords"), T.job_company(title).alias("company_name"), score.alias("relevance_score"), reason.alias("drop_reason"))


def retro_reason(df: DataFrame, cfg: Config) -> DataFrame:
    """Why a stored event would be dropped today (drop_reason null: it stays)."""
    f = low(joined(F.col("title"), F.col("description"), F.col("company_name")))
    quote = lambda label, hit, other: F.concat(F.lit(f'{label}: "'), F.coalesce(hit, F.lit(other)), F.lit('"'))
    industry = V.first_held(f, cfg.excluded_industries)
    public = V.first_held(f, cfg.public_companies)
    reason = F.when(industry.isNotNull(), quote("excluded_industry", industry, "industry")).when(public_company(f, cfg), quote("excluded_company", public, "public-co"))
    if "companies_data" in df.columns:
        late = blocked_industry(S.listed_primary(F.col("companies_data"))["industry"], cfg)
        reason = F.coalesce(reason, F.when(late.isNotNull(), quote("post_enrichment_industry", late, "")))
    return df.withColumn("drop_reason", reason)
