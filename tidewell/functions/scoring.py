"""Scores, grades and fit verdicts over scalars and arrays of companies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config
from . import vocab as V
from .text import joined, largest_amount, nz, strip


def relevance(event_type: Column, n_regions: Column, industry: Column, company: Column) -> Column:
    by_type = V.mapping({"cfo_hire": 40, "executive_hire": 30, "merger_acquisition": 35, "funding": 25})
    base = F.coalesce(F.try_element_at(by_type, event_type), F.lit(10))
    extra = F.when(industry, 20).otherwise(0) + F.when(company, 50).otherwise(0)
    return F.least(base + F.least(n_regions * 15, F.lit(30)) + extra, F.lit(100)).cast("double")


def boosted(score: Column, by: Column) -> Column:
    return F.least(score + by, F.lit(100.0))


def feed_boost(source: Column, dateline: Column) -> Column:
    """Territory datelines and press wires count more. Boosts are capped one
    after the other, which is the cap of their sum."""
    wire = F.when(source == "pr_newswire", 15).when(source.isin("business_wire", "globe_newswire"), 10).otherwise(0)
    return F.when(dateline, 20).otherwise(0) + wire


def job_relevance(title: Column, n_regions: Column, industry: Column, n_keywords: Column) -> Column:
    t = F.lower(nz(title))
    base = (
        F.when(V.holds_any(t, V.CFO_WORDS), 45).when(F.contains(t, F.lit("controller")), 40).when(V.holds_any(t, ["director", "vp", "vice president", "head of finance"]), 35).otherwise(25)
    )
    return F.least(base + F.least(n_regions * 10, F.lit(20)) + F.when(industry, 15).otherwise(0) + F.least(n_keywords * 5, F.lit(15)), F.lit(100)).cast("double")


# ---------------------------------------------------------------- grades


def points(tags: Column, table: dict[str, int]) -> Column:
    own = V.mapping(table)
    return F.aggregate(F.coalesce(tags, F.array().cast("array<string>")), F.lit(0), lambda s, h: s + F.coalesce(F.try_element_at(own, h), F.lit(0)))


def grade(tags: Column, conf: Column) -> Column:
    """struct<score, grade> of hashtags; low or no confidence caps at C."""

    def of(facts: Column) -> Column:
        total, complexity = facts["score"], facts["complexity"]
        letter = (
            F.when(facts["n"] <= 0, "D")
            .when(facts["intent"], F.when(total >= 8, "A").when(total >= 5, "B").when(total >= 2, "C").otherwise("D"))
            .otherwise(F.when(complexity >= 8, "B").when(total >= 2, "C").otherwise("D"))
        )
        capped_ = lambda g: F.when(~facts["sure"] & g.isin("A", "B"), "C").otherwise(g)
        return F.struct(total.alias("score"), V.once(letter, capped_).alias("grade"))

    facts = lambda t: F.struct(
        points(t, V.HASHTAG_POINTS).alias("score"),
        points(t, V.COMPLEXITY).alias("complexity"),
        F.arrays_overlap(t, V.words(V.HIGH_INTENT)).alias("intent"),
        F.size(t).alias("n"),
        F.coalesce(conf.isin("High", "Medium"), F.lit(False)).alias("sure"),
    )
    return V.once(V.once(F.coalesce(tags, F.array().cast("array<string>")), facts), of)


def closed_tags(tags: Column, evidence: Column) -> Column:
    """Known hashtags, each once; #HyperGrowth only with growth evidence."""
    known = F.array_distinct(F.filter(tags, lambda h: h.isin(list(V.HASHTAG_POINTS))))
    return F.when(evidence, known).otherwise(F.array_remove(known, "#HyperGrowth"))


def capped(letter: Column, verdict: Column) -> Column:
    """An A of an account whose fit is unverified is a B."""
    return F.when((letter == "A") & (verdict == "unverified"), "B").otherwise(letter)


def capped_note(letter: Column, verdict: Column, note: Column) -> Column:
    return F.when((letter == "A") & (verdict == "unverified"), F.left(F.concat(F.lit("[Capped A→B: fit unverified] "), nz(note)), F.lit(1000))).otherwise(note)


def queue_rank(letter: Column) -> Column:
    """A, B, ungraded, C, D."""
    g = F.upper(strip(nz(letter)))
    return F.when(g == "A", 0).when(g == "B", 1).when(g == "C", 3).when(g == "D", 4).otherwise(2)


def promotion_rank(letter: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, "ABCD")), letter), F.lit(0)).cast("int") + F.when(letter.isin(*"ABCD"), -1).otherwise(4)


# ---------------------------------------------------------------- fit


def territory_rule(hq: Column, code: Column, name: Column, low: Column) -> Column:
    """in, out or unknown, of a stripped headquarters text, its last part in
    capitals and in small letters, and all of it in small letters."""
    return (
        F.when(hq == "", "unknown")
        .when(code.isin(V.TERRITORY_CODES), "in")
        .when(code.isin(V.ALL_CODES), "out")
        .when(name.isin(V.TERRITORY_NAMES) | low.isin(V.TERRITORY_NAMES), "in")
        .when(V.holds_any(low, V.FOREIGN_MARKERS), "out")
        .otherwise("unknown")
    )


def revenue_rule(segment: Column) -> Column:
    return F.when(segment.isin(V.IN_BAND), "in").when(segment == "Enterprise", "out").otherwise("unknown")


def vertical_rule(subindustry: Column) -> Column:
    return F.when(subindustry.isin(list(V.SUBINDUSTRIES)), "in").when(F.upper(subindustry) == "OTHER", "out").otherwise("unknown")


def verdict_rule(*facts: Column) -> Column:
    return F.when(F.lit("out").isin(*facts), "fail").when(F.lit("unknown").isin(*facts), "unverified").otherwise("pass")


def territory_of(hq: Column) -> Column:
    """in, out or unknown, of a headquarters text."""
    tail = lambda h: strip(F.element_at(F.split(h, ","), -1))
    parts = lambda h: F.struct(h.alias("hq"), F.upper(tail(h)).alias("code"), F.lower(tail(h)).alias("name"), F.lower(h).alias("low"))
    judged = lambda p: territory_rule(p["hq"], p["code"], p["name"], p["low"])
    return V.once(V.once(strip(nz(hq)), parts), judged)


def is_school_district(name: Column) -> Column:
    return V.holds_any(F.concat(F.lit(" "), F.lower(nz(name)), F.lit(" ")), V.SCHOOL_DISTRICTS)


def company_fit(name: Column, hq: Column, revenue: Column, subindustry: Column) -> Column:
    """struct<verdict, territory, revenue, vertical, reasons> of a company."""
    fields = lambda v, t, r, z, why: F.struct(v.alias("verdict"), t.alias("territory"), r.alias("revenue"), z.alias("vertical"), why.alias("reasons"))

    def judged(f: Column) -> Column:
        said = lambda value, t, r, z: F.array_compact(F.array(F.when(f["t"] == value, t), F.when(f["r"] == value, r), F.when(f["z"] == value, z)))
        outs = said("out", F.concat(F.lit("HQ out of territory ("), nz(hq), F.lit(")")), F.lit("revenue Enterprise (>$100M, out of band)"), F.lit("subindustry OTHER (not a target vertical)"))
        unknowns = said("unknown", F.lit("territory unverified"), F.lit("revenue unverified"), F.lit("vertical unverified"))
        return fields(verdict_rule(f["t"], f["r"], f["z"]), f["t"], f["r"], f["z"], F.when(F.lit("out").isin(f["t"], f["r"], f["z"]), outs).otherwise(unknowns))

    facts = F.struct(territory_of(hq).alias("t"), V.once(strip(nz(revenue)), revenue_rule).alias("r"), V.once(strip(nz(subindustry)), vertical_rule).alias("z"))
    district = fields(F.lit("fail"), F.lit("n/a"), F.lit("n/a"), F.lit("out"), F.array(F.lit("public school district (RFP procurement — dead end)")))
    return F.when(is_school_district(name), district).otherwise(V.once(facts, judged))


def searchable(companies: Column) -> Column:
    """The companies worth a search: not those of a role that can never become
    the account where another can, nor public school districts."""
    workable = lambda c: F.lower(nz(c["role"])).isin(V.WORKABLE_ROLES)
    some = F.exists(companies, workable)
    return F.filter(companies, lambda c: ~((nz(c["role"]) != "") & ~workable(c) & some) & ~is_school_district(c["name"]))


def with_fit(companies: Column) -> Column:
    """The companies, each with its own fit."""
    return F.transform(companies, lambda c: c.withField("fit", company_fit(c["name"], c["hq"], c["revenue"], c["zi_subindustry"])))


def role_rank(role: Column, roles: list[str]) -> Column:
    """Place of a role in the order, from 0; null outside."""
    at = F.array_position(V.words(roles), F.lower(nz(role)))
    return F.when(at > 0, at.cast("int") - 1)


def pick_primary(companies: Column) -> Column:
    """First company of the best primary role, else the first listed."""
    ranked = F.transform(companies, lambda c, i: F.struct(F.coalesce(role_rank(c["role"], V.PRIMARY_ROLES), F.lit(99)).alias("rank"), i.alias("at")))
    return F.get(companies, F.coalesce(F.array_min(ranked)["at"], F.lit(0)))


def listed_primary(companies: Column) -> Column:
    """First listed company with any primary role, else the first listed."""
    return F.coalesce(F.get(F.filter(companies, lambda c: F.lower(nz(c["role"])).isin(V.PRIMARY_ROLES)), 0), F.get(companies, 0))


def account_position(companies: Column) -> Column:
    """Place of the event's account among fitted companies: passing, then
    unverified, then any workable role, by role and position; else the first."""
    tier = lambda c: F.when(c["fit"]["verdict"] == "pass", 0).when(c["fit"]["verdict"] == "unverified", 1).otherwise(2)
    ranked = F.transform(companies, lambda c, i: F.struct(tier(c).alias("tier"), role_rank(c["role"], V.WORKABLE_ROLES).alias("rank"), i.alias("at")))
    return F.coalesce(F.array_min(F.filter(ranked, lambda r: r["rank"].isNotNull()))["at"], F.lit(0))


def account_by_name(companies: Column, name: Column) -> Column:
    """The company of the account's name, else the primary one."""
    same = F.filter(companies, lambda c: F.lower(strip(nz(c["name"]))) == F.lower(strip(nz(name))))
    return F.coalesce(F.get(same, 0), pick_primary(companies))


def seeded_hq(company: Column, hq: Column, filer: Column, state: Column) -> Column:
    """The headquarters, or the filer's state where the company is the filer
    and has none."""
    own = (F.lower(strip(nz(company))) == F.lower(strip(nz(filer)))) & (strip(nz(filer)) != "")
    return F.when(own & (strip(nz(hq)) == ""), state).otherwise(hq)


def event_fit(companies: Column) -> Column:
    """The event's fit from its fitted companies: it fails if every workable
    company fails, else it is the account's own."""
    fields = lambda v, t, r, z, s, n, why: F.struct(v.alias("verdict"), t.alias("territory"), r.alias("revenue"), z.alias("vertical"), s.alias("zi_subindustry"), n.alias("primary_name"), n.alias("account_name"), why.alias("reasons"))
    none, unknown = F.lit(None).cast("string"), F.lit("unknown")
    nobody = fields(F.lit("unverified"), unknown, unknown, unknown, none, none, F.array(F.lit("no companies identified")))

    def among(all_: Column) -> Column:
        workable = F.filter(all_, lambda c: role_rank(c["role"], V.WORKABLE_ROLES).isNotNull())
        return V.once(F.struct(F.get(all_, account_position(all_)).alias("account"), workable.alias("workable")), judged)

    def judged(p: Column) -> Column:
        account, workable = p["account"], p["workable"]
        all_fail = (F.size(workable) > 0) & F.forall(workable, lambda c: c["fit"]["verdict"] == "fail")
        reasons = F.when(all_fail, F.transform(workable, lambda c: F.concat(nz(c["name"]), F.lit(": "), F.array_join(c["fit"]["reasons"], "; ")))).otherwise(account["fit"]["reasons"])
        return fields(F.when(all_fail, "fail").otherwise(account["fit"]["verdict"]), account["fit"]["territory"], account["fit"]["revenue"], account["fit"]["vertical"], F.nullif(account["zi_subindustry"], F.lit("")), account["name"], reasons)

    own = V.once(companies, among)
    return F.coalesce(F.when(F.coalesce(F.size(companies), F.lit(0)) <= 0, nobody), own)


def headline(companies: Column) -> Column:
    """The company whose grade leads: best grade, then score, then position."""
    ranked = F.transform(companies, lambda c, i: F.struct(promotion_rank(c["tal"]["grade"]).alias("rank"), (-F.coalesce(c["tal"]["score"], F.lit(0))).alias("minus"), i.alias("at")))
    return F.get(companies, F.array_min(ranked)["at"])


# ---------------------------------------------------------------- roles and tiers


def finance_trigger(event_type: Column, title: Column, description: Column) -> Column:
    t = F.lower(joined(title, description))
    return (F.trim(t) != "") & ((event_type == "cfo_hire") | (V.holds_any(t, V.TRIGGER_VERBS) & V.holds_any(t, V.FINANCE_LEADERS)))


def finance_role(event_type: Column, title: Column, description: Column) -> Column:
    """cfo, controller or null; a controller who becomes CFO is a cfo."""
    t = F.lower(joined(title, description))
    role = (
        F.when(V.holds_any(t, V.CONTROLLER_WORDS), F.when(V.holds_any(t, V.CFO_DESTINATIONS), "cfo").otherwise("controller"))
        .when((event_type == "cfo_hire") | V.holds_any(t, V.CFO_LIKE), "cfo")
    )
    return F.when(F.coalesce(finance_trigger(event_type, title, description), F.lit(False)), role)


def board_only(event_type: Column, title: Column, description: Column) -> Column:
    t = F.lower(joined(title, description))
    return (event_type == "executive_hire") & V.holds_any(t, V.BOARD_WORDS) & ~V.holds_any(t, V.CFO_LIKE) & ~V.holds_any(t, V.CONTROLLER_WORDS)


def search_tier(event_type: Column, title: Column, description: Column) -> Column:
    """What an event's research may cost: 1 all, 2 free searches, 3 none."""
    amount = largest_amount(joined(title, description))
    return (
        F.when((event_type == "cfo_hire") | finance_role(event_type, title, description).isNotNull() | (event_type == "merger_acquisition"), 1)
        .when(event_type == "funding", F.when(amount.isNull(), 2).when(amount >= 10_000_000, 1).when(amount >= 1_000_000, 2).otherwise(3))
        .otherwise(2)
    )


def industry_hint(descriptor: Column, role: Column, default: str = "company") -> Column:
    investor = F.contains(F.lower(nz(role)), F.lit("investor"))
    return F.coalesce(F.nullif(strip(nz(descriptor)), F.lit("")), F.when(investor, F.lit("private equity venture capital")), F.lit(default))


def verify_company(public: Column, symbol: Column, employees: Column, millions: Column, cfg: Config) -> Column:
    """struct<ok, reason> of a company's facts; unknown facts pass."""
    e, m = F.nullif(employees, F.lit(0)), F.nullif(millions, F.lit(0.0))
    say = lambda text, *args: F.format_string(text, *args)
    reason = (
        F.when(F.lit(cfg.exclude_public) & F.coalesce(public, F.lit(False)), say("Public company (%s)", F.coalesce(F.nullif(symbol, F.lit("")), F.lit("publicly traded"))))
        .when(e > cfg.max_employees, say(f"Too large (%,d employees, max {cfg.max_employees:,})", e))
        .when(e < cfg.min_employees, say(f"Too small (%,d employees, min {cfg.min_employees:,})", e))
        .when(m > cfg.max_revenue, say(f"Revenue too high ($%.0fM, max ${cfg.max_revenue:g}M)", m))
        .when(m < cfg.min_revenue, say(f"Revenue too low ($%.0fM, min ${cfg.min_revenue:g}M)", m))
    )
    return F.struct(reason.isNull().alias("ok"), F.coalesce(reason, F.lit("Meets criteria")).alias("reason"))
