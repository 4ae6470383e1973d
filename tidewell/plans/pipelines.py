"""The library's three pipelines as plans: a scrape cycle, enrichment, and the
analysts' view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import Config
from ..functions import scoring as S
from ..functions import text as T
from ..functions import vocab as V
from ..operators import dedup, gates, ranking, store
from ..sources import readers


def scrape_cycle(payloads: DataFrame, seen: DataFrame, events: DataFrame, cfg: Config, as_of: Column) -> DataFrame:
    """Fetched feeds -> accepted events: parse, drop old ones, judge, drop seen
    and repeated ones, then accept greedily in arrival order: that of the feeds in
    the configuration (others after them, by name), then that in the feed."""
    young = V.made(readers.feed_entries(payloads)).where(gates.recent(readers.published(as_of), as_of, cfg.max_age_hours))
    found = readers.to_events(gates.feed_gate(young, cfg), as_of)
    new = dedup.fresh_titles(dedup.unseen(found, seen), events, as_of, cfg.max_age_hours)
    known = F.array_position(V.words([f.get("name") for f in cfg.feeds]), F.col("feed_name"))
    order = W.orderBy(F.when(known > 0, known).otherwise(1 << 30), "feed_name")  # one row a feed
    ranks = payloads.select("feed_name").distinct().withColumn("_rank", F.row_number().over(order))
    numbered = new.join(ranks, "feed_name").withColumn("arrival_seq", F.col("_rank") * F.lit(1 << 32) + F.col("pos")).drop("_rank")
    # Judged once: what follows reads the keys several times.
    return dedup.greedy(store.staged(numbered)).withColumn("discovered_date", as_of)


def enrich(events: DataFrame, as_of: Column, cfg: Config) -> DataFrame:
    """Events with companies_data (facts filled in) -> fit, grades, headline;
    board-only and industry-blocked events are tombstoned. One projection."""
    fitted = events.withColumn("companies_data", S.with_fit(F.col("companies_data")))
    fitted = fitted.withColumn("fit", S.event_fit(F.col("companies_data")))
    primary = S.pick_primary(F.col("companies_data"))
    blocked = gates.blocked_industry(primary["industry"], cfg)
    reason = (
        F.when(S.board_only(F.col("event_type"), F.col("title"), F.col("description")), "board_change_only")
        .when(blocked.isNotNull(), F.concat(F.lit("industry: "), blocked))
        .when(F.col("fit.verdict") == "fail", F.concat(F.lit("fit_gate: "), F.array_join("fit.reasons", "; ")))
    )
    graded = S.grade(F.col("hashtags"), F.col("confidence_level"))
    out = fitted.withColumn("_g", graded).withColumns({
        "numeric_score": F.col("_g.score"),
        "grade": S.capped(F.col("_g.grade"), F.col("fit.verdict")),
        "grade_justification": S.capped_note(F.col("_g.grade"), F.col("fit.verdict"), F.col("grade_justification")),
        "search_tier": S.search_tier(F.col("event_type"), F.col("title"), F.col("description")),
        "blocked_at": F.coalesce(F.col("blocked_at"), F.when(reason.isNotNull(), as_of)),
        "blocked_reason": F.coalesce(F.col("blocked_reason"), F.left(reason, F.lit(300))),
        "enriched_at": as_of,
    })
    return out.drop("_g")


def analyst_view(events: DataFrame, dispositions: DataFrame, as_of: Column, days: int = 30, needle: str = "", regions: list[str] | None = None, bands: list[str] | None = None, grades: list[str] | None = None, most: int = 10) -> DataFrame:
    """Filters, then new and undecided events, then the ranked work queue."""
    rows = events.where((F.col("discovered_at") >= as_of - F.expr(f"INTERVAL {int(days)} DAYS")) & F.col("blocked_at").isNull())
    rows = ranking.by_grade(ranking.by_band(ranking.by_region(ranking.search(rows, needle), regions or []), bands or []), grades or [])
    shown = rows.withColumn("display_company", ranking.display_company(F.col("fit"), F.col("company_name"), F.col("companies_data")))
    new = shown.where(F.upper(F.coalesce("lead_status", F.lit("NEW"))) == "NEW")
    return ranking.work_queue(ranking.undecided(new, dispositions), "display_company", "grade", "numeric_score", "discovered_at", "id", most)


def cleanup(events: DataFrame, cfg: Config) -> DataFrame:
    """id, drop_reason of stored events that today's rules or title duplicates
    would drop."""
    judged = gates.retro_reason(events, cfg)
    dropped = judged.where("drop_reason is not null").select("id", "drop_reason")
    left = judged.where("drop_reason is null")
    companies = F.size(F.coalesce(F.col("companies_data"), F.array().cast(dict(events.dtypes)["companies_data"]))) > 0
    ranked = dedup.title_groups(left, companies=companies, graded=T.nz(F.col("grade")) != "")
    return dropped.union(ranked.where("keep_rank > 1").select("id", F.lit("duplicate_title")))
