"""Configuration: territory and keyword lists of a deployment. Built from a
nested mapping, as a YAML or JSON file holds it; all lists are lower-cased once
and become array literals."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field


def _low(values) -> tuple[str, ...]:
    return tuple(str(v).lower() for v in (values or ()) if v)


@dataclass(frozen=True)
class Config:
    regions: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    industries: tuple[str, ...] = ()
    excluded_industries: tuple[str, ...] = ()
    excluded_locations: tuple[str, ...] = ()
    excluded_content: tuple[str, ...] = ()
    blocked_industries: tuple[str, ...] = ()
    target_companies: tuple[str, ...] = ()
    size_indicators: tuple[str, ...] = ()
    exclude_public: bool = True
    public_indicators: tuple[str, ...] = ()
    public_companies: tuple[str, ...] = ()
    executive_words: tuple[str, ...] = ()
    merger_words: tuple[str, ...] = ()
    funding_words: tuple[str, ...] = ()
    publishers: tuple[str, ...] = ()
    require_territory: bool = True
    max_age_hours: int = 72
    min_employees: int = 20
    max_employees: int = 2000
    min_revenue: float = 5.0
    max_revenue: float = 500.0
    feeds: tuple[Mapping, ...] = field(default=())
    job_titles: tuple[str, ...] = ()

    @classmethod
    def of(cls, raw: Mapping) -> "Config":
        territory = raw.get("territory") or {}
        company = territory.get("company_filters") or {}
        keywords = raw.get("keywords") or {}
        scraper = raw.get("scraper") or {}
        return cls(
            regions=_low(territory.get("regions")),
            cities=_low(territory.get("cities")),
            industries=_low(territory.get("industries")),
            excluded_industries=_low(territory.get("excluded_industries")),
            excluded_locations=_low(territory.get("excluded_locations")),
            excluded_content=_low(raw.get("excluded_content") or territory.get("excluded_content")),
            blocked_industries=_low(raw.get("blocked_industries")),
            target_companies=_low(territory.get("target_companies")),
            size_indicators=_low(company.get("target_size_indicators")),
            exclude_public=bool(company.get("exclude_public_companies", True)),
            public_indicators=_low(company.get("public_company_indicators")),
            public_companies=_low(company.get("excluded_public_companies")),
            executive_words=_low(keywords.get("executive_hires")),
            merger_words=_low(keywords.get("mergers_acquisitions")),
            funding_words=_low(keywords.get("funding_events")),
            publishers=_low(raw.get("publishers")),
            require_territory=bool(scraper.get("require_territory_match", True)),
            max_age_hours=int(scraper.get("max_age_hours", 72)),
            min_employees=int(company.get("min_employees", 20)),
            max_employees=int(company.get("max_employees", 2000)),
            min_revenue=float(company.get("min_revenue_millions", 5)),
            max_revenue=float(company.get("max_revenue_millions", 500)),
            feeds=tuple((raw.get("sources") or {}).get("rss_feeds") or ()),
            job_titles=tuple(raw.get("job_titles") or ()),
        )


def load(path: str) -> Config:
    """Read a configuration file, JSON or (where a parser is installed) YAML."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return Config.of(json.loads(text))
    import yaml

    return Config.of(yaml.safe_load(text) or {})
