"""Word lists, code tables and point values, and helpers that turn them into
columns. The territory, industry and keyword lists of a deployment come from
its configuration (`tidewell.config`)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviations of states and provinces in datelines.
STATE_NAMES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado",
    "ct": "connecticut", "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho",
    "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana",
    "me": "maine", "md": "maryland", "ma": "massachusetts", "mass": "massachusetts", "mi": "michigan",
    "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada",
    "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina",
    "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania", "ri": "rhode island",
    "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont",
    "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming",
    "dc": "washington dc", "on": "ontario", "ont": "ontario", "qc": "quebec", "que": "quebec",
    "bc": "british columbia", "ab": "alberta", "mb": "manitoba", "sk": "saskatchewan", "ns": "nova scotia",
    "nb": "new brunswick", "nl": "newfoundland", "pe": "prince edward island",
}

# Territory of headquarters.
TERRITORY_CODES = [
    "ME", "NH", "VT", "MA", "RI", "CT", "NY", "NJ", "PA", "DE", "MD", "VA", "WV", "DC", "NC", "SC", "GA", "FL", "AL",
    "TN", "KY", "OH", "MI", "IN", "ON", "QC", "NB", "NS", "PE", "NL",
]
ALL_CODES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME",
    "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA",
    "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC", "ON", "QC", "NB", "NS", "PE", "NL",
    "BC", "AB", "MB", "SK", "YT", "NT", "NU",
]
TERRITORY_NAMES = [
    "maine", "new hampshire", "vermont", "massachusetts", "rhode island", "connecticut", "new york", "new jersey",
    "pennsylvania", "delaware", "maryland", "virginia", "west virginia", "washington dc", "district of columbia",
    "north carolina", "south carolina", "georgia", "florida", "alabama", "tennessee", "kentucky", "ohio", "michigan",
    "indiana", "ontario", "quebec", "québec", "new brunswick", "nova scotia", "prince edward island", "newfoundland",
    "newfoundland and labrador",
]
FOREIGN_MARKERS = [
    "germany", "france", "uk", "united kingdom", "england", "india", "china", "japan", "australia", "israel",
    "singapore", "switzerland", "netherlands", "sweden", "ireland", "spain", "italy", "brazil", "mexico",
    "hong kong", "korea", "norway", "denmark", "finland", "belgium", "austria", "chile", "british columbia",
    "alberta", "manitoba", "saskatchewan",
]
FILING_PROVINCES = {'A3': 'NB', 'A4': 'NL', 'A5': 'NS', 'A6': 'ON', 'A7': 'PE', 'A8': 'QC'}

# Subindustries by vertical.
VERTICALS = {
    "Financial Services": [
        "Banking", "Credit Cards & Transaction Processing", "Debt Collection", "Holding Companies & Conglomerates",
        "Insurance", "Investment Banking", "Lending & Brokerage", "Venture Capital & Private Equity",
    ],
    "Nonprofits & Organizations": [
        "Blood & Organ Banks", "Childcare", "Colleges & Universities", "Cultural & Informational Centers",
        "K-12 Schools", "Libraries", "Membership Organizations", "Museums & Art Galleries",
        "Non-Profit & Charitable Organizations", "Non-Profit Organizations & Charitable Foundations",
        "Performing Arts Theaters", "Religious Organizations", "Training", "Zoos & National Parks",
    ],
    "Consumer Services": [
        "Auctions", "Automobile Dealers", "Automotive Service & Collision Repair", "Barber Shops & Beauty Salons",
        "Cleaning Services", "Consumer Services", "Funeral Homes & Funeral Related Services", "Photography Studio",
        "Real Estate", "Repair Services",
    ],
}
SUBINDUSTRIES = {name: vertical for vertical, names in VERTICALS.items() for name in names}

# Revenue segments in $M and what older data called them.
BANDS = ["LMM", "MM", "Corp", "Enterprise"]
BAND_LIMITS = [10, 20, 100]
LEGACY_BANDS = {
    "<$10M": "LMM", "$10M-50M": "MM", "$50M-100M": "Corp", "$100M-200M": "Enterprise", "$200M-500M": "Enterprise",
    "$500M-1B": "Enterprise", "$1B+": "Enterprise", "<$5M": "LMM", "$5M-10M": "LMM", "$10M-25M": "MM",
    "$25M-50M": "Corp",
}
IN_BAND = ["LMM", "MM", "Corp"]

# Roles of companies in an event.
PRIMARY_ROLES = ["acquirer", "portfolio company", "hiring company", "primary", "target"]
WORKABLE_ROLES = PRIMARY_ROLES + ["lead investor", "investor"]

# Points of hashtags; the first seven show high intent.
HIGH_INTENT = {"#NewCFO": 5, "#NewController": 3, "#Funding": 3, "#PEBacked": 3, "#Acquisitions": 3, "#FormerUser": 3, "#PrevConvo": 3}
COMPLEXITY = dict.fromkeys(["#HyperGrowth", "#100EE", "#Locations", "#Entities", "#HoldCo", "#Global", "#Franchisor", "#Franchisee", "#Legacy", "#AssetManagerScale"], 2)
HASHTAG_POINTS = HIGH_INTENT | COMPLEXITY

# Phrases of detectors.
CFO_WORDS = ["cfo", "chief financial officer"]
CFO_VERBS = ["named", "appointed", "hired", "joins", "new cfo", "promoted", "announces"]
HIRE_VERBS = ["named", "appointed", "hired", "joins", "promoted", "announces", "welcomes"]
STRONG_FUNDING = [
    "series a", "series b", "series c", "series d", "funding round", "raises $", "raised $", "secures $", "secured $",
    "investment round", "venture capital", "private equity", "seed funding", "seed round",
]
SITE_FUNDING = [
    r"raises?\s+\$[\d,.]+[mk]?\s*(?:million|m\b)", r"secures?\s+\$[\d,.]+[mk]?\s*(?:million|m\b)",
    r"closes?\s+\$[\d,.]+[mk]?\s*(?:million|m\b)", r"series\s+[a-f]\b", r"seed\s+(?:round|funding)", r"funding\s+round",
    r"venture\s+(?:capital|funding)", r"growth\s+(?:equity|capital|funding)", r"in\s+(?:new\s+)?funding",
    r"\$[\d,.]+[mk]?\s*(?:million|m\b)\s*(?:in\s+)?(?:funding|investment|financing|round)",
]
SITE_MERGERS = [r"acquires?\b", r"acquisition\b", r"merger\b", r"to\s+acquire\b", r"completes?\s+acquisition", r"buyout\b", r"takeover\b"]
PE_WORDS = [
    "private equity", "pe-backed", "pe backed", "-backed", "portfolio company", "capital partners", "equity partners",
    "investment partners", "growth equity", "buyout", "lbo", "leveraged buyout", "sponsor-backed", "sponsor backed",
    "add-on acquisition", "bolt-on acquisition", "platform acquisition", "tuck-in acquisition",
]
SCHOOL_DISTRICTS = [
    "school district", "public schools", "board of education", "unified school", "school corporation",
    "county schools", "city schools", "school board", "department of education",
]
BOARD_WORDS = [
    "board of directors", "to the board", "to its board", "board member", "board seat", "joins board",
    "joins the board", "named to board", "elected director", "board appointment", "board chair",
]
CONTROLLER_WORDS = ["controller", "vp accounting", "vp of accounting", "vice president of accounting", "corporate controller"]
CFO_LIKE = [
    "cfo", "chief financial officer", "chief financial", "vp finance", "vp of finance", "vice president finance",
    "vice president of finance", "head of finance", "director of finance", "finance director",
    "chief accounting officer", "chief accountant",
]
FINANCE_LEADERS = CFO_LIKE + CONTROLLER_WORDS
TRIGGER_VERBS = ["appoints", "names", "hires", "welcomes", "taps", "joins as", "promoted to", "elevated to", "hiring", "hire"]
CFO_DESTINATIONS = ["as cfo", "new cfo", "to cfo", "chief financial officer"]
JOB_TITLES = [
    "CFO", "Chief Financial Officer", "VP Finance", "Vice President Finance", "VP of Finance", "Controller",
    "Corporate Controller", "Finance Director", "Director of Finance", "Head of Finance", "Chief Accounting Officer",
    "VP Accounting",
]
OTHER_CONTROLLERS = [
    "air traffic", "document controller", "quality controller", "inventory controller", "stock controller",
    "traffic controller", "controls engineer", "controller technician", "motion controller", "production controller",
    "material controller", "credit controller", "pasteuriz", "machine controller", "process controller",
]
RECRUITERS = [
    "robert half", "vaco", "kforce", "randstad", "aston carter", "michael page", "lhh", "addison group", "beacon hill",
    "jobot", "cybercoders", "creative financial staffing", "korn ferry", "heidrick", "spencer stuart", "staffing",
    "recruit", "headhunt", "executive search", "search partners", "search group", "talent", "personnel", "workforce",
    "employment", "placement",
]
FUND_ITEMS = ["3C", "3C.1"]
FUND_NAMES = [
    " fund", "fund l", "fund,", "fund i", "fund v", "fund x", "partners lp", "partners, lp", "partners l.p",
    "holdings spv", " spv", "capital i", "investments l", "a series of", "series 0", "lending co l", "real assets",
    "acquisition co l", "feeder l", "co-invest", "coinvest",
]
FUND_SIC = ["6722", "6726", "6770"]
BLOCKED_SIC = {
    "1000": "Metal Mining", "1040": "Gold Mining", "1044": "Silver Mining", "1090": "Misc Metal Mining",
    "1311": "Crude Petroleum & Natural Gas", "1381": "Drilling Oil & Gas Wells", "1389": "Oil & Gas Field Services",
    "1400": "Mining & Quarrying — Nonmetallic", "1422": "Crushed & Broken Limestone",
    "1623": "Water/Sewer/Pipeline Construction", "2911": "Petroleum Refining", "2990": "Misc Petroleum Products",
    "3310": "Steel Works & Blast Furnaces", "3312": "Steel Works", "3317": "Steel Pipe & Tubes",
    "3320": "Iron & Steel Foundries", "3330": "Primary Nonferrous Metals", "3334": "Primary Aluminum",
    "3341": "Secondary Smelting & Refining", "3576": "Computer Communications Equipment",
    "3577": "Computer Peripheral Equipment", "3674": "Semiconductors & Related Devices",
    "2834": "Pharmaceutical Preparations", "2835": "In Vitro & In Vivo Diagnostic Substances",
    "2836": "Biological Products (Biotechnology)", "3841": "Surgical & Medical Instruments",
    "3842": "Orthopedic, Prosthetic, & Surgical Appliances", "3845": "Electromedical & Electrotherapeutic Apparatus",
    "8000": "Health Services", "8050": "Nursing & Personal Care Facilities", "8060": "Hospitals",
    "8062": "General Medical & Surgical Hospitals", "8071": "Medical Laboratories", "8090": "Health Services",
    "8731": "Commercial Physical & Biological Research", "4011": "Railroads", "4213": "Trucking",
    "4400": "Water Transportation", "4412": "Deep Sea Foreign Transportation of Freight", "4500": "Air Transportation",
    "4512": "Air Transportation — Scheduled", "4513": "Air Couriers", "4581": "Airports",
    "4700": "Transportation Services", "4731": "Freight Transportation Arrangement",
    "4900": "Electric, Gas, & Sanitary Services", "4911": "Electric Services", "4922": "Natural Gas Transmission",
    "4923": "Natural Gas Distribution", "4924": "Natural Gas Distribution", "4931": "Electric & Other Services Combined",
    "4932": "Gas & Other Services Combined", "4941": "Water Supply", "5812": "Eating Places (Restaurants)",
    "7000": "Hotels & Other Lodging", "7011": "Hotels & Motels", "7990": "Amusement & Recreation Services",
    "7993": "Coin-Operated Amusement Devices", "7997": "Membership Sports & Recreation Clubs",
}
FILING_ITEMS = {
    "5.02": ("Departure/Election of Directors or Officers", "executive_hire"),
    "2.01": ("Completion of Acquisition or Disposition", "merger_acquisition"),
    "1.01": ("Entry into a Material Definitive Agreement", "merger_acquisition"),
}
SIGNALS = [
    ("expands", "Company expansion mentioned"), ("expansion", "Company expansion mentioned"),
    ("growth", "Company growth mentioned"), ("growing", "Company growth mentioned"),
    ("new location", "New location/facility announced"), ("new facility", "New facility announced"),
    ("opens new", "New opening announced"), ("grand opening", "New opening announced"),
    ("relocating", "Company relocation mentioned"), ("headquarters", "Headquarters mentioned"),
    ("award", "Company received award/recognition"), ("winner", "Company received award/recognition"),
    ("recognized", "Company recognized"), ("named top", "Company named as top performer"),
    ("best of", "Company named as top performer"), ("excellence", "Company excellence recognized"),
    ("certification", "Company certification mentioned"), ("certified", "Company certification mentioned"),
    ("new contract", "New contract announced"), ("wins contract", "Contract win announced"),
    ("awarded contract", "Contract award announced"), ("partnership", "Partnership announced"),
    ("partners with", "Partnership announced"), ("strategic alliance", "Strategic alliance announced"),
    ("collaboration", "Business collaboration mentioned"), ("new product", "New product launched"),
    ("launches", "New launch announced"), ("introduces", "New introduction announced"),
    ("unveils", "New unveiling announced"), ("new service", "New service announced"),
    ("ceo", "CEO/leadership mentioned"), ("chief executive", "Leadership mentioned"),
    ("founder", "Founder mentioned"), ("president", "President mentioned"), ("leadership", "Leadership mentioned"),
    ("executive team", "Executive team mentioned"), ("industry leader", "Company positioned as industry leader"),
    ("market leader", "Company positioned as market leader"),
    ("leading provider", "Company positioned as leading provider"),
    ("top provider", "Company positioned as top provider"), ("fastest growing", "Fast growth company"),
    ("inc. 5000", "Inc. 5000 company"), ("inc 5000", "Inc. 5000 company"),
]
ERROR_CLASSES = [
    ("timeout", ["timeout"]), ("rate_limit", ["429", "rate limit"]), ("forbidden", ["403", "forbidden"]),
    ("not_found", ["404", "not found"]), ("server_error", ["500", "502", "503"]),
    ("connection_error", ["connection", "network"]), ("ssl_error", ["ssl", "certificate"]),
    ("parse_error", ["parse", "xml", "json"]),
]
FEED_SOURCES = [
    ("business wire", "business_wire"), ("pr newswire", "pr_newswire"), ("globe newswire", "globe_newswire"),
    ("globenewswire", "globe_newswire"),
]
NAMESPACES = {
    "media": "http://search.yahoo.com/mrss/", "content": "http://purl.org/rss/1.0/modules/content/",
    "dc": "http://purl.org/dc/elements/1.1/", "atom": "http://www.w3.org/2005/Atom",
    "wfw": "http://wellformedweb.org/CommentAPI/", "sy": "http://purl.org/rss/1.0/modules/syndication/",
    "slash": "http://purl.org/rss/1.0/modules/slash/", "georss": "http://www.georss.org/georss",
    "geo": "http://www.w3.org/2003/01/geo/wgs84_pos#", "gd": "http://schemas.google.com/g/2005",
    "thr": "http://purl.org/syndication/thread/1.0", "itunes": "http://www.itunes.com/dtds/podcast-1.0.dtd",
}
ACCOUNT_SUFFIXES = [", inc.", ", inc", " inc.", " inc", ", llc", " llc", ", ltd.", " ltd.", " ltd", " corp.", " corp", " co.", " company"]
UNKNOWN_NAMES = ["", "?", "unknown", "unknown company", "nan", "none", "n/a"]
EVENT_TYPES = ["cfo_hire", "executive_hire", "merger_acquisition", "funding", "expansion", "stable_target", "other"]


# ---------------------------------------------------------------- columns


# What a news search asks for, as (query, type hint, whether the
# territory filter is skipped). Terms of mergers are asked for by region, names of
# industries with each of their suffixes.
NEWS_REGIONS = ["New York", "Boston", "Toronto", "Philadelphia", "Charlotte"]
NEWS_CFO_TERMS = ["CFO appointed", "new CFO", "names CFO", "CFO hire"]
NEWS_MERGER_TERMS = ["acquisition announced", "company acquired", "merger agreement"]
NEWS_INDUSTRIES = ["insurance", "credit union", "wealth management", "private equity", "nonprofit", "foundation", "auto dealership", "real estate brokerage"]
NEWS_INDUSTRY_SUFFIXES = [("CFO", "cfo_hire"), ("acquisition", "merger_acquisition")]
NEWS_QUERIES = [
    ("new controller appointed", "cfo_hire", False),
    ('"VP of Finance" appointed', "cfo_hire", False),
    ("site:linkedin.com CFO appointed", "cfo_hire", True),
    ('site:linkedin.com "excited to announce" CFO', "cfo_hire", True),
    ('site:linkedin.com "new role" CFO finance', "cfo_hire", True),
    ('site:linkedin.com "thrilled to join" CFO', "cfo_hire", True),
    ('site:linkedin.com "joined as" CFO', "cfo_hire", True),
    ('site:linkedin.com "Chief Financial Officer"', "cfo_hire", True),
    ('site:linkedin.com "started a new position" CFO', "cfo_hire", True),
    ('site:linkedin.com "started a new position" "Chief Financial Officer"', "cfo_hire", True),
    ('site:linkedin.com "happy to share" CFO', "cfo_hire", True),
    ('site:linkedin.com "proud to announce" CFO', "cfo_hire", True),
    ('site:linkedin.com "delighted to announce" CFO', "cfo_hire", True),
    ('site:linkedin.com "pleased to share" CFO finance', "cfo_hire", True),
    ('site:linkedin.com "new chapter" CFO', "cfo_hire", True),
    ('site:linkedin.com "I\'m happy to announce" finance', "cfo_hire", True),
    ('site:linkedin.com "VP of Finance" "joined"', "cfo_hire", True),
    ('site:linkedin.com "Head of Finance" "excited"', "cfo_hire", True),
    ('site:linkedin.com "Controller" "new role"', "cfo_hire", True),
    ('site:linkedin.com "Finance Director" "joined"', "cfo_hire", True),
    ('site:linkedin.com/posts "CFO" "appointed"', "cfo_hire", True),
    ('site:linkedin.com/posts "Chief Financial Officer"', "cfo_hire", True),
    ('site:linkedin.com/posts "excited to announce" CFO', "cfo_hire", True),
    ('site:linkedin.com/posts "VP Finance" "new role"', "cfo_hire", True),
    ("site:linkedin.com/pulse CFO appointed", "cfo_hire", True),
    ('site:linkedin.com/pulse "Chief Financial Officer"', "cfo_hire", True),
    ("site:linkedin.com acquisition announced", "merger_acquisition", True),
    ('site:linkedin.com "pleased to announce" acquisition', "merger_acquisition", True),
    ('site:linkedin.com/posts "acquisition" "pleased to announce"', "merger_acquisition", True),
    ('site:linkedin.com/posts "acquired" "excited"', "merger_acquisition", True),
    ("site:linkedin.com funding round raised", "funding", True),
    ('site:linkedin.com/posts "raised" "funding"', "funding", True),
    ("site:crunchbase.com series funding", "funding", False),
    ("site:crunchbase.com acquisition", "merger_acquisition", False),
    ("site:news.crunchbase.com raises", "funding", False),
    ("site:news.crunchbase.com acquired", "merger_acquisition", False),
    ('"private equity" "portfolio company" CFO', "cfo_hire", True),
    ('"PE-backed" CFO appointed', "cfo_hire", True),
    ('"platform company" CFO', "cfo_hire", True),
    ('"add-on acquisition"', "merger_acquisition", True),
    ('"bolt-on acquisition"', "merger_acquisition", True),
    ('"interim CFO"', "cfo_hire", False),
    ('"fractional CFO"', "cfo_hire", False),
    ('"acting CFO"', "cfo_hire", False),
    ('"CFO transition"', "cfo_hire", False),
    ('"CFO search"', "cfo_hire", False),
    ('"new headquarters" OR "relocating headquarters"', "other", False),
    ('"office expansion" OR "expanding operations"', "other", False),
    ('"opened new office"', "other", False),
    ('"launches new product" OR "new product launch"', "other", False),
    ('"launches new service" OR "new service offering"', "other", False),
    ('"enters new market" OR "market expansion"', "other", False),
    ('"new business line" OR "new division"', "other", False),
    ('"pleased to announce the launch"', "other", False),
    ('"expands into" OR "expanding into"', "other", False),
    ('site:techcrunch.com "series A"', "funding", True),
    ('site:techcrunch.com "series B"', "funding", True),
    ('site:techcrunch.com "raises" million', "funding", True),
]


def words(values: Iterable[str]) -> Column:
    """An array literal: one constant, whatever the list's length."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def mapping(values: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def holds_any(text: Column, values: Iterable[str]) -> Column:
    """Whether the (already lower-cased) text contains any of the values."""
    values = list(values)
    if not values:
        return F.lit(False)
    # A null text holds nothing that is known: null, as for contains.
    return once(text, lambda t: F.exists(words(values), lambda v: F.contains(t, v)))


def held(text: Column, values: Iterable[str]) -> Column:
    """The values that the lower-cased text contains, in list order."""
    values = list(values)
    return once(text, lambda t: F.filter(words(values), lambda v: F.contains(t, v)))


def first_held(text: Column, values: Iterable[str]) -> Column:
    return F.get(held(text, values), 0)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where `use` names the value several times: it is computed
    once, as the only element of an array, and not copied into the plan."""
    return F.get(F.transform(F.array(value), use), 0)


def made(df: DataFrame) -> DataFrame:
    """The same rows, with every column made here, once. A filter that is put
    on them stays above; else it is moved below, with a copy of what makes a
    column in place of each of its names, and evaluates every copy."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))
