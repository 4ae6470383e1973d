import json
import random
import re
import time

import duckdb
import pytest

import corpus_pipeline
from tidewell.llm import html_text, jaccard, mixing

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    from tidewell.llm import _common

    for name, f in corpus_pipeline.STAGES:
        out.append(_common.staged(f(spark, out[-1], DATA), "t"))
    return out


def test_columns_and_effects(stages):
    docs = stages[0]
    for df in stages[1:-1]:
        assert df.columns == docs.columns
    counts = [df.count() for df in stages]
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0
    assert set(stages[-1].columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert counts[5] == counts[4]


def test_filters_agree_with_labels(stages):
    labels = dict((i, (q, t)) for i, q, t in duckdb.sql(f"select doc_id, quality, toxic from '{DATA}/labels.parquet'").fetchall())
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in stages[:3]]
    good = {i for i, (q, _) in labels.items() if q}
    assert len(good - ids[1]) <= 0.02 * len(good)
    junk = {i for i, (q, _) in labels.items() if not q}
    assert len(junk & ids[1]) <= 0.1 * len(junk)
    clean = {i for i, (q, t) in labels.items() if not t} & ids[1]
    assert len(clean - ids[2]) <= 0.02 * len(clean)


def test_no_near_duplicates_left(stages):
    def sh(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    before = {r.doc_id: sh(r.text) for r in stages[2].collect()}
    after = {r.doc_id for r in stages[3].collect()}
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    left = sorted(after)
    assert not any(near(before[a], before[b]) for i, a in enumerate(left) for b in left[:i])
    # What went has a chain of links to something that stayed.
    reach, grown = set(after), True
    while grown:
        new = {d for d in before if d not in reach and any(near(before[d], before[r]) for r in reach)}
        reach |= new
        grown = bool(new)
    assert reach == set(before)


def test_mix_repeats_documents(stages):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before, after = {}, {}
    for side, df in ((before, stages[3]), (after, stages[4])):
        for r in df.collect():
            side[r.source] = side.get(r.source, 0) + words(r.text)
    goal = mixing.targets({s: before[s] for s in sorted(before)}, [3, 1, 2], 1.5, 2)
    longest = max(words(r.text) for r in stages[3].collect())
    assert all(abs(after.get(s, 0) - goal[s]) <= longest for s in goal)


def test_odd_rows_and_columns(spark, tmp_path):
    """Nulls in any column, repeated rows, clashing names, an empty table."""
    text = " ".join(f"word{i} and" for i in range(40))
    rows = [(1, text, "en", "a", 5, "x"), (1, text, "en", "a", 5, "x"), (None, None, None, None, None, None), (2, "", "en", None, 0, "y"), (3, text + " end", None, "b", 7, None), (4, "Another short text.", "de", "b", 3, "z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, {} string"
    spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, empty in (("size", False), ("_id", True)):
        docs = spark.createDataFrame([] if empty else rows, schema.format(name))
        df = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, str(tmp_path))
            assert df.columns == docs.columns
            df = spark.createDataFrame(df.collect(), docs.schema)


def test_first_of_each_with_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    data = [(5, text, "x"), (5, text, "y"), (None, text + " end", "z"), (7, "", "e"), (8, None, "e"), (9, "alone in here", "a")]
    df = spark.createDataFrame(data, "doc_id long, text string, _c string").withColumnRenamed("_c", "component_id")
    got = jaccard.first_of_each(df).collect()
    assert len(got) == 4 and sorted(r.component_id for r in got)[:1] == ["a"]


# ---------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="wrap"><p>{promo}</p>{body}</div>
<div id="comments"><p>I disagree</p></div><aside>Side</aside><form><input name=q>Search</form><footer>&copy; me</footer></body></html>"""


def test_extraction_of_an_article():
    body = "<article><header><h1>Head &amp;\n line</h1></header><p>One <b>bold</b><br>two<p>Three&nbsp;four <a href=x>link</a><div class=share>Share</div><ul><li>a<li>b</ul></article><p>outside"
    assert html_text.extract(PAGE.format(promo="x", body=body))[0] == "Head & line\n\nOne bold two\n\nThree four link\n\na\n\nb"


def test_without_article_and_broken():
    assert html_text.extract(PAGE.format(promo="kept", body="<p>a < b and c</p><div>tail"))[0].startswith("kept\n\na < b and c")
    for page in ("", "<", "<p", "</b></p>x", "<script>never closed", "<!-- open", "<a b='c", "<div>" * 3000 + "deep"):
        assert isinstance(html_text.extract(page)[0], str)
    assert html_text.extract("<div>" * 3000 + "deep")[0] == "deep"


def test_long_broken_pages_take_linear_time():
    begin = time.process_time()
    for page in ("<b>" * 20_000 + "<p>x" * 20_000, "<div>" * 20_000 + "x", "<b><p>" + "<i></b>" * 40_000, "<li><ul>" * 20_000):
        html_text.skeleton(html_text.parse(page))
        html_text.extract(page)
    assert time.process_time() - begin < 20


def test_a_short_article_in_a_list_keeps_the_page():
    page = "<body><article><p>teaser</p></article>" + "".join(f"<div><p>item {k} of a long list of items</p></div>" for k in range(9)) + "</body>"
    assert html_text.extract(page)[0].count("list of items") == 9


def test_constant_runs_are_template(spark):
    rows = []
    for i in range(40):
        body = "".join(f"<p>story {i} part {k} says {i * k}</p>" for k in range(3 + i % 3))
        rows.append((i, f"https://a.example/{i}", PAGE.format(promo="Best site of the year", body=body)))
    rows += [(100 + i, "http://b.example/x", PAGE.format(promo="Unlike the rest", body="<p>copied story</p>")) for i in range(9)]
    rows += [(200, None, None), (201, "no url", ""), (202, "https://a.example/1", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert len(got) == len(rows)
    assert got[4] == "\n\n".join(f"story 4 part {k} says {4 * k}" for k in range(4))
    assert got[100] == "Unlike the rest\n\ncopied story"
    assert got[200] == got[201] == got[202] == ""
    assert html_text.main_text(df.limit(0)).count() == 0


def test_joined_templates_say_the_same(spark, monkeypatch):
    rows = [(i, f"https://a.example/{i}", PAGE.format(promo="Best site", body=f"<p>story {i} tells of {i * i}</p>")) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    few = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    monkeypatch.setattr(html_text, "BROADCAST_KEYS", -1)
    assert {r.page_id: r.text for r in html_text.main_text(df).collect()} == few
    assert few[3] == "story 3 tells of 9"


def _unmarked(i: int) -> str:
    """A page without classes, marks or an article: the wrapper is told by
    alignment alone."""
    story = "".join(f"<p>story {i} part {k} tells of {i * k} and of {i + k}</p>" for k in range(4 + i % 3))
    return f"<html><body><div><p>Welcome to the site</p><p>Page {i % 2}</p></div><section><h2>Title {i}</h2>{story}<p>Read on and be merry</p></section><div><p>All rights are ours</p></div></body></html>"


@pytest.mark.parametrize("n", [2, 3, 40])
def test_pages_without_marks(spark, n):
    rows = [(i, "http://plain.example/p", _unmarked(i)) for i in range(n)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        i = r.page_id
        assert r.decided == "template"
        assert r.text == "\n\n".join([f"Title {i}", *(f"story {i} part {k} tells of {i * k} and of {i + k}" for k in range(4 + i % 3))])


def test_two_layouts_of_equal_share(spark):
    other = lambda i: f"<html><body><main><p>Welcome to the shop</p><p>thing {i} costs {i * 7} and weighs {i * 3}</p><p>It is number {i} of many</p></main></body></html>"
    rows = [(i, "http://two.example/p", _unmarked(i) if i % 2 else other(i)) for i in range(16)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Welcome" not in t and "rights" not in t for t in got.values())
    assert got[4] == "thing 4 costs 28 and weighs 12\n\nIt is number 4 of many"


def best_alignment(a, b):
    """Plain simple tree matching, from its definition."""
    if a[0] != b[0]:
        return 0
    if a[0] == "#":
        return 2 if a[1] == b[1] else 1
    x, y = a[2], b[2]
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + best_alignment(x[i], y[j]))
    return 1 + m[-1][-1]


def test_simple_tree_matching(monkeypatch):
    rng = random.Random(8)

    def block(depth):
        if not depth or rng.random() < 0.3:
            return f"<p>{rng.choice('abcdef')}</p>"
        tag = rng.choice(["div", "section"])
        return f"<{tag}>" + "".join(block(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    for _ in range(60):
        a, b = (json.loads(html_text.skeleton(html_text.parse("".join(block(3) for _ in range(4))))) for _ in range(2))
        keys = set()
        score = html_text.same_runs(a, b, keys)
        assert keys <= set(html_text.leaves(a)) & set(html_text.leaves(b))
        assert abs(score - best_alignment(a, b)) <= max(3, 0.35 * score)
    items = [f"<p>line {k}</p>" for k in range(400)]
    a, b = (json.loads(html_text.skeleton(html_text.parse("".join([f"<p>own {n}</p>", *items[:200], f"<p>other {n}</p>", *items[200:], f"<p>end {n}</p>"])))) for n in range(2))
    monkeypatch.setattr(html_text, "CELLS", 100)
    keys = set()
    html_text.same_runs(a, b, keys)
    assert len(keys) == 400


def _skeletons(pages):
    return [html_text.skeleton(html_text.parse("".join(f"<div>{r}</div>" for r in p))) for p in pages]


def test_template_where_boilerplate_outweighs_content():
    fixed = [f"Line {k} of the wrapper stays as it is" for k in range(7)]
    keys = {html_text.key("/div", f) for f in fixed}
    for n in (3, 8):
        pages = [[*fixed, " ".join(f"w{i}x{k}" for k in range(9)), f"short {i} text"] for i in range(n)]
        assert set(html_text.induce(_skeletons(pages))[0]) == keys


def test_near_copies_are_no_template():
    article = [" ".join(f"p{k}w{j}" for j in range(20)) for k in range(7)]
    last = [f"e{j}" for j in range(20)]
    copies = [[*article, " ".join([*last[:i], f"edit{i}", *last[i + 1 :]])] for i in range(5)]
    other = [[" ".join(f"q{i}w{j}" for j in range(20))] for i in range(2)]
    for pages in (copies, copies[:3] + other[:1], copies + other):
        assert html_text.induce(_skeletons(pages))[0] == []
