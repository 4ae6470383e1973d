"""Wrapper induction decides, loses no text of an article, and ends in time."""

import collections
import html
import re
import time

import duckdb
import pytest

from tidewell.llm import html_text as H


def induced(pages):
    """Templates of pages of one host, by layout."""
    by = collections.defaultdict(list)
    for p in pages:
        root = H.parse(p)
        by[H.outline(root)].append(H.skeleton(root))
    out = {}
    for layout, found in by.items():
        constant, template = H.induce(sorted(set(found), key=lambda t: H.key("", t))[: H.REFERENCES])
        if template:
            out[layout] = frozenset(constant), template
    return out


def said(i, what, n=12):
    return " ".join(f"w{i}{what}{k}" for k in range(n))


def blocks(page, templates):
    return H.extract(page, templates)[0].split("\n\n")


def test_lead_beside_the_container_stays():
    page = lambda i: f'<div class="wrapper"><h1>T{i}</h1><p>{said(i, "lead")}</p><div class="bd">{"".join(f"<p>{said(i, k)}</p>" for k in range(8))}</div></div>'
    pages = [page(i) for i in range(8)]
    templates = induced(pages)
    assert templates
    assert blocks(pages[3], templates) == ["T3", said(3, "lead"), *(said(3, k) for k in range(8))]
    assert blocks(page(90), templates)[1] == said(90, "lead")


@pytest.mark.parametrize("menu", ["<div><ul>{0}</ul></div>", "<div>{1}</div>", "<div><p>{1}</p></div>"])
def test_varying_menu_beside_the_container_goes(menu):
    def page(i):
        links = [f"<a href=x>link {i} {k}</a>" for k in range(6)]
        return f"<body>{menu.format(''.join(f'<li>{x}</li>' for x in links), ' '.join(links))}<div><h1>T{i}</h1>{''.join(f'<p>{said(i, k)}</p>' for k in range(6))}</div><div>{said(i, 'foot', 4)}</div></body>"

    pages = [page(i) for i in range(8)]
    assert blocks(pages[2], induced(pages)) == ["T2", *(said(2, k) for k in range(6))]


@pytest.mark.parametrize("name", "tags related alert widget skip promo notice social".split())
def test_class_names_drop_nothing_in_an_article(name):
    page = lambda i: f'<nav><a href=x>menu</a></nav><article><h1>T{i}</h1><p>{said(i, 0)}</p><div class="{name}">{said(i, "in")}</div><aside><p>{said(i, "quote")}</p></aside><p>{said(i, 2)}</p><div class="{name}"><a href=x>{said(i, "links")}</a></div></article><div class="{name}">{said(i, "out")}</div>'
    pages = [page(i) for i in range(4)]
    want = ["T1", said(1, 0), said(1, "in"), said(1, "quote"), said(1, 2)]
    assert blocks(pages[1], None) == want and blocks(pages[1], induced(pages)) == want


def test_strong_marks_count_in_an_article():
    page = f'<article><p>{said(1, 0)}</p><div class="comments"><p>{said(1, "comment")}</p></div><div class="ad">{said(1, "ad")}</div><form>{said(1, "form")}</form></article>'
    assert blocks(page, None) == [said(1, 0)]


def test_optional_elements_and_new_ones():
    """Pages with a notice that others lack, and with more than any reference."""
    def page(i, extra=""):
        notice = f"<div>{said(i, 'notice', 3)}</div>" if i % 2 else ""
        return f"<body><div><section><div>{said(i, 'top', 3)}</div>{notice}<div><h2>T{i}</h2>{''.join(f'<p>{said(i, k)}</p>' for k in range(4 + i % 3))}{extra}</div></section></div></body>"

    pages = [page(i) for i in range(8)]
    templates = induced(pages)
    for i in range(8):
        assert blocks(pages[i], templates) == [f"T{i}", *(said(i, k) for k in range(4 + i % 3))]
    extra = f"<blockquote>{said(50, 'cited')}</blockquote><div><p>{said(50, 'boxed')}</p></div><div><a href=x>{said(50, 'links')}</a></div>"
    assert blocks(page(50, extra), templates) == ["T50", *(said(50, k) for k in range(6)), said(50, "cited"), said(50, "boxed")]


def _want(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    found = [html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:h1|p)>", inner)]
    return "\n\n".join(x for x in (re.sub(r"\s+", " ", b).strip() for b in found) if x)


def _without_marks(page):
    page = re.sub(r"<(/?)(article|main|nav|header|footer|aside|form|section)\b", r"<\1div", page)
    return re.sub(r"<(div|p|ul|li|span)\s[^>]*>", r"<\1>", page)


def test_given_pages_without_marks():
    """Tags of meaning, classes and ids taken away: alignment is what is left.
    Templates change some pages, and for the better."""
    rows = duckdb.sql("select regexp_extract(url, '://([^/]*)', 1), html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    hosts = collections.defaultdict(list)
    for host, page in rows:
        hosts[host].append((_without_marks(page), _want(page)))
    right = alone = changed = 0
    for pages in hosts.values():
        templates = induced([p for p, _ in pages])
        for page, want in pages:
            with_, without = H.extract(page, templates)[0], H.extract(page)[0]
            right, alone, changed = right + (with_ == want), alone + (without == want), changed + (with_ != without)
    assert right >= 0.98 * len(rows) and right >= alone and changed > 0


def test_plain_paragraphs_need_templates():
    """Text in elements without names only: every page changes by its template."""
    page = lambda i: f"<body><div><div>{said(i, 'top', 3)}</div><div>{said(i, 'top2', 4)}</div></div><div>{''.join(f'<div>{said(i, k)}</div>' for k in range(9))}</div><div>{said(i, 'foot', 5)}</div></body>"
    pages = [page(i) for i in range(8)]
    templates = induced(pages)
    for i, p in enumerate(pages):
        assert blocks(p, templates) == [said(i, k) for k in range(9)] != blocks(p, None)


@pytest.mark.parametrize("rows, items", [(50, 10), (150, 10), (400, 3), (1, 3000)])
def test_list_pages_end_in_time(rows, items):
    page = lambda i: "<body><div>" + "".join(f"<div>{''.join(f'<li>item {i} {d} {k} {said(i, d * k, 4)}</li>' for k in range(items))}</div>" for d in range(rows)) + "</div></body>"
    a, b = (H.tree(H.parse(page(i))) for i in (1, 2))
    begin = time.perf_counter()
    H.same_runs(a, b, set())
    assert time.perf_counter() - begin < 1
    assert len(blocks(page(1), induced([page(i) for i in range(3)]))) == rows * items
