"""Main text against another parser, with and without marks; time in proportion."""

import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from marlstone.llm import pages, queries
from tests.oracle import duck

BIG = "/root/testdata/sf0.1"


class Reference(HTMLParser):
    """Lines of the article of a page of the driver's table, by the standard parser."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines = 0, [""]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("article", "p", "h1"):
            self.lines.append("")
        elif tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("article", "p", "h1"):
            self.lines.append("")

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data

    @property
    def text(self):
        return "\n".join(x for x in (" ".join(line.split()) for line in self.lines) if x)


@pytest.fixture(scope="module")
def source():
    return duck(BIG).execute("SELECT page_id, url, html FROM pages").fetchall()


def _host(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


def test_all_pages(spark, source):
    got = {r.page_id: r for r in queries.op1_html_template(spark, BIG).collect()}
    assert len(got) == len(source)
    for k, url, html in source:
        text = Reference(html or "").text
        assert (got[k].url, got[k].text, got[k].n_chars) == (url, text, len(text))


def _bare(html):
    """A page without any mark: every box is a plain div."""
    html = re.sub(r"<(/?)(?:nav|article|footer|aside|header|main|section)\b[^>]*>", r"<\1div>", html or "")
    return re.sub(r" (?:class|id|role)=\"[^\"]*\"", "", html)


def test_pages_without_marks(spark, source):
    """On hosts of several pages the template alone finds the article; with no
    classes nothing tells it from the rest."""
    size = Counter(_host(u) for _, u, _ in source)
    rows = [(k, u, _bare(h)) for k, u, h in source]
    assert not any(re.search("<(?:nav|article|footer)|class=", h) for _, _, h in rows)
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)).collect()}
    large = [(k, h) for k, u, h in source if size[_host(u)] >= 8]
    whole = [got[k] == Reference(h or "").text for k, h in large]
    assert len({_host(u) for k, u, _ in source if size[_host(u)] >= 8}) >= 20 and len(large) > 1000
    assert sum(whole) >= 0.97 * len(whole)
    texts = {k: t for k, _, t in rows}
    without = [pages.main_text(texts[k], []) == Reference(h or "").text for k, h in large]
    assert sum(without) < 0.01 * len(without)


def test_hosts_of_several_templates(spark):
    """Sections of a host with templates of their own, all of plain divs."""

    def page(i):
        own = "".join(f"<p>story {i} part {k} is told here at some length, as stories are</p>" for k in range(4))
        head, menu, foot = f"<h2>Title {i}</h2>", f"<ul><li><a href='/{i}'>link {i}</a><li><a href='/x'>more {i}</a></ul>", f"<i>seen {i} times</i>"
        if i % 3 == 0:
            return f"<body><div>{menu}</div><div>{head}{own}</div><div>All rights reserved {foot}</div></body>"
        if i % 3 == 1:
            return f"<body><table><tr><td>{menu}<td>{head}{own}<td>advert {i}</table></body>"
        return f"<body><div><div>Shop</div><div>{menu}</div></div><div><div>{head}<div>{own}</div></div><div>Call us {foot}</div></div></body>"

    df = spark.createDataFrame([(i, f"https://big.example/{i}", page(i)) for i in range(60)], "page_id long, url string, html string").repartition(3)
    got = pages.extract(df).collect()
    assert sorted(map(repr, pages.extract(df, broadcast_bytes=0).collect())) == sorted(map(repr, got))
    for r in got:
        own = [f"story {r.page_id} part {k} is told here at some length, as stories are" for k in range(4)]
        assert r.text.split("\n") == [f"Title {r.page_id}", *own]


@pytest.mark.parametrize(
    "make",
    [
        lambda n: "<div>" * n + "x" + "</div>" * n,
        lambda n: "<b>" * n + "<p>x</i></em>" * n,
        lambda n: "<div><span>" * n + "</section></article>" * n,
        lambda n: "<ul><li>a" * n + "</ol>" * n,
        lambda n: "<p>text &amp; more</b> " * n,
        lambda n: "<table><tr><td>" * n + "</th>" * n,
        lambda n: "<article>" * n + "<h2 id='related'>x</h2>" * n,
    ],
)
def test_time_in_proportion(make):
    def took(n):
        source = make(n)
        best = 9e9
        for _ in range(3):
            began = time.perf_counter()
            pages.main_text(source, [])
            best = min(best, time.perf_counter() - began)
        return best

    took(500)
    assert took(24_000) < 16 * took(4_000) + 0.05


def test_crossed_tags():
    def text(source):
        return pages.main_text(source, [])

    assert text("<div><b>a<p>b</b>c</p></div>d") == "a\nbc\nd"
    assert text("<ul><li>a<ul><li>b</ul><li>c</ul>") == "a\nb\nc"
    assert text("<nav>x</nav></nav></nav><p>y</p>") == "y"
    assert text("<table><tr><td>a<table><tr><td>b</table>c</table>") == "a\nb\nc"
