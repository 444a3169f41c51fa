"""Selectors: the automaton against a tree walk, event records, container rows, addresses."""

from __future__ import annotations

import datetime as dt
import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from marquee.sources import selectors
from marquee.sources.selectors import VOID, Automaton, Take, container_rows, event_records, page_urls, resolved

PAGE = """<html><head><meta property="og:url" content="https://example.com/events/jazz"><link rel="stylesheet" href="x.css">
<title>T &amp; U</title><script>var a = "<h1>no</h1>";</script></head><body>
<h1 class="event-title">Jazz Night at <b>Blue</b> Note</h1><div class="event-date">March 15, 2024 8:00 PM</div>
<div class="venue"><div class="inner">Blue <div>Note</div> NYC</div></div><div class="address">131 W 3rd St, New York, NY</div>
<div class="price">$25.00</div><div class="artists">John Doe Trio, Jane Smith</div><div class="genre">Jazz</div>
<a href="/tickets/123" class="ticket-link">Buy</a><div class="poster"><img src="/i/p.jpg"><img src="/i/p.jpg"></div>
<ul id="list"><li class="row"><a href="/a">One</a> <i>x</i><li class="row odd"><a href="/b">Two</a><p>p1<p>p2</ul></body>"""


class _Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def text(self):
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids if isinstance(k, str) or k.tag not in ("script", "style"))

    def below(self):
        for k in self.kids:
            if not isinstance(k, str):
                yield k
                yield from k.below()


class _Tree(HTMLParser):
    """A tree of balanced pages."""

    def __init__(self, page):
        super().__init__()
        self.root = self.at = _Node("", {}, None)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        n = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(n)
        if tag not in VOID:
            self.at = n

    def handle_endtag(self, tag):
        self.at = self.at.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def _fits(n, part):
    tag = re.match(r"[a-z]+", part)
    return (not tag or n.tag == tag[0]) and all(c in n.attrs.get("class", "").split() for c in re.findall(r"\.(\w+)", part))


def _hits(n, parts):
    """Whether ``n`` ends the chain ``parts`` of compounds and combinators."""
    if not _fits(n, parts[-1]):
        return False
    if len(parts) == 1:
        return True
    link, rest = parts[-2], parts[:-2]
    sibs = [k for k in n.parent.kids if not isinstance(k, str)]
    before = sibs[: sibs.index(n)]
    if link == ">":
        return n.parent.tag != "" and _hits(n.parent, rest)
    if link == "+":
        return bool(before) and _hits(before[-1], rest)
    if link == "~":
        return any(_hits(b, rest) for b in before)
    up = n.parent
    while up.tag:
        if _hits(up, rest):
            return True
        up = up.parent
    return False


def _random_page(r, depth=0):
    out = ""
    for _ in range(r.randint(0, 4 if depth < 5 else 0)):
        tag, cls = r.choice(["div", "span", "b"]), " ".join(r.sample("xyz", r.randint(0, 2)))
        out += f't{r.randint(0, 9)}<{tag} class="{cls}">{_random_page(r, depth + 1)}</{tag}>' if r.random() < 0.9 else '<img class="x">'
    return out + f"e{r.randint(0, 9)}"


def test_automaton_equals_a_tree_walk():
    r = random.Random(3)
    chains = [["div"], [".x"], ["div", " ", ".y"], [".x", ">", "span"], ["div", "+", "div"], [".x", "~", "b.y"], ["div", " ", "div", ">", ".z"], [".x", " ", ".x", " ", ".x"], ["span", "+", ".x", " ", "b"]]
    selectors = ["".join(c) for c in chains]
    a = Automaton({str(k): Take((s,), many=True) for k, s in enumerate(selectors)})
    found = 0
    for _ in range(60):
        page = _random_page(r)
        got = a.run(page)[0]
        nodes = list(_Tree(page).root.below())
        want = [[t for n in nodes if _hits(n, c) and (t := n.text().strip())] for c in chains]
        assert got == want
        found += sum(map(len, got))
    assert found > 500


def test_selectors_with_attributes_places_and_lists():
    take = lambda *s, **k: Take(s, **k)
    a = Automaton({"odd": take("li.odd > a", what="href"), "second": take("#list li:nth-child(2) a"), "first": take("ul > :first-child a"), "starts": take("a[href^='/t']", what="class"), "both": take("h1, .genre", many=True), "ps": take("li p", many=True), "html": take("h1", what="innerHTML"), "none": take(".absent", "title"), "script": take("script")})
    assert a.run(PAGE) == [["/b", "Two", "One", "ticket-link", ["Jazz Night at Blue Note", "Jazz"], ["p1", "p2"], "Jazz Night at <b>Blue</b> Note", "T & U", 'var a = "<h1>no</h1>";']]
    assert a.run(None) == a.run("") == a.run("<") == [[None, None, None, None, [], [], None, None, None]]
    for bad in ("a:has-text('x')", "> a", "", "a >> b"):
        with pytest.raises(ValueError):
            Automaton({"x": take(bad)})


def test_event_records(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<div>unclosed div"), (3, None), (4, '<p class=date>x</p><time datetime="2024-05-01T20:00:00Z">soon</time><a href="?buy=1">b</a>')], "page_id long, html string")
    rows = {r.page_id: r for r in event_records(pages, dt.date(2024, 1, 1)).collect()}
    r = rows[1]
    assert (r.title, r.venue, r.address, r.price) == ("Jazz Night at Blue Note", "Blue Note NYC", "131 W 3rd St, New York, NY", "25.00")
    assert (r.artists, r.genres, r.tickets_url, r.event_url, r.image_urls) == (["John Doe Trio", "Jane Smith"], ["Jazz"], "/tickets/123", "https://example.com/events/jazz", ["/i/p.jpg"])
    assert r.date_start == dt.datetime(2024, 3, 15, 20)
    assert rows[2].title is None and rows[3].title is None and rows[2].image_urls == []
    assert rows[4].date_start is not None and rows[4].tickets_url == "?buy=1"
    own = event_records(pages, dt.date(2024, 1, 1), {"title": (".absent", ".genre")}).where("page_id = 1").first()
    assert own.title == "Jazz"


def test_container_rows(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    fields = {"name": {"selector": "a", "transform": "uppercase"}, "url": {"selector": "a", "attribute": "href"}, "notes": {"selector": "p, i", "multiple": True}, "odd": {"selector": "b", "required": True, "fallback": "?"}}
    rows = container_rows(pages, "li.row", fields).orderBy("place").collect()
    assert [(r.page_id, r.place, r.name, r.url, r.notes, r.odd) for r in rows] == [(1, 0, "ONE", "/a", ["x"], "?"), (1, 1, "TWO", "/b", ["p1", "p2"], "?")]
    nested = spark.createDataFrame([(1, "<div class=c>a<div class=c><a>in</a></div><a>out</a></div>")], "page_id long, html string")
    assert [r.t for r in container_rows(nested, ".c", {"t": {"selector": "a", "multiple": True}}).orderBy("place").collect()] == [["in", "out"], ["in"]]


def test_addresses(spark):
    base = "https://example.com/a/b.html"
    urls = ["https://x.org/y", "/p/../q", "c/d", "../e", "?f=1", "#g", "//h.org/i", "mailto:a@b", "./", "j?k=/../l", ".."]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", resolved(F.col("u"), base).alias("r")).collect()
    assert {r.u: r.r for r in rows} == {u: urljoin(base, u) for u in urls}
    assert spark.createDataFrame([("http://",)], "u string").select(resolved(F.col("u"), base)).first()[0] is None
    got = page_urls(spark.createDataFrame([(1, PAGE)], "page_id long, html string"), ("a", "img"), "https://example.com").first()
    assert got.urls == ["https://example.com/tickets/123", "https://example.com/a", "https://example.com/b", "https://example.com/i/p.jpg"]


def test_few_pages_are_python_objects_at_once():
    """400 pages of 50 KB: what is held beside Arrow is less than a fifth of them."""
    import tracemalloc

    import pyarrow as pa

    fields = {"title": selectors.Take(("h1",))}
    pages = pa.array([f"<h1>T{i}</h1><p>" + "x" * 50_000 for i in range(399)] + [None])
    tracemalloc.start()
    got = selectors._run(pages, fields, None).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [g["title"] for g in got] == [f"T{i}" for i in range(399)] + [None] and peak < 4_000_000
    assert [len(rows) for rows in selectors._run(pages.slice(0, 40), fields, "h1").to_pylist()] == [1] * 40
