"""Fields of pages by CSS selectors: all selectors compiled to one stack automaton, a pass over a page's tags.

A selector is a chain of compounds. Each compound of each chain has a bit; an element's bits say which
chains have come that far with it. Whether a chain goes on at an element is read from the bits of its parent
(child), of all elements open around it (descendant), of the sibling before it (``+``) or of all before it
(``~``), which the stack keeps for each open element, so nested elements of equal tags and unclosed ones are
right and nothing is read twice. Supported: tags, ``*``, ``#id``, ``.class``, ``[a]``, ``[a=v]`` and its
``* ^ $ ~ |`` forms, ``:first-child``, ``:nth-child(n)``, the four combinators and commas; others raise
``ValueError`` when compiled, on the driver.

Tags: elements without an end, raw text and the usual implied ends (``p``, ``li``, table parts) are
known; formatting elements are not opened again in later blocks.
Defined cases: a null or empty page has no elements; broken tags are text; attributes' and texts' entities are resolved.
"""

from __future__ import annotations

import datetime as dt
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from marquee.functions import dates, event_dates, extract
from marquee.functions.extract import page_text, transformed
from marquee.functions.text import collapse

# fixed values of HTML: elements without an end tag, with raw text, and what ends which open element
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDED_BY = {"p": _BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"])}
#: An implied end looks no further out than these.
_WALLS = frozenset(["ul", "ol", "table", "dl", "select", "body", "div", "td", "th"])

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*+"|'[^']*+'|[^>"']++)*+)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PART = re.compile(r"""(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s]+))\s*)?\]|:(?:(?P<first>first-child)|nth-child\(\s*(?P<nth>\d+)\s*\))""")
_TESTS = {"=": str.__eq__, "*=": lambda a, v: bool(v) and v in a, "^=": lambda a, v: bool(v) and a.startswith(v), "$=": lambda a, v: bool(v) and a.endswith(v), "~=": lambda a, v: v in a.split(), "|=": lambda a, v: a == v or a.startswith(v + "-")}


@dataclass(frozen=True)
class Take:
    """What a field takes: of the first selector whose first element gives something (or, with ``many``, of all elements), its text, an attribute, ``innerHTML`` or ``url`` (href, else src)."""

    selectors: tuple[str, ...]
    what: str = "text"
    many: bool = False


@dataclass
class _Compound:
    tag: str | None = None
    ident: str | None = None
    classes: list[str] = field(default_factory=list)
    attrs: list[tuple[str, str | None, str]] = field(default_factory=list)
    nth: int | None = None

    def fits(self, attrs: dict[str, str], classes: list[str], place: int) -> bool:
        if self.nth is not None and self.nth != place or self.ident is not None and attrs.get("id") != self.ident:
            return False
        if any(c not in classes for c in self.classes):
            return False
        return all(a in attrs and (op is None or _TESTS[op](attrs[a], v)) for a, op, v in self.attrs)


def _chains(selector: str) -> Iterator[list[tuple[str, _Compound]]]:
    """The chains of a selector: (combinator before it, compound)."""
    for one in re.split(r""",(?=(?:[^"']|"[^"]*"|'[^']*')*$)""", selector):
        chain, at, link = [], 0, ""
        one = one.strip()
        while at < len(one):
            if m := re.compile(r"\s*([>+~])\s*|\s+").match(one, at):
                if not chain or link:
                    raise ValueError(f"combinator without an element before it: {selector}")
                link, at = m[1] or " ", m.end()
            c, begun = _Compound(), at
            while m := _PART.match(one, at):
                if m["tag"] and at > begun:
                    break
                at = m.end()
                if m["tag"]:
                    c.tag = None if m["tag"] == "*" else m["tag"].lower()
                elif m["id"]:
                    c.ident = m["id"]
                elif m["cls"]:
                    c.classes.append(m["cls"])
                elif m["attr"]:
                    c.attrs.append((m["attr"].lower(), m["op"], next((v for v in (m["v1"], m["v2"], m["v3"]) if v is not None), "")))
                else:
                    c.nth = int(m["nth"] or 1)
            if at == begun:
                raise ValueError(f"not a supported selector: {selector}")
            chain.append((link, c))
            link = ""
        if not chain:
            raise ValueError(f"empty selector: {selector!r}")
        yield chain


class Automaton:
    """All fields' selectors, and where a container is given its selector, in one automaton."""

    def __init__(self, fields: dict[str, Take], container: str | None = None) -> None:
        self.fields, self.container = list(fields.values()), container
        self.by_key: dict[str, list] = {}
        self.ends: dict[int, list[tuple[int, int]]] = {}
        self.final = bit = 0
        wanted = [(n, rank, s) for n, f in enumerate(self.fields) for rank, s in enumerate(f.selectors)]
        for n, rank, s in [*wanted, *([(-1, 0, container)] if container else [])]:
            for chain in _chains(s):
                for k, (link, c) in enumerate(chain):
                    key = f"#{c.ident}" if c.ident else f".{c.classes[0]}" if c.classes else c.tag or "*"
                    self.by_key.setdefault(key, []).append((bit, link if k else "", c))
                    bit += 1
                self.ends.setdefault(bit - 1, []).append((n, rank))
                self.final |= 1 << (bit - 1)

    def run(self, page: str | None) -> list[list]:
        """The fields' values for every container (the page itself, where there is none), in order."""
        page, whole = page or "", [{} for _ in self.fields]
        scopes = [] if self.container else [whole]
        # an open element: tag, bits around its children, its bits, the last child's, all children's, children, finds, where it began, scope
        stack: list[list] = [["", 0, 0, 0, 0, 0, (), 0, None if self.container else whole]]
        texts: list[str] = []
        at = 0
        end = 0
        while m := _TAG.search(page, at):
            if m.start() > end:
                texts.append(entities.unescape(page[end : m.start()]))
            at = end = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if any(e[0] == name for e in stack[1:]):
                    while self._close(stack, texts, page, m.start()) != name:
                        pass
                continue
            self._implied(stack, name, texts, page, m.start())
            attrs = {a[0].lower(): entities.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(m[3])} if m[3].strip() else {}
            self._open(stack, name, attrs, len(texts), m.end(), scopes)
            if name in VOID:
                self._close(stack, texts, page, m.end())
            elif name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = stop.start() if stop else len(page)
                if name in ("title", "textarea"):
                    texts.append(entities.unescape(page[end:at]))
                else:  # its content is no text of the elements around it
                    stack[-1][7] = (0, page[end:at])
                end = at
        if end < len(page):
            texts.append(entities.unescape(page[end:]))
        while len(stack) > 1:
            self._close(stack, texts, page, len(page))
        return [[self._value(f, s[n]) for n, f in enumerate(self.fields)] for s in scopes]

    def _implied(self, stack: list, name: str, texts: list[str], page: str, at: int) -> None:
        """Ends the open elements that a start tag ends by implication."""
        k = len(stack) - 1
        while k > 0:
            tag = stack[k][0]
            if name in ENDED_BY.get(tag, ()):
                while len(stack) > k:
                    self._close(stack, texts, page, at)
            elif tag in _WALLS:
                return
            k -= 1

    def _open(self, stack: list, name: str, attrs: dict[str, str], n_texts: int, at: int, scopes: list) -> None:
        parent = stack[-1]
        parent[5] += 1
        classes = attrs.get("class", "").split()
        bits, keys = 0, ["*", name, *[f".{c}" for c in dict.fromkeys(classes)]]
        if "id" in attrs:
            keys.append(f"#{attrs['id']}")
        for key in keys:
            for bit, link, c in self.by_key.get(key, ()):
                before = {"": None, " ": parent[1], ">": parent[2], "+": parent[3], "~": parent[4]}[link]
                if (before is None or before >> (bit - 1) & 1) and (c.tag is None or c.tag == name) and c.fits(attrs, classes, parent[5]):
                    bits |= 1 << bit
        parent[3] = bits
        parent[4] |= bits
        scope, finds = parent[8], []
        if bits & self.final:
            hits = sorted({hit for bit, to in self.ends.items() if bits >> bit & 1 for hit in to})
            for n, rank in hits:
                if n >= 0:
                    s = scope
                    while s is not None:  # containers around each other all have what lies in them
                        if self.fields[n].many or rank not in s[n]:
                            finds.append((s[n].setdefault(rank, []), n, attrs))
                            s[n][rank].append(None)
                            finds[-1] += (len(s[n][rank]) - 1,)
                        s = s[-1] if self.container else None
            if hits[0][0] < 0:
                scope = [*[{} for _ in self.fields], scope]
                scopes.append(scope)
        stack.append([name, parent[1] | bits, bits, 0, 0, 0, finds, (n_texts, None), scope, at])

    def _close(self, stack: list, texts: list[str], page: str, end: int) -> str:
        e = stack.pop()
        for found, n, attrs, k in e[6]:
            what = self.fields[n].what
            if what == "text":
                first, raw = e[7]
                found[k] = raw if raw is not None else "".join(texts[first:])
            elif what == "innerHTML":
                found[k] = page[e[9] : end]
            else:
                found[k] = attrs.get("href") or attrs.get("src") if what == "url" else attrs.get(what)
        return e[0]

    def _value(self, f: Take, found: dict[int, list]) -> str | list[str] | None:
        ranked = [[(v or "").strip() for v in found.get(r, ())] for r in range(len(f.selectors))]
        if f.many:
            return [v for vs in ranked for v in vs if v]
        return next((vs[0] for vs in ranked if vs and vs[0]), None)


_AUTOMATA: dict[tuple, Automaton] = {}
#: Pages that a task holds as Python objects at once.
SLICE = 32


def _automaton(fields: dict[str, Take], container: str | None) -> Automaton:
    key = (tuple(fields.items()), container)
    if key not in _AUTOMATA:
        _AUTOMATA[key] = Automaton(fields, container)
    return _AUTOMATA[key]


def _type(fields: dict[str, Take]) -> StructType:
    return StructType([StructField(n, ArrayType(StringType()) if f.many else StringType()) for n, f in fields.items()])


def _run(pages: pa.Array, fields: dict[str, Take], container: str | None) -> pa.Array:
    """The fields of each page, or of each element within it; ``SLICE`` pages are Python objects at a time, the rest stays in Arrow."""
    a = _automaton(fields, container)
    row = pa.struct([(n, pa.list_(pa.string()) if f.many else pa.string()) for n, f in fields.items()])
    kind = row if container is None else pa.list_(row)
    named = lambda values: dict(zip(fields, values, strict=True))
    out = [pa.array([], kind)]
    for first in range(0, len(pages), SLICE):
        found = (a.run(p) for p in pages.slice(first, SLICE).to_pylist())
        out.append(pa.array([named(f[0]) if container is None else [named(r) for r in f] for f in found], kind))
    return pa.concat_arrays(out)


def selected(html: Column, fields: dict[str, Take]) -> Column:
    """struct of the fields of a page, in one pass of an Arrow UDF."""
    Automaton(fields)  # raises here, not in a task

    @F.arrow_udf(_type(fields))
    def run(pages: pa.Array) -> pa.Array:
        return _run(pages, fields, None)

    return run(html)


def selected_in(html: Column, container: str, fields: dict[str, Take]) -> Column:
    """array of structs: the fields within each element that ``container`` selects, in the order of their start tags."""
    Automaton(fields, container)

    @F.arrow_udf(ArrayType(_type(fields)))
    def run(pages: pa.Array) -> pa.Array:
        return _run(pages, fields, container)

    return run(html)


def container_rows(pages: DataFrame, container: str, fields: dict[str, dict], html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep``, place (from 0) and the declared fields, a row for each element that ``container`` selects.

    A field has selector, and may have attribute (text, href, src, innerHTML or any other), multiple, required,
    fallback, transform and params. Values pass the transform; a required field without a value takes its fallback; without one it stays null.
    """
    takes = {n: Take((f["selector"],), f.get("attribute") or "text", bool(f.get("multiple"))) for n, f in fields.items()}
    rows = pages.select(*keep, F.posexplode(selected_in(F.col(html), container, takes)).alias("place", "_row"))
    for n, f in fields.items():
        many = bool(f.get("multiple"))
        value = transformed(F.col("_row").getField(n), f.get("transform"), f.get("params"), many)
        if f.get("required") and f.get("fallback") is not None:
            value = F.when(F.size(value) > 0, value).otherwise(F.array(F.lit(f["fallback"]))) if many else F.coalesce(F.nullif(value, F.lit("")), F.lit(f["fallback"]))
        rows = rows.withColumn(n, value)
    return rows.drop("_row")


_T = lambda *s, **k: Take(s, **k)
#: Where event pages have their fields (fixed values), first to last.
EVENT_FIELDS = {
    "title": _T("h1", ".event-title", ".title", '[itemprop="name"]', ".event-name"),
    "description": _T(".description", ".event-description", '[itemprop="description"]', ".summary", ".about"),
    "venue": _T(".venue", ".location", '[itemprop="location"]', ".venue-name", ".place"),
    "address": _T(".address", ".venue-address", '[itemprop="address"]', ".location-address"),
    "date": _T(".date", ".event-date", '[itemprop="startDate"]', ".start-date", "time[datetime]"),
    "time": _T(".time", ".event-time", ".start-time", ".doors"),
    "price": _T(".price", ".cost", ".ticket-price", '[itemprop="price"]', ".fee"),
    "artists": _T(".artists", ".performers", ".artist", ".performer", '[itemprop="performer"]', many=True),
    "genres": _T(".genre", ".category", ".tag", '[itemprop="genre"]', ".music-genre", many=True),
    "tickets_url": _T('a[href*="ticket"]', 'a[href*="buy"]', ".ticket-link", ".buy-tickets", what="href"),
    "event_url": _T('link[rel="canonical"]', 'meta[property="og:url"]', what="href"),
    "image_urls": _T(".event-image img", ".poster img", 'img[itemprop="image"]', 'meta[property="og:image"]', what="url", many=True),
}
#: Attributes that hold a date or another address, after those (fixed values).
_MORE = {
    "_datetime": _T("time[datetime]", "[datetime]", "[data-date]", "[data-datetime]", what="datetime"),
    "_data_date": _T("[data-date]", "[data-datetime]", what="data-date"),
    "_data_datetime": _T("[data-datetime]", what="data-datetime"),
    "_og_url": _T('meta[property="og:url"]', what="content"),
}


def event_records(pages: DataFrame, today: dt.date, own: dict[str, tuple[str, ...]] | None = None, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key`` and title, description, venue, address, date_start, price, artists, genres, tickets_url, event_url, image_urls of every page.

    ``own`` gives other selectors for some fields. A date comes from an attribute, else from the texts of date and time;
    one that can't be read is null. Relative days count from ``today``.
    """
    fields = {n: Take(tuple((own or {}).get(n, t.selectors)), t.what, t.many) for n, t in EVENT_FIELDS.items()} | _MORE
    rows = pages.select(key, selected(F.col(html), fields).alias("_f"))
    at = lambda n: F.col("_f").getField(n)
    each = lambda n, f: F.flatten(F.transform(F.array_distinct(F.transform(at(n), page_text)), f))
    given = dates.parse_iso(F.coalesce(at("_datetime"), at("_data_date"), at("_data_datetime")))
    day, time = collapse(at("date")), collapse(at("time"))  # as written: page_text has no colons
    read = F.coalesce(event_dates.parse_day(day, today), event_dates.month_first_day(day))
    minutes = F.coalesce(event_dates.clock(time), event_dates.clock(day), F.lit(0))
    written = F.coalesce(event_dates.at_minute(read, minutes).cast("timestamp"), dates.parse_iso(day))
    texts = [page_text(at(n)).alias(n) for n in ("title", "description", "venue", "address")]
    return rows.select(
        key, *texts, F.coalesce(given, written).alias("date_start"), page_text(at("price")).alias("price"), each("artists", extract.artists).alias("artists"), each("genres", extract.genres).alias("genres"),
        at("tickets_url").alias("tickets_url"), F.coalesce(at("event_url"), at("_og_url")).alias("event_url"), F.array_distinct(at("image_urls")).alias("image_urls"),
    )


def page_urls(pages: DataFrame, selectors: tuple[str, ...], base: str | None = None, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key`` and urls: the distinct addresses (href, else src) of the elements selected, resolved on ``base`` where one is given; those that can't be resolved go."""
    found = F.col("_f").getField("urls")
    if base is not None:
        found = F.filter(F.transform(found, lambda u: resolved(u, base)), lambda u: u.isNotNull())
    return pages.select(key, selected(F.col(html), {"urls": Take(selectors, "url", True)}).alias("_f")).select(key, F.array_distinct(found).alias("urls"))


def resolved(url: Column, base: str) -> Column:
    """``url`` as seen from ``base`` (an absolute address): whole ones stay, ``//host``, ``/path``, ``?query``, ``#part`` and relative paths are completed; null where a host is missing."""
    scheme, host, path = re.match(r"([a-z][a-z0-9+.-]*:)//([^/?#]+)([^?#]*)", base, re.I).groups()
    folder = path.rpartition("/")[0] + "/"
    whole = F.when(url.rlike("(?i)^https?://[^/?#]"), url).when(url.rlike("(?i)^(?!https?:)[a-z][a-z0-9+.-]*:"), url)
    near = F.when(url.startswith("//"), F.when(url.rlike("^//[^/?#]"), F.concat(F.lit(scheme), url))).when(url.startswith("/"), F.concat(F.lit(f"{scheme}//{host}"), _without_dots(url)))
    last = path or "/"
    far = F.when(url.rlike("^[?#]"), F.concat(F.lit(f"{scheme}//{host}{last}"), url)).otherwise(F.concat(F.lit(f"{scheme}//{host}"), _without_dots(F.concat(F.lit(folder), url))))
    return F.when(url.rlike("(?i)^https?:") & whole.isNull(), None).otherwise(F.coalesce(whole, F.when(url.startswith("/"), near).otherwise(far)))


def _without_dots(path: Column) -> Column:
    """A path and what follows it with its ``.`` and ``..`` parts taken out."""
    way, rest = F.regexp_extract(path, r"^[^?#]*", 0), F.regexp_extract(path, r"^[^?#]*(.*)$", 1)
    parts = F.split(way, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).when(p == ".", a).otherwise(F.array_append(a, p)))
    open_end = F.when(way.rlike(r"/\.\.?$"), F.lit("/")).otherwise("")
    return F.concat(F.array_join(kept, "/"), open_end, rest)
