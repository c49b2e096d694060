"""Main text of web pages, by templates deduced from equivalence classes of tokens.

Tokens of a page are its tags, each with its path, short text nodes outside the article,
and whole blocks of text inside it.  Over the distinct pages of a host, every token has an
occurrence vector: how often it stands on each page.  Tokens with equal vectors form an equivalence class; classes that
are frequent and have several members make up the host's template.  A block inside the
article can be the article's own, so it alone is template only where nearly all pages of
the host hold it.  Vectors are compared by a fingerprint that partial aggregation can
build, so a host with a third of all pages is no task's own work.

On a page, a class is used where it is valid: its tokens stand in the class's order, and
its spans are nested with those of larger classes.  What is left between the template
tokens that stand once on the page are slots, judged by what they hold: text in an article
or main element is the result, and text outside too where there is no other, or where one
slot holds as much of it as all of these elements together.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import saved

# Elements and class or id words that mark what is no main text.
RAW = {"script", "style", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ASIDE = {"head", "nav", "footer", "aside", "form", "noscript", "template", "iframe", "button", "select", "svg", "object", "dialog", "menu", "option", "canvas"}
MAIN = {"article", "main"}
#: Elements whose class or id says nothing about the text in them.
WHOLE = MAIN | {"html", "body"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
AD_WORDS = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "related", "reply", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "widget"}
#: Words that say nothing of their own beside a listed one, as in site-footer or comment-list.
PLAIN_WORDS = {"area", "bar", "block", "body", "box", "buttons", "container", "content", "inner", "list", "main", "page", "post", "posts", "section", "site", "top", "wrapper"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that a new one of the same kind closes.
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}

_BEGIN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
_STOP = re.compile(r"[>\"']")
_MARK = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BETWEEN = re.compile(r"[\W\d_]+")
_SHORT = 200


class _Tags:
    """Where the tags of a page are, in time that is linear in its length.

    A ``>`` in quotes ends no tag; a quote that is never closed is an ordinary character.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.open: list[tuple[list[int], list[int]]] = []  # quoted spans of scans that found no end

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose attributes begin at ``at``, or -1."""
        if at > self.last[">"]:
            return -1
        for begins, ends in self.open:
            k = bisect_right(begins, at) - 1
            if k < 0 or at > ends[k]:
                return -1  # what stands in no quotes of an endless tag has no end either
        begins, ends, start = [at], [at - 1], at
        while m := _STOP.search(self.page, at):
            if m[0] == ">":
                return m.start()
            close = self.page.find(m[0], m.end()) if m.start() < self.last[m[0]] else -1
            if close >= 0:
                begins.append(m.start()), ends.append(close)
            at = close + 1 if close >= 0 else m.end()
        begins[0], ends[0] = -1, start - 1  # nothing is known of what comes before
        self.open.append((begins, ends))
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(begin, end, is it a closing one, name, attributes) of the next tag; no name for comments and declarations."""
        page = self.page
        while m := _BEGIN.search(page, at):
            if m[1]:
                to = page.find("-->", m.end())
                return m.start(), len(page) if to < 0 else to + 3, False, "", ""
            if m[2]:
                to = page.find(">", m.end())
                return m.start(), len(page) if to < 0 else to + 1, False, "", ""
            to = self.end(m.end())
            if to >= 0:
                return m.start(), to + 1, bool(m[3]), m[4].lower(), page[m.end() : to]
            at = m.end()  # a name holds no other beginning that ends elsewhere
        return None


class _Element:
    """An open element; what is asked of all elements around it is kept with it."""

    __slots__ = ("name", "marks", "parent", "path", "main", "article", "heading", "holds", "_beside")

    def __init__(self, name: str, marks: str, parent: _Element | None):
        self.name, self.marks, self.parent = name, marks, parent
        self.path = xxhash.xxh64_intdigest(f"{parent.path if parent else ''}/{name}.{marks}")
        self.main = name in MAIN or bool(parent and parent.main)
        self.article = name == "article" or bool(parent and parent.article)
        self.heading = name in HEADINGS or bool(parent and parent.heading)
        self.holds = False
        self._beside: bool | None = None

    def beside(self) -> bool:
        """Does what stands in it belong to no article?  Asked once the page is read."""
        chain, x = [], self
        while x is not None and x._beside is None:
            chain.append(x)
            x = x.parent
        for x in reversed(chain):
            inside = bool(x.parent and x.parent.main)
            own = x.name in ASIDE or x.name == "header" and not inside or bool(x.marks) and x.name not in WHOLE and not x.holds and _listed(x.marks, inside)
            x._beside = own or bool(x.parent and x.parent._beside)
        return self._beside


Token = tuple[str, str, _Element | None, str]


def tokens(page: str) -> Iterator[Token]:
    """(kind, name, innermost open element, text) in page order.

    What an element holds is known once the page is read.  Articles within another one,
    such as comments, don't count.

    Comments and declarations are passed over; script, style and the like are one element
    without text.  A ``<`` that begins no tag is text.  Elements left open end with the
    page, or where an enclosing one is closed.
    """
    stack: list[_Element] = []
    opened: Counter[str] = Counter()
    top = lambda: stack[-1] if stack else None

    def drop() -> str:
        gone = stack.pop().name
        opened[gone] -= 1
        return gone

    at, n, tags = 0, len(page), _Tags(page)
    while at < n:
        tag = tags.next(at)
        to = tag[0] if tag else n
        if to > at:
            yield "text", "", top(), page[at:to]
        if not tag:
            return
        _, at, closing, name, rest = tag
        if not name:
            continue
        if closing:
            if opened[name] > 0:
                while drop() != name:
                    pass
                yield "close", name, top(), ""
            elif name == "p":
                yield "close", name, top(), ""
            continue
        marks = " ".join(f"{k.lower()}={(a or b or c).lower()}" for k, a, b, c in _MARK.findall(rest)) if rest else ""
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            yield "open", name, top(), ""
            at = end.end() if end else n
            continue
        closes = _SELF_CLOSING.get(name, set()) | ({"p"} if name in _CLOSES_P else set())
        while stack and stack[-1].name in INLINE and any(opened[c] > 0 for c in closes):
            drop()
        while stack and stack[-1].name in closes:
            drop()
        element = _Element(name, marks, top())
        if name in MAIN and not (element.parent and element.parent.article):
            x = element.parent
            while x is not None and not x.holds:
                x.holds = True
                x = x.parent
        yield "open", name, element, ""
        if name not in VOID and not rest.rstrip().endswith("/"):
            stack.append(element)
            opened[name] += 1


@lru_cache(100_000)
def _listed(marks: str, inside: bool) -> bool:
    """Is a whole class, id or role made of listed words, or of those and plain ones?

    In an article, header is a word of its own headline, and an id of search or notice the
    name of a part of it.  Beside plain words header says nothing, but for the site's.
    """
    for mark in marks.split():
        kind, _, value = mark.rpartition("=")
        parts = {x for x in _BETWEEN.split(value) if x}
        words = parts & AD_WORDS
        if not words or parts - words - PLAIN_WORDS or words == {"header"} and (inside or parts - words not in (set(), {"site"})):
            continue
        if not (inside and kind == "id" and words <= {"search", "notice"}):
            return True
    return False


def _code(kind: str, name: str, element: _Element | None, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind} {name} {element.path if element else ''} {text}") - (1 << 63)


def coded(page: str) -> list[tuple[int, str, str, _Element | None, str]]:
    """Tokens with their codes: 0 for text that can't be a token."""
    out = []
    for kind, name, element, text in tokens(page):
        if kind != "text":
            out.append((_code(kind, name, element, ""), kind, name, element, ""))
            continue
        clean = " ".join(html.unescape(text).split())
        token = bool(clean) and len(clean) <= _SHORT and not (element and element.main)
        out.append((_code(kind, name, element, clean) if token else 0, kind, name, element, text))
    return out


def blocks(found: list[tuple[int, str, str, _Element | None, str]], fixed: set[int] = frozenset(), breaks: set[int] = frozenset()) -> list[list[tuple[str, bool, bool]]]:
    """(text, is it in an article, is it a heading) of each block, by slot; a slot ends at each place in breaks.

    Text at the places in fixed and text that belongs to no article are left out.
    """
    slots: list[list[tuple[str, bool, bool]]] = [[]]
    block: list[str] = []
    inside = heading = False

    def flush() -> None:
        text = " ".join(html.unescape("".join(block)).split())
        if text:
            slots[-1].append((text, inside, heading))
        block.clear()

    for k, (_, kind, name, element, text) in enumerate(found):
        if kind == "text":
            if k in fixed or element and element.beside():
                continue
            now = bool(element and element.main)
            if now != inside:
                flush()
                inside = now
            heading = bool(element and element.heading)
            block.append(text)
        elif name in INLINE:
            if name == "br":
                block.append(" ")
        else:
            flush()
            if k in breaks:
                slots.append([])
    flush()
    return slots


def block_code(text: str) -> int:
    """Token of a block inside the article, wherever it stands there."""
    return _code("block", "", None, text)


def host_of(url: Column) -> Column:
    """Lower-case host of a url; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token: pages, a fingerprint of the occurrence vector, the sum of the first places, and if it is a block inside the article.  Token 0 stands on each page."""
    names = ["host", "token", "inner", "pages", "vector", "place"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        rows: dict[tuple[str, int, bool], list[int]] = {}
        for host, page in zip(*(batch.column(c).to_pylist() for c in ("host", "html"))):
            key = xxhash.xxh64_intdigest(page)
            counts, first = Counter({(0, False): 1}), {}
            found = coded(page)
            for k, (code, *_) in enumerate(found):
                if code:
                    counts[code, False] += 1
                    first.setdefault((code, False), k)
            counts.update((block_code(text), True) for slot in blocks(found) for text, inside, heading in slot if inside and not heading)
            for token, n in counts.items():
                row = rows.setdefault((host, *token), [0, 0, 0])
                row[0] += 1
                row[1] ^= xxhash.xxh64_intdigest(f"{key} {n}") - (1 << 63)
                row[2] += first.get(token, 0)
        columns = list(zip(*((*k, *r) for k, r in rows.items()))) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def templates(pages: DataFrame, least_pages: int = 3, share: float = 0.5, members: int = 2, inner_pages: int = 5, inner_share: float = 0.9) -> DataFrame:
    """host, template: its tokens with class and order, and repeated: its blocks inside articles.

    pages has host and html; equal pages of a host count once.  A class counts where its
    tokens stand on at least ``least_pages`` pages and ``share`` of the host's, and it has
    ``members`` tokens or more; a block inside articles that is no heading, on ``inner_pages``
    pages and ``inner_share`` of all.
    """
    rows = pages.select("host", "html").distinct().mapInArrow(_vectors, "host string, token long, inner boolean, pages long, vector long, place long")
    rows = rows.groupBy("host", "token", "inner").agg(F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.sum("place").alias("place"))
    rows = saved(rows.where((F.col("pages") >= least_pages) | (F.col("token") == 0)), "tokens")
    sizes = rows.where("token = 0").select("host", F.col("pages").alias("all"))
    often = rows.where((F.col("token") != 0) & (F.col("pages") >= least_pages)).join(sizes, "host")
    often = often.where(F.col("pages") >= F.when(F.col("inner"), F.greatest(F.lit(inner_pages), inner_share * F.col("all"))).otherwise(share * F.col("all")))
    classes = often.groupBy("host", "inner", "vector", "pages").agg(F.count(F.lit(1)).alias("members"), F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("place"), "token")).alias("tokens"))
    classes = classes.where(F.col("inner") | (F.col("members") >= members))
    token = lambda t: F.struct(t["token"].alias("token"), F.col("vector").alias("cls"), t["place"].alias("place"))
    of = lambda inner, f: F.flatten(F.collect_list(F.when(F.col("inner") == inner, F.transform("tokens", f))))
    return classes.groupBy("host").agg(of(False, token).alias("template"), of(True, lambda t: t["token"]).alias("repeated"))


def valid_tokens(codes: list[int], template: dict[int, tuple[int, float]]) -> set[int]:
    """Places of the page's tokens that belong to valid classes: in order, and nested with larger classes."""
    by_class: dict[int, list[int]] = {}
    for k, code in enumerate(codes):
        if code in template:
            by_class.setdefault(template[code][0], []).append(k)
    order: dict[int, list[int]] = {}
    for code, (cls, _) in sorted(template.items(), key=lambda x: (x[1][1], x[0])):
        order.setdefault(cls, []).append(code)
    spans, out = [], set()
    for cls, places in sorted(by_class.items(), key=lambda x: (-len(order[x[0]]), x[1])):
        n = len(order[cls])
        if len(places) % n or any(codes[k] != order[cls][i % n] for i, k in enumerate(places)):
            continue
        own = [(places[i], places[i + n - 1]) for i in range(0, len(places), n)]
        if all(b < c or d < a or (a < c and d < b) or (c < a and b < d) for a, b in own for c, d in spans):
            spans += own
            out.update(places)
    return out


def once(codes: list[int], fixed: set[int]) -> set[int]:
    """Places of the template tokens that stand once on the page."""
    often = Counter(codes[k] for k in fixed)
    return {k for k in fixed if often[codes[k]] == 1}


def main_text(page: str, template: dict[int, tuple[int, float]] | None = None, repeated: set[int] = frozenset()) -> str:
    """Blocks of the article, joined by line breaks.

    Without an article all blocks that are no template are main text.  How long texts are plays
    no part.
    """
    found = coded(page)
    codes = [f[0] for f in found]
    fixed = valid_tokens(codes, template) if template else set()
    slots = [[(t, i) for t, i, head in slot if head or not (i and repeated and block_code(t) in repeated)] for slot in blocks(found, fixed, once(codes, fixed))]
    inner = [t for slot in slots for t, i in slot if i]
    if not inner:
        return "\n".join(t for slot in slots for t, _ in slot)
    # a template says where a page's own text stands: beside an article of one block, a slot of several blocks is main text too
    more = bool(fixed) and len(inner) == 1
    own = [more and sum(not i for _, i in slot) > 1 for slot in slots]
    return "\n".join(t for slot, all_ in zip(slots, own) for t, i in slot if i or all_)


def extract(pages: DataFrame, url: str = "url", page: str = "html", keep: list[str] | None = None, most_broadcast: int = 500_000) -> DataFrame:
    """The columns in ``keep`` (all by default), then text and n_chars.

    A null page gives an empty text.  Pages without a host share the empty one.  Templates
    with up to ``most_broadcast`` tokens in all are broadcast; beyond, pages are joined to
    their host's template by shuffle.  Kept columns of the two names are replaced.
    """
    keep = [c for c in (keep if keep is not None else pages.columns) if c not in ("text", "n_chars")]
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    body = F.coalesce(F.col(page), F.lit(""))
    rows = pages.select(F.struct(*keep).alias("kept"), host_of(F.col(url)).alias("host"), body.alias("html"))
    found = saved(templates(rows), "templates")
    tokens_ = found.agg(F.sum(F.size("template") + F.size("repeated"))).first()[0] or 0
    side = F.broadcast(found) if tokens_ <= most_broadcast else found
    joined = rows.join(side, "host", "left").select("kept", "host", "html", "template", "repeated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[dict, set]] = {}
        for batch in batches:
            texts = []
            hosts, htmls, marks, lines = batch.column("host").to_pylist(), batch.column("html"), batch.column("template"), batch.column("repeated")
            for k in range(batch.num_rows):
                if hosts[k] not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[hosts[k]] = {t["token"]: (t["cls"], t["place"]) for t in marks[k].as_py() or ()}, set(lines[k].as_py() or ())
                texts.append(main_text(htmls[k].as_py(), *known[hosts[k]]))
            kept = [batch.column("kept").field(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])
