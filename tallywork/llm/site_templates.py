"""HTML extraction: the main text of a page, without what its site repeats.

The text of the articles, or of the body where there is none, is the main text, blocks joined by
an empty line, without the site's template. To find the template, every container element has a
digest of its subtree (tags, classes, texts), and Spark counts, per host, on how many different
articles a subtree occurs. A subtree is the template's if its share of the host's articles is at
least ``SHARE`` with some confidence: on three of three, or most of many. There is no absolute
number, so a quotation on a few pages stays however large the host grows. Its blocks are deleted;
what is left and says what it is (menus, adverts, forms and so on, by element, role, or whole
class names) goes after that. Only digests are shuffled, pages are not: the digests of the
templates are broadcast, unless there are too many.

Copies of an article count once, so an article copied on its own site is not a template. A
subtree that holds half of the article's text or more is never one either; nor is a paragraph,
list item or heading within an article that holds a quarter or is not on most articles, which
spares quoted ones.

Articles that name themselves something else, such as comments, are not main text. If a main
element holds articles of less text than stands beside them, all of it is main text.

Defined results: null html is empty; a null or unreadable url has no host, and its page no
template; repeated rows repeat. Unclosed and misplaced tags are read as browsers do in the main:
a block ends an open paragraph, an end tag closes what is open inside its element, and one
without a start is ignored. Other columns are kept.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.llm.common import Batches, free_name
from tallywork.operators.stages import written

START = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>=]++|=)*+)>""")
END = re.compile(r"</([a-zA-Z][^\s/>]*+)[^>]*+>")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# How HTML elements nest and show.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub"
    " sup time tt u var wbr img".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
#: A start tag of the first kind ends an open element of the second, unless the third stands between.
ENDED_BY = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that are not main text.
DROPPED = RAW | frozenset("head nav footer aside form button select option label input template svg canvas object dialog menu audio video map applet".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
#: Words of classes and ids that name something else than main text.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu submenu"
    " breadcrumb breadcrumbs sidebar sidebars footer comment comments commentlist disqus reply replies respond cookie cookies consent gdpr"
    " notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended pagination"
    " pager widget widgets toolbar skip skiplink".split()
)
#: Words that may stand beside those in a name, and change nothing.
NEUTRAL_WORDS = frozenset(
    "area bar block bottom box button buttons col column container content div first form group holder icon icons id inner item items last left link"
    " links list main media page post posts right row section site slot text top unit wrap wrapper".split()
)
HEADER_WORDS = frozenset("header masthead".split())
CONTAINERS = frozenset("div section aside nav ul ol dl table form header footer figure menu center blockquote fieldset details".split())
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 dd dt".split())

#: The least share of the host's articles that a template's subtree is on, with this confidence in standard deviations.
SHARE, CONFIDENCE = 0.5, 1.64
#: A paragraph, list item or heading within an article is one by this share.
SHARE_WITHIN = 0.7
#: Digests of templates that are broadcast, eight bytes each; more are joined by host.
MOST_BROADCAST = 16 << 20
ROWS = "host long, subtree long, within boolean, article long"


def names_something_else(name: str) -> bool:
    """Whether a class or id is made of dropped words, and of others that change nothing."""
    words = [w for w in re.split(r"[^a-z]+", name.lower()) if w]
    return any(w in DROPPED_WORDS for w in words) and all(w in DROPPED_WORDS or w in NEUTRAL_WORDS for w in words)


class _Element:
    __slots__ = ("tag", "drop", "header", "article", "blocks", "content", "size", "links", "kept_size")

    def __init__(self, tag: str, drop: bool, header: bool, article: str | None, blocks: int, label: bytes):
        self.tag, self.drop, self.header, self.article, self.blocks = tag, drop, header, article, blocks
        self.content, self.size, self.links, self.kept_size = [label], 0, 0, 0


class Page:
    """One reading of a page: ``blocks`` of text with their place, and whether they name themselves something else; ``subtrees`` with their size and blocks."""

    def __init__(self, html: str | None):
        self.blocks: list[tuple[str, str | None, bool]] = []
        self.subtrees: list[tuple[bytes, int, bool, int, int]] = []
        self.places: set[str] = set()
        # What belongs to the open block, and what stands in it and names itself something else.
        self.parts: list[str] = []
        self.named_parts: list[str] = []
        self.stack = [_Element("", False, False, None, 0, b"")]
        self._read(html or "")
        while len(self.stack) > 1:
            self._close()
        self._end_block()

    # Reading.

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            mark = html.find("<", at)
            if mark < 0:
                return self._text(html[at:])
            if mark > at:
                self._text(html[at:mark])
            if html.startswith("<!--", mark):
                end = html.find("-->", mark + 4)
                at = size if end < 0 else end + 3
            elif found := START.match(html, mark):
                at = found.end()
                tag = found[1].lower()
                self._start(tag, found[2])
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                    at = end.start() if end else size
            elif found := END.match(html, mark):
                at = found.end()
                self._end(found[1].lower())
            elif re.match(r"</?[a-zA-Z]", html[mark : mark + 3]):
                return  # a tag that does not end
            elif html[mark + 1 : mark + 2] in ("!", "?", "/"):
                end = html.find(">", mark)
                at = size if end < 0 else end + 1
            else:
                self._text("<")
                at = mark + 1

    def _text(self, raw: str) -> None:
        top = self.stack[-1]
        text = entities.unescape(raw) if "&" in raw else raw
        size = len(text.strip())
        if size:
            top.content.append(" ".join(text.split()).encode("utf-8", "surrogatepass"))
            top.size += size
        named = top.drop or top.header and top.article is None
        if top.tag not in RAW:
            (self.named_parts if named else self.parts).append(text)
        if not named:
            top.kept_size += size

    def _start(self, tag: str, rest: str) -> None:
        if tag in ENDS_PARAGRAPH:
            self._close_open(("p",), ("button", "object", "td", "th", "table", "div", "section", "article"))
        if tag in ENDED_BY:
            self._close_open(*ENDED_BY[tag])
        if tag not in INLINE:
            self._end_block() if tag != "br" else self.parts.append(" ")
        if tag in VOID:
            return
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if rest and not rest.isspace() else {}
        above = self.stack[-1]
        place = above.article
        if tag in ("article", "main") or named.get("role", "").lower() == "main":
            place = "article" if tag == "article" or place == "article" else "main"
        words = set(re.split(r"[^a-z0-9]+", f"{named.get('class', '')} {named.get('id', '')}".lower())) if named else ()
        header = above.header or tag == "header" or (tag not in ("body", "html", "article", "main") and not HEADER_WORDS.isdisjoint(words))
        if header and (tag in HEADINGS and place):
            header = False
        drop = above.drop or tag in DROPPED or "hidden" in named or named.get("aria-hidden", "").lower() == "true"
        if named and not drop and tag not in ("body", "html", "main"):
            classes = f"{named.get('class', '')} {named.get('id', '')}".split()
            drop = (
                named.get("role", "").lower() in DROPPED_ROLES or any(map(names_something_else, classes))
                or "display:none" in named.get("style", "").replace(" ", "").lower()
            )
        if place != above.article and not drop:
            self.places.add(place)
        element = _Element(tag, drop or header, header, place, len(self.blocks), f"<{tag} {' '.join(sorted(words))}>".encode())
        # Within a header only headings are kept, and those within an article only.
        if not header and above.header and not above_dropped(self.stack):
            element.drop = False
        self.stack.append(element)

    def _end(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self._close()
                return
        if tag == "p":
            self._end_block()

    def _close_open(self, tags: tuple[str, ...], until: tuple[str, ...]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                while len(self.stack) > i:
                    self._close()
                return
            if self.stack[i].tag in until:
                return

    def _close(self) -> None:
        element = self.stack[-1]
        if element.tag not in INLINE:
            self._end_block()
        self.stack.pop()
        above = self.stack[-1]
        digest = hashlib.blake2b(b"\0".join(element.content), digest_size=12).digest()
        above.content.append(digest)
        above.size += element.size
        above.links += element.links + (element.size if element.tag == "a" else 0)
        above.kept_size += element.kept_size
        leaf = element.tag in LEAVES and (element.article is None or element.kept_size > 0)
        if element.size and (element.tag in CONTAINERS or leaf):
            menu = element.article is None and element.tag in CONTAINERS and element.links > 0.8 * element.size and len(element.content) > 2
            if menu:
                self.blocks[element.blocks :] = [(text, at, True) for text, at, _ in self.blocks[element.blocks :]]
                above.kept_size -= element.kept_size
            self.subtrees.append((digest, element.kept_size, leaf and element.article is not None, element.blocks, len(self.blocks)))

    def _end_block(self) -> None:
        for parts, named in ((self.parts, False), (self.named_parts, True)):
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((text, self.stack[-1].article, named))
                parts.clear()

    # What was read.

    def _places(self) -> tuple[str | None, ...]:
        """Where the main text is: in articles, unless the main element around them says more; else in the main element, else anywhere."""
        sizes = dict.fromkeys(("article", "main"), 0)
        for text, at, named in self.blocks:
            if at and not named:
                sizes[at] += len(text)
        if "article" in self.places and (sizes["article"] >= sizes["main"] or "main" not in self.places):
            return ("article",)
        return ("article", "main") if "main" in self.places else (None, "article", "main")

    def text(self, gone: frozenset[int] | set[int] = frozenset()) -> str:
        """The main text but for the blocks ``gone``."""
        places = self._places()
        return "\n\n".join(t for i, (t, at, named) in enumerate(self.blocks) if at in places and not named and i not in gone)

    def shown(self, gone: frozenset[int] | set[int] = frozenset()) -> str:
        """All text but for the blocks ``gone``, whatever it says it is."""
        return "\n\n".join(t for i, (t, _, _) in enumerate(self.blocks) if i not in gone)

    def candidates(self) -> list[tuple[bytes, bool, int, int]]:
        """The subtrees that may be part of a template: digest, whether a leaf within an article, and the blocks they hold."""
        size = len(self.text())
        return [(digest, within, start, end) for digest, kept, within, start, end in self.subtrees if (4 if within else 2) * kept < size]


def short(*parts: bytes) -> int:
    """A digest as a signed number."""
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def above_dropped(stack: list[_Element]) -> bool:
    """Whether an open element other than a header is dropped."""
    return any(e.drop and not e.header for e in stack)


def host_of(url: Column) -> Column:
    """The host of a url in lower case, null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def subtree_table(pages: DataFrame, url: str, html: str) -> DataFrame:
    """A row per page with a host and per candidate: digests of the host, of host and subtree, and of the main text.

    One more row per page has a null subtree.
    """

    def read(batches: Batches) -> Batches:
        for batch in batches:
            found = set()
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                name, page = host.encode("utf-8", "surrogatepass"), Page(source)
                site, article = short(name), short(page.text().encode("utf-8", "surrogatepass"))
                found.add((site, None, False, article))
                found.update((site, short(name, digest, b"in" if within else b""), within, article) for digest, within, _, _ in page.candidates())
            columns = zip(*found) if found else ((), (), (), ())
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "subtree", "within", "article"])

    named = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))
    return named.where("host IS NOT NULL AND html IS NOT NULL").mapInArrow(read, ROWS)


def at_least(count: Column, whole: Column) -> Column:
    """The share that ``count`` of ``whole`` shows with confidence: the lower end of Wilson's interval."""
    share, square = count / whole, CONFIDENCE**2
    spread = CONFIDENCE * F.sqrt(share * (1 - share) / whole + square / (4 * whole * whole))
    return (share + square / (2 * whole) - spread) / (1 + square / whole)


def templates(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Digests (host, subtree) of the subtrees that are on their share of the host's different articles."""
    counts = subtree_table(pages, url, html).distinct().groupBy("host", "subtree", "within").agg(F.count("*").alias("articles"))
    # One article alone never shows a share.
    counts = written(counts.where("subtree IS NULL OR articles > 1"), "subtree-counts")
    whole = counts.where("subtree IS NULL").select("host", F.col("articles").alias("whole"))
    often = at_least(F.col("articles"), F.col("whole")) >= F.when(F.col("within"), SHARE_WITHIN).otherwise(SHARE)
    return counts.where("subtree IS NOT NULL").join(whole, "host").where(often).select("host", "subtree")


def template_blocks(page: Page, host: str | None, known: np.ndarray) -> set[int]:
    """Places of the page's blocks that are in a template, by the sorted digests ``known``."""
    held = [c for c in page.candidates() if c[2] < c[3]] if host is not None and len(known) else []
    if not held:
        return set()
    name = host.encode("utf-8", "surrogatepass")
    keys = np.array([short(name, digest, b"in" if within else b"") for digest, within, _, _ in held], np.int64)
    hit = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
    return {i for (_, _, start, end), out in zip(held, hit) if out for i in range(start, end)}


def main_text(
    pages: DataFrame, url: str = "url", html: str = "html", into: str = "main_text", most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """``pages`` with one more column ``into`` (under a free name, the last column): the main text.

    Templates are written to the shared folder. Up to ``most_broadcast`` their digests are
    broadcast and pages stay where they are; more are joined to the pages by host.
    """
    result = free_name(into, pages.columns)
    host, site, drop = (free_name(c, pages.columns) for c in ("host", "site", "subtrees"))
    gone = written(templates(pages, url, html), "templates")
    keyed = pages.withColumn(host, host_of(F.col(f"`{url}`")))
    if gone.count() <= most_broadcast:
        known = np.sort(gone.select("subtree").toArrow().column(0).to_numpy())
        shared = pages.sparkSession.sparkContext.broadcast(known)
    else:
        shared, number = None, F.udf(lambda h: None if h is None else short(h.encode("utf-8", "surrogatepass")), "long")
        lists = gone.groupBy(F.col("host").alias(site)).agg(F.sort_array(F.collect_list("subtree")).alias(drop))
        keyed = keyed.withColumn(site, number(host)).join(lists, site, "left").select(*(F.col(f"`{c}`") for c in pages.columns), host, drop)

    def main(name: str | None, source: str | None, known: np.ndarray) -> str:
        page = Page(source)
        return page.text(template_blocks(page, name, known))

    def extract(batches: Batches) -> Batches:
        for batch in batches:
            names, sources = batch.column(host).to_pylist(), batch.column(html).to_pylist()
            lists = [shared.value] * len(names) if shared else [np.array(x or (), np.int64) for x in batch.column(drop).to_pylist()]
            texts = [main(*row) for row in zip(names, sources, lists)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in pages_columns), pa.array(texts, pa.string())], [*pages_columns, result])

    pages_columns = pages.columns
    return keyed.mapInArrow(extract, T.StructType([*pages.schema.fields, T.StructField(result, T.StringType())]))
