"""HTML extraction by consensus host paths."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfill.session import ship, stored

RESULT = "page_id long, url string, text string, n_chars long"
VOTES = "host string, kind int, path long, label string, weight double, linked double, hash long"

# a tag, comment, declaration, or an element whose content is never text; an unclosed one reaches to the end
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(script|style|noscript|template|iframe|svg|math|object|canvas|audio|video|textarea|select|title)\b(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</\1\s*+>|.*)"
    r"|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
# fixed values: elements that end a line of text, elements that are kept on the stack, elements that are never main text
BREAKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CELLS = frozenset(["td", "th"])
OUTSIDE = frozenset("nav aside footer form button menu dialog head label input fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr tbody thead tfoot table ul ol dl figure figcaption caption address summary".split())
SAME_CLOSES = frozenset("p li dt dd tr td th option".split())
# fixed values: words in a class, id or role that speak for something other than the article
NAMES = frozenset(
    "promo promotion banner notice alert popup modal overlay newsletter subscribe subscription "
    "nav navigation navbar menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar header share sharing social related recommended recommendations trending widget "
    "discussion pagination pager login signup signin search form hidden contentinfo complementary".split()
)
# fixed values: the same of adverts, consent and reader comments, whose text may look like an article's
DECIDING = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr comment comments disqus reply replies respond".split())
# fixed values: words that only say what kind of box it is
NEUTRAL = frozenset(
    "site page post entry article content main body text title meta section block box wrap wrapper container area inner outer group list item items row col column grid card panel module region "
    "button buttons btn bar link links icon icons top bottom left right primary secondary global local user reader thread first last even odd new small large mobile desktop sticky fixed hero".split()
)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
IN, SUSPECT, OUT = 0, 1, 2
PROSE_CHARS = 60
LINKED_SHARE = 0.3
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
DIGITS = re.compile(r"\d+")


class Element:
    __slots__ = ("tag", "path", "label", "outside", "suspect", "parent", "own", "linked", "below", "number")

    def __init__(self, tag, path, label, outside, suspect, parent, number):
        self.tag, self.path, self.label, self.outside, self.suspect, self.parent, self.number = tag, path, label, outside, suspect, parent, number
        self.own = self.linked = self.below = 0.0


def _named(value: str) -> int:
    """What the words of a class, id or role say.

    A name of listed words, box words and numbers only says that the element is outside; one with other words besides, such as
    notice-board-history, makes it suspect.
    """
    said = IN
    for name in value.split():
        words = [w.lower() for w in PARTS.findall(name)]
        if any(w in DECIDING for w in words):
            return OUT
        if any(w in NAMES for w in words):
            if all(w in NAMES or w in NEUTRAL or len(w) < 3 or w.isdigit() for w in words):
                return OUT
            said = SUSPECT
    return said


def _described(tag: str, attributes: str, parent: Element) -> tuple[str, int]:
    """Generalised tag and class of an element, and whether it is outside the article by itself."""
    said, label = OUT if tag in OUTSIDE else IN, tag
    if attributes and ("=" in attributes or "hidden" in attributes):
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value, name = a or b or c, name.lower()
            if name == "class":
                label = tag + "." + ".".join(sorted(DIGITS.sub("#", value.lower()).split()))
            if name in ("class", "id", "role"):
                if tag not in ("html", "body", "article", "main"):
                    said = max(said, _named(value))
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
                said = OUT
    if tag == "header" and not _inside(parent, ("article", "main")):
        said = OUT
    return label, said


def _path(parent: Element, label: str) -> int:
    return (parent.path * 1000003 + zlib.crc32(label.encode("utf-8", "replace"))) & 0x7FFFFFFFFFFFFFFF


def _inside(element: Element | None, tags: tuple) -> bool:
    while element is not None:
        if element.tag in tags:
            return True
        element = element.parent
    return False


def blocks(html: str, kept: frozenset = frozenset()) -> tuple[list[Element], list[tuple[Element, str]]]:
    """Elements of a page in order, and its text blocks with the element that holds each.

    A suspect element is outside unless its path is among ``kept``.

    Forgiving: unclosed paragraphs, items and cells end where the next begins, a closing tag ends all that is open
    inside its element, and one without an opening does nothing.
    """
    root = Element("#", 0, "#", False, False, None, 0)
    elements, found = [root], []
    open_tags: dict[str, int] = {}
    at, top, link, text = 0, root, 0, []
    chars = linked = 0

    def flush():
        nonlocal chars, linked
        if text:
            joined = "".join(text)
            line = " ".join((unescape(joined) if "&" in joined else joined).split())
            if line:
                found.append((top, line))
                top.own += len(line)
                top.linked += len(line) * (linked / chars if chars else 0)
            text.clear()
            chars = linked = 0

    def close(tag):
        nonlocal top
        while top is not root:
            own, top = top.tag, top.parent
            open_tags[own] -= 1
            if own == tag:
                return

    for m in TOKEN.finditer(html):
        if m.start() > at:
            part = html[at : m.start()]
            text.append(part)
            chars += len(part)
            linked += len(part) if link else 0
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag, ending = tag.lower(), m[2]
        if tag == "a":
            link = 0 if ending else 1
            continue
        if tag in CELLS:
            text.append(" ")
        if tag not in BREAKS and tag not in CELLS and tag not in OUTSIDE:
            # inline elements matter only if they are outside the article, and then those of the same name inside
            if ending:
                if open_tags.get(tag):
                    flush()
                    close(tag)
                continue
            nested = top.outside and open_tags.get(tag)
            if tag in VOID or not nested and (top.outside or not m[4]):
                continue
            if not nested:
                label, said = _described(tag, m[4], top)
                if said == IN or said == SUSPECT and _path(top, label) in kept:
                    continue
            flush()
        if ending:
            if open_tags.get(tag):
                flush()
                close(tag)
            elif tag in BREAKS:
                flush()
            continue
        if tag in BREAKS:
            flush()
        if tag in VOID:
            continue
        if tag in BREAKS and open_tags.get("p") and tag != "br":
            if top.tag == "p":
                close("p")
        if tag in SAME_CLOSES and top.tag == tag:
            close(tag)
        label, said = _described(tag, m[4], top)
        path = _path(top, label)
        outside = top.outside or said == OUT or said == SUSPECT and path not in kept
        if outside and not top.outside:
            flush()
        if m[4] and m[4].endswith("/"):
            continue
        top = Element(tag, path, label, outside, outside and not top.outside and said == SUSPECT, top, len(elements))
        elements.append(top)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag in HEADINGS and outside and top.parent.outside and _inside(top.parent, ("article",)) and _only_header(top.parent):
            top.outside = False
    if at < len(html):
        text.append(html[at:])
    flush()
    return elements, found


def _only_header(element: Element) -> bool:
    """Whether the outermost reason to leave an element out is that it is the article's own header."""
    while element.parent is not None and element.parent.outside:
        element = element.parent
    return element.tag == "header" or "header" in element.label


def container(elements: list[Element]) -> Element | None:
    """The element most likely to hold the article: text of its own paragraphs, less linked text, with a bonus for article and main."""
    best, most = None, 0.0
    for e in reversed(elements):  # children come after their parents
        if e.outside:
            continue
        plain = max(0.0, e.own - 2 * e.linked)
        if e.tag in TEXTUAL:
            if e.parent is not None:
                e.parent.own += e.own
                e.parent.linked += e.linked
                e.parent.below += e.below
            continue
        score = plain + 0.5 * e.below
        if e.tag in ("article", "main"):
            score = 4 * (plain + e.below)
        if e.parent is not None:
            e.parent.below += plain + (e.below if e.tag not in ("html", "body") else 0)
        if score >= most and score > 0 and e.tag not in ("#", "html") or best is None and score > 0:
            best, most = e, score
    return best


def text_of(found: list[tuple[Element, str]], inside) -> str:
    """Blocks inside the wanted elements and not outside the article, one a line."""
    known: dict[int, bool] = {}

    def wanted(e):
        chain = []
        while e is not None and e.number not in known:
            chain.append(e)
            if inside(e):
                known[e.number] = True
                break
            e = e.parent
        good = known[e.number] if e is not None else False
        for c in chain:
            known[c.number] = good
        return good

    return "\n".join(line for e, line in found if not e.outside and wanted(e))


def suspects(found: list[tuple[Element, str]]) -> dict[int, tuple[str, float, float]]:
    """Text, length and linked length of each path of suspect elements; they are what leaves their text out."""
    known: dict[int, Element | None] = {}

    def top(e):
        if e is None:
            return None
        if e.number not in known:
            known[e.number] = e if e.suspect else top(e.parent) if e.outside else None
        return known[e.number]

    texts: dict[int, list] = {}
    counted: set[int] = set()
    linked: dict[int, float] = {}
    for e, line in found:
        owner = top(e) if e.outside and _only_suspect(e) else None
        if owner is not None:
            texts.setdefault(owner.path, []).append(line)
            if e.number not in counted:
                counted.add(e.number)
                linked[owner.path] = linked.get(owner.path, 0.0) + e.linked
    return {path: ("\n".join(lines), float(sum(map(len, lines))), linked[path]) for path, lines in texts.items()}


def _only_suspect(element: Element) -> bool:
    """Whether nothing but a suspect name leaves an element out: no element on the way up to it is outside by itself."""
    while element is not None and element.outside and not element.suspect:
        if element.parent is None or not element.parent.outside:
            return False
        if element.tag in OUTSIDE or element.label != element.tag and _named(element.label.partition(".")[2].replace(".", " ")) == OUT:
            return False
        element = element.parent
    return element is not None and element.suspect


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A vote of each page for its best container (kind 0), and one row for each path of its suspect elements (kind 1)."""
    for batch in batches:
        rows: list[tuple] = []
        for host, html in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
            elements, found = blocks(html or "")
            seen = suspects(found)
            best = container(elements)
            if best is not None:
                rows.append((host, 0, best.path, best.label, best.own + best.below, 0.0, 0))
            rows += [(host, 1, path, "", chars, linked, zlib.crc32(text.encode("utf-8", "replace"))) for path, (text, chars, linked) in seen.items()]
        types = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        columns = zip(*rows) if rows else [[]] * len(types)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], [c.split(" ")[0] for c in VOTES.split(", ")])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for html, path, kept in zip(*(batch[c].to_pylist() for c in ("html", "path", "kept"))):
            elements, found = blocks(html or "", frozenset(kept or ()))
            text = text_of(found, lambda e, path=path: e.path == path) if path is not None else ""
            if not text:  # the page has no such place: its own best one
                best = container(elements)
                text = text_of(found, lambda e, best=best: e is best) if best else ""
            out.append(text)
        yield pa.record_batch(
            [batch["page_id"].cast(pa.int64()), batch["url"], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, label, kept): of each host the generalised tag-class path with the greatest weight of votes, ties to the
    smaller path, and the paths of suspect elements that hold article text.

    Those are paths with ``PROSE_CHARS`` characters a page on the average, of which less than ``LINKED_SHARE`` in links, and whose
    text is another one on more than half of their pages: what a site shows around its articles repeats, or is links.
    """
    ship(pages.sparkSession)
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_voted, VOTES)
    texts = votes.groupBy("host", "kind", "path", "hash").agg(F.sum("weight").alias("weight"), F.sum("linked").alias("linked"), F.min("label").alias("label"), F.count("*").alias("n"))
    paths = texts.groupBy("host", "kind", "path").agg(
        F.sum("weight").alias("weight"), F.sum("linked").alias("linked"), F.min("label").alias("label"), F.sum("n").alias("pages"), F.count("*").alias("texts")
    )
    prose = (F.col("weight") >= PROSE_CHARS * F.col("pages")) & (F.col("linked") < LINKED_SHARE * F.col("weight")) & (2 * F.col("texts") > F.col("pages"))
    vote = F.col("kind") == 0
    best = F.max_by(F.when(vote, F.struct("path", "label")), F.when(vote, F.struct("weight", (-F.col("path")).alias("order"))))
    kept = F.sort_array(F.collect_set(F.when((F.col("kind") == 1) & prose, F.col("path"))))
    return paths.groupBy("host").agg(best.alias("best"), kept.alias("kept")).select("host", "best.path", "best.label", "kept")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Each page votes for the generalised path (tags with their classes, digits as #) of its best container, with
    its text as weight; Spark sums the votes by host and path. Pages are then read again with their host's
    winning path, and take their own best container only if they have no text there. Menus, headers, footers,
    sidebars, notices, adverts, forms, comments, hidden parts, scripts and styles are left out at any depth. They are known by
    their tag, role or name; where a name has other words as well, the host's pages decide by the text in such places
    (:func:`host_paths`).

    Votes are summed before they are shuffled, so a host with a third of all pages is one row a task. Winning
    paths, one row a host, are stored, so Spark broadcasts them only while they are small. Null or empty html
    gives an empty text; a null url counts as a host of its own. Repeated rows give repeated rows, an
    empty table an empty one; further columns are ignored.
    """
    winners = stored(host_paths(pages).select("host", "path", "kept"), "host-paths")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(winners, "host", "left")
    return rows.select("page_id", "url", "html", "path", "kept").mapInArrow(_extracted, RESULT)
