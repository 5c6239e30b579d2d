"""Main text of web pages by equivalence classes of template tokens.

A page is a sequence of tokens: opening tags told apart by their path and names, and texts told apart by their path and
content. Tokens of one host that occur equally often on each of its pages have one occurrence vector and form an
equivalence class. A class is valid where its tokens stand in one order on every page, again and again, and each such
round begins and ends at the same token of the classes above it (those on more pages, then those that occur less). Valid
classes, nested in this way, are the host's template; what follows a template token up to the next is that token's
slot. Texts that belong to the template are no main text, nor are slots of mere links. What remains is extracted from
the page's article, by the meaning of its elements.

Vectors are sums of hashes and are compared as such, so hosts of any size are grouped without gathering their pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import heavy_join, keep, small_batches

# Names of elements and attributes by their meaning.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
IN_HEAD = frozenset("title meta link style script base noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body caption head html legend option optgroup select tbody td tfoot th thead tr".split())
#: An opening tag ends an open element of these, unless one of the barriers stands between.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
DROPPED = frozenset("aside audio button canvas datalist dialog footer form head iframe input label legend map menu nav noembed noframes noscript object option script search select style svg template textarea title video xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising aside banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
NEGATED = frozenset("has no not with without".split())
MAIN_NAMES = frozenset(
    "article article-body article-content articlebody content content-body entry entry-content main main-content maincontent page-content post post-body post-content story story-body story-content".split()
)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TELLING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
NONE, ARTICLE, MAIN, NAMED, OUT, HEADER = range(6)


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest(repr(parts)) - (1 << 63)


def role_of(tag: str, attrs: str) -> tuple[int, str]:
    """What an element's names say of it, and the names that tell it apart from others on its path."""
    if not attrs or not _TELLING.search(attrs):
        return (OUT if tag in DROPPED else HEADER if tag == "header" else ARTICLE if tag == "article" else MAIN if tag == "main" else NONE), ""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTR.finditer(attrs)))}
    kind, names = found.get("role", "").strip().lower(), f"{found.get('class', '')} {found.get('id', '')}"
    key = f"{names.strip()}|{kind}"
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", found.get("style", ""), re.I)
    if tag in DROPPED or hidden or kind in DROPPED_ROLES:
        return OUT, key
    if tag not in ("html", "body"):
        for name in names.split():
            words = [w.lower() for w in _WORDS.findall(name)]
            if any(w in DROPPED_NAMES and not (i and words[i - 1] in NEGATED) for i, w in enumerate(words)) and not (tag in ("article", "main") and words[0] not in ("comment", "comments", "reply", "related", "sponsored", "promo", "ad")):
                return OUT, key
    if tag == "header":
        return HEADER, key
    if tag == "article" or kind == "article" or found.get("itemprop", "").lower() == "articlebody":
        return ARTICLE, key
    if tag == "main" or kind == "main":
        return MAIN, key
    return (NAMED if tag in ("div", "section", "td") and any(n.lower().replace("_", "-") in MAIN_NAMES for n in names.split()) else NONE), key


class Element(NamedTuple):
    tag: str
    parent: int
    sig: int
    role: int
    named: bool


class Page(NamedTuple):
    """Elements, and in page order (element, block, text): text is None for an opening tag, block counts block borders."""

    elements: list[Element]
    items: list[tuple[int, int, str | None]]


def parse(source: str, roles: dict[tuple[str, str], tuple[int, str]]) -> Page:
    """The page's elements and texts, character references decoded. Forgiving: unclosed, stray and cut tags are as browsers take them, roughly.

    roles: a cache of role_of, which the caller bounds.
    """
    elements, items, stack, block, at = [Element("", -1, 0, NONE, False)], [], [0], 0, 0
    held: Counter[str] = Counter()  # open elements by tag

    def end(to: int) -> None:
        nonlocal block
        tags = [elements[e].tag for e in stack[to:]]
        block += not BLOCK.isdisjoint(tags)
        held.subtract(tags)
        del stack[to:]

    def opened(tags: tuple[str, ...], barriers: tuple[str, ...] = ()) -> int:
        if any(held[t] for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                tag = elements[stack[i]].tag
                if tag in tags:
                    return i
                if tag in barriers:
                    return 0
        return 0

    while m := _TOKEN.search(source, at):
        if m.start() > at:
            items.append((stack[-1], block, html.unescape(source[at : m.start()])))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if at == len(source) and not m[0].endswith(">"):
            break  # a tag that the page's end cuts
        if m[1]:
            if i := opened((tag,)):
                end(i)
            elif tag in ("p", "br"):
                block += tag == "p"
                items.append((stack[-1], block, " "))
            continue
        if tag == "body" and len(stack) > 1:
            end(2 if elements[stack[1]].tag == "html" else 1)
        elif tag not in IN_HEAD and (i := opened(("head",), ("body",))):
            end(i)
        if tag in ENDS_P and (i := opened(("p",), ("button", "td", "th", "caption", "object", "table"))):
            end(i)
        if tag in ENDS and (i := opened(*ENDS[tag])):
            end(i)
        known = roles.get((tag, m[3]))
        if known is None:
            known = roles[tag, m[3]] = role_of(tag, m[3])
        if tag in BLOCK:
            block += 1
        elements.append(Element(tag, stack[-1], _hash(elements[stack[-1]].sig, tag, known[1]), known[0], bool(known[1])))
        items.append((len(elements) - 1, block, None))
        if tag == "br":
            items.append((stack[-1], block, " "))
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else len(source)
        elif tag not in VOID:
            stack.append(len(elements) - 1)
            held[tag] += 1
        elif tag in BLOCK:
            block += 1
    if at < len(source):
        items.append((stack[-1], block, html.unescape(source[at:])))
    return Page(elements, items)


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def tokens(page: Page) -> tuple[list[int], list[int]]:
    """The page's tokens in order, and of each: -1 a tag, else twice the text's length, and one more within a link."""
    linked = [False] * len(page.elements)
    for i, e in enumerate(page.elements[1:], 1):
        linked[i] = linked[e.parent] or e.tag == "a"
    out, kinds = [], []
    for e, _, text in page.items:
        if text is None:
            out.append(page.elements[e].sig)
            kinds.append(-1)
        elif text := _squeezed(text):
            out.append(_hash(page.elements[e].sig, text))
            kinds.append(2 * len(text) + linked[e])
    return out, kinds


def main_text(page: Page, template: frozenset[int] = frozenset(), links: frozenset[int] = frozenset()) -> str:
    """The text of the page's article. template: the host's template tokens; links: those whose slots are mere links.

    The article is what lies in article elements, else in the main one, else in one named like that, else the whole
    body, without elements whose tag, role or names mark them as something else. Of a header in it the headings stay.
    Template texts are left out, within an article only where an element with names of its own holds them.
    """
    elements = page.elements
    out, heading, best = [0] * len(elements), [False] * len(elements), OUT
    for i, e in enumerate(elements[1:], 1):
        out[i] = 2 if e.role == OUT else max(out[e.parent], int(e.role == HEADER))
        heading[i] = heading[e.parent] or e.tag in HEADINGS
    texts = {e for e, _, text in page.items if text and not out[e] and not text.isspace()}
    inside = [True] * len(elements)
    for kind in (ARTICLE, MAIN, NAMED):
        held = [False] * len(elements)
        for i, e in enumerate(elements[1:], 1):
            held[i] = held[e.parent] or e.role == kind
        if any(held[e] for e in texts):
            inside, best = held, kind
            break
    blocks: dict[int, list[str]] = {}
    slot = 0
    for e, block, text in page.items:
        if text is None:
            slot = elements[e].sig if elements[e].sig in template else slot
        elif inside[e] and (not out[e] or out[e] == 1 and heading[e] and best != OUT):
            if template and not text.isspace():
                if best == OUT and slot in links:
                    continue
                holder = e
                while elements[holder].tag not in BLOCK and elements[holder].parent > 0:
                    holder = elements[holder].parent
                if (best == OUT or elements[holder].named and elements[holder].role == NONE) and _hash(elements[e].sig, _squeezed(text)) in template:
                    continue
            blocks.setdefault(block, []).append(text)
    return "\n".join(x for x in map(_squeezed, map("".join, blocks.values())) if x)


def _parsed(texts: pa.Array) -> Iterator[Page]:
    roles: dict[tuple[str, str], tuple[int, str]] = {}
    for i in range(len(texts)):
        if len(roles) > 20_000:
            roles.clear()
        yield parse(texts[i].as_py() or "", roles)


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, page (hash of its tokens), t (distinct tokens), n (how often each), kind (of its first), seq (all, as places in t), size (kinds of seq)."""
    for batch in batches:
        rows: list[tuple] = []
        for host, page in zip(batch.column("host").to_pylist(), _parsed(batch.column("html"))):
            found, kinds = tokens(page)
            place: dict[int, int] = {}
            seq = [place.setdefault(t, len(place)) for t in found]
            counts = np.bincount(np.array(seq, np.int64), minlength=len(place)).tolist()
            first = dict(zip(reversed(seq), reversed(kinds)))
            rows.append((host, _hash(found), list(place), counts, [first[i] < 0 for i in range(len(place))], seq, kinds))
        kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["host", "page", "t", "n", "tag", "seq", "size"])


def rounds(seq: list[int], members: dict[int, int], above: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """For each class on a page (class, order, slot): one hash for its order and one for its place; 0 where they aren't the same in each round.

    seq: the page's tokens; members: their classes; above: a class's rank. A round is the class's tokens once each;
    its slot is the last token before it of a class that ranks above, and none of those may come within it.
    """
    order: dict[int, list[int]] = {}
    slots: dict[int, set[int]] = {}
    last: list[tuple[int, int]] = []  # (rank, token): the last tokens of ranks that rise from the first to the last
    for t in seq:
        c = members.get(t)
        if c is None:
            continue
        while last and last[-1][0] >= above[c]:
            last.pop()
        slots.setdefault(c, set()).add(last[-1][1] if last else 1)
        last.append((above[c], t))
        order.setdefault(c, []).append(t)
    for c, found in order.items():
        n = len(set(found))
        same = all(found[i : i + n] == found[:n] for i in range(n, len(found), n))
        yield c, _hash(found[:n]) if same else 0, next(iter(slots[c])) if len(slots[c]) == 1 else 0


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, key, order, slot, chars, linked: of each class on a page its order and slot (chars null), and of each slot the length of its texts."""
    for batch in batches:
        rows: list[tuple] = []
        known: dict[str, tuple[dict[int, int], dict[int, int]]] = {}
        for host, classes, t, seq, size in zip(batch.column("host").to_pylist(), batch.column("classes"), *(batch.column(c).to_pylist() for c in ("t", "seq", "size"))):
            if host not in known:
                told = classes.as_py()
                known[host] = {x["t"]: x["class"] for x in told}, {x["class"]: x["above"] for x in told}
            members, above = known[host]
            found = [t[i] for i in seq]
            rows += [(host, c, order, slot, None, None) for c, order, slot in rounds(found, members, above)]
            chars: dict[int, list[int]] = {}
            at = 0
            for x, k in zip(found, size):
                if x in members:
                    at = x
                elif k >= 0:
                    held = chars.setdefault(at, [0, 0])
                    held[0] += k >> 1
                    held[1] += (k >> 1) * (k & 1)
            rows += [(host, at, None, None, *x) for at, x in chars.items()]
        kinds = (pa.string(), *[pa.int64()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["host", "key", "order", "slot", "chars", "linked"])


def templates(pages: DataFrame, least_pages: int = 4, support: float = 0.3, link_share: float = 0.9) -> DataFrame:
    """One row a host: host, template (tokens of valid classes), links (those whose slots are mere links).

    pages: host and html. Pages with equal tokens count once. A class has two tokens or more, a tag among them, and
    stands on `support` of its host's pages, so a host's template has at most 1 / support times the distinct tokens of
    its mean page. Hosts with fewer than `least_pages` pages, and pages without a host, have no template.
    """
    seen = keep(pages.filter("host != ''").mapInArrow(_tokenised, "host string, page long, t array<long>, n array<int>, tag array<boolean>, seq array<int>, size array<int>"), "page-tokens")
    seen = keep(seen.dropDuplicates(["host", "page"]), "pages-once")
    hosts = seen.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    each = seen.select("host", "page", F.explode(F.arrays_zip("t", "n", "tag")).alias("x")).select("host", "page", "x.*")
    vector = F.sum(F.shiftright(F.xxhash64("page", "n"), 24))
    held = each.groupBy("host", "t").agg(F.count("*").alias("on"), F.sum("n").alias("times"), vector.alias("vector"), F.bit_xor(F.xxhash64("n", "page")).alias("other"), F.max("tag").alias("tag"))
    held = heavy_join(keep(held.filter(F.col("on") >= 2), "vectors"), hosts, "host").filter(F.col("on") >= F.col("pages") * support)
    classed = keep(held.select("host", "t", "tag", "on", "times", F.xxhash64("on", "times", "vector", "other").alias("class")), "classes")
    sizes = classed.groupBy("host", "class").agg(F.count("*").alias("m"), F.max("tag").alias("tagged"), F.first("on").alias("on"), F.first("times").alias("times")).filter("m > 1 AND tagged")
    member = classed.select("host", "t", "tag", "class").join(sizes, ["host", "class"])
    listed = F.array_sort(F.collect_list(F.struct(-F.col("on"), F.col("times"), F.col("class"), F.col("t"), F.col("tag"))))
    by_host = member.groupBy("host").agg(listed.alias("all"))
    ranks = F.array_distinct(F.transform("all", lambda x: x["class"]))
    by_host = keep(by_host.withColumn("ranks", ranks).select("host", F.transform("all", lambda x: F.struct(x["t"].alias("t"), x["tag"].alias("tag"), x["class"].alias("class"), (F.array_position("ranks", x["class"]) - 1).alias("above"))).alias("classes")), "host-classes")
    found = heavy_join(seen, by_host, "host").mapInArrow(_checked, "host string, key long, order long, slot long, chars long, linked long")
    told = keep(found.groupBy("host", "key").agg(*(f(c).alias(f"{n}_{c}") for c in ("order", "slot") for n, f in (("least", F.min), ("most", F.max))), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")), "told")
    valid = told.filter("least_order = most_order AND least_order != 0 AND least_slot = most_slot AND least_slot != 0").select("host", F.col("key").alias("class"))
    links = told.filter(F.col("linked") >= F.col("chars") * link_share).select("host", F.col("key").alias("t"), F.lit(True).alias("mere"))
    rows = by_host.select("host", F.explode("classes").alias("x")).select("host", "x.*").join(valid, ["host", "class"], "left_semi").join(links, ["host", "t"], "left")
    return rows.groupBy("host").agg(F.collect_list("t").alias("template"), F.collect_list(F.when(F.col("mere"), F.col("t"))).alias("links"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[bytes, tuple[frozenset[int], frozenset[int]]] = {}
        texts = []
        for host, template, links, page in zip(batch.column("host").to_pylist(), batch.column("template"), batch.column("links"), _parsed(batch.column("html"))):
            if host not in known:
                known[host] = frozenset(template.as_py() or ()), frozenset(links.as_py() or ())
            texts.append(main_text(page, *known[host]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_pages(pages: DataFrame, least_pages: int = 4, support: float = 0.3) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Blocks of the article in page order, joined by line feeds; white space within a block is one space; character
    references are decoded. A null or empty html, or one without an article's text, gives an empty text; a null or
    odd url a page without a host, whose template is unknown. Repeated rows give repeated rows. Columns other than
    page_id, url and html are ignored. No rows: an empty result.
    """
    small_batches(pages.sparkSession)
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    rows = pages.select("page_id", "url", host.alias("host"), "html")
    found = templates(rows.select("host", "html"), least_pages, support)
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"
    texts = heavy_join(rows, keep(found, "templates"), "host", "left", least=32).mapInArrow(_extracted, schema)
    return texts.withColumn("n_chars", F.length("text").cast("long"))
