"""HTML main-text extraction by equivalence-class template deduction over the pages of a host.

Tokens are elements, named by the path of tags and classes to them, and whole text blocks. The occurrence vector of a token
is its count on every page of the host; tokens with equal vectors form an equivalence class. Vectors are compared by the
number of pages and the sum of hashed (page, count) pairs, so they are grouped sums with map-side combining: a host with
a third of all pages is no special case. Only the tokens that half of a host's pages have, no more than two pages' worth, come
together for each host; deduce() makes its template of them:

* Classes of more than one token, and those on every page, are valid. They nest by the elements around their tokens.
* What an element of the template holds beside the template elements inside it is its slot, with text and link characters.
* From the outermost class the way leads into the element, once a page at most, that holds more than half of the free text
  (neither link nor fixed, nor in an element named as something else) as long as there is one; where it ends is the main region.
* Slots of the region stay, but for those that are mostly links, those that are named as something else (nav, form,
  class="comments") and do not hold most of the region, and text blocks of the outermost class: fixed texts.

Pages are then read again, and the blocks of the remaining slots come out whole. A page without its host's region is deduced as a
host of one page.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import scratch
from .url_filter import split_url

#: Elements without content, elements that end an open p, elements inside a line, elements whose content is not
#: text, elements that group others, and elements and names of what is not the article.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style noscript template textarea iframe xmp noframes title".split())
GROUPS = frozenset("html body div section article main table tbody tr td center".split())
OUTSIDE = frozenset("nav footer aside form head menu dialog button select svg object".split())
OUTSIDE_NAMES = frozenset("ad ads advert advertisement adverts aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu modal nav navbar navigation newsletter notice notices pagination popup promo related replies respond share sharing sidebar social sponsor sponsored subscribe widget contentinfo complementary search".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: No part of it is tried twice over the same characters, so broken markup costs no more than sound markup.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++))?+)*+)(>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
#: A host's template holds tokens that this share of its pages have. Fixed texts are told from chance on this many pages.
SUPPORT, FIXED_PAGES = 0.5, 5
#: Bytes of templates that may be broadcast; beyond it they are joined to the pages by host.
BROADCAST_BYTES = 24 << 20


class Block(NamedTuple):
    text: str
    node: int
    link_chars: int


class Node(NamedTuple):
    """All elements of a page that share a path."""

    key: int
    above: int
    name: str
    outside: bool


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=lambda: [Node(0, -1, "", False)])
    count: list[int] = field(default_factory=lambda: [1])


def _hash(what: str, seed: int = 0) -> int:
    """A signed long."""
    h = xxhash.xxh64_intdigest(what.encode("utf-8", "surrogatepass"), seed & (2**64 - 1))
    return h - (1 << 64) if h >> 63 else h


def text_key(text: str) -> int:
    return _hash(text, 0x7E27)


def _element(name: str, attrs: str, headed: bool) -> tuple[str, bool]:
    """(token name, whether it names what is outside the article: by its tag, or by a whole word of class, id or role of which
    every part between hyphens does). headed: a header here is an article's own."""
    label, outside = name, name in OUTSIDE or name == "header" and not headed
    if attrs:
        for m in _NAMES.finditer(attrs):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() != "id":
                label += "." + value
            outside = outside or any(OUTSIDE_NAMES.issuperset(re.split("[-_]+", word)) for word in value.split())
    return label, outside and name not in ("html", "body")


def parse(source: str | None) -> Page:
    """The page's text blocks and the paths of elements around them, in time linear in its length. Unclosed and stray tags are
    put up with."""
    page, source = Page(), source or ""
    known: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, node, whether a link was open around it
    open_names: Counter = Counter()
    texts: list[str] = []
    links, link = 0, False

    def flush() -> None:
        nonlocal texts, links
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                page.blocks.append(Block(text, stack[-1][1], min(links, len(text))))
            texts, links = [], 0

    def cut(n: int) -> None:
        nonlocal link
        flush()
        link = stack[n][2]
        open_names.subtract(e[0] for e in stack[n:])
        del stack[n:]

    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        end = m.start() if m else size
        if end > at:
            texts.append(source[at:end])
            if link:
                links += end - at
        if not m:
            break
        at, name = m.end(), m[2]
        if not name or m[4] != ">":
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                link = not m[1]
            continue
        if m[1]:
            if open_names[name] > 0:
                cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
            else:
                flush()
            continue
        if name in VOID:
            flush()
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else size
            continue
        flush()
        while stack[-1][0] in CLOSES.get(name, ()) or stack[-1][0] == "p" and name in ENDS_P:
            cut(len(stack) - 1)
        label, outside = _element(name, m[3], any(open_names[x] > 0 for x in ("article", "main", "section")))
        above = stack[-1][1]
        node = known.get((above, label))
        if node is None:
            node = known[above, label] = len(page.nodes)
            page.nodes.append(Node(_hash(label, page.nodes[above].key), above, name, outside))
            page.count.append(0)
        page.count[node] += 1
        stack.append((name, node, link))
        open_names[name] += 1
    flush()
    return page


class Token(NamedTuple):
    """An element (above is the key of the path around it, name its tag) or a text block (name is null, above the element's key),
    with its occurrences: pages, vector and the most on one page; chars and linked count text and link characters in it."""

    token: int
    above: int
    name: str | None
    outside: bool
    pages: int
    vector: int
    most: int
    chars: int
    linked: int


def tokens_of(page: Page):
    """(token, above, name, outside, count, chars, linked) of a page."""
    chars, linked = [0] * len(page.nodes), [0] * len(page.nodes)
    texts: dict[int, list] = {}
    for b in page.blocks:
        chars[b.node] += len(b.text)
        linked[b.node] += b.link_chars
        t = texts.setdefault(text_key(b.text), [page.nodes[b.node].key, 0, len(b.text)])
        t[1] += 1
    for i in range(len(page.nodes) - 1, 0, -1):  # an element comes after the one around it
        above = page.nodes[i].above
        chars[above] += chars[i]
        linked[above] += linked[i]
    for i, node in enumerate(page.nodes):
        yield node.key, page.nodes[node.above].key if i else 0, node.name, node.outside, page.count[i], chars[i], linked[i]
    for key, (above, n, size) in texts.items():
        yield key, above, None, False, n, n * size, 0


class Template(NamedTuple):
    """Keys: the main region, elements inside it that do not belong to it, fixed texts."""

    region: int
    drop: frozenset[int]
    fixed: frozenset[int]


def valid_classes(tokens: list[Token], of: int) -> dict[tuple[int, int], list[Token]]:
    """The equivalence classes by (pages, vector) that have more than one token or are on every page."""
    classes: dict[tuple[int, int], list[Token]] = defaultdict(list)
    for t in tokens:
        classes[t.pages, t.vector].append(t)
    return {k: c for k, c in classes.items() if len(c) > 1 or k[0] == of}


def deduce(tokens: list[Token], of: int) -> Template | None:
    """The template of a host of `of` pages, from the tokens that enough of them have. None without an outermost element."""
    classes = valid_classes(tokens, of)
    class_of = {t.token: k for k, c in classes.items() for t in c if t.name is not None}
    element = {t.token: t for t in tokens if t.name is not None}
    top = next((t for t in element.values() if t.token == 0), None)
    if top is None or 0 not in class_of:
        return None
    # The template: every element of a valid class under the nearest such element around it.
    inside: dict[int, list[Token]] = defaultdict(list)
    holder: dict[int, int] = {0: 0}

    def around(key: int) -> int:
        """The template element that holds the element key, or is it."""
        way = []
        while key not in class_of and key in element and key != 0:
            way.append(key)
            key = element[key].above
        key = key if key in class_of else 0
        for k in way:
            holder[k] = key
        return key

    for key in class_of:
        if key != 0:
            inside[around(element[key].above)].append(element[key])
    order = [0]
    for key in order:
        order += [t.token for t in inside[key]]
    root = class_of[0]
    fixed = [t for t in classes[root] if t.name is None] if of >= FIXED_PAGES else []
    if 2 * sum(t.chars for t in fixed) > top.chars:  # pages that are copies of each other: their text is not the template's
        fixed = []
    still, apart = Counter(), Counter()  # characters of fixed texts, and of elements named as something else, in each element
    for t in fixed:
        still[around(t.above)] += t.chars
    for key in reversed(order):
        for t in inside[key]:
            still[key] += still[t.token]
            apart[key] += max(t.chars - t.linked - still[t.token], 0) if t.outside else apart[t.token]

    def free(t: Token) -> int:
        return t.chars - t.linked - still[t.token]

    region = top
    while True:
        left = {t.token: free(t) for t in inside[region.token] if t.most == 1 and t.name in GROUPS}
        best = max(left, key=lambda k: (left[k], -k), default=None)
        if best is None or 2 * left[best] <= free(region) - apart[region.token]:
            break
        region = element[best]
    if 2 * still[region.token] > region.chars:
        fixed = []
    drop, ways = set(), list(inside[region.token])
    for t in ways:
        if t.chars and 2 * t.linked > t.chars or t.outside and 2 * t.chars <= region.chars:
            drop.add(t.token)
        else:
            ways += inside[t.token]
    return Template(region.token, frozenset(drop), frozenset(t.token for t in fixed))


def main_text(source: str | None, template: Template | None) -> str:
    """The blocks of the template's slots in page order. A page that has nothing in the region is a host of its own."""
    page = parse(source)
    keys = {n.key for n in page.nodes}
    if template is None or template.region not in keys:
        template = deduce([Token(t, a, name, outside, 1, n, n, c, k) for t, a, name, outside, n, c, k in tokens_of(page)], 1)
    held = [0] * len(page.nodes)
    for b in page.blocks:
        held[b.node] += len(b.text)
    for i in range(len(page.nodes) - 1, 0, -1):
        held[page.nodes[i].above] += held[i]
    whole = max((h for n, h in zip(page.nodes, held) if n.key == template.region), default=0)
    stays = [False] * len(page.nodes)
    for i, node in enumerate(page.nodes):
        # Elements that the template does not know are judged by the page itself.
        out = node.key in template.drop or node.outside and 2 * held[i] <= whole
        stays[i] = node.key == template.region or node.above >= 0 and stays[node.above] and not out
    return " ".join(b.text for b in page.blocks if stays[b.node] and text_key(b.text) not in template.fixed)


_TOKENS = "host string, id string, token long, above long, name string, outside boolean, n int, chars long, linked long"


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, region, drop, fixed): the template of each host."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in _TOKENS.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for pid, url, source in zip(*(c.to_pylist() for c in batch.columns)):
                host = split_url(url)[0]
                rows += [(host, str(pid), *t) for t in tokens_of(parse(source))]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def deduced(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                t = deduce([Token(**x) for x in row["tokens"]], row["of"])
                if t:
                    found.append({"host": row["host"], "region": t.region, "drop": sorted(t.drop), "fixed": sorted(t.fixed)})
            yield pa.RecordBatch.from_pylist(found, pa.schema([("host", pa.string()), ("region", pa.int64()), ("drop", pa.list_(pa.int64())), ("fixed", pa.list_(pa.int64()))]))

    seen = pages.select(id_col, url_col, html_col).mapInArrow(run, _TOKENS)
    held = seen.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum(F.xxhash64("id", "n").cast("decimal(38,0)")).alias("vector"), F.max("n").alias("most"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("above").alias("above"), F.min("name").alias("name"), F.max("outside").alias("outside"))
    held = scratch.cut(held, "tokens")
    hosts = held.where("token = 0").select("host", F.col("pages").alias("of"))  # every page has the outermost token once
    known = held.join(hosts, "host").where(F.col("pages") >= SUPPORT * F.col("of"))
    token = F.struct("token", "above", "name", "outside", "pages", F.col("vector").cast("string").alias("vector"), "most", "chars", "linked")
    return known.groupBy("host", "of").agg(F.collect_list(token).alias("tokens")).mapInArrow(deduced, "host string, region long, drop array<long>, fixed array<long>")


def _host(url_col: str):
    """The host as split_url() has it."""
    host = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text), row for row: the main text of each page.

    Character references are decoded once, white space inside a block becomes one space, blocks are joined by one space.
    Null and empty pages give an empty text; null urls share the empty host. Repeated ids stay rows of their own. Other
    columns are ignored.
    """
    found = scratch.cut(templates(pages, id_col, url_col, html_col), "templates")
    size = found.agg(F.sum(200 + 4 * F.length("host") + 100 * (F.size("drop") + F.size("fixed")))).first()[0] or 0
    schema = StructType([pages.schema[id_col], pages.schema[url_col], StructField("text", StringType())])
    rows = pages.select(id_col, url_col, html_col)

    def whole(region, drop, fixed):
        return None if region is None else Template(region, frozenset(drop), frozenset(fixed))

    if size <= BROADCAST_BYTES:
        known = rows.sparkSession.sparkContext.broadcast({r["host"]: whole(r["region"], r["drop"], r["fixed"]) for r in found.collect()})

        def look(batch):
            return [known.value.get(split_url(u)[0]) for u in batch.column(1).to_pylist()]

    else:
        rows = rows.withColumn("host", _host(url_col)).join(found, "host", "left").select(id_col, url_col, html_col, "region", "drop", "fixed")

        def look(batch):
            return [whole(*x) for x in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)))]

    def run(batches):
        for batch in batches:
            texts = [main_text(source.as_py(), how) for source, how in zip(batch.column(2), look(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
