"""Main-text extraction by wrappers inferred from all pages of a host.

A wrapper is a union-free regular expression over a page's tokens: tags, fixed
text, text slots, optional groups `( )?` and repeated groups `( )+`. It is
inferred by aligning the token streams of a host's pages one after the other,
run by run, a run being the tokens from an element's start tag to its end tag.
Where streams differ, texts become a slot, runs that one side lacks become
optional, and the runs from the first to the last one of a tag that comes back
become a repeated group.

Each page is then matched against its host's wrapper, and what its texts match
decides with the page's own marks (tags, roles and class words of menus,
headers, footers, sidebars, notices, adverts, forms and comments):

* what stands in the page's article is its text, else what stands in its main
  element, and nothing of that goes but by its own marks;
* of a page without either, text that the pages of the host share, in a place of
  its own, is template text and goes, and a repeated group whose slots are all
  links is a menu or a list of teasers and goes, unless a class names it the
  article's own references;
* the other slots are the page's text.

A host of fewer than `MIN_PAGES` pages (copies that one task reads count once),
or whose pages share most of their text, says nothing about fixed text.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import checkpointed, importable, slices

#: Hosts that a task aligns at once; with more it sends what it has and goes on.
HELD = 2_000
#: Nesting up to which tags take part in inference; deeper text counts for the element at that depth.
DEPTH = 100
#: Pages of a host from which on shared text is template text.
MIN_PAGES = 3
#: Kinds of runs beside each other up to which each is kept by its own sign; of more, those of few pages are one kind for each tag.
KINDS = 64
#: Share of a repeated group's text that is links in a menu.
LINKED = 0.8
#: Pairs of runs that are aligned in order; an element with more is one repeated group.
PAIRS = 10_000
#: First fold of a host's trees: into so many parts, then into one.
PARTS = 256
#: Bytes of wrappers up to which they are sent to the tasks; beyond, a join shuffles.
BROADCAST_BYTES = 16 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][A-Za-z0-9:-]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""([A-Za-z_:@][\w:.-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")
#: Numbers in a class that count a page's parts, or name the page, and not a kind of part.
_NUMBER = re.compile(r"(?<![a-z0-9])\d+(?![a-z0-9])|\d{3,}")

_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that others end when their end tag is missing.
_ENDED_BY = {"p": _BLOCK - {"option", "optgroup", "legend"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}}
_ENDS = {name: {e for e, by in _ENDED_BY.items() if name in by} for name in set().union(*_ENDED_BY.values())}
_SCOPE = {"table", "ul", "ol", "dl", "article", "section", "div", "body", "main", "td", "th", "blockquote", "select", "html"}
_OUT_TAGS = set("nav header footer aside form script style head template noscript iframe button select textarea svg canvas object audio video map menu dialog title datalist noembed noframes xmp math".split())
_OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Names of a class or id that mark what is not the article, and words that may stand beside them in one.
_OUT_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promoted promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer sidebar sidebars aside "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts banner banners popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations teaser teasers widget widgets "
    "comment comments commentlist respond replies reply disqus discussion search form copyright".split()
)
_BESIDE = set(
    "area bar block body bottom box btn button buttons col column container content contents fixed footer global group head heading holder icons inner "
    "item items left link links list main message module page panel post posts primary right row secondary section site slot strip text title top unit wrap wrapper".split()
)
#: Words of a class or id that mark a list of links as the article's own.
_OWN_LINKS = set("bibliography citations endnotes footnotes notes references refs sources".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements whose class words don't count.
_TRUSTED = {"html", "body", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6"}


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(rest)} if rest and not rest.isspace() else {}


def _is_out(name: str, attrs: dict[str, str]) -> bool:
    """Does the element hold what is not the article?"""
    if name in _OUT_TAGS:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").lower().replace(" ", ""):
        return True
    if attrs.get("role", "").lower() in _OUT_ROLES:
        return True
    if name in _TRUSTED:
        return False
    return any(_marks_out(name) for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split())


@lru_cache(maxsize=4096)
def _marks_out(name: str) -> bool:
    """Is a class or id a name of what is not the article, by itself or beside words that say nothing?

    `cookie-notice` and `related-posts` are; `social-history`, which names what a text is about, is not.
    """
    words = {w for w in _WORD.findall(name) if not w.isdigit()}
    return bool(words & _OUT_WORDS) and words <= _OUT_WORDS | _BESIDE


@dataclass
class _Open:
    name: str
    sign: str  # the tag as the wrapper sees it
    out: bool


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", text, {}), ("open", name, attributes) and ("close", name, {}); raw elements' contents are passed over."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            yield "text", page[at:], {}
            return
        if m.start() > at:
            yield "text", page[at : m.start()], {}
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                yield "text", html_lib.escape(m[0][9:].removesuffix("]]>")), {}
            continue
        if m["end"] or m["end2"]:
            yield "close", name, {}
            continue
        yield "open", name, _attributes(m["rest"] or m["rest2"] or "")
        if name in _RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else n


class _Walker:
    """Open elements, with missing end tags supplied."""

    def __init__(self):
        self.stack: list[_Open] = []
        self.out = 0
        self.names: Counter[str] = Counter()

    def open(self, name: str, attrs: dict[str, str]) -> _Open | None:
        ends = _ENDS.get(name)
        if ends:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].name in ends:
                    self._cut(i)
                    break
                if self.stack[i].name in _SCOPE:
                    break
        out = _is_out(name, attrs)
        if name == "header" and out and not self.out and (self.names["article"] or self.names["main"]):
            out = False  # its headings are the article's; what else is in it is told apart by `keeps`
        if name in _VOID or (name not in _BLOCK and not out):
            return None
        words = sorted(set(_WORD.findall(_NUMBER.sub("", attrs.get("class", "").lower())))) if name not in ("html", "body") else []
        element = _Open(name, ".".join([name, *words]), out)
        self.stack.append(element)
        self.names[name] += 1
        self.out += out
        return element

    def close(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name == name:
                self._cut(i)
                return
            if self.stack[i].name == "body" or (self.stack[i].name in ("article", "main", "section", "table", "div", "aside", "nav") and name in ("p", "li")):
                return

    def _cut(self, to: int) -> None:
        for e in self.stack[to:]:
            self.out -= e.out
            self.names[e.name] -= 1
        del self.stack[to:]

    def keeps(self) -> bool:
        if self.out:
            return False
        return not self.names["header"] or any(self.names[h] for h in _HEADINGS)


# --- inference

TEXT, GROUP = "#", "+"


@dataclass
class Node:
    """A run of tokens: an element with its parts in order, a text, or a repeated group of runs."""

    sign: str
    text: str | None = ""  # of a text: the fixed one; None if it is a slot
    length: int = 0  # characters of all texts that were aligned here
    linked: int = 0  # those of them in links
    count: int = 1  # pages that have it
    optional: bool = False
    repeated: bool = False
    parts: list[Node] = field(default_factory=list)
    block: int = -1  # of a page's text: the number of its block

    def pattern(self) -> str:
        """The wrapper as a union-free regular expression."""
        inner = "".join(p.pattern() for p in self.parts)
        if self.sign == TEXT:
            body = "#TEXT" if self.text is None else self.text[:20]
        else:
            body = inner if self.sign in ("", GROUP) else f"<{self.sign}>{inner}</{self.sign.split('.')[0]}>"
        if self.repeated:
            body = f"({body})+"
        return f"({body})?" if self.optional else body


def read(page: str) -> tuple[Node, list[tuple[str, int]]]:
    """The page's runs as they stand, and its blocks of kept text with their rank (2 in an article, 1 in main, else 0).

    Where a main element has more text outside its articles than in them, they
    are parts of its text and rank with it.
    """
    root = Node("")
    walker, nodes = _Walker(), [root]
    blocks: list[tuple[str, int]] = []
    held: list[str] = []
    both: list[int] = []  # blocks in an article that is in a main element
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        text = " ".join(html_lib.unescape("".join(held)).split())
        if text:
            rank = 2 if walker.names["article"] else 1 if walker.names["main"] else 0
            if rank == 2 and walker.names["main"]:
                both.append(len(blocks))
            nodes[-1].parts.append(Node(TEXT, text, len(text), min(linked, len(text)), block=len(blocks)))
            blocks.append((text, rank))
        held.clear()
        linked = 0

    for kind, value, attrs in tokens(page):
        if kind == "text":
            if walker.keeps():
                held.append(value)
                linked += len(value.strip()) if in_link else 0
            continue
        if value == "a":
            in_link = kind == "open"
        if kind == "open" and value == "br":
            held.append(" ")
            continue
        if value in _BLOCK:
            flush()
        if kind == "close":
            walker.close(value)
            del nodes[min(len(walker.stack), DEPTH) + 1 :]
        else:
            element = walker.open(value, attrs)
            del nodes[min(len(walker.stack) - (element is not None), DEPTH) + 1 :]
            if element is not None and len(nodes) <= DEPTH:
                node = Node(element.sign + "!" * element.out)
                nodes[-1].parts.append(node)
                nodes.append(node)
    flush()
    if both and sum(len(t) for t, r in blocks if r == 1) > sum(len(t) for t, r in blocks if r == 2):
        for i in both:
            blocks[i] = blocks[i][0], 1
        blocks = [(t, 0 if r == 2 else r) for t, r in blocks]
    return root, blocks


def _members(node: Node) -> list[Node]:
    return node.parts if node.sign == GROUP else [node]


def _grouped(parts: list[Node], add: bool) -> list[Node]:
    """One run for each sign: from the first to the last of a sign that comes back, runs are one repeated group."""
    reach = list(range(len(parts)))
    first: dict[str, int] = {}
    for i, p in enumerate(parts):
        for m in _members(p):
            reach[first.setdefault(m.sign, i)] = i
    out, i = [], 0
    while i < len(parts):
        end = j = i
        while j <= end:
            end = max(end, reach[j])
            j += 1
        out.append(parts[i] if end == i else _group(parts[i : end + 1], add))
        i = end + 1
    return out


def _group(parts: list[Node], add: bool) -> Node:
    members: dict[str, Node] = {}
    for p in parts:
        for m in _members(p):
            members[m.sign] = align(members[m.sign], m, add) if m.sign in members else m
    for m in members.values():
        m.repeated = True
    if len(members) == 1:
        return next(iter(members.values()))
    for m in members.values():
        m.optional = True
    return Node(GROUP, repeated=True, parts=list(members.values()))


def folded(node: Node) -> Node:
    """A page's runs as the least wrapper of that page."""
    node.parts = _grouped([folded(p) if p.parts else p for p in node.parts], False)
    return node


def align(a: Node, b: Node, add: bool = True) -> Node:
    """The least wrapper of two of the same sign; `add` if they are of different pages."""
    out = Node(a.sign, a.text if a.text == b.text else None, a.length + b.length, a.linked + b.linked, a.count + b.count if add else max(a.count, b.count), a.optional or b.optional, a.repeated or b.repeated)
    out.parts = _grouped(_interleaved(a.parts, b.parts, add), add)
    _merge_rare(out)
    return out


def _any_of(sign: str) -> str:
    """The sign of all runs of a tag."""
    return sign.split(".")[0].rstrip("!") + ".*" + "!" * sign.endswith("!")


def _merge_rare(node: Node) -> None:
    """With over `KINDS` kinds of parts, those that under a `KINDS`th of the pages have become one repeated kind for each tag.

    So classes that name a page keep no place of their own, and the wrapper does
    not grow with the pages.
    """
    kinds = [m for p in node.parts for m in _members(p)]
    if len(kinds) <= KINDS:
        return
    parts: list[Node | str] = []  # a merged kind by its sign, where its first member stood
    rare: dict[str, Node] = {}
    for p in node.parts:
        kept = []
        for m in _members(p):
            if m.sign == TEXT or (m.count * KINDS >= node.count and m.sign != _any_of(m.sign)):
                kept.append(m)
                continue
            m.sign = _any_of(m.sign)
            if m.sign not in rare:
                parts.append(m.sign)
            rare[m.sign] = align(rare[m.sign], m) if m.sign in rare else m
        if len(kept) == len(_members(p)):
            parts.append(p)
        elif kept:
            parts.append(Node(GROUP, optional=p.optional, repeated=True, parts=kept) if len(kept) > 1 else kept[0])
    for m in rare.values():
        m.optional = m.repeated = True
    node.parts = [rare[p] if isinstance(p, str) else p for p in parts]


def _alike(x: Node, y: Node) -> bool:
    if x.sign == y.sign:
        return True
    if GROUP not in (x.sign, y.sign):
        return False
    return not {m.sign for m in _members(x)}.isdisjoint(m.sign for m in _members(y))


def _interleaved(x: list[Node], y: list[Node], add: bool) -> list[Node]:
    """Both sequences in one, with as many runs aligned as their order allows; the others are optional."""
    if not x or not y:
        for p in x or y:
            p.optional = True
        return x or y
    if len(x) * len(y) > PAIRS:
        return [_group([*x, *y], add)]
    if [p.sign for p in x] == [p.sign for p in y] and all(p.sign != GROUP for p in x):
        return [align(p, q, add) for p, q in zip(x, y, strict=True)]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _alike(x[i], y[j]) else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out: list[Node] = []
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and _alike(x[i], y[j]):
            plain = x[i].sign == y[j].sign != GROUP
            out.append(align(x[i], y[j], add) if plain else _group([x[i], y[j]], add))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            x[i].optional = True
            out.append(x[i])
            i += 1
        else:
            y[j].optional = True
            out.append(y[j])
            j += 1
    return out


def infer(pages: list[str]) -> Node | None:
    """One wrapper of all pages; None without pages."""
    out = None
    for page in pages:
        tree = folded(read(page)[0])
        out = tree if out is None else align(out, tree)
    return out


def _packed(n: Node) -> list:
    """A wrapper as lists, long fixed texts by their start and hash."""
    text = n.text if n.text is None or len(n.text) <= 60 else n.text[:20] + hashlib.md5(n.text.encode("utf-8", "surrogatepass")).hexdigest()
    return [n.sign, text, n.length, n.linked, n.count, n.optional, n.repeated, [_packed(p) for p in n.parts]]


def _unpacked(x: list) -> Node:
    return Node(*x[:7], [_unpacked(p) for p in x[7]])


# --- extraction


def _texts(node: Node) -> Iterator[Node]:
    if node.sign == TEXT:
        yield node
    for p in node.parts:
        yield from _texts(p)


class Wrapper:
    """A host's wrapper, ready to be matched."""

    def __init__(self, root: Node):
        self.root = root
        slots = sum(t.length for t in _texts(root) if t.text is None)
        self.tells = root.count >= MIN_PAGES and 2 * slots >= sum(t.length for t in _texts(root))

    def match(self, page: Node) -> dict[int, tuple[Node, str, bool, bool]]:
        """For each block of the page's runs: the wrapper's text, the sign of its element, whether it is in a repeated group, and whether that is the article's own."""
        out: dict[int, tuple[Node, str, bool, bool]] = {}
        todo = [(self.root, page, False, False)]
        while todo:
            node, run, repeated, own = todo.pop()
            known = {m.sign: m for p in node.parts for m in _members(p)}
            own = own or not _OWN_LINKS.isdisjoint(run.sign.split("."))
            for p in run.parts:
                m = known.get(p.sign) or known.get(_any_of(p.sign))
                if m is not None and p.sign == TEXT:
                    out[p.block] = m, run.sign, repeated or m.repeated, own
                elif m is not None:
                    todo.append((m, p, repeated or m.repeated, own))
        return out


def _goes(rank: int, text: Node, sign: str, repeated: bool, tells: bool, own: bool) -> bool:
    """Does the wrapper say that a block is not the page's text? Never of what stands in its article or main element."""
    if rank or own:
        return False
    if repeated:
        return text.linked >= LINKED * text.length
    return text.text is not None and tells and text.count >= MIN_PAGES and sign.split(".")[0] not in _HEADINGS


def extract(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The page's main text: blocks joined by a newline, white space in a block as one space.

    Blocks in article elements are taken; if there are none, those in main
    elements, then all that are left. Of these, those go that the wrapper tells
    to be no text of the page, unless nothing else is left.
    """
    root, blocks = read(page or "")
    most = max((r for _, r in blocks), default=0)
    found = wrapper.match(root) if wrapper else {}
    rest = [t for i, (t, r) in enumerate(blocks) if r == most and not (i in found and _goes(r, *found[i][:3], wrapper.tells, found[i][3]))]
    return "\n".join(rest or [t for t, r in blocks if r == most])


def host_of(url: F.Column) -> F.Column:
    """The part between `://` and the next `/`, `?` or `#`, lower-cased; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")))


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    importable(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))


def host_wrappers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, pattern): each host's wrapper, as JSON and as text.

    All pages are read. A task aligns its pages of a host and sends one wrapper
    for each, these are aligned in at most `PARTS` groups of a host, and those
    with each other, so a large host is no task's work alone. The host of no
    name has no wrapper.
    """
    rows = _rows(pages, id_col, url_col, html_col).where("html IS NOT NULL AND host <> ''").select("host", "html")

    def sent(held: dict[str, Node]) -> pa.RecordBatch:
        out = [json.dumps(_packed(tree)) for tree in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(out, pa.string())], names=["host", "tree"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Node] = {}
        seen: set[int] = set()  # copies that a task holds count once
        for batch in slices(batches):
            for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if (page := hash((host, text))) in seen:
                    continue
                seen.add(page)
                tree = folded(read(text)[0])
                held[host] = align(held[host], tree) if host in held else tree
            if len(held) > HELD:
                yield sent(held)
                held, seen = {}, set()
        yield sent(held)

    def joined(group: pd.DataFrame) -> tuple[str, Node]:
        trees = (_unpacked(json.loads(t)) for t in sorted(group["tree"]))
        return group["host"].iloc[0], reduce(align, trees)

    def some(group: pd.DataFrame) -> pd.DataFrame:
        host, tree = joined(group)
        return pd.DataFrame({"host": [host], "tree": [json.dumps(_packed(tree))]})

    def all_(group: pd.DataFrame) -> pd.DataFrame:
        host, tree = joined(group)
        return pd.DataFrame({"host": [host], "wrapper": [json.dumps(_packed(tree))], "pattern": [tree.pattern()]})

    trees = rows.mapInArrow(fold, "host string, tree string").withColumn("part", F.pmod(F.xxhash64("tree"), F.lit(PARTS)))
    parts = trees.groupBy("host", "part").applyInPandas(some, "host string, tree string")
    return parts.groupBy("host").applyInPandas(all_, "host string, wrapper string, pattern string")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row, from its whole html.

    Wrappers go to the tasks if they have at most `BROADCAST_BYTES`; else pages
    are joined to them, a host's pages dealt to `PARTS` keys. A null html is
    empty; a null or odd url falls to the host of no name, which has no wrapper;
    repeated rows give repeated results; an empty table gives an empty result.
    """
    wrappers = checkpointed(host_wrappers(pages, id_col, url_col, html_col).select("host", "wrapper"))
    rows = _rows(pages, id_col, url_col, html_col)
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    few = size <= BROADCAST_BYTES
    shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()} if few else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Wrapper | None] = {}
        for batch in slices(batches):
            texts = []
            for text, host, wrapper in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if host not in ready:
                    if len(ready) > HELD:
                        ready.clear()
                    wrapper = shared.value.get(host) if few else wrapper
                    ready[host] = Wrapper(_unpacked(json.loads(wrapper))) if wrapper else None
                texts.append(extract(text, ready[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if few:
        joined = rows.withColumn("wrapper", F.lit(None).cast("string"))
    else:
        dealt = wrappers.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        joined = rows.withColumn("part", F.pmod(F.xxhash64("html", "page_id"), F.lit(PARTS)).cast("int")).join(dealt, ["host", "part"], "left")
    return joined.select("page_id", "url", "host", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")
