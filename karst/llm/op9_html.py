"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks with their places in the DOM. Neighbouring blocks of one
parent, tag and leaning are one node. A linear classifier (WEIGHTS over features of the block and
of the elements around it) gives each node a cost for being content and one for being boilerplate:
these are the capacities to the two terminals. Nodes that follow each other, and nodes of one
parent, are joined by smoothness edges, stronger the nearer their common ancestor. The maximum
flow separates content from boilerplate; what the source side keeps is the article.

What the classifier sees: the block's length, tag and share of text in links, and of each element
around it the tag and its own class, id, role and hidden attributes (the first of a name counts;
other attributes never do). A name that often marks something else (WEAK_NAMES) weighs little, so
that prose, an article around it or its neighbours outweigh it. A name or tag that tells what isn't
the article (STRONG_NAMES, BAD_TAGS) also hides what is outside it from the block. Such a name counts
as the first part of a class or id (`sidebar-left`); after a part that only describes (`with-sidebar`,
`category-social`) or before one (`comments-open`) it counts as nothing; after another part
(`right-sidebar`), and on an article or main element, it counts unless the element holds most of the
page's prose, for then it speaks of the layout. Where the page has an article or main element with
prose, blocks outside it weigh less.

Null or empty html gives an empty text; a page without a content block too. Unclosed, crossed and
stray tags are tolerated. Rows are independent: repeated rows give repeated results, an empty
table none. Extra columns are ignored. Whole pages are read; nothing is cut. Scripts, styles,
form controls, graphics and embedded objects aren't text. A tag that isn't closed ends where the next
begins; reading takes time in proportion to the page, whatever its tags (an item looks for an open one
that it ends through SCOPE elements at most).
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(
    "script style noscript template textarea iframe svg title object select button option annotation annotation-xml".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong"
    " sub sup time tt u var wbr img br input ruby rt rp math semantics mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt"
    " mroot mover munder munderover mstyle".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# What names of elements, roles, classes and ids tell.
BAD_TAGS = frozenset("nav footer aside form menu dialog head fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
STRONG_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense aside breadcrumb breadcrumbs byline comment comments commentlist"
    " consent cookie cookies copyright disqus foot footer gdpr login masthead menu menus modal nav navbar navi navigation"
    " newsletter notice notices notification pagination paginator pager popup promo promoted promotion recommended related"
    " replies respond share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription toolbar"
    " topbar".split()
)
WEAK_NAMES = frozenset(
    "alert banner dialog disclaimer feedback form head header legal overlay privacy rail register reply search tags toc warning"
    " widget widgets".split()
)
# Parts before a name, or after it, that make it a description of the page.
BEFORE_NAMES = frozenset("with without has have no not is show shows hide hides category cat tag tags topic type format post taxonomy term supports".split())
AFTER_NAMES = frozenset("open opened closed enabled disabled active inactive on off visible hidden none".split())
GOOD_NAMES = frozenset("article articlebody body content entry main post story text".split())
RIGHTS = ("©", "(c) ", "copyright ", "all rights reserved")

#: The classifier: what each feature adds; content is above 0.
WEIGHTS = {
    "bias": 0.4,
    "bad": -5.0,  # a tag, role or strong name that isn't the article's, or a hidden element
    "header": -3.0,  # a header, but the article's own
    "own header": -1.0,
    "weak": -2.5,
    "article": 4.0,
    "good": 2.0,
    "outside": -2.5,
    "links": -2.0,  # most of the text is in links
    "prose": 1.2,  # ten words or more
    "doubling": 0.4,  # each time prose is twice as long, up to 320 words
    "paragraph": 0.7,
    "heading": 0.3,
    "title": 2.0,
    "scrap": -0.5,  # a few words, no end of a sentence, and no item of a list or table
    "rights": -3.0,
}
ADJACENT, SAME_PARENT = 0.8, 0.8
SCOPE = 512

# no part of a tag runs over the beginning of another, so each character is looked at a few times at most
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+(?:>|(?=<)|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']|"[^"<]*+"|'[^'<]*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+(?:<(?![a-zA-Z/!?])[^<>]*+)*+)(?:>|(?=<)|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Element:
    tag: str
    names: tuple[str, ...]
    kind: str  # "", or the weight that the element's own tag, role and names tell; "maybe" is bad unless most prose is inside
    depth: int
    parent: Element | None
    in_article: bool
    prose: int = 0
    score: float = 0.0
    good: float = 0.0

    def settle(self) -> None:
        """What the element and those around it tell of text in them."""
        around = self.parent
        self.score, self.good = (around.score, around.good) if around is not None else (0.0, 0.0)
        if self.kind == "bad":
            self.score, self.good = min(self.score, 0.0) + WEIGHTS["bad"], 0.0
        elif self.kind in ("article", "good"):
            self.score += max(0.0, WEIGHTS[self.kind] - self.good)
            self.good = max(self.good, WEIGHTS[self.kind])
        elif self.kind:
            self.score += WEIGHTS[self.kind]


@dataclass
class Block:
    where: Element
    links: int = 0  # characters in links
    parts: list[str] = field(default_factory=list)
    text: str = ""


def attributes(raw: str) -> dict[str, str]:
    """An element's attributes by name in lower case; of a name that repeats, the first."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def name_kind(value: str) -> str:
    """What one class or id tells: "bad", "maybe", "weak", "good" or nothing."""
    parts = [x.lower() for x in _NAME.findall(value)]
    if value.lower() in STRONG_NAMES:
        return "bad"
    strong = [i for i, x in enumerate(parts) if x in STRONG_NAMES and not (i + 1 < len(parts) and parts[i + 1] in AFTER_NAMES)]
    if strong and not (strong[0] and parts[0] in BEFORE_NAMES):
        return "maybe" if strong[0] else "bad"
    some = {*parts, value.lower()}
    if some & GOOD_NAMES:
        return "good"
    return "weak" if some & WEAK_NAMES and parts[0] not in BEFORE_NAMES else ""


def _element(tag: str, attrs: str, parent: Element | None) -> Element:
    own = attributes(attrs) if attrs and not attrs.isspace() else {}
    names = tuple(entities.unescape(f"{own.get('class', '')} {own.get('id', '')}").split()) if own else ()
    role = own.get("role", "").lower()
    is_article = tag in ("article", "main") or role in ("main", "article")
    inside = bool(parent and parent.in_article) or is_article
    kinds = {name_kind(x) for x in names} if names and tag not in ("html", "body") else set()
    hidden = "hidden" in own or own.get("aria-hidden", "").lower() == "true"
    if tag in BAD_TAGS or role in BAD_ROLES or hidden:
        kind = "bad"
    elif "bad" in kinds or "maybe" in kinds:
        kind = "maybe" if is_article or "bad" not in kinds else "bad"
    elif tag == "header":
        kind = "own header" if parent and parent.in_article else "header"
    elif is_article:
        kind = "article"
    else:
        kind = "good" if "good" in kinds else "weak" if "weak" in kinds else ""
    return Element(tag, names, kind, parent.depth + 1 if parent else 0, parent, inside)


def _settle(elements: list[Element], blocks: list[Block]) -> None:
    """Decide the names that depend on the page's prose, and score all elements, which stand in page order."""
    total = 0
    for b in blocks:
        words = b.text.count(" ") + 1
        if words >= 10 and b.links <= 0.5 * len(b.text):
            b.where.prose += words
            total += words
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.prose += e.prose
    for e in elements:
        if e.kind == "maybe":
            most = 2 * e.prose > total
            e.kind = ("article" if e.tag in ("article", "main") else "") if most else "bad"
        e.settle()


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, decoded, with white space folded; none is empty."""
    root = _element("html", "", None)
    stack, found, elements = [root], [], [root]
    # places in the stack of elements that aren't inline, and of those that text may belong to
    solid, holders = [0], [0]
    # open elements by tag, and open inline elements by tag since each solid one
    is_open, runs = Counter(["html"]), [Counter()]
    endless: set[str] = set()
    block: Block | None = None
    in_link = at = 0

    def end_block() -> None:
        nonlocal block
        if block is not None:
            block.text = " ".join(entities.unescape("".join(block.parts)).split())
            if block.text:
                found.append(block)
            block = None

    def close(k: int) -> None:
        nonlocal in_link
        while len(stack) > k:
            e = stack.pop()
            in_link -= e.tag == "a"
            is_open[e.tag] -= 1
            if solid[-1] == len(stack):
                solid.pop()
                runs.pop()
            else:
                runs[-1][e.tag] -= 1
            if holders[-1] == len(stack):
                holders.pop()

    def say(text: str) -> None:
        nonlocal block
        if not text:
            return
        if block is None:
            if text.isspace():
                return
            block = Block(stack[holders[-1]])
        block.parts.append(text)
        if in_link:
            block.links += len(text.strip())

    while (m := _TOKEN.search(page, at)) is not None:
        say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if page.startswith("<![CDATA[", m.start()):
                say(entities.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag, ending, attrs = name.lower(), m[1] or m[4], (m[3] or m[6] or "")
        if ending:
            if tag not in INLINE:
                end_block()
            # an inline end tag doesn't close blocks around it
            if runs[-1][tag] if tag in INLINE else is_open[tag] > (tag == "html"):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in RAW:
            # their text is no part of the page; one that isn't closed hides the rest only if browsers hide it too
            end = None
            if not attrs.rstrip().endswith("/") and tag not in endless:
                end = re.compile(rf"</{re.escape(tag)}\b[^<>]*+>", re.I).search(page, at)
                if not end:
                    endless.add(tag)
            if end:
                at = end.end()
            elif tag in ("script", "style", "title", "textarea"):
                at = len(page)
            continue
        if tag == "br":
            say("\n") if block is not None else None
            continue
        if tag in VOID:
            if tag not in INLINE:
                end_block()
            continue
        if tag not in INLINE:
            end_block()
            if tag in ENDS_P:
                if stack[solid[-1]].tag == "p":
                    close(solid[-1])
            if tag in ("li", "dt", "dd", "tr", "td", "th"):
                stops = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",)}.get(tag, ("tr", "table"))
                twins = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                for i in reversed(solid[-SCOPE:]) if any(is_open[x] for x in twins) else ():
                    if stack[i].tag in twins:
                        close(i)
                        break
                    if stack[i].tag in stops or stack[i].tag in ("div", "article", "section"):
                        break
        element = _element(tag, attrs, stack[-1])
        if tag in INLINE and element.kind == "bad":
            end_block()
        if attrs.rstrip().endswith("/") and tag in INLINE:
            continue
        if tag not in INLINE:
            solid.append(len(stack))
            runs.append(Counter())
        else:
            runs[-1][tag] += 1
        if tag not in INLINE or element.kind:
            holders.append(len(stack))
        is_open[tag] += 1
        stack.append(element)
        elements.append(element)
        in_link += tag == "a"
    say(page[at:])
    end_block()
    _settle(elements, found)
    return found


ITEMS = frozenset("li td th dt dd figcaption caption summary pre h1 h2 h3 h4 h5 h6".split())


def leaning(block: Block, has_article: bool = False) -> float:
    """The classifier: above 0 for content."""
    tag, words = block.where.tag, block.text.count(" ") + 1
    score = WEIGHTS["bias"] + block.where.score
    if has_article and not block.where.in_article:
        score += WEIGHTS["outside"]
    if block.links > 0.5 * len(block.text):
        score += WEIGHTS["links"]
    elif words >= 10:
        score += WEIGHTS["prose"] + WEIGHTS["doubling"] * min(5.0, math.log2(words / 10))
    if tag in ("p", "blockquote", "pre"):
        score += WEIGHTS["paragraph"]
    elif tag == "h1":
        score += WEIGHTS["title"]
    elif tag in ("h2", "h3", "h4", "h5", "h6"):
        score += WEIGHTS["heading"]
    elif tag not in ITEMS and words < 5 and block.text[-1] not in ".!?:;\"'»”":
        score += WEIGHTS["scrap"]
    if words < 30 and block.text.lower().startswith(RIGHTS):
        score += WEIGHTS["rights"]
    return score


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source after a maximum flow (Dinic's blocking flows)."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(there)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        if source[i] > 0:
            arc(s, i, source[i], 0.0)
        if sink[i] > 0:
            arc(i, t, sink[i], 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for k in out[a]:
                if cap[k] > tiny and level[to[k]] < 0:
                    level[to[k]] = level[a] + 1
                    queue.append(to[k])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[k] for k in path)
                for k in path:
                    cap[k] -= flow
                    cap[k ^ 1] += flow
                cut = next(i for i, k in enumerate(path) if cap[k] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nxt[a] < len(out[a]):
                k = out[a][nxt[a]]
                if cap[k] > tiny and level[to[k]] == level[a] + 1:
                    break
                nxt[a] += 1
            else:
                if a == s:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                continue
            path.append(k)
            a = to[k]


def _nearness(a: Element, b: Element) -> int:
    """Steps from the lower of two elements up to their common ancestor, 1 at least."""
    up = [0, 0]
    while a is not b:
        if a.depth >= b.depth:
            a, up[0] = a.parent, up[0] + 1  # type: ignore[assignment]
        else:
            b, up[1] = b.parent, up[1] + 1  # type: ignore[assignment]
        if a is None or b is None:
            break
    return max(1, *up)


def main_blocks(blocks: list[Block]) -> list[bool]:
    """Which blocks the cut keeps."""
    if not blocks:
        return []
    has_article = any(b.where.in_article and b.text.count(" ") >= 9 for b in blocks)
    lean = [leaning(b, has_article) for b in blocks]
    node: list[int] = []
    places: list[Element] = []
    sums: list[float] = []
    sizes: list[int] = []
    last_key = None
    for b, x in zip(blocks, lean):
        e = b.where
        key = (id(e.parent), e.tag, e.names, x > 0)
        if key != last_key:
            places.append(e)
            sums.append(0.0)
            sizes.append(0)
            last_key = key
        node.append(len(places) - 1)
        sums[-1] += x
        sizes[-1] += 1
    # a long run tells more than a block, but not as much as all its blocks: edges must be able to turn it
    total = [x / n * (1 + math.log2(n)) for x, n in zip(sums, sizes)]
    edges: list[tuple[int, int, float]] = []
    last_of: dict[int, int] = {}
    for i, e in enumerate(places):
        if i:
            edges.append((i - 1, i, ADJACENT / _nearness(places[i - 1], e)))
        p = id(e.parent)
        if p in last_of and last_of[p] != i - 1:
            edges.append((last_of[p], i, SAME_PARENT))
        last_of[p] = i
    kept = min_cut([max(0.0, x) for x in total], [max(0.0, -x) for x in total], edges)
    return [kept[i] for i in node]


def extract(page: str | None) -> str:
    """The article's blocks in page order, with an empty line between."""
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, keep in zip(blocks, main_blocks(blocks)) if keep)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def run(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, in one pass without a shuffle."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html"))
    return rows.mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark.read.parquet(f"{sf_dir}/pages.parquet"))
