"""Main text of web pages by tag-path ratios.

A page is a sequence of text nodes, each below a root-to-leaf path of tags. Text length and punctuation are aggregated per
path and divided by the path's nodes; the ratios are smoothed over neighbouring paths in page order, fused into one value
per path and compared with a threshold of the page. Paths that pass give content nodes, and these are joined into blocks.
Inline tags belong to the path around them, the text of links weighs little, and headings go with what they introduce.
Tags and class names that announce boilerplate (menus, footers, adverts, forms, scripts, comments) weigh nothing. Names that
an article's own parts may bear as well, and ids there, only count if the element holds neither a sentence nor a title.
Where a page has ``article`` or ``main`` elements, those that hold most of the content by these ratios bound the result.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, texts_of

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg")
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot"}
SAME_LEVEL = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
              "option": ("select",)}

# Names that announce something else than the article.
SIDE_TAGS = frozenset("nav footer aside form button select option label dialog menu script style noscript template iframe svg head title".split())
ADDED = (  # by others than the article's author: these count inside an article too
    r"ads?|advert\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|comments?|commentlist|replies|reply|respond|disqus|cookies?|"
    r"consent|popup|modal|newsletter|subscribe|signup|login|pagination|pager"
)
OTHER = (
    r"banner|promo\w*|side|widgets?|footer|foot|header|masthead|notices?|alert|share\w*|social|related|recommend\w*|copyright|legal|"
    r"disclaimer|toolbar|search"
)
LAYOUT = r"wrapper|wrap|container|inner|outer|area|box|bar|block|links|panel|top|bottom|left|right|\d+"


def _names(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[-_\s])(?:{words})(?:$|[-_\s\d])", re.IGNORECASE)


SIDE_NAMES, ADDED_NAMES, HEADER_NAMES = _names(f"{ADDED}|{OTHER}"), _names(ADDED), _names("header|head")
OWN_HEADER = re.compile(r"(?:^|\s)(?:article|post|entry|story)[-_]+header(?=$|[-_\s])", re.IGNORECASE)
# An id that says more (related-work, share-prices) is a slug of the text below it.
SIDE_ID = re.compile(rf"(?:(?:site|page|main|global|{LAYOUT})[-_]?)*(?:{ADDED}|{OTHER})(?:[-_]?(?:{LAYOUT}))*", re.IGNORECASE)
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th caption blockquote pre figcaption".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_CDATA = r"<!\[CDATA\[(?P<cdata>.*?)\]\]>|"
_MARKUP = (
    r"<!--.*?(?:-->|\Z)|{cdata}<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*+\"[^\"]*\"|=\s*+'[^']*'|[^>])*+)>|<(?P<cut>[/a-zA-Z][^>]*\Z)"
)
TAG = re.compile(_MARKUP.replace("{cdata}", _CDATA), re.DOTALL)
TAG_AFTER_CDATA = re.compile(_MARKUP.replace("{cdata}", "(?P<cdata>(?!))|"), re.DOTALL)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؟।]")
SPACE = re.compile(r"\s+")
SENTENCE = 20
LINK_WEIGHT = 0.1
SHARE_OF_MEAN = 0.1
KERNEL = (0.05, 0.1, 0.7, 0.1, 0.05)
# A container is entered if it holds this share of the content around it; several of like size together need more.
ALONE, TOGETHER, LIKE = 1 / 3, 2 / 3, 0.5


class Open:
    """An open element: what holds for the text below it. ``path`` numbers the tags from the root, without inline tags;
    ``doubt`` and ``container`` number the innermost doubtful element and the innermost ``article`` or ``main``."""

    __slots__ = ("tag", "path", "side", "doubt", "container", "heading", "linked")

    def __init__(self, tag: str, path: int, side: bool, doubt: int, container: int, heading: str, linked: bool):
        self.tag, self.path, self.side, self.doubt = tag, path, side, doubt
        self.container, self.heading, self.linked = container, heading, linked


class Node:
    """A run of text in a block, and what holds for it; ``link`` if it is a link's and no heading's."""

    __slots__ = ("path", "block", "side", "doubt", "container", "heading", "link", "text")

    def __init__(self, around: Open, block: int, text: str):
        self.path, self.block, self.side, self.doubt = around.path, block, around.side, around.doubt
        self.container, self.heading, self.text = around.container, around.heading, text
        self.link = around.linked and not around.heading


class Page:
    """Text nodes of a page in order, and the parents of its doubtful elements and of its containers (0: none)."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.doubts: list[int] = [0]
        self.containers: list[int] = [0]


def _is_side(name: str, attrs: str, own: bool) -> bool | None:
    """Whether an element holds something else than the article; ``own``: inside an ``article`` or ``main``. None: in doubt,
    its text decides."""
    if name in SIDE_TAGS or name == "header" and not own:
        return True
    doubt = False
    for key, value in ATTRIBUTE.findall(attrs) if attrs else ():
        value = value.strip("\"'")
        key = key.lower()
        if key == "hidden" or key == "role" and value.lower() in SIDE_ROLES:
            return True
        if name in ("html", "body", "article", "main"):
            continue
        if key == "class":
            value = HEADER_NAMES.sub(" ", value) if own else OWN_HEADER.sub(" ", value)
            if (ADDED_NAMES if own else SIDE_NAMES).search(value):
                return True
            doubt = doubt or bool(SIDE_NAMES.search(value))
        if key == "id" and name not in TEXT_TAGS and SIDE_ID.fullmatch(value):
            if not own and name != "section":
                return True
            doubt = doubt or not (own and HEADER_NAMES.search(value))
    return None if doubt else False


def _settled(page: Page) -> list[Node]:
    """Nodes outside side elements, and outside the doubtful ones without a sentence or a title.

    A sentence is a block with enough text and punctuation. What a doubtful element shows speaks for all that it is in, so
    elements are judged from the inside; a block that goes on outside an inline one is judged there with all its text.
    """
    kept = [n for n in page.nodes if not n.side]
    good = [False] * len(page.doubts)
    shown: list[dict[int, list]] = [{} for _ in page.doubts]
    for node in kept:
        if node.doubt and node.heading == "h1" and node.text.strip():
            good[node.doubt] = True
        elif node.doubt and not node.link and not node.heading:
            size, marks = shown[node.doubt].get(node.block, (0, False))
            text = SPACE.sub(" ", node.text)
            shown[node.doubt][node.block] = (size + len(text if size else text.lstrip()), marks or bool(PUNCTUATION.search(text)))
    for d in range(len(page.doubts) - 1, 0, -1):
        parent, blocks = page.doubts[d], shown[d]
        good[d] = good[d] or any(size >= SENTENCE and marks for size, marks in blocks.values())
        good[parent] = good[parent] or good[d]
        for block in {min(blocks), max(blocks)} if blocks and parent and not good[d] else ():
            size, marks = shown[parent].get(block, (0, False))
            shown[parent][block] = (size + blocks[block][0], marks or blocks[block][1])
    passed = [True] * len(good)
    for d in range(1, len(good)):
        passed[d] = good[d] and passed[page.doubts[d]]
    return [n for n in kept if passed[n.doubt]]


def nodes(text: str) -> Page:
    """Text nodes of a page in order. Unclosed paragraphs and list items end where the next one starts; what a page cut
    short leaves of a tag is dropped, and so is a tag with a quote that never ends, up to its first ``>``."""
    page = Page()
    stack = [Open("", 0, False, 0, 0, "", False)]
    places: dict[str, list[int]] = {}  # of the open elements, by tag
    paths: dict[tuple[int, str], int] = {}
    block = at = 0
    last_cdata = text.rfind("]]>")

    def add(run: str) -> None:
        if run:
            page.nodes.append(Node(stack[-1], block, run))

    def leave(index: int) -> None:
        nonlocal block
        gone = [element.tag for element in stack[index:]]
        del stack[index:]
        for tag in gone:
            places[tag].pop()
        block += not BLOCK.isdisjoint(gone)

    def last(names: tuple[str, ...], until: tuple[str, ...] = ()) -> int | None:
        """Place of the innermost open element of these names, unless one of ``until`` is further in."""
        found = max((places[n][-1] for n in names if places.get(n)), default=-1)
        barrier = max((places[n][-1] for n in until if places.get(n)), default=-1)
        return found if found >= 0 and found >= barrier else None

    while at < len(text):
        m = (TAG if at <= last_cdata else TAG_AFTER_CDATA).search(text, at)
        if m is None:
            add(html.unescape(text[at:]))
            break
        add(html.unescape(text[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
        if m["name"] is None:
            continue
        name, closing, attrs = m["name"].lower(), bool(m["close"]), m["attrs"]
        if closing:
            i = last((name,), ("article", "body") if name not in ("article", "body", "html") else ())
            if i is not None:
                leave(i)
            elif name == "p":
                block += 1
            continue
        if name in ("br", "wbr"):
            if name == "br":
                add("\n")
            continue
        if name in BLOCK:
            i = last(("p",), ("article", "body", "div", "section", "td", "li", "blockquote")) if name in CLOSES_P else None
            if i is not None:
                leave(i)
            block += 1
        if name in SAME_LEVEL:
            i = last((name,) if name not in ("dt", "dd") else ("dt", "dd"), SAME_LEVEL[name])
            if i is not None:
                leave(i)
                block += 1
        if name in VOID or attrs.rstrip().endswith("/"):
            continue
        around = stack[-1]
        side = around.side or _is_side(name, attrs, bool(around.container))
        if name in RAW:
            end = RAW_END[name].search(text, at)
            at = end.end() if end else len(text)
            continue
        doubt, container = around.doubt, around.container
        if side is None:
            page.doubts.append(doubt)
            doubt = len(page.doubts) - 1
        if name in ("article", "main"):
            page.containers.append(container)
            container = len(page.containers) - 1
        path = around.path if name in INLINE else paths.setdefault((around.path, name), len(paths) + 1)
        heading = around.heading or (name if name in HEADINGS else "")
        places.setdefault(name, []).append(len(stack))
        stack.append(Open(name, path, bool(side), doubt, container, heading, around.linked or name == "a"))
    return page


def content_paths(found: list[Node], contained: bool = False) -> set[int]:
    """Paths whose fused ratio passes the page's threshold. Inside a container, only paths that are mostly links can fail."""
    total: dict[int, list[float]] = {}
    blocks = set()
    for node in found:
        text = node.text.strip()
        if text and not node.side and not node.heading:
            entry = total.setdefault(node.path, [0.0, 0.0, 0.0, 0.0])
            share = LINK_WEIGHT if node.link else 1.0
            entry[0] += share * len(text)
            entry[1] += share * len(PUNCTUATION.findall(text))
            entry[2] += (node.path, node.block) not in blocks
            entry[3] += len(text) * (1 if node.link else -1)
            blocks.add((node.path, node.block))
    if not total:
        return set()
    order = list(total)
    length = [total[p][0] / total[p][2] for p in order]
    points = [(total[p][1] + 1) / total[p][2] for p in order]

    def smooth(values: list[float]) -> list[float]:
        """In logarithms: a long text must not lift the menu beside it."""
        logs = [math.log(v) for v in values]
        padded = [logs[0], logs[0], *logs, logs[-1], logs[-1]]
        return [math.exp(sum(k * v for k, v in zip(KERNEL, padded[i:]))) for i in range(len(values))]

    fused = [math.sqrt(a * b) for a, b in zip(smooth(length), smooth(points))]
    weight = sum(total[p][0] for p in order)
    mean = sum(f * total[p][0] for f, p in zip(fused, order)) / weight  # of a character, not of a path
    return {p for p, f in zip(order, fused) if f >= SHARE_OF_MEAN * mean or contained and total[p][3] <= 0}


def content_containers(found: list[Node], parents: list[int]) -> set[int]:
    """The ``article`` and ``main`` elements that bound the content, with all inside them; 0 is the page itself.

    From the page inwards: the containers directly inside that have the most text on content paths, or several of like size,
    are entered if they hold most of what there is.
    """
    chosen = content_paths(found)
    mass = [0.0] * len(parents)
    for node in found:
        if not node.heading and (node.path in chosen or not chosen):
            mass[node.container] += len(node.text.strip()) * (LINK_WEIGHT if node.link else 1.0)
    for c in range(len(parents) - 1, 0, -1):
        mass[parents[c]] += mass[c]
    inside: dict[int, list[int]] = {}
    for c in range(1, len(parents)):
        inside.setdefault(parents[c], []).append(c)
    now = [0]
    while len(now) == 1 and inside.get(now[0]):
        most = max(mass[c] for c in inside[now[0]])
        like = [c for c in inside[now[0]] if mass[c] >= LIKE * most]
        if most == 0 or sum(mass[c] for c in like) < (ALONE if len(like) == 1 else TOGETHER) * mass[now[0]]:
            break
        now = like
    kept = set(now)
    for c in range(1, len(parents)):
        if parents[c] in kept:
            kept.add(c)
    return kept


def main_text(page: str | None) -> str:
    """The content blocks of a page in order, white space inside a block as one space, blocks joined by a line feed.

    Null, empty and text-free pages give the empty text. Ratios are those of all nodes; where ``article`` or ``main`` elements
    hold most of the content, only nodes below them are returned. A first-level heading stays, any other if the text after
    it does.
    """
    read = nodes(page or "")
    found = _settled(read)
    containers = content_containers(found, read.containers)
    inner = [] if 0 in containers else [n for n in found if n.container in containers]
    chosen = content_paths(found, bool(inner))
    blocks: dict[int, list[str]] = {}
    keep = follows = not chosen or bool(inner)
    kept = []
    for node in reversed(inner or found):
        if node.text.strip():
            if not node.heading:
                follows = node.path in chosen
            keep = follows or node.heading == "h1"
        if keep or not node.text.strip():
            kept.append(node)
    for node in reversed(kept):
        blocks.setdefault(node.block, []).append(node.text)
    texts = (SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(t for t in texts if t)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for every row. Null and empty pages have an empty text; rows may repeat, ids and urls may be
    null; other columns are not read."""
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 256):
            found = pa.array([main_text(p) for p in texts_of(batch, "html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["page_id", "url", "text"])

    kind = source.schema["page_id"].dataType.simpleString()
    return source.mapInArrow(run, f"page_id {kind}, url string, text string")
