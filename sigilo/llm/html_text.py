"""Main text of web pages by composite text density over the DOM."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

# Element names of the HTML standard, and words that name boilerplate in class and id attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements that show no text of the page, and the controls of forms: they go with all they hold, wherever they are.
UNSEEN = frozenset("script style noscript template iframe object embed audio video head title button select option input textarea label legend map noembed noframes xmp datalist".split())
#: Elements whose density is discounted for what their names mean, like that of boxes with such a class or id, unless they hold the bulk of the text.
NAMED = frozenset("nav footer header aside form fieldset dialog menu search".split())
BLOCKS = frozenset(
    "address article aside blockquote body br canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot "
    "th thead title tr ul".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre search section summary table ul".split()
)
#: Elements that an opening tag closes, and those that hide what is open around them from it.
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"),
}
SCOPES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "optgroup": ("select",)} | {k: ("table",) for k in ("tr", "td", "th", "thead", "tbody", "tfoot")}
SCOPES["p"] = tuple("button table td th article section div main li".split())
BIT = {tag: 1 << k for k, tag in enumerate(SCOPES)}
#: For each opening tag the bits of the elements that it closes; for each element the bits that it hides.
CLOSES = {tag: sum(BIT[x] for x in names) for tag, names in SIBLINGS.items()} | {tag: BIT["p"] for tag in CLOSES_P - SIBLINGS.keys()}
HIDES = {scope: sum(BIT[k] for k, v in SCOPES.items() if scope in v) for v in SCOPES.values() for scope in v}
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|adslot|adbox|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|"
    r"alert|popup|modal|overlay|nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|sidebar|side|aside|widget|footer|foot|header|masthead|topbar|comment|comments|commentlist|"
    r"reply|replies|disqus|respond|discussion|share|sharing|social|related|recommended|recommendations|newsletter|subscribe|subscription|signup|login|search|pagination|pager|"
    r"copyright|legal|disclaimer|toolbar|skip|hidden|tags)(?=$|[\s_-]|\d)",
    re.I,
)
#: Names of the parts of an article, which are no boilerplate though a word in them may be.
PARTS = re.compile(r"(?<![a-z])(?:post|article|entry|story|content|main|page-title|chapter|section)[-_]?(?:header|head|footer|menu-?item|title|notice|legal)(?![a-z])", re.I)
HEADING = re.compile("h[1-6]")
#: What is left of the density of a box that boilerplate is likely in.
PRIOR = 1 / 64
#: Elements that hold blocks. A name tells something about boxes only, not about a paragraph or a phrase.
BOXES = frozenset("address aside blockquote center details dialog dir div dl fieldset figure footer form header hgroup main menu nav ol search section table tbody td tr ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    """An element: its children and texts in order, and the sums over its subtree that densities need.

    open: the bits of the elements around it, itself included, that a tag inside could close.
    """

    __slots__ = ("tag", "named", "prior", "dropped", "items", "parent", "open", "chars", "tags", "link_chars", "link_tags", "density", "total", "best")

    def __init__(self, tag: str, parent: Node | None, named: str):
        self.tag, self.parent, self.named, self.items = tag, parent, named, []
        self.dropped, self.prior = False, 1.0
        self.open = ((parent.open if parent else 0) & ~HIDES.get(tag, 0)) | BIT.get(tag, 0)
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.best: Node = self


def boilerplate(tag: str, attributes: str, inside_main: bool) -> str:
    """"always" for what the page doesn't show; "unless bulk" for what its name, role, class or id calls boilerplate, which
    may yet wrap the page's text. A header inside an article holds its heading and stays."""
    if tag in UNSEEN:
        return "always"
    found = "unless bulk" if tag in NAMED and not (tag == "header" and inside_main) else ""
    if not attributes or tag in ("html", "body"):
        return found
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "always"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "always"
        if name == "role" and value.lower() in ROLES:
            found = "unless bulk"
        if name in ("class", "id") and tag in BOXES and BOILERPLATE.search(PARTS.sub(" ", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value))):
            found = "unless bulk"
    return found


def parse(page: str) -> Node:
    """A tree of the page, forgiving as browsers are: open paragraphs, items and cells are closed by what follows them.

    Every element is closed once, and a tag looks up the tree only for what is open there, so the time is linear in the page.
    """
    root = Node("html", None, "")
    at, here, main, opened = 0, root, 0, Counter()

    def close(top: Node) -> None:
        """Close all elements from the innermost one to the given one."""
        nonlocal here, main
        while here is not top.parent:
            main -= here.tag in ("article", "main")
            opened[here.tag] -= 1
            here = here.parent

    for m in iter(lambda: TOKEN.search(page, at), None):
        if m.start() > at:
            here.items.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                node = here
                while node.tag != tag:
                    node = node.parent
                close(node)
            elif tag == "br":
                here.items.append(Node("br", here, ""))
            continue
        if tag == "html":
            continue
        bits = CLOSES.get(tag, 0)
        while here.open & bits:
            node = here
            while not BIT.get(node.tag, 0) & bits:
                node = node.parent
            close(node)
        node = Node(tag, here, boilerplate(tag, m[3], main > 0))
        here.items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            node.items.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID:
            here = node
            opened[tag] += 1
            main += tag in ("article", "main")
    if at < len(page):
        here.items.append(page[at:])
    drop(root)
    return root


def drop(root: Node) -> None:
    """Marks what the page doesn't show, which is left out before densities are taken, and sets the priors of named boxes. A box has none
    if it holds more than half of the page's text outside of links and, on a page with a marked article or main part, holds one or lies in one."""
    order, stack, said, marked = [], [root], {}, set()
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in node.items if isinstance(x, Node) and x.named != "always")
    for node in reversed(order):
        own = sum(len("".join(x.split())) if isinstance(x, str) else said.get(x, 0) for x in node.items)
        said[node] = 0 if node.tag == "a" else own
        if own and node.tag in ("article", "main") or any(x in marked for x in node.items if isinstance(x, Node)):
            marked.add(node)
    stack = [(root, root not in marked)]
    while stack:
        node, free = stack.pop()
        free = free or node.tag in ("article", "main")
        for x in node.items:
            if isinstance(x, Node):
                bulk = 2 * said.get(x, 0) > said[root] and (free or x in marked)
                x.dropped = node.dropped or x.named == "always"
                x.prior = PRIOR if x.named == "unless bulk" and not bulk else 1.0
                stack.append((x, free))


def measure(root: Node) -> None:
    """Sums, densities (with the priors of named boxes) and the best subtree of each node, from the leaves up; without recursion, for deep pages."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in node.items if isinstance(x, Node) and not x.dropped)
    for node in reversed(order):
        for x in node.items:
            if isinstance(x, str):
                n = len("".join(x.split()))
                node.chars += n
                node.link_chars += n if node.tag == "a" else 0
            elif not x.dropped:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.chars if node.tag == "a" else x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
    body = next((x for x in order if x.tag == "body"), root)
    ratio = body.link_chars / max(body.chars, 1)
    for node in reversed(order):
        c, lc = node.chars, node.link_chars
        if c:
            tags, links = max(node.tags, 1), max(node.link_tags, 1)
            base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
            ahead = c / max(lc, 1) * tags / links
            node.density = node.prior * c / tags * math.log(ahead) / base if ahead > 1 else 0.0
        parts = [x for x in node.items if isinstance(x, Node) and not x.dropped and x.tag in BLOCKS]
        node.total = sum(x.density for x in parts) if parts else node.density
        for x in parts:
            if x.best.total > node.best.total:
                node.best = x.best


def chosen(root: Node) -> list[Node]:
    """Subtrees of the article in page order: where the sum of child densities is largest, within every branch that is
    at least as dense as the thinnest node on the way from the page's best subtree up to the body. In them, boxes thinner than
    that go which are mostly links or have a prior against them."""
    node, threshold = root.best, math.inf
    while node is not None:
        threshold = min(threshold, node.density)
        if node.tag == "body":
            break
        node = node.parent
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node is node.best:
            out.append(node)
        else:
            stack.extend(x for x in reversed(node.items) if isinstance(x, Node) and not x.dropped and x.chars and x.density >= threshold)
    stack = list(out)
    while stack:
        node = stack.pop()
        for x in node.items:
            if isinstance(x, Node) and not x.dropped and x.tag in BLOCKS and not HEADING.fullmatch(x.tag):
                if x.density < threshold and (x.prior < 1 or x.link_tags > 1 and 2 * x.link_chars > x.chars):
                    x.dropped = True
                else:
                    stack.append(x)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks under the nodes: character references decoded, white space one space, empty ones left out."""
    out: list[str] = []
    piece: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(piece)).split())
        piece.clear()
        if text:
            out.append(text)

    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                piece.append(x)
            elif not x.dropped:
                if x.tag in BLOCKS:
                    end()
                    stack.append(None)
                stack.extend(reversed(x.items))
        end()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by one space; empty for a page without text."""
    if not page:
        return ""
    root = parse(page)
    measure(root)
    return " ".join(blocks(chosen(root))) if root.chars else ""


OUT = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html), by itself: no shuffle.

    Null html is empty; a page without text has an empty text. Null page_id and url stay. Repeated rows return each.
    An empty table gives none. Extra columns are not looked at. Whole pages are read, whatever their length.
    """
    bounded_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_extract, OUT)
