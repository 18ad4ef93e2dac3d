"""Main text of HTML pages by composite text density.

A page becomes a tree of elements. For every node, characters and tags below it, and those of them in links, give the
composite text density: characters a tag, damped where link characters and link tags prevail relative to the body. A node's
density sum adds the densities of its children; text that stands directly in a node counts as a child without tags. The
subtree with the largest sum is the content; the threshold is the least density on the path from the body to it, and within
it, outside article and main elements, blocks of a lower density that hold hardly anything but short links, a menu, are left
out. Headings that stand right
before the subtree, or before what encloses it, belong to it.

What the page's markup says is evidence beside that. Scripts, styles, controls, menus, asides, footers, and headers outside
an article or main element are left out. Forms, and nodes whose role or class names say that they're a sidebar, advert,
notice, reader comments or the like, are marked: their densities don't count elsewhere, and a marked node is left out unless
the largest density sum below it exceeds that of all that isn't marked; then it is a wrapper, whatever its name (ten times as
large for comments and consent texts, which may well outweigh an article, and on pages with an article or main element). A
class name marks if all its parts are such words, or words of place and layout besides; "ad-hoc" and "has-sidebar" don't. An id
alone marks nothing in an article that has ENOUGH characters outside links.
Where a page has article or main elements, the largest sum is sought in them, and the element around it is taken whole.

Text comes out a block at a time: character references decoded, white space within a block made one space, blocks in page
order joined by two line feeds. A page is read tag by tag, forwards only: time grows in proportion to its length, also
with unbalanced quotes and deep or wrong nesting. Pages don't meet, so there's no shuffle.

Defined results: null or empty html, or a page without text, gives an empty text; markup that isn't closed, or closed out
of order, is closed by its parent, a paragraph also by the next block; a tag without an end is text; repeated rows stay; an
empty table gives an empty result; other columns pass through, and clashing names go to the result.
"""

from __future__ import annotations

import heapq
import html as entities
import math
import re

from pyspark.sql import DataFrame

from .common import ship

#: Fixed lists of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CHROME = frozenset("nav footer aside script style noscript template iframe svg button select option input textarea menu dialog embed video audio canvas head title".split())
ENDS_PARAGRAPH = BLOCK - {"body", "html"}
OWN_KIND = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr td th", "tbody": "thead tr td th", "tfoot": "tbody tr td th"}
#: Words of a class or id, or roles, that mark what isn't the article.
ASIDE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar aside related widget widgets comment comments commentlist disqus respond footer masthead topbar cookie cookies consent notice notices gdpr newsletter subscribe subscription signup login form".split())
#: Words that may stand beside those in one class name.
BESIDE = frozenset("area bar block body bottom box btn button buttons center col column container content div el inner item items left link links list main outer page panel post posts primary right second secondary section site small text title top wrap wrapper".split())
#: Words for what is other text than the article however much of it there is.
OTHERS = frozenset("comment comments commentlist disqus respond cookie cookies consent gdpr".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
#: Elements that hold an article's blocks.
HOLDERS = frozenset("html body main article section div td center".split())
#: Such words in the class of one of these don't matter: they hold the whole page.
WHOLE = frozenset("html body main".split())
FORMS = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 hgroup".split())
LISTS = frozenset("ul ol menu table div section p".split())
#: What a node is by its name and attributes: part of the page, marked as aside, marked as other text, left out at all events,
#: or named in an article by an id alone, which counts only where there is little text.
PLAIN, MARKED, OTHER, OUT, NAMED = range(5)
RANK = (PLAIN, NAMED, MARKED, OTHER, OUT)
#: Characters outside links from which a node with such an id is part of the article.
ENOUGH = 200

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
PLAIN_ATTRIBUTES = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "parts", "kind", "skip", "within", "paragraph", "chars", "tags", "link_chars", "link_tags", "density", "total", "reach", "form")

    def __init__(self, name: str, parent: Node | None, kind: int):
        self.name, self.parent, self.parts, self.kind, self.skip = name, parent, [], kind, kind == OUT  # parts: strings and nodes, in page order
        self.within = name in ("article", "main") or bool(parent and parent.within)  # in an article or main element
        self.form = name in FORMS or bool(parent and parent.form)
        #: The paragraph that the next block ends: the one that is open around this node, if no block lies between.
        self.paragraph = self if name == "p" else None if name in BLOCK or not parent else parent.paragraph
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = self.reach = 0.0


def _class_kind(value: str) -> int:
    """What the names in a class or id make of an element: a name counts if its parts are all known words, one an aside's."""
    kind = PLAIN
    for name in value.split():
        parts = [w.lower() for w in PART.findall(name)]
        own = [w for w in parts if w in ASIDE_WORDS]
        if own and all(w in ASIDE_WORDS or w in BESIDE or w.isdigit() for w in parts):
            if any(w in OTHERS for w in own):
                return OTHER
            kind = MARKED
    return kind


def _kind(name: str, attributes: str, parent: Node) -> int:
    within = parent.within
    if name in CHROME or (name == "header" and not within) or (name == "label" and parent.form):
        return OUT
    kind = MARKED if name in FORMS else PLAIN
    if not attributes or name in WHOLE:
        return kind
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next(filter(None, values), "")
        if key in ("class", "id"):
            own = _class_kind(value)
            if key == "id" and within and own == MARKED:
                own = NAMED
            if name != "article" or own == OTHER:  # an article is the page's, whatever its class, unless it is a comment
                kind = max(kind, own, key=RANK.index)
        elif name == "article":
            continue
        elif key == "role":
            if value.lower() in ASIDE_ROLES:
                kind = max(kind, MARKED, key=RANK.index)
        elif key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return OUT
        elif key in ("hidden", "aria-hidden") and value.lower() != "false":
            return OUT
    return kind


def tags(page: str):
    """(start, end, name, closing, attributes) of every tag, with no name for comments and declarations; a CDATA section has
    the name "[" and its text as attributes. Reads forwards only."""
    at, last = 0, {q: page.rfind(q) for q in "\"'"}
    dead: set[int] = set()  # places of quotes from which no end of a tag was found
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
            at = end
            continue
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            yield at, len(page) if end < 0 else end + 3, "[", False, page[at + 9 : len(page) if end < 0 else end]
            at = len(page) if end < 0 else end + 3
            continue
        m = NAME.match(page, at)
        if m is None and page[at + 1 : at + 2] not in ("!", "?"):
            at += 1
            continue
        first = m.end() if m else at + 1
        now, met = first, []
        while True:  # a quote is met once: those of a tag without an end are dead
            now = PLAIN_ATTRIBUTES.match(page, now).end()
            sign = page[now : now + 1]
            if sign in ("", ">") or now in dead:
                break
            met.append(now)
            now = page.find(sign, now + 1) + 1 if now < last[sign] else now + 1  # a quote without a second one is a sign like others
        if page[now : now + 1] != ">":  # no end outside quotes: the next one within them, if any
            dead.update(met)
            now = page.find(">", first)
            if now < 0:
                return
        yield at, now + 1, m[1].lower() if m else "", page[at + 1] == "/", page[first:now]
        at = now + 1


def parse(page: str) -> Node:
    """The tree of a page; elements left open are closed by their parent."""
    root = now = Node("html", None, PLAIN)
    open_: dict[str, int] = {}  # how many elements of a name are open
    at, seen = 0, {"html"}

    def close(node: Node) -> Node:
        """Leaves a node, and all that is open in it; its parent."""
        nonlocal now
        while now is not node.parent:
            open_[now.name] -= 1
            now = now.parent
        return now

    skip_to = 0
    for start, end, name, closing, attributes in tags(page):
        if start < skip_to:
            continue
        if start > at:
            now.parts.append(page[at:start])
        at = end
        if not name:
            continue
        if name == "[":
            now.parts.append(attributes)
            continue
        if closing:
            if open_.get(name):
                node = now
                while node.name != name:
                    node = node.parent
                close(node)
            continue
        if name in ("html", "head", "body"):
            if name in seen:
                continue
            seen.add(name)
            if name == "body" and now.name == "head":
                close(now)
        if name in ENDS_PARAGRAPH and now.paragraph:
            close(now.paragraph)  # with the inline elements in it
        while name in OWN_KIND and now.parent and now.name in OWN_KIND[name].split():
            close(now)
        node = Node(name, now, OUT if now.skip else _kind(name, attributes, now))
        now.parts.append(node)
        if name in RAW:
            closed = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            node.parts.append(page[at : closed.start() if closed else len(page)])
            node.skip = True
            skip_to = at = closed.end() if closed else len(page)
        elif name not in VOID and not attributes.endswith("/"):
            open_[name] = open_.get(name, 0) + 1
            now = node
    if at < len(page):
        now.parts.append(page[at:])
    return root


def _path(node: Node | None):
    while node:
        yield node
        node = node.parent


def _order(root: Node) -> list[Node]:
    """All nodes that aren't left out, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.skip:
            order.append(node)
            stack.extend(x for x in reversed(node.parts) if isinstance(x, Node))
    return order


def _length(text: str) -> int:
    return len(SPACE.sub(" ", text).strip())


def weigh(root: Node) -> list[Node]:
    """Counts, densities and density sums of every node that isn't left out; the nodes in page order.

    What is marked counts below itself alone, not in the nodes around it. reach is the largest sum of a node and of the
    unmarked ones below it.
    """
    order = _order(root)
    for node in order:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = node.total = node.reach = 0.0
    for node in reversed(order):
        for x in node.parts:
            if isinstance(x, str):
                node.chars += _length(x)
            elif not x.skip and x.kind == PLAIN:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.name == "a")
        if node.name == "a":
            node.link_chars = node.chars
    whole = next((x for x in order if x.name == "body"), root)
    share = whole.link_chars / max(whole.chars, 1)
    for node in order:
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in reversed(order):
        for x in node.parts:
            if isinstance(x, str):
                n = _length(x)
                node.total += _density(n, 0, n if node.name == "a" else 0, 0, share) if n else 0
            elif not x.skip and x.kind == PLAIN:
                node.total += x.density
                node.reach = max(node.reach, x.reach)
        node.reach = max(node.reach, node.total)
    return order


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density; share is that of link characters in the body."""
    if not chars:
        return 0.0
    tags = max(tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    value = chars / max(link_chars, 1) * tags / max(link_tags, 1)
    return chars / tags * math.log(max(value, 1.0)) / math.log(max(base, 1.1))


def leave_out(root: Node) -> None:
    """Decides by density sums which of the marked nodes are parts of the page, to be left out, and which are wrappers."""
    order = _order(root)
    if any(x.kind == NAMED for x in order):
        own: dict[int, int] = {}  # characters outside links below a node
        for x in reversed(order):
            own[id(x)] = 0 if x.name == "a" else sum(_length(y) if isinstance(y, str) else own.get(id(y), 0) for y in x.parts)
            if x.kind == NAMED:
                x.kind = PLAIN if own[id(x)] >= ENOUGH else MARKED
    order = weigh(root)
    if all(x.kind == PLAIN for x in order):
        return
    under: dict[int, bool] = {}  # whether a node is within reader comments or the like
    for x in order:
        under[id(x)] = x.kind == OTHER or (x.parent is not None and under[id(x.parent)])
    holders = set()
    for name in ("article", "main"):
        held = [x for x in order if x.name == name and x.reach and not under[id(x)]]
        if held:
            holders.update(_path(max(held, key=lambda x: x.reach)))

    def outermost(node: Node):
        stack = [node]
        while stack:
            for x in stack.pop().parts:
                if isinstance(x, Node) and not x.skip:
                    if x.kind == PLAIN:
                        stack.append(x)
                    else:
                        yield x

    waiting: list = []  # holders first, then the largest, comments and the like last
    made = 0

    def wait(node: Node) -> None:
        nonlocal made
        for x in outermost(node):
            made += 1
            heapq.heappush(waiting, (x not in holders, x.kind == OTHER, -x.reach, made, x))

    wait(root)
    rest = root.reach
    while waiting:
        outside, other, least, _, node = heapq.heappop(waiting)
        if not outside or -least > (10 * rest if other or holders else rest):
            rest = max(rest, node.reach)
            node.kind = PLAIN
            wait(node)
        else:
            node.skip = True


def content(order: list[Node]) -> tuple[Node, float]:
    """The node of the largest density sum, in article or main elements if there are any, and the least density on the path to
    it from the body."""
    within = [x for x in order if x.within and x.reach]
    best = max(within or order, key=lambda x: x.total)  # of equal ones the first, which is the outermost
    threshold, node = best.density, best
    while node and node.name != "body":
        threshold = min(threshold, node.density)
        node = node.parent
    return best, threshold


def _headings(top: Node) -> list[Node]:
    """Headings right before the content, or right before a node that holds it."""
    found: list[Node] = []
    for node in _path(top):
        if not node.parent or node.within:
            break
        before = node.parent.parts[: next(i for i, x in enumerate(node.parent.parts) if x is node)]
        for x in reversed(before):
            if isinstance(x, str):
                if x.strip():
                    break
            elif not x.skip and x.chars:
                if x.name not in HEADINGS:
                    break
                found.append(x)
    return found[::-1]


def _menu(x: Node, threshold: float) -> bool:
    """A list or table of hardly anything but short links. A low density alone is no reason to drop a block."""
    return x.density < threshold and x.link_tags > 2 and x.link_chars > 0.9 * x.chars and x.link_chars < 16 * x.link_tags and x.name in LISTS


def main_text(page: str | None) -> str:
    """The main text of a page; blocks joined by two line feeds."""
    if not page:
        return ""
    root = parse(page)
    leave_out(root)
    top, threshold = content(weigh(root))
    while top.parent and top.name not in HOLDERS:  # a page of one paragraph has its largest sum inside that
        top = top.parent
    for name in ("article", "main"):
        if (node := next((x for x in _path(top) if x.name == name), None)) is not None:
            top = node
            break
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(line))).strip()
        line.clear()
        if text:
            blocks.append(text)

    stack: list = [top, *reversed(_headings(top))]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif not x.skip:
            if x.name == "br":
                line.append(" ")
                continue
            block = x.name in BLOCK
            if block:
                end()
                if x is not top and not x.within and _menu(x, threshold):
                    continue
                stack.append(None)
            stack.extend(reversed(x.parts))
    end()
    return "\n\n".join(blocks)


def extracted(pages: DataFrame) -> DataFrame:
    """Adds text and n_chars to rows with html."""
    ship(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    keep = [f for f in pages.schema.fields if f.name != "html"]

    def work(parts):
        import pyarrow as pa

        for part in parts:
            texts = [main_text(x.as_py()) for x in part.column(part.schema.get_field_index("html"))]
            others = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n != "html"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in others), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*(n for n, _ in others), "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "text string, n_chars long"])
    return pages.mapInArrow(work, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
