"""Main text of web pages by tree scoring, and the small HTML reader that it needs."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+[^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"br", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary"}
#: Elements that end when one of the same kind begins, and what stops the search for them.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that never hold article text.
NEVER = frozenset("aside button canvas dialog embed fieldset footer form head iframe input menu nav noscript object script search select style svg template textarea video audio".split())
#: Parts of a class, id or role that mark what surrounds an article.
_AROUND = re.compile(r"(?:ads?|adv|advert\w*|adsense|adslot|banner|breadcrumbs?|comments?|commentary|commentlist|consent|contentinfo|cookies?|disqus|disclaimer|footer|footnav|gdpr|header|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notices?|notifications?|overlay|pager|pagination|popup|promos?|promoted|promotion|rail|recommend\w*|related|replies|respond|share|sharing|sidebar|sidenav|social|sponsor\w*|subscribe|subscription|syndication|toolbar|topbar|widgets?)")
#: Parts that say of the part behind them that it is absent or stands elsewhere.
_OF_ANOTHER = frozenset("has have no non not with without hide hides hidden show shows free toggle enable enabled disable disabled".split())
_COMMENTS = frozenset("comment comments commentary commentlist disqus replies respond".split())
_HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_PARTS = re.compile(r"[\s_-]+")
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|hentry|main|page|post|story|text)(?=$|[\s_-])")
SCORED = frozenset("html p pre td blockquote div section article main body li dd h1 h2 h3 h4 h5 h6".split())


class Node:
    """own: what measure() finds. scope: the block that an element is in, or is. open: for a block, its open inline elements by name."""

    __slots__ = ("tag", "attrs", "parent", "children", "score", "own", "scope", "open")

    def __init__(self, tag: str, attrs: str, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.score, self.own = 0.0, None
        self.scope: Node = self if parent is None or tag in BLOCKS else parent.scope
        self.open: dict[str, int] = {}


def attributes(text: str) -> dict[str, str]:
    """Attributes of a tag; the first of several of one name counts."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def tree(source: str) -> Node:
    """The element tree of a page, with the end tags that HTML lets authors leave out.

    An end tag closes what is open inside its element, but one of an inline element never closes a block; end tags of
    nothing that is open are left out. Open elements are counted, so none of this looks through them in vain.
    """
    root = at = Node("html", "", None)
    blocks: dict[str, int] = {}  # open blocks by name
    pos, n = 0, len(source)

    def opened(node: Node, by: int) -> None:
        held = blocks if node.scope is node else node.scope.open
        held[node.tag] = held.get(node.tag, 0) + by

    def closed(node: Node) -> Node:
        """Closes all from the open element up to the node; gives what is open then."""
        up = at
        while True:
            opened(up, -1)
            if up is node:
                return up.parent
            up = up.parent

    for m in iter(lambda: _TOKEN.search(source, pos), None):
        if m.start() > pos:
            at.children.append(html.unescape(source[pos : m.start()]))
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if (blocks if tag in BLOCKS else at.scope.open).get(tag):
                up = at
                while up.tag != tag:
                    up = up.parent
                at = closed(up)
            continue
        if tag == "html" or (tag == "body" and blocks.get("body")):
            continue
        if tag in CLOSES_P:
            if at.scope.tag == "p":
                at = closed(at.scope)
        elif tag in SIBLINGS:
            same, stop = SIBLINGS[tag]
            up = at.scope
            while up.parent is not None and up.tag not in stop:
                above = up.parent
                if up.tag in same:
                    at = closed(up)
                    if tag != "tr":
                        break
                up = above.scope
        node = Node(tag, m[3], at)
        at.children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}[^>]*(?:>|\\Z)", re.I).search(source, pos)
            node.children.append(source[pos : end.start() if end else n])
            pos = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            at = node
            opened(node, 1)
        if pos >= n:
            break
    if pos < n:
        at.children.append(html.unescape(source[pos:]))
    return root


def _upwards(node: Node | None) -> Iterator[Node]:
    while node is not None and node.parent is not None:
        yield node
        node = node.parent


#: Whether an element stays, goes, or leaves only its headings.
STAYS, GOES, TITLE = 0, 1, 2


def around(node: Node, inside: bool, whole: int) -> int:
    """Whether an element belongs to what surrounds an article, as STAYS, GOES or TITLE.

    inside: it stands in an article or main element. whole: characters of the page. A form around half of the page's text is
    no form to fill in. What a style hides goes. Classes count as whole names, cut
    at dashes: a part that follows has, no, with and the like says nothing about the element itself. Nor does one in a
    longer name, if the element holds half of the page's text, or in any, if it holds the main element, or a top heading and a third of the text. Of a header
    inside an article the headings stay.
    """
    if node.tag == "header":
        return TITLE if inside else GOES
    if node.tag in NEVER and not (node.tag in ("form", "fieldset") and 2 * node.own[0] >= whole):
        return GOES
    if not node.attrs or node.tag in ("body", "html", "article", "main"):
        return STAYS
    a = attributes(node.attrs)
    if "hidden" in a or a.get("aria-hidden") == "true" or _HIDES.search(a.get("style", "")):
        return GOES
    found = STAYS
    for kind in ("class", "id", "role"):
        for name in a.get(kind, "").lower().split():
            parts = [x for x in _PARTS.split(name) if x]
            for i, part in enumerate(parts):
                if not _AROUND.fullmatch(part) or _OF_ANOTHER & {*parts[max(0, i - 2) : i], *parts[i + 1 : i + 2]}:
                    continue
                chars, main, top = node.own[0], node.own[4], node.own[5]
                if main or (top and 3 * chars >= whole) or (len(parts) > 1 and 2 * chars >= whole and part not in _COMMENTS):
                    continue
                if part == "header" and (inside or {"entry", "post", "article", "story"} & set(parts)):
                    found = TITLE
                else:
                    return GOES
    return found


def headings(node: Node) -> list[Node]:
    """The headings below a node, in page order, without those in menus, forms and the like."""
    found, stack = [], [node]
    while stack:
        at = stack.pop()
        if at.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            found.append(at)
        elif at is node or at.tag not in NEVER:
            stack.extend(x for x in reversed(at.children) if not isinstance(x, str))
    return found


def pruned(node: Node, inside: bool = False) -> None:
    """Takes out what surrounds an article, below a node that was measured."""
    stack = [(node, inside)]
    whole = node.own[0]
    while stack:
        at, within = stack.pop()
        within |= at.tag in ("article", "main")
        left: list[Node | str] = []
        for x in at.children:
            what = STAYS if isinstance(x, str) else around(x, within, whole)
            if what == TITLE:
                x.children = headings(x)
                for h in x.children:
                    h.parent = x
            if what != GOES:
                left.append(x)
        at.children = left
        stack.extend((x, within) for x in left if not isinstance(x, str))


def measure(root: Node) -> list[Node]:
    """Sets own of each node to (characters, characters in links, commas, links, whether it holds a main element, whether a top heading); gives the nodes, children first. Scripts and the like have no characters."""
    order, stack = [], [root]
    while stack:
        at = stack.pop()
        order.append(at)
        stack.extend(x for x in at.children if not isinstance(x, str))
    order.reverse()
    for at in order:
        chars = linked = commas = links = 0
        main, heading = at.tag == "main", at.tag == "h1"
        for x in () if at.tag in RAW else at.children:
            if isinstance(x, str):
                chars += len(" ".join(x.split()))
                commas += x.count(",") + x.count("、") + x.count("，")
            else:
                a, b, c, d, e, f = x.own
                chars, linked, commas, links = chars + a, linked + b, commas + c, links + d
                main, heading = main or e, heading or f
        if at.tag == "a":
            linked, links = chars, links + 1
        at.own = (chars, linked, commas, links, main, heading)
    return order


def best(root: Node) -> list[Node]:
    """The nodes that hold the article: the container of the best score, and siblings that belong to it."""
    order = measure(root)
    given: dict[int, float] = {}  # points that a container gets from its own paragraphs
    for at in order:
        direct = any(isinstance(x, str) and x.strip() for x in at.children) or any(not isinstance(x, str) and x.tag not in BLOCKS and x.own[0] for x in at.children)
        if at.tag not in SCORED or not direct or not at.own[0]:
            continue
        chars, linked, commas = at.own[:3]
        points = (1 + commas + min(chars / 100, 3)) * (1 - linked / chars)
        up, depth = at.parent if at.tag not in ("html", "body", "article", "main", "div", "section") else at, 0
        if up is not None:
            given[id(up)] = given.get(id(up), 0.0) + points
        while up is not None and depth < 6:
            up.score += points / (1 if depth == 0 else 2 * depth)
            up, depth = up.parent, depth + 1
    scored = [x for x in order if x.score > 0]
    if not scored:
        return []
    for x in scored:
        if x.tag in ("article", "main"):
            x.score = 2 * x.score + 5
        elif x.attrs and _GOOD.search(" ".join(attributes(x.attrs).get(k, "") for k in ("class", "id", "role")).lower()):
            x.score = 1.25 * x.score + 2
        x.score *= 1 - x.own[1] / max(1, x.own[0])
    top = max(reversed(scored), key=lambda x: x.score)  # the outermost of equals
    for up in _upwards(top):
        if up.tag == "article" or (up.tag == "main" and not any(x.tag == "article" for x in _upwards(top))):
            top = up
            break
    return gathered(top, order, given)


def gathered(top: Node, order: list[Node], given: dict[int, float]) -> list[Node]:
    """The best container with what belongs to it, in page order.

    Beside a main or body element nothing does. Beside an article, other articles and sections do, and a top heading; beside
    any other container, elements of a fifth of its score, and paragraphs and headings. What stands there or beside its
    ancestors also belongs to it if a container in it gets, from its own paragraphs, a quarter of the points that one in the
    best gets: columns that are nested alike. What is mostly links never does. All bars are relative, so short pages keep their parts as long ones do.
    """
    if top.parent is None or top.tag in ("main", "body"):
        return [top]
    peak: dict[int, float] = {}  # the most points given to a node or one below it
    for x in order:
        peak[id(x)] = max([given.get(id(x), 0.0), *(peak.get(id(c), 0.0) for c in x.children if not isinstance(c, str))])

    def belongs(x: Node, beside: bool) -> bool:
        chars, linked = x.own[:2]
        density = linked / max(1, chars)
        if not chars or density >= 0.5:
            return False
        if x.tag in ("article", "section") and (beside or top.tag == "article"):
            return True
        if top.tag == "article":
            return x.tag == "h1" and density == 0
        if density < 0.25 and peak[id(x)] >= 0.25 * peak[id(top)]:
            return True
        if not beside:
            return False
        if x.tag in ("p", "pre", "blockquote"):
            return density < 0.25 if chars > 80 else density == 0
        return x.score >= 0.2 * top.score or (x.tag in ("h1", "h2", "h3", "h4") and density == 0)

    found, at = [top], top
    while at.parent is not None and at.tag not in ("main", "body"):
        place = next(i for i, x in enumerate(at.parent.children) if x is at)
        kept = [(i > place, x) for i, x in enumerate(at.parent.children) if i != place and not isinstance(x, str) and belongs(x, at is top)]
        found = [x for behind, x in kept if not behind] + found + [x for behind, x in kept if behind]
        at = at.parent
    return found


def menus(nodes: list[Node]) -> set[int]:
    """Lists, tables and boxes of links alone that stand before the first or behind the last other text of the nodes, by id.

    Links inside an article or main element, or between other text, belong to it.
    """
    if any(x.tag in ("article", "main") for n in nodes for x in (n, *_upwards(n))):
        return set()
    found: list[tuple[bool, int]] = []
    stack = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if x.strip():
                found.append((False, 0))
        elif x.tag in ("ul", "ol", "table", "div", "section") and x.own[3] >= 3 and x.own[1] >= 0.8 * x.own[0]:
            found.append((True, id(x)))
        else:
            stack.extend(reversed(x.children))
    others = [i for i, (is_menu, _) in enumerate(found) if not is_menu]
    return {at for i, (is_menu, at) in enumerate(found) if is_menu and (not others or not others[0] < i < others[-1])}


def text_of(nodes: list[Node]) -> str:
    """Text of nodes in page order: blocks are joined by one space, white space inside them is one space; menus are left out."""
    parts: list[str] = []
    out = menus(nodes)
    stack: list[Node | str] = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        if id(x) in out:
            continue
        block = x.tag in BLOCKS
        if block:
            parts.append(" ")
            stack.append(" ")
        stack.extend(reversed(x.children))
    return " ".join("".join(parts).split())


def main_text(source: str | None) -> str:
    """The main text of a page; empty for null, empty and text-free pages."""
    if not source:
        return ""
    root = tree(source)
    measure(root)
    pruned(root)
    return text_of(best(root))


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """Adds text and n_chars (code points) of each page's main text.

    Elements that never hold article text, and those whose class, id or role names a menu, notice, advert, comment list
    or the like, go first (of a header inside an article the headings stay). Paragraphs then pass points for length and commas to their ancestors (full to the parent,
    less with each step up), discounted by the share of their text inside links; the container of the best score is
    kept with the siblings that belong to it, and with columns beside its ancestors (`gathered`). Points reach the six nearest
    ancestors; those farther up would get less than a tenth of them. Null, empty and text-free pages have the text ''. Rows are independent:
    repeated rows and ties give equal results, nothing is shuffled, whole pages are read whatever their length. New
    columns replace columns of the same names.
    """
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    at = kept.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = [main_text(t) for t in batch.column(at).to_pylist()]
                columns = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, "text", "n_chars"])

    return pages.select(*kept).mapInArrow(run, pages.select(*kept).schema.add("text", "string").add("n_chars", "long"))
