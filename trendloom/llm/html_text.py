"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Every paragraph gives points, for its length and its
commas, discounted by its link density, to its parent in full and to each further
ancestor half as many as to the one below. The element with the best total, again
discounted by its own link density, is the container. The article or main that it lies
in stays with all its blocks; without one, the whole page but its lists of links stays.
Siblings of an article stay if they are articles, score like it or are paragraphs of
running text. Elements with a class or id like that of a menu, an advertisement and the
like go only if they hold no article and few paragraph points, or many links; forms,
notices and comments that say so by name go at any length if the page has more. Blocks of
what stays are the text. Inside an article only names that are whole names of menus and
what other people add count. All steps take time in proportion to the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
DROPPED = RAW | frozenset("nav footer aside button select option input label dialog menu head canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
PARAGRAPHS = frozenset("p pre blockquote li td dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|comment|comments|disqus|replies|respond|"
    r"sidebar|side-bar|rail|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|foot|header|masthead|topbar|cookie|cookies|consent|gdpr|notice|notices|"
    r"alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|widget|toolbar|"
    r"pagination|pager|tags|hidden|skip|skip-link|copyright|legal|disclaimer)s?(?:$|[\s_-]|\d)",
    re.I,
)
#: Names of what other people add to a page, at any length.
FOREIGN = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|comment|comments|disqus|replies|respond|cookie|cookies|consent|gdpr|"
    r"related|recommended|recommendations)s?(?:$|[\s_-]|\d)",
    re.I,
)
#: Words of names that count inside an article, and words that may stand beside them.
INSIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus replies respond cookie cookies consent gdpr related recommended "
    "recommendations menu nav navbar navigation breadcrumb breadcrumbs sidebar share sharing social newsletter subscribe subscription signup login widget toolbar pagination pager hidden".split()
)
BESIDE = frozenset("area articles bar block box buttons container content form inner items left links list module outer panel posts right section slot stories top unit wrap wrapper".split())
#: Words of names that are those of reader comments, notices, adverts and the like: an element
#: with such a name (beside it only words of BESIDE, and no name of ARTICLE_NAMES) is nothing
#: else, as is a form with controls. They go however rich they are, if the page has CORE
#: paragraph points besides; else they are wrappers around all of it.
STRICT = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion comment comments disqus replies respond reply cookie cookies consent gdpr notice notices "
    "alert alerts newsletter subscribe subscription signup login".split()
)
ARTICLE_NAMES = frozenset("article post entry story content main text body".split())
CONTROLS = frozenset("input button select textarea option label".split())
CORE = 4.0
#: Elements with an unwanted name stay with so many paragraph points, foreign ones with
#: so large a share of the page's; and with a link density under MANY_LINKS.
POINTS, SHARE, MANY_LINKS = 4.0, 0.5, 0.33
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())

# A quotation mark counts behind = only, and only if another one follows; < ends a tag
# that isn't closed.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/><]*+)((?>[^><=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "commas", "controls", "doubt", "holds", "letters", "links", "parent", "points", "score", "tag", "unwanted")

    def __init__(self, tag: str, parent: Node | None, unwanted: bool = False):
        self.tag, self.parent, self.unwanted = tag, parent, unwanted
        self.children: list[Node | str] = []
        self.letters = self.links = self.commas = 0
        self.score = self.points = 0.0
        self.doubt = 0  # 1 for an unwanted name, 2 for a foreign one, 3 for nothing but that
        self.holds = False  # an article or main
        self.controls = False  # of a form


def _unwanted(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside_article):
        return True
    if not attributes or tag in ("body", "html", "article", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in UNWANTED_ROLES):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _doubt(tag: str, attributes: str, inside_article: bool) -> int:
    if tag in ("body", "html", "main"):
        return 0
    names = [v for name, *values in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for v in values if UNWANTED.search(v)] if attributes else []
    if inside_article:
        words = [[w for w in re.split(r"[\s_-]+|\d+", name.lower()) if w] for name in " ".join(names).split()]
        names = [" ".join(w) for w in words if INSIDE.intersection(w) and INSIDE.union(BESIDE).issuperset(w)]
    elif names and _strict(attributes):
        return 3
    return 2 if any(map(FOREIGN.search, names)) else 1 if names or tag == "form" else 0


def _strict(attributes: str) -> bool:
    names = [n.lower() for name, *values in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for v in values for n in v.split()]
    words = [[w for w in re.split(r"[_-]+|\d+", n) if w] for n in names]
    return not ARTICLE_NAMES.intersection(names) and any(STRICT.intersection(w) and STRICT.union(BESIDE).issuperset(w) for w in words)


class _Open:
    """The open elements, and the depths at which those of each name are."""

    def __init__(self, root: Node):
        self.nodes, self.depths = [root], {}

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def deepest(self, tags: Iterable[str]) -> int:
        return max((at[-1] for at in map(self.depths.get, tags) if at), default=0)

    def mark_form(self) -> None:
        at = self.depths.get("form")
        if at:
            self.nodes[at[-1]].controls = True

    def close(self, tags: Iterable[str], stop: Iterable[str] = ()) -> bool:
        """Closes the innermost of tags and all in it, unless one of stop is further in."""
        depth = self.deepest(tags)
        if depth <= self.deepest(stop):
            return False
        for n in self.nodes[depth:]:
            self.depths[n.tag].pop()
        del self.nodes[depth:]
        return True


#: Start tags that close open elements of these names, up to these.
CLOSES = {
    **{t: (("li",), ("ul", "ol", "menu")) for t in ("li",)}, **{t: (("td", "th"), ("table", "tr")) for t in ("td", "th")}, "tr": (("tr",), ("table",)),
    **{t: (("dt", "dd"), ("dl",)) for t in ("dt", "dd")}, "option": (("option",), ("select",)),
}


def parse(page: str) -> Node:
    """A tree of elements and decoded text. Open elements end as browsers end them: p at
    the next block, li, td and the like at the next of their kind; unknown end tags are
    skipped. Comments, declarations and the insides of raw elements are left out."""
    root = Node("html", None)
    at, opened = 0, _Open(root)
    ends: dict[str, re.Pattern] = {}
    m = TOKEN.search(page)
    while m:
        node = opened.nodes[-1]
        if m.start() > at:
            node.children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if m[1]:
                if tag in HEADINGS:
                    opened.close(HEADINGS)
                elif not opened.close((tag,), ("table",) if tag in ("p", "li", "div", "b", "span", "a") else ()) and tag in ("br", "p"):
                    node.children.append(Node(tag, node))
            elif tag in RAW:
                if tag == "textarea":
                    opened.mark_form()
                if tag not in ends:
                    ends[tag] = re.compile(rf"</{re.escape(tag)}\s*>", re.I)
                end = ends[tag].search(page, at) if ends[tag] else None
                if end is None:
                    ends[tag] = None  # there are no more of them
                at = end.end() if end else len(page)
            else:
                if tag not in INLINE:
                    opened.close(("p",), ("td", "th", "table", "button", "object"))
                if tag in CLOSES:
                    opened.close(*CLOSES[tag])
                node = opened.nodes[-1]
                inside = opened.deepest(("article",)) > 0
                child = Node(tag, node, node.unwanted or _unwanted(tag, m[3], inside))
                child.doubt = _doubt(tag, m[3], inside)
                if tag in CONTROLS:
                    opened.mark_form()
                node.children.append(child)
                if tag not in VOID and not m[3].rstrip().endswith("/"):
                    opened.push(child)
        m = TOKEN.search(page, at)
    if at < len(page):
        opened.nodes[-1].children.append(html.unescape(page[at:]))
    return root


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += [c for c in reversed(n.children) if isinstance(c, Node)]


def _measure(root: Node) -> list[Node]:
    """Sets letters, letters in links, commas and paragraph points of every wanted
    element, and whether it holds an article; elements in page order."""
    order = [n for n in _walk(root) if not n.unwanted]
    for n in reversed(order):
        own = [c for c in n.children if isinstance(c, str)]
        below = [c for c in n.children if isinstance(c, Node) and not c.unwanted]
        n.letters = sum(len(SPACE.sub(" ", c).strip()) for c in own) + sum(c.letters for c in below)
        n.links = n.letters if n.tag == "a" else sum(c.links for c in below)
        n.commas = sum(sum(map(c.count, ",،、，")) for c in own) + sum(c.commas for c in below)
        n.points = _points(n) + sum(c.points for c in below)
        n.holds = (n.tag in ("article", "main") and not n.doubt and n.letters > 0) or any(c.holds for c in below)
    return order


def _density(n: Node) -> float:
    return n.links / n.letters if n.letters else 0.0


def _is_paragraph(n: Node) -> bool:
    if n.tag in PARAGRAPHS:
        return True
    return n.tag in ("div", "section", "article", "td") and any(isinstance(c, str) and c.strip() for c in n.children)


def _points(n: Node) -> float:
    if not n.letters or not _is_paragraph(n):
        return 0.0
    return (1 + n.commas + min(n.letters / 100, 3)) * (1 - _density(n))


def _drop_doubtful(root: Node) -> None:
    """Forms and elements of strict names go if there is enough besides. Others of unwanted
    names go, unless they hold an article or are rich in paragraph points and poor in
    links."""
    order = _measure(root)
    strict = [n for n in order if not n.holds and (n.doubt == 3 or (n.tag == "form" and n.controls))]
    inside: set[int] = set()
    outer = []
    for n in strict:  # in page order: the outer ones come first
        if id(n) not in inside:
            outer.append(n)
            inside.update(map(id, _walk(n)))
    if root.points - sum(n.points for n in outer) >= CORE:
        for n in outer:
            for x in _walk(n):
                x.unwanted = True
        order = _measure(root)
    for n in order:
        if not n.doubt or n.unwanted or n.holds:
            continue
        rich = n.points >= (POINTS if n.doubt == 1 else max(POINTS, SHARE * root.points)) and not (n.doubt >= 2 and root.holds)
        if not rich or _density(n) >= MANY_LINKS:
            for x in _walk(n):
                x.unwanted = True


def _poor_in_links(children: list[Node | str]) -> list[Node | str]:
    """Without the blocks, and runs of loose text, that are mostly links."""
    kept: list[Node | str] = []
    run: list[Node | str] = []

    def cut() -> None:
        letters = sum(len(c.strip()) if isinstance(c, str) else c.letters for c in run)
        if 2 * sum(c.links for c in run if isinstance(c, Node)) <= letters:
            kept.extend(run)
        run.clear()

    for c in children:
        if isinstance(c, str) or c.tag in INLINE:
            if isinstance(c, str) or not c.unwanted:
                run.append(c)
            continue
        cut()
        if c.tag in HEADINGS or c.holds or _density(c) <= 0.5:
            kept.append(c)
    cut()
    return kept


def container(root: Node) -> list[Node]:
    """What stays of the page, in page order: the article or main around the best
    element and those of its siblings that stay, or the page without lists of links."""
    _drop_doubtful(root)
    order = _measure(root)
    for n in reversed(order):
        points, passed = _points(n), n.score / 2
        if n.tag in PARAGRAPHS:
            passed += points
        else:
            n.score += points
            passed += points / 2
        if n.parent is not None:
            n.parent.score += passed
    scored = [n for n in order if n.score > 0]
    if not scored:
        return [root] if root.letters else []
    value = lambda n: n.score * (1 - _density(n)) * (1.25 if n.tag in ("article", "main") else 1.0)
    best = max(scored, key=value)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    inner = max((i for i, n in enumerate(path) if n.tag == "article"), default=0)
    top = max((i for i, n in enumerate(path) if n.tag in ("article", "main")), default=len(path) - 1)
    for n in path[inner + 1 : top + 1]:
        n.children = _poor_in_links(n.children)
    best = path[top]
    if best.parent is None:
        return [best]
    kept = []
    least = max(10.0, 0.2 * value(best))
    for c in best.parent.children:
        if c is best:
            kept.append(c)
        elif isinstance(c, Node) and not c.unwanted and c.letters:
            text_like = c.tag == "p" and _density(c) < (0.25 if c.letters > 80 else 0.01) and c.letters > 40
            if value(c) >= least or text_like or (c.tag in ("article", "main") and _density(c) <= 0.5):
                kept.append(c)
    return kept


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the block elements, in page order; white space becomes one space."""
    out: list[str] = []
    parts: list[str] = []

    def cut() -> None:
        text = SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [x for n in reversed(nodes) for x in (None, n)]
    while stack:
        x = stack.pop()
        if x is None:
            cut()
        elif isinstance(x, str):
            parts.append(x)
        elif not x.unwanted:
            if x.tag == "br":
                parts.append(" ")
                continue
            if x.tag not in INLINE:
                cut()
                stack.append(None)
            stack += reversed(x.children)
    cut()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(container(parse(page)))) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars of every page, from its whole HTML.

    A null or empty page, or one without text outside of menus and the like, has an
    empty text. Null ids and addresses and repeated rows are kept. An empty table gives
    no rows. Other columns aren't read.
    """
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                texts = [main_text(p) for p in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    names=["id", "url", "text", "n_chars"],
                )

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(
        run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long"
    )
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
