"""Main text of web pages by tree scoring.

A page becomes a tree (start tags close what HTML lets them close; attributes are read
by HTML's own rules; script, style and the like are skipped as raw text). Every
paragraph, that is an element with text of its own, earns points for its length and
commas, and passes them to its ancestors, half as much at each further level. A
container's points, with a bonus or malus for its tag and names, are discounted by its
link density. The best container, or the article it lies in, stays with those of its
siblings that score enough of its points.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are
marked by their tags, roles and names. A name marks only if its words say nothing else
("comments-area"), not where it describes a layout ("has-sidebar") or means another
thing ("social-history"); those cost points at most. Marked elements are left out, but
a mark is lifted where it would take the article with it: from what holds the page's
only article or main element, from a form around the page, and from a wrapper around
most of the text with its headline. Paragraphs inside an article are marked by the names
of adverts alone. Lists that consist of links are left out outside the article only.

What stays gives one block for each block-level run of text, with character references
decoded and white space as one space; blocks are joined by an empty line. Nothing is
dropped for being short or deep, and nothing is cut.

Results for special inputs: a null or empty html, or one without article text, gives
the empty text. Unclosed and misplaced tags are repaired as browsers do in the common
cases. Repeated rows each give a row, an empty table an empty one. Extra columns are
ignored. Pages are parsed whole.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches

#: One attribute; a quote that is never closed is part of a name, not the start of a value.
_ATTRIBUTE = r"[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++|(?=>)))?+"
TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?:>|[^A-Za-z>][^>]*(?:>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|(?![\"'])([^\s>]++)|(?=>)))?+")

# Names of HTML elements by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup, or nothing to read. Those of TEXT_ONLY last to their end tag or the page's end.
RAW = frozenset("script style textarea title noscript template iframe svg math object select xmp noembed noframes".split())
TEXT_ONLY = frozenset("script style textarea title iframe xmp noembed noframes".split())
IN_HEAD = frozenset("title meta link base style script noscript template basefont bgsound".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes an open element of these; the search ends at a container (BOUND).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}}
BOUND = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "option": {"select"}}

# What isn't article text, by tag, role, and words of class and id.
LEFT_OUT = frozenset("nav aside footer form button fieldset dialog menu label input select head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
#: These words mark whatever stands beside them.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense adsbygoogle adbox adslot sponsor sponsors sponsored promo promoted outbrain taboola".split())
SURE_NAMES = ADVERTS | frozenset("disqus commentlist cookie cookies consent gdpr newsletter subscribe signup paywall popup popover breadcrumb breadcrumbs navbar pagination searchbox printonly recirc sharebar".split())
#: These mark if no word beside them says something else.
NAMES = frozenset(
    "banner promotion comment comments discussion respond replies reply notice notices alert modal overlay subscription share sharing social sidebar side aside rail "
    "menu menus nav navigation pager header masthead topbar footer foot bottombar related recommended recommendations widget widgets toolbar copyright legal disclaimer skip login search hidden".split()
)
#: Words that say nothing about content.
NEUTRAL = frozenset(
    "container wrapper wrap outer inner area list box section block link links button buttons icon icons bar panel item items row rows col cols column columns group holder "
    "site page global top bottom left right center primary secondary main fixed sticky responsive mobile desktop js id div module region zone unit slot feed form title sm md lg xl".split()
)
LAYOUT = frozenset("has with no without hide show".split())
FAVOURED = frozenset("article articlebody post entry content main story body text page hentry blog".split())
TAG_POINTS = {"article": 25, "main": 20, "section": 3, "div": 5, "blockquote": 3, "td": 3, "pre": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "table": -1, "address": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "th": -5}
SIBLING_SHARE, LINK_LIST = 0.2, 0.5
PARAGRAPHS = HEADINGS | frozenset("p li dt dd td th blockquote pre figcaption".split())
WRAPPED = 2  # a named wrapper holds so many times the text outside marks, if its mark is lifted
COMMAS = re.compile("[,،﹐﹑、,]")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "parts", "mark", "out", "points", "length", "linked", "scored", "inside", "core", "favoured", "given")

    def __init__(self, tag: str, parent: Node | None, mark: str = "", points: float = 0.0, core: bool = False, favoured: bool = False):
        self.tag, self.parent, self.mark, self.points, self.core, self.favoured = tag, parent, mark, points, core, favoured
        self.inside = core or parent is not None and parent.inside
        self.parts: list[str | Node] = []  # texts and elements in page order
        self.length = self.linked = 0  # characters below, and those in links
        self.given = 0.0  # points from paragraphs below
        self.scored = self.out = False


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), references.unescape(m[2] or m[3] or m[4] or ""))  # of repeated ones the first counts
    return out


def _words(name: str) -> list[str]:
    return [w.lower() for w in NAME_WORD.findall(name)]


def _named(names: list[list[str]], inside: bool) -> str:
    """What names (lists of words) say: "advert", "named", "weak" or nothing."""
    said = ""
    for words in names:
        if LAYOUT.intersection(words):
            continue
        if ADVERTS.intersection(words):
            return "advert"
        if SURE_NAMES.intersection(words):
            said = "named"
            continue
        found = [w for w in words if w in NAMES and not (w == "header" and (inside or FAVOURED.intersection(words)))]
        if found:
            plain = all(w in NAMES or w in NEUTRAL or w in FAVOURED or w.isdigit() or len(w) == 1 for w in words)
            said = "named" if plain or said == "named" else "weak"
    return said


def _start(tag: str, source: str, parent: Node) -> Node:
    """An element, with its mark and what its tag and names are worth."""
    mark = "tag" if tag in LEFT_OUT or tag == "header" and not parent.inside else ""
    if tag in ("form", "fieldset"):
        mark = "form"
    points = float(TAG_POINTS.get(tag, 0))
    core = tag in ("article", "main")
    favoured = False
    if source.strip():
        a = _attributes(source)
        role = a.get("role", "").strip().lower()
        names = [_words(x) for k in ("class", "id") for x in a.get(k, "").split()]
        core = core or role in ("main", "article") or "articlebody" in a.get("itemprop", "").lower()
        favoured = any(FAVOURED.intersection(w) and all(x in FAVOURED or x in NEUTRAL for x in w) for w in names)
        if tag not in ("body", "html") and not mark:
            said = _named(names, parent.inside)
            if tag in PARAGRAPHS and parent.inside and said != "advert" or tag == "header":
                said = ""
            if core and role not in ("main", "article") and tag != "article":
                said = ""
            if role in ROLES and not core:
                said = "form" if role == "form" else "named"
            if said == "weak":
                points -= 10
            else:
                mark = said
        style = a.get("style", "").replace(" ", "").lower()
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
            mark = "hidden"
        if favoured:
            points += 15
        if role in ("main", "article") or "articlebody" in a.get("itemprop", "").lower():
            points += 25
    return Node(tag, parent, mark, points, core, favoured)


def parse(page: str) -> Node:
    root = Node("#", None)
    top, at = root, 0
    never_closed: set[str] = set()  # raw elements without a further end tag
    open_tags: Counter[str] = Counter()  # so that no search for a tag that isn't open starts

    def leave(to: Node) -> None:
        nonlocal top
        while top is not to:
            open_tags[top.tag] -= 1
            top = top.parent

    for m in TAG.finditer(page):
        if m.start() < at:
            continue  # inside raw text
        if m.start() > at:
            top.parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = top if open_tags[tag] else None
            while node is not None and node.tag != tag:
                if node.tag in ("td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    node = None
                    break
                node = node.parent
            if node is not None:
                leave(node.parent)
            elif tag in BLOCK:
                top.parts.append(Node(tag, top))  # still ends a block
            continue
        if open_tags["head"] and tag not in IN_HEAD and tag not in ("html", "head"):  # the body has begun
            node = top
            while node.tag != "head":
                node = node.parent
            leave(node.parent)
        if tag in RAW:
            if tag in TEXT_ONLY or tag not in never_closed and not m[3].rstrip().endswith("/"):
                end = None if tag in never_closed else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                if end is None:
                    never_closed.add(tag)
                at = end.end() if end else len(page) if tag in TEXT_ONLY else at
            continue
        if tag in BLOCK:  # closes an open paragraph
            node = top if open_tags["p"] else None
            while node is not None and node.tag != "p":
                node = None if node.tag in BLOCK else node.parent
            if node is not None:
                leave(node.parent)
        if tag in CLOSES and any(open_tags[x] for x in CLOSES[tag]):
            node, found = top, None
            while node is not None and node.tag not in BOUND[tag]:
                if node.tag in CLOSES[tag]:
                    found = node
                node = node.parent
            if found is not None:
                leave(found.parent)
        if tag in HEADINGS and top.tag in HEADINGS:
            leave(top.parent)
        node = _start(tag, m[3], top)
        top.parts.append(node)
        if tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK):
            top = node
            open_tags[tag] += 1
    if at < len(page):
        top.parts.append(page[at:])
    return root


def _order(root: Node) -> list[Node]:
    """All elements in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.parts) if not isinstance(c, str)]
    return order


def _own(node: Node) -> int:
    return sum(len(" ".join(c.split())) for c in node.parts if isinstance(c, str))


def _settle(order: list[Node]) -> None:
    """Lift marks that would take the article with them, and fill in what is left out."""
    free: dict[int, int] = {}  # characters below, without those in marked elements below
    headed: dict[int, bool] = {}  # whether a headline or a favoured name is below, likewise
    for node in reversed(order):
        below = [c for c in node.parts if not isinstance(c, str) and not c.mark]
        free[id(node)] = _own(node) + sum(free[id(c)] for c in below)
        headed[id(node)] = any(c.tag == "h1" or c.favoured or headed[id(c)] for c in below)
    fill(order)
    cores = [n for n in order if n.core and n.mark != "hidden" and free[id(n)]]
    outside = free[id(order[0])]
    main = max((n for n in cores if not n.mark or all(c.mark for c in cores)), key=lambda n: free[id(n)], default=None)  # of equal ones the first
    if main is not None and all(n.out for n in cores) and free[id(main)] > outside:
        while main is not None:
            main.mark = ""
            main = main.parent
    elif all(n.out for n in cores):
        for node in order:  # ancestors come first, so a lifted mark shows the ones below
            if node.mark in ("form", "named") and not (node.parent is not None and node.parent.out):
                n = free[id(node)]
                if n > outside if node.mark == "form" else n > WRAPPED * outside and headed[id(node)]:
                    node.mark = ""
                    outside += n
            node.out = bool(node.mark) or node.parent is not None and node.parent.out
    fill(order)


def fill(order: list[Node]) -> None:
    """An element is left out if it or an ancestor is marked."""
    for node in order:
        node.out = bool(node.mark) or node.parent is not None and node.parent.out


def _measure(order: list[Node]) -> None:
    """Fill in lengths without what is left out."""
    for node in reversed(order):
        below = [c for c in node.parts if not isinstance(c, str) and not c.out]
        node.length = _own(node) + sum(c.length for c in below)
        node.linked = node.length if node.tag == "a" else sum(c.linked for c in below)


def _paragraph(node: Node) -> str:
    """The text of an element and of its inline elements."""
    texts, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            texts.append(x)
        elif x is node or x.tag not in BLOCK and not x.out:
            stack += reversed(x.parts)
    return "".join(texts)


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _score(order: list[Node]) -> None:
    """Paragraphs' points for containers: all to the nearest block, half as much at each further one."""
    for node in reversed(order):
        if node.out or node.tag == "#":
            continue
        up = node.parent
        if node.tag not in BLOCK:
            if up is not None and node.given:
                up.given += node.given
                up.scored = up.scored or node.scored and up.tag in BLOCK
            continue
        earned = 0.0
        text = _paragraph(node).strip()
        if text:
            earned = (1 + len(COMMAS.findall(text)) + min(len(text) // 100, 3)) * (1 - _density(node))
            if node.tag in ("article", "main", "section", "div", "td", "body"):  # counts for itself first
                node.given += earned
                node.scored, earned = True, 0.0
        node.points += node.given
        node.scored = node.scored or node.given > 0
        if up is not None and (earned or node.given):
            up.given += earned + node.given / 2


def best_nodes(root: Node) -> list[Node]:
    """The best container with its kept siblings, in page order."""
    order = _order(root)
    _settle(order)
    _measure(order)
    _score(order)
    found = [n for n in order if n.scored and not n.out]
    if not found:
        return [root]
    value: dict[int, float] = {id(n): n.points * (1 - _density(n)) for n in found}
    best = max(found, key=lambda n: value[id(n)])  # of equal ones the first
    if best.tag in ("p", "li", "pre") or best.parent is None:
        best = best.parent or best
    while best.inside and not best.core:  # the whole article
        best = best.parent
    if best.core or best.tag in ("article", "main", "body", "html", "#"):
        level = [best]
    else:
        level = []
        least = max(10.0, SIBLING_SHARE * value.get(id(best), 0.0))
        for c in best.parent.parts:
            if isinstance(c, str) or c.out:
                continue
            if c is best or value.get(id(c), 0.0) >= least or c.tag in HEADINGS or c.tag == "p" and c.length and _density(c) < 0.25:
                level.append(c)
    if best.tag == "article":  # an article in several parts
        others = [n for n in order if n.tag == "article" and n.parent is best.parent and not n.out]
        level = [n for n in others if n is best or value.get(id(n), 0.0) >= SIBLING_SHARE * value[id(best)]]
    return level


def _blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join(references.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    loose = any(n.tag in ("#", "html", "body") for n in nodes)  # no container of its own: menus may lie anywhere
    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.out:
            if x.tag in BLOCK:
                end()
        elif x.tag in ("ul", "ol", "dl") and loose and not x.inside and x.length and _density(x) > LINK_LIST:
            end()
        elif x.tag == "br":
            run.append(" ")
        elif x.tag in BLOCK or x.tag == "#":
            end()
            stack.append(None)
            stack += reversed(x.parts)
        else:
            stack += reversed(x.parts)
    end()
    return out


def main_text(page: str | None) -> str:
    if not page or not page.strip():
        return ""
    return "\n\n".join(_blocks(best_nodes(parse(page))))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = df.select(df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").alias("url"), F.coalesce(df[html_col].cast("string"), F.lit("")).alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
