"""Main text of HTML pages by tree scoring."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is never part of an article.
_NEVER = frozenset("script style noscript template head title svg math iframe object canvas audio video button select textarea input nav footer aside menu dialog".split())
#: An open element of these kinds ends when one of the given kinds begins.
_ENDS = {"p": _BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
#: Parts of class names and ids that name page furniture, and those of them that do so after any other word.
_FURNITURE = frozenset("nav navbar navigation menu menus sidebar sidebars side footer footers header headers masthead breadcrumb breadcrumbs ad ads advert adverts advertisement advertising banner banners promo promos promotion sponsor sponsored cookie cookies consent gdpr notice notices popup popups modal overlay newsletter subscribe subscription sharing share social related recommended recommendations recommend comment comments replies respond responses disqus widget widgets login signup signin toolbar pagination pager skip".split())
_NOUNS = _FURNITURE - frozenset("side share sharing related social notice notices recommended recommend sponsor sponsored promotion skip comment respond subscription header headers".split())
#: Of these, names of what is no article at any length, unless it holds most of the page.
_STRICT = frozenset("nav navbar navigation menu menus footer footers breadcrumb breadcrumbs cookie cookies consent gdpr popup popups modal overlay newsletter subscribe comments replies respond disqus login signup signin toolbar pagination pager skip".split())
#: Of these, names of readers' comments.
_COMMENTS = frozenset("comment comments replies respond responses disqus".split())
#: Parts that say nothing of what an element holds.
_NEUTRAL = frozenset("a area article articles bar bars block blocks bottom box boxes btn bottom button buttons center col column container content entry floating form global group holder icon icons inline inner item items l layer left link links list lists main mobile module more of outer page panel post posts primary r right row secondary section site sites slot small stories sticky tertiary text the to top unit up us wp wrap wrapper google in log sign".split())
#: A heading that begins the readers' part of a page.
_READERS = re.compile(r"\W*(?:\d+\s+)?(?:(?:reader|readers|user)\S*\s+)?(?:comments?|responses?|replies|discussion|join the (?:discussion|conversation)|leave a (?:reply|comment)|post a comment)\b\W*(?:\(?\d+\)?\W*)?", re.I)
#: Words on the layout around an element, not on its own kind.
_LAYOUT = re.compile(r"(?<![^\s_-])(?:no|without|has|with)[_-]\w+", re.I)
#: So many characters outside links, at a link density up to DENSE, are text whatever the name.
LONG, DENSE = 200, 1 / 3
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Elements nested deeper than this are laid flat; their texts and breaks stay.
DEPTH = 300
_SCORED = frozenset("p pre td blockquote div section article main li h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("attrs", "chars", "children", "depth", "links", "named", "paras", "parent", "score", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []
        self.score = 0.0
        self.chars = self.links = self.paras = 0
        self.named = False


class Tree(HTMLParser):
    """A lenient tree: unknown end tags are ignored, open elements end with their parents or at the end of the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)
        self.flat: Counter[str] = Counter()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        self._make_room(tag)
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag in _VOID:
            return
        if node.depth > DEPTH and tag not in _NEVER:
            self.flat[tag] += 1
        else:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.at.tag in ("script", "style") and self.at.tag == tag:
            self.handle_endtag(tag)

    def _make_room(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.parent is not None:
            if tag in _ENDS.get(node.tag, ()):
                self.at = node.parent
                if node.tag == "p" or node.tag == tag:
                    return
            elif node.tag in _BLOCK and (node.tag in _SCOPE.get(tag, ()) or node.tag not in _ENDS):
                return
            node = node.parent

    def handle_endtag(self, tag: str) -> None:
        if self.flat[tag]:
            self.flat[tag] -= 1
            if tag in _BLOCK:
                self.at.children.append(Node("hr", {}, self.at))
            return
        node: Node | None = self.at
        while node is not None and node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            if tag not in _BLOCK and node.tag in _BLOCK:
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def unknown_decl(self, data: str) -> None:
        pass


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _hidden(node: Node) -> bool:
    attrs = node.attrs
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in _BAD_ROLE:
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or "", re.I))


def _furniture(node: Node) -> str:
    """'readers', 'strict' or 'named' for an element whose class or id names comments or other page furniture, else ''.

    A class counts if all of its parts name furniture or say nothing (related-posts), or if its last part is such a noun
    (acme-footer); related-work or share-price count as words of the article.
    """
    if node.tag in ("article", "main", "body", "header"):
        return ""
    found = ""
    for name in _LAYOUT.sub("", f"{node.attrs.get('class') or ''} {node.attrs.get('id') or ''}").lower().split():
        parts = [p for p in re.split(r"[\W_\d]+", name) if p]
        if not parts or not (any(p in _FURNITURE for p in parts) and all(p in _FURNITURE or p in _NEUTRAL for p in parts) or parts[-1] in _NOUNS):
            continue
        if any(p in _COMMENTS for p in parts):
            return "readers"
        if any(p in _STRICT for p in parts):
            return "strict"
        found = "named"
    return found


def _sizes(node: Node) -> None:
    """Characters below the node, those in links, and those of paragraphs, or of own sentences, of low link density."""
    node.chars = node.links = node.paras = own = 0
    last = ""
    for child in node.children:
        if isinstance(child, str):
            own += len(child.strip())
            last = child.strip() or last
        elif child.tag not in _NEVER:
            _sizes(child)
            node.chars += child.chars
            node.links += child.links
            node.paras += child.paras
    node.chars += own
    if node.tag == "a":
        node.links = node.chars
    if node.chars and node.links <= DENSE * node.chars:
        if node.tag in ("p", "pre", "blockquote"):
            node.paras = node.chars
        elif own and node.tag in ("div", "section") and last[-1:] in ".!?…。！？":
            node.paras = max(node.paras, own)


def _gap(node: Node, parent: Node) -> Node:
    return Node("hr" if node.tag in _BLOCK else "span", {}, parent)


def _outside(node: Node) -> tuple[int, int]:
    """Characters of paragraphs below the node that stand in no named element, and those of them in articles."""
    prose, articles = node.paras if node.tag in ("p", "pre", "blockquote") else 0, 0
    named = 0
    for child in node.children:
        if isinstance(child, str) or child.tag in _NEVER or _hidden(child):
            continue
        if _furniture(child):
            named += child.paras
            continue
        p, a = _outside(child)
        prose += p if node.tag not in ("p", "pre", "blockquote") else 0
        articles += p if child.tag in ("article", "main") else a
    # sentences of a div's own count as its paragraph
    below = sum(c.paras for c in node.children if isinstance(c, Node))
    return max(prose, node.paras - max(below, named) if node.paras > below else 0), articles


def drop_named(node: Node, most: int, apart: bool = False, prose: tuple[int, int] | None = None) -> None:
    """Cut off elements by name; what stays although it is named has the name noted, which lowers its score.

    A named element goes whatever its length if an article has paragraphs outside of such elements, or if the page has more of them there
    than the element has text; readers' comments go if there is any paragraph outside.  Without that, as where a name is on the wrapper of
    the text itself, it goes where shortness or links agree.  A part whose first heading speaks of comments goes, unless it has most of
    the page and no article stands beside it; headings of a named header stay.
    """
    prose = prose or _outside(node)
    apart = apart or any(isinstance(c, Node) and c.tag in ("article", "main") and c.chars for c in node.children)
    for k, child in enumerate(node.children):
        if not isinstance(child, Node):
            continue
        kind = _furniture(child)
        plain = child.chars - child.links
        if child.tag in ("section", "div") and (apart or 2 * plain < max(most, 1)) and _READERS.fullmatch(_first_heading(child)):
            node.children[k] = _gap(child, node)
            continue
        if kind:
            beside = prose[1] > 0 or prose[0] > (0 if kind == "readers" else plain)
            if beside or child.links > DENSE * child.chars or plain < LONG or (kind != "named" and 2 * plain < most):
                heads = [c for c in child.children if isinstance(c, Node) and c.tag in ("h1", "h2")] if re.search(r"\b(?:entry|article|post)[-_]header", child.attrs.get("class") or "") else []
                node.children[k] = _gap(child, node)
                node.children[k].children = heads
                continue
            child.named = True
            drop_named(child, most, apart)
            continue
        drop_named(child, most, apart and child.tag not in ("article", "main"), prose)


def _words(node: Node) -> str:
    return "".join(c if isinstance(c, str) else _words(c) for c in node.children)


def _first_heading(node: Node) -> str:
    """The text of a heading that comes before any other text of the node."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                return ""
        elif re.fullmatch("h[1-6]", child.tag):
            return " ".join(_words(child).split())
        elif child.chars:
            return _first_heading(child)
    return ""


def prune(node: Node, most: int, inside: bool = False) -> None:
    """Cut off what is no article by its kind; a header inside an article keeps its headings and standfirst, a form that holds most of the page its texts."""
    kept: list[Node | str] = []
    for child in node.children:
        if isinstance(child, Node):
            wrapper = child.tag == "form" and 2 * (child.chars - child.links) > most and child.paras > 0
            if child.tag in _NEVER or _hidden(child) or (child.tag == "form" and not wrapper):
                if child.tag in _BLOCK:
                    kept.append(Node("hr", {}, node))
                continue
            if child.tag in ("label", "legend", "option", "fieldset") and 2 * child.chars < most:
                continue
            if child.tag == "header":
                if not inside:
                    kept.append(Node("hr", {}, node))
                    continue
                child.children = [c for c in child.children if isinstance(c, Node) and re.fullmatch("h[1-6]|hgroup|div|p", c.tag)]
            prune(child, most, inside or child.tag in ("article", "main"))
        kept.append(child)
    node.children = kept


def _measure(node: Node, best: list[Node], depth: int = 0) -> tuple[int, int, int]:
    """Characters, those in links, and commas below the node; passes points for its own text to its ancestors."""
    own = commas = chars = links = 0
    for child in node.children:
        if isinstance(child, str):
            n = len(child.strip())
            own += n
            chars += n
            commas += child.count(",")
            continue
        c, k, m = _measure(child, best, depth + 1)
        if child.tag == "a":
            k = c
        if child.tag not in _BLOCK:
            own += c
            commas += m
        chars += c
        links += k
    if own and node.tag in _SCORED:
        density = min(1.0, links / chars) if chars else 0.0
        points = (1 + commas + min(own // 100, 3)) * (1 - density)
        share, above = 1.0, node.parent
        if node.tag in ("div", "section", "article", "main"):
            node.score += points
        while above is not None and share > 0.2:
            above.score += points * share
            share /= 2
            above = above.parent
    if node.tag in _BLOCK and node.tag not in ("p", "pre", "li", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "body"):
        node.score *= 1 - (links / chars if chars else 0.0)
        if node.named:
            node.score /= 2
        best.append(node)
    return chars, links, commas


def _blocks(node: Node, out: list[list[str]]) -> None:
    for child in node.children:
        if isinstance(child, str):
            out[-1].append(child)
        elif child.tag == "br":
            out[-1].append(" ")
        elif child.tag in _BLOCK:
            out.append([])
            _blocks(child, out)
            out.append([])
        else:
            _blocks(child, out)


def _widened(top: Node) -> Node:
    """The highest ancestor with a sibling whose paragraphs have a fifth of its own paragraphs' length at least, or the node itself."""
    node = out = top
    while node.parent is not None:
        if any(isinstance(n, Node) and n is not node and not n.named and 5 * n.paras >= node.paras > 0 for n in node.parent.children):
            out = node
        node = node.parent
    return out


def _within(node: Node) -> bool:
    """Whether the node is part of an article."""
    above = node.parent
    while above is not None and above.tag not in ("article", "main"):
        above = above.parent
    return above is not None


def _beside(node: Node, bar: float) -> bool:
    """Whether a sibling of the best container is text of the same kind."""
    if node.named or node.links > DENSE * node.chars:
        return False
    return node.score >= bar or node.paras > 0 or (node.chars > 0 and node.tag in ("ul", "ol", "dl", "table", "figure"))


def main_text(html: str) -> str:
    """The article's text: white space in a block is one space, blocks are joined by a line feed."""
    root = parse(html)
    _sizes(root)
    prune(root, root.chars - root.links)
    _sizes(root)
    drop_named(root, root.chars - root.links)
    _sizes(root)
    candidates: list[Node] = []
    _measure(root, candidates)
    top = max(candidates, key=lambda n: n.score, default=None)
    outer = [n for n in candidates if n.tag in ("article", "main") and n.chars and not _within(n)]
    if top is not None and len(outer) == 1 and not _within(top) and (5 * outer[0].score >= top.score or outer[0].paras):
        top = outer[0]  # a page's only article, unless it is a mere teaser
    if top is None or top.score <= 0:
        kept = [root]
    else:
        node: Node | None = top
        while node is not None:  # the whole of the article that holds the best container
            if node.tag in ("article", "main"):
                top = node
            node = node.parent
        bar = max(10.0, 0.2 * top.score)
        if top.tag not in ("article", "main"):
            top = _widened(top)
        around = top.parent.children if top.parent else [top]
        if top.tag in ("article", "main"):
            kept = [n for n in around if n is top or (isinstance(n, Node) and n.tag == "article" and n.score >= bar)]
        else:
            kept = [n for n in around if isinstance(n, Node) and (n is top or _beside(n, bar) or n.tag in ("p", "h1", "h2", "h3", "blockquote", "pre"))]
    out: list[list[str]] = [[]]
    for node in kept:
        out.append([])
        _blocks(node, out)
    lines = (" ".join("".join(block).split()) for block in out)
    return "\n".join(line for line in lines if line)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html = batch[2].to_pylist()
        for a in range(0, len(html), 256):
            texts = [main_text(h or "") for h in html[a : a + 256]]
            part = batch.slice(a, 256)
            yield pa.RecordBatch.from_arrays([part[0], part[1].cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_OUT)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Paragraphs pass points for length and commas to their ancestors, half as much at each step up, discounted by link
    density; the best container, widened to the article that holds it, or else to where siblings hold like paragraphs, and siblings of like
    score or with paragraphs are kept.  A name such as sidebar or share cuts an element off only if it is short or full of links.  Null html is empty; an
    empty page or one without text gives ''; null ids, null urls and repeated rows stay; other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op4_html(pages: DataFrame) -> DataFrame:
    return extract_pages(pages)
