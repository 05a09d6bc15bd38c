"""HTML to a tree of blocks: what both wrapper inference and extraction read.

The parser is lenient: elements are closed by what HTML says closes them, end
tags without a start are skipped, and a page that ends early keeps what it has.
Inline markup disappears; every other element is a node; runs of text between
element borders are text nodes.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.DOTALL,
)
ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen frame basefont bgsound".split())
RAW = frozenset("script style textarea title noembed noframes xmp iframe svg template".split())
#: Elements that never hold article text.
FURNITURE_TAGS = frozenset("nav footer aside form button select option textarea dialog menu noscript script style title iframe svg template object applet canvas audio video map datalist fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Last words of a class or id that mark page furniture: main-menu, site-footer.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox"
    " nav navbar navigation subnav topnav sidenav menu submenu breadcrumb breadcrumbs pagination pager topbar toolbar masthead header footer sidebar side aside rail widget widgets"
    " newsletter subscribe subscription signup login signin register share sharing social related recommended recommendations trending popular"
    " comment comments commentlist disqus respond responses reply replies discussion feedback search skip copyright disclaimer".split()
)
#: First words that mark all that they name: ad-top, comment-body, sidebar-content.
FURNITURE_FIRST = frozenset("ad ads advert advertisement sponsored promo cookie cookies consent newsletter sidebar footer nav navbar menu breadcrumb social share related comment comments disqus popup modal".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond responses reply replies discussion".split())
#: Parts of words written together: cookiebar, pagefooter.
FURNITURE_PARTS = ("sidebar", "footer", "cookie", "newsletter", "breadcrumb", "advert", "navbar", "navigation", "popup")
CONTENT_WORDS = frozenset("content article post entry main story body text".split())
#: Words that say nothing about what is inside.
NEUTRAL_WORDS = frozenset("wrapper wrap container box block area section inner outer bar list item items link links holder group panel unit slot zone row col column".split())
#: First words of a class that tells about a layout: has-sidebar.
STATE_WORDS = frozenset("has with without no not is".split())
ROOT_TAGS = frozenset(("article", "main"))
CLOSED_BY = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table", "thead", "tbody", "tfoot"))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
}
#: Deeper elements become siblings at this depth; they keep their names and what holds them.
TREE_DEPTH = 150
TEXT = "#"
#: What an element is by its tag, role or style, or only by the words of its class and id.
BY_NAME, BY_KIND = 1, 2
HIDDEN = "!"


@dataclass
class Node:
    sig: str
    tag: str = ""
    furniture: int = 0
    children: list[Node] = field(default_factory=list)
    text: str = ""
    link_chars: int = 0


def _kind(name: str) -> str | None:
    """What a class or id says an element is: furniture, comment, content or None."""
    parts = re.sub(r"([a-z])([A-Z])", r"\1 \2", name)
    words = [w.lower() for w in re.split(r"[^A-Za-z]+", parts) if w]
    while len(words) > 1 and words[-1] in NEUTRAL_WORDS:
        words.pop()
    if not words or words[0] in STATE_WORDS:
        return None
    if words[0] in COMMENT_WORDS or words[-1] in COMMENT_WORDS:
        return "comment"
    if words[-1] == "header" and CONTENT_WORDS & set(words[:-1]):
        return None  # the title of an article
    if words[0] in FURNITURE_FIRST or words[-1] in FURNITURE_WORDS or any(x in w for w in words for x in FURNITURE_PARTS):
        return "furniture"
    return "content" if words[-1] in CONTENT_WORDS else None


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTR.finditer(raw)} if raw.strip("/ \t\n\r") else {}


def _by_attributes(attrs: dict[str, str]) -> bool:
    """Hidden, or of a role that is never article."""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.IGNORECASE):
        return True
    return attrs.get("role", "").lower() in FURNITURE_ROLES


def furniture_of(tag: str, attrs: dict[str, str]) -> int:
    """BY_KIND, BY_NAME or 0."""
    if tag in FURNITURE_TAGS:
        return BY_KIND
    if not attrs or tag in ("html", "body"):
        return 0
    if _by_attributes(attrs):
        return BY_KIND
    kinds = {_kind(x) for x in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()}
    if "comment" in kinds:
        return 0 if "content" in kinds else BY_NAME
    return BY_NAME if "furniture" in kinds and "content" not in kinds and tag not in ROOT_TAGS else 0


def is_furniture(tag: str, attrs: dict[str, str]) -> bool:
    return furniture_of(tag, attrs) > 0


def signature(tag: str, attrs: dict[str, str]) -> str:
    """The tag with its class and id, digits removed, and a mark if it is hidden: what
    must agree for two elements to be aligned."""
    label = tag
    for name, mark in (("class", "."), ("id", "#")):
        if value := re.sub(r"\d+", "", attrs.get(name, "")):
            label += "".join(mark + w for w in sorted(set(value.split())))
    return label + HIDDEN if attrs and _by_attributes(attrs) else label


def parse(page: str | None) -> Node:
    """The tree of a page below a root node.

    An element below TREE_DEPTH is a child of its ancestor there: furniture if any
    element between is, and named by the article element between, if there is one."""
    root = Node("", "")
    stack: list[tuple[Node, str]] = [(root, "")]
    opened: Counter[str] = Counter()
    text: list[str] = []
    links = [0, 0]  # open anchors, characters inside anchors
    page = page or ""

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                stack[-1][0].children.append(Node(TEXT, text=joined, link_chars=min(links[1], len(joined))))
            text.clear()
        links[1] = 0

    def add(piece: str) -> None:
        text.append(piece)
        if links[0]:
            links[1] += len(piece.strip())

    def pop_to(k: int) -> None:
        for _, gone in stack[k:]:
            opened[gone] -= 1
        del stack[k:]

    def push(tag: str, attrs: dict[str, str], furniture: int) -> None:
        node = Node(signature(tag, attrs), tag, furniture)
        if len(stack) < TREE_DEPTH:
            stack[-1][0].children.append(node)
        else:
            above = stack[-1][0]
            if len(stack) > TREE_DEPTH:
                node.furniture = max(furniture, above.furniture)
                if above.tag in ROOT_TAGS:
                    node.tag, node.sig = above.tag, f"{above.tag}.{node.sig}" if not node.sig.startswith(above.tag) else node.sig
            stack[TREE_DEPTH - 1][0].children.append(node)
        stack.append((node, tag))
        opened[tag] += 1

    pos, n = 0, len(page)
    while pos < n:
        m = TOKEN.search(page, pos)
        if m is None:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos : m.start()])
        pos = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if tag == "a":
                links[0] = max(0, links[0] - 1)
            if opened[tag] > 0:
                flush()
                pop_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][1] == tag))
            continue
        attrs = _attributes(m["attrs"] or "")
        furniture = furniture_of(tag, attrs)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, pos)
            pos = close.end() if close else n
            continue
        if tag in INLINE and not (furniture and tag not in VOID):
            if tag == "a" and (m["attrs"] or "")[-1:] != "/":
                links[0] += 1
            continue
        if tag in ("html", "head", "body"):
            flush()
            continue
        flush()
        if tag in VOID:
            continue
        if tag not in INLINE:
            if stack[-1][1] == "p":
                pop_to(len(stack) - 1)
            if tag in CLOSED_BY:
                closing, fence = CLOSED_BY[tag]
                if any(opened[x] > 0 for x in closing):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][1] in fence:
                            break
                        if stack[k][1] in closing:
                            pop_to(k)
                            break
        if (m["attrs"] or "")[-1:] == "/":
            continue
        push(tag, attrs, furniture)
    flush()
    return root


def blocks(root: Node):
    """(path, text node) of each text node in page order; path is a tuple of signatures."""
    todo = [(root, ())]
    while todo:
        node, path = todo.pop()
        if node.sig == TEXT:
            yield path, node
            continue
        below = (*path, node.sig) if node.sig else path
        todo += [(c, below) for c in reversed(node.children)]
