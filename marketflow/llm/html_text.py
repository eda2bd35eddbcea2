"""A tolerant HTML reader: elements with implied end tags, blocks of text, and template roles."""

from __future__ import annotations

import html
import re

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(\bhidden\b)""")
_NAME = re.compile(r"[a-z]+")

# The element classes of HTML.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html",
          "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody",
          "td", "tfoot", "th", "thead", "title", "tr", "ul"}
CONTAINERS = {"article", "body", "center", "div", "html", "main", "section", "table", "tbody", "td", "tr"}
_ENDS_P = BLOCKS - {"body", "caption", "dd", "dt", "head", "html", "legend", "li", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}
#: An open element that a start tag ends, and the elements beyond which it does not look.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"})}
_SCOPE = {"td", "th", "table", "button", "object", "html", "body", "caption"}

# Elements that hold no main text, and whole class names (and ids) that say the same of a container.
SKIPPED = {"aside", "button", "canvas", "dialog", "footer", "form", "head", "iframe", "input", "nav", "noscript", "object",
           "script", "select", "style", "svg", "template", "textarea", "title", "audio", "video", "option"}
ROLES = {"ad", "ads", "ad-slot", "ad-banner", "adsbygoogle", "adsense", "advert", "advertisement", "advertising", "adverts", "alert", "banner",
         "breadcrumb", "breadcrumbs", "comment", "comments", "comment-list", "commentlist", "comments-area", "post-comments", "complementary",
         "consent", "contentinfo", "cookie", "cookies", "cookie-banner", "cookie-consent", "cookie-notice", "dialog", "disqus", "disqus_thread",
         "footer", "site-footer", "page-footer", "gdpr", "login", "masthead", "menu", "main-menu", "modal", "nav", "main-nav", "site-nav", "navbar",
         "navigation", "newsletter", "notice", "notices", "overlay", "pagination", "popup", "promo", "promoted", "promotion", "related",
         "related-posts", "replies", "reply", "respond", "search", "search-form", "share", "share-buttons", "sharing", "sidebar", "site-header",
         "signup", "skip", "skip-link", "social", "social-share", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget"}
#: Of these, ids that count inside an article too; other ids there are anchors of its sections.
_IDS_INSIDE = {"comments", "respond", "disqus_thread"}
#: Outside of articles a compound name says what its last word says ("top-banner"), unless it begins with one of these.
_MODIFIERS = {"has", "is", "no", "not", "with", "without"}
#: Elements that such a name may take out: never headings, paragraphs, table cells or list items by their class.
_NAMED = {"center", "details", "div", "dl", "fieldset", "figure", "menu", "ol", "section", "span", "table", "ul"}


class Node:
    """``skip``: hidden, or an element without main text.  ``role``: a container whose whole class, id or role says menu,
    advert, comment or the like.  ``name``: words of its classes."""

    __slots__ = ("tag", "name", "skip", "role", "compound", "at", "links", "kids", "slot")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.name, self.skip, self.role, self.at, self.links, self.kids, self.slot = tag, "", tag in SKIPPED, False, "", False, [], -1
        self.compound = False
        if "=" in attrs or "hidden" in attrs:
            whole, words = set(), []
            for key, a, b, c, bare in _ATTR.findall(attrs):
                key, value = key.lower(), (a or b or c).lower()
                if key in ("class", "role"):
                    whole.update(value.split())
                    words += _NAME.findall(value)
                if key == "id":
                    self.at = value.strip()
                if bare or key == "hidden" or key == "aria-hidden" and value == "true" or \
                        key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    self.skip = True
            self.name = ".".join(words)
            self.role = tag in _NAMED and not ROLES.isdisjoint(whole)
            self.compound = tag in _NAMED and any(p[-1] in ROLES and p[0] not in _MODIFIERS for p in (re.split("[-_]+", w) for w in whole))


def _open(stack: list[Node], tags: set[str], beyond: set[str]) -> int:
    """Place of the innermost open element of ``tags`` within ``beyond``, or 0."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            return i
        if stack[i].tag in beyond:
            return 0
    return 0


def parse(page: str | None) -> Node:
    """The tree of a page; character references in text are decoded."""
    root = Node("html")
    stack, text, at = [root], page or "", 0

    def say(s: str) -> None:
        if s:
            stack[-1].kids.append(html.unescape(s))

    while True:
        m = _TAG.search(text, at)
        if m is None:
            say(text[at:])
            return root
        say(text[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if not i or tag == "body":
                continue
            if tag in BLOCKS:
                del stack[i:]
            elif not any(n.tag in BLOCKS for n in stack[i + 1:]):
                del stack[i:]
            else:
                del stack[i]  # an inline end tag does not end the blocks inside it
            continue
        if tag in ("html", "body") and _open(stack, {tag}, set()):
            continue
        if tag == "html":
            continue
        if tag in _ENDS_P and (i := _open(stack, {"p"}, _SCOPE)):
            del stack[i:]
        if tag in _ENDS and (i := _open(stack, *_ENDS[tag])):
            del stack[i:]
        if tag == "body" and (i := _open(stack, {"head"}, set())):
            del stack[i:]
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(text, at)
            if tag not in ("script", "style"):
                node.kids.append(html.unescape(text[at:end.start() if end else len(text)]))
            at = end.end() if end else len(text)
        elif tag not in VOID:
            stack.append(node)


def drop_roles(root: Node) -> Node:
    """Settle ``skip``, ``role`` and ``links``.

    Headers outside an article are skipped; ids and compound names make a role outside an article, and a few ids inside.  What holds the main
    element, or the first article of a page without one, has no role.  Lists and containers made of links get ``links``.
    """
    todo, order = [(root, -1, False)], []
    while todo:  # order: (node, place of its parent, inside an article)
        node, parent, inside = todo.pop()
        if node.tag == "header" and not inside:
            node.skip = True
        if node.tag in _NAMED and (node.at in _IDS_INSIDE or not inside and (node.at in ROLES or node.compound or "header" in node.name.split("."))):
            node.role = True
        if node.skip:
            continue
        order.append((node, parent))
        here = len(order) - 1
        inside = inside or node.tag in ("article", "main")
        todo += [(kid, here, inside) for kid in reversed(node.kids) if not isinstance(kid, str)]
    for tag in ("main", "article"):
        if at := next((i for i, (node, _) in enumerate(order) if node.tag == tag), 0):
            while at >= 0:
                order[at][0].role = False
                at = order[at][1]
            break
    chars, linked = [0] * len(order), [0] * len(order)
    for i in range(len(order) - 1, -1, -1):
        node, parent = order[i]
        chars[i] += sum(len(kid.strip()) for kid in node.kids if isinstance(kid, str))
        if node.tag == "a":
            linked[i] = chars[i]
        if node.tag in ("ul", "ol", "menu", "table", "div", "section") and chars[i] and linked[i] > 0.7 * chars[i]:
            node.links = True
        elif parent >= 0:
            chars[parent] += chars[i]
            linked[parent] += linked[i]
    return root


def blocks(root: Node, wanted) -> list[str]:
    """Texts of the blocks in page order, white space collapsed; ``wanted(node)`` says whose own text counts."""
    out, now = [], []

    def flush() -> None:
        s = " ".join("".join(now).split())
        if s:
            out.append(s)
        now.clear()

    todo = [(root, 0, wanted(root))]
    while todo:
        node, i, want = todo.pop()
        if i == 0 and node.tag in BLOCKS:
            flush()
        if i < len(node.kids):
            todo.append((node, i + 1, want))
            kid = node.kids[i]
            if isinstance(kid, str):
                if want:
                    now.append(kid)
            elif not kid.skip:
                if kid.tag in ("br", "wbr"):
                    now.append(" " if kid.tag == "br" else "")
                else:
                    todo.append((kid, 0, wanted(kid) if kid.tag in BLOCKS else want and not kid.role))
        elif node.tag in BLOCKS:
            flush()
    flush()
    return out
