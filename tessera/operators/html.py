"""A tolerant HTML tree with class, id and attribute selectors, and the main content of a page."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What a start tag ends if it is open: paragraphs, list items, table cells and the like may go without end tags.
ENDS = {
    **dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
    "tr": ("tr", "td", "th", "p"), "tbody": ("thead", "tbody", "tr", "td", "th"), "body": ("head",),
}
#: An implied end doesn't reach beyond these.
SCOPE = frozenset("table ul ol dl select html div section article".split())
#: Elements whose text isn't a page's text.
HIDDEN = frozenset("script style template".split())

#: Where a documentation page has its content, in order of preference, and what is taken out of it.
CONTENT = ["div.body", "div.document", "main", "article"]
REMOVED = [
    "nav", "header.page-header", "footer", "div.sidebar", "div.sphinxsidebar", "div.related", "div.navigation", "script", "style", "noscript",
    ".headerlink", ".viewcode-link", "div.admonition.sphx-glr-download-link-note",
]


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "classes")

    def __init__(self, tag: str, attrs: dict | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent
        self.classes = frozenset((self.attrs.get("class") or "").split())

    def walk(self):
        """This node and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self):
        """Texts below this node in document order, without those of HIDDEN elements."""
        stack = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x is self or x.tag not in HIDDEN:
                stack += reversed(x.children)

    def text(self, separator: str = "", strip: bool = False) -> str:
        found = (s.strip() for s in self.strings()) if strip else self.strings()
        return separator.join(s for s in found if s or not strip)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("")

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag in ("html", "body") and (same := next((n for n in self._open() if n.tag == tag), None)):
            same.attrs = attrs | same.attrs  # a second one only adds attributes
            same.classes = frozenset((same.attrs.get("class") or "").split())
            return
        while (open_ := self._implied(tag)) is not None:
            self.now = open_.parent
        node = Node(tag, attrs, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def _open(self):
        node = self.now
        while node.parent is not None:
            yield node
            node = node.parent

    def _implied(self, tag):
        for node in self._open():
            if node.tag in ENDS.get(tag, ()):
                return node
            if node.tag in SCOPE:
                return None
        return None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.now.tag == tag:
            self.now = self.now.parent

    def handle_endtag(self, tag):
        found = next((n for n in self._open() if n.tag == tag), None)
        if found is not None:  # what was left open inside ends too; an end without a start is ignored
            self.now = found.parent

    def handle_data(self, data):
        self.now.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_PART = re.compile(r"""([\w-]+|\*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*]?=)\s*["']?([^"'\]]*)["']?\s*)?\]""")


def _compound(text: str):
    tests, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if m is None or m[1] and at:
            raise ValueError(f"no such selector: {text}")
        tag, cls, ident, name, op, value = m.groups()
        if cls:
            tests.append(lambda n, c=cls: c in n.classes)
        elif ident:
            tests.append(lambda n, i=ident: n.attrs.get("id") == i)
        elif name:
            how = {
                None: lambda a, v: True, "=": lambda a, v: a == v, "~=": lambda a, v: v in a.split(), "^=": lambda a, v: bool(v) and a.startswith(v),
                "$=": lambda a, v: bool(v) and a.endswith(v), "*=": lambda a, v: bool(v) and v in a,
            }[op]
            tests.append(lambda n, k=name, v=value, f=how: k in n.attrs and f(n.attrs[k], v))
        elif tag != "*":
            tests.append(lambda n, t=tag.lower(): n.tag == t)
        at = m.end()
    return lambda n: bool(n.tag) and all(t(n) for t in tests)


def selector(text: str):
    """A test of nodes for a selector: tags, classes, ids and attributes, descendants by blanks, children by '>', and lists by
    commas."""
    ways = []
    for one in text.split(","):
        parts = one.replace(">", " > ").split()
        if not parts or parts[0] == ">" or parts[-1] == ">":
            raise ValueError(f"no such selector: {text}")
        steps, child = [], False
        for p in parts:
            if p == ">":
                child = True
            else:
                steps.append((_compound(p), child))
                child = False
        ways.append(steps)

    def matches(node, steps) -> bool:
        test, child = steps[-1]
        if not test(node):
            return False
        if len(steps) == 1:
            return True
        up = node.parent
        while up is not None:
            if matches(up, steps[:-1]):
                return True
            if child:
                return False
            up = up.parent
        return False

    return lambda node: any(matches(node, steps) for steps in ways)


def select(root: Node, text: str) -> list[Node]:
    test = selector(text)
    return [n for n in root.walk() if test(n)]


def first(root: Node, text: str) -> Node | None:
    test = selector(text)
    return next((n for n in root.walk() if test(n)), None)


def cleaned(text: str) -> str:
    return re.sub(r"\n\n+", "\n\n", re.sub(r" +", " ", text)).strip()


def page(html: str | None, site: str | None = None, content=CONTENT, removed=REMOVED, longest: int = 200) -> tuple[str, str, list[str]]:
    """(title, content, sections). The title is the first h1, wherever it is, or else the title element without ' — site' or
    ' | site' and what follows. Then what ``removed`` selects goes; the content is the text of the first element that a selector of
    ``content`` finds, in their order, or of the body; sections are the h1 to h3 that are left and shorter than ``longest``."""
    root = parse(html)
    head, name = first(root, "h1"), first(root, "title")
    title = "Untitled Document"
    if head is not None:
        title = cleaned(head.text())
    elif name is not None:
        title = name.text()
        if site:
            title = re.sub(rf"\s*[—|]\s*{re.escape(site)}.*$", "", title, flags=re.IGNORECASE)
        title = cleaned(title)
    for s in removed:
        for node in select(root, s):
            node.remove()
    main = next((n for s in content if (n := first(root, s)) is not None), None) or first(root, "body")
    if main is None:  # neither is written out: all but the head
        for node in select(root, "head, title, meta, link"):
            node.remove()
        main = root
    sections = [cleaned(n.text()) for n in select(root, "h1, h2, h3")]
    return title, cleaned(main.text(" ", strip=True)), [s for s in sections if 0 < len(s) < longest]
