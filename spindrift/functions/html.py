"""HTML as a small tree: text, main content, boilerplate, and sections of blocks under headings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements without an end tag, and what counts as boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav aside footer header".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo".split())
BOILERPLATE_LABELS = ("breadcrumb", "navigation")
BOILERPLATE_CLASSES = frozenset("edit-on-github copy-button toc table-of-contents nav navbar sidebar footer header".split())
BOILERPLATE_CLASS_PARTS = {"button": "copy", "a": "edit"}
NO_TEXT = frozenset("script style nav footer header".split())
HEADINGS = {f"h{n}": n for n in range(1, 7)}
BLOCKS = frozenset("p div ul ol dl blockquote".split())


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # of Node and str

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, wanted: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if wanted(n)), None)

    def texts(self, skip: frozenset[str] = frozenset()) -> Iterator[str]:
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                if node.strip():
                    yield node.strip()
            elif node.tag not in skip:
                stack += reversed(node.children)

    def text(self, joint: str = " ", skip: frozenset[str] = frozenset()) -> str:
        return joint.join(self.texts(skip))

    def raw(self) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return "".join(out)

    def prune(self, unwanted: Callable[[Node], bool]) -> None:
        for node in self.walk():
            node.children = [c for c in node.children if isinstance(c, str) or not unwanted(c)]


class _Builder(HTMLParser):
    """An end tag closes the nearest open element of its name, with what is open inside; without one it counts for nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Node("#document")]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


class Rejected(ValueError):
    """A page that the parser gives up on."""


def parse(html: str | None) -> Node:
    builder = _Builder()
    try:
        builder.feed(html or "")
        builder.close()
    except AssertionError as broken:  # a declaration that is none
        raise Rejected(str(broken)) from broken
    return builder.open[0]


def is_boilerplate(node: Node) -> bool:
    own, part = node.attrs.get("class", ""), BOILERPLATE_CLASS_PARTS.get(node.tag)
    named = node.tag in BOILERPLATE_TAGS or node.attrs.get("role") in BOILERPLATE_ROLES
    labelled = any(label in node.attrs.get("aria-label", "") for label in BOILERPLATE_LABELS)
    return named or labelled or not BOILERPLATE_CLASSES.isdisjoint(own.split()) or (part is not None and part in own)


def page_text(html: str | None) -> str:
    """Text without scripts, styles, navigation, header and footer, its white space single blanks."""
    return " ".join(parse(html).text(skip=NO_TEXT).split())


def main_content(html: str | None, least: int = 100) -> tuple[str, str]:
    """(where found, text) of a page's main content: the page without boilerplate if its text is long enough, else its
    documentation block, article or main element, else all of it."""
    root = parse(html)
    places = (("mdx", lambda n: n.tag == "div" and "mdxcontent" in n.attrs.get("class", "").lower()), ("article", lambda n: n.tag == "article"), ("main", lambda n: n.tag == "main"))
    found = [(name, node.text()) for name, wanted in places if (node := root.find(wanted)) is not None]
    whole = root.text()
    root.prune(is_boilerplate)
    body = root.text()
    return ("body", body) if len(body) >= least else next(((n, t) for n, t in found if t), ("page", whole))


@dataclass
class Section:
    """What stands under one heading: its path of (level, text, id), and blocks of (kind, text)."""

    path: list[tuple[int, str, str]]
    blocks: list[tuple[str, str]] = field(default_factory=list)

    @property
    def headings(self) -> list[str]:
        return [text for _, text, _ in self.path]


def sections(html: str | None, slug: Callable[[str], str], repeat_nested: bool = False) -> list[Section]:
    """Sections of a page in order, boilerplate left out; before the first heading the root section.

    A block's text counts once; with ``repeat_nested`` an outer block's text stands before those of the blocks in it, and
    each piece of text after them once more."""
    root = parse(html)
    root.prune(is_boilerplate)
    out = [Section([])]

    # whether a block or heading lies in a node; descendants come first
    holds: dict[int, bool] = {}
    for node in reversed(list(root.walk())):
        holds[id(node)] = any(holds[id(c)] or c.tag in BLOCKS or c.tag in HEADINGS or c.tag in ("pre", "table") for c in node.children if isinstance(c, Node))

    # a stack of its own, as pages nest deeper than Python's
    open_nodes = [(iter((root.find(lambda n: n.tag == "body") or root).children), False)]
    while open_nodes:
        children, inside = open_nodes[-1]
        child = next(children, None)
        if child is None:
            open_nodes.pop()
        elif isinstance(child, str):
            if child.strip() and (repeat_nested or not inside):
                out[-1].blocks.append(("text", child.strip()))
        elif child.tag in HEADINGS:
            level, text = HEADINGS[child.tag], child.text()
            path = [p for p in out[-1].path if p[0] < level]
            out.append(Section([*path, (level, text, child.attrs.get("id") or slug(text))]))
        elif child.tag == "pre":
            code = child.find(lambda n: n.tag == "code")
            classes = ((code or child).attrs.get("class") or child.attrs.get("class", "")).split()
            out[-1].blocks.append(("code", f"```{classes[0].removeprefix('language-') if classes else ''}\n{child.raw().strip()}\n```"))
        elif child.tag == "table":
            out[-1].blocks.append(("table", child.text()))
        elif child.tag not in BLOCKS:
            open_nodes.append((iter(child.children), inside))
        elif not repeat_nested and holds[id(child)]:
            open_nodes.append((iter(child.children), False))
        else:
            if text := child.text():
                out[-1].blocks.append(("text", text))
            if repeat_nested:
                open_nodes.append((iter(child.children), True))
    return [s for s in out if s.blocks or s.path]
