"""One web page as a tree of text blocks, for wrapper inference and extraction."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
# Elements whose text does not count; they end with their end tag or with the element around them.
HIDDEN = frozenset("noscript template svg select button object annotation annotation-xml".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements that a new one of the same family ends, and where the search for it stops.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
# Deeper elements count as their ancestor at this level; no text is lost.
DEPTH = 120

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>",
    re.S,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"\d+")
# Signs that labels and paths use themselves.
_SIGNS = str.maketrans({">": None, ".": "_", "#": "_"})


def label(tag: str, attributes: str) -> str:
    """Return an element's label: its tag with the words of class, id and role, without digits."""
    if not attributes or "=" not in attributes:
        return tag
    words = []
    for name, *values in _NAMED.findall(attributes):
        plain = _DIGITS.sub("", "".join(values)).lower().translate(_SIGNS)
        words += [("#" if name.lower() == "id" else ".") + word for word in plain.split()]
    return tag + "".join(sorted(words))


class Element:
    """An open element: its label, the path of labels to it, its children so far, and whether text is below it."""

    __slots__ = ("children", "filled", "label", "path", "tag")

    def __init__(self, tag: str, name: str, path: str) -> None:
        self.tag, self.label, self.path, self.children, self.filled = tag, name, path, [], False


def blocks(page: str) -> tuple[Element, list[tuple[tuple[int, int], str, int]]]:
    """Return the tree of a page and its blocks: (place, text, characters inside links), in page order.

    A place is the identity of an element's list of children and the index in it.

    Scripts, styles and form fields have no text. Unclosed and stray tags
    are read as browsers do: a paragraph ends where the next block begins.
    """
    root = Element("", "", "")
    stack = [root]
    found: list[tuple[tuple[int, int], str, int]] = []
    parts: list[str] = []
    linked = 0
    in_link = False
    hidden: list[tuple[str, int]] = []  # open elements without text, and how many elements were open then

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                if stack[-1].tag == "head":  # a text ends the head
                    stack.pop()
                here = stack[-1]
                if not here.children or here.children[-1] != "#":
                    here.children.append("#")
                for element in reversed(stack):
                    if element.filled:
                        break
                    element.filled = True
                found.append(((id(here.children), len(here.children) - 1), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(tags: set[str] | frozenset[str], stop: set[str]) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in tags:
                del stack[at:]
                return
            if stack[at].tag in stop:
                return

    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        end = token.start() if token else size
        if end > at and not hidden:
            piece = page[at:end]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if not token:
            break
        at = token.end()
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            continue
        closing = bool(token[1] or token[4])
        if tag in RAW:
            if not closing and not (token[3] or token[6] or "").endswith("/"):
                ended = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = ended.end() if ended else size
            continue
        if tag in HIDDEN:
            if not closing:
                if not (token[3] or token[6] or "").endswith("/"):
                    hidden.append((tag, len(stack)))
            elif any(name == tag for name, _ in hidden):
                while hidden:
                    name, depth = hidden.pop()
                    del stack[depth:]
                    if name == tag:
                        break
        elif tag == "br" or tag == "hr":
            parts.append("\n")
        elif tag == "a":
            in_link = not closing
        elif tag in BLOCKS:
            flush()
            in_link = False
            if closing:
                close({tag}, set())
                while hidden and len(stack) < hidden[-1][1]:
                    hidden.pop()
            else:
                if stack[-1].tag == "head":  # what cannot stand in the head ends it
                    stack.pop()
                if any(element.tag == "p" for element in stack[-3:]) and tag not in ("td", "th"):
                    close({"p"}, {"div", "article", "section", "td", "li", "body"})
                if tag in _ENDS:
                    close(*_ENDS[tag])
                name = label(tag, token[3] or token[6] or "")
                above = stack[-1]
                if len(stack) < DEPTH:
                    opened = Element(tag, name, f"{above.path}>{name}")
                    above.children.append(opened)
                else:
                    opened = Element(tag, above.label, above.path)
                    opened.children = above.children
                stack.append(opened)
    flush()
    return root, found


def words_of(path: str) -> Iterator[list[str]]:
    """Return the tag and the whole class words of each element on a path."""
    for element in path.split(">")[1:]:
        yield re.split(r"[.#]", element)
