"""A small, forgiving HTML reader: tokens, and trees of blocks."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Elements without an end, elements whose text is not markup, and elements that stand in a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
# The elements that an opening tag ends, and those that such an end cannot cross.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
FENCES = frozenset("ul ol dl table select html body article section div nav aside header footer main form blockquote figure".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?/]?(?:[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*|[!?/][^>]*)>", re.DOTALL)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")


def attributes(tag: str) -> dict[str, str]:
    """Attributes of an opening tag; the first of a name counts."""
    start = NAME.match(tag)
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(tag, start.end() if start else 1, len(tag) - 1):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def tokens(text: str):
    """Pairs of a kind and a value: text with character references left in it, open with the whole tag, close with a name; comments and declarations are left out."""
    at = 0
    while at < len(text):
        m = TOKEN.search(text, at)
        if not m:
            yield "text", text[at:]
            return
        if m.start() > at:
            yield "text", text[at : m.start()]
        at, tag = m.end(), m[0]
        if tag[1] in "!?":
            continue
        name = NAME.match(tag)
        if not name:
            continue
        if tag[1] == "/":
            yield "close", name[1].lower()
            continue
        yield "open", tag
        low = name[1].lower()
        if low in RAW and not tag.endswith("/>"):
            end = re.compile(rf"</{low}(?=[\s/>])[^>]*>", re.IGNORECASE).search(text, at)
            stop = end.start() if end else len(text)
            if stop > at:
                yield "raw", text[at:stop]
            yield "close", low
            at = end.end() if end else len(text)


@dataclass(slots=True)
class Node:
    """An element, or a text if tag is empty. key tells elements apart for alignment."""

    tag: str
    key: str = ""
    text: str = ""
    hints: str = ""
    children: list["Node"] = field(default_factory=list)


def parse(text: str) -> Node:
    """The tree of a page. Elements that are not closed end where their parent does or where the next of their kind begins."""
    root = Node("#root", "#root")
    stack = [root]
    open_: Counter[str] = Counter()  # elements on the stack by name, so that an end without a beginning is seen at once

    def cut(k: int) -> None:
        open_.subtract(x.tag for x in stack[k:])
        del stack[k:]

    for kind, value in tokens(text):
        if kind == "text":
            stack[-1].children.append(Node("", "#text", value))
        elif kind == "raw":
            stack[-1].children.append(Node("", "#raw", value))
        elif kind == "close":
            for k in range(len(stack) - 1, 0, -1) if open_[value] else ():
                if stack[k].tag == value:
                    cut(k)
                    break
                if stack[k].tag in FENCES and value in INLINE:
                    break
        else:
            name = NAME.match(value)[1].lower()
            found = attributes(value) if "=" in value or " " in value else {}
            hints = " ".join([found.get("class", ""), found.get("id", ""), found.get("role", "")]).strip().lower()
            if name in ENDS_P or name in CLOSES:
                ends = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
                for k in range(len(stack) - 1, 0, -1) if any(open_[x] for x in ends) else ():
                    if stack[k].tag in ends:
                        cut(k)
                        break
                    if stack[k].tag in FENCES:
                        break
            node = Node(name, f"{name}.{hints}" if hints else name, "", hints)
            if name == "img":
                node.text = found.get("src", "")
            stack[-1].children.append(node)
            if name not in VOID and not value.endswith("/>"):
                stack.append(node)
                open_[name] += 1
    return root
