"""A forgiving reader of HTML: block elements as a tree in page order, with the text runs that stand in them.

The reader only moves forward, so that its work grows with the page, whatever it holds: a tag is walked once, attribute by
attribute quote; a tag without an end cuts the page off; open elements are found by their names, not by walking up.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

# Elements whose content is no text of the page, block elements, those without an end, implied ends.
RAW = {"script", "style", "textarea", "title", "iframe", "template", "svg"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol",
    "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "button", "option", "caption",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: A start of the key ends an open element of the first set, looked for no further up than one of the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
    "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"tbody"}, {"table"}),
}
_TAG = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STEP = re.compile(r"""[^"'>]*""")
_VALUE = re.compile(r"=\s*\Z")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|data-role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


class _Open:
    """Open elements, with their places on the stack by name."""

    __slots__ = ("stack", "names", "at")

    def __init__(self):
        self.stack, self.names, self.at = [0], ["#"], {}

    def push(self, node: int, name: str) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        self.stack.append(node)
        self.names.append(name)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.stack.pop()
            self.at[self.names.pop()].pop()

    def last(self, names) -> int:
        """The innermost place of one of these names, or 0."""
        return max((own[-1] for n in names if (own := self.at.get(n))), default=0)


class Tree:
    """tag, parent, tokens (words of class, id and role), links (characters inside links) by element; runs: (element, text)."""

    __slots__ = ("tag", "parent", "tokens", "links", "inline", "runs")

    def __init__(self, page: str):
        self.tag, self.parent, self.tokens, self.links, self.inline = ["#"], [-1], [()], [0], [0]
        self.runs: list[tuple[int, str]] = []
        own, pending, in_link = _Open(), [], 0
        at, end = 0, len(page)
        last = {c: page.rfind(c) for c in "\"'>"}

        def flush() -> None:
            if pending:
                text = " ".join(html.unescape("".join(pending)).split())
                pending.clear()
                if text:
                    self.runs.append((own.stack[-1], text))

        def closed(lo: int) -> int:
            """The place behind the end of the tag whose name ends at lo: a quote counts behind =, if it is closed at all; end if it is cut off."""
            if last[">"] < lo:
                return end
            i = lo
            while True:
                j = _STEP.match(page, i).end()
                if j >= end:
                    return page.find(">", lo) + 1
                c = page[j]
                if c == ">":
                    return j + 1
                if last[c] > j and _VALUE.search(page, max(lo, j - 20), j):
                    i = page.find(c, j + 1) + 1
                    if last[">"] < i:  # the tag's end stands inside a quote
                        return page.find(">", lo) + 1
                else:
                    i = j + 1

        while at < end:
            m = _TAG.search(page, at)
            text = page[at : m.start() if m else end]
            if text:
                pending.append(text)
                if in_link:
                    self.links[own.stack[-1]] += len(text)
            if not m:
                break
            if m[1]:
                stop = page.find("-->", m.end())
                at = stop + 3 if stop >= 0 else end
                continue
            at = closed(m.end()) if m[3] else page.find(">", m.end()) + 1 or end
            if not m[3]:
                continue
            if page[at - 1] != ">" or at <= m.end():
                break
            name, is_end, rest = m[3].lower(), bool(m[2]), page[m.end() : at - 1]
            if name in RAW:
                if not is_end and not rest.endswith("/"):
                    stop = _raw_end(name).search(page, at)
                    at = page.find(">", stop.end()) + 1 or end if stop else end
            elif name not in BLOCK:
                if name == "a":
                    in_link = max(0, in_link + (-1 if is_end else 1))
                elif name == "br":
                    pending.append(" ")
                self.inline[own.stack[-1]] += not is_end
            else:
                flush()
                if is_end:
                    if depth := own.last((name,)):
                        own.cut(depth)
                        in_link = 0
                    continue
                if own.names[-1] == "p":  # an open paragraph ends where any block starts
                    own.cut(len(own.stack) - 1)
                if name in IMPLIED:
                    closes, stops = IMPLIED[name]
                    if (depth := own.last(closes)) > own.last(stops):
                        own.cut(depth)
                if name in VOID:
                    continue
                self.tag.append(name)
                self.parent.append(own.stack[-1])
                self.tokens.append(tuple(t.lower() for a in _NAMES.findall(rest) for t in _SPLIT.split(next(filter(None, a), "")) if t) if rest else ())
                self.links.append(0)
                self.inline.append(0)
                own.push(len(self.tag) - 1, name)
        flush()


@lru_cache(64)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b", re.I)
