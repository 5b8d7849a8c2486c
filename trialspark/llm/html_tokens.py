"""Tags and text runs of raw HTML pages, tolerant of unclosed and misplaced tags."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*>|[^<]+|<", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")

# Elements whose content is no markup, elements without content, and elements that end a run of text.
RAW = frozenset(("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
BLOCK = frozenset((
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, rest): ``text`` with decoded characters, ``open`` and ``close`` with a lower-cased tag name and its
    raw attributes, ``raw`` with the tag and content of an element whose content is no markup. Comments are left out."""
    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at, tag = m.end(), m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                yield "text", unescape(m[0]), ""
            elif m[0].startswith("<![CDATA["):
                yield "text", m[0][9:].removesuffix("]]>"), ""
            continue
        tag = tag.lower()
        if m[1]:
            yield "close", tag, ""
            continue
        yield "open", tag, m[3]
        if tag in RAW and not m[3].endswith("/"):
            close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(html, at)
            yield "raw", tag, html[at:close.start() if close else end]
            yield "close", tag, ""
            at = close.end() if close else end


def names(attributes: str) -> str:
    """The lower-cased class, id and role values of a tag."""
    return " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower() if attributes else ""


def attributes(rest: str) -> dict[str, str]:
    return {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(rest)}


def squeeze(text: str) -> str:
    """``text`` trimmed, with every run of white space as one space."""
    return " ".join(text.split())
