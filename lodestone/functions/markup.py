"""HTML to Markdown for one page, the small helper behind the HTML reader."""

from __future__ import annotations

import html
import re

from lodestone.functions.text import WHITESPACE

# Elements whose content is never part of the article.
SKIPPED = {"script", "style", "nav", "footer", "aside", "header", "form", "button", "iframe"}
SKIPPED |= {"head", "title", "noscript", "template"}
BLOCKS = {"p", "div", "section", "article", "blockquote", "table"}
LISTS = {"ul", "ol"}
EMPHASIS = {"strong": "**", "b": "**", "em": "*", "i": "*"}
# Inline formatting that is reopened when a block boundary cut it off.
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "s", "small", "strike", "strong", "tt", "u"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Opening the key ends a still open element of the values.
IMPLIED_END = {
    "li": {"li"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tr": {"td", "th", "tr"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
}
HEADINGS = {f"h{n}" for n in range(1, 7)}
# Opening one of these closes an open paragraph, unless a table cell or the like lies between.
CLOSES_P = BLOCKS - {"table"} | LISTS | HEADINGS | SKIPPED - {"script", "style", "button", "iframe", "title", "noscript", "template"}
CLOSES_P |= {"table", "pre", "li", "dl", "dt", "dd", "main", "figure", "figcaption", "hr", "center", "details", "summary", "address"}
P_SCOPE = {"table", "td", "th", "caption", "button", "html", "template"}

RAW_TEXT = re.compile(r"<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
ALT = re.compile(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)


def page_title(page: str) -> str | None:
    found = TITLE.search(page)
    return (html.unescape(found.group(1)).strip(WHITESPACE) or None) if found else None


class _Article:
    """Open elements and the text each one is collecting."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.text: list[list[str]] = [[]]
        self.cut: list[str] = []
        self.skipping = self.verbatim = self.depth = 0

    def write(self, piece: str) -> None:
        self.text[-1].append(piece)

    def start(self, tag: str, attrs: str) -> None:
        while self.open and self.open[-1] in IMPLIED_END.get(tag, ()):
            self.end(self.open[-1])
        if tag in CLOSES_P and self._paragraph_open():
            self.end("p")
        if tag not in CLOSES_P and tag not in IMPLIED_END:
            self._reopen()
        self._enter(tag, attrs)

    def _paragraph_open(self) -> bool:
        for tag in reversed(self.open):
            if tag == "p" or tag in P_SCOPE:
                return tag == "p"
        return False

    def _reopen(self) -> None:
        """Formatting cut off by a block boundary goes on around the next inline content."""
        again, self.cut = self.cut, []
        for tag in again:
            self._enter(tag, "")

    def _enter(self, tag: str, attrs: str) -> None:
        if tag in VOID:
            if not self.skipping and not self.verbatim:
                self._void(tag, attrs)
            return
        self.open.append(tag)
        if tag in SKIPPED:
            self.skipping += 1
        if self.skipping or self.verbatim:
            if tag in ("pre", "code"):
                self.verbatim += 1
            return
        if tag in LISTS:
            self.depth += 1
            self.write("\n")
        elif tag in BLOCKS:
            self.write("\n\n")
        elif tag == "li":
            self.write("\n" + "  " * max(self.depth - 1, 0) + "- ")
        elif tag in ("td", "th"):
            self.write(" ")
        elif tag in EMPHASIS:
            self.write(EMPHASIS[tag])
        elif tag in ("pre", "code"):
            self.verbatim += 1
            self.text.append([])
        elif tag in HEADINGS:
            self.text.append([])

    def _void(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.write("\n")
        elif tag == "img":
            alt = ALT.search(attrs)
            words = html.unescape(next((g for g in alt.groups() if g), "") if alt else "").strip(WHITESPACE)
            if words:
                self.write(words + " ")

    def end(self, tag: str) -> None:
        if tag in self.cut:
            self.cut.remove(tag)
        if tag not in self.open:
            return
        cut = []
        while True:
            closing = self.open.pop()
            self._close(closing)
            if closing == tag:
                break
            if closing in FORMATTING:
                cut.insert(0, closing)
        self.cut = cut + self.cut

    def _close(self, tag: str) -> None:
        hidden = self.skipping
        if tag in SKIPPED:
            self.skipping -= 1
        if tag in ("pre", "code") and self.verbatim:
            self.verbatim -= 1
            if self.verbatim or hidden:
                return
            inner = "".join(self.text.pop()).strip(WHITESPACE)
            if tag == "pre":
                self.write(f"\n\n```\n{inner}\n```\n\n")
            elif inner:
                self.write(f"`{inner}`")
            return
        if hidden or self.verbatim:
            return
        if tag in LISTS:
            self.depth -= 1
            self.write("\n")
        elif tag in BLOCKS:
            self.write("\n\n")
        elif tag == "tr":
            self.write("\n")
        elif tag in ("td", "th"):
            self.write(" |")
        elif tag in EMPHASIS:
            self.write(EMPHASIS[tag])
        elif tag in HEADINGS:
            inner = "".join(self.text.pop()).strip(WHITESPACE)
            self.write(f"\n\n{'#' * int(tag[1])} {inner}\n\n")

    def characters(self, raw: str) -> None:
        self._reopen()
        if self.skipping:
            return
        words = html.unescape(raw)
        if self.verbatim:
            self.write(words)
        elif words.strip(WHITESPACE):
            self.write(words.strip(WHITESPACE) + " ")


def html_to_markdown(page: str) -> str:
    article = _Article()
    for token in TOKEN.finditer(RAW_TEXT.sub("", page)):
        if token["text"] is not None:
            article.characters(token["text"])
        elif token["tag"]:
            tag = token["tag"].lower()
            if token["close"]:
                article.end(tag)
            else:
                article.start(tag, token["attrs"] or "")
    while article.open:
        article.end(article.open[-1])
    return re.sub(r"\n{3,}", "\n\n", "".join(article.text[0])).strip(WHITESPACE)
