"""Row functions that need a parser or a scan with state: HTML to Markdown, similarity of words."""

from __future__ import annotations

import difflib
import re
from html.parser import HTMLParser

_SKIPPED = {"script", "style", "nav", "footer"}
_BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "blockquote", "figure", "pre"}


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipping = 0
        self.cells = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SKIPPED:
            self.skipping += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "tr":
            self.out.append("\n|")
            self.cells = 0
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "br":
            self.out.append("\n")
        elif tag in _BLOCKS:
            self.out.append("\n\n> " if tag == "blockquote" else "\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif tag in ("td", "th"):
            self.out.append(" |")
        elif tag in _BLOCKS or re.fullmatch("h[1-6]", tag):
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.out.append(re.sub(r"\s+", " ", data))


def to_markdown(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(parser.out))).strip()


def ratio(a: str, b: str) -> float:
    """Twice the matching characters over all, by longest matching blocks."""
    return difflib.SequenceMatcher(None, a, b).ratio()
