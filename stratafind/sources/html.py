"""HTML pages as sections: the standard parser inside Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from ..operators.chunking import _each

DROPPED = {"script", "style", "noscript", "nav", "header", "footer", "aside"}
ROOTS = ("main", "article", "body")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Reader(HTMLParser):
    """Text pieces with the heading level they stand under, inside `root`, or everywhere if root is None."""

    def __init__(self, root: str | None):
        super().__init__(convert_charrefs=True)
        self.root, self.inside, self.dropped, self.level = root, 0 if root else 1, 0, 0
        self.pieces: list[tuple[int, str]] = []
        self.title, self.in_title, self.tags = "", False, set()

    def handle_starttag(self, tag, attrs):
        self.tags.add(tag)
        if tag in _VOID:
            return
        self.inside += tag == self.root
        self.dropped += tag in DROPPED
        self.in_title |= tag == "title"
        if re.fullmatch("h[1-3]", tag):
            self.level = int(tag[1])
            self.pieces.append((self.level, ""))

    def handle_endtag(self, tag):
        self.inside -= tag == self.root and self.inside > 0
        self.dropped -= tag in DROPPED and self.dropped > 0
        if tag == "title":
            self.in_title = False
        if re.fullmatch("h[1-3]", tag):
            self.level = 0
            self.pieces.append((0, "\n"))
        elif tag in ("p", "div", "li", "tr", "section", "article"):
            self.pieces.append((0, "\n"))

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif self.inside > 0 and not self.dropped:
            self.pieces.append((self.level, data))


def read(html: str) -> tuple[str, list[tuple[int, str, str]]]:
    """The title, and (level, heading, content) of each section with content; the part before any heading has level 0."""
    probe = _Reader(None)
    probe.feed(html)
    reader = _Reader(next((t for t in ROOTS if t in probe.tags), None))
    reader.feed(html)
    found, level, head, body = [], 0, "", []
    for lv, text in [*reader.pieces, (1, "")]:
        if lv and not text:  # a heading opens
            content = re.sub(r"[ \t\r\f\v]*\n\s*", "\n", re.sub(r"[ \t\r\f\v]+", " ", "".join(body))).strip()
            if content:
                found.append((level, " ".join(head.split()), content))
            level, head, body = lv, "", []
        elif lv:
            head += text
        else:
            body.append(text)
    return probe.title.strip(), found


def sections(pages: DataFrame) -> DataFrame:
    """page_id, pos, level, section_title, html_title, text: each section opens with its heading as Markdown."""

    def of(page, html):
        title, found = read(html or "")
        for k, (level, head, content) in enumerate(found):
            yield page, k, level, head or "Preamble", title, (f"{'#' * level} {head}\n\n" if level else "") + content

    return _each(pages, of, ["page_id", "html"], "page_id long, pos int, level int, section_title string, html_title string, text string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, file_name (stable, from the url), text: a page's main content under a header of title and source."""
    import hashlib

    def of(page, url, html):
        title, found = read(html or "")
        name = hashlib.sha256((url or "").encode()).hexdigest()[:16]
        yield page, f"{name}.md", f"# {title}\n\nSource: {url}\n\n" + "\n\n".join(c for _, _, c in found)

    return _each(pages, of, ["page_id", "url", "html"], "page_id long, file_name string, text string")
