"""Page HTML to readable text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchery.functions.text import tidy_body
from dispatchery.operators.curation import fallback_text

# Elements whose text is never part of an article, and elements that end a line.
_HIDDEN = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "table", "title", "head"}
_BREAKS = {"p", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "div", "article", "main"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr"}
_ASIDES = {"ad", "ads", "advert", "comment", "comments", "sidebar", "share", "related", "promo", "menu"}


class _Reader(HTMLParser):
    """Collects visible text, and apart from it the text inside article or main."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []
        self.every: list[str] = []
        self.inner: list[str] = []

    def _add(self, text: str) -> None:
        hidden = bool(self.open) and self.open[-1][1]
        if hidden:
            return
        self.every.append(text)
        if self.open and self.open[-1][2]:
            self.inner.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in _BREAKS:
            self._add("\n")
        if tag in _VOID:
            return
        names = set()
        for key, value in attrs:
            if key in ("class", "id") and value:
                names.update(value.lower().replace("_", "-").split())
        above = self.open[-1] if self.open else ("", False, False)
        hidden = above[1] or tag in _HIDDEN or bool(names & _ASIDES)
        self.open.append((tag, hidden, above[2] or tag in ("article", "main")))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
        if tag in _BREAKS:
            self._add("\n")

    def handle_data(self, data):
        self._add(data)


def readable_text(html: str | None) -> str:
    """Text of article or main where there is one, else all visible text, one block a line."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    pieces = reader.inner if any(p.strip() for p in reader.inner) else reader.every
    lines = (" ".join(line.split()) for line in "".join(pieces).split("\n"))
    return "\n".join(line for line in lines if line)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of (page_id, url, html); tag-strip where nothing readable is left."""

    def read(batches: Iterator) -> Iterator:
        for batch in batches:
            batch["text"] = [readable_text(h) for h in batch["html"]]
            yield batch

    schema = "page_id bigint, url string, html string, text string"
    rows = pages.select("page_id", "url", "html").mapInPandas(read, schema)
    return rows.select(
        "page_id", "url",
        F.when(F.trim("text") != "", tidy_body(F.col("text"))).otherwise(fallback_text(F.col("html"))).alias("text"),
    )
