"""Web pages to Markdown: block structure alone."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HEADINGS = {f"h{n}": "#" * n + " " for n in range(1, 7)}
#: Elements whose start and end break a paragraph; elements whose content is not text.
BLOCKS = frozenset("p div section article blockquote pre tr td th figcaption dd dt table ul ol body aside header footer nav main".split())
SILENT = frozenset("script style head svg math noscript".split())


class _Events(HTMLParser):
    """Text and breaks as a list: strings are text, tuples begin a block with that prefix."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[str | tuple[str]] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.depth += 1
        elif not self.depth:
            if tag in HEADINGS:
                self.events.append((HEADINGS[tag],))
            elif tag == "li":
                self.events.append(("- ",))
            elif tag == "br" or tag in BLOCKS:
                self.events.append(("",))

    def handle_startendtag(self, tag, attrs):
        if tag == "br" and not self.depth:
            self.events.append(("",))

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.depth = max(0, self.depth - 1)
        elif not self.depth and (tag in HEADINGS or tag == "li" or tag in BLOCKS):
            self.events.append(("",))

    def handle_data(self, data):
        if not self.depth:
            self.events.append(data)


def html_to_markdown(html: str | None) -> str | None:
    """Headings as #, list items as -, everything else as paragraphs; white space is squeezed."""
    if html is None:
        return None
    reader = _Events()
    try:
        reader.feed(html)
        reader.close()
    except Exception:  # noqa: BLE001 - what was read of a broken page is better than nothing
        pass
    blocks, prefix, text = [], "", []
    for event in [*reader.events, ("",)]:
        if isinstance(event, str):
            text.append(event)
            continue
        block = " ".join("".join(text).split())
        if block:
            blocks.append(prefix + block)
        prefix, text = event[0], []
    return "\n\n".join(blocks)


@F.udf(StringType(), useArrow=False)
def markdown_of(page):
    """Pages reach Python a hundred at a time: a batch of ten thousand of them, with their events, would take gigabytes."""
    return html_to_markdown(page)


def markdown(html: str | Column) -> Column:
    """A column of pages as Markdown."""
    return markdown_of(html)
