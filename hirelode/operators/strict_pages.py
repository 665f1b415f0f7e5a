"""Anchors of malformed pages, by a tokenizer instead of patterns.

The one place where Python runs on the executors, and only for those who ask for it: patterns
(`pages.page_links`) are many times as fast and agree on pages whose quotes and comments are closed. A
page is read tag by tag, with the states a parser has: within a tag, a quoted value, a comment, or an element
whose content is text. What is never closed ends with the page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINKS = "array<struct<href:string,text:string>>"
#: Pages that are parsed and handed back at a time.
SLICE = 64


def page_links_strict(pages: DataFrame, *keep: str) -> DataFrame:
    """links(page_id, url, the columns to keep, pos, href, text): one row per anchor with an address.

    A page without a source has none. Pages that repeat stay; other columns are left out.
    """
    columns = ["page_id", "url", *keep]
    found = pages.select(*columns, "html").mapInArrow(
        _parser(len(columns)), _schema(pages, columns)
    )
    return found.select(*columns, F.posexplode("links").alias("pos", "link")).select(
        *columns, "pos", F.col("link.href").alias("href"), F.col("link.text").alias("text")
    )


def _schema(pages: DataFrame, columns: list[str]) -> str:
    kept = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns]
    return ", ".join([*kept, f"links {LINKS}"])


def _parser(kept: int):
    """A function over Arrow batches; all it needs is inside, so executors need not have this package."""
    size = SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from html import unescape
        from html.parser import HTMLParser

        class Anchors(HTMLParser):
            def __init__(self):
                super().__init__()
                self.found, self.inside = [], False

            def handle_starttag(self, tag, attrs):
                if tag == "a":
                    # An anchor ends where the next begins.
                    self.inside = any(name == "href" for name, _ in attrs)
                    if self.inside:
                        address = next(value for name, value in attrs if name == "href")
                        self.found.append([address or "", ""])
                elif tag in ("textarea", "title"):
                    self.set_cdata_mode(tag)

            def handle_startendtag(self, tag, attrs):
                if tag == "a":
                    self.handle_starttag(tag, attrs)

            def handle_endtag(self, tag):
                if tag == "a":
                    self.inside = False

            def handle_data(self, data):
                if self.inside and self.cdata_elem not in ("script", "style"):
                    raw = unescape(data) if self.cdata_elem else data
                    self.found[-1][1] += raw.strip()

        def links(source: str | None) -> list[dict[str, str]]:
            parser = Anchors()
            # In HTML such a section is a comment up to the next ">".
            parser.feed((source or "").replace("<![", "<!x["))
            parser.close()
            return [{"href": href, "text": text} for href, text in parser.found]

        kind = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                made = pa.array([links(html) for html in part.column(kept).to_pylist()], type=kind)
                names = [*part.schema.names[:kept], "links"]
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], made], names=names)

    return run
