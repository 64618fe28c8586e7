"""HTML pages as rows of cells and links, by one tolerant pass of the standard parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame


class _Reader(HTMLParser):
    """Collects table cells by row, and anchors; what isn't closed ends where the next begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list[str]]] = []
        self.links: list[tuple[str, list[str]]] = []
        self.cell = self.link = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
            self.cell = None
        elif tag in ("td", "th") and self.rows:
            self.cell = []
            self.rows[-1].append(self.cell)
        elif tag == "a" and (href := dict(attrs).get("href")):
            self.link = []
            self.links.append((href, self.link))

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.cell = None
        elif tag == "a":
            self.link = None

    def handle_data(self, data):
        for target in (self.cell, self.link):
            if target is not None:
                target.append(data)


def _read(html: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader


def _flat(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def cells(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row, col, text) of every table cell that has text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, i, j, t) for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, row in enumerate(_read(h).rows) for j, c in enumerate(row) if (t := _flat(c))]
            ks, i, j, t = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ks, batch.schema.field(0).type), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(t, pa.string())], names=[key, "row", "col", "text"])

    return df.select(key, html).mapInArrow(run, f"`{key}` {kind}, row int, col int, text string")


def links(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, href, id, text) of every anchor; id is the last part of its path."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, href, href.split("?")[0].rstrip("/").rpartition("/")[2], _flat(parts)) for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for href, parts in _read(h).links]
            ks, a, b, c = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ks, batch.schema.field(0).type), *(pa.array(x, pa.string()) for x in (a, b, c))], names=[key, "href", "id", "text"])

    return df.select(key, html).mapInArrow(run, f"`{key}` {kind}, href string, id string, text string")
