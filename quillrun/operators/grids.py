"""Tables of web pages as grids: nested tables apart, cells repeated where they span rows and columns."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: The most that a cell may span, as browsers have it.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534


class _Table:
    def __init__(self, number: int, parent: int | None):
        self.number, self.parent = number, parent
        self.rows: list[dict[int, str]] = []
        self.taken: dict[int, tuple[int | None, str]] = {}  # column: rows still to fill (None: all), text
        self.cell: list | None = None  # column, columns, rows, parts of text
        self.at = 0

    def fill(self) -> None:
        """Cells from rows above, up to the next free column."""
        while self.at in self.taken:
            rows, text = self.taken[self.at]
            self.rows[-1][self.at] = text
            if rows is not None:
                self.taken[self.at] = (rows - 1, text)
                if rows == 1:
                    del self.taken[self.at]
            self.at += 1

    def start_row(self) -> None:
        self.end_row()
        self.rows.append({})
        self.at = 0

    def end_row(self) -> None:
        self.end_cell()
        if self.rows and self.at >= 0:
            while self.taken and max(self.taken) >= self.at:
                self.fill()
                if self.taken and max(self.taken) >= self.at:
                    self.at = min(c for c in self.taken if c >= self.at)
        self.at = -1

    def start_cell(self, columns: int, rows: int) -> None:
        self.end_cell()
        if not self.rows or self.at < 0:
            self.start_row()
        self.fill()
        self.cell = [self.at, columns, rows, []]

    def end_cell(self) -> None:
        if self.cell:
            column, columns, rows, parts = self.cell
            text = " ".join("".join(parts).split())
            for c in range(column, column + columns):
                self.rows[-1][c] = text
                self.taken.pop(c, None)
                if rows != 1:
                    self.taken[c] = (rows - 1 if rows else None, text)
            self.at, self.cell = column + columns, None

    def grid(self) -> list[list[str]]:
        width = max((max(r) + 1 for r in self.rows if r), default=0)
        return [[r.get(c, "") for c in range(width)] for r in self.rows]


class _Reader(HTMLParser):
    """Keeps a stack of open tables; text goes to the innermost open cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Table] = []
        self.found: list[_Table] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "table":
            self.open.append(_Table(len(self.found), self.open[-1].number if self.open else None))
            self.found.append(self.open[-1])
        elif self.open and tag == "tr":
            self.open[-1].start_row()
        elif self.open and tag in ("td", "th"):
            span = lambda name, least, most: min(max(int(v), least), most) if (v := (dict(attrs).get(name) or "").strip()).isascii() and v.isdigit() else 1
            self.open[-1].start_cell(span("colspan", 1, MOST_COLUMNS), span("rowspan", 0, MOST_ROWS))
        elif self.open and self.open[-1].cell:
            self.open[-1].cell[3].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag == "table" and self.open:
            self.open.pop().end_row()
        elif self.open and tag == "tr":
            self.open[-1].end_row()
        elif self.open and tag in ("td", "th"):
            self.open[-1].end_cell()
        elif self.open and self.open[-1].cell:
            self.open[-1].cell[3].append(" ")

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].cell and not self.silent:
            self.open[-1].cell[3].append(data)

    def close(self) -> None:
        super().close()
        while self.open:  # tables that the page doesn't end
            self.open.pop().end_row()


def read_grids(html: str) -> list[tuple[int, int | None, list[list[str]]]]:
    """(table, parent, grid) of each table, numbered by where they begin."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return [(t.number, t.parent, t.grid()) for t in reader.found]


def html_grids(pages: DataFrame) -> DataFrame:
    """(page_id, table, parent, row, cells): a row for each row of each table of raw web pages, all of a
    table with as many cells. A cell that spans rows or columns stands in each of its places; a nested table
    is one of its own, with the number of the table around it as parent, and no text of the cell it is in.
    Null pages have none; unended tables end with the page; a rowspan of 0 reaches to the table's end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, html in zip(pdf["page_id"], pdf["html"]):
                for table, parent, grid in read_grids(html):
                    rows += [(page, table, parent, i, cells) for i, cells in enumerate(grid)]
            out = pd.DataFrame(rows, columns=["page_id", "table", "parent", "row", "cells"])
            yield out.astype({"parent": "Int32"})

    kind = pages.schema["page_id"].dataType.simpleString()
    named = pages.where("html is not null and page_id is not null").select("page_id", "html")
    return named.mapInPandas(run, f"page_id {kind}, table int, parent int, row int, cells array<string>")
