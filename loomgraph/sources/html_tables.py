"""Tables of HTML documents as rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.heading, self.tables, self.text, self.row = "", [], None, None

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "h2", "h3", "th", "td"):
            self.text = []
        elif tag == "table":
            self.tables.append((self.heading, []))
        elif tag == "tr" and self.tables:
            self.row = []

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag in ("h1", "h2", "h3") and self.text is not None:
            self.heading, self.text = "".join(self.text).strip(), None
        elif tag in ("th", "td") and self.text is not None:
            if self.row is not None:
                self.row.append("".join(self.text).strip())
            self.text = None
        elif tag == "tr" and self.row:
            self.tables[-1][1].append(self.row)
            self.row = None


def read_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, table_no, heading, row_no, cells): row 0 is the header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for i, source in zip(df.iloc[:, 0], df.iloc[:, 1]):
                reader = _Reader()
                reader.feed(source or "")
                rows += [(i, t, heading, r, cells) for t, (heading, body) in enumerate(reader.tables) for r, cells in enumerate(body)]
            yield pd.DataFrame(rows, columns=[id_col, "table_no", "heading", "row_no", "cells"])

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, table_no int, heading string, row_no int, cells array<string>")


def column_of(rows: DataFrame, heading: str, column: str, id_col: str = "page_id") -> DataFrame:
    """(id_col, row_no, value): the named column of tables under a heading that contains the term; blanks in names do not count."""
    under = rows.where(F.contains("heading", F.lit(heading)))
    at = under.where("row_no = 0").select(id_col, "table_no", F.array_position(F.transform("cells", lambda c: F.replace(c, F.lit(" "), F.lit(""))), column).alias("at")).where(F.col("at") > 0)
    return under.where("row_no > 0").join(at, [id_col, "table_no"]).where(F.size("cells") >= F.col("at")).select(id_col, "row_no", F.element_at("cells", F.col("at").cast("int")).alias("value"))


def free_models(endpoints: DataFrame, prices: DataFrame) -> DataFrame:
    """endpoints(label, model) whose label stands with both prices Free in prices(label, input, output)."""
    return endpoints.join(prices.where("input = 'Free' and output = 'Free'").select("label"), "label", "left_semi")
