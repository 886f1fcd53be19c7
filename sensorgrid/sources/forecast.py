"""Weather-forecast pages to tidy hourly rows.

The page table is cut into cells on executors; labels, units, midnight rollover and
the choice of metric values are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorgrid.config import STATION_ZONE
from sensorgrid.functions import scalar, text
from sensorgrid.operators.counts import RunCounts

# --- fixed values -----------------------------------------------------------
TABLE_ID = "forecastTable_1_3"
HINT_ATTRIBUTE = "onmouseover"
# -----------------------------------------------------------------------------
CELLS = "page_id bigint, row int, kind string, pos int, value string"


class _Cells(HTMLParser):
    """Cells of the forecast table and the hover hints of its ``div`` tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[int, str, int, str]] = []
        self.depth = 0
        self.row = -1
        self.cells = self.hints = 0
        self.text: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "table":
            if self.depth or (self.row < 0 and attrs.get("id") == TABLE_ID):
                self.depth += 1
        if not self.depth:
            return
        if tag == "tr":
            self._close_cell()
            self.row, self.cells, self.hints = self.row + 1, 0, 0
        elif tag == "td":
            self._close_cell()
            self.text = []
        elif tag == "div" and HINT_ATTRIBUTE in attrs and self.row >= 0:
            self.out.append((self.row, "hint", self.hints, attrs[HINT_ATTRIBUTE] or ""))
            self.hints += 1

    def handle_endtag(self, tag):
        if not self.depth:
            return
        if tag in ("td", "tr", "table"):
            self._close_cell()
        if tag == "table":
            self.depth -= 1

    def handle_data(self, data):
        if self.depth and self.text is not None:
            self.text.append(data)

    def _close_cell(self):
        if self.text is not None:
            self.out.append((self.row, "cell", self.cells, "".join(self.text)))
            self.cells += 1
            self.text = None


def _page_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, rows = [], []
        for page_id, html in zip(pdf["page_id"], pdf["html"]):
            parser = _Cells()
            parser.feed(html or "")
            parser.close()
            ids += [page_id] * len(parser.out)
            rows += parser.out
        if not rows:
            continue
        yield pd.DataFrame(
            {
                "page_id": ids,
                "row": [r[0] for r in rows],
                "kind": [r[1] for r in rows],
                "pos": [r[2] for r in rows],
                "value": [r[3] for r in rows],
            }
        )


def page_cells(pages: DataFrame) -> DataFrame:
    """``page_id, row, kind, pos, value`` of the forecast table of ``page_id, html`` pages."""
    return pages.select("page_id", "html").mapInPandas(_page_cells, CELLS)


def rollover_days(hour: Column, order: Window) -> Column:
    """Days to add to an hour: one for every 23 o'clock column before it."""
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.when(hour == 23, F.lit(1)).otherwise(F.lit(0))).over(before), F.lit(0)).cast("int")


def every_second(values: Column, limit: int | None = None) -> Column:
    """Elements 0, 2, 4, ... of an array, at most ``limit`` of them if a limit is given."""
    kept = F.filter(values, lambda _, i: i % 2 == 0)
    return kept if limit is None else F.slice(kept, 1, limit)


#: What is read of a page: the rows of its forecast table with label, cell texts and hover hints.
PAGE_ROWS = pa.list_(pa.struct([("label", pa.string()), ("cells", pa.list_(pa.string())), ("hints", pa.list_(pa.string()))]))


def _table_rows(html: str | None) -> list[dict]:
    parser = _Cells()
    parser.feed(html or "")
    parser.close()
    rows: dict[int, dict] = {}
    for row, kind, _, value in parser.out:
        line = rows.setdefault(row, {"label": None, "cells": [], "hints": []})
        line["cells" if kind == "cell" else "hints"].append(value)
    for line in rows.values():
        line["label"] = next(iter(line["cells"]), None)
    return [rows[k] for k in sorted(rows)]


def page_tables(pages: DataFrame) -> DataFrame:
    """The columns of ``pages`` with ``rows`` in the place of ``html``; a page stays one row, so nothing is shuffled."""
    others = [c for c in pages.columns if c != "html"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([_table_rows(html) for html in batch.column(0).to_pylist()], PAGE_ROWS)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], rows], names=[*others, "rows"])

    whole = pages.select("html", *others)
    line = T.StructType([T.StructField("label", T.StringType()), *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("cells", "hints"))])
    return whole.mapInArrow(read, T.StructType([*whole.schema.fields[1:], T.StructField("rows", T.ArrayType(line))]))


def tidy_forecast(
    pages: DataFrame, day: Column, parsed_at: Column, keep: tuple[str, ...] = (), hours: int | None = None,
    counts: RunCounts | None = None,
) -> DataFrame:
    """One row per page and hour column, of all columns or the first ``hours``.

    ``day`` is the local day of the first column and ``parsed_at`` the time of the
    snapshot; both may use columns of ``pages``.  A page without the table, a row or
    a readable value gives no rows; see :func:`bad_pages`.  With ``counts`` the pages and the good ones
    are counted as steps ``pages`` and ``good_pages`` in the same pass.
    """
    read = pages.select("page_id", "html", day.alias("_day"), parsed_at.alias("_parsed"), *keep)
    good = _good_pages(page_tables(counts.watch(read, "pages") if counts else read), hours)
    if counts:
        good = counts.watch(good, "good_pages")
    late = F.filter(F.sequence(F.lit(1), F.size("slots")), lambda i: F.col("slots")[i - 1]["time"] == 23)
    slots = good.select("page_id", "_day", "_parsed", *keep, late.alias("_late"), F.posexplode("slots").alias("pos", "slot"))
    # A day more for every 23 o'clock column before this one.
    days = F.size(F.filter("_late", lambda i: i <= F.col("pos")))
    local = F.to_timestamp(F.date_add("_day", days)) + F.make_dt_interval(hours=F.col("slot.time").cast("int"))
    return slots.select(
        "page_id",
        "pos",
        *keep,
        F.col("_parsed").alias("Parsing date"),
        scalar.to_utc(local, STATION_ZONE).alias("Date-Time"),
        F.col("slot.prec").alias("Weather"),
        F.col("slot.temp").cast("double").alias("Temp"),
        F.col("slot.pressure").cast("double").alias("Pressure"),
        F.col("slot.wind_speed").cast("double").alias("Wind_speed"),
        F.col("slot.wind_dir").alias("Wind_dir"),
        F.col("slot.humidity").cast("double").alias("Humidity"),
    )


def _good_pages(read: DataFrame, hours: int | None = None) -> DataFrame:
    """The good pages of :func:`page_tables`, with the values of their hour columns as ``slots`` in the place of ``rows``."""

    # A label may carry the marks of two rows (wind speed and direction); of several rows with one role the last one counts.
    def marked(mark: str) -> Column:
        return F.try_element_at(F.filter("rows", lambda r: F.contains(r["label"], F.lit(mark))), F.lit(-1))

    found = read.select(*[c for c in read.columns if c != "rows"], *[marked(mark).alias(f"_{role}") for role, mark in text.FORECAST_LABELS])

    def shown(role: str) -> Column:
        cells = F.col(f"_{role}.cells")
        return F.slice(cells, F.lit(2), F.size(cells) if hours is None else F.lit(hours))

    hints = every_second(F.transform(F.col("_prec.hints"), lambda h: F.get(F.split(h, ","), F.lit(1))), hours)
    columns = {
        "time": F.transform(shown("time"), lambda v: F.trim(v).try_cast("int")), "prec": hints,
        "wind_dir": F.transform(shown("wind_dir"), text.first_token),
        **{r: F.transform(shown(r), text.first_number) for r in ("temp", "pressure", "wind_speed", "humidity")},
    }
    kept = [c for c in read.columns if c != "rows"]
    ready = found.select(*kept, *[c.alias(f"_v_{n}") for n, c in columns.items()])
    whole = F.size("_v_time") > 0
    for n in columns:
        v = F.col(f"_v_{n}")
        whole = whole & v.isNotNull() & (F.size(v) == F.size("_v_time")) & ~F.exists(v, lambda x: x.isNull())
    return ready.filter(whole).select(*kept, F.arrays_zip(*[F.col(f"_v_{n}").alias(n) for n in columns]).alias("slots"))


def bad_pages(pages: DataFrame) -> DataFrame:
    """Ids of the pages that give no forecast rows."""
    read = pages.select("page_id", "html")
    return read.select("page_id").join(_good_pages(page_tables(read)).select("page_id"), "page_id", "left_anti")
