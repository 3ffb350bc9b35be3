"""Printed stamps: lines that recur near the bottom of many pages of a book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def stamp_lines(pages: DataFrame, band: float = 0.15, least_pages: int = 3, least_share: float = 0.3, normalize: bool = True) -> DataFrame:
    """pages(book_id, page, page_height, regions) -> book_id, line, pages; text is taken as NFC, or brought to it with normalize.

    The threshold is max(least_pages, share of all pages rounded half to even); pages of height 0 count there only.
    Distinct pages are counted by two aggregates, so a line on every page is reduced in each task first. A page's lines are
    made once: Spark would make them again to ask whether there are any, and again to ask whether a line is empty.
    """
    low = t.once(pages.where("page_height > 0"), _low=f"transform(filter(regions, r -> r.y0 >= {1 - band!r}D * page_height), r -> r.text)").selectExpr("book_id", "page", "explode(_low) AS line")
    low = t.with_nfc(low, "line") if normalize else low
    low = t.once(low, _line=t.collapse("line")).selectExpr("book_id", "page", "_line AS line").where("line <> ''").distinct()
    total = pages.groupBy("book_id").agg(F.countDistinct("page").alias("total"))
    return low.groupBy("book_id", "line").agg(F.count("*").alias("pages")).join(total, "book_id").where(f"pages >= greatest({least_pages}, bround({least_share!r}D * total))").select("book_id", "line", "pages")


def drop_stamps(regions: DataFrame, stamps: DataFrame, normalized_match: bool = False, band: float | None = None, send: bool = True) -> DataFrame:
    """regions(book_id, text, ...) without stamp lines. By default the stripped text is compared as it is and stamps go from
    anywhere on a page; normalized_match compares collapsed text, band restricts this to the bottom band (y0, page_height).
    The few stamps are sent to every task, so lines stay where they are; without send, both are dealt out by book and line."""
    key = t.collapse("text") if normalized_match else t.strip("text")
    low = "" if band is None else f" AND y0 >= {1 - band!r}D * page_height"
    stamps = stamps.select(F.col("book_id").alias("_b"), F.col("line").alias("_l"))
    return regions.join(F.broadcast(stamps) if send else stamps, F.expr(f"book_id = _b AND {key} = _l{low}"), "left_anti")
