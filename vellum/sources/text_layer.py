"""A document's own text layer: blocks scaled to the raster, and the gate that decides whether to use it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text as t
from ..functions.quality import Script
from ..operators.ordering import assemble, right_to_left

_EMPTY = "coalesce(text, '')"


def regions(blocks: str = "blocks") -> str:
    """blocks: array<struct<x0, y0, x1, y1, text>> in points; page_width, page_height in points, raster_width, raster_height in pixels."""
    sx, sy = "raster_width / greatest(page_width, 1)", "raster_height / greatest(page_height, 1)"
    clean = f"filter(transform({blocks}, b -> struct(b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1, {t.strip('b.text')} AS text)), b -> b.text <> '')"
    scaled = f"transform({clean}, b -> struct('body' AS kind, b.x0 * {sx} AS x0, b.y0 * {sy} AS y0, b.x1 * {sx} AS x1, b.y1 * {sy} AS y1, b.text AS text, CAST(NULL AS double) AS confidence, CAST(NULL AS int) AS reading_order))"
    return right_to_left(scaled)


def extract(pages: DataFrame) -> DataFrame:
    got = pages.selectExpr("*", f"{regions()} AS regions")
    return got.selectExpr("*", f"{assemble('regions')} AS text")


def gate(pages: DataFrame, prefer: bool = True, least_chars: int = 80, least_words: int = 12, least_ratio: float = 0.5, most_replaced: float = 0.01, script: Script = Script()) -> DataFrame:
    """pages(text) plus layer: struct of present, usable, counts and ratios."""
    got = t.once(pages, _w=t.words(_EMPTY)).selectExpr("*", "array_join(_w, '') AS _b").selectExpr("*", "char_length(_b) AS _n")
    ratio = lambda cls: f"{t.chars('_b', cls)} / greatest(_n, 1)"
    got = t.once(got, _a=ratio(f"[{script.letters}]"), _r=ratio("[" + chr(92) * 2 + "uFFFD]"))
    layer = (
        f"struct({_EMPTY} <> '' AS present, {str(prefer).lower()} AND _n >= {least_chars} AND size(_w) >= {least_words} AND _a >= {least_ratio!r}D AND _r <= {most_replaced!r}D AS usable, "
        "CAST(_n AS bigint) AS character_count, CAST(size(_w) AS bigint) AS word_count, round(_a, 6) AS arabic_ratio, round(_r, 6) AS replacement_ratio)"
    )
    return got.selectExpr("* EXCEPT (_w, _b, _n, _a, _r)", f"{layer} AS layer")
