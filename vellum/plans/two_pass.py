"""The book pipeline: triage, gate, first reading, layout, quality and routing, second reading, canonical records, products.

Readings are written at exactly two points, after either pass, since they must not be computed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence, image
from ..functions.quality import Rules, score_pages
from ..operators import engines, layout, ordering, render, routing, stamps
from ..schemas import BLOCK
from ..settings import Settings
from ..sources import text_layer

#: The columns of a canonical page.
PAGE = ["book_id", "page", "text", "regions", "confidence", "score", "tier", "status", "engine", "processing_pass", "provider", "warnings", "error"]


def triage(images: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Page images -> their profile, whether they are blank, and which repairs they need."""
    how = settings.image
    return image.gates(image.analyze(images, how.blank_below), how.least_angle, how.noise_above, how.contrast_below)


def repaired(images: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """triage, and the repaired page (png) beside it, in one pass over the images."""
    how = settings.image
    return image.triaged(images, how.blank_below, how.least_angle, how.noise_above, how.contrast_below)


def products(pages: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Canonical pages (with regions, page_height, tier, confidence, warnings) -> stamps, txt and md (a document a book), txt_md5 (its digest, for books of any size), qc (a row a book)."""
    how, out = settings.stamps, settings.output
    found = stamps.stamp_lines(pages, how.band, how.least_pages, how.least_share)
    body = render.body_regions(pages, found)
    return {"stamps": found, "txt": render.txt(body, out.marker), "txt_md5": render.txt_digests(body, out.marker), "md": render.markdown(body, out.heading), "qc": render.qc_report(pages, found)}


def judged(readings: DataFrame, rules: Rules) -> DataFrame:
    counters = evidence.counters(regions="size(regions)")
    return score_pages(readings, rules).selectExpr("book_id", "page", "engine", "version", "text", "regions", "provider", "confidence", "score", "tier", "concat(warnings, layout_warnings) AS warnings", "error", *counters)


def laid_out(readings: DataFrame, blocks: DataFrame | None) -> DataFrame:
    """Readings with their lines in reading order as regions, by layout blocks where there are any, and the text that gives."""
    if blocks is None:
        readings = readings.selectExpr("*", f"CAST(NULL AS array<{BLOCK}>) AS blocks", "CAST(NULL AS string) AS layout_error")
    else:
        readings = readings.join(blocks, ["book_id", "page"], "left")
    got = layout.apply_layout(readings, error="layout_error")
    return got.selectExpr("* EXCEPT (text, lines, blocks, layout_error)", f"IF(error IS NULL, {ordering.assemble('regions')}, NULL) AS text")


def run(spark: SparkSession, pages: DataFrame, folder: str, first, second=None, settings: Settings = Settings(), first_config: dict | None = None, second_config: dict | None = None, detector=None, detector_config: dict | None = None) -> DataFrame:
    """pages(book_id, page, text, blank) -> one canonical row (PAGE) a page. text is the page's own text layer.

    Blank pages are recorded as BLANK with confidence 100; a usable text layer is taken without an engine or a layout.
    Second readings are put in row order, without a layout. A page keeps the confidence and regions of its chosen reading.
    """
    how, rules = settings.run, settings.rules
    own = {"mode": how.mode, "start_method": how.start_method}
    blank = pages.where("blank").selectExpr(
        "book_id", "page", "'' AS text", "100D AS confidence", "100D AS score", "'HIGH' AS tier", "'BLANK' AS status", "'none' AS engine", "1 AS processing_pass", "'none' AS provider", "array('blank_page') AS warnings", "CAST(NULL AS string) AS error"
    )
    gate = settings.gate
    gated = text_layer.gate(pages.where("NOT blank"), gate.prefer, gate.least_chars, gate.least_words, gate.least_ratio, gate.most_replaced, rules.script)
    line = "struct('body' AS kind, 0D AS x0, i + 0D AS y0, 1D AS x1, i + 0.5D AS y1, l AS text, CAST(NULL AS double) AS confidence, CAST(NULL AS int) AS reading_order)"
    layer = gated.where("layer.usable").selectExpr("book_id", "page", "'text-layer' AS engine", "'1' AS version", f"transform(split(text, '\\n'), (l, i) -> {line}) AS lines", "text", "CAST(NULL AS double) AS confidence", "0D AS runtime_s", "CAST(NULL AS string) AS error")
    todo = gated.where("NOT layer.usable").drop("layer")
    read = engines.recognize(todo, "primary", first, first_config, timeout_s=how.first_timeout_s, **own)
    blocks = None if detector is None else engines.detect(todo, detector, detector_config, timeout_s=how.first_timeout_s, **own)
    one = laid_out(layer, None).unionByName(laid_out(read, blocks))
    judged(one, rules).write.mode("overwrite").parquet(f"{folder}/pass1")
    one = spark.read.parquet(f"{folder}/pass1")
    escalate = second is not None and how.escalate
    broken = one.where("error IS NOT NULL").selectExpr("*", "'FAILED' AS status", "1 AS processing_pass")
    routed = routing.route(one.where("error IS NULL"), 1, escalate, how.most_disagreement)
    done = routed.where("action <> 'reprocess_local'").selectExpr("*", "1 AS processing_pass")
    out = broken.select(PAGE).unionByName(done.select(PAGE)).unionByName(blank, allowMissingColumns=True).select(PAGE)
    if not escalate:
        return out
    again = pages.join(routed.where("action = 'reprocess_local'").select("book_id", "page"), ["book_id", "page"], "left_semi")
    two = laid_out(engines.recognize(again, "escalation", second, second_config, timeout_s=how.second_timeout_s, **own), None)
    judged(two, rules).write.mode("overwrite").parquet(f"{folder}/pass2")
    chosen = routing.adjudicate(one, spark.read.parquet(f"{folder}/pass2"), how.most_disagreement)
    return out.unionByName(chosen.withColumn("provider", F.lit("rtl-row-fallback")).select(PAGE))
