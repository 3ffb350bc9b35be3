"""Book text, Markdown and QC report from canonical pages."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# Kinds that are no body text.
EXCLUDED = ("header", "footer", "page_number", "watermark")
#: Parts that a book's pages are dealt out in where they meet its stamps by a shuffle.
SPREAD = 64


def body_regions(pages: DataFrame, stamps: DataFrame | None = None, send: bool = True) -> DataFrame:
    """pages(book_id, page, text, regions) plus body: array<struct<kind, text>>. If no region is left, the text's lines are body.

    stamps(book_id, line) becomes one array a book, of the few lines that pass the stamps' threshold (no more than a page's
    lines in the band over the least share), and is sent to every task, so no book's pages are gathered in one. Without
    send, for so many books that these arrays don't fit, pages are dealt out by book and a SPREAD-th of its pages.
    """
    kinds = ", ".join(f"'{k}'" for k in EXCLUDED)
    if stamps is None:
        pages = pages.withColumn("_s", F.expr("CAST(array() AS array<string>)"))
    else:
        per, on = stamps.groupBy("book_id").agg(F.collect_set("line").alias("_s")), ["book_id"]
        if not send:
            pages, per, on = pages.withColumn("_z", F.expr(f"pmod(xxhash64(page), {SPREAD})")), per.withColumn("_z", F.expr(f"explode(sequence(0L, {SPREAD - 1}L))")), ["book_id", "_z"]
        pages = pages.join(F.broadcast(per) if send else per, on, "left").drop("_z").withColumn("_s", F.expr("coalesce(_s, array())"))
    stays = "r.s <> '' AND NOT array_contains(_s, r.s)"
    kept = f"filter(transform(filter(coalesce(regions, array()), r -> r.kind NOT IN ({kinds})), r -> struct(r.kind AS kind, r.text AS text, {t.strip('r.text')} AS s)), r -> {stays})"
    lines = f"filter(transform(split(text, '\\n'), l -> struct('body' AS kind, l AS text, {t.strip('l')} AS s)), r -> {stays})"
    plain = "transform({0}, r -> struct(r.kind AS kind, r.text AS text))"
    return pages.selectExpr("*", f"{kept} AS _k").selectExpr("* EXCEPT (_k, _s)", f"CASE WHEN size(_k) > 0 OR coalesce(text, '') = '' THEN {plain.format('_k')} ELSE {plain.format(lines)} END AS body")


def _txt(marker: str) -> str:
    a, b = marker.split("{page}")
    return f"concat('{a}', page, '{b}', '\\n\\n', array_join(transform(body, r -> r.text), '\\n'), '\\n')"


def _md(heading: str) -> str:
    a, b = heading.split("{page}")
    return f"concat('{a}', page, '{b}', '\\n\\n', array_join(transform(body, r -> IF(r.kind = 'heading', concat('### ', r.text), r.text)), '\\n\\n'), '\\n')"


def chunks(pages: DataFrame, kind: str = "txt", mark: str | None = None) -> DataFrame:
    """book_id, page, chunk: what each page adds to its book's product, by book and page in ranges of both.

    No book is gathered, so books may have any size. The product is a title line (md), the chunks with a separator
    between them (two line feeds for txt, one for md) and a last line feed (txt).
    """
    chunk = _txt(mark or "===== PAGE {page} =====") if kind == "txt" else _md(mark or "## Page {page}")
    return pages.selectExpr("book_id", "page", f"{chunk} AS chunk").repartitionByRange("book_id", "page").sortWithinPartitions("book_id", "page")


def _book(pages: DataFrame, chunk: str, glue: str, head: str = "''", tail: str = "''") -> DataFrame:
    """One document a book, in one row: for books of up to some hundred MB. Beyond that, chunks()."""
    got = pages.selectExpr("book_id", f"struct(page, {chunk} AS c) AS p").groupBy("book_id").agg(F.expr("array_sort(collect_list(p))").alias("ps"))
    return got.selectExpr("book_id", f"concat({head}, array_join(transform(ps, p -> p.c), '{glue}'), {tail}) AS document")


def txt(pages: DataFrame, marker: str = "===== PAGE {page} =====") -> DataFrame:
    """pages with body -> book_id, document."""
    return _book(pages, _txt(marker), "\\n\\n", tail="'\\n'")


def markdown(pages: DataFrame, heading: str = "## Page {page}") -> DataFrame:
    return _book(pages, _md(heading), "\\n", head="concat('# ', book_id, '\\n\\n')")


def _digests(pages: DataFrame, chunk: str, glue: str, head: str = "''", tail: str = "") -> DataFrame:
    """book_id, md5: that of _book's document, for books of any size, as no document and no array of pages is made.

    A book's pages come to one task, as MD5 takes its bytes in order; they are sorted there, on disk if need be, and
    hashed as they stream by. Each chunk brings the glue before it, so a batch's bytes are hashed as they lie.
    """
    cut, end = len(glue.encode()), tail.encode()
    sql = glue.replace("\n", "\\n")
    rows = pages.selectExpr("book_id", "page", f"CAST(concat('{sql}', {chunk}) AS binary) AS chunk").repartition("book_id").sortWithinPartitions("book_id", "page", "chunk")

    def hashed(batches):
        book, md5, begun = None, None, False
        for batch in batches:
            runs, chunks = pc.run_end_encode(batch.column("book_id")), batch.column("chunk")
            heads, at = batch.column("head"), 0
            for b, stop in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if md5 is None or b != book:
                    if md5 is not None:
                        md5.update(end)
                        yield _row(batch.schema, book, md5)
                    book, md5, begun = b, hashlib.md5(heads[at].as_py() or b"", usedforsecurity=False), False
                own = _bytes(chunks.slice(at, stop - at))
                md5.update(own if begun or not len(own) else own[cut:])  # a null chunk has no bytes
                begun, at = begun or len(own) > 0, stop
            schema = batch.schema
        if md5 is not None:
            md5.update(end)
            yield _row(schema, book, md5)

    kind = pages.schema["book_id"].dataType.simpleString()
    return rows.selectExpr("book_id", "chunk", f"CAST({head} AS binary) AS head").mapInArrow(hashed, f"book_id {kind}, md5 string")


def _row(schema: pa.Schema, book, md5) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([book], schema.field("book_id").type), pa.array([md5.hexdigest()])], ["book_id", "md5"])


def _bytes(values: pa.Array) -> memoryview:
    """All values of a binary column as they lie, one after another."""
    _, places, data = values.buffers()
    places = np.frombuffer(places, np.int64 if pa.types.is_large_binary(values.type) else np.int32)
    return memoryview(data or b"")[int(places[values.offset]) : int(places[values.offset + len(values)])]


def txt_digests(pages: DataFrame, marker: str = "===== PAGE {page} =====") -> DataFrame:
    """book_id, md5: the digest of txt's document."""
    return _digests(pages, _txt(marker), "\n\n", tail="\n")


def markdown_digests(pages: DataFrame, heading: str = "## Page {page}") -> DataFrame:
    """book_id, md5: the digest of markdown's document."""
    return _digests(pages, _md(heading), "\n", head="concat('# ', book_id, '\\n\\n')")


def flagged(pages: DataFrame) -> DataFrame:
    return pages.where("tier IN ('LOW', 'CRITICAL') OR size(warnings) > 0")


def qc_report(pages: DataFrame, stamps: DataFrame | None = None) -> DataFrame:
    """pages(book_id, page, tier, confidence, warnings) -> one row a book. A column flagged goes before what tier and warnings say."""
    by_tier = [F.count_if(F.col("tier") == k).alias(f"n_{k.lower()}") for k in ("HIGH", "MEDIUM", "LOW", "CRITICAL")]
    flag = F.expr("flagged" if "flagged" in pages.columns else "tier IN ('LOW', 'CRITICAL') OR size(warnings) > 0")
    out = pages.groupBy("book_id").agg(
        F.count("*").alias("pages"), *by_tier, F.coalesce(F.round(F.avg("confidence"), 2), F.lit(0.0)).alias("mean_confidence"), F.coalesce(F.min("confidence"), F.lit(0.0)).alias("min_confidence"),
        F.count_if(flag).alias("n_flagged"), F.array_sort(F.collect_list(F.when(flag, F.col("page")))).alias("flagged_pages"),
    )
    if stamps is None:
        return out
    return out.join(stamps.groupBy("book_id").agg(F.array_sort(F.collect_set("line")).alias("stamp_lines")), "book_id", "left").withColumn("stamp_lines", F.expr("coalesce(stamp_lines, array())"))


def page_record(pages: DataFrame) -> DataFrame:
    """The canonical log record: regions without their reading_order (their place is the order), rounded figures."""
    regions = "transform(regions, r -> struct(r.kind AS kind, array(r.x0, r.y0, r.x1, r.y1) AS bbox, r.text AS text, r.confidence AS confidence))"
    return pages.selectExpr("page", "text", "round(confidence, 2) AS confidence", "tier", "status", f"{regions} AS regions", "warnings", "round(duration_s, 3) AS duration_s")
