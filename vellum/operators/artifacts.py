"""Records that a run leaves beside its pages: events, profiles, layouts, candidates, decisions and manifests, each a table.

One table a kind, a row a record; what another design would keep as a file of a page's folder is a filter here, and the
bundle of a page is a join of what belongs to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import evidence
from ..schemas import conform

KEY = ["book_id", "page"]


def events(rows: DataFrame, event: str, *payload: str, ts: str = "current_timestamp()") -> DataFrame:
    """One event a row of rows(book_id, page): the payload columns as a JSON object. event and ts are expressions."""
    return conform(rows.selectExpr("book_id", "page", f"{ts} AS ts", f"{event} AS event", f"to_json(struct({', '.join(payload) or 'page'})) AS payload"), "events")


def profiles(images: DataFrame, *analysis: str) -> DataFrame:
    """Triage: images(book_id, page, content, original_path, processed_path, width, height, dpi) with the analysis columns as JSON."""
    got = images.selectExpr("*", "sha2(content, 256) AS source_sha256", "original_path <> processed_path AS preprocessing_applied", f"to_json(struct({', '.join(analysis)})) AS analysis")
    return conform(got, "profiles")


def layouts(pages: DataFrame) -> DataFrame:
    """pages(book_id, page, provider, layout_warnings, regions), as layout.apply_layout gives them."""
    return conform(pages.withColumnRenamed("layout_warnings", "warnings"), "layouts")


def candidates(scored: DataFrame, processing_pass: int) -> DataFrame:
    """A reading with its report and evidence, and the name it is stored under (artifact). Tags in the text make its format html."""
    counted = scored.selectExpr("*", f"map({_COUNTERS}) AS evidence")
    got = counted.selectExpr("*", f"{processing_pass} AS processing_pass", "engine AS engine_name", "version AS engine_version", "confidence AS native_confidence", f"IF({evidence.has_html('text')}, 'html', 'text') AS output_format")
    name = evidence.artifact_name("processing_pass", "engine_name")
    return conform(got, "candidates").withColumn("artifact", F.expr(name))


_COUNTED = ("character_count", "line_count", "region_count", "punctuation_count", "digit_count", "latin_count", "html_tag_count")
_COUNTERS = ", ".join(f"{c!r}, CAST({c} AS double)" for c in _COUNTED)


def decisions(routed: DataFrame) -> DataFrame:
    """routed(book_id, page, action, status, selected_engine, processing_pass, reasons, candidates)."""
    return conform(routed, "decisions")


def manifest(books: DataFrame, engine_versions: DataFrame, config_hash: str, version: str, ts: str = "current_timestamp()") -> DataFrame:
    """books(book_id, title, source_path, source_sha256, page_count), engine_versions(book_id, engine, version) -> one row a book."""
    used = engine_versions.groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("engine", "version")))).alias("engine_versions"))
    got = books.join(used, "book_id", "left").selectExpr("*", "2 AS schema_version", f"'{version}' AS pipeline_version", f"'{config_hash}' AS config_hash", f"{ts} AS finalized_at")
    return conform(got, "manifests")


def bundle(pages: DataFrame, **kinds: DataFrame) -> DataFrame:
    """pages(book_id, page) with, for each kind, the records of the page as one array of structs in the order of their columns."""
    parts = [df.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c not in KEY]))).alias(k)) for k, df in kinds.items()]
    return reduce(lambda a, b: a.join(b, KEY, "left"), parts, pages)


def audit(books: DataFrame, **reports: DataFrame) -> DataFrame:
    """books(book_id) with each report's row of a book as JSON; null where it has none."""
    parts = [df.select("book_id", F.to_json(F.struct(*[c for c in df.columns if c != "book_id"])).alias(k)) for k, df in reports.items()]
    return reduce(lambda a, b: a.join(b, "book_id", "left"), parts, books.select("book_id"))


def status_lines(progress: DataFrame, failed: DataFrame, most: int = 10) -> DataFrame:
    """What a console shows of a book: one line a status, the total, and its first failed pages by number."""
    nth = F.expr(f"slice(array_sort(collect_list(named_struct('page', page, 'line', concat('  page ', page, ': ', coalesce(last_error, 'None'), ' (retries: ', retry_count, ')')))), 1, {most})")
    bad = _first(failed, "page", most).groupBy("book_id").agg(nth.alias("bad"))
    per = progress.groupBy("book_id").agg(F.expr("array_sort(collect_list(concat(status, ' ', pages)))").alias("by"), F.max("total_pages").alias("total"))
    n = failed.groupBy("book_id").agg(F.count("*").alias("n"))
    got = per.join(bad, "book_id", "left").join(n, "book_id", "left")
    return got.selectExpr("book_id", "array_join(concat(by, array(concat('Total pages: ', total)), IF(n IS NULL, array(), concat(array(concat(n, ' failed page(s):')), transform(bad, b -> b.line)))), '\n') AS report")


def _first(df: DataFrame, by: str, most: int) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy("book_id").orderBy(by))).where(f"_n <= {most}").drop("_n")
