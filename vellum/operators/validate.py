"""Integrity checks of a book's log as rows (book_id, check, severity, detail); a book is valid if it has no error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FINAL_STATUS, in_list
from . import log as lg


def parse_log(lines: DataFrame, schema: str) -> DataFrame:
    """lines(book_id, seq, value) -> parsed columns and malformed: not JSON, or no integer page."""
    got = lines.where("trim(value) <> ''").select("book_id", "seq", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.expr("try_cast(get_json_object(value, '$.page') AS int)").alias("_page"))
    return got.selectExpr("book_id", "seq", "r.* EXCEPT (page)" if "page" in schema else "r.*", "_page AS page", "_page IS NULL AS malformed")


def violations(
    log: DataFrame, books: DataFrame, attempts: DataFrame | None = None, malformed: DataFrame | None = None, products: DataFrame | None = None, latest_attempts_only: bool = False, unreadable: DataFrame | None = None
) -> DataFrame:
    """log(book_id, page, seq, status), books(book_id, page_count), attempts, malformed(book_id, seq), products(book_id, name, size: null if there is none), unreadable(book_id, error: why its state can't be read)."""
    now = lg.latest(log.select("book_id", "page", "seq", "status"))
    row = lambda df, check, severity, detail: df.selectExpr("book_id", f"{check} AS check", f"'{severity}' AS severity", f"CAST({detail} AS string) AS detail")
    expected = books.selectExpr("book_id", "CAST(page_count AS int) AS page_count")
    pages = expected.where("page_count > 0").selectExpr("book_id", "explode(sequence(1, page_count)) AS page")
    parts = [
        row(pages.join(now, ["book_id", "page"], "left_anti"), "'missing_page'", "error", "page"),
        row(now.join(expected, "book_id").where("page < 1 OR page > page_count"), "'unexpected_page'", "error", "page"),
        row(now.where(f"status IS NULL OR status NOT IN {in_list(FINAL_STATUS)}"), "'non_final_status'", "error", "concat(page, ':', coalesce(status, 'null'))"),
        row(now.where("status = 'REVIEW_REQUIRED'"), "'review_required'", "warning", "page"),
        row(expected.join(log.select("book_id").distinct(), "book_id", "left_anti"), "'missing_log'", "error", "page_count"),
    ]
    if attempts is not None:
        parts.append(row(lg.stuck_attempts(attempts, latest_attempts_only), "'unfinished_attempt'", "error", "attempt_id"))
    if malformed is not None:
        parts.append(row(malformed, "'malformed_record'", "error", "seq"))
    if products is not None:
        parts.append(row(products.where("coalesce(size, 0) = 0"), "IF(size IS NULL, 'missing_product', 'empty_product')", "error", "name"))
    if unreadable is not None:
        parts.append(row(unreadable, "'unreadable_state'", "error", "error"))
    return reduce(DataFrame.unionByName, parts)


def report(found: DataFrame, books: DataFrame, most: int = 20) -> DataFrame:
    """book_id, valid, errors, warnings: the first `most` details of each severity. Only these are gathered; a book's other details are ranked out before."""
    line = found.selectExpr("book_id", "severity", "concat(check, ':', detail) AS line")
    first = line.withColumn("n", F.row_number().over(Window.partitionBy("book_id", "severity").orderBy("line"))).where(f"n <= {most}")
    per = first.groupBy("book_id").agg(*(F.expr(f"array_sort(collect_list(IF(severity = '{s}', line, NULL)))").alias(c) for s, c in (("error", "errors"), ("warning", "warnings"))))
    return books.select("book_id").join(per, "book_id", "left").selectExpr("book_id", "size(coalesce(errors, array())) = 0 AS valid", "coalesce(errors, array()) AS errors", "coalesce(warnings, array()) AS warnings")


def statistics(log: DataFrame, books: DataFrame, attempts: DataFrame | None = None, malformed: DataFrame | None = None) -> DataFrame:
    """One row a book: expected, canonical, superseded and malformed records, pages under review and unfinished attempts."""
    per_page = log.groupBy("book_id", "page").agg(F.count("*").alias("n"), F.max_by("status", "seq").alias("status"))
    got = per_page.groupBy("book_id").agg(F.count("*").alias("canonical_pages"), F.sum(F.col("n") - 1).alias("superseded_records"), F.count_if(F.col("status") == "REVIEW_REQUIRED").alias("review_pages"))
    out = books.selectExpr("book_id", "CAST(page_count AS bigint) AS expected_pages").join(got, "book_id", "left")
    for name, df in (("unfinished_attempts", attempts and lg.stuck_attempts(attempts)), ("malformed_records", malformed)):
        out = out.withColumn(name, F.lit(0)) if df is None else out.join(df.groupBy("book_id").agg(F.count("*").alias(name)), "book_id", "left")
    return out.na.fill(0)
