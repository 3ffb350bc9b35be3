"""Append-only logs and the views that stand for a state store. seq is the order of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FINAL_STATUS, TRANSITIONS, in_list

KEY = ("book_id", "page")


def latest(log: DataFrame, key=KEY) -> DataFrame:
    """The last record of each key: one aggregate that is reduced in each task, no sort; the same form works on streams."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*key, "r.*")


def superseded(log: DataFrame) -> DataFrame:
    """One row: superseded, the records that a later one of the same page replaced."""
    return log.groupBy(*KEY).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("superseded"))


def pending(log: DataFrame, force: bool = False) -> DataFrame:
    """Pages whose latest status is not final; with force all of them."""
    now = latest(log).select(*KEY, "status")
    return now if force else now.where(f"status NOT IN {in_list(FINAL_STATUS)} OR status IS NULL")


def progress(log: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """book_id, status, pages and, with books(book_id, page_count), total_pages (0 for an unknown book)."""
    out = latest(log).groupBy("book_id", "status").agg(F.count("*").alias("pages"))
    if books is None:
        return out
    return out.join(books.select("book_id", "page_count"), "book_id", "left").select("book_id", "status", "pages", F.coalesce(F.col("page_count").cast("bigint"), F.lit(0)).alias("total_pages"))


def retries(log: DataFrame) -> DataFrame:
    return log.groupBy(*KEY).agg(F.count_if(F.col("status") == "FAILED").alias("retry_count"))


def failed(log: DataFrame) -> DataFrame:
    return latest(log).where("status = 'FAILED'").join(retries(log), list(KEY)).select(*KEY, "last_error", "retry_count")


def coalesced_state(log: DataFrame) -> DataFrame:
    """Current state: the last value that isn't null of tier, confidence, engine and pass; the last error as it is, null or not."""
    keep = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("tier", "confidence", "engine_used", "processing_pass")]
    return log.groupBy(*KEY).agg(F.max_by("status", "seq").alias("status"), *keep, F.max_by("last_error", "seq").alias("last_error"), F.count_if(F.col("status") == "FAILED").alias("retry_count"))


def state_history(log: DataFrame) -> DataFrame:
    """The coalesced state after each record."""
    w = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return log.select(*KEY, "seq", "status", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in ("tier", "confidence", "engine_used", "processing_pass")), "last_error")


def illegal_transitions(log: DataFrame) -> DataFrame:
    legal = ", ".join(f"'{a}>{b}'" for a, bs in TRANSITIONS.items() for b in bs)
    w = Window.partitionBy(*KEY).orderBy("seq")
    return log.select(*KEY, "seq", F.lag("status").over(w).alias("before"), "status").where(f"before IS NOT NULL AND before <> status AND concat(before, '>', status) NOT IN ({legal})")


def seed(books: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """PENDING rows for pages 1..page_count that known(book_id, page) lacks."""
    rows = books.where("page_count > 0").selectExpr("book_id", "explode(sequence(1, page_count)) AS page", "'PENDING' AS status")
    return rows if known is None else rows.join(known.select(*KEY), list(KEY), "left_anti")


def register(known: DataFrame, new: dict) -> dict:
    """The row to append for a book. known: its earlier rows with seq; raises if path, page count, fingerprint or hash differ."""
    old = known.where(F.col("book_id") == new["book_id"]).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("source_path", "page_count", "source_fingerprint", "source_sha256"))).first()
    for c in ("source_path", "page_count", "source_fingerprint", "source_sha256"):
        if old[c] is not None and new.get(c) is not None and old[c] != new[c]:
            raise ValueError(f"book {new['book_id']}: {c} was {old[c]}, not {new[c]}")
    return new | {c: old[c] if old[c] is not None else new.get(c) for c in ("source_fingerprint", "source_sha256")}


def stuck_attempts(attempts: DataFrame, only_latest: bool = False) -> DataFrame:
    """Attempts still PROCESSING; only_latest leaves out those that a later attempt of the page and pass replaced."""
    if only_latest:
        attempts = attempts.groupBy("book_id", "page", "processing_pass").agg(F.max_by(F.struct("attempt_id", "status"), "attempt_id").alias("r")).select("book_id", "page", "processing_pass", "r.*")
    return attempts.where("status = 'PROCESSING'").select("attempt_id", "book_id", "page", "processing_pass")


def begin_attempts(pages: DataFrame, known: DataFrame, processing_pass: int, engine: str, ts: str = "current_timestamp()") -> DataFrame:
    """Opening rows of attempts at pages(book_id, page), numbered on from known(attempt_id).

    Numbers rise by book, page within a task's range only, as no more is needed of them than that they are new.
    """
    last = known.agg(F.max("attempt_id")).first()[0] or 0
    got = pages.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    return got.select((F.monotonically_increasing_id() + 1 + last).alias("attempt_id"), *KEY, F.lit(processing_pass).alias("processing_pass"), F.lit(engine).alias("engine_used"), F.lit("PROCESSING").alias("status"), F.expr(ts).alias("started_at"))


def finish_attempts(attempts: DataFrame, results: DataFrame, ts: str = "current_timestamp()") -> DataFrame:
    """Closing rows for results(attempt_id, status, error, artifact) of known attempts; others are left out."""
    keys = attempts.groupBy("attempt_id").agg(*(F.first(c).alias(c) for c in (*KEY, "processing_pass", "engine_used")))
    return results.join(keys, "attempt_id").select("attempt_id", *KEY, "processing_pass", "engine_used", "status", F.expr(ts).alias("completed_at"), "error", "artifact")


def resolve_attempts(opened: DataFrame, closed: DataFrame) -> DataFrame:
    """One row an attempt: a closing row's status, error and artifact (the last one's by completed_at), else PROCESSING."""
    end = closed.groupBy("attempt_id").agg(F.max_by(F.struct("status", "completed_at", "error", "artifact"), "completed_at").alias("end"))
    got = opened.join(end, "attempt_id", "left")
    return got.selectExpr("attempt_id", *KEY, "processing_pass", "engine_used", "coalesce(end.status, status) AS status", "started_at", "end.completed_at", "end.error", "end.artifact")


def page_attempts(attempts: DataFrame, book_id: str, page: int) -> DataFrame:
    """One page's attempts in their order."""
    return attempts.where((F.col("book_id") == book_id) & (F.col("page") == page)).orderBy("attempt_id")


def books_now(books: DataFrame) -> DataFrame:
    """Books from the rows of their log: the first fingerprint and hash that were known, the last of everything else."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("source_fingerprint", "source_sha256")]
    last = [F.max_by(c, "seq").alias(c) for c in ("source_path", "page_count", "pipeline_version", "config_hash", "status")]
    return books.groupBy("book_id").agg(*first, *last)


def book_status(report: DataFrame, ts: str = "current_timestamp()") -> DataFrame:
    """report(book_id, valid, review_pages) -> book_id, status, completed_at, which only a book has that is done."""
    got = report.selectExpr("book_id", "CASE WHEN NOT valid THEN 'FAILED_VALIDATION' WHEN review_pages > 0 THEN 'REVIEW_REQUIRED' ELSE 'COMPLETED' END AS status")
    return got.selectExpr("book_id", "status", f"IF(status = 'FAILED_VALIDATION', NULL, {ts}) AS completed_at")


def migrate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null."""
    return old.unionByName(new, allowMissingColumns=True)
