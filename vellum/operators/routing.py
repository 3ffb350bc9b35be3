"""Routing: what happens to a page after a reading, and which of two readings becomes canonical."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import evidence


def action(processing_pass: str, tier: str, html_tags: str, disagreement: str, escalation: bool = True, limit: float = 0.35) -> str:
    return (
        f"CASE WHEN coalesce({html_tags}, 0) > 0 THEN 'flag_for_review' WHEN {processing_pass} > 1 AND coalesce({disagreement}, 0) > {limit}D THEN 'flag_for_review' "
        f"WHEN {tier} IN ('HIGH', 'MEDIUM') THEN 'accept' WHEN {processing_pass} = 1 AND {str(escalation).lower()} THEN 'reprocess_local' ELSE 'flag_for_review' END"
    )


def status(act: str) -> str:
    return f"CASE {act} WHEN 'accept' THEN 'COMPLETED' WHEN 'reprocess_local' THEN 'LOW_CONFIDENCE' ELSE 'REVIEW_REQUIRED' END"


def route(pages: DataFrame, processing_pass: int = 1, escalation: bool = True, limit: float = 0.35) -> DataFrame:
    """pages(tier, html_tag_count, normalized_disagreement where pass > 1) plus action and status."""
    gap = "normalized_disagreement" if "normalized_disagreement" in pages.columns else "0D"
    return pages.selectExpr("*", f"{action(str(processing_pass), 'tier', 'html_tag_count', gap, escalation, limit)} AS action").selectExpr("*", f"{status('action')} AS status")


def adjudicate(first: DataFrame, second: DataFrame, limit: float = 0.35) -> DataFrame:
    """One row a page of first that was to be reprocessed: the second reading if it is accepted, else the first one for review.

    first, second: (book_id, page, text, score, tier, warnings, html_tag_count, engine); second also error, null unless it
    failed. Their columns confidence and regions, where there are any, go with the reading that is chosen.
    """
    extra = [c for c in ("confidence", "regions") if c in first.columns and c in second.columns]
    a = first.selectExpr("book_id", "page", "text AS t1", "score AS s1", "tier AS r1", "warnings AS w1", "engine AS e1", *(f"{c} AS {c}_1" for c in extra))
    b = second.selectExpr("book_id", "page", "text AS t2", "score AS s2", "tier AS r2", "warnings AS w2", "engine AS e2", "html_tag_count AS h2", "error", *(f"{c} AS {c}_2" for c in extra))
    long = f"error IS NULL AND t1 <> t2 AND CAST(char_length(t1) AS bigint) * char_length(t2) >= {evidence.LONG}"
    both = a.join(b, ["book_id", "page"]).selectExpr("*", f"IF({long}, t1, NULL) AS _a", f"IF({long}, t2, NULL) AS _b")
    both = both.withColumn("_d", evidence.edit_distance("_a", "_b")).drop("_a", "_b")  # null but for long texts
    gap = f"IF(_d IS NULL, {evidence.disagreement('t1', 't2')}, _d / greatest(char_length(t1), char_length(t2)))"
    both = both.selectExpr("*", f"IF(error IS NULL, {gap}, NULL) AS normalized_disagreement")
    both = both.selectExpr("*", f"IF(error IS NULL, {action('2', 'r2', 'h2', 'normalized_disagreement', True, limit)}, 'flag_for_review') AS action").selectExpr("*", "action = 'accept' AS ok")
    failed = "concat('escalation_failed:', substring_index(error, ':', 1))"
    return both.selectExpr(
        "book_id", "page", "IF(ok, t2, t1) AS text", "IF(ok, s2, s1) AS score", "IF(ok, r2, r1) AS tier", "IF(ok, e2, e1) AS engine", "2 AS processing_pass", "action", "IF(ok, 'COMPLETED', 'REVIEW_REQUIRED') AS status",
        "normalized_disagreement", f"CASE WHEN ok THEN w2 WHEN error IS NOT NULL THEN array_append(w1, {failed}) ELSE array_append(w1, 'second_engine_not_safely_accepted') END AS warnings",
        *(f"IF(ok, {c}_2, {c}_1) AS {c}" for c in extra), "error",
    )
