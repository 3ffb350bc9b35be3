"""Page records from the tables at hand: documents as pages, their lines as regions, events as a page log.

The mappings stand in for recognised books. A page's number is its doc_id, so no book has to be sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

#: Pages in the expected script, so that rules on it see some: (page, text, confidence).
SCRIPT_PAGES = (
    (1, "كان الولد في البيت مع أخيه، ثم قال له: هذا كتاب قديم من المدرسة.\nلم يكن في الغرفة غير كرسي صغير و نافذة.\nقالت الأم إن المطر قد توقف عند الظهر.", 91.5),
    (2, "هل من أحد هنا؟ لا أحد على الطريق.", None),
    (3, "نعم نعم نعم نعم " * 8, 95.0),
    (4, "سطر\nسطر\nسطر\nآخر من على هذا", 70.0),
    (5, "□□■■ ÆØÅ ¤¤¤ ¶¶¶ §§§§ ±±±±", 20.0),
    (6, "٣١", 60.0),
    (7, "", None),
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Labels (two numbers each) that are sent to every task; more of them meet the texts by a shuffle.
SENT = 4_000_000


def pages(spark: SparkSession, sf_dir: str, script_pages: bool = True) -> DataFrame:
    """book_id, page, text, confidence. Confidence comes from labels (1: 92, 0: 48), null where there is none.

    Labels are counted, as Spark's own limit may be low and texts are a thousand times the size of what a shuffle would bring them.
    """
    labels = read(spark, sf_dir, "labels").selectExpr("doc_id", "CASE quality WHEN 1 THEN 92D WHEN 0 THEN 48D END AS confidence")
    labels = F.broadcast(labels) if labels.count() <= SENT else labels
    out = read(spark, sf_dir, "documents").select("doc_id", "source", "text").join(labels, "doc_id", "left").selectExpr("source AS book_id", "doc_id AS page", "text", "confidence")
    if script_pages:
        out = out.unionByName(spark.createDataFrame([("script", p, x, c) for p, x, c in SCRIPT_PAGES], "book_id string, page bigint, text string, confidence double"))
    return out


def with_regions(pages: DataFrame, height: int = 1000) -> DataFrame:
    """pages plus page_height and regions: one a line, three to a row of the page; a row's lines lie at its lower end, its number of characters is a line's width."""
    unit = f"({height}D / greatest(1, (size(ls) + 2) div 3))"
    top = f"((i div 3) + 0.9D + (i % 3) / 100D) * {unit}"
    region = (
        "struct(CASE WHEN l LIKE '#%' THEN 'heading' WHEN i = 0 AND char_length(l) < 12 THEN 'header' ELSE 'body' END AS kind, CAST((i * 37) % 100 AS double) AS x0, "
        f"{top} AS y0, (i * 37) % 100 + char_length(l) + 0D AS x1, {top} + 0.08D * {unit} AS y1, l AS text, CAST(NULL AS double) AS confidence, CAST(NULL AS int) AS reading_order)"
    )
    return pages.selectExpr("*", f"{height} AS page_height", t.let("ls", "split(text, '\\n')", f"transform(ls, (l, i) -> {region})") + " AS regions")


#: The status that an event stands for.
STATUS = {"signup": "PENDING", "click": "PROCESSING", "view": "COMPLETED", "purchase": "REVIEW_REQUIRED", "error": "FAILED"}


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log(read(spark, sf_dir, "events"))


def as_log(events: DataFrame) -> DataFrame:
    """Events as a page log: page is the user, seq the event; works on streams, too."""
    status = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"
    return events.selectExpr(
        "concat('book', user_id % 5) AS book_id", "user_id AS page", "event_id AS seq", f"{status} AS status", "IF(event_type = 'view', value, NULL) AS confidence",
        "CASE WHEN event_type = 'view' AND value > 50 THEN 'HIGH' WHEN event_type = 'view' THEN 'MEDIUM' END AS tier", "IF(event_type IN ('view', 'purchase'), 'primary', NULL) AS engine_used",
        "IF(event_type = 'purchase', 2, IF(event_type = 'view', 1, NULL)) AS processing_pass", "IF(event_type = 'error', concat('error ', event_id), NULL) AS last_error",
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_log(spark, sf_dir).selectExpr("seq AS attempt_id", "book_id", "page", "coalesce(processing_pass, 1) AS processing_pass", "status")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five books whose page_count is their greatest page, and two pages more in book 3."""
    return page_log(spark, sf_dir).groupBy("book_id").agg(F.max("page").alias("m")).selectExpr("book_id", "CAST(m + IF(book_id = 'book3', 2, 0) AS int) AS page_count")


def reading_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn that follows, if any: (book_id, page, font, reference, hypothesis)."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    a, b = c.where("role = 'user'").alias("a"), c.where("role = 'assistant'").alias("b")
    return a.join(b, F.expr("a.conv_id = b.conv_id AND a.turn + 1 = b.turn"), "left").selectExpr("concat('c', a.conv_id % 7) AS book_id", "a.conv_id * 100 + a.turn AS page", "concat('font', a.conv_id % 5) AS font", "a.text AS reference", "b.text AS hypothesis")
