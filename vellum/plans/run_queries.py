"""Registered queries over the records of a run: logs, attempts, books, artifacts, images, engines and settings, and their SQL."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import functions as F

from .. import settings
from ..functions import image
from ..functions import text as t
from ..functions import metrics, quality
from ..operators import artifacts, engines, layout, log, ordering, render, validate
from ..sources import files, pdf, synthetic, tables, text_layer
from ..streaming import log as slog
from . import queries as base
from . import two_pass
from .queries import _SP, _WITH_BODY, LOG, PAGES, REGIONS, SIGNALS, VIOLATIONS, query, work_folder

_NOW = "timestamp'2024-01-01'"

# Sources and files ----------------------------------------------------------------------------------------------------


@query(f"""WITH {PAGES}, {REGIONS} SELECT book_id, page, row_number() OVER (PARTITION BY book_id, page ORDER BY i // 3, x0 DESC, i) - 1 AS pos, round(x0 * 2, 6) AS x0, round(y0 * 2, 6) AS y0, trim(text, {_SP}) AS text
  FROM regions_ WHERE trim(text, {_SP}) <> ''""")
def text_layer_extract(spark, sf_dir):
    """Blocks of the size of a region, in points, on a raster of twice the size."""
    blocks = "transform(regions, r -> struct(r.x0 AS x0, r.y0 AS y0, r.x1 AS x1, r.y1 AS y1, r.text AS text))"
    p = tables.with_regions(tables.pages(spark, sf_dir)).selectExpr("book_id", "page", f"{blocks} AS blocks", "500 AS page_width", "1000 AS page_height", "1000 AS raster_width", "2000 AS raster_height")
    got = text_layer.extract(p).selectExpr("book_id", "page", "posexplode(regions) AS (pos, r)")
    return got.selectExpr("book_id", "page", "CAST(pos AS bigint) AS pos", "round(r.x0, 6) AS x0", "round(r.y0, 6) AS y0", "r.text")


def _written_log(spark, sf_dir):
    folder = f"{work_folder(spark, 'log')}/pages.jsonl"
    rows = tables.page_log(spark, sf_dir).select("book_id", "page", "seq", "status", "tier", "confidence")
    for part in (0, 1):
        files.append_log(rows.where(f"seq % 2 = {part}"), folder)
    return folder


@query(f"WITH {LOG} SELECT book_id, CAST(page AS INTEGER) AS page, seq, status, tier, confidence FROM log_")
def log_roundtrip(spark, sf_dir):
    """A log that is appended in two goes and read strictly."""
    return files.read_log(spark, _written_log(spark, sf_dir)).select("book_id", "page", "seq", "status", "tier", "confidence")


@query(f"WITH {LOG} SELECT CAST(page AS INTEGER) AS page, book_id, seq, status FROM now_ WHERE page = 7")
def point_lookup(spark, sf_dir):
    return files.page_of(files.read_log(spark, _written_log(spark, sf_dir)), 7).select("page", "book_id", "seq", "status")


@query("SELECT count(*) AS n FROM events")
def event_total(spark, sf_dir):
    return spark.createDataFrame([(files.event_count(spark, _written_log(spark, sf_dir)),)], "n bigint")


@query("SELECT row_number() OVER (ORDER BY event_id) AS line, CASE WHEN event_id % 10 NOT IN (3, 7) THEN CAST(user_id AS INTEGER) ELSE -1 END AS page, event_id % 10 IN (3, 7) AS malformed FROM events")
def tolerant_log(spark, sf_dir):
    """Some lines are torn, some have no page; all are found under their line number."""
    folder = work_folder(spark, "torn")
    whole = "to_json(struct(CAST(user_id AS int) AS page, event_id AS seq))"
    line = f"CASE event_id % 10 WHEN 3 THEN left({whole}, 6) WHEN 7 THEN '{{\"seq\": 1}}' ELSE {whole} END AS value"
    tables.read(spark, sf_dir, "events").repartition(1).sortWithinPartitions("event_id").selectExpr(line).write.text(f"{folder}/log")
    got = files.read_log(spark, f"{folder}/log", strict=False)
    return got.selectExpr("_line AS line", "IF(_malformed IS NULL, page, -1) AS page", "_malformed IS NOT NULL AS malformed")


@query("SELECT n_name || '.txt' AS name, CAST(length(n_name) AS BIGINT) AS length, sha256(n_name) AS sha256, true AS has_fingerprint FROM nation")
def directory_scan(spark, sf_dir):
    folder = work_folder(spark, "scan")
    for r in tables.read(spark, sf_dir, "nation").collect():
        os.makedirs(f"{folder}/{r.n_regionkey}", exist_ok=True)
        files.write_atomically(f"{folder}/{r.n_regionkey}/{r.n_name}.txt", r.n_name)
    return files.scan(spark, folder, "*.txt").selectExpr("substring_index(path, '/', -1) AS name", "length", "sha256", "length(fingerprint) = 64 AS has_fingerprint")


@query("SELECT n_name || '.pdf' AS name, n_regionkey < 4 AS readable, CASE WHEN n_regionkey < 4 THEN n_regionkey + 1 ELSE 0 END AS page_count FROM nation")
def pdf_counts(spark, sf_dir):
    """Scans of one to four pages; the last region's files are torn."""
    return pdf.counts(_pdfs(spark, sf_dir)).selectExpr("substring_index(path, '/', -1) AS name", "readable", "page_count")


@query("""SELECT n_name || '.pdf' AS name, CAST(p AS INTEGER) AS page, CASE WHEN n_regionkey < 4 AND p <= n_regionkey + 1 THEN 4 ELSE 0 END AS width, CASE WHEN n_regionkey < 4 AND p <= n_regionkey + 1 THEN 2 ELSE 0 END AS height,
  CASE WHEN n_regionkey < 4 AND p <= n_regionkey + 1 THEN repeat(lower(lpad(printf('%X', CAST(n_nationkey * 5 + p AS INTEGER)), 2, '0')), 8) END AS pixels,
  CASE WHEN n_regionkey = 4 THEN 'ValueError' WHEN p > n_regionkey + 1 THEN 'IndexError' END AS error FROM nation, range(1, 4) r(p)""")
def pdf_rasters(spark, sf_dir):
    """Three pages of each file, at the resolution they were written at; those that a file lacks are errors."""
    got = _pdfs(spark, sf_dir)
    pages = got.select("path", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("page"))
    return pdf.render(got, pages, 300).selectExpr("substring_index(path, '/', -1) AS name", "page", "width", "height", "lower(hex(data)) AS pixels", "substring_index(error, ':', 1) AS error")


def _pdfs(spark, sf_dir):
    folder = work_folder(spark, "pdf")

    def write(batches):
        for b in batches:
            for name, nation, region in zip(b["n_name"], b["n_nationkey"], b["n_regionkey"]):
                data = pdf.write([image.np.full((2, 4), nation * 5 + p) for p in range(1, region + 2)])
                with open(f"{folder}/{name}.pdf", "wb") as f:
                    f.write(data if region < 4 else data[:40])
            yield pd.DataFrame({"n": [len(b)]})

    tables.read(spark, sf_dir, "nation").mapInPandas(write, "n bigint").collect()
    return spark.read.format("binaryFile").load(folder)


@query("""SELECT n_name || '.png' AS name, CASE WHEN n_regionkey < 4 THEN 4 ELSE -1 END AS width, CASE WHEN n_regionkey < 4 THEN 2 ELSE -1 END AS height, CASE WHEN n_regionkey < 4 THEN repeat(lower(lpad(printf('%X', CAST(n_nationkey * 5 AS INTEGER)), 2, '0')), 8) END AS pixels FROM nation""")
def image_load(spark, sf_dir):
    """Gray PNG files; the last region's are torn, which gives no pixels."""
    folder = work_folder(spark, "png")
    for r in tables.read(spark, sf_dir, "nation").collect():
        data = image.png(image.np.full((2, 4), r.n_nationkey * 5))
        with open(f"{folder}/{r.n_name}.png", "wb") as f:
            f.write(data if r.n_regionkey < 4 else data[:20])
    got = files.page_images(spark, folder)
    return got.selectExpr("substring_index(origin, '/', -1) AS name", "width", "height", "lower(hex(data)) AS pixels")


@query("SELECT * FROM (VALUES ('book.txt', CAST(length(chr(233) || 'done') + 1 AS BIGINT)), ('book.md', CAST(-1 AS BIGINT))) v(name, size)")
def product_files(spark, sf_dir):
    """One product is written, twice, and one is missing."""
    folder = work_folder(spark, "products")
    for text in ("first", "édone"):
        files.write_atomically(f"{folder}/book.txt", text)
    return spark.createDataFrame(files.products(folder), "name string, size bigint").selectExpr("name", "coalesce(size, -1) AS size")


@query("SELECT 'synthetic' || b AS book_id, CAST(p AS INTEGER) AS page, 20 AS n_lines, 23 AS n_regions, 2 AS n_stamps, true AS has_ink FROM range(5) x(b), range(1, 5) y(p)")
def synthetic_pages(spark, sf_dir):
    got = synthetic.pages(spark)
    stamps = ", ".join(f"'{s}'" for s in synthetic.STAMPS)
    return got.selectExpr("book_id", "page", "size(split(reference, '\\n')) AS n_lines", "size(regions) AS n_regions", f"size(filter(regions, r -> r.text IN ({stamps}))) AS n_stamps", "exists(regions, r -> r.x1 > r.x0) AS has_ink")


_SETTINGS = """gate.least_chars|80 gate.least_ratio|0.5 gate.least_words|12 gate.most_replaced|0.01 gate.prefer|true image.blank_below|0.002 image.contrast_below|40.0 image.least_angle|0.3 image.noise_above|0.15
run.escalate|false run.first_timeout_s|900.0 run.mode|"in_process" run.most_disagreement|0.35 run.second_timeout_s|3600.0 run.start_method|"spawn" rules.high|85.0 rules.low|30.0 rules.medium|60.0
rules.weights.engine_confidence|0.5 rules.weights.arabic_char_ratio|0.2 rules.weights.dictionary_hit_rate|0.15 rules.weights.length_anomaly|0.1 rules.weights.garbage_symbol_ratio|0.05
stamps.band|0.15 stamps.least_pages|3 stamps.least_share|0.3"""


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in (x.split("|") for x in _SETTINGS.split())) + ") v(name, value)")
def settings_rows(spark, sf_dir):
    """All numbers and switches of the settings, two of them overridden as on a command line."""
    got = settings.rows(settings.load(overrides={"rules.high": "85", "run.escalate": "false"}))
    return spark.createDataFrame([r for r in got if not r[0].startswith(("output.", "rules.script."))], "name string, value string")


# Logs, attempts, books ------------------------------------------------------------------------------------------------


@query(f"WITH {LOG} SELECT book_id, page, status FROM now_")
def pending_forced(spark, sf_dir):
    return log.pending(tables.page_log(spark, sf_dir), force=True)


def _attempts(spark, sf_dir):
    """Every third record opens an attempt; every sixth closes it."""
    rows = tables.page_log(spark, sf_dir)
    opened = rows.where("seq % 3 = 0").selectExpr("seq AS attempt_id", "book_id", "page", "1 AS processing_pass", "'primary' AS engine_used", "'PROCESSING' AS status", f"{_NOW} AS started_at")
    results = rows.where("seq % 6 = 0").selectExpr("seq AS attempt_id", "status", "last_error AS error", "concat('a', seq) AS artifact")
    return log.resolve_attempts(opened, log.finish_attempts(opened, results, _NOW))


_ATTEMPTS = "attempts_ AS (SELECT seq AS attempt_id, book_id, page, CASE WHEN seq % 6 = 0 THEN status ELSE 'PROCESSING' END AS status, CASE WHEN seq % 6 = 0 THEN last_error END AS error, CASE WHEN seq % 6 = 0 THEN 'a' || seq END AS artifact, seq % 6 = 0 AS done FROM log_ WHERE seq % 3 = 0)"


@query(f"WITH {LOG}, {_ATTEMPTS} SELECT * FROM attempts_")
def attempt_results(spark, sf_dir):
    return _attempts(spark, sf_dir).selectExpr("attempt_id", "book_id", "page", "status", "error", "artifact", "completed_at IS NOT NULL AS done")


@query(f"WITH {LOG}, {_ATTEMPTS} SELECT attempt_id, status, artifact FROM attempts_ WHERE book_id = 'book2' AND page = 7")
def page_attempts(spark, sf_dir):
    return log.page_attempts(_attempts(spark, sf_dir), "book2", 7).select("attempt_id", "status", "artifact")


@query(f"WITH {LOG} SELECT book_id, page, 2 AS processing_pass, 'second' AS engine_used, 'PROCESSING' AS status, true AS is_new, true AS is_distinct FROM now_ WHERE status NOT IN ('COMPLETED', 'BLANK', 'REVIEW_REQUIRED')")
def begun_attempts(spark, sf_dir):
    rows = tables.page_log(spark, sf_dir)
    known = rows.selectExpr("seq AS attempt_id")
    got = log.begin_attempts(log.pending(rows).select("book_id", "page"), known, 2, "second", _NOW)
    last = known.agg(F.max("attempt_id").alias("last"))
    n = got.groupBy("attempt_id").agg(F.count("*").alias("n"))
    return got.join(n, "attempt_id").crossJoin(F.broadcast(last)).selectExpr("book_id", "page", "processing_pass", "engine_used", "status", "attempt_id > last AS is_new", "n = 1 AS is_distinct")


_BOOK_LOG = """blog_ AS (SELECT 'book' || CAST(user_id % 5 AS VARCHAR) AS book_id, event_id AS seq, 'p' || CAST(user_id % 5 AS VARCHAR) AS source_path, CASE WHEN event_type = 'view' THEN 'f' || event_id END AS source_fingerprint,
  CASE WHEN event_type = 'error' THEN 'h' || event_id END AS source_sha256, CAST(event_id % 9 AS INTEGER) AS page_count, 'v' || event_id AS pipeline_version FROM events)"""


@query(f"WITH {_BOOK_LOG} SELECT book_id, arg_min(source_fingerprint, seq) FILTER (source_fingerprint IS NOT NULL) AS source_fingerprint, arg_min(source_sha256, seq) FILTER (source_sha256 IS NOT NULL) AS source_sha256, arg_max(source_path, seq) AS source_path, arg_max(page_count, seq) AS page_count, arg_max(pipeline_version, seq) AS pipeline_version FROM blog_ GROUP BY book_id")
def registered_books(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "events").selectExpr(
        "concat('book', user_id % 5) AS book_id", "event_id AS seq", "concat('p', user_id % 5) AS source_path", "IF(event_type = 'view', concat('f', event_id), NULL) AS source_fingerprint",
        "IF(event_type = 'error', concat('h', event_id), NULL) AS source_sha256", "CAST(event_id % 9 AS int) AS page_count", "concat('v', event_id) AS pipeline_version", "'c' AS config_hash", "'PROCESSING' AS status",
    )
    return log.books_now(rows).select("book_id", "source_fingerprint", "source_sha256", "source_path", "page_count", "pipeline_version")


@query(f"WITH {LOG} SELECT book_id, page, seq, status, CASE WHEN seq % 2 = 0 THEN tier END AS tier FROM log_")
def migrated_log(spark, sf_dir):
    """Records of an old log that has no tier, and of a new one that has."""
    rows = tables.page_log(spark, sf_dir).select("book_id", "page", "seq", "status", "tier")
    return log.migrate(rows.where("seq % 2 = 1").drop("tier"), rows.where("seq % 2 = 0"))


def _review(spark, sf_dir):
    rows, books = tables.page_log(spark, sf_dir), tables.books(spark, sf_dir)
    extra = books.unionByName(spark.createDataFrame([("book9", 4)], "book_id string, page_count int"))
    malformed = spark.createDataFrame([("book1", 12)], "book_id string, seq bigint")
    products = spark.createDataFrame([("book0", "book.txt", None), ("book0", "book.md", 5), ("book2", "book.md", 0)], "book_id string, name string, size bigint")
    unreadable = spark.createDataFrame([("book4", "file is not a database")], "book_id string, error string")
    return rows, extra, malformed, products, unreadable


_EXTRA = "extra_ AS (SELECT * FROM (VALUES ('book9', 'missing_page', 'error', '1'), ('book9', 'missing_page', 'error', '2'), ('book9', 'missing_page', 'error', '3'), ('book9', 'missing_page', 'error', '4'), ('book9', 'missing_log', 'error', '4'), ('book1', 'malformed_record', 'error', '12'), ('book0', 'missing_product', 'error', 'book.txt'), ('book2', 'empty_product', 'error', 'book.md'), ('book4', 'unreadable_state', 'error', 'file is not a database')) v(book_id, \"check\", severity, detail))"


@query(f"WITH {LOG}, {VIOLATIONS}, {_EXTRA} SELECT * FROM bad_ UNION ALL SELECT * FROM extra_")
def validation_of_all_kinds(spark, sf_dir):
    rows, books, malformed, products, unreadable = _review(spark, sf_dir)
    return validate.violations(rows, books, tables.attempts(spark, sf_dir), malformed, products, unreadable=unreadable)


_STATISTICS = """stats_ AS (SELECT b.book_id, CAST(b.page_count AS BIGINT) AS expected_pages, coalesce(n.pages, 0) AS canonical_pages, CAST(coalesce(l.records, 0) - coalesce(n.pages, 0) AS BIGINT) AS superseded_records, coalesce(n.review, 0) AS review_pages,
  coalesce(l.open, 0) AS unfinished_attempts, CASE WHEN b.book_id = 'book1' THEN 1 ELSE 0 END::BIGINT AS malformed_records
  FROM (SELECT * FROM books_ UNION ALL SELECT 'book9', 4) b LEFT JOIN (SELECT book_id, count(*) AS pages, count(*) FILTER (status = 'REVIEW_REQUIRED') AS review FROM now_ GROUP BY ALL) n USING (book_id)
  LEFT JOIN (SELECT book_id, count(*) AS records, count(*) FILTER (status = 'PROCESSING') AS open FROM log_ GROUP BY ALL) l USING (book_id))"""


def _statistics(spark, sf_dir):
    rows, books, malformed, *_ = _review(spark, sf_dir)
    return validate.statistics(rows, books, tables.attempts(spark, sf_dir), malformed)


@query(f"WITH {LOG}, {_STATISTICS} SELECT * FROM stats_")
def validation_statistics(spark, sf_dir):
    return _statistics(spark, sf_dir)


@query(f"WITH {LOG}, {_STATISTICS} SELECT book_id, CASE WHEN malformed_records > 0 THEN 'FAILED_VALIDATION' WHEN review_pages > 0 THEN 'REVIEW_REQUIRED' ELSE 'COMPLETED' END AS status, malformed_records = 0 AS done FROM stats_")
def book_status(spark, sf_dir):
    """Here a book is valid if its log has no malformed record."""
    return log.book_status(_statistics(spark, sf_dir).selectExpr("book_id", "malformed_records = 0 AS valid", "review_pages"), _NOW).selectExpr("book_id", "status", "completed_at IS NOT NULL AS done")


# Records of a run -----------------------------------------------------------------------------------------------------


@query("""SELECT 'book' || CAST(user_id % 5 AS VARCHAR) AS book_id, CAST(user_id AS INTEGER) AS page, 'page_' || event_type AS event, '{"event_type":"' || event_type || '","event_id":' || event_id || '}' AS payload FROM events""")
def lifecycle_events(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "events").selectExpr("concat('book', user_id % 5) AS book_id", "user_id AS page", "ts", "event_type", "event_id")
    return artifacts.events(rows, "concat('page_', event_type)", "event_type", "event_id", ts="ts").select("book_id", "page", "event", "payload")


@query("SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, count(*) AS n FROM events GROUP BY ALL")
def event_rate(spark, sf_dir):
    return slog.event_rate(tables.read(spark, sf_dir, "events")).selectExpr("event_type", "unix_timestamp(CAST(start AS timestamp)) AS start", "n")


@query("SELECT event_id, CAST(regexp_extract(props, ':\\s*([0-9]+)', 1) AS INTEGER) AS k FROM events")
def event_payload(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").selectExpr("event_id", "from_json(props, 'k int').k AS k")


@query("""SELECT source AS book_id, CAST(doc_id AS INTEGER) AS page, sha256(text) AS source_sha256, doc_id % 3 = 0 AS preprocessing_applied, '{"blank":' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"n":' || (doc_id % 7) || '}' AS analysis FROM documents""")
def triage_profiles(spark, sf_dir):
    images = tables.read(spark, sf_dir, "documents").selectExpr(
        "source AS book_id", "doc_id AS page", "text AS content", "concat(doc_id, '.png') AS original_path", "concat(doc_id, IF(doc_id % 3 = 0, '_pp.png', '.png')) AS processed_path", "10 AS width", "20 AS height", "300 AS dpi", "doc_id % 2 = 0 AS blank", "doc_id % 7 AS n"
    )
    return artifacts.profiles(images, "blank", "n").select("book_id", "page", "source_sha256", "preprocessing_applied", "analysis")


_LAID = f"""WITH {PAGES}, {REGIONS}, {base.ASSIGNED}, o_ AS (SELECT book_id, page, string_agg(text, chr(10) ORDER BY CASE WHEN page % 7 = 0 OR page % 50 = 0 THEN 0 ELSE ro END, i // 3, x0 DESC, i) AS t, count(*) AS n FROM kinds_ GROUP BY ALL)
SELECT book_id, CAST(page AS INTEGER) AS page, CASE WHEN page % 7 = 0 OR page % 50 = 0 THEN 'rtl-row-fallback' ELSE 'layout' END AS provider, CASE WHEN page % 50 = 0 THEN 'layout_detection_failed:TimeoutError' ELSE '' END AS warnings, CAST(n AS INTEGER) AS n_regions, md5(t) AS text_md5 FROM o_"""


@query(_LAID)
def layout_records(spark, sf_dir):
    """Pages without blocks and pages whose detector failed fall back to rows alone; the text follows."""
    p = tables.with_regions(tables.pages(spark, sf_dir)).withColumnRenamed("regions", "lines").selectExpr("book_id", "page", "lines", f"IF(page % 7 = 0, NULL, {base._BLOCKS}) AS blocks", "IF(page % 50 = 0, 'TimeoutError', NULL) AS e")
    got = artifacts.layouts(layout.apply_layout(p, error="e").drop("lines", "blocks", "e"))
    return got.selectExpr("book_id", "page", "provider", "array_join(warnings, '|') AS warnings", "size(regions) AS n_regions", f"md5({ordering.assemble('regions')}) AS text_md5")


@query(f"WITH {PAGES}, {REGIONS} SELECT book_id, page, CAST(count(*) AS INTEGER) AS n, md5(string_agg(text, chr(10) ORDER BY i)) AS text_md5 FROM regions_ WHERE y0 <= 0.85::DOUBLE * 1000 GROUP BY ALL")
def footer_band(spark, sf_dir):
    p = tables.with_regions(tables.pages(spark, sf_dir)).selectExpr("book_id", "page", f"{layout.drop_footer_band('regions', 'page_height')} AS r").where("size(r) > 0")
    return p.selectExpr("book_id", "page", "size(r) AS n", f"md5({ordering.assemble('r')}) AS text_md5")


def _candidates(spark, sf_dir):
    p = tables.with_regions(tables.pages(spark, sf_dir)).selectExpr("*", "'Primary OCR/v2' AS engine", "'1.0' AS version", "0D AS runtime_s")
    return artifacts.candidates(base.quality.score_pages(p.selectExpr("*", *base.evidence.counters(regions="size(regions)"))), 1)


@query(f"WITH {PAGES}, {SIGNALS} SELECT book_id, CAST(page AS INTEGER) AS page, 1 AS processing_pass, 'pass-1-Primary-OCR-v2.json' AS artifact, CASE WHEN html_tag_count > 0 THEN 'html' ELSE 'text' END AS output_format, tier, round(score, 6) AS score, len(regexp_extract_all(text, '[0-9٠-٩]'))::DOUBLE AS digits, confidence AS native_confidence FROM scored")
def candidate_records(spark, sf_dir):
    return _candidates(spark, sf_dir).selectExpr("book_id", "page", "processing_pass", "artifact", "output_format", "tier", "round(score, 6) AS score", "evidence['digit_count'] AS digits", "native_confidence")


@query(f"WITH {PAGES}, {SIGNALS} SELECT book_id, CAST(page AS INTEGER) AS page, CASE WHEN html_tag_count > 0 THEN 'flag_for_review' WHEN tier IN ('HIGH', 'MEDIUM') THEN 'accept' ELSE 'reprocess_local' END AS action, array_to_string(warnings, '|') AS reasons, 'pass-1-Primary-OCR-v2.json' AS candidates FROM scored")
def decision_records(spark, sf_dir):
    rows = _candidates(spark, sf_dir).selectExpr("*", "CAST(evidence['html_tag_count'] AS bigint) AS html_tag_count")
    routed = base.routing.route(rows, 1).selectExpr("*", "engine_name AS selected_engine", "warnings AS reasons", "array(artifact) AS candidates")
    return artifacts.decisions(routed).selectExpr("book_id", "page", "action", "array_join(reasons, '|') AS reasons", "array_join(candidates, '|') AS candidates")


@query(f"WITH {LOG} SELECT book_id, 2 AS schema_version, b.page_count, 'title ' || book_id AS title, coalesce(e.engines, '') AS engines FROM books_ b LEFT JOIN (SELECT book_id, string_agg(DISTINCT engine_used || '=1', ',') AS engines FROM log_ WHERE engine_used IS NOT NULL GROUP BY ALL) e USING (book_id)")
def manifests(spark, sf_dir):
    books = tables.books(spark, sf_dir).selectExpr("book_id", "page_count", "concat('title ', book_id) AS title")
    used = tables.page_log(spark, sf_dir).where("engine_used IS NOT NULL").selectExpr("book_id", "engine_used AS engine", "'1' AS version").distinct()
    got = artifacts.manifest(books, used, settings.fingerprint(settings.Settings()), "1.0", _NOW)
    return got.selectExpr("book_id", "schema_version", "page_count", "title", "coalesce(array_join(transform(map_entries(engine_versions), e -> concat(e.key, '=', e.value)), ','), '') AS engines")


@query(f"""WITH {LOG}, s_ AS (SELECT book_id, string_agg(status || ' ' || n, chr(10) ORDER BY status || ' ' || n) AS lines FROM (SELECT book_id, status, count(*) AS n FROM now_ GROUP BY ALL) GROUP BY ALL),
f_ AS (SELECT n.book_id, n.page, n.last_error, r.retries, row_number() OVER (PARTITION BY n.book_id ORDER BY n.page) AS k, count(*) OVER (PARTITION BY n.book_id) AS many
  FROM now_ n JOIN (SELECT book_id, page, count(*) FILTER (status = 'FAILED') AS retries FROM log_ GROUP BY ALL) r USING (book_id, page) WHERE n.status = 'FAILED'),
g_ AS (SELECT book_id, any_value(many) AS many, string_agg('  page ' || page || ': ' || last_error || ' (retries: ' || retries || ')', chr(10) ORDER BY page) AS bad FROM f_ WHERE k <= 10 GROUP BY ALL)
SELECT s_.book_id, lines || chr(10) || 'Total pages: ' || page_count || coalesce(chr(10) || many || ' failed page(s):' || chr(10) || bad, '') AS report FROM s_ JOIN books_ USING (book_id) LEFT JOIN g_ ON g_.book_id = s_.book_id""")
def status_report(spark, sf_dir):
    rows, books = tables.page_log(spark, sf_dir), tables.books(spark, sf_dir)
    return artifacts.status_lines(log.progress(rows, books), log.failed(rows))


@query(f"""WITH {LOG}, {_STATISTICS} SELECT book_id, '{{"expected_pages":' || expected_pages || ',"canonical_pages":' || canonical_pages || ',"superseded_records":' || superseded_records || '}}' AS statistics, CASE WHEN book_id <> 'book9' THEN '{{"title":"title ' || book_id || '"}}' END AS manifest FROM stats_""")
def audit_report(spark, sf_dir):
    stats = _statistics(spark, sf_dir)
    return artifacts.audit(stats, statistics=stats.select("book_id", "expected_pages", "canonical_pages", "superseded_records"), manifest=tables.books(spark, sf_dir).selectExpr("book_id", "concat('title ', book_id) AS title"))


@query(f"WITH {LOG}, {_ATTEMPTS} SELECT n.book_id, n.page, coalesce(string_agg(a.attempt_id || ':' || a.status, ',' ORDER BY attempt_id), '') AS attempts, n.status AS decision FROM now_ n LEFT JOIN attempts_ a USING (book_id, page) GROUP BY n.book_id, n.page, n.status")
def page_bundles(spark, sf_dir):
    now = log.latest(tables.page_log(spark, sf_dir)).select("book_id", "page", "status")
    got = artifacts.bundle(now.select("book_id", "page"), attempts=_attempts(spark, sf_dir).select("attempt_id", "book_id", "page", "status"), decision=now)
    return got.selectExpr("book_id", "page", "coalesce(array_join(transform(attempts, a -> concat(a.attempt_id, ':', a.status)), ','), '') AS attempts", "decision[0].status AS decision")


@query(f"WITH {PAGES}, {SIGNALS} SELECT page, tier, round(confidence, 2) AS confidence, md5(text) AS text_md5, 'COMPLETED' AS status, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_regions, 4 AS bbox FROM scored")
def record_projection(spark, sf_dir):
    p = tables.with_regions(base._scored(spark, sf_dir)).selectExpr("*", "'COMPLETED' AS status", "1.23456D AS duration_s")
    return render.page_record(p).where("duration_s = 1.235").selectExpr("page", "tier", "confidence", "md5(text) AS text_md5", "status", "size(regions) AS n_regions", "size(regions[0].bbox) AS bbox")


@query(f"""{_WITH_BODY}, c AS (SELECT p.book_id, p.page, coalesce(string_agg(b.text, chr(10) ORDER BY i), '') AS t, coalesce(string_agg(CASE WHEN kind = 'heading' THEN '### ' || b.text ELSE b.text END, chr(10) || chr(10) ORDER BY i), '') AS m FROM pages_ p LEFT JOIN body_ b USING (book_id, page) GROUP BY ALL)
SELECT book_id, page, md5('===== PAGE ' || page || ' =====' || chr(10) || chr(10) || t || chr(10)) AS txt, md5('## Page ' || page || chr(10) || chr(10) || m || chr(10)) AS md FROM c""")
def render_chunks(spark, sf_dir):
    body = base._body(spark, sf_dir)
    a, b = (render.chunks(body, k).selectExpr("book_id", "page", f"md5(chunk) AS {k}") for k in ("txt", "md"))
    return a.join(b, ["book_id", "page"])


@query(f"""{_WITH_BODY}, {SIGNALS}, c AS (SELECT p.book_id, p.page, coalesce(string_agg(b.text, chr(10) ORDER BY i), '') AS t FROM pages_ p LEFT JOIN body_ b USING (book_id, page) GROUP BY ALL),
d AS (SELECT book_id, md5(string_agg('[' || page || ']' || chr(10) || chr(10) || t || chr(10), chr(10) || chr(10) ORDER BY page) || chr(10)) AS txt_md5 FROM c GROUP BY book_id),
q AS (SELECT book_id, count(*) FILTER (tier IN ('LOW', 'CRITICAL') OR len(warnings) > 0) AS n_flagged FROM scored GROUP BY book_id), s AS (SELECT book_id, string_agg(line, '|' ORDER BY line) AS stamp_lines FROM stamps_ GROUP BY book_id)
SELECT d.book_id, txt_md5, n_flagged, coalesce(stamp_lines, '') AS stamp_lines FROM d JOIN q USING (book_id) LEFT JOIN s USING (book_id)""")
def book_products(spark, sf_dir):
    """Products of scored pages under settings of their own: fewer pages make a stamp, and another page marker."""
    how = settings.load(overrides={"stamps.least_share": "0.05", "output.marker": "[{page}]"})
    scored = base._scored(spark, sf_dir).withColumn("flagged", F.expr(quality.flagged()))
    made = two_pass.products(tables.with_regions(scored), how)
    return made["txt_md5"].join(made["qc"], "book_id").selectExpr("book_id", "md5 AS txt_md5", "n_flagged", "array_join(stamp_lines, '|') AS stamp_lines")


# Images and engines ---------------------------------------------------------------------------------------------------

_PX = "px[{0} * 8 + {1} + 1]"
_LAP = " + ".join(
    _PX.format(y, x)
    for y, x in (("CASE WHEN i // 8 = 0 THEN 1 ELSE i // 8 - 1 END", "i % 8"), ("CASE WHEN i // 8 = 3 THEN 2 ELSE i // 8 + 1 END", "i % 8"), ("i // 8", "CASE WHEN i % 8 = 0 THEN 1 ELSE i % 8 - 1 END"), ("i // 8", "CASE WHEN i % 8 = 7 THEN 6 ELSE i % 8 + 1 END"))
).replace("px[CASE", "px[(CASE").replace("END * 8", "END) * 8")
_IMAGES = f"""images_ AS (SELECT doc_id, [CASE WHEN doc_id % 10 = 0 THEN 255 ELSE ('0x' || substr(sha256(text), CAST(2 * k + 1 AS INTEGER), 2))::INTEGER // CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 1 END END for k in range(32)] AS px FROM documents),
stat_ AS (SELECT doc_id, len(list_filter(px, lambda v: v < 200)) / 32 AS ink, list_stddev_pop(px) AS std, list_var_pop([{_LAP} - 4 * px[i + 1] for i in range(32)]) / 10000 AS noise FROM images_)"""


def _images(spark, sf_dir):
    """Images of 8 by 4 pixels from hashes; every tenth is white, others have less contrast."""
    digits = "transform(sequence(0, 31), k -> CAST(conv(substr(sha2(text, 256), 2 * k + 1, 2), 16, 10) AS int) div IF(doc_id % 3 = 0, 4, 1))"
    return tables.read(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS string) AS origin", "8 AS width", "4 AS height", "1 AS nChannels", f"unhex(IF(doc_id % 10 = 0, repeat('ff', 32), array_join(transform({digits}, v -> lpad(hex(v), 2, '0')), ''))) AS data")


@query(f"WITH {_IMAGES} SELECT CAST(doc_id AS VARCHAR) AS origin, true AS readable, ink < 0.002 AS blank, round(ink, 6) AS ink_ratio, round(std, 6) AS contrast_std, CAST(round(noise * 10240000) AS BIGINT) AS noise_score FROM stat_")
def image_stats(spark, sf_dir):
    return image.analyze(_images(spark, sf_dir)).selectExpr("origin", "readable", "blank", "round(ink_ratio, 6) AS ink_ratio", "round(contrast_std, 6) AS contrast_std", "CAST(round(noise_score * 10240000) AS bigint) AS noise_score")


@query(f"WITH {_IMAGES} SELECT CAST(doc_id AS VARCHAR) AS origin, ink >= 0.002 AND noise > 0.15 AS denoise, ink >= 0.002 AND std < 40 AS binarize, ink >= 0.002 AND (noise > 0.15 OR std < 40) AS repaired FROM stat_")
def image_repairs(spark, sf_dir):
    """Images of 32 pixels have no skew to speak of, so no page is turned here."""
    done = two_pass.repaired(_images(spark, sf_dir))
    return done.selectExpr("origin", "denoise", "binarize", "png IS NOT NULL AND hex(substr(png, 2, 3)) = '504E47' AS repaired")


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS page, CASE WHEN n_nationkey <> 12 THEN upper(n_name) END AS text, CASE WHEN n_nationkey = 12 THEN 'TimeoutError: recognize took over 20 s' END AS error, CASE WHEN n_nationkey <> 12 THEN 'echo-1' END AS version FROM nation")
def process_engine(spark, sf_dir):
    """An engine in a process of its own, which is ended on the page that takes too long and started again."""
    p = tables.read(spark, sf_dir, "nation").selectExpr("'b' AS book_id", "CAST(n_nationkey + 1 AS bigint) AS page", "n_name AS text")
    return engines.recognize(p, "echo", "vellum.operators.engines:EchoEngine", {"slow_every": 13, "upper": True}, mode="process", timeout_s=20).select("page", "text", "error", "version")


@query("SELECT CAST(n_nationkey AS BIGINT) AS page, CASE WHEN n_nationkey % 7 <> 0 THEN 'caption,header,body' END AS kinds, CASE WHEN n_nationkey % 7 = 0 THEN 'LookupError' END AS layout_error FROM nation")
def layout_detection(spark, sf_dir):
    p = tables.read(spark, sf_dir, "nation").selectExpr("'b' AS book_id", "CAST(n_nationkey AS bigint) AS page")
    return engines.detect(p, engines.BandDetector, {"fail_every": 7}).selectExpr("page", "array_join(transform(blocks, b -> b.kind), ',') AS kinds", "layout_error")


@query("SELECT vec_id, round(exp(embedding[vec_id % 4 + 1]::DOUBLE) / list_sum(list_transform(embedding, lambda v: exp(v::DOUBLE))) * 100, 2) AS probability FROM embeddings")
def token_probability(spark, sf_dir):
    p = tables.read(spark, sf_dir, "embeddings").selectExpr("vec_id", "array(CAST(embedding AS array<double>)) AS scores", "array(CAST(vec_id % 4 AS int)) AS chosen")
    return p.selectExpr("vec_id", f"{engines.token_probability('scores', 'chosen')} AS probability")


_MARKED = ("كِتَابٌ  قَدِيمٌ", "الـسـلام", "été آ", "ٰ plain", "")


@query("SELECT text, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS strict, trim(regexp_replace(regexp_replace(nfc_normalize(text), '[\\x{064B}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06ED}\\x{0640}]', '', 'g'), '\\s+', ' ', 'g')) AS loose FROM (VALUES " + ", ".join(f"('{m}')" for m in _MARKED) + ") v(text)")
def normalized_text(spark, sf_dir):
    p = spark.createDataFrame([(m,) for m in _MARKED], "text string").select("text", t.nfc(F.col("text")).alias("c"))
    return p.selectExpr("text", f"{metrics.normalize('c')} AS strict", f"{metrics.normalize('c', True)} AS loose")
