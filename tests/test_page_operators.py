"""Ordering, layout, stamps, routing, logs, validation, rendering, images, engines, configuration and streams on small inputs."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vellum import interfaces, schemas, settings
from vellum.functions import evidence, image, quality
from vellum.operators import artifacts, engines, layout, log, ordering, render, routing, stamps, validate
from vellum.plans import queries, run_queries, two_pass  # noqa: F401
from vellum.sources import files, pdf, synthetic, tables, text_layer
from vellum.streaming import log as slog

LINE = "array<struct<kind:string,x0:double,y0:double,x1:double,y1:double,text:string,confidence:double,reading_order:int>>"


def line(x0, y0, x1, y1, text, kind="body", order=None):
    return (kind, float(x0), float(y0), float(x1), float(y1), text, None, order)


def order(spark, lines, f=ordering.right_to_left):
    return [r["text"] for r in spark.createDataFrame([(lines,)], f"l {LINE}").selectExpr(f"{f('l')} AS l").first().l]


def test_rows_right_to_left(spark):
    assert order(spark, [line(50, 325, 122, 379, "3"), line(258, 309, 1200, 383, "1"), line(130, 310, 258, 385, "2"), line(10, 600, 20, 640, "4")]) == ["1", "2", "3", "4"]
    assert order(spark, [line(0, 100, 9, 120, "b"), line(0, 0, 9, 20, "a"), line(0, 200, 9, 220, "c")]) == ["a", "b", "c"]
    assert order(spark, [line(5, 0, 9, 20, "x"), line(5, 1, 9, 21, "y")]) == ["x", "y"]  # ties keep their order
    assert order(spark, []) == []


def plain_rows(lines):
    rows = []
    for x in sorted(lines, key=lambda x: x[2]):
        c = (x[2] + x[4]) / 2
        for r in rows:
            if min(y[2] for y in r) <= c <= max(y[4] for y in r):
                r.append(x)
                break
        else:
            rows.append([x])
    return [x[5] for r in sorted(rows, key=lambda r: min(y[2] for y in r)) for x in sorted(r, key=lambda x: x[1], reverse=True)]


def test_rows_as_a_plain_fold(spark):
    g = np.random.default_rng(0)
    for _ in range(4):
        lines = [line(g.integers(0, 99), y := int(g.integers(0, 60)), 100, y + int(g.integers(-3, 15)), f"t{i}") for i in range(25)]
        assert order(spark, lines) == plain_rows(lines)


def test_layout(spark):
    blocks = "array(struct('header' AS kind, 0D AS x0, 0D AS y0, 100D AS x1, 20D AS y1, 0 AS reading_order), struct('body' AS kind, 0D AS x0, 10D AS y0, 100D AS x1, 90D AS y1, 1 AS reading_order))"
    lines = [line(0, 12, 10, 16, "both"), line(0, 2, 10, 6, "٣١"), line(0, 50, 10, 60, "31"), line(500, 0, 510, 5, "out")]
    p = spark.createDataFrame([(lines,)], f"lines {LINE}").selectExpr("lines", f"{blocks} AS blocks")
    got = layout.apply_layout(p).first()
    assert [(r.text, r.kind) for r in got.regions] == [("٣١", "page_number"), ("both", "header"), ("31", "body"), ("out", "body")]
    assert got.regions[-1].reading_order == 2 and got.provider == "layout"
    got = layout.apply_layout(p, error="'TimeoutError'").first()
    assert got.provider == "rtl-row-fallback" and got.layout_warnings == ["layout_detection_failed:TimeoutError"]
    p = spark.createDataFrame([(lines,)], f"lines {LINE}").selectExpr("lines", f"IF(false, {blocks}, NULL) AS blocks")
    assert layout.apply_layout(p).first().layout_warnings == []


def test_stamps(spark):
    rows = [("b", i, 100, [line(0, 95, 9, 99, " my   stamp"), line(0, 50, 9, 55, "refrain"), line(0, 96, 9, 99, f"own {i}")]) for i in range(5)] + [("b", 5, 0, [line(0, 95, 9, 99, "my stamp")])]
    p = spark.createDataFrame(rows, f"book_id string, page int, page_height int, regions {LINE}")
    found = stamps.stamp_lines(p)
    assert [tuple(r) for r in found.collect()] == [("b", "my stamp", 5)]
    assert stamps.stamp_lines(p.limit(0)).count() == 0
    r = p.selectExpr("book_id", "page", "page_height", "explode(regions) AS r").selectExpr("book_id", "page", "page_height", "r.y0", "r.text")
    assert stamps.drop_stamps(r, found).count() == 15 and stamps.drop_stamps(r, found, normalized_match=True).count() == 10


def test_routing(spark):
    rows = [(1, "LOW", 0, None), (2, "HIGH", 0, 0.8), (2, "HIGH", 0, 0.1), (1, "HIGH", 1, None), (2, "LOW", 0, 0.1), (1, "MEDIUM", 0, None)]
    df = spark.createDataFrame(rows, "p int, tier string, h int, d double")
    got = [r.a for r in df.selectExpr(f"{routing.action('p', 'tier', 'h', 'd')} AS a").collect()]
    assert got == ["reprocess_local", "flag_for_review", "accept", "flag_for_review", "flag_for_review", "accept"]


def test_log_and_validation(spark):
    rows = [("b", 1, 1, "PENDING", None, None), ("b", 1, 2, "PROCESSING", "HIGH", None), ("b", 1, 3, "COMPLETED", None, None), ("b", 2, 4, "FAILED", "LOW", "x"), ("b", 2, 5, "PROCESSING", None, None), ("b", 9, 6, "REVIEW_REQUIRED", None, None)]
    lg = spark.createDataFrame(rows, "book_id string, page int, seq bigint, status string, tier string, last_error string").selectExpr("*", "CAST(NULL AS double) AS confidence", "'e' AS engine_used", "1 AS processing_pass")
    assert {(r.page, r.status) for r in log.latest(lg).collect()} == {(1, "COMPLETED"), (2, "PROCESSING"), (9, "REVIEW_REQUIRED")}
    assert [r.page for r in log.pending(lg).collect()] == [2]
    assert log.superseded(lg).first()[0] == 3
    state = {r.page: r for r in log.coalesced_state(lg).collect()}
    assert state[1].tier == "HIGH" and state[2].tier == "LOW" and state[2].last_error is None and state[2].retry_count == 1
    assert [(r.before, r.status) for r in log.illegal_transitions(lg).collect()] == []
    books = spark.createDataFrame([("b", 3), ("none", 1)], "book_id string, page_count int")
    att = spark.createDataFrame([(1, "b", 2, 1, "PROCESSING"), (2, "b", 2, 1, "COMPLETED")], "attempt_id bigint, book_id string, page int, processing_pass int, status string")
    bad = {(r.check, r.detail) for r in validate.violations(lg, books, att).collect()}
    assert bad == {("missing_page", "3"), ("missing_page", "1"), ("unexpected_page", "9"), ("non_final_status", "2:PROCESSING"), ("review_required", "9"), ("missing_log", "1"), ("unfinished_attempt", "1")}
    assert ("unfinished_attempt", "1") not in {(r.check, r.detail) for r in validate.violations(lg, books, att, latest_attempts_only=True).collect()}
    assert {r.page for r in log.seed(books.where("book_id = 'b'"), lg).collect()} == {3}
    known = spark.createDataFrame([("b", "p.pdf", 3, "f", "abc", 1)], "book_id string, source_path string, page_count int, source_fingerprint string, source_sha256 string, seq bigint")
    assert log.register(known, {"book_id": "b", "source_path": "p.pdf", "page_count": 3, "source_fingerprint": "f"})["source_sha256"] == "abc"
    with pytest.raises(ValueError):
        log.register(known, {"book_id": "b", "source_path": "p.pdf", "page_count": 3, "source_sha256": "changed"})
    torn = spark.createDataFrame([("b", 1, '{"page": 1, "status": "COMPLETED"}'), ("b", 2, '{"page": 2, "sta'), ("b", 3, '{"status": "x"}'), ("b", 4, " ")], "book_id string, seq bigint, value string")
    assert {(r.seq, r.malformed) for r in validate.parse_log(torn, "page int, status string").collect()} == {(1, False), (2, True), (3, True)}


def test_rendering(spark):
    rows = [("b", 2, "t\nmy stamp", []), ("b", 1, "x", [line(0, 0, 1, 1, "H", "heading"), line(0, 0, 1, 1, "7", "page_number"), line(0, 0, 1, 1, " "), line(0, 0, 1, 1, "my stamp"), line(0, 0, 1, 1, "body")])]
    p = spark.createDataFrame(rows, f"book_id string, page int, text string, regions {LINE}")
    body = render.body_regions(p, spark.createDataFrame([("b", "my stamp")], "book_id string, line string"))
    assert render.txt(body).first().document == "===== PAGE 1 =====\n\nH\nbody\n\n\n===== PAGE 2 =====\n\nt\n\n"
    assert render.markdown(body).first().document == "# b\n\n## Page 1\n\n### H\n\nbody\n\n## Page 2\n\nt\n"


def test_text_layer_gate(spark):
    rows = [("word " * 30,), ("في " * 60,), ("",), (None,), ("�" * 100 + " في" * 90,)]
    df = spark.createDataFrame(rows, "text string")
    assert [r.layer.usable for r in text_layer.gate(df).collect()] == [False, True, False, False, False]
    assert text_layer.gate(df, least_ratio=0.0, least_words=5, least_chars=20).first().layer.usable


def test_images(spark):
    img = np.full((60, 80), 255.0)
    img[20:40, 10:70] = 0
    assert image.noise(np.full((9, 9), 7.0)) == 0 and image.noise(img) > 0 and image.skew(img) == 0
    yy, xx = np.mgrid[:200, :300]
    turned = np.where((abs((xx - 150) * 0.9962 + (yy - 100) * 0.0872) < 90) & (abs((yy - 100) * 0.9962 - (xx - 150) * 0.0872) < 30), 0.0, 255.0)
    assert abs(abs(image.skew(turned)) - 5) < 0.6
    rows = [("a", 80, 60, 1, bytearray(img.astype(np.uint8).tobytes())), ("blank", 8, 8, 1, bytearray(b"\xff" * 64)), ("broken", 0, 0, 0, None)]
    df = spark.createDataFrame(rows, "origin string, width int, height int, nChannels int, data binary")
    got = {r.origin: r for r in image.gates(image.analyze(df)).collect()}
    assert not got["a"].blank and got["blank"].blank and not got["broken"].readable and got["broken"].blank
    assert got["a"].ink_ratio == pytest.approx(0.25)


def test_engines(spark):
    r = engines.Registry()
    r.register("echo", "vellum.operators.engines:EchoEngine")
    with pytest.raises(ValueError):
        r.register("echo", engines.EchoEngine)
    with pytest.raises(KeyError):
        r.get("other")
    p = spark.createDataFrame([("b", 1, "x\ny"), ("b", 2, "z")], "book_id string, page bigint, text string")
    got = {x.page: x for x in engines.recognize(p, "echo", r.get("echo"), {"fail_every": 2, "score": 0.8}).collect()}
    assert got[1].text == "x\ny" and got[1].confidence == pytest.approx(80) and len(got[1].lines) == 2
    assert got[2].text is None and got[2].error.startswith("RuntimeError")
    assert engines.mean_token_probability(np.array([[0.0, 0.0], [0.0, np.log(3)]]), np.array([0, 1])) == 62.5


def test_settings(tmp_path):
    got = settings.load(overrides={"rules.high": "85", "run.escalate": "false", "stamps.least_share": "0.5", "rules.weights.extra": "0.1"})
    assert got.rules.high == 85 and not got.run.escalate and got.stamps.least_share == 0.5 and got.rules.weights["extra"] == 0.1 and got.rules.weights["engine_confidence"] == 0.5
    for wrong in ({"gate.unknown": "1"}, {"unknown": "1"}, {"gate": "1"}, {"run.escalate": "7"}, {"gate.least_chars": "many"}):
        with pytest.raises(ValueError):
            settings.load(overrides=wrong)
    (tmp_path / "c.yaml").write_text("stamps: {least_share: 0.5}\ngate: {prefer: false}\n")
    got = settings.load(str(tmp_path / "c.yaml"))
    assert got.stamps == settings.Stamps(least_share=0.5) and not got.gate.prefer
    assert len(settings.fingerprint(got)) == 16 != settings.fingerprint(settings.Settings()) and settings.coerce("1.5") == 1.5 and settings.coerce("TRUE") is True


def test_engine_process_and_its_limits(spark):
    """A page that takes too long, one that fails and an engine that can't start each leave an error in their rows."""
    p = spark.createDataFrame([("b", i, f"t{i}") for i in range(1, 5)], "book_id string, page bigint, text string").coalesce(1)
    path = "vellum.operators.engines:EchoEngine"
    got = {r.page: r for r in engines.recognize(p, "e", path, {"slow_every": 2, "fail_every": 3, "upper": True}, mode="process", timeout_s=15).where("page < 4").collect()}
    assert (got[1].text, got[1].version) == ("T1", "echo-1") and got[2].error == "TimeoutError: recognize took over 15 s" and got[3].error == "RuntimeError: page can't be read"
    assert "can't start" in engines.recognize(p.limit(1), "e", path, {"fail_start": True}, mode="process").first().error
    assert engines.recognize(p.limit(1), "e", path, {"start_s": 9}, mode="process", timeout_s=1).first().error.startswith("TimeoutError: start took over")
    with pytest.raises(ValueError):
        engines.recognize(p, "e", path, mode="elsewhere")
    runner = engines.OwnProcess(path, {})
    assert runner.call("recognize", {"page": 1, "text": "x"})["text"] == "x"
    runner.close()
    assert not runner._child.is_alive() and isinstance(engines.EchoEngine({}), interfaces.Recognizer) and isinstance(engines.BandDetector({}), interfaces.LayoutDetector)


def test_two_passes(spark, tmp_path):
    """Lines that an engine gives from the bottom up are put in order in either pass; the chosen reading keeps its confidence."""
    text = "one two\n" + "\n".join(f"line {i} of the page" for i in range(5))
    p = spark.createDataFrame([("b", 1, text, False), ("b", 2, "", True), ("b", 3, text, False)], "book_id string, page bigint, text string, blank boolean")
    how = {"first_config": {"reverse": True, "score": 0.1, "fail_every": 3}, "detector": engines.BandDetector}
    for second, want in (({"reverse": True, "score": 1.0}, ("COMPLETED", "escalation", 100.0, 2)), ({"score": 0.2}, ("REVIEW_REQUIRED", "primary", 10.0, 2)), ({"fail_every": 1}, ("REVIEW_REQUIRED", "primary", 10.0, 2))):
        got = {r.page: r for r in two_pass.run(spark, p, str(tmp_path / str(want[2]) / str(len(second))), engines.EchoEngine, engines.EchoEngine, second_config=second, settings=settings.load(overrides={"rules.medium": "50"}), **how).collect()}
        r = got[1]
        assert (r.status, r.engine, r.confidence, r.processing_pass) == want and r.text == text and len(r.regions) == 6
        assert got[2].status == "BLANK" and (got[3].status, got[3].text, got[3].error) == ("FAILED", None, "RuntimeError: page can't be read")
        if "fail_every" in second:
            assert r.warnings[-1] == "escalation_failed:RuntimeError" and r.error == "RuntimeError: page can't be read"
        elif want[0] == "REVIEW_REQUIRED":
            assert r.warnings[-1] == "second_engine_not_safely_accepted" and r.error is None
    one = two_pass.run(spark, p, str(tmp_path / "one"), engines.EchoEngine, engines.EchoEngine, settings=settings.load(overrides={"run.escalate": "false"})).collect()
    assert {r.page: r.status for r in one} == {1: "REVIEW_REQUIRED", 2: "BLANK", 3: "REVIEW_REQUIRED"}


def test_records(spark):
    p = spark.createDataFrame([("b", 1, "x <br>", 90.0)], "book_id string, page bigint, text string, confidence double").selectExpr("*", "'a/b' AS engine", "'1' AS version", "1D AS score", "'HIGH' AS tier", "array('w') AS warnings")
    from vellum.functions import evidence

    c = artifacts.candidates(p.selectExpr("*", *evidence.counters()), 2)
    r = c.first()
    assert (r.artifact, r.output_format, r.evidence["html_tag_count"], r.engine_name) == ("pass-2-a-b.json", "html", 1.0, "a/b")
    b = artifacts.bundle(p.select("book_id", "page"), candidates=c.select("book_id", "page", "artifact"), decisions=c.select("book_id", "page", "tier").where("false")).first()
    assert [x.artifact for x in b.candidates] == ["pass-2-a-b.json"] and b.decisions is None
    assert schemas.create_tables(spark, "made_here") == sorted(schemas.TABLES) and spark.table("made_here.candidates").columns == c.drop("artifact").columns
    spark.sql("DROP DATABASE made_here CASCADE")


def test_scans(spark, tmp_path):
    regions = synthetic.page(0, 3)[1]
    img = synthetic.raster(regions)
    assert synthetic.page(0, 3)[1] == regions and 0 < (img < 200).mean() < 0.5
    data = pdf.write([img, 255 - img], 300)
    assert pdf.page_count(data) == 2 and pdf.page_count(data[:-2000]) in (0, 2) and pdf.page_count(b"") == pdf.page_count(b"%PDF-1.4 rubbish") == 0
    assert (pdf.page_image(data, 2, 300)[..., 0] == 255 - img).all() and pdf.page_image(data, 1, 150).shape[0] == round(img.shape[0] / 2)
    with pytest.raises(IndexError):
        pdf.page_image(data, 3, 300)
    assert files.output_folder("/x/a.b.pdf", "/y") == "/y/a.b"
    files.write_atomically(str(tmp_path / "book.txt"), "x")
    assert files.products(str(tmp_path)) == [("book.txt", 1), ("book.md", None)]


def test_repairs():
    yy, xx = np.mgrid[:120, :160]
    img = np.where((abs(xx - 80) < 60) & (abs(yy - 60) < 3), 0.0, 255.0)
    turned = image.rotate(img, 7)
    assert abs(abs(image.skew(turned)) - 7) < 0.8 and np.abs(image.rotate(img, 0) - img).max() == 0
    assert np.abs(image.rotate(turned, -image.skew(turned)) - img).mean() < 6
    g = np.random.default_rng(0)
    dirty = np.clip(img * 0.8 + 20 + g.normal(0, 6, img.shape), 0, 255)
    assert image.denoise(dirty[:40, :40]).std() <= dirty[:40, :40].std() and set(np.unique(image.binarize(dirty))) == {0.0, 255.0}
    import zlib

    raw = image.png(img)
    assert raw[:4] == b"\x89PNG" and zlib.decompress(raw[raw.index(b"IDAT") + 4 : -16])[1:161] == img[0].astype(np.uint8).tobytes()


def test_denoising_as_a_plain_mean():
    g = np.random.default_rng(0)
    img = np.clip(200 + g.normal(0, 8, (16, 14)), 0, 255)
    p, want = np.pad(img, 13, mode="reflect"), np.zeros(img.shape)
    for i, j in np.ndindex(*img.shape):
        y, x, total, weight = i + 13, j + 13, 0.0, 0.0
        for dy in range(-10, 11):
            for dx in range(-10, 11):
                gap = (p[y - 3 : y + 4, x - 3 : x + 4] - p[y + dy - 3 : y + dy + 4, x + dx - 3 : x + dx + 4]) ** 2
                k = np.exp(-gap.mean() / 100)
                total, weight = total + k * p[y + dy, x + dx], weight + k
        want[i, j] = total / weight
    assert np.abs(image.denoise(img) - want).max() <= 0.5 + 1e-9


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(1, 3001)))
    (tmp_path / "b.txt").write_text("line 1\n\nline 3")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = files.numbered_lines(spark, str(tmp_path)).where("value <> ''").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3002 and all(r.value == f"line {r.line}" for r in got)


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.pdf").write_bytes(b"y")
    assert [r.path.rsplit("/", 1)[1] for r in files.scan(spark, str(tmp_path)).collect()] == ["a.pdf", "b.pdf"]
    files.write_atomically(str(tmp_path / "book.txt"), "done")
    assert (tmp_path / "book.txt").read_text() == "done"
    rows = [json.dumps({"page": 1, "seq": i, "text": f"v{i}"}) for i in (1, 2)]
    (tmp_path / "log.jsonl").write_text("\n".join(rows) + "\n\n")
    lg = files.read_log(spark, str(tmp_path / "log.jsonl"))
    assert files.page_of(lg, 1).first().text == "v2" and files.event_count(spark, str(tmp_path / "log.jsonl")) == 2
    (tmp_path / "log.jsonl").write_text("\n".join(rows) + '\n{"page": 2, "te\n')
    assert [r._line for r in files.read_log(spark, str(tmp_path / "log.jsonl"), strict=False).where("_malformed IS NOT NULL").collect()] == [3]


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    events = pd.DataFrame({"event_id": [1, 2], "ts": pd.to_datetime(["2024-01-01", "2024-01-02"]), "user_id": [7, 7], "event_type": ["click", "view"], "value": [1.0, 60.0], "props": ["{}", "{}"]})
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    spark.createDataFrame(events.iloc[:1]).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    read = lambda: slog.latest(tables.as_log(spark.readStream.schema(schema).parquet(src)).select("book_id", "page", "seq", "status"))
    assert [r.status for r in slog.run_available(read(), cp, "s1").collect()] == ["PROCESSING"]
    spark.createDataFrame(events.iloc[1:]).write.mode("append").parquet(src)
    assert [r.status for r in slog.run_available(read(), cp, "s2").collect()] == ["COMPLETED"]
    slog.upsert_to(read(), str(tmp_path / "out"), str(tmp_path / "cp3"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_leak_check_is_plain_containment(spark, tmp_path):
    passages = [(1, "one\ntwo three four five six seven eight nine"), (2, "quoted word goes on for eight words here"), (3, " leads with a space and goes on to end"), (4, "short one"), (5, "a b c"), (6, "word"), (7, ""), (8, None), (None, "two three four five"), (1, "a b c"), (9, "two  spaces in a row are one empty word"), (10, "not in any of the texts at all , really")]
    texts = ["zero one\ntwo three four five six seven eight nineteen", 'x "quoted word goes on for eight words here"', "\tquoted word goes on for eight words here", "it leads with a space and goes on to endings", "a short one, a b cd", "a b c", "a b c", "", None, "xtwo  spaces in a row are one empty words", "leads with a space and goes on to end"]
    spark.createDataFrame(passages, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, p in passages:
        for t in texts:
            if p is not None and t is not None and p in t:
                want[k] = want.get(k, 0) + 1
    assert {r.item_id: r.pages for r in queries.leak_check(spark, str(tmp_path)).collect()} == want


def test_images_of_one_shape_are_repaired_together(spark, monkeypatch):
    """As image by image, in a single pass, however many fit in an array."""
    g = np.random.default_rng(5)
    images = [g.integers(0, 256, shape).astype(float) for shape in [(4, 8)] * 5 + [(20, 30)] * 2 + [(1, 3)]] + [None, np.full((4, 8), 255.0)]
    stack = np.stack(images[:5])
    for step in (image.denoise, image.binarize, image.noise):
        assert (np.array(step(stack)) == np.stack([np.array(step(i)) for i in images[:5]])).all()
    monkeypatch.setattr(image, "AT_ONCE", 3000)
    rows = [(str(i), *((0, 0) if x is None else x.shape[::-1]), 1, None if x is None else bytearray(x.astype(np.uint8).tobytes())) for i, x in enumerate(images)]
    df = spark.createDataFrame(rows, "origin string, width int, height int, nChannels int, data binary")
    gates = image.gates(image.analyze(df))
    apart = {r.origin: r.png for r in image.repair(df.join(gates.select("origin", "skew_deg", "deskew", "denoise", "binarize"), "origin")).collect()}
    done = {r.origin: r for r in image.triaged(df).collect()}
    assert {k: r.png for k, r in done.items()} == apart and done["8"].png is None and not done["8"].readable and done["9"].png is None
    assert {r.origin: (r.deskew, r.denoise, r.binarize) for r in gates.collect()} == {k: (r.deskew, r.denoise, r.binarize) for k, r in done.items()}
    assert apart["0"] == image.png(image.denoise(images[0])) and done["0"].denoise and not done["0"].binarize


def test_no_book_is_gathered_to_lose_its_stamps(spark):
    p = tables.with_regions(spark.createDataFrame([("b", i, f"top {i}\nbody {i}\nm{i}\nn{i}\nmiddle {i}\nstamp") for i in range(9)] + [("c", 1, "x")], "book_id string, page long, text string"))
    found = stamps.stamp_lines(p)
    lines = p.selectExpr("book_id", "page", "inline(transform(regions, r -> struct(r.text AS text)))")
    for body, rest in ((render.body_regions(p, found), stamps.drop_stamps(lines, found)), (render.body_regions(p, found, send=False), stamps.drop_stamps(lines, found, send=False))):
        assert {(r.book_id, r.page): [x.text for x in r.body][-1] for r in body.collect()} == {**{("b", i): f"middle {i}" for i in range(9)}, ("c", 1): "x"}
        assert "stamp" not in {r.text for r in rest.collect()} and rest.count() == 46
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (render.body_regions(p, found), stamps.drop_stamps(lines, found))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("BroadcastHashJoin" in x and "text#" not in "".join(y for y in x.split("\n") if "hashpartitioning" in y) for x in plans)


def test_long_readings_are_compared_without_a_table_of_distances(spark):
    g = np.random.default_rng(2)
    draw = lambda n: "".join(g.choice(list("ab é😀"), n))
    pairs = [(x, y) for x in ("", "a", draw(7), draw(64), draw(400)) for y in ("", "b", draw(9), draw(65), draw(390))] + [((x := draw(500)), x[200:] + x[:200]), (x, x)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    assert [evidence.edits(r.a, r.b) for r in df.collect()] == [r.d for r in df.selectExpr("levenshtein(a, b) AS d").collect()]
    side = lambda c, e: df.selectExpr("'b' AS book_id", "i AS page", f"{c} AS text", "1D AS score", "'HIGH' AS tier", "CAST(array() AS array<string>) AS warnings", "0 AS html_tag_count", f"'{c}' AS engine", f"{e} AS error")
    got = {r.page: r.normalized_disagreement for r in routing.adjudicate(side("a", "CAST(NULL AS string)"), side("b", "IF(i = 26, 'E: x', NULL)")).collect()}
    want = {r.i: r.d for r in df.selectExpr("i", "IF(i = 26, NULL, coalesce(levenshtein(a, b) / nullif(greatest(char_length(a), char_length(b)), 0), IF(a = b, 0D, NULL))) AS d").collect()}
    assert got == want
    slow = "".join(g.choice(list("abcdefgh"), 20_000))
    assert evidence.edits(slow, slow[50:]) == 50


def test_products_score_no_page_for_its_text_or_stamps(spark):
    scored = quality.score_pages(spark.createDataFrame([("b", 1, "x", 50.0)], "book_id string, page long, text string, confidence double"))
    made = two_pass.products(tables.with_regions(scored))
    scores = {k: df._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") for k, df in made.items()}
    assert scores["stamps"] == scores["txt"] == scores["md"] == 0 and scores["qc"] == 1


def test_digests_are_those_of_whole_documents_without_making_them(spark):
    rows = [("a", p, x) for p, x in ((3, "c"), (1, None), (2, ""), (2, "é\nx"), (None, "lost"))] + [("b", p, f"line {p}\n# t") for p in range(25_000)] + [("c", None, "only"), (None, 1, "no book")]
    pages = spark.createDataFrame(rows, "book_id string, page long, text string").withColumn("regions", F.expr("transform(split(text, '\n'), l -> struct(IF(l LIKE '#%', 'heading', 'body') AS kind, l AS text))"))
    body = render.body_regions(pages.repartition(3))
    for whole, digests in ((render.txt(body, "[{page}]"), render.txt_digests(body, "[{page}]")), (render.markdown(body), render.markdown_digests(body))):
        want = {r.book_id: r.m for r in whole.selectExpr("book_id", "md5(document) AS m").collect() if r.m}
        got = {r.book_id: r.md5 for r in digests.collect()}
        assert len(want) >= 3 and {k: got[k] for k in want} == want and len(got) == 4
        assert "collect_list" not in digests._jdf.queryExecution().optimizedPlan().toString()


def test_products_hash_a_book_and_make_its_stamps_lines_once(spark, tmp_path):
    spark.createDataFrame([(1, "s", "a\nb"), (2, "s", "c\nd")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    plan = queries.QUERIES["book_products"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    p = spark.createDataFrame([("a\nb",)], "text string").selectExpr("'b' AS book_id", "1L AS page", "text")
    found = stamps.stamp_lines(tables.with_regions(p), normalize=False)._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("regexp_replace(") == 1 and found.count("split(") == 1


def test_flagged_pages_by_the_first_rule_that_holds(spark):
    arabic = "قال الولد في البيت مع أخيه كلاما طويلا عن هذا الكتاب القديم من المدرسة"
    texts = [None, "", "short", arabic, arabic + " ¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤", "نعم نعم نعم نعم " * 8, f"{arabic}\n" * 3 + "آخر", "plain words in latin letters, forty characters at least", *(x for _, x, _ in tables.SCRIPT_PAGES)]
    rows = [(x, c) for x in texts for c in (None, 0.0, 48.0, 60.0, 92.0, float("nan"))]
    for rules in (quality.Rules(), quality.Rules(high=50.0, medium=70.0), quality.Rules(script=quality.LATIN)):
        scored = quality.score_pages(spark.createDataFrame(rows, "text string, confidence double"), rules)
        got = scored.selectExpr(f"{quality.flagged(rules=rules)} AS quick", "tier IN ('LOW', 'CRITICAL') OR size(warnings) > 0 AS full").collect()
        assert [r.quick for r in got] == [r.full for r in got] and {r.full for r in got} == {True, False}


def test_labels_are_sent_to_the_texts(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "s", "a"), (2, "s", None), (3, "t", "c")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (3, 0), (9, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        sent = tables.pages(spark, str(tmp_path), False)
        monkeypatch.setattr(tables, "SENT", 2)
        dealt = tables.pages(spark, str(tmp_path), False)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (sent, dealt)]
        assert "SortMergeJoin" not in plans[0] and "SortMergeJoin" in plans[1]
        want = [("s", 1, "a", 92.0), ("s", 2, None, None), ("t", 3, "c", 48.0)]
        assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, dealt.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
