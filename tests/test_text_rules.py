"""Text rules against plain Python on drawn texts."""

import re
import unicodedata
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vellum.functions import evidence, metrics, quality
from vellum.functions import text as t

CHARS = "ab .\n\t  \r\x1c،كمنً3٣<>-é"
texts = st.lists(st.text(CHARS, max_size=60), min_size=1, max_size=20)
quick = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def values(spark, rows, *exprs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, text string")
    return [tuple(r)[1:] for r in df.selectExpr("i", *exprs).orderBy("i").collect()]


@quick
@given(texts)
def test_strip_words_lines(spark, rows):
    got = values(spark, rows, t.strip("text"), t.words("text"), t.lines("text"), t.any_line("text"), f"char_length({t.bare('text')})")
    for x, (s, w, ls, n, bare) in zip(rows, got):
        assert s == x.strip()
        assert w == x.split()
        assert ls == [y.strip() for y in x.split("\n") if y.strip()]
        assert n == len([y for y in x.splitlines() if y.strip()])
        assert bare == len([c for c in x if not c.isspace()])


@quick
@given(texts)
def test_signals(spark, rows):
    got = values(spark, rows, quality.script_ratio("text"), quality.garbage_ratio("text"), quality.length_score("text"), quality.dictionary_rate("text"))
    plain = re.compile(r"[؀-ۿA-Za-z0-9.,!?:;\"'()\[\]«»…\-—]")
    for x, (script, garbage, length, rate) in zip(rows, got):
        c = [y for y in x if not y.isspace()]
        assert script == pytest.approx(sum("؀" <= y <= "ۿ" for y in c) / len(c) if c else 0)
        assert garbage == pytest.approx(1 - sum(bool(plain.match(y)) for y in c) / len(c) if c else 0)
        n = len(x.strip())
        assert length == pytest.approx(0 if not n else min(1, n / 40))
        runs = re.findall("[؀-ۿ]+", x)
        assert rate == pytest.approx(0.5 if len(runs) < 5 else min(1, sum(r in quality.FUNCTION_WORDS for r in runs) / len(runs) / 0.25))


@quick
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c d", ""]), max_size=30), min_size=1, max_size=12))
def test_repetition(spark, rows):
    for sep, expr, rule in (("\n", quality.repeated_line("text"), _line), (" ", quality.repeated_ngram("text"), _ngram)):
        xs = [sep.join(r) for r in rows]
        assert [v[0] for v in values(spark, xs, expr)] == [rule(x) for x in xs]


def _line(x):
    ls = [y.strip() for y in x.split("\n") if y.strip()]
    return len(ls) >= 4 and max(Counter(ls).values()) >= 3


def _ngram(x):
    w = x.split()
    return len(w) >= 24 and max(Counter(tuple(w[i : i + 4]) for i in range(len(w) - 3)).values()) >= 6


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@quick
@given(st.lists(st.tuples(st.text("ab .،كً\n", max_size=25), st.text("ab .،كً\n", max_size=25)), min_size=1, max_size=15))
def test_metrics(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, reference string, hypothesis string")
    got = [r.asDict() for r in metrics.page_report(df).orderBy("i").collect()]
    for (a, b), r in zip(pairs, got):
        for loose in (False, True):
            x, y = (" ".join((re.sub("[ً-ٰٟۖ-ۭـ]", "", s) if loose else s).split()) for s in (a, b))
            tail = "_loose" if loose else ""
            assert r["cer" + tail] == pytest.approx(distance(x, y) / len(x) if x else float(bool(y)))
            assert r["wer" + tail] == pytest.approx(distance(x.split(), y.split()) / len(x.split()) if x else float(bool(y)))
        ca, cb = Counter(c for c in a if c in metrics.SIGNS), Counter(c for c in b if c in metrics.SIGNS)
        want = sum(min(n, cb[c]) for c, n in ca.items()) / sum(ca.values()) if ca else None
        assert r["punctuation_recall"] == (None if want is None else pytest.approx(want))


def test_nfc(spark):
    df = spark.createDataFrame([("é",), ("abc",), (None,)], "x string")
    assert [r.x for r in t.with_nfc(df, "x").collect()] == [unicodedata.normalize("NFC", "é"), "abc", None]


def test_page_numbers(spark):
    rows = ["٣١", "31", " 12 ", "xiv", "123456789", "- 7 -", "a1", "", "[3]"]
    assert [v[0] for v in values(spark, rows, evidence.is_page_number("text"))] == [True, True, True, False, False, True, False, False, True]


def test_quality_tiers(spark):
    good = "قال الولد في البيت إن الكتاب من المدرسة ثم خرج إلى الطريق مع أخيه"
    rows = [(1, good, 95.0), (2, "نعم نعم نعم نعم " * 15, 95.0), (3, "سطر\n" * 5, 95.0), (4, None, None), (5, good, None)]
    df = spark.createDataFrame(rows, "page int, text string, confidence double")
    got = {r.page: r for r in quality.score_pages(df).collect()}
    assert got[1].tier == "HIGH" and got[1].warnings == []
    assert got[2].tier == "CRITICAL" and "degenerate_repetition" in got[2].warnings
    assert got[3].tier == "CRITICAL" and "repeated_line_detected" in got[3].warnings
    assert got[4].tier == "LOW" and "near_empty_page" in got[4].warnings
    assert got[5].tier == "MEDIUM" and got[5].warnings == ["native_confidence_unavailable"]


def test_names_and_html(spark):
    assert values(spark, ["Engine A/1", "///", ""], evidence.artifact_name("1", "text")) == [("pass-1-Engine-A-1.json",), ("pass-1-engine.json",), ("pass-1-engine.json",)]
    assert values(spark, ["<p>a<br>b</p> &lt;c&gt; &amp;lt;"], evidence.html_to_text("text")) == [("a\nb\n <c> &lt;",)]


def test_words_beyond_one_plane(spark, monkeypatch):
    """Pairs of more words than a table of characters took before, and the way for those beyond all characters."""
    many = [f"w{i}" for i in range(36_500)]
    df = spark.createDataFrame([(" ".join(many[-1200:] + many[:35_400]), " ".join(many[-1200:]))], "r string, h string")
    assert df.selectExpr(f"{metrics.wer('r', 'h')} AS w").first().w == pytest.approx(35_400 / 36_600)
    monkeypatch.setattr(metrics, "CODES", 2)
    pairs = [("a b c", "a x c d"), ("", "a"), ("a", ""), ("a b c d e f", "f e d c b a"), ("a a b", "b a a")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, r string, h string")
    got = [r.w for r in df.selectExpr("i", f"{metrics.wer('r', 'h')} AS w").orderBy("i").collect()]
    assert got == [pytest.approx(distance(a.split(), b.split()) / len(a.split()) if a else 1.0) for a, b in pairs]


def test_words_and_signs_as_one_class(spark):
    """White space, and signs of a clean page, character by character as plain code has them."""
    x = "".join(chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000)
    pieces = [f"a{c}b" for c in x if c.isspace()] + ["a" + c + "b" for c in "​᠎†ヿ"] + ["", "  ", " a  b ", "a"]
    df = spark.createDataFrame([(p,) for p in [*pieces, x]], "x string")
    assert [r.w for r in df.selectExpr(f"{t.words('x')} AS w").collect()] == [p.split() for p in [*pieces, x]]
    bare = "".join(x.split())
    plain = [c for c in bare if "؀" <= c <= "ۿ" or c.isascii() and c.isalnum() or c in ".,!?:;\"'()[]«»…-—"]
    row = df.where("char_length(x) > 9").selectExpr(f"{quality.garbage_ratio('x')} AS g", *evidence.counters("x", confidence="x")).first()
    assert abs(row.g - (1 - len(plain) / len(bare))) < 1e-12
    assert row.punctuation_count == 17 and row.digit_count == 20 and row.latin_count == 52


def test_once_is_left_out_where_nothing_reads_it(spark):
    got = t.once(spark.range(3).selectExpr("id", "CAST(id AS string) AS x"), y="concat(x, 'told')")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "told" not in plan(got.select("id")) and plan(got.where("y > '1'").selectExpr("y", "concat(y, y) AS z")).count("told") == 1
    assert [r.y for r in got.orderBy("id").collect()] == ["0told", "1told", "2told"]


def test_nfc_without_python(spark):
    text = ["é", "abc", "été", None, "آ", "가", "क़", "ᾴ"]
    got = t.with_nfc(spark.createDataFrame([(x,) for x in text], "x string"), "x")
    assert [r.x for r in got.collect()] == [x if x is None else unicodedata.normalize("NFC", x) for x in text]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
