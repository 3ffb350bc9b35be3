"""Recognition metrics against reference text: character and word error rates, punctuation recall."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import text as t

# Signs whose recall is measured, and marks that a loose comparison leaves out.
SIGNS = ".,:;!?()[]{}\"'«»…-–—،؛؟"
MARKS = r"[\\u064B-\\u065F\\u0670\\u06D6-\\u06ED\\u0640]"


def normalize(x: str, loose: bool = False) -> str:
    """White space collapsed and stripped; loose also drops marks. x should be in NFC."""
    return t.collapse(f"regexp_replace({x}, '{MARKS}', '')" if loose else x)


def rate(distance: str, size: str, empty: str) -> str:
    return f"IF({size} = 0, IF({empty}, 0D, 1D), {distance} / {size})"


def cer(ref: str, hyp: str, loose: bool = False) -> str:
    return t.let("p", f"struct({normalize(ref, loose)} AS r, {normalize(hyp, loose)} AS h)", rate("levenshtein(p.r, p.h)", "char_length(p.r)", "p.h = ''"))


#: Distinct words of a pair that have a character each: all of Unicode from U+0100 on but the surrogates.
CODES = 0x10FFFF - 0x800 - 0x100


def wer(ref: str, hyp: str, loose: bool = False) -> str:
    """Levenshtein over words: each distinct word of the pair becomes one character, from U+0101 on; pairs of more than CODES words are compared row by row."""
    point = "256 + array_position(v, w)"
    code = f"array_join(transform({{0}}, w -> decode(unhex(lpad(hex({point} + IF({point} >= 55296, 2048, 0)), 8, '0')), 'UTF-32')), '')"
    step = "least(element_at(row, -1) + 1, above[j] + 1, above[j - 1] + IF(p.h[j - 1] = w, 0, 1))"
    line = f"aggregate(sequence(1, size(p.h)), array(above[0] + 1), (row, j) -> array_append(row, {step}))"
    plain = f"element_at(aggregate(p.r, sequence(0, size(p.h)), (above, w) -> IF(size(p.h) = 0, array(above[0] + 1), {line})), -1)"
    distance = f"IF(size(v) <= {CODES}, levenshtein({code.format('p.r')}, {code.format('p.h')}), {plain})"
    inner = t.let("v", "array_distinct(concat(p.r, p.h))", rate(distance, "size(p.r)", "size(p.h) = 0"))
    return t.let("p", f"struct({t.words(normalize(ref, loose))} AS r, {t.words(normalize(hyp, loose))} AS h)", inner)


def punctuation_recall(ref: str, hyp: str) -> str:
    """Share of the reference's signs that the reading has as often; null if it has none."""
    signs = "array(" + ", ".join("'" + s.replace("'", "\\'") + "'" for s in SIGNS) + ")"
    of = "char_length({0}) - char_length(replace({0}, s, ''))"
    total = f"aggregate({signs}, 0, (a, s) -> a + {of.format('p.r')})"
    kept = f"aggregate({signs}, 0, (a, s) -> a + least({of.format('p.r')}, {of.format('p.h')}))"
    return t.let("p", f"struct({ref} AS r, {hyp} AS h)", f"{kept} / nullif({total}, 0)")


def page_report(pairs: DataFrame, ref: str = "reference", hyp: str = "hypothesis") -> DataFrame:
    """pairs plus cer, wer, cer_loose, wer_loose, punctuation_recall and ref_chars; a missing reading is empty."""
    h = f"coalesce({hyp}, '')"
    return pairs.selectExpr(
        "*", f"{cer(ref, h)} AS cer", f"{wer(ref, h)} AS wer", f"{cer(ref, h, True)} AS cer_loose", f"{wer(ref, h, True)} AS wer_loose",
        f"{punctuation_recall(ref, h)} AS punctuation_recall", f"CAST(char_length({normalize(ref)}) AS bigint) AS ref_chars",
    )
