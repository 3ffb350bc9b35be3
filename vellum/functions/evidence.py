"""Evidence counters of a reading, its disagreement with a baseline, and artifact names."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from . import text as t

# Patterns of the evidence counters; characters up to U+00FF stand one by one, as Java looks them up in a table then.
PUNCTUATION = r"[[.!?:;«»()\\[\\]\\-][\\u060c-\\u2026&&[،؛؟…—]]]"
DIGIT = rf"[{string.digits}\\u0660-\\u0669]"
LATIN = f"[{string.ascii_letters}]"
TAG = r"<\\s*/?\\s*[A-Za-z][^>]*>"
# Characters of a page number.
PAGE_NUMBER = r"^[0-9\\u0660-\\u0669ivxlcIVXLC\\-–—. ()\\[\\]]{1,8}$"


def tags(x: str) -> str:
    """How many tags a text holds; only one with their first sign is searched."""
    return f"IF(contains({x}, '<'), {t.count(x, TAG)}, 0)"


def counters(x: str = "text", regions: str = "0", confidence: str = "confidence") -> list[str]:
    x = f"coalesce({x}, '')"
    return [
        f"CAST(char_length({x}) AS bigint) AS character_count", f"CAST({t.any_line(x)} AS bigint) AS line_count", f"CAST({regions} AS bigint) AS region_count",
        *(f"CAST({t.chars(x, p)} AS bigint) AS {n}_count" for n, p in (("punctuation", PUNCTUATION), ("digit", DIGIT), ("latin", LATIN))), f"CAST({tags(x)} AS bigint) AS html_tag_count",
        f"{confidence} IS NOT NULL AS native_confidence_available",
    ]


def disagreement(base: str, x: str) -> str:
    """Levenshtein distance over the longer length; 0 if both are empty. Its cost is the product of the lengths, but none for equal texts."""
    return f"IF({base} = {x}, 0D, levenshtein({base}, {x}) / nullif(greatest(char_length({base}), char_length({x})), 0))"


def edits(a: str, b: str) -> int:
    """Levenshtein distance by code points: a column of the table of distances is two integers of a bit for each character of the shorter text (Myers, Hyyro)."""
    a, b = sorted((a, b), key=len)
    if not a:
        return len(b)
    at: dict = {}
    for i, c in enumerate(a):
        at.setdefault(c, []).append(i)
    size = len(a) // 8 + 1
    masks = {}
    for c, found in at.items():
        bits = bytearray(size)
        for i in found:
            bits[i >> 3] |= 1 << (i & 7)
        masks[c] = int.from_bytes(bits, "little")
    every, last = (1 << len(a)) - 1, len(a) - 1
    up, down, score = every, 0, len(a)  # where the distance rises or falls from one row to the next
    for c in b:
        same = masks.get(c, 0)
        x = same | down
        y = (((same & up) + up) ^ up) | same
        rises, falls = (down | ~(y | up)) & every, up & y
        score += (rises >> last & 1) - (falls >> last & 1)
        rises, falls = rises << 1 | 1, falls << 1
        up, down = (falls | ~(x | rises)) & every, rises & x & every
    return score


@pandas_udf(IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """levenshtein() of long texts, in a fraction of its time; null where either is."""
    return pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(a, b)], dtype="Int32")


#: Cells of the table of distances from which edits() is quicker than the built-in function.
LONG = 100_000


def length_ratio(base: str, x: str) -> str:
    return f"char_length({x}) / greatest(char_length({base}), 1)"


def is_page_number(x: str) -> str:
    """Up to 8 characters of numerals and signs, with a digit among them."""
    return t.let("p", t.strip(x), f"p rlike '{PAGE_NUMBER}' AND p rlike '{DIGIT}'")


def has_html(x: str) -> str:
    return f"(contains({x}, '<') AND {x} rlike '{TAG}')"


def artifact_name(processing_pass: str, engine: str) -> str:
    safe = f"trim(BOTH '-' FROM regexp_replace({engine}, '[^A-Za-z0-9_.-]+', '-'))"
    return f"concat('pass-', {processing_pass}, '-', coalesce(nullif({safe}, ''), 'engine'), '.json')"


def html_to_text(x: str) -> str:
    """Breaks and closed blocks become line feeds, other tags go, the five basic entities are resolved."""
    x = f"regexp_replace(regexp_replace({x}, '(?i)<br\\\\s*/?>|</(?:p|div|li|tr|h[1-6])>', '\\n'), '<[^>]+>', '')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\\'"), ("&nbsp;", "\\u00a0"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return t.strip(x)
