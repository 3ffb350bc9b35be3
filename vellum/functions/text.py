"""Text rules as SQL expressions over a string expression, all of them built-in functions."""

from __future__ import annotations

from pyspark.sql import functions as F

#: White space as Python's str.isspace() has it: as a class of a Java pattern inside a SQL literal, and as characters of a SQL literal.
#: Characters up to U+00FF stand one by one, as Java looks them up in a table then, and one range is asked before all others.
SPACE = r"[\\t\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x1f\\x20\\x85\\xa0[\\u1680-\\u3000&&[\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]]]"
_SPACES = "".join(f"\\u{c:04x}" for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
#: Line ends as str.splitlines() has them; CR LF is one.
LINE_END = r"\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"


def let(name: str, value: str, body: str) -> str:
    """body with name bound to a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def once(df, **columns: str):
    """df plus columns that are computed once a row, whatever later projections and filters do with them, or not at all if nobody asks.

    Their condition, which always holds, isn't deterministic to Spark: so it neither merges projections nor pushes filters
    through this one, as it would otherwise, repeating expressions wherever they are used, even inside lambdas. Columns
    that nothing reads are still pruned.
    """
    return df.selectExpr("*", *(f"IF(monotonically_increasing_id() >= 0, {e}, NULL) AS {n}" for n, e in columns.items()))


def strip(x: str) -> str:
    """Without white space at both ends; only the ends are looked at."""
    return f"trim(BOTH '{_SPACES}' FROM {x})"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{SPACE}+', ' ')")


def bare(x: str) -> str:
    """Without any white space."""
    return f"regexp_replace({x}, '{SPACE}+', '')"


def words(x: str) -> str:
    """Runs of anything but white space. A stripped text has no empty ones, unless it is empty."""
    return let("s", strip(x), f"IF(s = '', CAST(array() AS array<string>), split(s, '{SPACE}+'))")


def count(x: str, pattern: str) -> str:
    return f"regexp_count({x}, '{pattern}')"


def chars(x: str, cls: str) -> str:
    """How many characters are of a class (a pattern's, in brackets): what is left out without them, so no match is kept."""
    return f"(char_length({x}) - char_length(regexp_replace({x}, '{cls}+', '')))"


def lines(x: str) -> str:
    """Stripped lines, split at line feeds only, without empty ones."""
    return f"array_remove(transform(split({x}, '\\n'), l -> {strip('l')}), '')"


def any_line(x: str) -> str:
    """The number of lines that hold more than white space, split at every line end."""
    return f"size(filter(split({x}, '{LINE_END}'), l -> {strip('l')} <> ''))"


def repeats(array: str, times: int) -> str:
    """Whether a value occurs so often. Only an array with times - 1 values too many is sorted; a value's first and last then lie times - 1 apart."""
    found = let("s", "sort_array(r)", f"exists(sequence(0, size(s) - {times}), i -> s[i] = s[i + {times - 1}])")
    return let("r", array, f"IF(size(r) - size(array_distinct(r)) < {times - 1}, false, {found})")


def nfc(x):
    """Canonical composition of a string column, by the ICU library that Spark carries, as there is no built-in function.

    A text without characters from U+0300 on is composed already and is passed on as it is.
    """
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(False))
    return F.when(x.rlike("[^\\x00-\\u02ff]"), composed).otherwise(x)


def with_nfc(df, *columns: str):
    return df.withColumns({c: nfc(F.col(c)) for c in columns})
