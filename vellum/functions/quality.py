"""Page quality: signals, weighted score, warnings and tier, as SQL expressions over text and confidence."""

from __future__ import annotations

import string
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from . import text as t

# The frequent Arabic function words by which prose is told from garbage.
FUNCTION_WORDS = (
    "في", "من", "على", "إلى", "عن", "مع", "هذا", "هذه", "هذان", "هؤلاء", "ذلك", "تلك", "التي", "الذي", "الذين",
    "و", "أو", "ثم", "لكن", "لا", "لن", "لم", "ما", "لو", "إن", "أن", "إذا", "كان", "كانت", "يكون", "تكون",
    "قال", "قالت", "يقول", "قد", "لقد", "كل", "بعض", "غير", "أي", "حتى", "بين", "عند", "لدى", "نحو",
    "هو", "هي", "هم", "هن", "أنا", "أنت", "أنتم", "نحن", "كنت", "كنا", "يكونون",
    "الله", "رب", "يا", "أيها", "ألا", "إلا", "بل", "سوف", "س", "ب", "ل", "ك",
)
# Characters outside the script that a clean page may have, as in a pattern's class; those up to U+00FF one by one, as Java looks them up in a table then.
PLAIN, OTHER = rf"{string.ascii_letters}{string.digits}.,!?:;\"\'()\\[\\]«»\\-", r"\\u0660-\\u0669…—"


@dataclass(frozen=True)
class Script:
    """The script that pages are expected in: its letters as a pattern's class, and its function words."""

    letters: str = r"\\u0600-\\u06FF"
    words: tuple[str, ...] = FUNCTION_WORDS


#: A Latin profile, for corpora in languages of western Europe.
LATIN = Script(r"A-Za-z\\u00C0-\\u024F", ("the", "of", "and", "to", "in", "a", "is", "that", "de", "la", "le", "et", "der", "die", "und", "que", "el", "en", "un", "les", "des", "for", "was", "on", "it", "with"))


@dataclass(frozen=True)
class Rules:
    """Weights and limits; the defaults are those of the documentation."""

    weights: dict[str, float] = field(default_factory=lambda: {"engine_confidence": 0.5, "arabic_char_ratio": 0.2, "dictionary_hit_rate": 0.15, "length_anomaly": 0.1, "garbage_symbol_ratio": 0.05})
    high: float = 80.0
    medium: float = 60.0
    low: float = 30.0
    script: Script = Script()


def _script(bare: str, s: Script) -> str:
    return f"IF({bare} = '', 0D, {t.chars(bare, f'[{s.letters}]')} / char_length({bare}))"


def _garbage(bare: str, s: Script) -> str:
    return f"IF({bare} = '', 0D, 1 - char_length(regexp_replace({bare}, '[^[{PLAIN}][{OTHER}{s.letters}]]+', '')) / char_length({bare}))"


def _length(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0D WHEN {n} < 40 THEN {n} / 40D ELSE 1D END"


def _line(lines: str) -> str:
    return f"IF(size({lines}) < 4, false, {t.repeats(lines, 3)})"


def _ngram(words: str, n: int = 4, times: int = 6) -> str:
    run = ", ".join(f"{words}[i + {k}]" if k else f"{words}[i]" for k in range(n))
    return f"IF(size({words}) < {n * times}, false, {t.repeats(f'transform(sequence(0, size({words}) - {n}), i -> xxhash64({run}))', times)})"


def script_ratio(x: str, s: Script = Script()) -> str:
    return t.let("b", t.bare(x), _script("b", s))


def garbage_ratio(x: str, s: Script = Script()) -> str:
    return t.let("b", t.bare(x), _garbage("b", s))


def dictionary_rate(x: str, s: Script = Script()) -> str:
    """Function words among the runs of letters, 1 from a quarter on; 0.5 for fewer than 5 runs. x must be in NFC."""
    known = ", ".join(f"'{w}'" for w in s.words)
    hits = f"size(filter(k, w -> w IN ({known})))"
    return t.let("k", f"regexp_extract_all({x}, '([{s.letters}]+)', 1)", f"IF(size(k) < 5, 0.5D, least(1D, {hits} / size(k) / 0.25D))")


def length_score(x: str) -> str:
    return t.let("n", f"char_length({t.strip(x)})", _length("n"))


def repeated_line(x: str) -> str:
    """Four lines or more, one of them three times."""
    return t.let("ls", t.lines(x), _line("ls"))


def repeated_ngram(x: str, n: int = 4, times: int = 6) -> str:
    """A run of n words that occurs so often, overlaps counted, in n * times words or more. Runs are compared by 64-bit hashes."""
    return t.let("ws", t.words(x), _ngram("ws", n, times))


def _signals(confidence: str, x: str, b: str, n: str, s: Script) -> dict[str, str]:
    return {
        "engine_confidence": f"coalesce(CAST({confidence} AS double), 50D)",
        "arabic_char_ratio": f"{_script(b, s)} * 100",
        "dictionary_hit_rate": f"{dictionary_rate(x, s)} * 100",
        "length_anomaly": f"{_length(n)} * 100",
        "garbage_symbol_ratio": f"(1 - {_garbage(b, s)}) * 100",
    }


def _score(of: dict[str, str], rules: Rules) -> str:
    """The weighted mean of signals, of which of has the expressions."""
    return "(" + " + ".join(f"{rules.weights.get(k, 0.0)!r}D * {e}" for k, e in of.items()) + f") / {sum(rules.weights.values()) or 1.0!r}D"


def flagged(text: str = "text", confidence: str = "confidence", rules: Rules = Rules()) -> str:
    """Whether score_pages would give the tier LOW or CRITICAL or a warning, for reports that need no more than that.

    The same rules, from the cheapest to the dearest; the first that holds settles it, and the others are not evaluated.
    """
    x, s = f"coalesce({text}, '')", rules.script
    of = _signals(confidence, x, "b", "n", s)
    score = _score(of | {"arabic_char_ratio": "a", "garbage_symbol_ratio": "g"}, rules)
    low = f"NOT (score >= {rules.high}D OR score >= {rules.medium}D)"
    runs = t.let("ls", t.lines(x), _line("ls")) + " OR " + t.let("ws", t.words(x), _ngram("ws"))
    rest = t.let("g", of["garbage_symbol_ratio"], f"g < 70 OR {t.let('score', score, low)} OR {runs}")
    scored = t.let("b", t.bare(x), t.let("a", of["arabic_char_ratio"], f"a < 30 OR {rest}"))
    return f"({confidence} IS NULL OR {t.let('n', f'char_length({t.strip(x)})', f'n < 20 OR {scored}')})"


def score_pages(pages: DataFrame, rules: Rules = Rules(), text: str = "text", confidence: str = "confidence") -> DataFrame:
    """pages plus signals (map), score, warnings and tier. A null confidence counts as 50.

    Text without white space, words and lines are made once, and all signals are read off them, once too.
    """
    kept, s = [c for c in pages.columns if not c.startswith("_")], rules.script
    x = f"coalesce({text}, '')"
    pages = t.once(pages, _x=x, _w=t.words(x), _l=t.lines(x), _n=f"char_length({t.strip(x)})")
    pages = t.once(pages, _b="array_join(_w, '')")
    signal = _signals(confidence, "_x", "_b", "_n", s)
    pages = t.once(pages, **{f"_{k}": e for k, e in signal.items()}, _line=_line("_l"), _gram=_ngram("_w"))
    score = _score({k: f"_{k}" for k in signal}, rules)
    warnings = (
        "array_compact(array(IF(_arabic_char_ratio < 30, 'low_arabic_content', NULL), IF(_garbage_symbol_ratio < 70, 'high_garbage_symbol_density', NULL), IF(_n < 20, 'near_empty_page', NULL), "
        f"IF({confidence} IS NULL, 'native_confidence_unavailable', NULL), IF(_line, 'repeated_line_detected', NULL), IF(_gram, 'degenerate_repetition', NULL)))"
    )
    tier = f"CASE WHEN _line OR _gram THEN 'CRITICAL' WHEN score >= {rules.high}D THEN 'HIGH' WHEN score >= {rules.medium}D THEN 'MEDIUM' WHEN score >= {rules.low}D THEN 'LOW' ELSE 'CRITICAL' END"
    signals = "map(" + ", ".join(f"'{k}', _{k}" for k in signal) + ")"
    return pages.selectExpr(*kept, f"{signals} AS signals", f"{score} AS score", f"{warnings} AS warnings", "_line", "_gram").selectExpr(*kept, "signals", "score", "warnings", f"{tier} AS tier")
