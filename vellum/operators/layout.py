"""Layout assignment: each line takes kind and order of the first block that holds its centre."""

from __future__ import annotations

from ..functions.evidence import is_page_number
from .ordering import by_block, right_to_left

# Labels of a layout model and the kinds they stand for; others are body.
LABELS = {
    "Text": "body", "ListGroup": "body", "ListItem": "body", "TextInlineMath": "body", "Title": "heading", "SectionHeader": "heading", "PageHeader": "header", "PageFooter": "footer",
    "Caption": "caption", "Footnote": "footnote", "Table": "table", "TableOfContents": "body", "TableCell": "table", "Picture": "illustration", "Figure": "illustration", "Diagram": "illustration",
    "ChemicalBlock": "illustration", "Equation": "body", "Code": "body", "Form": "body", "Bibliography": "body", "BlankPage": "body",
}
KINDS = ("body", "heading", "header", "footer", "page_number", "footnote", "illustration", "watermark", "caption", "table")


def kind_of(label: str) -> str:
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in LABELS.items())
    return f"coalesce(element_at(map({pairs}), {label}), 'body')"


def assign(lines: str, blocks: str) -> str:
    """lines with kind and reading_order from blocks (array<struct<kind, x0, y0, x1, y1, reading_order>>, in list order).

    A line outside all blocks is body and comes after them. Numerals in a header or footer are page numbers.
    """
    holds = "b.x0 <= (l.x0 + l.x1) / 2 AND (l.x0 + l.x1) / 2 <= b.x1 AND b.y0 <= (l.y0 + l.y1) / 2 AND (l.y0 + l.y1) / 2 <= b.y1"
    last = f"coalesce(array_max(transform({blocks}, b -> coalesce(b.reading_order, 0))) + 1, 0)"
    kind = f"IF(m.kind IN ('header', 'footer') AND {is_page_number('l.text')}, 'page_number', coalesce(m.kind, 'body'))"
    line = f"struct({kind} AS kind, l.x0 AS x0, l.y0 AS y0, l.x1 AS x1, l.y1 AS y1, l.text AS text, l.confidence AS confidence, CAST(IF(m IS NULL, {last}, coalesce(m.reading_order, m.idx)) AS int) AS reading_order)"
    numbered = f"transform({blocks}, (b, i) -> struct(b.kind AS kind, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1, b.reading_order AS reading_order, i AS idx))"
    first = f"get(filter({numbered}, b -> {holds}), 0)"
    return f"transform({lines}, l -> element_at(transform(array({first}), m -> {line}), 1))"


def apply_layout(pages, lines: str = "lines", blocks: str = "blocks", error: str = "CAST(NULL AS string)"):
    """pages plus regions in reading order, provider and layout_warnings; null blocks or an error fall back to rows alone."""
    usable = f"{blocks} IS NOT NULL AND {error} IS NULL"
    pages = pages.selectExpr("*", f"{assign(lines, blocks)} AS _assigned")
    regions = f"CASE WHEN {usable} THEN {by_block('_assigned')} ELSE {right_to_left(lines)} END"
    return pages.selectExpr(
        "* EXCEPT (_assigned)", f"{regions} AS regions", f"IF({usable}, 'layout', 'rtl-row-fallback') AS provider", f"IF({error} IS NULL, CAST(array() AS array<string>), array(concat('layout_detection_failed:', {error}))) AS layout_warnings"
    )


def drop_footer_band(lines: str, height: str, share: float = 0.85) -> str:
    """Lines that begin above the footer band."""
    return f"filter({lines}, l -> l.y0 <= {share!r}D * {height})"
