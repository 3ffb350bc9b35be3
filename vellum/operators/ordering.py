"""Reading order of right-to-left pages: rows by a fold over lines, blocks by layout.

Lines are an array of structs (kind, x0, y0, x1, y1, text, confidence, reading_order); its order is the input order.
A page's lines stay in its row, so nothing is shuffled.
"""

from __future__ import annotations

from ..functions.text import let


def rows(lines: str) -> str:
    """The lines with their row: taken by y0, a line joins the first open row whose extent holds its centre, else it opens one.

    Gives array<struct<row, lo, pos, line>>: row in order of opening, lo the row's least y0, pos the order of joining.
    """
    by_top = f"array_sort(transform({lines}, (l, i) -> struct(l.y0 AS y0, i AS i, l AS l)))"
    extent = "array<struct<lo:double,hi:double>>"
    step = let(
        "k", "coalesce(array_position(transform(a.rows, r -> r.lo <= (s.y0 + s.l.y1) / 2 AND (s.y0 + s.l.y1) / 2 <= r.hi), true), 0)",
        "struct(IF(k = 0, array_append(a.rows, struct(s.y0 AS lo, s.l.y1 AS hi)), transform(a.rows, (r, j) -> IF(j + 1 = k, struct(least(r.lo, s.y0) AS lo, greatest(r.hi, s.l.y1) AS hi), r))) AS rows, "
        "array_append(a.own, IF(k = 0, size(a.rows), CAST(k AS int) - 1)) AS own)",
    )
    fold = f"aggregate(srt, struct(CAST(array() AS {extent}) AS rows, CAST(array() AS array<int>) AS own), (a, s) -> {step})"
    out = let("f", fold, "transform(srt, (s, i) -> struct(f.own[i] AS row, f.rows[f.own[i]].lo AS lo, i AS pos, s.l AS line))")
    return let("srt", by_top, out)


def right_to_left(lines: str) -> str:
    """Lines top to bottom by row, within a row by descending x0; ties keep their order."""
    keyed = f"array_sort(transform({rows(lines)}, r -> struct(r.lo AS lo, r.row AS row, -r.line.x0 AS x, r.pos AS pos, r.line AS line)))"
    return f"transform({keyed}, r -> r.line)"


def by_block(lines: str) -> str:
    """Lines by their reading_order (that of a layout block), in each by right_to_left."""
    orders = f"array_sort(array_distinct(transform({lines}, l -> coalesce(l.reading_order, 0))))"
    return let("ls", lines, f"flatten(transform({orders.replace(lines, 'ls')}, o -> {right_to_left('filter(ls, l -> coalesce(l.reading_order, 0) = o)')}))")


def assemble(lines: str) -> str:
    return f"array_join(transform({lines}, l -> l.text), '\\n')"
