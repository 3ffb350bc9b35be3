"""Chat formatting in budgeted windows (operator 9), in DataFrame and SQL functions only.

A turn becomes <s>role\\ntext</s>. Control strings in texts and roles are escaped: & as &amp;, and the first
character of any CONTROL string as &lt; or &lb; (a role's line feed as &nl;), so none is left inside a text, and the
replacements undone in reverse give the text back.

Prefix sums of the turns' tokens choose the windows: a window takes turns while the leading system turn, the
repeated history and the new turns stay within BUDGET tokens, and at least one new turn in any case (then
over_budget says so); windows begin and end between turns. Every window retains a leading system turn and repeats up
to HISTORY turns of up to HISTORY_TOKENS tokens before its first new turn. The loss mask has the texts of new
assistant turns, as code point spans of the formatted window; repeated targets are masked out.

A token is a word or a single other sign; a turn's frame counts TURN_TOKENS more.

A conversation is formatted in sections of SECTION turns by their place in it, so one conversation with a large share of
all rows is many rows; a window also ends where its section does. A section gets the last HISTORY turns of the one
before and the conversation's system turn by a join. Both the places and the joins are planned only where a conversation
has more turns than SECTION: turns are counted by blocks of turn numbers, the blocks' sizes are summed up, and a turn's
place is its block's start plus its place there, so no conversation is sorted in one task unless one block holds it.

SECTION must be HISTORY at least. The query's digests need a conversation's whole text in one row (read_back), as the SQL
function sha2 takes one string; windows don't.

Defined cases: null text or role is empty; null conv_id is a conversation of its own; null turn comes first; rows of
equal conv_id and turn are turns of their own in the order of role and text, repeated rows too; a conversation without
an assistant turn has an empty loss mask; an empty table gives no windows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, HISTORY_TOKENS, TURN_TOKENS, SECTION = 512, 2, 128, 4, 4096
#: Strings that mark turns or are known as controls to chat models.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(x: str) -> str:
    return rf"regexp_replace(regexp_replace(replace({x}, '&', '&amp;'), '<(?=/?s>|</?SYS>>)', '&lt;'), '\\[(?=/?INST\\])', '&lb;')"


def unescape(x: str) -> str:
    return f"replace(replace(replace({x}, '&lb;', '['), '&lt;', '<'), '&amp;', '&')"


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to a value that is computed once (a projection of its own could be merged into lambdas)."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _placed(turns: DataFrame, size: int) -> DataFrame:
    """turns plus section: a turn's place in its conversation, by turn, role and text, over size."""
    turns = turns.withColumn("block", F.expr(f"coalesce(CAST(floor(turn / {size}) AS bigint), -9223372036854775808)"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n")).select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text"))
    return turns.withColumn("place", place).alias("t").join(starts.alias("s"), F.expr("t.conv_id <=> s.conv_id AND t.block = s.block")).selectExpr("t.*", f"(start + place - 1) div {size} AS section").drop("block", "place")


def _grouped(turns: DataFrame, size: int, history: int) -> DataFrame:
    """conv_id, section, system (a turn or null), t (its turns in order, without that), back (the turns before it that may be repeated)."""
    piece = f"concat('<s>', replace({escape('role')}, '\\n', '&nl;'), '\\n', {escape('text')}, '</s>')"
    turns = turns.selectExpr("CAST(conv_id AS bigint) AS conv_id", "CAST(turn AS bigint) AS turn", "coalesce(CAST(role AS string), '') AS role", "coalesce(CAST(text AS string), '') AS text")
    many = (turns.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > size
    placed = _placed(turns, size) if many else turns.withColumn("section", F.lit(0).cast("bigint"))
    one = placed.selectExpr("conv_id", "section", "turn", "role", "text", f"{piece} AS piece", f"CAST(regexp_count(text, '(?U)\\\\w+|[^\\\\w\\\\s]') + {TURN_TOKENS} AS bigint) AS n", f"char_length({escape('text')}) AS long")
    got = one.groupBy("conv_id", "section").agg(F.expr("transform(array_sort(collect_list(struct(turn, role, text, piece, n, long))), t -> struct(t.role, t.piece, t.n, t.long))").alias("t"))
    own = "section = 0 AND t[0].role = 'system'"
    got = got.selectExpr("conv_id", "section", f"CASE WHEN {own} THEN t[0] END AS system", f"CASE WHEN {own} THEN slice(t, 2, size(t)) ELSE t END AS t")
    if not many:
        return got.selectExpr("*", "slice(t, 1, 0) AS back")
    first = got.where("section = 0 AND system IS NOT NULL").selectExpr("conv_id", "system AS s")
    last = got.selectExpr("conv_id", "section + 1 AS section", f"slice(t, greatest(size(t) - {history - 1}, 1), {history}) AS back")
    got = got.alias("g").join(last.alias("l"), F.expr("g.conv_id <=> l.conv_id AND g.section = l.section"), "left").selectExpr("g.*", "coalesce(l.back, slice(t, 1, 0)) AS back")
    return got.alias("g").join(first.alias("f"), F.expr("g.conv_id <=> f.conv_id AND g.section > 0"), "left").selectExpr("g.conv_id", "section", "coalesce(system, s) AS system", "t", "back")


def format_chats(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS, section: int = SECTION) -> DataFrame:
    """turns(conv_id, turn, role, text) -> one row a window: conv_id, section, window, n_repeated, n_new, n_tokens, over_budget, formatted, loss."""
    got = _grouped(turns, section, history).selectExpr("conv_id", "section", "system", "size(back) AS old", "concat(back, t) AS t")
    sums = "aggregate(t, array(0L), (a, x) -> array_append(a, element_at(a, -1) + x.n))"
    # by turn i: the first repeated turn of a window that begins there
    backs = f"transform(sequence(0, size(t)), i -> coalesce(array_min(filter(sequence(greatest(i - {history}, 0), i), j -> sums[i] - sums[j] <= {history_tokens})), i))"
    starts = f"""aggregate(sequence(old, greatest(size(t) - 1, old)), array(old), (a, i) ->
        IF(i > element_at(a, -1) AND fixed + sums[i + 1] - sums[backs[element_at(a, -1)]] > {budget}, array_append(a, i), a))"""
    window = "struct(s AS start, coalesce(get(starts, k + 1), size(t)) AS stop, backs[s] AS first, fixed + sums[coalesce(get(starts, k + 1), size(t))] - sums[backs[s]] AS n_tokens)"
    plan = _let("fixed", "coalesce(system.n, 0L)", _let("sums", sums, _let("backs", backs, _let("starts", starts, f"transform(starts, (s, k) -> {window})"))))
    got = got.selectExpr("conv_id", "section", "system", "t", f"posexplode({plan}) AS (window, w)").selectExpr(
        "conv_id", "section", "window", "w.n_tokens", "IF(system IS NULL OR (window = 0 AND section = 0), 0, 1) + w.start - w.first AS n_repeated",
        "concat(IF(system IS NULL, array(), array(system)), slice(t, w.first + 1, w.stop - w.first)) AS p",
    )
    ends = "aggregate(p, array(0), (a, x) -> array_append(a, element_at(a, -1) + char_length(x.piece)))"
    loss = "filter(transform(p, (x, i) -> IF(i >= n_repeated AND x.role = 'assistant', struct(ends[i + 1] - 4 - x.long AS start, ends[i + 1] - 4 AS end), NULL)), x -> x IS NOT NULL)"
    return got.selectExpr(
        "conv_id", "section", "window", "n_repeated", "size(p) - n_repeated AS n_new", "n_tokens", f"n_tokens > {budget} AS over_budget",
        "array_join(transform(p, x -> x.piece), '') AS formatted", f"{_let('ends', ends, loss)} AS loss",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Windows -> conv_id, turns (role, text), loss (text of each target) and formatted_chars, from the formatted strings alone."""
    role = unescape("replace(substring_index(x, chr(10), 1), '&nl;', chr(10))")
    turn = f"struct({role} AS role, {unescape('substring(x, locate(chr(10), x) + 1)')} AS text)"
    target = unescape("substring(formatted, s.start + 1, s.end - s.start)")
    return (
        windows.selectExpr(
            "conv_id", "section", "window", "char_length(formatted) AS chars",
            f"transform(slice(transform(split(formatted, '</s>'), x -> substring(x, 4)), n_repeated + 1, n_new), x -> {turn}) AS turns", f"transform(loss, s -> {target}) AS loss", "n_repeated",
        )
        .groupBy("conv_id").agg(F.expr("array_sort(collect_list(struct(section, window, turns, loss)))").alias("w"), F.sum("chars").cast("bigint").alias("formatted_chars"))
        .selectExpr("conv_id", "flatten(transform(w, x -> x.turns)) AS turns", "flatten(transform(w, x -> x.loss)) AS loss", "formatted_chars")
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trial = spark.sql("SELECT -1L AS conv_id, stack(2, 0L, 'user', 1L, 'assistant') AS (turn, role), '</s>[INST] ok [/INST]' AS text")
    got = read_back(format_chats(turns.unionByName(trial)))
    return got.selectExpr(
        "conv_id", "CAST(size(turns) AS bigint) AS n_turns", "sha2(array_join(transform(turns, x -> concat(x.role, '\\n', x.text, '\\n')), ''), 256) AS turns_sha256",
        "CAST(char_length(array_join(loss, '')) AS bigint) AS loss_chars", "sha2(array_join(loss, ''), 256) AS loss_sha256", "formatted_chars",
    )


#: For conversations of up to SECTION turns, as a window also ends where a section does.
OP9_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
e AS (SELECT *, regexp_replace(regexp_replace(replace(text, '&', '&amp;'), '<(/?s>|</?SYS>>)', '&lt;\1', 'g'), '\[(/?INST\])', '&lb;\1', 'g') AS et, replace(regexp_replace(regexp_replace(replace(role, '&', '&amp;'), '<(/?s>|</?SYS>>)', '&lt;\1', 'g'), '\[(/?INST\])', '&lb;\1', 'g'), chr(10), '&nl;') AS er FROM c),
f AS (SELECT *, length(er) + length(et) + 8 AS long, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')) + 4 AS n FROM e),
g AS (SELECT conv_id, list(struct_pack(role := role, text := text, long := long, n := n) ORDER BY turn NULLS FIRST, role, text) AS t FROM f GROUP BY conv_id),
h AS (SELECT conv_id, t AS every, CASE WHEN t[1].role = 'system' THEN t[2:] ELSE t END AS t, CASE WHEN t[1].role = 'system' THEN t[1].n ELSE 0 END AS sn, CASE WHEN t[1].role = 'system' THEN t[1].long ELSE 0 END AS sl FROM g),
w AS (SELECT *, list_reduce(range(1, len(t) + 1), lambda st, i: CASE
    WHEN i = 1 OR st.tot + t[i].n <= 512 THEN struct_pack(tot := CAST(st.tot + t[i].n AS BIGINT), chars := CAST(st.chars + t[i].long AS BIGINT))
    WHEN i > 2 AND t[i - 1].n + t[i - 2].n <= 128 THEN struct_pack(tot := CAST(sn + t[i - 2].n + t[i - 1].n + t[i].n AS BIGINT), chars := CAST(st.chars + sl + t[i - 2].long + t[i - 1].long + t[i].long AS BIGINT))
    WHEN t[i - 1].n <= 128 THEN struct_pack(tot := CAST(sn + t[i - 1].n + t[i].n AS BIGINT), chars := CAST(st.chars + sl + t[i - 1].long + t[i].long AS BIGINT))
    ELSE struct_pack(tot := CAST(sn + t[i].n AS BIGINT), chars := CAST(st.chars + sl + t[i].long AS BIGINT)) END, struct_pack(tot := CAST(sn AS BIGINT), chars := CAST(sl AS BIGINT))) AS done,
    array_to_string(list_transform(list_filter(every, lambda x: x.role = 'assistant'), lambda x: x.text), '') AS loss FROM h)
SELECT conv_id, CAST(len(every) AS BIGINT) AS n_turns, sha256(array_to_string(list_transform(every, lambda x: x.role || chr(10) || x.text || chr(10)), '')) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, done.chars AS formatted_chars FROM w
"""
