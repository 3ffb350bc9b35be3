"""Benchmark decontamination (operator 1), in DataFrame and SQL functions only.

An item's windows are its runs of WINDOW consecutive words (an item of fewer words, but not none, is one window).
Prefix-filtered set join: a window is the set of its words in the order of their rarity in all documents. Since all
of them must occur, the necessary prefix is the rarest one: only places where a document has it are candidates.
The positional bound gives the place where the window would start, the length bound drops starts outside the
document, and the words from there on are compared with the window's.

Plan: documents' words are counted for the benchmark's vocabulary (partial aggregates, then one row a word); then
words are exploded, joined with the windows by their prefix word and verified in one stage, and only hits are
shuffled, to their document. The windows are broadcast if the benchmark has up to BROADCAST_BYTES of text, which is
measured first; beyond that the join is a shuffle of words, where adaptive execution splits the frequent ones.

Defined cases: null text has no words; a document without hits has n_items 0 and items_sha256 of the empty string;
items without words have no windows; items of null item_id are left out; equal windows of several items hit all of
them; repeated documents and items give their rows each, or count once as item_id; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

WINDOW = 8
BROADCAST_BYTES = 32 << 20
#: Never null, so rows of null text are known by it too.
TEXT_HASH = "xxhash64(CAST({} AS string))"
SEPARATORS = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: str = "text"):
    """The words of a text column, A-Z folded; other characters keep their case."""
    fold = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return F.expr(f"array_remove(split(CASE WHEN {text} IS NULL THEN '' WHEN octet_length({text}) = char_length({text}) THEN lower({text}) ELSE {fold.format(text)} END, '{SEPARATORS}'), '')")


def windows(items: DataFrame, counts: DataFrame, size: int = WINDOW) -> DataFrame:
    """items(item_id, w), counts(word, n) -> prefix word, its place in the window, the window and its items."""
    each = items.where("size(w) > 0").select(
        "item_id", F.expr(f"explode(transform(sequence(0, greatest(size(w) - {size}, 0)), i -> slice(w, i + 1, {size}))) AS win")
    )
    each = each.groupBy("win").agg(F.array_distinct(F.collect_list("item_id")).alias("items"))
    rare = each.select("win", F.posexplode("win").alias("at", "word")).join(counts, "word", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("p"))
    return each.join(rare, "win").select(F.col("p.word").alias("word"), F.col("p.at").alias("at"), "win", "items")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, least_items: int = 2) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> one row a document: doc_id, text_hash, n_words, n_hit, n_items, items, contaminated."""
    items = items.where("item_id IS NOT NULL").select("item_id", words().alias("w"), F.octet_length("text").alias("bytes"))
    small = (items.agg(F.sum("bytes")).first()[0] or 0) <= BROADCAST_BYTES
    hint = F.broadcast if small else (lambda df: df)
    vocabulary = hint(items.select(F.explode("w").alias("word")).distinct())
    counts = docs.select(F.explode(words()).alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("n"))
    win = windows(items.select("item_id", "w"), counts, size)
    both = docs.select("doc_id", F.expr(TEXT_HASH.format("text")).alias("text_hash"), words().alias("w")).withColumn("row", F.monotonically_increasing_id())
    fits = "place - at >= 0 AND place - at + size(win) <= size(w) AND slice(w, place - at + 1, size(win)) = win"
    if small:
        # the empty word, which no text has, ends each document's words and meets one row without a window
        mark = win.sparkSession.sql("SELECT '' AS word, 0 AS at").select("word", "at", F.lit(None).cast("array<string>").alias("win"), F.lit(None).cast(win.schema["items"].dataType).alias("items"))
        hits = both.select("row", "doc_id", "text_hash", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("place", "word")).join(hint(win.unionByName(mark)), "word").where(f"win IS NULL OR {fits}")
    else:
        # candidates go back to their text by doc_id and text hash, each once however often the row is repeated
        found = both.select("doc_id", "text_hash", F.posexplode("w").alias("place", "word")).join(win.withColumn("win_id", F.xxhash64("win")), "word").select("doc_id", "text_hash", "place", "at", "win_id", "win", "items").dropDuplicates(["doc_id", "text_hash", "place", "at", "win_id"])
        hits = both.alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id AND d.text_hash = f.text_hash")).select("row", "d.doc_id", "d.text_hash", "w", "place", "at", "win", "items").where(fits)
        hits = hits.unionByName(both.selectExpr("row", "doc_id", "text_hash", "w", "size(w) AS place", "0 AS at", "CAST(NULL AS array<string>) AS win"), allowMissingColumns=True)
    # one row of a document has its number of words, the others a start and its window's length
    hits = hits.selectExpr("row", "doc_id", "text_hash", "CASE WHEN win IS NULL THEN place END AS n_words", "CASE WHEN win IS NOT NULL THEN sequence(place - at, place - at + size(win) - 1) END AS hit", "items")
    per = hits.groupBy("row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("text_hash").alias("text_hash"), F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return per.select("doc_id", "text_hash", F.col("n_words").cast("bigint").alias("n_words"), F.size("hit").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", (F.size("items") >= least_items).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW, least_items: int = 2) -> DataFrame:
    """The rows of docs that are not contaminated: a row is known by doc_id and its text's hash, as equal texts are decided alike."""
    store.shared_base(docs.sparkSession)  # where checkpoint() writes
    bad = decontaminate(docs, items, size, least_items).where("contaminated").select("doc_id", "text_hash").distinct().coalesce(1 + store.partitions(docs.sparkSession) // 8).checkpoint()
    side = F.broadcast(bad) if bad.count() * 24 <= BROADCAST_BYTES else bad
    # names are qualified, so docs may have any other columns
    return docs.alias("clean_docs").join(side.alias("clean_bad"), F.expr(f"clean_docs.doc_id <=> clean_bad.doc_id AND {TEXT_HASH.format('clean_docs.text')} = clean_bad.text_hash"), "left_anti")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = decontaminate(docs.select("doc_id", "text"), items)
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.expr("sha2(array_join(array_sort(transform(items, i -> CAST(i AS string))), ','), 256)").alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, CASE WHEN len(w) < 8 THEN w ELSE w[i + 1 : i + 8] END AS k FROM b, unnest(range(greatest(len(w) - 7, 1))) u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT len(k) AS n FROM win), dw AS (
  SELECT doc_id, i, n, w[i + 1 : i + n] AS k FROM d, sizes, unnest(range(greatest(len(w) - n + 1, 0))) u(i)
), hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (k) WHERE len(k) = n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN its USING (doc_id)
"""
