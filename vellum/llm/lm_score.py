"""Scoring by an interpolated modified Kneser-Ney model of order 3 (operator 3).

The model is counted in Spark and stored as sorted hash arrays in the shared folder, which workers map into memory.
Nothing is pruned and all counts are 64-bit integers.

1. Words: each task counts its words' hashes; a shard of them numbers its words by falling count, number times
   shards plus shard being a word's id, so frequent words have small ids without any global order.
2. Trigrams (u, v, w): a second scan counts them by ids and deals them to shards by the hash of (v, w). They are sent
   sorted, as planes of bytes, of which the compression of the shuffle leaves about a third.
3. A shard holds every trigram of a pair (v, w), so its reduction gives the trigrams' counts, written as sorted hash
   arrays, and the pairs' continuation counts N1+(.vw). It sums up what contexts (u, v) and words need: how often a
   context occurs and how many trigrams of it are seen once, twice and more; a word's continuation count, and the like
   sums over the pairs that it begins.
4. Those meet in another shuffle, by pair and by word, one blob from a task to a shard, and are written: a pair's row
   holds what it needs as an end and as a context, so a text's pairs are looked up once each. A pair that is a context
   occurs, so a continuation count of one goes without saying; it is sent only for pairs before a text's end.
5. Scores: a last scan of the texts looks up words, pairs and trigrams.

p1(w)     = (max(N1+(.w) - D, 0) + (share of discounts) / (V+1)) / N1+(..), V+1 counting the unknown word;
p2(w|v)   = (max(a - D(a), 0) + gamma(v) p1(w)) / a(v.), a = N1+(.vw), but the raw count where v is the begin mark;
p3(w|u,v) = (max(c - D(c), 0) + gamma(u, v) p2(w|v)) / c(uv.), or p2 for an unseen context, as p2 is p1 for an unseen v.
D1, D2, D3+ are estimated at each level from the counts of counts. A text's words follow two begin marks, which are not
scored, and lead to one end, which is.

A pair's trigrams are in one shard, reduced in each task first: a pair that very many texts hold is as many entries as
it has different words before it.

Defined cases: null or empty text is its end alone; null doc_id is hashed as an empty text and returned as null;
repeated rows count each time; with nothing to learn from, V = N = 0 and every token has probability 1; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, vec
from .vec import U

SPACE = vec.byte_class([0x20, *range(0x09, 0x0E)])
END, BEGIN = vec.mix(np.array([0xE4D, 0xB16], U))
#: The id of a word that was not learned.
UNKNOWN = U(1 << 63)
SLICE = 6 << 20
HELD = 3_000_000
#: Kinds of sections in a blob, and their columns: pairs as ends of several trigrams, pairs before a text's end of one,
#: contexts that occur once, and more often, words, counts of counts.
ENDS, LAST, ONCE, MORE, WORD, STAT = range(6)
COLUMNS = (2, 1, 1, 5, 6, 10)
OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
_DONE = "kind int, shard int, " + ", ".join(f"x{i} bigint" for i in range(17))


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, each text's words and its end, and the tokens before each text."""
    c = vec.sums(vec.BYTE[vec.LOWER[data]])
    s, e, words = vec.runs(~SPACE[data], off)
    docs = len(off) - 1
    at = words + np.arange(docs + 1)
    tok = np.empty(len(s) + docs, U)
    is_end = np.zeros(len(tok), bool)
    is_end[at[1:] - 1] = True
    tok[is_end] = END
    tok[~is_end] = vec.span(c, s, e)
    return tok, at


def before(tok: np.ndarray, at: np.ndarray, begin) -> tuple[np.ndarray, np.ndarray]:
    """The two ids before each token (u, v); begin before a text's first."""
    u, v = np.empty_like(tok), np.empty_like(tok)
    v[1:], u[2:] = tok[:-1], tok[:-2]
    v[at[:-1]] = u[at[:-1]] = begin
    u[at[:-1][np.diff(at) > 1] + 1] = begin
    return u, v


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return vec.mix(vec.mix(v) * U(0xD6E8FEB86659FD93) + w)


def triple(uv: np.ndarray, w: np.ndarray) -> np.ndarray:
    return vec.mix(uv * U(0x9FB21C651E98DF25) + w)


@dataclass(frozen=True)
class Model:
    """What workers need to score: where the arrays are, N, V and the discounts of the three levels."""

    folder: str
    bits: int
    tokens: int
    words: int
    discount: tuple[tuple[float, ...], ...]
    continuations: int
    rest: float


def discounts(n: list[int]) -> tuple[float, ...]:
    """(0, D1, D2, D3+) from the numbers of types seen 1, 2, 3 and 4 times."""
    if min(n) <= 0:
        return 0.0, 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return (0.0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)))


def _totals(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(store.firsts_of(keys))
    return keys[at], np.add.reduceat(values[order], at, axis=0) if len(at) else values[:0]


def _kinds(n: np.ndarray) -> np.ndarray:
    """Columns: whether a count is one, two, or more."""
    return np.stack([n == 1, n == 2, n > 2], 1).astype(np.int64)


def word_rows(folder: str, bits: int, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes' ids, their counts, place of each token and last of the begin mark among them)."""
    distinct, inv = np.unique(np.append(tok, BEGIN), return_inverse=True)
    row = store.find(folder, "word", bits, distinct, 2)  # 1 + id, count
    return np.where(row[:, 0] > 0, (row[:, 0] - 1).astype(U), UNKNOWN), row[:, 1], inv


def fit(docs: DataFrame) -> Model:
    """Counts the model over all texts of docs."""
    spark = docs.sparkSession
    store.prepare(spark)
    docs = docs.select(F.col("text").cast("string").alias("text"))
    folder, bits, parts = store.new_folder(spark, "lm"), store.shard_bits(spark), store.partitions(spark)
    shard_of = lambda h: (h >> U(64 - bits)).astype(np.int64)
    rest = lambda h: (h << U(bits)) >> U(24)

    def flush_words(held):
        key, n = _totals(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        yield from _blobs(0, shard_of(key), np.stack([rest(key).astype(np.int64), n], 1))

    @store.frugal
    def map_words(batches):
        held, n = [], 0
        for b in batches:
            for _, _, data, off in vec.texts(b, SLICE):
                held.append(np.unique(np.append(tokens(data, off)[0], BEGIN), return_counts=True))
                held[-1][1][held[-1][0] == BEGIN] = 0  # is no token, but has an id
                n += len(held[-1][0])
                if n > HELD:
                    yield from flush_words(held)
                    held, n = [], 0
        if n:
            yield from flush_words(held)

    @store.frugal
    def reduce_words(batches):
        out: list = []
        for (_, shard), got in store.gather(batches).items():
            key, n = _totals(*store.unpack_columns(got, 2).T)
            key = key.astype(U)
            ids = np.empty(len(n), np.int64)
            ids[np.argsort(-n, kind="stable")] = (np.arange(len(n)) << bits) + shard
            store.save_sorted(folder, f"word-{shard}", key, np.stack([ids + 1, n], 1).astype(np.uint64))
            out.append((0, shard, int(n.sum()), int((n > 0).sum())))
        yield store.rows("kind int, shard int, tokens bigint, words bigint", out)

    step = store.deal(docs.mapInArrow(map_words, store.BLOB), parts).mapInArrow(reduce_words, "kind int, shard int, tokens bigint, words bigint")
    total, words = store.run_step(step, folder, {0: ("word",)})

    def flush_trigrams(held):
        u, v, w = (np.concatenate(x) for x in zip(*held))
        shard = shard_of(pair(v, w))
        # the order of (shard, v, w, u) but for the low bits of very many ids: what does not lie side by side then is summed up later
        third = (64 - bits) // 3
        cut = U(max(0, int(max(u.max(), v.max(), w.max())).bit_length() - third))
        key = (shard.astype(U) << U(64 - bits)) | (v >> cut << U(2 * third)) | (w >> cut << U(third)) | (u >> cut)
        order = np.argsort(key)
        u, v, w, shard = u[order], v[order], w[order], shard[order]
        at = np.flatnonzero(vec.firsts(v, w, u))
        n = np.diff(np.append(at, len(u)))
        yield from _blobs(0, shard[at], np.stack([*(x[at].astype(np.int64) for x in (v, w, u)), n], 1))

    @store.frugal
    def map_trigrams(batches):
        held, n = [], 0
        for b in batches:
            for _, _, data, off in vec.texts(b, SLICE):
                tok, at = tokens(data, off)
                ids, _, inv = word_rows(folder, bits, tok)
                tok = ids[inv]
                held.append((*before(tok[:-1], at, tok[-1]), tok[:-1]))
                n += len(tok)
                if n > HELD:
                    yield from flush_trigrams(held)
                    held, n = [], 0
        if n:
            yield from flush_trigrams(held)

    @store.frugal
    def reduce_trigrams(batches):
        ids, _, inv = word_rows(folder, bits, np.array([END]))
        end, begin = ids[inv]
        contexts, sums, sections = [], [], {}  # of all of the task's shards; sections by the shard they go to
        for (_, shard), got in store.gather(batches).items():
            x = store.unpack_columns(got, 4)
            v, w, u, n = (x[:, i].astype(U) if i < 3 else x[:, i] for i in range(4))
            p = pair(v, w)
            order = np.lexsort((u, p))
            u, v, w, p, n = (x[order] for x in (u, v, w, p, n))
            at = np.flatnonzero(vec.firsts(p, u))
            u, v, w, p, n = u[at], v[at], w[at], p[at], np.add.reduceat(n, at)
            uv = pair(u, v)
            t = rest(triple(uv, w))
            order = np.argsort(t)
            single = n[order] == 1
            store.save_sorted(folder, f"single-{shard}", t[order][single])
            store.save_counts(folder, "triple", shard, t[order][~single], n[order, None][~single])
            at = np.flatnonzero(store.firsts_of(p))
            a = np.where(v[at] == begin, np.add.reduceat(n, at), np.diff(np.append(at, len(p))))
            key = rest(p[at]).astype(np.int64)
            own = sections.setdefault(shard, {})
            own[STAT] = np.stack([np.bincount(np.minimum(x, 5), minlength=6)[1:] for x in (n, a)]).ravel()[None]
            own[ENDS] = np.stack([key, a], 1)[a > 1]
            own[LAST] = key[(a == 1) & (w[at] == end), None]
            contexts.append(_totals(uv, np.concatenate([n[:, None], _kinds(n)], 1)))
            none = np.zeros((len(at), 4), np.int64)
            ends, begins = np.concatenate([none[:, :1] + 1, none], 1), np.concatenate([none[:, :1], a[:, None], _kinds(a)], 1)
            sums.append(_totals(np.concatenate([w[at], v[at]]).astype(np.int64), np.concatenate([ends, begins])))
        if not sums:
            return
        key, value = _totals(*(np.concatenate(x) for x in zip(*contexts)))
        once, record = value[:, 0] == 1, np.concatenate([rest(key).astype(np.int64)[:, None], value], 1)
        _split(sections, ONCE, shard_of(key[once]), record[once, :1])
        _split(sections, MORE, shard_of(key[~once]), record[~once])
        key, value = _totals(*(np.concatenate(x) for x in zip(*sums)))
        of = key & ((1 << bits) - 1)
        order = np.argsort(of, kind="stable")
        _split(sections, WORD, of[order], np.concatenate([key[order, None], value[order]], 1))
        for shard, parts in sections.items():
            packed = [(kind, store.pack_columns(x)) for kind, x in parts.items() if len(x)]
            blob = b"".join(bytes([kind]) + len(x).to_bytes(8, "little") + x for kind, x in packed)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], names=["kind", "shard", "blob"])

    @store.frugal
    def reduce_sums(batches):
        out: list = []
        for (_, shard), blobs in store.gather(batches).items():
            parts: list[list[bytes]] = [[] for _ in COLUMNS]
            for b in blobs:
                at = 0
                while at < len(b):
                    size = int.from_bytes(b[at + 1 : at + 9], "little")
                    parts[b[at]].append(b[at + 9 : at + 9 + size])
                    at += 9 + size
            ends, last, once, more, word, stat = (store.unpack_columns(x, n) for x, n in zip(parts, COLUMNS))
            wide = np.zeros((len(ends) + len(last) + len(once) + len(more), 5), np.int64)
            i, j, k = len(ends), len(ends) + len(last), len(wide) - len(more)
            wide[:i, 0], wide[i:j, 0], wide[j:k, 1:3], wide[k:, 1:] = ends[:, 1], 1, 1, more[:, 1:]
            key, value = _totals(np.concatenate([ends[:, 0], last[:, 0], once[:, 0], more[:, 0]]), wide)
            value[:, 0] = np.maximum(value[:, 0], 1)
            store.save_counts(folder, "pair", shard, key.astype(U), value)
            row = np.zeros(17, np.int64)
            row[0], row[7:] = 1, stat.sum(0) if len(stat) else 0
            if len(word):
                key, value = _totals(word[:, 0], word[:, 1:])
                dense = np.zeros((int(key[-1] >> bits) + 1, 5), np.uint64)
                dense[key >> bits] = value
                store.save(folder, f"sums-{shard}", dense)
                row[1:6], row[6] = np.bincount(np.minimum(value[:, 0], 5), minlength=6)[1:], value[:, 0].sum()
            out.append((int(len(stat) > 0) + 2 * int(len(word) > 0), shard, *row.tolist()))
        yield store.rows(_DONE, out)

    if total:
        sums = store.deal(docs.mapInArrow(map_trigrams, store.BLOB), parts).mapInArrow(reduce_trigrams, store.BLOB)
        done = store.deal(sums, parts).mapInArrow(reduce_sums, _DONE).collect()
    else:
        done = []
    have = {"pair": done, "sums": [r for r in done if r.kind & 2], "triple": [r for r in done if r.kind & 1]}
    have |= {"pair_large": done, "triple_large": have["triple"], "single": have["triple"]}
    store.manifest(folder, {name: sorted(r.shard for r in of) for name, of in have.items()})
    _, n1, n2, n3, n4, n5, cont, *stat = (sum(r[2 + i] for r in done) for i in range(17))
    d = discounts([n1, n2, n3, n4])
    left = d[1] * n1 + d[2] * n2 + d[3] * (n3 + n4 + n5)
    return Model(folder, bits, total, words, (d, discounts(stat[5:9]), discounts(stat[:4])), cont, left)


def _blobs(kind: int, shard: np.ndarray, columns: np.ndarray):
    """A batch of blobs, one a shard, which must be sorted."""
    if not len(shard):
        return
    at = np.flatnonzero(store.firsts_of(shard))
    blob = [store.pack_columns(columns[a:b]) for a, b in zip(at, np.append(at[1:], len(shard)))]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(shard[at].astype(np.int32)), pa.array(blob, pa.binary())], names=["kind", "shard", "blob"])


def _split(sections: dict, kind: int, shard: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to the sections of their shards, which must be sorted."""
    at = np.flatnonzero(store.firsts_of(shard))
    for a, b in zip(at.tolist(), np.append(at[1:], len(shard)).tolist()):
        sections.setdefault(int(shard[a]), {})[kind] = rows[a:b]


def _sums(m: Model, ids: np.ndarray) -> np.ndarray:
    """Continuation count, sum over the pairs it begins, and their kinds, of each word id."""
    out = np.zeros((len(ids), 5))
    shard = np.where(ids == UNKNOWN, -1, (ids & U((1 << m.bits) - 1)).astype(np.int64))
    for s in np.unique(shard[shard >= 0]).tolist():
        have = store.load(m.folder, f"sums-{s}")
        if have is not None:
            at = np.flatnonzero(shard == s)
            row = (ids[at] >> U(m.bits)).astype(np.int64)
            out[at[row < len(have)]] = have[row[row < len(have)]]
    return out


def log10_probabilities(m: Model, tok: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 p of each token, its training count)."""
    d1, d2, d3 = map(np.array, m.discount)
    ids, count, inv = word_rows(m.folder, m.bits, tok)
    word, tok = _sums(m, ids), ids[inv[:-1]]
    u, v = before(tok, at, ids[inv[-1]])
    _, ctx = before(inv[:-1], at, inv[-1])
    inv = inv[:-1]
    uniform = 1 / (m.words + 1)
    p1 = (word[:, 0] - d1[np.minimum(word[:, 0], 3).astype(int)] + m.rest * uniform) / m.continuations if m.continuations else np.full(len(ids), uniform)

    def level(c, d, total, kinds, lower):
        more = (np.maximum(c - d[np.minimum(c, 3)], 0) + kinds @ d[1:] * lower) / np.maximum(total, 1)
        return np.where(total > 0, more, lower)

    uv, vw = pair(u, v), pair(v, tok)
    # the pair before a token is the one that ends in the token before it; only a text's first token has none
    ends = store.find_counts(m.folder, "pair", m.bits, np.append(vw, uv[:1]), 5)
    context = np.empty((len(tok), 4), np.int64)
    context[1:] = ends[:-2, 1:]
    context[at[:-1]] = ends[-1, 1:]
    p = level(ends[:-1, 0], d2, word[ctx, 1], word[ctx, 2:], p1[inv])
    t = triple(uv, tok)
    c = store.find_counts(m.folder, "triple", m.bits, t, 1, by=vw)[:, 0]
    rare = np.flatnonzero(c == 0)
    c[rare] = store.find(m.folder, "single", m.bits, t[rare], 0, by=vw[rare])
    return np.log10(level(c, d3, context[:, 0], context[:, 1:], p)), count[inv]


def score(docs: DataFrame, m: Model, held_out) -> DataFrame:
    """docs(doc_id, text) -> OUT; held_out is a boolean column."""
    store.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))

    @store.frugal
    def run(batches):
        for b in batches:
            rows = [[] for _ in range(4)]
            for _, _, data, off in vec.texts(b, SLICE):
                tok, at = tokens(data, off)
                lp, n = log10_probabilities(m, tok, at)
                base = np.log10((n + 1) / (m.tokens + m.words + 1))
                for out, x in zip(rows, (np.diff(at), np.add.reduceat((n > 0).astype(np.int64), at[:-1]), np.add.reduceat(base, at[:-1]), np.add.reduceat(lp, at[:-1]))):
                    out.append(x)
            n, known, base, lp = (np.concatenate(x) if x else np.zeros(0) for x in rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), m.tokens, np.int64)), pa.array(base.astype(float)), pa.array(lp.astype(float))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.mapInArrow(run, OUT)


def fold(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores to six decimals, as sums of logarithms depend on their order beyond that."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = fold(7) == 2
    return score(docs, fit(docs.where(~out)), out).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, xor(list_reduce(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda s, ch: list_reduce(range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(s, ascii(ch))), 4294967295), 4294967295) % 7 = 2 AS held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' end') AS t, row_number() OVER () AS id FROM documents
), tok AS (SELECT id, held_out, t[i] AS w, CASE WHEN i > 1 THEN t[i - 1] ELSE ' begin' END AS v, CASE WHEN i > 2 THEN t[i - 2] ELSE ' begin' END AS u FROM d, unnest(range(1, len(t) + 1)) x(i)
), tri AS (SELECT u, v, w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY ALL),
two AS (SELECT v, w, CASE WHEN v = ' begin' THEN CAST(sum(c) AS BIGINT) ELSE count(*) END AS c FROM tri GROUP BY v, w),
one AS (SELECT w, count(*) AS c FROM two GROUP BY ALL),
word AS (SELECT w, CAST(sum(c) AS BIGINT) AS c FROM tri GROUP BY ALL),
kinds AS (SELECT level, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3, count(*) FILTER (c = 4) AS n4, count(*) FILTER (c > 2) AS more, sum(c) AS total
  FROM (SELECT 1 AS level, c FROM one UNION ALL SELECT 2, c FROM two UNION ALL SELECT 3, c FROM tri) GROUP BY level),
disc AS (SELECT level, n1, n2, more, total, least(n1, n2, n3, n4) > 0 AS ok, n1 / (n1 + 2 * n2) AS y, n3, n4 FROM kinds),
dd AS (SELECT level, CASE WHEN ok THEN least(greatest(1 - 2 * y * n2 / n1, 0.05), 0.95) ELSE 0.5 END AS d1, CASE WHEN ok THEN least(greatest(2 - 3 * y * n3 / n2, 0.05), 1.95) ELSE 1.0 END AS d2,
  CASE WHEN ok THEN least(greatest(3 - 4 * y * n4 / n3, 0.05), 2.95) ELSE 1.5 END AS d3, n1, n2, more, total FROM disc),
x1 AS (SELECT d1, d2, d3, d1 * n1 + d2 * n2 + d3 * more AS rest, total FROM dd WHERE level = 1), x2 AS (SELECT d1, d2, d3 FROM dd WHERE level = 2), x3 AS (SELECT d1, d2, d3 FROM dd WHERE level = 3),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM word),
h2 AS (SELECT v, sum(c) AS total, sum(CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) AS gamma FROM two, x2 GROUP BY v),
h3 AS (SELECT u, v, sum(c) AS total, sum(CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) AS gamma FROM tri, x3 GROUP BY u, v),
p1 AS (SELECT tok.*, word.c AS c, (coalesce(one.c - CASE one.c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0) + rest / (n.v + 1)) / x1.total AS q1, n.n AS n_all, n.v AS n_words FROM tok LEFT JOIN one USING (w) LEFT JOIN word USING (w), x1, n),
p2 AS (SELECT p1.*, CASE WHEN h2.total IS NULL THEN q1 ELSE (coalesce(two.c - CASE two.c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0) + h2.gamma * q1) / h2.total END AS q2 FROM p1 LEFT JOIN two ON two.v = p1.v AND two.w = p1.w LEFT JOIN h2 ON h2.v = p1.v, x2),
p3 AS (SELECT p2.*, CASE WHEN h3.total IS NULL THEN q2 ELSE (coalesce(tri.c - CASE tri.c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0) + h3.gamma * q2) / h3.total END AS q3
  FROM p2 LEFT JOIN tri ON tri.u = p2.u AND tri.v = p2.v AND tri.w = p2.w LEFT JOIN h3 ON h3.u = p2.u AND h3.v = p2.v, x3),
s AS (SELECT id, count(*) AS n_tokens, count(c) AS n_known, any_value(n_all) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n_all + n_words + 1))), 6) AS base_score, round(sum(log10(q3)), 6) AS score FROM p3 GROUP BY id)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score FROM d JOIN s USING (id)
"""
