"""Exact substring deduplication (operator 2).

Rule: over whole UTF-8 texts, each byte covered by a string of `length` bytes that also starts earlier (smaller
doc_id, or the same document at a smaller offset) goes; strings are judged on the input and never cross documents.

Method: blockwise suffix sorting to depth `length` with a sampled cover. The cover is a string synchronising set,
the content-defined form of a difference cover: position p is sampled if its k-gram has the least hash among the
w = length-k+1 k-grams of some window, so any two equal strings hold a sampled position at the same distance
from their starts. An index-based difference cover has the same property but needs 12 % of all positions
(period 73) where this one needs 2/(w+1), under 5 %; only that fits the disk budget.

1. Ranks of the cover sample: each sampled k-gram's class. A class of one suffix is settled: nothing repeats there.
2. Suffix buckets, one class at a time: the run of starts that share a sampled position, by the hash of the bytes
   it spans. Equal runs are long ties: settled by their rank, without looking at their suffixes.
3. Runs of one class that differ are cut into their single suffixes, which are sorted to depth `length`.

Each step is a shuffle of packed arrays, reduced in each task first, so a class of a third of all documents
arrives as one entry a task; a class with very many occurrences is dealt by run, not by class. Results of a
step are sorted files in the shared folder. Equality is that of 128 bits of hashes: in step 2 of the sampled k-gram and
the run, in step 3 of the string and of its halves. Texts that share a doc_id are told apart by a 64-bit hash.

Defined cases: null text is empty; null doc_id comes first; rows equal in doc_id and text count as one document
(each gets that document's result), rows equal in doc_id only are ordered by a hash of the text; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import store, vec
from .vec import U

LENGTH = 100
#: Occurrences from which a class is dealt by run.
HOT = 20_000
#: Sampled positions a task holds before it hands them on.
HELD = 3_000_000
OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
_RUN = np.dtype([("key", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("th", "<u8"), ("at", "<u4"), ("n", "<u2"), ("hot", "u1")])
_POS = np.dtype([("key", "<u8"), ("key2", "<u8"), ("doc", "<i8"), ("th", "<u8"), ("at", "<u4")])
_IVL = np.dtype([("doc", "<i8"), ("th", "<u8"), ("at", "<u4"), ("end", "<u4")])
RUN, POS, IVL = 0, 1, 2
_DONE = "kind int, shard int, n bigint"


def sampled(data: np.ndarray, off: np.ndarray, length: int):
    """(running sums, sampled position, first start, last start, document) of each run of starts."""
    k = max(1, int(length * 0.6))
    w = length - k + 1
    n, c = len(data), vec.sums(vec.BYTE[data])
    empty = np.zeros(0, np.int64)
    if n < length:
        return c, empty, empty, empty, empty
    h = vec.mix((c[k:] - c[:-k]) * vec.powers(n + 1)[1][: n - k + 1])
    m = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)
    have = 1
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[: len(m) - (w - have)], m[w - have :])
    a = (m & U(0xFFFFFFFF)).astype(np.int64)  # for start i: the sampled position of [i, i+length)
    ok = np.ones(len(a) + 1, bool)
    ok[-1] = False
    for s, e in zip(off[:-1].tolist(), off[1:].tolist()):
        ok[max(s, e - length + 1) : e] = False
    new = np.ones(len(a) + 1, bool)
    new[1:-1] = a[1:] != a[:-1]
    before = np.zeros(len(a) + 1, bool)
    before[1:] = ok[:-1]
    first = np.flatnonzero(ok & (new | ~before))
    last = np.flatnonzero(ok[:-1] & (new[1:] | ~ok[1:]))
    return c, a[first], first, last, np.searchsorted(off, first, "right") - 1


def _documents(batch, lo: int, hi: int, c: np.ndarray, off: np.ndarray):
    return vec.longs(batch.column("doc_id"))[lo:hi], vec.span(c, off[:-1], off[1:]) ^ vec.mix(np.diff(off).astype(U))


def _doc_shard(doc: np.ndarray, bits: int) -> np.ndarray:
    return (vec.mix(doc.astype(np.int64).view(U)) >> U(64 - bits)).astype(np.int64)


def _send(kind: int, rec: np.ndarray, shard: np.ndarray):
    order = np.argsort(shard, kind="stable")
    yield from store.blobs(kind, shard[order], store.as_bytes(rec[order]))


def _merge(x: np.ndarray) -> np.ndarray:
    """Touching or overlapping intervals of a document become one."""
    if not len(x):
        return x
    x = x[np.lexsort((x["end"], x["at"], x["th"], x["doc"]))]
    doc_new = vec.firsts(x["doc"], x["th"])
    group = np.cumsum(doc_new).astype(np.int64)
    reach = np.maximum.accumulate(x["end"].astype(np.int64) + (group << 33)) - (group << 33)
    new = doc_new.copy()
    new[1:] |= x["at"][1:] > reach[:-1]
    at = np.flatnonzero(new)
    out = x[at].copy()
    out["end"] = reach[np.append(at[1:], len(x)) - 1]
    return out


def _later(x: np.ndarray, *keys: str):
    """Sorted by keys and document order; of each group its first occurrence, and what differs from that."""
    x = x[np.lexsort((x["at"], x["th"], x["doc"], *(x[k] for k in reversed(keys))))]
    new = vec.firsts(*(x[k] for k in keys))
    lead = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    same = (x["doc"] == x["doc"][lead]) & (x["th"] == x["th"][lead]) & (x["at"] == x["at"][lead])
    return x, new, ~same


def _intervals(x: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(x), _IVL)
    out["doc"], out["th"], out["at"] = x["doc"], x["th"], x["at"]
    out["end"] = x["at"] + n - 1 + length
    return _merge(out)


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text) -> OUT, one row per document; spans are byte offsets of what goes."""
    spark: SparkSession = docs.sparkSession
    store.prepare(spark)
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    folder, bits, parts = store.new_folder(spark, "suffix"), store.shard_bits(spark), store.partitions(spark)
    rest = U(24 - bits)  # a class is known by its shard and the next 40 bits

    def flush_keys(keys: list):
        k, n = np.unique(np.concatenate(keys), return_counts=True)
        rec = np.concatenate([vec.pack((k << U(bits)) >> U(24), 5), np.minimum(n, 255).astype(np.uint8)[:, None]], 1)
        yield from store.blobs(0, (k >> U(64 - bits)).astype(np.int64), rec)

    def map_keys(batches):
        held, n = [], 0
        for b in batches:
            for _, _, data, off in vec.texts(b):
                c, p, *_ = sampled(data, off, length)
                if len(p):
                    held.append(vec.span(c, p, p + max(1, int(length * 0.6))))
                    n += len(p)
            if n > HELD:
                yield from flush_keys(held)
                held, n = [], 0
        if held:
            yield from flush_keys(held)

    def reduce_keys(batches):
        out: list = []
        for (_, shard), got in store.gather(batches).items():
            rec = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 6) for x in got])
            k, n = vec.unpack(np.ascontiguousarray(rec[:, :5]), 5), rec[:, 5].astype(np.int64)
            order = np.argsort(k)
            k, n = k[order], n[order]
            at = np.flatnonzero(store.firsts_of(k))
            total = np.add.reduceat(n, at)
            again = total > 1
            store.save(folder, f"rank-{shard}", k[at][again])
            store.save(folder, f"hot-{shard}", k[at][total >= HOT])
            out.append((0, shard, int(again.sum())))
        yield store.rows(_DONE, out)

    step = store.deal(docs.select("text").mapInArrow(map_keys, store.BLOB), parts).mapInArrow(reduce_keys, _DONE)
    found = store.run_step(step, folder, {0: ("rank", "hot")})[0]
    doc_bits = bits

    def known(key: np.ndarray, name: str) -> np.ndarray:
        out = np.zeros(len(key), bool)
        shard = (key >> U(64 - bits)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange((1 << bits) + 1))
        low = (key << U(bits)) >> U(24)
        for s in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            have = store.load(folder, f"{name}-{s}")
            if have is not None and len(have):
                at = order[ends[s] : ends[s + 1]]
                i = np.searchsorted(have, low[at])
                out[at] = have[np.minimum(i, len(have) - 1)] == low[at]
        return out

    def flush_runs(held: list):
        x, _, later = _later(np.concatenate(held), "key", "ctx")
        gone = x[later]
        yield from _send(IVL, ivl := _intervals(gone, gone["n"], length), _doc_shard(ivl["doc"], doc_bits))
        x = x[~later & vec.firsts(x["key"], x["ctx"], x["doc"], x["th"], x["at"])]
        yield from _send(RUN, x, (vec.mix(x["key"] ^ np.where(x["hot"] > 0, x["ctx"], U(0))) >> U(64 - bits)).astype(np.int64))

    def map_runs(batches):
        k, held, n = max(1, int(length * 0.6)), [], 0
        for b in batches:
            for lo, hi, data, off in vec.texts(b):
                c, p, first, last, d = sampled(data, off, length)
                key = vec.span(c, p, p + k)
                keep = known(key, "rank")
                if not keep.any():
                    continue
                key, p, first, last, d = key[keep], p[keep], first[keep], last[keep], d[keep]
                doc, th = _documents(b, lo, hi, c, off)
                x = np.zeros(len(p), _RUN)
                x["key"], x["ctx"] = key, vec.mix(vec.span(c, first, last + length) + (p - first).astype(U))
                x["doc"], x["th"], x["at"], x["n"], x["hot"] = doc[d], th[d], first - off[d], last - first + 1, known(key, "hot")
                held.append(x)
                n += len(x)
            if n > HELD // 4:
                yield from flush_runs(held)
                held, n = [], 0
        if held:
            yield from flush_runs(held)

    def reduce_runs(batches):
        for (kind, shard), got in store.gather(batches).items():
            if kind == IVL:
                x = _merge(np.concatenate([np.frombuffer(g, _IVL) for g in got]))
                yield from store.blobs(IVL, np.full(len(x), shard), store.as_bytes(x))
                continue
            x, new, later = _later(np.concatenate([np.frombuffer(g, _RUN) for g in got]), "key", "ctx")
            gone = x[later]
            yield from _send(IVL, ivl := _intervals(gone, gone["n"], length), _doc_shard(ivl["doc"], doc_bits))
            x = x[new]
            at = np.flatnonzero(vec.firsts(x["key"]))
            many = np.repeat(np.diff(np.append(at, len(x))) > 1, np.diff(np.append(at, len(x)))) | (x["hot"] > 0)
            x = x[many]
            yield from _send(RUN, x, _doc_shard(x["doc"], doc_bits))

    def write_runs(batches):
        out: list = []
        for (kind, shard), got in store.gather(batches).items():
            if kind == IVL:
                x = _merge(np.concatenate([np.frombuffer(g, _IVL) for g in got]))
                store.save(folder, f"tie-{shard}", x)
            else:
                x = np.concatenate([np.frombuffer(g, _RUN) for g in got])[["doc", "th", "at", "n"]]
                x = x[np.lexsort((x["at"], x["th"], x["doc"]))]
                store.save(folder, f"open-doc-{shard}", np.ascontiguousarray(x["doc"]))
                store.save(folder, f"open-{shard}", x.astype(_OPEN))
            out.append((kind, shard, len(x)))
        yield store.rows(_DONE, out)

    if found:
        runs = store.deal(docs.mapInArrow(map_runs, store.BLOB), parts).mapInArrow(reduce_runs, store.BLOB)
        store.run_step(store.deal(runs, parts).mapInArrow(write_runs, _DONE), folder, {IVL: ("tie",), RUN: ("open", "open-doc")})
    else:
        store.manifest(folder, dict.fromkeys(("tie", "last"), []))

    def flush_positions(held: list):
        x, _, later = _later(np.concatenate(held), "key", "key2")
        gone = x[later]
        yield from _send(IVL, ivl := _intervals(gone, np.ones(len(gone), np.uint32), length), _doc_shard(ivl["doc"], doc_bits))
        x = x[~later & vec.firsts(x["key"], x["key2"], x["doc"], x["th"], x["at"])]
        yield from _send(POS, x, (x["key"] >> U(64 - bits)).astype(np.int64))

    def map_positions(batches):
        held, n = [], 0
        for b in batches:
            for lo, hi, data, off in vec.texts(b):
                doc = vec.longs(b.column("doc_id"))[lo:hi]
                d, rec = _of_documents(folder, "open", doc, doc_bits)
                if not len(d):
                    continue
                c = vec.sums(vec.BYTE[data])
                _, th = _documents(b, lo, hi, c, off)
                keep = rec["th"] == th[d]
                d, rec = d[keep], rec[keep]
                count = rec["n"].astype(np.int64)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = np.repeat(rec["at"].astype(np.int64), count) + step
                d = np.repeat(d, count)
                s = off[d] + at
                x = np.zeros(len(s), _POS)
                half = s + length // 2
                x["key"], x["key2"] = vec.span(c, s, s + length), vec.mix(vec.span(c, s, half) * U(vec.BASE) ^ vec.span(c, half, s + length))
                x["doc"], x["th"], x["at"] = doc[d], th[d], at
                held.append(x)
                n += len(x)
            if n > HELD // 2:
                yield from flush_positions(held)
                held, n = [], 0
        if held:
            yield from flush_positions(held)

    def reduce_positions(batches):
        for (kind, shard), got in store.gather(batches).items():
            if kind == IVL:
                x = _merge(np.concatenate([np.frombuffer(g, _IVL) for g in got]))
                yield from store.blobs(IVL, np.full(len(x), shard), store.as_bytes(x))
                continue
            x, _, later = _later(np.concatenate([np.frombuffer(g, _POS) for g in got]), "key", "key2")
            gone = x[later]
            yield from _send(IVL, ivl := _intervals(gone, np.ones(len(gone), np.uint32), length), _doc_shard(ivl["doc"], doc_bits))

    def write_spans(batches):
        out: list = []
        for (_, shard), got in store.gather(batches).items():
            x = _merge(np.concatenate([np.frombuffer(g, _IVL) for g in got]))
            store.save(folder, f"last-{shard}", x)
            out.append((IVL, shard, len(x)))
        yield store.rows(_DONE, out)

    if found:
        positions = store.deal(docs.mapInArrow(map_positions, store.BLOB), parts).mapInArrow(reduce_positions, store.BLOB)
        store.run_step(store.deal(positions, parts).mapInArrow(write_spans, _DONE), folder, {IVL: ("last",)})

    def cut(batches):
        for b in batches:
            ids, out = b.column("doc_id"), []
            for lo, hi, data, off in vec.texts(b):
                c = vec.sums(vec.BYTE[data])
                doc, th = _documents(b, lo, hi, c, off)
                spans: dict[int, list] = {}
                for name in ("tie", "last"):
                    d, rec = _of_documents(folder, name, doc, doc_bits)
                    for i, t, s, e in zip(d.tolist(), rec["th"].tolist(), rec["at"].tolist(), rec["end"].tolist()):
                        if t == th[i]:
                            spans.setdefault(i, []).append((s, e))
                raw = data.tobytes()
                for i, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    merged: list[list[int]] = []
                    for x, y in sorted(spans.get(i, ())):
                        if merged and x <= merged[-1][1]:
                            merged[-1][1] = max(y, merged[-1][1])
                        else:
                            merged.append([x, y])
                    digest, pos = hashlib.sha256(), s
                    for x, y in merged:
                        digest.update(raw[pos : s + x])
                        pos = s + y
                    digest.update(raw[pos:e])
                    out.append((e - s, sum(y - x for x, y in merged), len(merged), digest.hexdigest(), [{"start": x, "end": y} for x, y in merged]))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(cols[i], pa.int64()) for i in range(3)), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return docs.mapInArrow(cut, OUT)


_OPEN = np.dtype([("doc", "<i8"), ("th", "<u8"), ("at", "<u4"), ("n", "<u2")])


def _of_documents(folder: str, name: str, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the sorted files that belong to these documents, with the document's index."""
    index, rows = [], []
    shard = _doc_shard(doc, bits)
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange((1 << bits) + 1))
    for s in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
        rec = store.load(folder, f"{name}-{s}")
        if rec is None or not len(rec):
            continue
        key = store.load(folder, f"open-doc-{s}") if name == "open" else _doc_column(folder, f"{name}-{s}")
        at = order[ends[s] : ends[s + 1]]
        lo, hi = np.searchsorted(key, doc[at]), np.searchsorted(key, doc[at], "right")
        n = hi - lo
        pick = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        index.append(np.repeat(at, n))
        rows.append(np.asarray(rec[pick]))
    if not index:
        return np.zeros(0, np.int64), np.zeros(0, _OPEN if name == "open" else _IVL)
    return np.concatenate(index), np.concatenate(rows)


_columns: dict = {}


def _doc_column(folder: str, name: str) -> np.ndarray:
    key = (folder, name)
    if key not in _columns:
        if len(_columns) > 512:
            _columns.clear()
        _columns[key] = np.ascontiguousarray(store.load(folder, name)["doc"])
    return _columns[key]


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


OP2_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM t, unnest(range(len(h) // 2 - 99)) u(i)),
f AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, i) > 1),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM f),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM g),
s AS (SELECT doc_id, n, min(i) AS a, max(i) + 100 AS b FROM r GROUP BY ALL),
p AS (SELECT doc_id, list(struct_pack(a := a, b := b) ORDER BY a) AS s FROM s GROUP BY doc_id)
SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(list_sum(list_transform(s, lambda x: x.b - x.a)), 0) AS BIGINT) AS n_removed, CAST(coalesce(len(s), 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN s IS NULL THEN h ELSE array_to_string(list_transform(range(len(s) + 1), lambda j: substr(h, CAST(2 * CASE WHEN j = 0 THEN 0 ELSE s[j].b END + 1 AS BIGINT), CAST(2 * (CASE WHEN j = len(s) THEN len(h) // 2 ELSE s[j + 1].a END - CASE WHEN j = 0 THEN 0 ELSE s[j].b END) AS BIGINT))), '') END)) AS kept_sha256
FROM t LEFT JOIN p USING (doc_id)
"""
