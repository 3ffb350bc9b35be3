"""Near-duplicate classes by consistent weighted sampling (operator 5).

A text is the set of its 5-word shingles, each of weight tf * idf. Two texts are near duplicates if the weighted
Jaccard similarity of these sets is 0.8 or more; classes are the connected components of that relation.
idf = 1 + IDF * ln(N / df) / ln(N): damped, so that a text copied to a third of all rows, whose shingles are
common for that reason alone, still counts as equal to its copies.

1. Document frequencies of all shingles, and the first document of each distinct text. Equal texts are one node
   from here on, so a group of copies of any size is one entry.
2. Improved consistent weighted sampling: for each of BANDS * ROWS functions the shingle (and level t) of least
   ln a = ln c - r (t - b) - r, t = floor(ln w / r + b), with r, c ~ Gamma(2, 1) and b ~ U(0, 1) drawn by the
   shingle's hash. Bands of ROWS samples are hashed with the bucket of the text's total weight; a text goes to
   two buckets so that any two of a ratio over 0.8 meet, and only those can be similar enough.
3. Shingle vectors of texts that share a band are written once to the shared folder.
4. In each group of a band a text is verified only against texts of other components whose samples agree often
   enough, best first, so a group whose texts are all alike costs a few verifications a text, not one a pair. A pair
   that shares several bands is verified in each until it is of one component. Vectors are read in place.
5. Components by least labels with pointer jumping, cut by checkpoint().

By calculation a pair at exactly 0.8 shares a band with probability 0.9992, one at 0.9 with 0.999998.

Defined cases: words are runs of letters, digits and other non-ASCII characters, A-Z folded; texts of fewer words,
but not none, are one shingle; texts without words are near duplicates of equal texts only; null text is the empty
text; class_id is the least doc_id of the class (null doc_id after all others); repeated rows are of one class;
an empty table gives no rows; extra columns are kept by near_duplicates(keep=True) and ignored otherwise. What that keeps
of a class is its row of least doc_id and, among several of these, least text hash; of rows equal in both, one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import store, vec
from .vec import U

SHINGLE, SIMILARITY, IDF = 5, 0.8, 0.2
BANDS, ROWS = 10, 3
#: Samples that two texts must share before they are verified: of 30, Binomial(30, 0.8) has fewer than 14 once in
#: 30,000 times.
AGREE = 14
#: Failures after which a text is compared with its whole group, if that has up to so many shingles.
TRIES, GROUP_ITEMS, PROBES = 6, 4_000_000, 3
HELD = 1_500_000
BROADCAST_ROWS = 500_000
_MAX = (1 << 63) - 1
_KEYS = vec.mix(np.arange(1, BANDS * ROWS + 1, dtype=U)) | U(1)
_BAND = np.dtype([("key", "<u8"), ("node", "<u8"), ("band", "u1"), ("sig", "u1", (BANDS * ROWS,))])
_NODE = np.dtype([("th", "<u8"), ("doc", "<i8")])


def _quantiles():
    """r (Gamma(2,1)) and ln c at 65536 drawn levels."""
    g = np.random.default_rng(5)
    draw = lambda: -np.log((g.random(1 << 16) + 1e-12) * (g.random(1 << 16) + 1e-12))
    return draw().astype(np.float32), np.log(draw()).astype(np.float32)


R, LN_C = _quantiles()


def shingles(data: np.ndarray, off: np.ndarray, size: int = SHINGLE):
    """(hash, its document) of each shingle, in order, and the hash of each whole text."""
    c = vec.sums(vec.BYTE[data])
    whole = vec.span(c, off[:-1], off[1:]) ^ vec.mix(np.diff(off).astype(U))
    s, e, first = vec.runs(vec.WORD[data], off)
    h = vec.span(vec.sums(vec.BYTE[vec.LOWER[data]]), s, e)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    out = np.zeros(len(h), U)
    for i in range(size):
        out[: len(h) - i] += h[i:] * vec.powers(size)[0][i] if i < len(h) else 0
    place = np.arange(len(h)) - np.repeat(first[:-1], n)
    keep = place + size <= n[doc]
    for d in np.flatnonzero((n > 0) & (n < size)).tolist():
        a, b = first[d], first[d + 1]
        out[a] = (h[a:b] * vec.powers(size)[0][: b - a]).sum(dtype=U) + U(b - a)
        keep[a] = True
    return vec.mix(out[keep]), doc[keep], whole


def sets(h: np.ndarray, doc: np.ndarray):
    """Distinct shingles of each document in the order of their hashes, and how often each occurs."""
    o = np.argsort(h)
    o = o[np.argsort(doc[o].astype(np.uint16) if len(doc) and doc[-1] < 65536 else doc[o], kind="stable")]
    h, doc = h[o], doc[o]
    at = np.flatnonzero(vec.firsts(h, doc))
    return h[at], doc[at], np.diff(np.append(at, len(h)))


def samples(h: np.ndarray, start: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of (shingle, t) for each document (from start) and function."""
    ln_w = np.log(w).astype(np.float32)
    place = np.arange(len(h), dtype=U)
    out = np.zeros((len(start), len(_KEYS)), U)
    for i, k in enumerate(_KEYS):
        x = h * k
        r = R[(x >> U(48)).astype(np.int64)]
        b = ((x >> U(16)) & U(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(ln_w / r + b)
        a = LN_C[((x >> U(32)) & U(0xFFFF)).astype(np.int64)] - r * (t - b) - r
        bits = a.view(np.int32).astype(np.int64)
        order = np.where(bits < 0, ~bits & 0xFFFFFFFF, bits | 0x80000000).astype(U)  # sorts as the floats do
        best = (np.minimum.reduceat((order << U(32)) | place, start) & U(0xFFFFFFFF)).astype(np.int64)
        out[:, i] = vec.mix(h[best] + t[best].astype(np.int64).view(U))
    return out


def weights(folder: str, bits: int, h: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
    """Multiples of 1/1024, so that sums of them are exact in any order and a pair is decided alike wherever it is verified."""
    df = np.maximum(store.find(folder, "df", bits, h, 1)[:, 0], 1)
    return np.rint(1024 * tf * (1 + IDF * np.log(n / df) / np.log(n))) / 1024 if n > 1 else tf.astype(float)


def similarity(a, b) -> float:
    """Weighted Jaccard of two (sorted hashes, weights, total)."""
    if min(a[2], b[2]) < SIMILARITY / 2 * max(a[2], b[2]):
        return 0.0
    if len(a[0]) > len(b[0]):
        a, b = b, a
    i = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    m = float(np.minimum(a[1], b[1][i])[b[0][i] == a[0]].sum(dtype=float))
    return m / (a[2] + b[2] - m)


class Union:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class Group:
    """Shingle vectors of one group by local numbers, so that one text is compared with all others at once."""

    def __init__(self, vectors: list):
        n = np.array([len(v[0]) for v in vectors])
        self.start = np.cumsum(n) - n
        self.vocabulary, self.at = np.unique(np.concatenate([v[0] for v in vectors]), return_inverse=True)
        self.w = np.concatenate([v[1] for v in vectors])
        self.total = np.array([v[2] for v in vectors])
        self.own = np.zeros(len(self.vocabulary), np.float32)
        self.n = n

    def similarities(self, x: int) -> np.ndarray:
        mine = slice(self.start[x], self.start[x] + self.n[x])
        self.own[self.at[mine]] = self.w[mine]
        m = np.add.reduceat(np.minimum(self.own[self.at], self.w), self.start, dtype=float)
        self.own[self.at[mine]] = 0
        return m / (self.total + self.total[x] - m)


def cluster(nodes: np.ndarray, sig: np.ndarray, vector, size, union: Union) -> None:
    """Links the near duplicates of one group; union knows what is linked already.

    A text is first tried against PROBES members of the largest component; once it is of that, its other members are out of
    the question, so a group whose texts are nearly all alike costs a few verifications a text. Then it is verified
    against the earlier texts of other components whose samples agree often enough, best first; one that fails TRIES times
    is compared with all at once. No pair is left to the group of an earlier band: samples are known by a byte here,
    which does not tell whether it was in that group.
    """
    part = np.zeros(len(nodes), np.int64)  # component of each earlier text
    members: list[list[int]] = []
    of_root: dict[int, int] = {}
    most, others, n_others, whole = 0, np.empty(len(nodes), np.int64), 0, None  # the largest component, and the texts outside it

    def alike(x: int, y: int) -> bool:
        return similarity(vector(int(nodes[x])), vector(int(nodes[y]))) >= SIMILARITY

    def join(x: int, y: int) -> None:
        a, b = int(part[x]), int(part[y])
        union.join(int(nodes[x]), int(nodes[y]))
        if len(members[a]) < len(members[b]):
            a, b = b, a
        part[members[b]] = a
        members[a] += members[b]
        members[b] = []
        of_root[union.find(int(nodes[x]))] = a

    for x in range(len(nodes)):
        c = of_root.setdefault(union.find(int(nodes[x])), len(members))
        if c == len(members):
            members.append([])
        part[x] = c
        members[c].append(x)
        if x and c != most:
            for y in members[most][:PROBES]:
                if (sig[x] == sig[y]).sum() >= AGREE and alike(x, y):
                    join(x, y)
                    break
        seen = others[:n_others] if part[x] == most else np.flatnonzero(part[:x] != part[x])
        same = (sig[seen] == sig[x]).sum(1)
        todo, same = seen[same >= AGREE], same[same >= AGREE]
        todo = todo[np.argsort(-same, kind="stable")]
        failed = 0
        while len(todo):
            y = int(todo[0])
            todo = todo[1:]
            if failed >= TRIES and len(todo) > TRIES and whole is None:
                whole = sum(size(int(n)) for n in nodes) <= GROUP_ITEMS and Group([vector(int(n)) for n in nodes])
            if failed >= TRIES and whole:
                every = np.append(y, todo)
                near = every[whole.similarities(x)[every] >= SIMILARITY].tolist()
                todo = todo[:0]
            else:
                near = [y] if alike(x, y) else []
                failed += not near
            for y in near:
                if part[x] != part[y]:
                    join(x, y)
            if near and len(todo):
                todo = todo[part[todo] != part[x]]
        largest = int(part[x])
        if largest != most and len(members[largest]) > 2 * len(members[most]):
            most = largest
            left = np.flatnonzero(part[: x + 1] != most)
        elif largest != most:
            others[n_others], n_others = x, n_others + 1
            continue
        elif len(members[most]) + n_others == x + 1:
            continue
        else:  # components went into the largest
            left = others[:n_others][part[others[:n_others]] != most]
        others[: len(left)], n_others = left, len(left)


def components(edges: DataFrame, parts: int) -> DataFrame:
    """edges(a, b) -> (node, root): the least node of each component, by least labels with pointer jumping.

    What is kept of a round is written in parts files, as many as its few rows need. Labels are broadcast while there are
    up to BROADCAST_ROWS of them (16 bytes each), which is counted first.
    """
    both = edges.union(edges.select("b", "a")).toDF("src", "dst").distinct().coalesce(parts).checkpoint()
    labels = both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("root")).coalesce(parts).checkpoint()
    side = F.broadcast if labels.count() <= BROADCAST_ROWS else (lambda df: df)
    while True:
        near = both.join(side(labels.toDF("dst", "l")), "dst").groupBy("src").agg(F.min("l").alias("l")).withColumnRenamed("src", "node")
        step = near.join(side(labels), "node").select("node", F.least("root", "l").alias("root"), F.col("root").alias("old"))
        jump = step.join(side(labels.toDF("root", "up")), "root").select("node", F.least("root", "up").alias("root"), "old").coalesce(parts).checkpoint()
        labels = jump.select("node", "root")
        if jump.where("root <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, keep: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, class_id) for each row, or with keep the rows of docs that stay: one of each class."""
    spark: SparkSession = docs.sparkSession
    store.prepare(spark)
    all_docs = docs
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder, bits, parts = store.new_folder(spark, "near"), store.shard_bits(spark), store.partitions(spark)
    shard_of = lambda h: (h >> U(64 - bits)).astype(np.int64)

    def ids(batch):
        return pc.fill_null(batch.column("doc_id").cast(pa.int64()), _MAX).to_numpy(zero_copy_only=False)

    def flush_df(held):
        k, n = np.unique(np.concatenate(held), return_counts=True)
        yield from store.blobs(0, shard_of(k), [vec.pack((k << U(bits)) >> U(24), 5), n.astype("<u4")])

    @store.frugal
    def map_df(batches):
        held, n = [], 0
        for b in batches:
            nodes = []
            for lo, hi, data, off in vec.texts(b):
                h, doc, whole = shingles(data, off)
                held.append(sets(h, doc)[0])
                n += len(held[-1])
                nodes.append(np.array(list(zip(whole.tolist(), ids(b)[lo:hi].tolist())), _NODE))
            if nodes:
                x = np.concatenate(nodes)
                x = x[np.argsort(x["th"])]
                yield from store.blobs(1, shard_of(x["th"]), store.as_bytes(x))
            if n > HELD:
                yield from flush_df(held)
                held, n = [], 0
        if held:
            yield from flush_df(held)

    @store.frugal
    def reduce_df(batches):
        out: list = []
        for (kind, shard), got in store.gather(batches).items():
            if kind == 0:
                got = [store.split(x, 5, 4) for x in got]
                k, n = np.concatenate([vec.unpack(x[0], 5) for x in got]), np.concatenate([np.frombuffer(x[1], "<u4") for x in got]).astype(np.int64)
                o = np.argsort(k)
                k, n = k[o], n[o]
                at = np.flatnonzero(store.firsts_of(k))
                n = np.add.reduceat(n, at) if len(at) else n
                store.save_sorted(folder, f"df-{shard}", k[at][n > 1], n[n > 1].astype(np.uint64)[:, None])
                out.append((kind, shard, 0, 0))
            else:
                x = np.concatenate([np.frombuffer(g, _NODE) for g in got])
                x = x[np.lexsort((x["doc"], x["th"]))]
                out.append((kind, shard, len(x), len(x) - int(vec.firsts(x["th"], x["doc"]).sum())))
                at = np.flatnonzero(vec.firsts(x["th"]))
                store.save(folder, f"text-{shard}", np.ascontiguousarray(x["th"][at]))
                store.save(folder, f"doc-{shard}", np.ascontiguousarray(x["doc"][at]))
        yield store.rows(f"{_DONE}, again bigint", out)

    step = store.deal(docs.mapInArrow(map_df, store.BLOB), parts).mapInArrow(reduce_df, f"{_DONE}, again bigint")
    total, again = store.run_step(step, folder, {0: ("df",), 1: ("text", "doc")})

    def lookup(th: np.ndarray, keys: str, values: str, missing: int | np.ndarray) -> np.ndarray:
        """Values by text hash from sorted files of shards."""
        out = np.full(len(th), missing, np.int64)
        shard = shard_of(th)
        for s in np.unique(shard).tolist():
            key = store.load(folder, f"{keys}-{s}")
            if key is None or not len(key):
                continue
            at = np.flatnonzero(shard == s)
            i = np.minimum(np.searchsorted(key, th[at]), len(key) - 1)
            hit = key[i] == th[at]
            out[at[hit]] = store.load(folder, f"{values}-{s}")[i[hit]]
        return out

    def firsts_only(b, limit=1 << 20):
        """Slices of a batch cut down to the first document of each distinct text: (hashes, counts, start, text hash, document)."""
        for lo, hi, data, off in vec.texts(b, limit):
            h, doc, whole = shingles(data, off)
            h, doc, tf = sets(h, doc)
            first = lookup(whole, "text", "doc", -1) == ids(b)[lo:hi]
            pick = first[doc]
            h, doc, tf = h[pick], doc[pick], tf[pick]
            if len(h):
                start = np.flatnonzero(store.firsts_of(doc))
                yield h, tf, start, whole[doc[start]]

    @store.frugal
    def map_bands(batches):
        for b in batches:
            for h, tf, start, th in firsts_only(b):
                w = weights(folder, bits, h, tf, total)
                sig = samples(h, start, w)
                size = np.log(np.add.reduceat(w, start)) / -np.log(SIMILARITY)
                rec = []
                for i in range(BANDS):
                    key = np.full(len(th), i, U)
                    for j in range(ROWS):
                        key = vec.mix(key * U(vec.BASE) + sig[:, i * ROWS + j])
                    for bucket in (np.floor(size), np.floor(size) + 1):
                        x = np.zeros(len(th), _BAND)
                        x["key"], x["node"], x["band"], x["sig"] = vec.mix(key + bucket.astype(np.int64).view(U)), th, i, sig.astype(np.uint8)
                        rec.append(x)
                x = np.concatenate(rec)
                x = x[np.argsort(shard_of(x["key"]), kind="stable")]
                yield from store.blobs(0, shard_of(x["key"]), store.as_bytes(x))

    @store.frugal
    def reduce_bands(batches):
        for (_, shard), got in store.gather(batches).items():
            x = np.concatenate([np.frombuffer(g, _BAND) for g in got])
            x = x[np.lexsort((x["node"], x["key"]))]
            x = x[vec.firsts(x["key"], x["node"])]
            at = np.flatnonzero(vec.firsts(x["key"]))
            size = np.diff(np.append(at, len(x)))
            x = x[np.repeat(size > 1, size)]
            store.save(folder, f"group-{shard}", x)
            nodes = np.unique(x["node"])
            yield from store.blobs(0, shard_of(nodes), store.as_bytes(nodes))
            yield from store.blobs(1, np.array([shard]), np.zeros((1, 1), np.uint8))  # for the manifest

    def write_wanted(batches):
        out: list = []
        for (kind, shard), got in store.gather(batches).items():
            if kind == 0:
                store.save(folder, f"wanted-{shard}", np.unique(np.concatenate([np.frombuffer(g, "<u8") for g in got])))
            out.append((kind, shard, 1 - kind))
        yield store.rows(_DONE, out)

    bands = store.deal(docs.mapInArrow(map_bands, store.BLOB), parts).mapInArrow(reduce_bands, store.BLOB)
    any_group = store.run_step(store.deal(bands, parts).mapInArrow(write_wanted, _DONE), folder, {0: ("wanted",), 1: ("group",)})[0]

    @store.frugal
    def write_vectors(batches):
        part, at, hashes, values, index = TaskContext.get().partitionId(), 0, [], [], []
        for b in batches:
            for h, tf, start, th in firsts_only(b):
                want = np.zeros(len(th), bool)
                shard = shard_of(th)
                for s in np.unique(shard).tolist():
                    key = store.load(folder, f"wanted-{s}")
                    if key is not None and len(key):
                        i = np.flatnonzero(shard == s)
                        want[i] = key[np.minimum(np.searchsorted(key, th[i]), len(key) - 1)] == th[i]
                if not want.any():
                    continue
                n = np.diff(np.append(start, len(h)))
                pick = np.repeat(want, n)
                hashes.append(h[pick]), values.append(weights(folder, bits, h[pick], tf[pick], total).astype(np.float32))
                size = n[want]
                first = at + np.cumsum(size) - size
                at += int(size.sum())
                x = np.zeros(int(want.sum()), _PLACE)
                x["th"], x["part"], x["at"], x["n"] = th[want], part, first, size
                index.append(x)
        if index:
            store.save(folder, f"hashes-{part}", np.concatenate(hashes))
            store.save(folder, f"values-{part}", np.concatenate(values))
            x = np.concatenate(index)
            x = x[np.argsort(shard_of(x["th"]), kind="stable")]
            yield from store.blobs(0, shard_of(x["th"]), store.as_bytes(x))

    def write_places(batches):
        out: list = []
        for (_, shard), got in store.gather(batches).items():
            x = np.concatenate([np.frombuffer(g, _PLACE) for g in got])
            x = x[np.argsort(x["th"], kind="stable")]
            store.save(folder, f"place-{shard}", x)
            store.save(folder, f"place-th-{shard}", np.ascontiguousarray(x["th"]))
            out.append((0, shard, len(x)))
        yield store.rows(_DONE, out)

    def place(th: int):
        s = th >> (64 - bits)
        return store.load(folder, f"place-{s}")[np.searchsorted(store.load(folder, f"place-th-{s}"), U(th))]

    def size(th: int) -> int:
        return int(place(th)["n"])

    def vector(th: int):
        if (got := cache.get(th)) is None:
            p = place(th)
            a, b = int(p["at"]), int(p["at"]) + int(p["n"])
            h, w = store.load(folder, f"hashes-{p['part']}")[a:b], store.load(folder, f"values-{p['part']}")[a:b]
            if len(cache) > 256:
                cache.clear()
            got = cache[th] = h, w, float(w.sum(dtype=float))
        return got

    cache: dict = {}

    @store.frugal
    def link(batches):
        for b in batches:
            for shard in b.column(0).to_pylist():
                x = store.load(folder, f"group-{shard}")
                if x is None or not len(x):
                    continue
                union = Union()
                at = np.flatnonzero(vec.firsts(x["key"]))
                for i, j in zip(at.tolist(), np.append(at[1:], len(x)).tolist()):
                    cluster(x["node"][i:j], x["sig"][i:j], vector, size, union)
                rows = [(n, r) for n in list(union.up) if (r := union.find(n)) != n]
                a = np.array([r[0] for r in rows], U).view(np.int64)
                c = np.array([r[1] for r in rows], U).view(np.int64)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(c)})

    classes = 0
    if any_group:
        store.run_step(store.deal(docs.mapInArrow(write_vectors, store.BLOB), parts).mapInArrow(write_places, _DONE), folder, {0: ("place", "place-th")})
        shards = spark.range(0, 1 << bits, 1, min(1 << bits, 2 * parts)).select(F.col("id").cast("int").alias("shard"))
        few = total // 100_000 + 1
        edges = shards.mapInArrow(link, "a bigint, b bigint").repartition(few).checkpoint()
        if not edges.isEmpty():
            label = components(edges, few)

            def send(batches):
                for b in batches:
                    x = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
                    th = x[:, 0].copy().view(U)
                    o = np.argsort(shard_of(th), kind="stable")
                    yield from store.blobs(0, shard_of(th)[o], np.ascontiguousarray(x[o]).view(np.uint8).reshape(len(x), 24))

            def first_docs(batches):
                for b in batches:
                    th = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lookup(th, "text", "doc", _MAX))], names=["node", "root", "doc"])

            def write_classes(batches):
                out: list = []
                for (_, shard), got in store.gather(batches).items():
                    x = np.concatenate([np.frombuffer(g, np.int64).reshape(-1, 3) for g in got])
                    th = x[:, 0].copy().view(U)
                    o = np.argsort(th)
                    store.save(folder, f"member-{shard}", th[o])
                    store.save(folder, f"class-{shard}", np.ascontiguousarray(x[o, 1]))
                    store.save(folder, f"kept-{shard}", np.ascontiguousarray(x[o, 2]))
                    out.append((0, shard, len(x)))
                yield store.rows(_DONE, out)

            nodes = label.mapInArrow(first_docs, "node bigint, root bigint, doc bigint").coalesce(few).checkpoint()
            low = nodes.groupBy("root").agg(F.min(F.struct("doc", "node")).alias("least")).select("root", F.col("least.doc").alias("class"), F.col("least.node").alias("kept"))
            step = store.deal(nodes.join(low, "root").select("node", "class", "kept").mapInArrow(send, store.BLOB), parts).mapInArrow(write_classes, _DONE)
            classes = store.run_step(step, folder, {0: ("member", "class", "kept")})[0]

    def hashes(b):
        got = [np.zeros(0, U)]
        for _, _, data, off in vec.texts(b):
            got.append(vec.span(vec.sums(vec.BYTE[data]), off[:-1], off[1:]) ^ vec.mix(np.diff(off).astype(U)))
        return np.concatenate(got)

    def label_rows(batches):
        for b in batches:
            th = hashes(b)
            k = lookup(th, "text", "doc", _MAX)
            k = lookup(th, "member", "class", k) if classes else k
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(k, pa.int64(), mask=k == _MAX)], names=["doc_id", "class_id"])

    def keep_rows(batches):
        for b in batches:
            th = hashes(b)
            stays = lookup(th, "text", "doc", _MAX) == ids(b)
            if classes:
                stays &= lookup(th, "member", "kept", th.view(np.int64)) == th.view(np.int64)
            cols = [*b.columns, pa.array(th.view(np.int64))] if again else b.columns
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, extra] if again else b.schema.names).filter(pa.array(stays))

    extra = "text_hash" + "_" * (1 + max(map(len, all_docs.columns)))  # no column of docs
    if keep:
        if not again:
            return all_docs.mapInArrow(keep_rows, all_docs.schema)
        # of a class, only rows equal in doc_id and text are left
        return all_docs.mapInArrow(keep_rows, StructType([*all_docs.schema, StructField(extra, LongType())])).dropDuplicates([extra]).drop(extra)
    return docs.mapInArrow(label_rows, "doc_id bigint, class_id bigint")


_DONE = "kind int, shard int, n bigint"
_PLACE = np.dtype([("th", "<u8"), ("part", "<u4"), ("at", "<u8"), ("n", "<u4")])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT doc_id, text, CASE WHEN len(w) < 5 THEN w ELSE w[i + 1 : i + 5] END AS k, count(*) AS n FROM t, unnest(range(greatest(len(w) - 4, 1))) x(i) WHERE len(w) > 0 GROUP BY ALL),
df AS (SELECT k, count(*) AS df FROM s GROUP BY k),
node AS (SELECT text, min(doc_id) AS node FROM t GROUP BY text),
f AS (SELECT s.doc_id AS node, k, round(1024 * n * (1 + 0.2 * ln((SELECT count(*) FROM t) / df) / ln((SELECT count(*) FROM t)))) / 1024 AS w FROM s JOIN node ON node.text = s.text AND node.node = s.doc_id JOIN df USING (k)),
total AS (SELECT node, sum(w) AS w FROM f GROUP BY node),
m AS (SELECT a.node AS a, b.node AS b, sum(least(a.w, b.w)) AS m FROM f a JOIN f b ON a.k = b.k AND a.node < b.node GROUP BY ALL),
near AS (SELECT a, b FROM m JOIN total x ON x.node = a JOIN total y ON y.node = b WHERE m / (x.w + y.w - m) >= 0.8),
edge AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT DISTINCT a, a AS b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
class AS (SELECT a AS node, min(b) AS class_id FROM reach GROUP BY a)
SELECT t.doc_id, coalesce(class_id, node.node) AS class_id FROM t JOIN node USING (text) LEFT JOIN class ON class.node = node.node
"""
