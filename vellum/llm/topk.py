"""Exact top-k inner products by M-tree search (operator 8).

Components become floor(1024 * x). Inner product is turned into a metric: with M the greatest norm of a tree's
vectors, x gets one more component sqrt(M**2 - |x|**2) and the query 0, so |q - x|**2 = |q|**2 + M**2 - 2 q.x.

Vectors are dealt over partitions by a hash; each partition builds one M-tree of pages of up to PAGE entries, each
with the distance to its parent's pivot and, in inner pages, a covering radius. A query goes through the pages best
first, by the least distance that a page can hold; entries whose parent distance already rules them out by the
triangle inequality are not computed. Scores are exact integers; bounds get a slack far above rounding and far
below the distance of two unequal scores, so ties are never pruned. A query's best of all partitions meet in one
window limited to k a task.

Queries lie in the shared folder and are read in blocks of BLOCK, so a task holds its tree and one block.

Rows equal in vec_id and vector are one tree entry with their number, reduced in each task first, so a row that a third
of the table repeats is one entry; its copies come back when the best are ranked.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows of null
vec_id; shorter vectors are filled up with zeros; repeated rows are candidates each, and a query that is repeated
meets each of its candidates as often (query_id has k rows at most all the same); rows of the query's own vec_id are
never its candidates; ties go to the smaller vec_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store, vec

SCALE, K, PAGE, BLOCK = 1024, 10, 128, 4096
TREE_ROWS = 65536


def exact(*arrays: np.ndarray) -> type:
    """A type in which inner products of these integers (held as floats) are exact."""
    top = max((float(np.abs(a).max(initial=0)) for a in arrays), default=0)
    dim = max(a.shape[1] for a in arrays)
    return np.float64 if top * top * dim < 2**53 else np.int64 if top * top * dim < 2**63 else object


class MTree:
    """Pages of an M-tree over vectors of equal norm, built top down."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.x, self.ids = vectors, ids
        norm2 = (vectors * vectors).sum(1)
        self.m2 = float(norm2.max(initial=0))
        self.y = np.concatenate([vectors, np.sqrt(np.maximum(self.m2 - norm2, 0))[:, None]], 1)
        #: (is leaf, entries: vectors or pages, pivot of each, covering radius of each, distance of each to this page's pivot)
        self.pages: list[tuple] = []
        self.pivot = self.y.mean(0)
        self.root = self._page(np.arange(len(ids)), self.pivot)[0]

    def _far(self, at: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        d = self.y[at] - pivot
        return np.sqrt((d * d).sum(1))

    def _page(self, at: np.ndarray, pivot: np.ndarray) -> tuple[int, float]:
        """(page, covering radius) of the vectors at."""
        far = self._far(at, pivot)
        if len(at) <= PAGE:
            self.pages.append((True, at, None, None, far))
            return len(self.pages) - 1, float(far.max(initial=0))
        n = min(PAGE, -(-len(at) // (PAGE // 2)))
        centers = self.y[at[np.linspace(0, len(at) - 1, n).astype(int)]]
        own = np.empty(len(at), np.int64)
        for i in range(0, len(at), 4096):
            part = self.y[at[i : i + 4096]]
            own[i : i + 4096] = (-2 * part @ centers.T + (centers * centers).sum(1)).argmin(1)
        groups = [g for g in np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own, minlength=n))[:-1]) if len(g)]
        if len(groups) == 1:  # equal vectors: any split does
            groups = np.array_split(np.arange(len(at)), n)
        pivots = np.array([self.y[at[g]].mean(0) for g in groups])
        below = [self._page(at[g], p) for g, p in zip(groups, pivots)]
        d = pivots - pivot
        self.pages.append((False, np.array([b[0] for b in below]), pivots, np.array([b[1] for b in below]), np.sqrt((d * d).sum(1))))
        return len(self.pages) - 1, float(far.max())

    def search(self, q: np.ndarray, own: int, k: int, ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best rows but those of id own; ints: the vectors in a type of exact products."""
        q2 = float((q * q).sum())
        point = np.append(q, 0.0)
        slack = 1e-9 * (q2 + self.m2 + 1)
        best_row, best = np.zeros(0, np.int64), np.zeros(0, ints.dtype)
        reach = math.inf  # distance of the k-th best, with slack
        whole = q.astype(ints.dtype) if ints.dtype != object else np.array([int(v) for v in q], object)
        first = point - self.pivot
        heap = [(0.0, self.root, math.sqrt(float((first * first).sum())))]
        while heap:
            least, page, to_pivot = heapq.heappop(heap)
            if least > reach:
                break
            leaf, entries, pivots, radius, far = self.pages[page]
            gap = np.abs(to_pivot - far)
            if leaf:
                at = entries[gap <= reach]
                at = at[self.ids[at] != own]
                if not len(at):
                    continue
                score = ints[at] @ whole
                rows = np.concatenate([best_row, at])
                ids, score = self.ids[rows], np.concatenate([best, score])
                order = np.lexsort((ids, -score))[:k] if score.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:k])
                best_row, best = rows[order], score[order]
                if len(best) == k:
                    reach = math.sqrt(max(0.0, q2 + self.m2 - 2 * float(best[-1])) + slack) + 1e-12
            else:
                ok = np.flatnonzero(gap - radius <= reach)
                d = pivots[ok] - point
                d = np.sqrt((d * d).sum(1))
                for lo, e, to in zip(np.maximum(d - radius[ok], 0).tolist(), entries[ok].tolist(), d.tolist()):
                    if lo <= reach:
                        heapq.heappush(heap, (lo, e, to))
        return best_row, best


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(column)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return np.floor(SCALE * out)


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """vectors(vec_id, embedding) -> (query_id, rank, vec_id, score); is_query is a boolean column."""
    spark: SparkSession = vectors.sparkSession
    store.prepare(spark)
    store.shared_base(spark)  # where checkpoint() writes
    sound = F.expr("size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("q")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    vectors = vectors.groupBy("vec_id", "embedding").agg(F.max("q").alias("q"), F.count("*").alias("n")).checkpoint()
    folder = store.new_folder(spark, "topk")
    rows, dim = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    out = "query_id bigint, vec_id bigint, score bigint, copies bigint"
    if not rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")

    def write_queries(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                c = b.slice(i, BLOCK)
                store.save(folder, f"id-{part}-{n}", vec.longs(c.column(0)))
                store.save(folder, f"copies-{part}-{n}", vec.longs(c.column(2)))
                store.save(folder, f"query-{part}-{n}", _matrix(c.column(1), dim))
                n += 1
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int32())})

    blocks = [(r.part, i) for r in vectors.where("q").select("vec_id", "embedding", "n").mapInArrow(write_queries, "part int, n int").collect() for i in range(r.n)]
    n = max(-(-rows // TREE_ROWS), min(store.partitions(spark), -(-rows // 2048)))

    def search(batches):
        ids, x, copies = [], [], []
        for b in batches:
            ids.append(vec.longs(b.column(0))), x.append(_matrix(b.column(1), dim)), copies.append(vec.longs(b.column(2)))
        if not ids:
            return
        tree, times = MTree(np.concatenate(x), np.concatenate(ids)), np.concatenate(copies)
        for part, i in blocks:
            own, q, repeated = (store.load(folder, f"{name}-{part}-{i}") for name in ("id", "query", "copies"))
            kind = exact(tree.x, q)
            ints = tree.x if kind is np.float64 else tree.x.astype(np.int64) if kind is np.int64 else np.array([[int(v) for v in r] for r in tree.x], object)
            got = [tree.search(np.asarray(v, float), int(o), k, ints) for o, v in zip(own.tolist(), q)]
            size = [len(g[0]) for g in got]
            if sum(size):
                at = np.concatenate([g[0] for g in got])
                n = np.minimum(np.minimum(times[at], k) * np.minimum(np.repeat(np.asarray(repeated), size), k), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.asarray(own), size)), pa.array(tree.ids[at]), pa.array([int(s) for g in got for s in g[1]], pa.int64()), pa.array(n)], names=["query_id", "vec_id", "score", "copies"]
                )

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = vectors.select("vec_id", "embedding", "n").repartition(n, F.xxhash64("vec_id", "embedding")).mapInArrow(search, out).select("query_id", "vec_id", "score", F.explode(F.expr("sequence(1L, copies)")))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
