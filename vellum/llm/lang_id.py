"""Language identification with hyperdimensional profiles (operator 10).

Each letter class has a random +-1 vector of DIM components. A trigram is bound as
roll(a, 2) * roll(b, 1) * c, a text is the bundle (sum) of its trigrams, a language the bundle of its training
texts, and a text's language is the prototype of greatest cosine. The cosine's numerator is linear, so each
distinct trigram is compared with the prototypes once in a worker and texts add up the results; the text's own
norm is common to all its cosines and cancels in both outputs.

Letters are folded to lower case; a-z have classes of their own, other letters share CLASSES - 27 by a hash of
the code point; runs of anything else are one boundary. Prototypes are centred on their mean, which all languages
share. The driver gets one prototype per language.

Defined cases: null text, or text without a letter, is `und` with score 0; rows of null lang or text teach
nothing; null doc_id is hashed as an empty text; with nothing learned all is `und`; ties go to the language
that sorts first; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, vec
from .lm_score import fold

DIM, CLASSES, SEED = 2048, 128, 10
#: Counts of (language, trigram) that a task holds before it bundles them.
HELD = 2_000_000
OUT = "doc_id bigint, held_out boolean, lang_pred string, score double"
_cache: dict = {}


def _class(cp: int) -> int:
    ch = chr(cp)
    if not ch.isalpha():
        return 0
    low = ch.lower()[0]
    return ord(low) - 96 if "a" <= low <= "z" else 27 + int(vec.mix(np.array([ord(low)]))[0] % np.uint64(CLASSES - 27))


def classes(cps: np.ndarray) -> np.ndarray:
    """The letter class of each code point; 0 for what is no letter."""
    if "bmp" not in _cache:
        _cache["bmp"] = np.array([0 if 0xD800 <= i < 0xE000 else _class(i) for i in range(0x10000)], np.uint8)
    out = _cache["bmp"][np.minimum(cps, 0xFFFF)]
    high = np.flatnonzero(cps > 0xFFFF)
    if len(high):
        u, inv = np.unique(cps[high], return_inverse=True)
        out[high] = np.array([_class(int(x)) for x in u], np.uint8)[inv]
    return out


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram, its document) of all texts, and whether each has a letter."""
    size = np.array([len(t) + 2 if t else 2 for t in texts], np.int64)
    cps = np.frombuffer("".join(f"\n{t or ''}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.cumsum(size) - size
    k = classes(cps)
    first = np.zeros(len(k), bool)
    first[start] = True
    keep = (k > 0) | first
    keep[1:] |= k[:-1] > 0
    at = np.flatnonzero(keep)
    doc = np.searchsorted(start, at, "right") - 1
    k = k[at].astype(np.int32)
    if len(k) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(texts), bool)
    same = doc[2:] == doc[:-2]
    return ((k[:-2] << 14) | (k[1:-1] << 7) | k[2:])[same], doc[2:][same], np.bincount(doc[k > 0], minlength=len(texts)) > 0


def _letters() -> np.ndarray:
    if "letters" not in _cache:
        v = np.random.default_rng(SEED).integers(0, 2, (CLASSES, DIM)).astype(np.float32) * 2 - 1
        _cache["letters"] = np.roll(v, 2, 1), np.roll(v, 1, 1), v
    return _cache["letters"]


def bound(tri: np.ndarray) -> np.ndarray:
    a, b, c = _letters()
    return a[tri >> 14] * b[(tri >> 7) & 127] * c[tri & 127]


def _weighed(tri: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(DIM)
    for i in range(0, len(tri), 2048):
        out += n[i : i + 2048].astype(np.float32) @ bound(tri[i : i + 2048])
    return out


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    """docs(text, lang) -> centred unit prototypes, over all rows."""
    store.prepare(docs.sparkSession)
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def bundle(batches):
        names: dict[str, int] = {}  # of what is held
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flush():
            for x, i in names.items():
                lo, hi = np.searchsorted(keys, [i << 21, (i + 1) << 21])
                yield pa.RecordBatch.from_pydict({"lang": [x], "v": pa.array([_weighed(keys[lo:hi] & 0x1FFFFF, n[lo:hi])], pa.list_(pa.float64()))})

        for b in batches:
            tri, doc, _ = trigrams(b.column("text").to_pylist())
            of = np.array([names.setdefault(x, len(names)) for x in b.column("lang").to_pylist()], np.int64)
            u, m = np.unique((of[doc] << 21) | tri, return_counts=True)
            order = np.argsort(np.concatenate([keys, u]), kind="stable")
            every = np.concatenate([keys, u])[order]
            at = np.flatnonzero(store.firsts_of(every))
            keys, n = every[at], np.add.reduceat(np.concatenate([n, m])[order], at) if len(at) else n
            if len(keys) > HELD:
                yield from flush()
                names, keys, n = {}, keys[:0], n[:0]
        yield from flush()

    sums = docs.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.expr("transform(array_sort(collect_list(struct(i, x))), s -> s.x)").alias("v")).collect()  # one vector a language
    proto = {lang: np.array(v) for lang, v in rows}
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    proto = {k: unit(proto[k]) for k in sorted(proto)}
    mean = np.mean(list(proto.values()), 0) if len(proto) > 1 else 0
    return {k: unit(v - mean) for k, v in proto.items()}


def predict(docs: DataFrame, proto: dict[str, np.ndarray], held_out) -> DataFrame:
    """docs(doc_id, text) -> OUT. score: the share of the winner in the positive cosines, 0 to 1."""
    store.prepare(docs.sparkSession)
    names = list(proto)
    matrix = np.array([proto[k] for k in names], np.float32).T if names else np.zeros((DIM, 0), np.float32)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))

    def run(batches):
        row, table = np.full(1 << 21, -1, np.int32), np.zeros((0, len(names)), np.float32)
        for b in batches:
            n = b.num_rows
            tri, doc, letter = trigrams(b.column("text").to_pylist())
            sims = np.zeros((n, len(names)))
            if names and len(tri):
                new = np.flatnonzero(np.bincount(tri, minlength=1 << 21)[: 1 << 21] * (row < 0))
                row[new] = len(table) + np.arange(len(new))
                table = np.concatenate([table, *(bound(new[i : i + 2048]) @ matrix for i in range(0, len(new), 2048))])
                each = table[row[tri]]
                for j in range(len(names)):
                    sims[:, j] = np.bincount(doc, each[:, j], n)
            best = sims.argmax(1) if names else np.zeros(n, int)
            ok = letter & bool(names)
            up = np.maximum(sims, 0)
            total = up.sum(1)
            share = np.where(total > 0, up.max(1, initial=0) / np.where(total > 0, total, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([names[i] if k else "und" for i, k in zip(best.tolist(), ok.tolist())], pa.string()), pa.array(np.where(ok, share, 0.0))],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.mapInArrow(run, OUT)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = fold(4) == 2
    return predict(docs, fit(docs.where(~out)), out)
