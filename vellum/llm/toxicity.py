"""Toxicity by a counterfactually regularised classifier (operator 6).

Logistic regression on the words of a text and their beginnings (3 to 6 bytes), as present or absent, learnt from
labelled texts. Each labelled text that names a group is paired with its counterfactual, the text with every such
term swapped for another of the same list, and the loss adds LAMBDA * (score(text) - score(swapped))**2 (log odds),
so the mention of a group carries no evidence by itself.

Fitting reads FIT_ROWS labelled texts at most, those of least hash of doc_id and, if their doc_ids have more rows than
that, of least hash of doc_id and text; the driver gets their packed hashes. It keeps the FEATURES of greatest association
(chi-squared). Scoring reads every whole text.

Defined cases: null or empty text has the intercept's score; null doc_id never matches a label; several labels of
one doc_id count as toxic if one is; null labels are left out; with one class or no labels every score is the
(smoothed) share of toxic labels; repeated rows score alike and teach once; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, vec
from .lm_score import fold
from .vec import U

FIT_ROWS, FEATURES, LEAST_TEXTS, LEAST_CHI = 6000, 3000, 4, 2.0
L2, LAMBDA, STEPS = 0.002, 1.0, 400
#: Terms that name groups of people, by list; a swap takes the next term of the same list.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "arab", "latino", "indigenous"), ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"), ("immigrants", "refugees", "foreigners", "natives"), ("disabled", "deaf", "blind", "autistic"), ("old", "young", "elderly"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einwanderer", "flüchtlinge"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "étrangers", "réfugiés"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "extranjeros", "refugiados"),
)
PREFIXES = (3, 4, 5, 6)


def words(data: np.ndarray, off: np.ndarray):
    c = vec.sums(vec.BYTE[vec.LOWER[data]])
    s, e, first = vec.runs(vec.WORD[data], off)
    return c, s, e, first


def features(c, s, e) -> np.ndarray:
    """Hashes of each word (column 0) and its beginnings; 0 where a word is no longer than that."""
    out = np.zeros((len(s), 1 + len(PREFIXES)), U)
    out[:, 0] = vec.span(c, s, e)
    for i, n in enumerate(PREFIXES):
        long = np.flatnonzero(e - s > n)
        out[long, i + 1] = vec.span(c, s[long], s[long] + n) ^ U(n)
    return out


def word_features(word: str) -> np.ndarray:
    data = np.frombuffer(word.encode(), np.uint8)
    f = features(vec.sums(vec.BYTE[vec.LOWER[data]]), np.array([0]), np.array([len(data)]))[0]
    return f[f != 0]


def swaps() -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By the hash of an identity term: its features and those of the term it is swapped for."""
    return {int(word_features(w)[0]): (word_features(w), word_features(group[(i + 1) % len(group)])) for group in IDENTITY for i, w in enumerate(group)}


@dataclass(frozen=True)
class Classifier:
    features: np.ndarray
    weights: np.ndarray
    intercept: float


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Classifier:
    """docs(doc_id, text), labels(doc_id, toxic) -> the classifier; labels are those it may learn from."""
    store.prepare(docs.sparkSession)
    picked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    both = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    # equal rows teach once, and the bound is one of rows, however many a doc_id has
    both = both.withColumn("h", F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id", "h"]).orderBy("h", "doc_id").limit(rows).repartition(8).select("text", "toxic")

    @store.frugal
    def extract(batches):
        for b in batches:
            out = []
            for _, _, data, off in vec.texts(b):
                c, s, e, first = words(data, off)
                f = features(c, s, e)
                for i in range(len(off) - 1):
                    x = np.unique(f[first[i] : first[i + 1]])
                    out.append(x[x != 0].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(out, pa.binary())], names=["toxic", "x"])

    got = both.mapInArrow(extract, "toxic int, x binary").toArrow()
    return _fit([np.frombuffer(x.as_buffer(), U) if x.as_buffer().size else np.zeros(0, U) for x in got.column("x")], got.column("toxic").to_numpy().astype(float) > 0)


def _fit(texts: list[np.ndarray], toxic: np.ndarray) -> Classifier:
    y = toxic.astype(float)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return Classifier(np.zeros(0, U), np.zeros(0), base if len(y) else -4.0)
    all_ = np.concatenate(texts)
    order = np.argsort(all_, kind="stable")
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])[order]
    f = all_[order]
    del all_, order
    at = np.flatnonzero(store.firsts_of(f))
    n = np.diff(np.append(at, len(f)))
    pos = np.add.reduceat(y[doc], at)
    p, q, k = y.sum(), len(y) - y.sum(), len(y)
    neg = n - pos
    chi = k * (pos * (q - neg) - neg * (p - pos)) ** 2 / np.maximum(1e-9, p * q * n * (k - n))
    often = n >= LEAST_TEXTS
    chi[~often | (chi < LEAST_CHI * np.log(max(2, often.sum())))] = 0  # the more there are, the more of them are great by chance
    best = np.sort(np.argsort(-chi, kind="stable")[: min(FEATURES, int((chi > 0).sum()))])
    chosen = f[at][best]
    if not len(chosen):
        return Classifier(np.zeros(0, U), np.zeros(0), base)
    table = swaps()
    owner = [np.searchsorted(chosen, np.intersect1d(t, chosen, assume_unique=True)) for t in texts]
    change_row, change_col, change = [], [], []
    for i, t in enumerate(texts):
        for h in set(t.tolist()) & table.keys():
            for sign, g in zip((1.0, -1.0), table[h]):
                for x in g.tolist():
                    j = int(np.searchsorted(chosen, U(x)))
                    if j < len(chosen) and chosen[j] == x:
                        change_row.append(i), change_col.append(j), change.append(sign)
    row, col = np.repeat(np.arange(k), [len(o) for o in owner]), np.concatenate(owner)
    cr, cc, cv = np.array(change_row, int), np.array(change_col, int), np.array(change, float)
    weight = np.where(y > 0, np.sqrt(q / p), 1.0)  # half way, on a log scale, to classes of equal weight
    w, b, m1, m2 = np.zeros(len(chosen)), base, np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[col], k) + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / k
        g = np.bincount(col, err[row], len(w)) + L2 * w / k
        if len(cr):
            gap = np.bincount(cr, cv * w[cc], k)
            g += np.bincount(cc, 2 * LAMBDA * gap[cr] * cv, len(w)) / k
        g = np.append(g, err.sum())
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.999 * m2 + 0.001 * g * g
        d = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
        w, b = w - d[:-1], b - d[-1]
    return Classifier(chosen, w, float(b))


def scores(batch, m: Classifier, bloom: np.ndarray) -> np.ndarray:
    """The score of each text of a batch."""
    total = []
    for _, _, data, off in vec.texts(batch):
        c, s, e, first = words(data, off)
        f = features(c, s, e)
        i, j = np.nonzero(bloom[(f >> U(44)).astype(np.int64)] & (f != 0))
        at = np.searchsorted(m.features, f[i, j])
        ok = m.features[np.minimum(at, len(m.features) - 1)] == f[i, j] if len(m.features) else np.zeros(len(i), bool)
        pair = np.unique((np.searchsorted(first, i[ok], "right") - 1) * (len(m.features) + 1) + at[ok])  # present or absent
        doc, col = pair // (len(m.features) + 1), pair % (len(m.features) + 1)
        total.append(np.bincount(doc, m.weights[col] if len(col) else None, len(off) - 1))
    z = (np.concatenate(total) if total else np.zeros(0)) + m.intercept
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _bloom(m: Classifier) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(m.features >> U(44)).astype(np.int64)] = True
    return out


def score(docs: DataFrame, m: Classifier, held_out) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out (a boolean column), score, predicted."""
    store.prepare(docs.sparkSession)
    bloom = _bloom(m)

    @store.frugal
    def run(batches):
        for b in batches:
            p = scores(b, m, bloom)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    return docs.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, m: Classifier) -> DataFrame:
    """The rows of docs that are not predicted toxic."""
    store.prepare(docs.sparkSession)
    bloom = _bloom(m)

    @store.frugal
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(scores(b, m, bloom) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that the query may learn from: crc32 of doc_id as text, modulo 5, is not 0."""
    return labels.where(fold(5) != 0)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, learnable(labels)), fold(5) == 0)
