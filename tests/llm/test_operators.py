"""Each operator against brute force on small fixtures with nulls, empty and repeated texts, ties and clashing column names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import bpe, chat, decontaminate, lang_id, lm_score, near_dup, secret_scan, store, suffix_dedup, topk, toxicity, vec

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def docs_of(spark, texts, parts=3):
    rows = [(i, t, "x", 1.0, 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, word string, score double, n int").repartition(parts)


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def drawn(seed, n, vocabulary=60):
    g = random.Random(seed)
    v = ["".join(g.choice("abcdeéß") for _ in range(g.randint(1, 6))) for _ in range(vocabulary)]
    out = []
    for _ in range(n):
        t = " ".join(g.choice(v) for _ in range(g.randint(0, 60)))
        if out and g.random() < 0.4:
            t = out[g.randrange(len(out))] or ""
            if g.random() < 0.5 and t:
                w = t.split()
                w[g.randrange(len(w))] = g.choice(v)
                t = " ".join(w)
        out.append(t if g.random() > 0.05 else None)
    return [*out, None, "", "?!", "?!", "a", "A"]


# 1 ---------------------------------------------------------------------------------------------------------------


def contamination(texts, items, size):
    wins = defaultdict(set)
    for k, t in items:
        w = words(t)
        if w and k is not None:
            for i in range(max(1, len(w) - size + 1)):
                wins[tuple(w[i : i + size])].add(k)
    out = {}
    for d, t in enumerate(texts):
        w, hit, its = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    its |= got
        out[d] = (len(w), len(hit), its)
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    texts = drawn(1, 60, 12)
    items = [(1, texts[3]), (2, (texts[5] or "b") + " zz"), (3, "A"), (4, None), (5, "?"), (None, "a b"), (7, texts[8]), (7, texts[8])]
    got = decontaminate.decontaminate(docs_of(spark, texts), spark.createDataFrame(items, "item_id int, text string"), 4).collect()
    want = contamination(texts, items, 4)
    assert {r.doc_id: (r.n_words, r.n_hit, set(r["items"])) for r in got} == want
    assert all(r.n_items == len(r["items"]) and r.contaminated == (r.n_items >= 2) for r in got) and len(got) == len(texts)
    kept = decontaminate.clean(docs_of(spark, texts), spark.createDataFrame(items, "item_id int, text string"), 4)
    assert {r.doc_id for r in kept.collect()} == {d for d, x in want.items() if len(x[2]) < 2}


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_decides_by_row(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    bad, rows = "so a b c d and e f g h too", [(None, "clean one"), (None, "clean two"), (7, "clean three"), (7, None), (8, "a b c d")]
    docs = spark.createDataFrame([*rows, (None, bad), (7, bad), (9, bad), (9, bad)], "doc_id bigint, text string").repartition(3)
    items = spark.createDataFrame([(1, "a b c d"), (2, "e f g h")], "item_id int, text string")
    kept = decontaminate.clean(docs, items, 4)
    assert Counter(map(tuple, kept.collect())) == Counter(rows) and kept.columns == docs.columns
    # columns of the names used inside, on both sides
    names = ["bad", "bad_text", "text_hash", "row", "w", "word", "win", "items", "place", "at", "hit", "n_words", "clean_docs", "clean_bad", "contaminated"]
    wide = docs.select("*", *(F.lit(n).alias(n) for n in names))
    kept = decontaminate.clean(wide, items.select("*", *(F.lit(n).alias(n) for n in names)), 4)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(rows) and kept.columns == wide.columns
    assert {tuple(r)[:2] for r in decontaminate.clean(wide, items, 4, least_items=1).collect()} == set(rows) - {(8, "a b c d")}


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.decontaminate(empty(spark), none).count() == 0
    assert decontaminate.decontaminate(docs_of(spark, ["a b"]), none).first().n_hit == 0


# 2 ---------------------------------------------------------------------------------------------------------------


def removed(texts, length):
    seen, out = set(), {}
    for d, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out[d] = (len(b), sum(gone), sum(gone[i] and (not i or not gone[i - 1]) for i in range(len(b))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [5, 12, 20])
def test_suffix_dedup(spark, monkeypatch, length):
    monkeypatch.setattr(suffix_dedup, "HELD", 500)
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    texts = [*drawn(2, 60), "ab" * 40, "ab" * 33, "a" * 50]
    got = suffix_dedup.suffix_dedup(docs_of(spark, texts), length)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == removed(texts, length)
    twice = docs_of(spark, ["x" * 10 + "abcdefghij"]).union(docs_of(spark, ["x" * 10 + "abcdefghij"]))
    assert [r.n_removed for r in suffix_dedup.suffix_dedup(twice, 12).collect()] == [0, 0]  # rows equal in id and text are one document
    assert suffix_dedup.suffix_dedup(empty(spark), length).count() == 0


def test_suffix_dedup_of_texts_without_an_id(spark):
    """Texts of null doc_id come first, each a document of its own; those of one doc_id are ordered by their hash."""
    g = random.Random(12)
    part = "".join(g.choice("abcdef") for _ in range(30))
    rows = [(None, "".join(g.choice("abcdef") for _ in range(17)) + chr(0x4E00 + i) + part * (i % 2)) for i in range(30)] + [(5, part), (-3, part), (7, "zz" + part), (7, part + "yy"), (8, None), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n_spans int, at string").repartition(3)
    got = suffix_dedup.suffix_dedup(docs, 30).collect()
    assert len(got) == len(rows) and sum(r.n_removed for r in got) == 30 * (sum((t or "").count(part) for _, t in rows) - 1)
    assert all(r.n_removed == 30 for r in got if r.doc_id is not None and r.n_bytes) and sum(r.n_removed == 0 and r.n_bytes == 50 for r in got if r.doc_id is None) == 1


# 3 ---------------------------------------------------------------------------------------------------------------


def kneser_ney(seqs):
    """p(w | u, v) of the interpolated modified model of order 3, counted plainly."""
    tri, uni = Counter(), Counter()
    for w in seqs:
        uni.update(w)
        tri.update(zip(["<>", "<>", *w], ["<>", *w], w))
    pairs, raw = Counter(), Counter()
    for (_, v, w), c in tri.items():
        pairs[v, w] += 1
        raw[v, w] += c
    pairs = {k: raw[k] if k[0] == "<>" else n for k, n in pairs.items()}
    cont = Counter(w for _, w in pairs)

    def totals(counts):
        total, kinds = Counter(), defaultdict(lambda: [0] * 4)
        for k, c in counts.items():
            total[k[:-1]] += c
            kinds[k[:-1]][min(c, 3)] += 1
        return total, kinds

    of = lambda counts: lm_score.discounts([Counter(counts.values())[i] for i in (1, 2, 3, 4)])
    d1, levels = of(cont), [(c, of(c), *totals(c)) for c in (pairs, tri)]
    rest, total, v = sum(d1[min(c, 3)] for c in cont.values()), sum(cont.values()), len(uni)

    def p(w, *h):
        if not h:
            return (cont[w] - d1[min(cont[w], 3)] + rest / (v + 1)) / total
        counts, d, n, kinds = levels[len(h) - 1]
        lower = p(w, *h[1:])
        if not n[h]:
            return lower
        c = counts.get((*h, w), 0)
        return (max(c - d[min(c, 3)], 0) + sum(d[i] * kinds[h][i] for i in (1, 2, 3)) * lower) / n[h]

    return p, uni


def test_lm_score(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HELD", 300)
    texts = [*drawn(3, 80, 15), "a b " * 400, "a b c"]
    docs = docs_of(spark, texts)
    out = lm_score.fold(7) == 2
    got = {r.doc_id: r for r in lm_score.score(docs, lm_score.fit(docs.where(~out)), out).collect()}
    seqs = {d: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) + ["</>"] for d, t in enumerate(texts)}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in seqs}
    p, uni = kneser_ney([w for d, w in seqs.items() if not held[d]])
    n, v = sum(uni.values()), len(uni)
    for h in [("<>", "<>"), ("a", "b"), ("<>", "a"), ("?", "b"), ("?", "?")]:
        assert sum(p(w, *h) for w in [*uni, "?unknown"]) == pytest.approx(1)
    for d, w in seqs.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(uni[x] > 0 for x in w), n)
        assert r.score == pytest.approx(sum(math.log10(p(x, *h)) for *h, x in zip(["<>", "<>", *w], ["<>", *w], w)))
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w))


def test_lm_score_of_nothing(spark):
    m = lm_score.fit(empty(spark))
    assert (m.tokens, m.words) == (0, 0)
    r = lm_score.score(docs_of(spark, ["a b", None]), m, lm_score.fold(7) == 2).orderBy("doc_id").collect()
    assert [(x.n_tokens, x.n_known, x.score, x.base_score) for x in r] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]


# 4 ---------------------------------------------------------------------------------------------------------------


def test_bpe(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary_path())
    g = random.Random(4)
    chars = "abcdefghijABC'’.,!?0123456789 \n\té漢字 İΣςσß½²①🙂́​\x1c\x85 Ⅷǅ"
    texts = [None, "", "<|endoftext|>", "a<|startoftext|>B <|endoftext|", "it's they're I'll don't", "ΟΔΟΣ ΣΑΣ", "é", "z" * 3000]
    texts += ["".join(g.choice(chars) for _ in range(g.randint(1, 60))) for _ in range(300)] + ["".join(g.choice("abcdeinorst") for _ in range(g.randint(1, 40))) for _ in range(300)]
    got = {r.doc_id: r for r in bpe.encode_decode(docs_of(spark, texts), outputs=True).collect()}
    for d, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert got[d].ids == ids and got[d].decoded == text, t
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(empty(spark)).count() == 0


# 5 ---------------------------------------------------------------------------------------------------------------


def classes(texts):
    sets = {d: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else Counter() for d, t in enumerate(texts)}
    n, df, union = len(texts), Counter(), near_dup.Union()
    for s in sets.values():
        df.update(s.keys())
    w = {d: {s: round(1024 * c * (1 + near_dup.IDF * math.log(n / df[s]) / math.log(n))) / 1024 for s, c in x.items()} for d, x in sets.items()}
    for a in w:
        for b in range(a):
            if (texts[a] or "") == (texts[b] or ""):
                union.join(a, b)
            elif w[a] and w[b]:
                m = sum(min(x, w[b].get(s, 0)) for s, x in w[a].items())
                if m / (sum(w[a].values()) + sum(w[b].values()) - m) >= 0.8:
                    union.join(a, b)
    return {d: union.find(d) for d in w}


def test_near_duplicates(spark):
    g = random.Random(5)
    texts = drawn(5, 60)
    base = [g.choice("abcdefghijklmnopqrstuvwxyz") * g.randint(1, 4) + str(g.randint(0, 99)) for _ in range(120)]
    for _ in range(40):  # a large group of near copies, some chained
        w = list(base)
        for _ in range(g.randint(0, 4)):
            w[g.randrange(120)] = "new" + str(g.random())
        texts.append(" ".join(w))
    docs = docs_of(spark, texts)
    want = classes(texts)
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()} == want
    kept = near_dup.near_duplicates(docs.union(docs), keep=True)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns
    assert near_dup.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_each_class_keeps_one_row(spark, repeated):
    g = random.Random(15)
    text = lambda: " ".join(str(g.random()) for _ in range(120))
    a, b, c, d, e = (text() for _ in range(5))
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [(None, a), (None, b), (None, near(b)), (1, c), (1, d), (1, near(d)), (2, near(c)), (None, near(a)), (4, None)]
    rows += [(3, e), (3, e), (4, "")] if repeated else [(3, e)]
    docs = spark.createDataFrame([(i, t, n, n, n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, n int, text_hash_ int, class_id int").repartition(3)
    kept = near_dup.near_duplicates(docs, keep=True)
    got = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == len(set(got)) == 6
    assert {(3, e), (1, c), (4, "")} < set(got) and all(len({(None, x), (None, near(x))} & set(got)) == 1 for x in (a, b)) and len({(1, d), (1, near(d))} & set(got)) == 1


def test_group_clustering_compares_all_at_once():
    g = np.random.default_rng(0)
    vectors = {}
    for i in range(60):
        h = np.sort(g.choice(120, 100, replace=False)).astype(np.uint64)
        vectors[i] = (h, np.ones(100, np.float32), 100.0)
    nodes, union, want = np.arange(60, dtype=np.uint64), near_dup.Union(), near_dup.Union()
    near_dup.cluster(nodes, np.zeros((60, 30), np.uint8), vectors.__getitem__, lambda n: 100, union)
    for a in range(60):
        for b in range(a):
            if near_dup.similarity(vectors[a], vectors[b]) >= 0.8:
                want.join(a, b)
    assert [union.find(i) for i in range(60)] == [want.find(i) for i in range(60)]


@pytest.mark.parametrize("seed", range(6))
def test_groups_of_several_components(seed):
    """Texts drawn round a few centres, some linked beforehand: the same components as from all pairs."""
    g = np.random.default_rng(seed)
    centres = [g.choice(4000, 100, replace=False) for _ in range(4)]
    vectors = {}
    for i in range(150):
        c = centres[int(g.choice(4, p=[0.55, 0.25, 0.15, 0.05]))].copy()
        c[g.choice(100, int(g.integers(0, 25)), replace=False)] = g.integers(4000, 10**9)
        h = np.unique(c).astype(np.uint64)
        vectors[i] = (h, np.ones(len(h), np.float32), float(len(h)))
    union, want = near_dup.Union(), near_dup.Union()
    for a, b in g.integers(0, 150, (6, 2)).tolist():
        union.join(a, b), want.join(a, b)
    near_dup.cluster(g.permutation(150).astype(np.uint64), np.zeros((150, 30), np.uint8), vectors.__getitem__, lambda n: 100, union)
    for a in range(150):
        for b in range(a):
            if near_dup.similarity(vectors[a], vectors[b]) >= 0.8:
                want.join(a, b)
    assert [union.find(i) for i in range(150)] == [want.find(i) for i in range(150)]


def test_equal_bytes_are_no_shared_band():
    """All samples of bands 0 and 1 agree in their bytes, as where one of band 0's only collides: band 1's group must still link the pair."""
    v = (np.arange(100, dtype=np.uint64), np.ones(100, np.float32), 100.0)
    union = near_dup.Union()
    near_dup.cluster(np.array([3, 8], np.uint64), np.zeros((2, 30), np.uint8), {3: v, 8: v}.__getitem__, lambda n: 100, union)
    assert union.find(8) == 3


# 6 ---------------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    g = random.Random(6)
    plain = ["tree", "river", "stone", "cloud", "grass", "bread", "music", "paper"]
    texts, labels = [], []
    for d in range(400):
        bad = d % 4 == 0
        w = [g.choice(plain) for _ in range(15)] + (["idiot"] if bad and d % 8 else ["vilework" + g.choice("abc")] if bad else [])
        if d % 3 == 0 or (bad and g.random() < 0.5):
            w.append("muslims")  # more often among toxic texts
        g.shuffle(w)
        texts.append(" ".join(w))
        labels.append((d, 1, int(bad)))
    texts += [None, "", "muslims christians bread"]
    docs, lab = docs_of(spark, texts), spark.createDataFrame(labels + [(1, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    m = toxicity.fit(docs, toxicity.learnable(lab))
    got = {r.doc_id: r for r in toxicity.score(docs, m, toxicity.fold(5) == 0).collect()}
    assert [got[d].predicted for d in range(400)] == [y for _, _, y in labels]
    assert all(got[d].predicted == 0 for d in (400, 401, 402)) and got[400].score == got[401].score
    swap = {int(x) for pair in toxicity.swaps().values() for x in pair[0].tolist()}
    mention = [w for f, w in zip(m.features.tolist(), m.weights.tolist()) if f in swap]
    assert all(abs(w) < 1 for w in mention)
    assert {r.doc_id for r in toxicity.accepted(docs, m).collect()} == {d for d in got if not got[d].predicted}
    one = toxicity.fit(docs, lab.where("toxic = 0"))
    assert len(one.features) == 0 and toxicity.score(docs, one, toxicity.fold(5) == 0).where("predicted = 1").count() == 0
    assert toxicity.score(empty(spark), m, toxicity.fold(5) == 0).count() == 0


def loss(texts, y, features, w, b, lam):
    """The documented objective, text by text: weighted log loss, L2 and the squared gap to the counterfactual."""
    n, p = len(y), sum(y)
    weight = {0: 1.0, 1: math.sqrt((n - p) / p)}
    place, table, total = {f: i for i, f in enumerate(features)}, toxicity.swaps(), 0.0
    for t, label in zip(texts, y):
        have = set(t)
        z = b + sum(w[place[f]] for f in have if f in place)
        swapped = Counter()
        for h in have & table.keys():
            swapped.update(int(x) for x in table[h][0])
            swapped.subtract(int(x) for x in table[h][1])
        gap = sum(k * w[place[f]] for f, k in swapped.items() if f in place)
        total += weight[label] * (math.log1p(math.exp(-z)) if label else math.log1p(math.exp(z))) / n + lam * gap * gap / n
    return total + toxicity.L2 * float(w @ w) / (2 * n)


def _labelled(seed=26):
    """Texts whose toxic ones name a group much more often than the others, and 40 neutral mentions held back."""
    g = random.Random(seed)
    plain, groups = ["tree", "river", "stone", "cloud", "grass", "bread", "music", "paper"], ["muslims", "christians", "jews", "women", "men"]
    texts, y = [], []
    for d in range(400):
        bad = int(d % 4 == 0)
        w = [g.choice(plain) for _ in range(15)] + (["idiot"] if bad and d % 8 else [])
        if g.random() < (0.8 if bad else 0.05):
            w.append(g.choice(groups[:2]))
        texts.append(" ".join(w)), y.append(bad)
    return texts, y, [" ".join(g.choice(plain) for _ in range(12)) + " " + x for x in groups * 8]


def _hashes(texts):
    out = []
    for t in texts:
        f = np.concatenate([toxicity.word_features(w) for w in t.split()])
        out.append(np.unique(f))
    return out


def test_toxicity_minimises_its_objective(monkeypatch):
    texts, y, neutral = _labelled()
    x = _hashes(texts)
    odds = {}
    for lam in (0.0, 1.0):
        monkeypatch.setattr(toxicity, "LAMBDA", lam)
        monkeypatch.setattr(toxicity, "STEPS", 3000)
        monkeypatch.setattr(toxicity, "L2", 0.5)
        m = toxicity._fit(x, np.array(y) > 0)
        best, g = loss([set(t.tolist()) for t in x], y, m.features.tolist(), m.weights, m.intercept, lam), np.random.default_rng(1)
        for _ in range(30):  # no step in any direction does better
            step = g.normal(0, 0.02, len(m.weights) + 1)
            assert best <= loss([set(t.tolist()) for t in x], y, m.features.tolist(), m.weights + step[:-1], m.intercept + step[-1], lam) + 1e-4
        place = dict(zip(m.features.tolist(), m.weights.tolist()))
        odds[lam] = [m.intercept + sum(place.get(f, 0.0) for f in t.tolist()) for t in _hashes(neutral)]
    mentions = lambda lam: max(odds[lam]) - min(odds[lam])
    assert mentions(1.0) < 0.5 * mentions(0.0) and max(odds[1.0]) < max(odds[0.0])  # a mention weighs less where swaps are penalised


def test_toxicity_bound_is_one_of_rows(spark):
    """A doc_id of very many rows doesn't bring them all to the driver; equal rows teach once and score alike."""
    texts, y, _ = _labelled()
    rows = list(enumerate(texts)) + [(4, "idiot " + str(i)) for i in range(300)] + [(4, texts[4])] * 50
    docs = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "doc_id bigint, text string, toxic int, score double").repartition(3)
    labels = spark.createDataFrame([(d, 1, k) for d, k in enumerate(y)], "doc_id bigint, quality int, toxic int")
    seen = []
    fit = toxicity._fit
    try:
        toxicity._fit = lambda x, t: seen.append(len(x)) or fit(x, t)
        toxicity.fit(docs, labels, rows=500)
        m = toxicity.fit(docs, labels, rows=5000)
    finally:
        toxicity._fit = fit
    assert seen == [500, 700]
    got = toxicity.score(docs, m, toxicity.fold(5) == 0).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 4}) <= 301
    want = {}
    place = dict(zip(m.features.tolist(), m.weights.tolist()))
    for d, t in enumerate(texts):
        want[d] = 1 / (1 + math.exp(-(m.intercept + sum(place.get(f, 0.0) for f in _hashes([t])[0].tolist()))))
    assert all(r.score == pytest.approx(want[r.doc_id]) for r in got if r.doc_id != 4)


# 7 ---------------------------------------------------------------------------------------------------------------


def test_secrets(spark):
    g = random.Random(7)
    key = lambda n, s="0123456789abcdef": "".join(g.choice(s) for _ in range(n))
    texts = [f"é some words {g.choice(['password', 'API_KEY', 'Secret', 'token'])}{g.choice([': ', '=', chr(34) + ': ' + chr(34)])}{key(40)} thereafter" for _ in range(80)]
    texts += [f"id AKIA{key(16, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')} end" for _ in range(40)]
    texts += [None, "", "token=password=abcdefghijkl", "secret: short", "Kpassword=ABCDEFGHIJKLM", "AKIA12", "0123456789abcdef0", key(20, "ABCDEF0123456789").lower() * 20, "extraordinarily longwordswithoutsecrets"]
    docs = docs_of(spark, texts)
    grammar = secret_scan.fit(docs)
    got = {r.doc_id: r for r in secret_scan.scan(docs, grammar).collect()}
    assign = re.compile(r"""([pP][aA][sS][sS][wW](?:[oO][rR])?[dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for d, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        named = [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]
        assert got[d].base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert set(named) <= set(got[d].spans.split(",")) | {""}
    unseen = docs_of(spark, ["the bare AKIB" + key(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") + " here", "unquestionably responsibilities"])
    r = {x.doc_id: x.spans for x in secret_scan.scan(unseen, grammar).collect()}
    assert r[0] == "format:9:29" and r[1] == ""
    masked = {x.doc_id: x.text for x in secret_scan.redact(docs, grammar).collect()}
    assert masked[0].startswith("é some words [SECRET]") and masked[0].endswith(" thereafter") and masked[80] == "id [SECRET] end" and masked[120] is None
    assert secret_scan.fit(empty(spark)) is None and secret_scan.scan(empty(spark), None).count() == 0


def test_rare_kinds_teach_too(spark):
    """One access key among many more documents than any sample, one without doc_id."""
    few = docs_of(spark, ["plain words here"])
    many = spark.range(9000).selectExpr("id AS doc_id", "concat('ordinary documents hold ', md5(CAST(id AS string))) AS text")
    rare = spark.createDataFrame([(None, f"id AKIA{x} end") for x in ("QWERTYUIOPASDFGH", "ZXCVBNMLKJHGFDSA")], "doc_id bigint, text string")
    with_rare = secret_scan.fit(many.union(rare))
    assert len(with_rare.automata) == 2 and len(secret_scan.fit(many).automata) == 1
    bare = docs_of(spark, ["the bare AKIBQAZWSXEDCRFVTGBY here"])
    assert secret_scan.scan(bare, with_rare).first().spans == "format:9:29"
    same = [secret_scan.fit(many.union(rare).repartition(n)) for n in (1, 7)]
    assert all((a.step == b.step).all() for a, b in zip(same[0].automata, same[1].automata)) and secret_scan.fit(few) is None


def test_long_and_overlapping_candidates(spark, monkeypatch):
    g = random.Random(17)
    key = lambda n, s="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(g.choice(s) for _ in range(n))
    taught = [f"some ordinary words of {w} and token={key(40)} thereafter" for w in ("unquestionably", "responsibilities", "correspondence") * 60]
    grammar = secret_scan.fit(docs_of(spark, taught))
    long, part = key(300), key(40) + "Z" + key(16, "0123456789abcdef") + "Z" + key(40)
    texts = [f"a {long} b", f"a {key(70000)} b", f"é {part} b"]
    got = {r.doc_id: r.spans.split(",") for r in secret_scan.scan(docs_of(spark, texts), grammar).collect()}
    assert "format:2:302" in got[0] and "format:2:70002" in got[1]
    assert any(x.startswith("hex:") for x in got[2]) and f"format:2:{2 + len(part)}" in got[2]
    masked = {r.doc_id: r.text for r in secret_scan.redact(docs_of(spark, texts), grammar).collect()}
    assert masked == {0: "a [SECRET] b", 1: "a [SECRET] b", 2: "é [SECRET] b"}
    k, s, n = secret_scan.CLASS[np.frombuffer(long.encode(), np.uint8)], np.array([0, 5]), np.array([300, 20])
    one = secret_scan.likelihoods(grammar.automata[0], 0, k, s, n)
    monkeypatch.setattr(secret_scan, "MOST", 1000)
    assert (one == secret_scan.likelihoods(grammar.automata[0], 0, k, s, n)).all()


def test_inferred_automaton_repeats_a_loop():
    a = secret_scan.infer([b"ab" * n for n in range(1, 30)])
    assert len(a.end) < 10 and np.isfinite(a.step).all()


def test_spans_by_a_plain_walk(spark):
    """Every format span again: each run walks each automaton a character at a time; probabilities of a state add up to one."""
    g = random.Random(37)
    key = lambda n, s="0123456789abcdef": "".join(g.choice(s) for _ in range(n))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    taught = [f"é some unquestionably ordinary words token={key(g.randint(12, 40))} thereafter" for _ in range(60)] + [f"id AKIA{key(16, upper)} responsibilities correspondence" for _ in range(40)]
    grammar = secret_scan.fit(docs_of(spark, taught))
    texts = [f"é bare AKIB{key(16, upper)} and x{key(24)}y then" for _ in range(40)] + taught[:60] + ["", None] * 2
    docs = docs_of(spark, texts + texts[:5])
    for a in [*grammar.automata, grammar.plain]:
        rows = np.exp(a.step + secret_scan.SIZE).sum(1) + np.exp(a.end)
        assert rows == pytest.approx(np.ones(len(rows)))

    def walk(a, start, word):
        q, total = start, 0.0
        for c in word.encode():
            k = secret_scan.CLASS[c]
            total += a.step[q, k]
            q = a.next[q, k] if a.next[q, k] >= 0 else start
        return total + a.end[q]

    n = 0
    for r in secret_scan.scan(docs, grammar).collect():
        t = (texts + texts[:5])[r.doc_id] or ""
        base = [(p, q) for p, _, q, _ in secret_scan.base_spans(t)]
        want = set()
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", t):
            gain = (max(walk(a, 0, m[0]) for a in grammar.automata) - walk(grammar.plain, secret_scan.N_CLASSES, m[0])) / len(m[0])
            if gain > secret_scan.MARGIN and not any(p <= m.start() and m.end() <= q for p, q in base):
                want.add(f"format:{m.start()}:{m.end()}")
        n += len(want)
        assert {x for x in r.spans.split(",") if x.startswith("format")} == want
    assert n > 20
    named = docs.selectExpr("*", "1 AS kind", "'x' AS value", "2L AS h", "'y' AS spans", "length(text) AS n_chars")
    same = secret_scan.redact(named, grammar)
    assert same.columns == named.columns and all(r.n_chars == (None if r.text is None else len(r.text)) for r in same.collect())


def test_a_very_long_credential(spark):
    """Found and masked as a whole, learned from in part."""
    docs = docs_of(spark, ["id " + "0123456789abcdef" * 30_000 + " end", "token=abcdefghijkl9"])
    grammar = secret_scan.fit(docs)
    assert {r.doc_id: r.n_hex for r in secret_scan.scan(docs, grammar).collect()} == {0: 1, 1: 0}
    assert {r.text for r in secret_scan.redact(docs, grammar).collect()} == {"id [SECRET] end", "[SECRET]"}


def test_merged_states_are_alike():
    """An automaton of strings that a known one made has its probabilities; with alpha near 2 next to nothing is merged."""
    g = random.Random(3)

    def made():  # digits and then letters, each lot ended by a fair coin
        out = "7"
        while g.random() < 0.5:
            out += "7"
        out += "z"
        while g.random() < 0.5:
            out += "z"
        return out.encode()

    strings = [made() for _ in range(4000)]
    a = secret_scan.infer(strings)
    p = lambda q, k: math.exp(a.step[q, k] + secret_scan.SIZE[k])
    digits = a.next[0, 0]
    letters = a.next[digits, 2]
    assert p(0, 0) == pytest.approx(1, abs=0.01) and p(digits, 0) == pytest.approx(0.5, abs=0.06) and p(letters, 2) == pytest.approx(0.5, abs=0.06) and math.exp(a.end[letters]) == pytest.approx(0.5, abs=0.06)
    assert len(a.end) < 8 < len(secret_scan.infer(strings, alpha=1.9).end)


# 8 ---------------------------------------------------------------------------------------------------------------


def best_of(rows, k=10):
    """Brute force over rows, repeated ones each, as (query_id, rank, vec_id, score)."""
    dim = max((len(v) for i, v in rows if v), default=0)
    ok = [(i, np.floor(1024 * np.array(np.float32(v + [0.0] * (dim - len(v))), float)).astype(int).tolist()) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v))]
    found = defaultdict(list)
    for i, q in ok:
        if i % 100 == 0:
            found[i] += [(-sum(a * b for a, b in zip(q, c)), j) for j, c in ok if j != i]
    return [(i, r + 1, j, -s) for i, x in found.items() for r, (s, j) in enumerate(sorted(x)[:k])]


def test_topk(spark):
    g = np.random.default_rng(8)
    rows = [(i, [float(x) for x in g.normal(size=6).round(1)]) for i in range(400)]
    rows += [(i, [0.5] * 6) for i in range(400, 700)]  # a very common vector
    rows += [(700, None), (800, [float("nan")] * 6), (900, [1.0, None]), (1000, [float("inf")] * 6), (1100, [2.0]), (None, [9.0] * 6), (100, rows[100][1]), (200, [0.1] * 6)]
    rows += [rows[250]] * 7 + [rows[251]] * 25  # repeated rows are candidates each
    df = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows], "vec_id bigint, embedding array<float>, q string, score double, n int").repartition(5)
    got = [tuple(r) for r in topk.top_k(df, df.vec_id % 100 == 0).collect()]
    assert sorted(got) == sorted(best_of(rows))
    assert topk.top_k(df.limit(0), df.vec_id % 100 == 0).count() == 0


def test_topk_of_repeated_queries_is_the_sql(spark, tmp_path):
    import duckdb

    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.1, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    df.coalesce(1).write.parquet(f"{tmp_path}/e")
    got = sorted(tuple(r) for r in topk.top_k(df, df.vec_id % 100 == 0).collect())
    want = duckdb.sql(topk.OP8_SQL.replace("FROM embeddings", f"FROM '{tmp_path}/e/*.parquet'")).fetchall()
    assert len(got) == 6 and [x[1:] for x in got] == [x[1:] for x in sorted(want)] and sorted(got) == sorted(best_of(rows))


def test_mtree_prunes():
    g = np.random.default_rng(1)
    x = np.floor(np.concatenate([g.normal(c, 1, (500, 8)) for c in range(0, 900, 30)]) * 10)
    t = topk.MTree(x, np.arange(len(x)))
    ids, score = t.search(x[7], 7, 10, x)
    s = x @ x[7]
    s[7] = -np.inf
    order = np.lexsort((np.arange(len(x)), -s))[:10]
    assert ids.tolist() == order.tolist() and score.tolist() == s[order].tolist()


# 9 ---------------------------------------------------------------------------------------------------------------


def windows_of(rows, section, budget=512, history=2, history_tokens=128):
    """(n_repeated, n_new, n_tokens) of each window of a conversation's (role, text) turns, turn by turn."""
    size = lambda t: len(re.findall(r"\w+|[^\w\s]", t)) + 4
    system = size(rows[0][1]) if rows[0][0] == "system" else 0
    n, out = [size(t) for _, t in rows], []
    first, i, new = bool(system), int(bool(system)), True
    while i < len(rows) or new:
        edge = min(len(rows), (i // section + 1) * section)
        back = max(j for j in range(history + 1) if i - j >= first and sum(n[i - j : i]) <= history_tokens)
        total, j = system + sum(n[i - back : i]), i
        while j < edge and (j == i or total + n[j] <= budget):
            total += n[j]
            j += 1
        out.append((back + (bool(system) and not new), j - i + (bool(system) and new), total))
        i, new = j, False
    return out


@pytest.mark.parametrize("section", [4096, 10, 64])
def test_chat(spark, section):
    odd = [(1, 0, "system", "sys <<s>> <<SYS>>&amp;"), (1, 1, "user", None), (1, 2, "assistant", "&lt;s> <<</SYS>> &amp;lb; [[INST]]\n</s"), (1, 3, None, "<"), (1, 4, "a\nb&nl;&", "x\n\ny"), (None, 0, "user", "n"), (None, None, "assistant", "é🙂" * 50)]
    odd += [(2, 0, "assistant", "a " * 2000), (2, 1, "user", "b"), (2, 2, "assistant", "c"), (2, 2, "assistant", "c"), (3, 0, "system", "only"), (4, 0, "user", "</s>[INST] ok [/INST]")]
    odd += [(5, i, "system" if not i else ["user", "assistant"][i % 2], f"word {i} " * (i % 40)) for i in range(4200 if section > 4000 else 500)]
    odd += [(6, 5000 + 1000 * i, "system" if not i else ["user", "assistant"][i % 2], f"time {i} " * (i % 30)) for i in range(100)]  # sparse numbers, from 5000 on
    odd += [(7, i // 40 - 1, "user", f"{i % 40:02} " + "y " * (i % 25)) for i in range(90)]  # many rows of one number, one of them negative
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in odd], "conv_id bigint, turn bigint, role string, text string, section string, place int, n int").repartition(3)
    out = chat.format_chats(df, section=section)
    by = defaultdict(list)
    for r in odd:
        by[r[0]].append(r)
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert set(got) == set(by)
    windows = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: (r.section, r.window)):
        windows[r.conv_id].append(r)
    for c, rows in by.items():
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in got[c].turns] == [(r[2] or "", r[3] or "") for r in rows]
        assert list(got[c].loss) == [r[3] or "" for r in rows if r[2] == "assistant"]
        assert [(r.n_repeated, r.n_new, r.n_tokens) for r in windows[c]] == windows_of([(r[2] or "", r[3] or "") for r in rows], section)
    assert all(r.n_tokens <= chat.BUDGET and r.formatted.startswith("<s>system\n") for r in windows[5] + windows[6]) and max(r.n_repeated for r in windows[5]) == 3
    assert windows[2][0].over_budget
    for c in (1, 2, 3, 4, None):  # no control string but those of the frame
        for r in windows[c]:
            assert r.formatted.count("<s>") == r.formatted.count("</s>") == r.n_repeated + r.n_new and "[INST]" not in r.formatted and "<<SYS>>" not in r.formatted
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


# 10 --------------------------------------------------------------------------------------------------------------


def test_lang_id(spark):
    g = random.Random(10)
    syllables = {"xa": ["ka", "to", "mi", "ru"], "yb": ["sch", "ung", "ein", "ter"], "zc": ["й", "ка", "то", "мы"]}
    rows = []
    for d in range(300):
        lang = list(syllables)[d % 3]
        rows.append((d, " ".join("".join(g.choice(syllables[lang]) for _ in range(g.randint(2, 4))) for _ in range(20)), lang))
    rows += [(300, None, "xa"), (301, "12 !?", "xa"), (302, "", None), (303, "kato miru", None), (304, "𐐨𐐩", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    held = lang_id.fold(4) == 2
    got = {r.doc_id: r for r in lang_id.predict(df, lang_id.fit(df.where(~held)), held).collect()}
    assert all(got[d].lang_pred == rows[d][2] for d in range(300)) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[d].lang_pred for d in (300, 301, 302, 303)] == ["und", "und", "und", "xa"] and got[304].lang_pred in syllables
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert [r.lang_pred for r in lang_id.predict(df, lang_id.fit(df.limit(0)), held).where("doc_id < 3").collect()] == ["und"] * 3


def test_lang_id_by_plain_vectors(spark):
    """Prototypes and cosines built one trigram at a time; repeated rows, columns of the names used inside, empty tables, long texts."""
    g = random.Random(20)
    rows = [(d, "".join(g.choice("abc déß東" if d % 2 else "xyz ñ京") for _ in range(g.randint(3, 200))), "pq"[d % 2]) for d in range(40)] + [(40, "ab " * 20_000, None), (41, "Zz", "q")]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, "v", 0.5, 1) for r in rows], "doc_id bigint, text string, lang string, lang_pred string, score double, i int").repartition(4)
    letters = lang_id._cache.get("letters") or lang_id._letters()

    def bundle(t):
        k = [0]
        for ch in t:
            c = lang_id._class(ord(ch))
            if c or k[-1]:
                k.append(c)
        if k[-1]:
            k.append(0)
        out = np.zeros(lang_id.DIM)
        for a, b, c in zip(k, k[1:], k[2:]):
            out += letters[0][a] * letters[1][b] * letters[2][c]
        return out

    unit = lambda v: v / (np.linalg.norm(v) or 1)
    proto = {x: unit(sum(bundle(t) for _, t, k in rows if k == x)) for x in "pq"}
    mean = (proto["p"] + proto["q"]) / 2
    proto = {x: unit(v - mean) for x, v in proto.items()}
    got = lang_id.fit(df)
    assert all(got[x] == pytest.approx(proto[x], abs=1e-6) for x in "pq")
    held = lang_id.fold(4) == 2
    for r in lang_id.predict(df, got, held).collect():
        sims = {x: max(float(bundle(rows[r.doc_id][1]) @ proto[x]), 0) for x in "pq"}
        assert r.lang_pred == max("pq", key=lambda x: float(bundle(rows[r.doc_id][1]) @ proto[x])) and r.score == pytest.approx(max(sims.values()) / (sum(sims.values()) or 1), abs=1e-3)
    assert lang_id.predict(df.limit(0), got, held).count() == 0 and lang_id.predict(df, got, held).count() == len(rows)


def test_lang_id_flushes(spark, monkeypatch):
    df = spark.createDataFrame([(d, "abcde fghij klmno"[d % 9 :], str(d % 3)) for d in range(60)], "doc_id bigint, text string, lang string").coalesce(1)
    whole = lang_id.fit(df)
    monkeypatch.setattr(lang_id, "HELD", 3)
    parts = lang_id.fit(df)
    assert whole.keys() == parts.keys() and all(whole[k] == pytest.approx(parts[k], abs=1e-9) for k in whole)


# kernels ---------------------------------------------------------------------------------------------------------


def test_spans_are_hashed_by_content():
    data = np.frombuffer(b"abcxabc", np.uint8)
    c = vec.sums(vec.BYTE[data])
    h = vec.span(c, np.array([0, 4, 1]), np.array([3, 7, 4]))
    assert h[0] == h[1] != h[2]
    assert (vec.unpack(vec.pack(np.array([1, 2**40 - 1], np.uint64), 5).tobytes(), 5) == [1, 2**40 - 1]).all()


# storage -----------------------------------------------------------------------------------------------------------


def test_a_missing_file_is_an_error(tmp_path):
    folder = str(tmp_path)
    store.save(folder, "x-0", np.arange(3))
    store.save_sorted(folder, "y-4", np.array([5, 1 << 39], np.uint64), np.array([[1], [2]], np.uint8))
    store.manifest(folder, {"x": [0, 1], "y": [4]})
    assert store.load(folder, "x-0").tolist() == [0, 1, 2] and store.load(folder, "x-2") is None and store.load(folder, "y-3.off") is None
    for name in ("x-1", "z-0"):  # a shard that was written, and a step that was not
        with pytest.raises(FileNotFoundError):
            store.load(folder, name)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": master})  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.shared_base(Session)


def test_counts_and_columns_come_back(tmp_path):
    g = np.random.default_rng(5)
    key = np.unique(g.integers(0, 1 << 40, 5000).astype(np.uint64))
    value = g.choice([0, 1, 1, 1, 2, 3, 200, 300, 1 << 40], (len(key), 3))
    store.save_counts(str(tmp_path), "c", 0, key, value)
    store.manifest(str(tmp_path), {"c": [0], "c_large": [0]})
    h = np.concatenate([key, key + np.uint64(1)]) << np.uint64(20)  # four bits of shard, all of them 0
    by = np.zeros(len(h), np.uint64)
    got = store.find_counts(str(tmp_path), "c", 4, h, 3, by=by)
    new = ~np.isin(key + np.uint64(1), key)
    assert (got[: len(key)] == value).all() and not got[len(key) :][new].any()
    x = np.concatenate([value, np.zeros((1, 3), np.int64)])
    assert (store.unpack_columns([store.pack_columns(x), store.pack_columns(x[:0]), store.pack_columns(x[:2])], 3) == np.concatenate([x, x[:2]])).all()
