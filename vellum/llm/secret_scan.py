"""Secret scanning with inferred grammars (operator 7).

Base rules give spans by pattern (KINDS). From the credentials that they find in all documents, one probabilistic
automaton a kind is inferred: the prefix tree of their character classes, whose states are merged while their
continuations are statistically compatible (Hoeffding's bound, as in ALERGIA). All candidates, the runs of LEAST or more
VALUE characters, are then scored: the log likelihood of the candidate under the best automaton, a character, against a
class-pair model of ordinary runs. A candidate above the threshold becomes a span of kind `format`, beside base spans
that overlap it; if it lies within one, it is named already. Base spans stay in any case.

A span is kind:start:end in code points, end exclusive; for `assign` it is the whole assignment.

Fitting reads all documents. Each task keeps a kind's FIT_STRINGS distinct credentials of least hash (of the ordinary
runs PLAIN times as many), and of these the least again are learned from, so a kind that occurs at all has its
automaton, and the same strings are taken however the table is split. The patterns run only on texts that hold a rule's
fixed part, which is searched over the bytes of many texts at once; whole texts are always read.

Defined cases: null or empty text has no spans (base_sha256 is that of the empty string, spans is ''); null
doc_id is returned as null; repeated rows each get their result; with no credentials to learn from there are no
`format` spans; runs over MOST characters teach nothing to the model of ordinary runs, and credentials teach by their
first MOST characters, so what the driver gets is bounded; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store, vec

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
FIT_STRINGS, PLAIN, SALTS = 400, 5, 8
#: Candidates have this length at least, and this advantage a character in natural logarithms. Up to MOST characters they
#: are scored side by side, longer ones each by itself in chunks of CHUNK.
LEAST, MOST, MARGIN, CHUNK = 16, 256, 0.35, 1 << 16
ALPHA = 0.05
MASK = "[SECRET]"
OUT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_spans bigint"

VALUE = vec.byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_=-"])
HEXES = vec.byte_class(b"0123456789abcdef")
#: Character classes of the automata: digit, a-f, other lower case, A-F, other upper case, sign.
CLASS = np.full(256, 5, np.int64)
for _i, _chars in enumerate((b"0123456789", b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ")):
    CLASS[list(_chars)] = _i
N_CLASSES = 6
#: ln of the characters in a class, so that likelihoods are those of characters.
SIZE = np.log([10.0, 6.0, 20.0, 6.0, 20.0, 5.0])


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the credential) of the base rules, leftmost and not overlapping for each kind."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out)


@dataclass(frozen=True)
class Automaton:
    """next[state, class] (-1: none) and ln probabilities of a class, and of ending, in a state."""

    next: np.ndarray
    step: np.ndarray
    end: np.ndarray


def infer(strings: list[bytes], alpha: float = ALPHA) -> Automaton:
    """Merges the statistically compatible states of the prefix tree of class strings (red-blue order)."""
    child: list[dict[int, int]] = [{}]
    count: list[dict[int, int]] = [{}]
    ends = [0]
    for s in strings:
        at = 0
        for k in CLASS[np.frombuffer(s, np.uint8)].tolist():
            count[at][k] = count[at].get(k, 0) + 1
            if k not in child[at]:
                child[at][k] = len(child)
                child.append({}), count.append({}), ends.append(0)
            at = child[at][k]
        ends[at] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def alike(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            na, nb = ends[a] + sum(count[a].values()), ends[b] + sum(count[b].values())
            if not na or not nb:
                continue
            near = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(ends[a] / na - ends[b] / nb) > near:
                return False
            for k in count[a].keys() | count[b].keys():
                if abs(count[a].get(k, 0) / na - count[b].get(k, 0) / nb) > near:
                    return False
            todo += [(child[a][k], child[b][k]) for k in child[a].keys() & child[b].keys() if child[a][k] != child[b][k]]
        return True

    def fold(into: int, tree: int) -> None:
        """Adds a tree's counts to the states that its strings reach from into."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            ends[a] += ends[b]
            for k, n in count[b].items():
                count[a][k] = count[a].get(k, 0) + n
                if k in child[b]:
                    if k in child[a]:
                        todo.append((child[a][k], child[b][k]))
                    else:
                        child[a][k] = child[b][k]

    red, i = [0], 0
    blue = [(0, k) for k in sorted(child[0])]
    while i < len(blue):
        parent, k = blue[i]
        i += 1
        q = child[parent].get(k)
        if q is None or q in red:
            continue
        for r in red:
            if alike(r, q):
                child[parent][k] = r
                fold(r, q)
                break
        else:
            red.append(q)
        if q in red:
            blue += [(q, x) for x in sorted(child[q])]
        else:
            blue += [(r, x) for x in sorted(child[r]) if child[r][x] not in red]
    number = {q: j for j, q in enumerate(red)}
    nxt, step, end = np.full((len(red), N_CLASSES), -1), np.zeros((len(red), N_CLASSES)), np.zeros(len(red))
    for q, j in number.items():
        total = ends[q] + sum(count[q].values())
        end[j] = math.log((ends[q] + 0.1) / (total + 0.1 * (N_CLASSES + 1)))
        for k in range(N_CLASSES):
            step[j, k] = math.log((count[q].get(k, 0) + 0.1) / (total + 0.1 * (N_CLASSES + 1)))
            nxt[j, k] = number.get(child[q].get(k), -1)
    return Automaton(nxt, step - SIZE, end)


def background(strings: list[bytes]) -> Automaton:
    """Ordinary runs: the class follows the last one."""
    n, end = np.full((N_CLASSES + 1, N_CLASSES), 0.5), np.full(N_CLASSES + 1, 0.5)
    for s in strings:
        k = CLASS[np.frombuffer(s, np.uint8)]
        np.add.at(n, (np.append(N_CLASSES, k[:-1]), k), 1)
        end[k[-1]] += 1
    total = n.sum(1) + end
    return Automaton(np.tile(np.arange(N_CLASSES), (N_CLASSES + 1, 1)), np.log(n / total[:, None]) - SIZE, np.log(end / total))


def likelihoods(a: Automaton, start: int, classes: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """ln probability of each run [s, s+n) of classes; a class that no state foresees costs its smoothed share."""
    state, out = np.full(len(s), start), np.zeros(len(s))
    short = n <= MOST
    for i in range(int(n[short].max(initial=0))):
        on = np.flatnonzero(short & (n > i))
        k = classes[s[on] + i]
        out[on] += a.step[state[on], k]
        to = a.next[state[on], k]
        state[on] = np.where(to < 0, start, to)
    if not short.all():
        step, to = a.step.tolist(), np.where(a.next < 0, start, a.next).tolist()
        for r in np.flatnonzero(~short).tolist():
            q, sum_ = start, 0.0
            for lo in range(int(s[r]), int(s[r] + n[r]), CHUNK):
                for k in classes[lo : min(lo + CHUNK, int(s[r] + n[r]))].tolist():
                    sum_ += step[q][k]
                    q = to[q][k]
            state[r], out[r] = q, sum_
    return out + a.end[state]


@dataclass(frozen=True)
class Grammars:
    automata: tuple[Automaton, ...]
    plain: Automaton

    def advantage(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The best automaton's ln likelihood over the plain model's, a character."""
        k, n = CLASS[data], e - s
        plain = likelihoods(self.plain, N_CLASSES, k, s, n)
        best = np.max([likelihoods(a, 0, k, s, n) for a in self.automata], 0)
        return (best - plain) / np.maximum(n, 1)


def fit(docs: DataFrame, strings: int = FIT_STRINGS) -> Grammars | None:
    """The grammars of the credentials in all documents; None if there are none."""
    store.prepare(docs.sparkSession)
    most = {-1: strings * PLAIN} | dict.fromkeys(range(len(KINDS)), strings)

    @store.frugal
    def credentials(batches):
        least: dict[int, dict[int, bytes]] = {k: {} for k in most}
        for b in batches:
            for _, _, data, off in vec.texts(b):
                raw, c = data.tobytes(), vec.sums(vec.BYTE[data])
                at: dict[int, list] = {k: [] for k in range(len(KINDS))}
                covered = np.zeros(len(data) + 1, np.int64)
                for i in hits(data, off).tolist():
                    text = raw[off[i] : off[i + 1]].decode()
                    for s, k, e, v in base_spans(text):
                        lo, hi = (int(off[i]) + len(text[:x].encode()) for x in (s, e))
                        first = lo + len(text[s:v].encode())
                        at[k].append((first, min(hi, first + MOST)))
                        covered[lo:hi] = 1
                s, e, _ = vec.runs(VALUE[data], off)
                covered = np.append(0, np.cumsum(covered))
                plain = (e - s >= 8) & (e - s <= MOST) & (covered[e] == covered[s])
                for k, x in [(-1, np.stack([s[plain], e[plain]], 1)), *((k, np.array(x, np.int64).reshape(-1, 2)) for k, x in at.items())]:
                    h, first = np.unique(vec.span(c, x[:, 0], x[:, 1]).view(np.int64), return_index=True)
                    least[k].update((g, raw[p:q]) for g, (p, q) in zip(h[: most[k]].tolist(), x[first[: most[k]]].tolist()))
                    least[k] = {g: least[k][g] for g in sorted(least[k])[: most[k]]}
        rows = [(k, g, v) for k, got in least.items() for g, v in got.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.int64(), pa.binary()))], names=["kind", "h", "value"])

    # ranked in SALTS groups a kind, so that no task has them all; of what is left of each the driver takes the least
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(credentials, "kind int, h bigint, value binary").distinct()
    nth = F.row_number().over(Window.partitionBy("kind", "salt").orderBy("h", "value"))
    found = found.withColumn("salt", F.pmod("h", F.lit(SALTS))).withColumn("nth", nth).where(F.col("nth") <= max(most.values()))
    rows = found.where(F.col("nth") <= F.when(F.col("kind") < 0, most[-1]).otherwise(strings)).select("kind", "h", "value").collect()
    by = {k: sorted(v for _, v in sorted((r.h, bytes(r.value)) for r in rows if r.kind == k)[: most[k]]) for k in most}
    automata = tuple(infer(by[k]) for k in range(len(KINDS)) if by[k])
    return Grammars(automata, background(by[-1])) if automata else None


def _found(low: bytes, word: bytes) -> list[int]:
    out, at = [], low.find(word)
    while at >= 0:
        out.append(at)
        at = low.find(word, at + 1)
    return out


def hits(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Documents that hold a fixed part of a base rule: a keyword, AKIA, or 16 hexadecimal digits in a row."""
    low, raw = vec.LOWER[data].tobytes(), data.tobytes()
    at = [x for w in (b"passw", b"secret", b"token", b"api") for x in _found(low, w)] + _found(raw, b"AKIA")
    s, e, _ = vec.runs(HEXES[data], off)
    at = np.concatenate([np.array(at, np.int64), s[e - s >= 16]])
    return np.unique(np.searchsorted(off, at, "right") - 1)


def spans_of(data: np.ndarray, off: np.ndarray, grammars: Grammars | None) -> dict[int, tuple[list, list]]:
    """By document: its base spans (start, kind, end, credential) and the spans that the grammars add, in code points."""
    raw = data.tobytes()
    out: dict[int, tuple[list, list]] = {}
    for i in hits(data, off).tolist():
        if got := base_spans(raw[off[i] : off[i + 1]].decode()):
            out[i] = got, []
    if grammars:
        s, e, _ = vec.runs(VALUE[data], off)
        keep = e - s >= LEAST
        s, e = s[keep], e[keep]
        keep = grammars.advantage(data, s, e) > MARGIN
        for x, y, i in zip(s[keep].tolist(), e[keep].tolist(), (np.searchsorted(off, s[keep], "right") - 1).tolist()):
            at = len(raw[off[i] : x].decode())
            base, more = out.get(i, ([], []))
            if not any(p <= at and at + y - x <= q for p, _, q, _ in base):
                more.append((at, at + y - x))
                out[i] = base, more
    return out


def scan(docs: DataFrame, grammars: Grammars | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans."""
    store.prepare(docs.sparkSession)
    empty = hashlib.sha256(b"").hexdigest()

    @store.frugal
    def run(batches):
        for b in batches:
            out = []
            for _, _, data, off in vec.texts(b):
                found = spans_of(data, off, grammars)
                for i in range(len(off) - 1):
                    if i not in found:
                        out.append((0, 0, 0, empty, "", 0))
                        continue
                    base, more = found[i]
                    named = [f"{KINDS[k]}:{p}:{q}" for p, k, q, _ in base]
                    every = sorted([(p, k, q) for p, k, q, _ in base] + [(p, len(KINDS), q) for p, q in more])
                    out.append((*(sum(k == j for _, k, _, _ in base) for j in range(3)), hashlib.sha256(",".join(named).encode()).hexdigest(), ",".join(f"{(*KINDS, 'format')[k]}:{p}:{q}" for p, k, q in every), len(every)))
            cols = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def redact(docs: DataFrame, grammars: Grammars | None, mask: str = MASK) -> DataFrame:
    """docs with each span (overlapping ones together) replaced by mask; n_chars, if there is such a column, follows."""
    store.prepare(docs.sparkSession)

    @store.frugal
    def run(batches):
        for b in batches:
            texts, sizes = b.column("text").to_pylist(), b.column("n_chars").to_pylist() if "n_chars" in b.schema.names else None
            for lo, _, data, off in vec.texts(b):
                for i, (base, more) in spans_of(data, off, grammars).items():
                    text, out, at = texts[lo + i], [], 0
                    for p, q in sorted([(p, q) for p, _, q, _ in base] + more):
                        if p >= at:
                            out += [text[at:p], mask]
                        at = max(at, q)
                    texts[lo + i] = "".join([*out, text[at:]])
                    if sizes:
                        sizes[lo + i] = len(texts[lo + i])
            cols = {"text": texts} | ({"n_chars": sizes} if sizes else {})
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else b.column(f.name) for f in b.schema], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, fit(docs))
