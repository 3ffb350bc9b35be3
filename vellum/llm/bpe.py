"""BPE encoding and decoding with a public vocabulary (operator 4).

Method: the backtracking encoder. Longest token matches at a position come from an Aho-Corasick automaton over the
vocabulary; a match may follow the last token only if the pair is compatible, that is if BPE applied to the two
strings together gives just these two tokens. If not, the next shorter match is tried, then the last token is
undone; positions proved dead are remembered, so the work is linear. Compatibility is read off the merges: undoing
the later of the two tokens again and again, no merge across the seam may come up that BPE would have done first.
The result equals the greedy merging by rank, without a queue.

Encoding reads whole texts; words repeat, so each worker keeps encoded chunks (runs without white space) and words
in maps of bounded size. Decoding joins slices of one byte buffer at the offsets of an offset table.

The vocabulary is a `tokenizers` file of the kind: NFC, white space to one space, lower case; words split by the
file's pattern; bytes as characters; an end-of-word mark; special tokens found in the raw text before all that. Its
path is a parameter and defaults to public_tokenizers.path("word_bpe_49k.json").

Defined cases: null or empty text has no tokens and decodes to the empty string; special tokens' strings in a text
are those tokens; repeated rows each get their result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

VOCABULARY = "word_bpe_49k.json"
#: Chunks and words that a worker remembers, and token pairs; a full map is emptied.
CHUNKS, WORDS, PAIRS = 300_000, 100_000, 300_000
#: White space as \\s of the file's pattern has it; str.split() also splits at U+001C-001F.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD = re.compile("[\x1c-\x1f]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError("not a vocabulary of this kind")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        mark, vocab = model["end_of_word_suffix"], model["vocab"]
        to_byte = {c: b for b, c in byte_characters().items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.find_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

        def symbols(token: str) -> str:
            """Bytes as U+0000-00FF; the byte that ends a word as U+0100-01FF."""
            last = token.endswith(mark) and token != mark
            body = [to_byte[c] for c in (token.removesuffix(mark) if last else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + 256 * last)

        own = {t: i for t, i in vocab.items() if all(c in to_byte for c in t.removesuffix(mark))}
        self.text = {i: symbols(t) for t, i in own.items()}
        self.id = {s: i for i, s in self.text.items()}
        #: Rank of a merge, by pair; a token's own merge: its rank and two parts. Lone symbols have rank -1.
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((i, j), rank)
            self.parts.setdefault(k, (rank, i, j))
        self.reachable = {i for i in self.text if len(self.text[i]) == 1 or self._splits_back(i)}
        self.longest = ahocorasick.Automaton()
        for i in self.reachable:
            self.longest.add_word(self.text[i], i)
        self.longest.make_automaton()
        trie = {self.text[i]: i for i in self.reachable}
        #: The longest reachable token that is a proper prefix.
        self.shorter = {i: next((trie[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in trie), -1) for i, s in ((i, self.text[i]) for i in self.reachable)}
        self.size = {i: len(s) for i, s in self.text.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        #: The offset table: token i decodes to buffer[offset[i]:offset[i+1]], as characters of the vocabulary file. Its slices
        #: are taken once.
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pieces = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.buffer, self.offset = b"".join(pieces), array("L", [0])
        for p in pieces:
            self.offset.append(self.offset[-1] + len(p))
        self.slices = [self.buffer[a:b] for a, b in zip(self.offset, self.offset[1:])]
        #: Whether the pattern leaves a run of letters whole, so that it needn't be asked about one.
        self.letters_are_words = all(self.pattern.findall(x) == [x] for x in ("a", "abcdefghijklmnopqrstuvwxyz", "zyx"))
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, bytes] = {}

    def _splits_back(self, i: int) -> bool:
        """A token that merging by rank really gives for its own string."""
        have = self.parts.get(i)
        if have is None:
            return False
        seq = [self.id.get(c, -1) for c in self.text[i]]
        return self._merge(seq) == [i]

    def _merge(self, seq: list[int]) -> list[int]:
        while len(seq) > 1:
            best = min((self.rank.get(p, 1 << 60), at) for at, p in enumerate(zip(seq, seq[1:])))
            if best[0] == 1 << 60:
                break
            pair = seq[best[1]], seq[best[1] + 1]
            new = self.id[self.text[pair[0]] + self.text[pair[1]]]
            out, at = [], 0
            while at < len(seq):
                if tuple(seq[at : at + 2]) == pair:
                    out.append(new)
                    at += 2
                else:
                    out.append(seq[at])
                    at += 1
            seq = out
        return seq

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of both strings together is just (a, b)."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self._compatible(a, b)
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # left, right: the tokens on both sides of the seam as merging went; undo the later of their merges each time.
        # A merge across the seam would have come first if its rank is below that of the merge just undone; on the
        # left, a tie goes to the earlier place, which lies on the left; on the right to the seam.
        left, right, undone, on_left = a, b, 1 << 60, True
        none = (-1, -1, -1)
        while True:
            across = self.rank.get((left, right))
            if across is not None and (across < undone or (across == undone and not on_left)):
                return False
            x, y = self.parts.get(left, none), self.parts.get(right, none)
            x = none if self.size[left] == 1 else x
            y = none if self.size[right] == 1 else y
            if x[0] < 0 and y[0] < 0:
                return True
            # of equal merges the one further right was done last
            if x[0] > y[0]:
                undone, left, on_left = x[0], x[2], True
            else:
                undone, right, on_left = y[0], y[1], False

    def encode_word(self, s: str) -> tuple[int, ...]:
        """Token ids of one word in symbols."""
        n = len(s)
        if (one := self.id.get(s)) is not None and one in self.reachable:
            return (one,)
        at_best = self._longest_at(s)
        out: list[int] = []
        dead = set()
        pos, token = 0, at_best[0]
        while True:
            end = pos + self.size[token]
            if end not in dead and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return tuple(out)
                pos, token = end, at_best[end]
                continue
            token = self.shorter[token]
            while token < 0:  # nothing fits here: undo the last token and try a shorter one in its place
                dead.add(pos)
                last = out.pop()
                pos -= self.size[last]
                token = self.shorter[last]

    def _longest_at(self, s: str) -> list[int]:
        """For each place, the longest token that starts there, from one pass of the automaton."""
        out, size = [-1] * len(s), self.size
        for end, i in self.longest.iter(s):
            start = end - size[i] + 1
            if out[start] < 0 or size[out[start]] < size[i]:
                out[start] = i
        return out

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space, after NFC and folding, as little-endian 32-bit integers."""
        if self.letters_are_words and chunk.isascii() and chunk.isalpha():
            return array("I", self.encode_word(chunk[:-1] + chr(ord(chunk[-1]) + 256))).tobytes()
        ids: list[int] = []
        for w in self.pattern.findall(chunk):
            got = self.words.get(w)
            if got is None:
                raw = w.encode()
                got = self.encode_word(raw[:-1].decode("latin-1") + chr(raw[-1] + 256))
                if len(self.words) >= WORDS:
                    self.words.clear()
                self.words[w] = got
            ids += got
        return array("I", ids).tobytes()

    def _ordinary(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # lower case of each character by itself: str.lower() gives a final sigma another form
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        chunks = SPACE.split(text) if ODD.search(text) else text.split()
        cache = self.chunks
        try:
            return b"".join(map(cache.__getitem__, chunks))
        except KeyError:
            pass
        out = []
        for c in chunks:
            got = cache.get(c)
            if got is None:
                got = self._chunk(c)
                if len(cache) >= CHUNKS:
                    cache.clear()
                if len(c) < 200:
                    cache[c] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.find_special is None or "<|" not in text or not self.find_special.search(text):
            return self._ordinary(text)
        out, at = [], 0
        for m in self.find_special.finditer(text):
            out += [self._ordinary(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._ordinary(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text: with no decoder in the file, tokens as written there, joined by spaces."""
        return b" ".join(map(self.slices.__getitem__, memoryview(ids).cast("I")))


@lru_cache(4)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, path: str | None = None, outputs: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256; with outputs also ids and the decoded text."""
    store.prepare(docs.sparkSession)
    path = path or vocabulary_path()

    @store.frugal
    def run(batches):
        bpe = load(path)
        for b in batches:
            every = [bpe.encode(t.as_py()) for t in b.column("text")]
            texts = [bpe.decode(x) for x in every]
            digest = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
            n = np.array([len(x) >> 2 for x in every], np.int64)
            cols = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(n), "ids_sha256": digest(every), "decoded_sha256": digest(texts)}
            if outputs:
                flat = np.frombuffer(b"".join(every), "<u4").astype(np.int32)
                cols |= {"ids": pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), flat), "decoded": pa.array(texts, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * outputs)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
