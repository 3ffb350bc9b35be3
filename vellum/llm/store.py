"""Sorted arrays in the folder that driver and executors share, and shuffles of packed arrays.

Workers write whole files under a temporary name and rename them, so a repeated task leaves the same file.
Workers map the files into memory; where the shared folder is no file system of the operating system, they
are first fetched into an unnamed local file, a cache that any worker can make again. The folder is the session's
spark.checkpoint.dir; where that is unset, one is made in local mode only, as other machines couldn't read it.

A step that writes shards returns their numbers and the driver writes a manifest of them, so that a shard without rows
is told from a file that is missing, which is an error.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import mmap
import os
import shutil
import sys
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: a few MB of text, so a worker's memory doesn't follow the partition.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
BLOB = "kind int, shard int, blob binary"


def prepare(spark: SparkSession) -> None:
    """Sets the session's Arrow batch limits, which Spark reads when a plan runs, thus after an operator has returned."""
    for k, v in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(k, str(v))


def shared_base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, removed when the driver ends."""
    folder = f"{shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if path := _local(folder):
        os.makedirs(path, exist_ok=True)
        atexit.register(shutil.rmtree, path, True)
    else:
        fs, p = _remote(folder)
        fs.create_dir(p)
        atexit.register(fs.delete_dir, p)
    return folder


def _local(folder: str) -> str:
    u = urlparse(folder)
    return u.path if u.scheme in ("", "file") else ""


def _remote(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def save(folder: str, name: str, array: np.ndarray) -> None:
    if path := _local(folder):
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, array)
        os.replace(part, f"{path}/{name}.npy")
    else:
        fs, p = _remote(folder)
        with fs.open_output_stream(f"{p}/.{name}.{(u := uuid.uuid4().hex)}") as f:
            np.save(f, array)
        fs.move(f"{p}/.{name}.{u}", f"{p}/{name}.npy")


@functools.lru_cache(24_576)  # mappings hold no file descriptor, but a process may have some 65,000 of them
def load(folder: str, name: str) -> np.ndarray | None:
    """The array, mapped into memory; None for a shard that its step wrote no rows of. Raises for any other missing file."""
    got = _open(folder, name)
    if got is not None:
        return got
    kind, _, shard = name.partition(".")[0].rpartition("-")
    if not name.startswith(_MANIFEST):
        have = load(folder, f"{_MANIFEST}{kind}")
        if int(shard) not in have:
            return None
    raise FileNotFoundError(f"{folder}/{name}.npy is missing")


def manifest(folder: str, shards: dict[str, list[int]]) -> None:
    """Written by the driver after a step: the shards that there are of each kind of file."""
    for kind, have in shards.items():
        save(folder, f"{_MANIFEST}{kind}", np.array(sorted(have), np.int64))


def run_step(step: DataFrame, folder: str, kinds: dict[int, tuple[str, ...]]) -> list[int]:
    """Runs a step whose rows are (kind, shard, values...), one a shard that it wrote, writes the manifest of each kind's files and returns the values' sums."""
    got, sums = {k: [] for k in kinds}, [0] * (len(step.columns) - 2)
    for kind, shard, *values in step.collect():
        got[kind].append(shard)
        sums = [a + b for a, b in zip(sums, values)]
    manifest(folder, {name: got[k] for k, names in kinds.items() for name in names})
    return sums


def rows(columns: str, values: list[tuple]) -> pa.RecordBatch:
    """A record batch of integers: rows (kind, shard, values...)."""
    names = columns.replace(",", "").split()[::2]
    types = [pa.int32() if n in ("kind", "shard") else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], t) for i, t in enumerate(types)], names=names)


_MANIFEST = "shards of "


def _open(folder: str, name: str) -> np.ndarray | None:
    if path := _local(folder):
        try:
            with open(f"{path}/{name}.npy", "rb") as f:
                return _mapped(f)
        except FileNotFoundError:
            return None
    fs, p = _remote(folder)
    if fs.get_file_info(f"{p}/{name}.npy").type == 0:
        return None
    local = tempfile.TemporaryFile()
    with fs.open_input_stream(f"{p}/{name}.npy") as f:
        shutil.copyfileobj(f, local)
    local.seek(0)
    return _mapped(local)


def _mapped(f) -> np.ndarray:
    """The array of an open .npy file; the mapping keeps no file descriptor where Python allows that."""
    version = np.lib.format.read_magic(f)
    shape, _, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
    if not shape[0]:
        return np.zeros(shape, dtype)
    at, kw = f.tell(), {"trackfd": False} if sys.version_info >= (3, 13) else {}
    return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **kw), dtype, int(np.prod(shape)), at).reshape(shape)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shard_bits(spark: SparkSession) -> int:
    """log2 of the shards: two for each shuffle partition at least, so that they follow the cluster's setting."""
    return max(4, (2 * partitions(spark) - 1).bit_length())


def blobs(kind: int, shard: np.ndarray, rows: np.ndarray | list[np.ndarray]):
    """A record batch of packed rows, one blob for each shard, which must be sorted. Several arrays lie one after the other in each blob."""
    parts = rows if isinstance(rows, list) else [rows]
    if len(shard) == 0:
        return
    at = np.flatnonzero(firsts_of(shard))
    ends = np.append(at[1:], len(shard))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(at), kind, np.int32)), pa.array(shard[at].astype(np.int32)), pa.array([b"".join(p[a:b].tobytes() for p in parts) for a, b in zip(at, ends)], pa.binary())], names=["kind", "shard", "blob"]
    )


def firsts_of(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def split(blob: bytes, *widths: int) -> list[bytes]:
    """The arrays of a blob, given each one's bytes a row."""
    n, out, at = len(blob) // sum(widths), [], 0
    for w in widths:
        out.append(blob[at : at + n * w])
        at += n * w
    return out


def as_bytes(rec: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rec).view(np.uint8).reshape(len(rec), rec.dtype.itemsize)


def deal(df: DataFrame, n: int) -> DataFrame:
    """Blobs to n partitions by shard, evenly."""
    return df.repartitionById(n, F.col("shard") % n)


def frugal(f):
    """A map over batches after which the worker, which Spark keeps, gives unused memory back to the system."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def gather(batches) -> dict[tuple[int, int], list[bytes]]:
    """A task's blobs by (kind, shard)."""
    out: dict[tuple[int, int], list[bytes]] = {}
    for b in batches:
        for k, s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            out.setdefault((k, s), []).append(x)
    return out


def save_sorted(folder: str, name: str, key40: np.ndarray, values: np.ndarray | None = None) -> None:
    """A sorted hash array: 40-bit keys as offsets by their leading bits (so that some 16 keys share one) and 32-bit rests, and a row of values for each, if there are any."""
    b = min(16, max(8, len(key40).bit_length() - 4))
    save(folder, f"{name}.off", np.searchsorted(key40, np.arange((1 << b) + 1, dtype=np.uint64) << np.uint64(40 - b)).astype(np.uint32))
    save(folder, f"{name}.key", (key40 & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    if values is not None:
        save(folder, f"{name}.val", values)


def find_sorted(folder: str, name: str, key40: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, row) of each key, by binary search in the mapped arrays; row counts where found."""
    off = load(folder, f"{name}.off")
    key = load(folder, f"{name}.key")
    if off is None or not len(key):
        return np.zeros(len(key40), bool), np.zeros(len(key40), np.int64)
    sub, rest = (key40 >> np.uint64(41 - len(off).bit_length())).astype(np.int64), (key40 & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    lo, end = off[sub].astype(np.int64), off[sub + 1].astype(np.int64)
    hi = end.copy()
    for _ in range(int((hi - lo).max(initial=0)).bit_length()):
        mid = (lo + hi) >> 1
        less = (key[np.minimum(mid, len(key) - 1)] < rest) & (lo < hi)
        lo = np.where(less, mid + 1, lo)
        hi = np.where(less, hi, mid)
    row = np.minimum(lo, len(key) - 1)
    return (lo < end) & (key[row] == rest), row


def find(folder: str, name: str, bits: int, h: np.ndarray, columns: int, dtype=np.int64, by: np.ndarray | None = None, coded: bool = False) -> np.ndarray:
    """The values of 64-bit hashes in sharded sorted hash arrays; zeros where there are none. The shard is that of by, or of the hash itself. With no columns: whether there is such a hash."""
    out = np.zeros((len(h), columns) if columns else len(h), dtype if columns else bool)
    shard = ((h if by is None else by) >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange((1 << bits) + 1))
    low = ((h << np.uint64(bits)) >> np.uint64(24))[order]
    for s in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
        a, b = ends[s], ends[s + 1]
        hit, row = find_sorted(folder, f"{name}-{s}", low[a:b])
        if not columns:
            out[order[a:b]] = hit
        elif hit.any():
            got = load(folder, f"{name}-{s}.val")[row[hit]]
            out[order[a:b][hit]] = load(folder, f"{name}-{s}.book")[got[:, 0]] if coded else got
    return out


#: The code of rows that are kept in full.
LARGE = 255


def save_counts(folder: str, name: str, shard: int, key40: np.ndarray, values: np.ndarray) -> None:
    """A sorted hash array of rows of counts, a byte each row: its place among the shard's 254 most frequent rows, or LARGE, and such rows in full apart."""
    small = (values < 256).all(1) if values.shape[1] <= 8 else np.zeros(len(values), bool)
    packed = (values[small].astype(np.uint64) << (np.arange(values.shape[1], dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64)
    _, first, inv, n = np.unique(packed, return_index=True, return_inverse=True, return_counts=True)
    top = np.argsort(-n, kind="stable")[: LARGE - 1]
    rank = np.full(len(n), LARGE, np.uint8)
    rank[top] = np.arange(1, len(top) + 1)
    code = np.full(len(values), LARGE, np.uint8)
    code[small] = rank[inv]
    book = np.zeros((256, values.shape[1]), np.int64)
    book[1 : len(top) + 1] = values[small][first[top]]
    book[LARGE] = -1
    save_sorted(folder, f"{name}-{shard}", key40, code[:, None])
    save(folder, f"{name}-{shard}.book", book)
    large = code == LARGE
    save_sorted(folder, f"{name}_large-{shard}", key40[large], values[large].astype(np.uint64))


def find_counts(folder: str, name: str, bits: int, h: np.ndarray, columns: int, by: np.ndarray | None = None) -> np.ndarray:
    out = find(folder, name, bits, h, columns, by=by, coded=True)
    many = np.flatnonzero(out[:, 0] < 0)
    if len(many):
        out[many] = find(folder, f"{name}_large", bits, h[many], columns, by=None if by is None else by[many])
    return out


_ZSTD = pa.Codec("zstd", compression_level=1)


def pack_columns(x: np.ndarray) -> bytes:
    """Columns of non-negative integers as planes of bytes, as many as a column's greatest value needs, compressed."""
    out = [len(x).to_bytes(8, "little")]
    for i in range(x.shape[1]):
        k = (int(x[:, i].max(initial=0)).bit_length() + 7) // 8
        out += [bytes([k]), np.ascontiguousarray(x[:, i].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes()]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unpack_columns(blobs: list[bytes], columns: int) -> np.ndarray:
    """The rows of packed columns, of all blobs one after the other."""
    parts = [np.zeros((0, columns), np.int64)]
    for b in blobs:
        raw = np.frombuffer(_ZSTD.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True), np.uint8)
        n, at = int.from_bytes(raw[:8].tobytes(), "little"), 8
        out = np.zeros((columns, 8, n), np.uint8)
        for i in range(columns):
            k = int(raw[at])
            out[i, :k] = raw[at + 1 : at + 1 + k * n].reshape(k, n)
            at += 1 + k * n
        parts.append(np.ascontiguousarray(out.transpose(2, 0, 1)).view("<u8")[:, :, 0].astype(np.int64))
    return np.concatenate(parts)
