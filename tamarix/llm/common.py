"""What the corpus operators share: the shared folder, Arrow word tables and
packed blobs that travel between a chunk of documents and its buckets."""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship as ship

#: White space that separates words everywhere here: space and \x09-\x0D.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows with whole texts or sets go to Python in batches of so many bytes.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a local
    session (tests) gets a temporary folder; a cluster has no folder that all
    its machines see, so there the operators refuse to run."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        base = "file://" + tempfile.mkdtemp(prefix="tamarix-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables that landed() wrote and nobody has removed, in order.
_LANDED: list[str] = []


def landed(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written to the shared folder and read back: the lineage is cut and
    lost executors don't bring recomputation with other results."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, BATCH_BYTES)
    _LANDED.append(path)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.landed_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes landed tables that no unfinished result reads any more."""
    for t in tables:
        if t is not None and getattr(t, "landed_at", None) in _LANDED:
            _remove(t.sparkSession, t.landed_at)


def landed_alone(df: DataFrame, name: str, since: int) -> DataFrame:
    """df landed; all tables landed since the mark `since` (marked()), which df
    was made from, are removed."""
    out = landed(df, name)
    for path in _LANDED[since:-1]:
        _remove(out.sparkSession, path)
    return out


def marked() -> int:
    return len(_LANDED)


def registered(path: str) -> str:
    """A path that was written by other means, to be removed like the others."""
    _LANDED.append(path)
    return path


def remove_landed(spark: SparkSession) -> None:
    """Removes all tables that are left, once no result is read any more."""
    for path in list(_LANDED):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    _LANDED.remove(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts (one pass over the column)."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


class Words:
    """The words of a chunk of texts: `array` (binary, words of all texts in
    order), `bounds` (text i has words bounds[i]:bounds[i + 1]). `solid`: the
    bytes that words are made of, if not all but white space, or a function that
    tells them."""

    def __init__(self, texts: pa.Array, lower: bool = False, solid: np.ndarray | Callable[[np.ndarray], np.ndarray] | None = None):
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        lo, hi = int(off[0]), int(off[-1])
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
        at = off - lo
        self.data, self.at = data, at
        solid = ~_WS[data] if solid is None else solid(data) if callable(solid) else solid[data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        begins = at[:-1][at[:-1] < len(data)]
        first[begins] = solid[begins]
        starts = np.flatnonzero(first)
        self.bounds = np.searchsorted(starts, at)
        self.bounds[-1] = len(starts)
        packed = data[solid]
        if lower:  # A-Z only
            packed = packed + ((packed >= 65) & (packed <= 90)).astype(np.uint8) * np.uint8(32)
        before = np.cumsum(solid, dtype=np.int64)[starts] - 1 if len(starts) else np.zeros(0, np.int64)
        self.packed = packed
        self.offsets = np.append(before, len(packed))
        self.array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(self.offsets), pa.py_buffer(packed)])
        self.n = len(starts)
        self._coded: tuple[np.ndarray, list[bytes]] | None = None

    def coded(self) -> tuple[np.ndarray, list[bytes]]:
        """(code of each word, the distinct words)."""
        if self._coded is None:
            d = self.array.dictionary_encode()
            self._coded = d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()
        return self._coded

    def codes(self) -> np.ndarray:
        """The code of each word."""
        return self.array.dictionary_encode().indices.to_numpy(zero_copy_only=False)

    def lengths(self) -> np.ndarray:
        return np.diff(self.bounds)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser over unsigned 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


#: Masks of the first 0 .. 8 bytes of eight.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def word_hashes(words: Words, order: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, in one of two independent families: a mix of
    its length and its bytes, eight at a time; XXH3 for over 16 bytes."""
    size, at, odd = np.diff(words.offsets), words.offsets[:-1], _ODD[order]
    data = np.concatenate([words.packed, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # those from each byte on
    out = mixed((eight[at] & _FIRST[np.minimum(size, 8)]) ^ mixed(size.astype(np.uint64) + odd))
    more = np.flatnonzero(size > 8)
    out[more] = mixed(out[more] * odd + (eight[at[more] + 8] & _FIRST[np.minimum(size[more] - 8, 8)]))
    for i in np.flatnonzero(size > 16).tolist():
        out[i] = xxhash.xxh3_64_intdigest(words.packed[at[i] : at[i] + size[i]].tobytes(), order)
    return out


def keyed_hashes(words: Words, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word, halves of one keyed BLAKE2b: who doesn't
    know the key can't find words that are alike."""
    codes, known = words.coded()
    table = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16, key=key).digest() for w in known), np.uint64).reshape(-1, 2)
    return table[codes, 0], table[codes, 1]


def rolled(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """The hash of each run of k values, out[i] of h[i : i + k]: each value is
    added to the finalised hash of those before it."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd = mixed(np.arange(1, k + 1, dtype=np.uint64) + np.uint64(1000 * (k + 100 * salt))) | np.uint64(1)
    out = np.full(n, odd[-1], np.uint64)
    for j in range(k):
        out = mixed(out * odd[j] + h[j : j + n])
    return out


def ranks(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """A number for each pair, equal for equal pairs only (values under 2^31)."""
    key = (major.astype(np.int64) << 32) | minor
    by = np.argsort(key)
    key = key[by]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(np.append(False, key[1:] != key[:-1])[: len(by)])
    return out


def run_ranks(codes: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of k codes, equal for equal runs only: runs of 1, 2,
    4, .. codes are numbered by sorting pairs of shorter ones. No hashes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    of, width = codes.astype(np.int64), 1
    while width < k:
        step = min(width, k - width)
        of = ranks(of[: len(of) - step], of[step:])
        width += step
    return of


def release() -> None:
    """Memory that a task's chunks needed goes back to the system: a worker that
    waits for its next task holds no more than it uses."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


_TRIM = _trim()


def chunks(batches: Iterator[pa.RecordBatch], most: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text each; a longer
    text is a slice of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text))
        size = np.asarray(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        total = np.cumsum(size)
        lo = 0
        while lo < b.num_rows:
            base = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, base + most, side="right")))
            yield b.slice(lo, hi - lo)
            pa.default_memory_pool().release_unused()
            lo = hi
    release()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1, for each i."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(np.asarray(starts, dtype=np.int64) - ends + lengths, lengths) + np.arange(total, dtype=np.int64)


def squeeze(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)
