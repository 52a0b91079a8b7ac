"""Shared helpers: storage that survives lost executors, packing, byte-level words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words everywhere in this subpackage.
WORD_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a Java character class.
SPACE_CLASS = r"[ \t\n\x0B\f\r]"


_own: list[str] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is configured on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="kindred-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/kindred/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch; Spark's own bound is sixteen times as much, which two tasks of whole texts feel.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Held while a table is written: shuffle files go when the write has ended.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", BATCH_KEY: str(BATCH_BYTES)}


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches for the session, for operators whose result is computed after they return; a bound that was set stays."""
    if spark.conf.get(BATCH_KEY) == "67108864b":
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


@contextlib.contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Settings for a write that runs once; the session's own come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors.

    The table stays until ``discard``; what an operator returns stays for its caller.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with writing(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made, once nothing reads them any more."""
    for t in tables:
        path = getattr(t, "_written_at", None)
        if path:
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(conf).delete(there, True)


def give_back(batches: Iterator) -> Iterator:
    """Passes batches on; at the task's end the worker's free memory goes back to the system."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def word_array(col):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a column as an array; none for null or blank text."""
    trimmed = F.btrim(F.coalesce(col, F.lit("")), F.lit(WORD_SPACE.decode()))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE_CLASS}+"))


# --- packing of sorted integers -------------------------------------------------


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as zstd over byte planes of their differences."""
    diffs = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    planes = diffs.view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def pack_columns(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays of one length as zstd over their byte planes."""
    planes = [np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def unpack_columns(blob: bytes, count: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(count, 8, -1)
    return [np.ascontiguousarray(p.T).view("<u8").ravel() for p in raw]


# --- hashing of words straight from UTF-8 buffers -------------------------------

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 17
_powers: list[np.ndarray] = []


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), vectorised."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_table() -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    codes[65:91] += np.uint64(32)  # A-Z count as a-z
    return mix(codes, 7)


_TABLE = _byte_table()
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WORD_SPACE)] = False


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _PIECE * 2) + 1
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _powers


def _hash_piece(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data`` and their first bytes; no word spans a position in ``starts``."""
    word = _IS_WORD[data]
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    before[starts[starts < len(data)]] = False
    first = np.flatnonzero(word & ~before)
    if not len(first):
        return np.empty(0, np.uint64), first
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    cut = starts[(starts > 0) & (starts <= len(data))] - 1
    after[cut] = False
    last = np.flatnonzero(word & ~after) + 1
    power, inverse = _power_tables(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * power[: len(data)], dtype=np.uint64)))
    return mix((sums[last] - sums[first]) * inverse[first], 3) ^ mix((last - first).astype(np.uint64), 5), first


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), where


def hashed_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, word hashes, word offsets by row) for runs of rows; memory is bounded
    by a piece of text (a longer single text is hashed piece by piece, cut at white space)."""
    data, where = text_buffers(column)
    rows, i = len(where) - 1, 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(where, where[i] + _PIECE, side="right")) - 1)
        low, high = int(where[i]), int(where[j])
        if j == i + 1 and high - low > 2 * _PIECE:
            parts, at = [], low
            while at < high:
                end = min(high, at + _PIECE)
                while end < high and _IS_WORD[data[end]]:
                    gaps = np.flatnonzero(~_IS_WORD[data[end : min(high, end + 4096)]])
                    end = end + int(gaps[0]) if len(gaps) else min(high, end + 4096)
                parts.append(_hash_piece(data[at:end], np.zeros(1, np.int64))[0])
                at = end
            hashes = np.concatenate(parts)
            yield i, hashes, np.array([0, len(hashes)])
        else:
            starts = where[i : j + 1] - low
            hashes, first = _hash_piece(data[low:high], starts)
            yield i, hashes, np.searchsorted(first, starts)
        i = j


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words; a shorter sequence is one window of its own."""
    n = len(words)
    if not n:
        return words
    size = min(width, n)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ words[k : n - size + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out, 11)
