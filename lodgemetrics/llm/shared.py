"""Helpers of the training-data operators: staged tables, document keys, vectorised word and n-gram hashes."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: Symbols hashed at once; longer texts go through in overlapping slices, so memory does not follow text length.
SLICE = 1_500_000
_MASK64 = (1 << 64) - 1
_P1, _P2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors re-read it, and lineage ends there.

    The folder goes when the session's JVM ends, or with ``drop_staged``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def measured(df: DataFrame, tag: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``staged``, and aggregates of the rows that were written, taken as they are written: no second query reads them."""
    seen = Observation()
    out = staged(df.observe(seen, *[c.alias(name) for name, c in measures.items()]), tag)
    got = seen.get
    return out, {name: got[name] for name in measures}


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again: all that came from it is staged itself."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back_memory() -> None:
    """Return what this process has freed to the system, where its C library can; large arrays leave holes otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, key, text: key tells rows of one doc_id with different texts apart; null text is empty."""
    body = F.coalesce(docs[text], F.lit(""))
    return docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[doc_id], body).alias("key"), body.alias("text"))


def without_rows(docs: DataFrame, bad: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` less the rows whose doc_id and key (see ``keyed``) stand in ``bad``; null ids are compared as values."""
    gone = bad.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    key = F.xxhash64(docs[doc_id], F.coalesce(docs[text], F.lit("")))
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["gone_id"]) & (key == gone["gone_key"]), "left_anti")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of an Arrow string column; nulls must have been filled."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.binary()), np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P1))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n, kept per worker."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE + 100_000)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b & _MASK64, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        have = _POWERS[base] = (both[0], both[1])
    return have


class SpanHash:
    """64-bit hashes of any span of a symbol sequence, equal for equal spans wherever they stand."""

    def __init__(self, symbols: np.ndarray, base: int = _P1):
        self.power, self.inverse = _powers(base, len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.power[:len(symbols)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        """Hash of each span of ``length`` symbols."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n] + np.uint64(length))


def byte_symbols(raw: np.ndarray) -> np.ndarray:
    return _BYTE[raw]


def second(symbols: np.ndarray) -> SpanHash:
    """An independent hash; with the first one, 128 bits."""
    return SpanHash(symbols ^ np.uint64(0x5851F42D4C957F2D), _P2)


WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and every byte of a non-ASCII character.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray = WORD) \
        -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each run of ``word`` bytes, and each text's first run (one more than rows).

    The default takes words [^\\x20\\x09-\\x0D]+.
    """
    solid = np.zeros(len(raw) + 2, bool)
    solid[1:-1] = word[raw]
    inner = offsets[1:-1]
    starts = solid[1:-1] & ~solid[:-2]
    ends = solid[1:-1] & ~solid[2:]
    cut = inner[(inner > 0) & (inner < len(raw))]
    starts[cut] = solid[1:-1][cut]
    ends[cut - 1] = solid[1:-1][cut - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def row_slices(offsets: np.ndarray, most: int = SLICE):
    """Row ranges of at most ``most`` bytes each; a longer text stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(key)
    if n < w:
        return key[:0]
    rows = -(-n // w)
    grid = np.full(rows * w, np.iinfo(key.dtype).max, key.dtype)
    grid[:n] = key
    grid = grid.reshape(rows, w)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n - w + 1], head[w - 1:n])


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
