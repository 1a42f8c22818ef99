"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut, drop  # noqa: F401

U64 = np.uint64
MIX1, MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Text is handled in pieces of about this many bytes inside a task, so memory does not follow the batch.
CHUNK_BYTES = 1 << 21


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def snug(df: DataFrame, rows: int, per: int = 250_000) -> DataFrame:
    """As many partitions as a known number of rows needs, one for each core at least: small tables don't leave a file
    for each of many partitions."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, 1 + rows // per))


def crc_mod(id_col: str, k: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(k))


def give_back() -> None:
    """After a fit or a task: hand freed memory to the system, which the allocators would keep for as long as the process lives."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def sampled(key: Column, share: float | Column) -> Column:
    """Whether a row is among about this share of all rows, by a 64-bit hash of its key; null keys have one hash."""
    if isinstance(share, float | int):
        return F.lit(True) if share >= 1 else F.xxhash64(key) < F.lit(int(share * 2**64) - 2**63)
    return (share >= 1) | (F.xxhash64(key) / F.lit(2.0**64) + 0.5 < share)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * MIX1
    x = (x ^ (x >> U64(27))) * MIX2
    return x ^ (x >> U64(31))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets (n + 1); null rows are empty. No copy where none is null."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(pa.large_string() if pa.types.is_string(col.type) else pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_large_string(col.type) else b"")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw, off - off[0]


def pieces(off: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges [i, j) of about `limit` bytes each; a longer row is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j
        i = j


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = U64(base), U64(pow(base, -1, 1 << 64))
        self.pow = self.ipow = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pow) < n:
            m = max(n, 2 * len(self.pow), CHUNK_BYTES + (1 << 16))
            for name, b in (("pow", self.base), ("ipow", self.inv)):
                x = np.full(m, b, U64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.pow[:n], self.ipow[:n]


POWERS = Powers(0x9E3779B97F4A7C15 | 1)
#: A random 64-bit value for each byte: sums of small byte values times powers leave fewer patterns this way.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """H[i] = sum of value(b[j]) * base**j for j < i, modulo 2**64; n + 1 entries."""
    p, _ = POWERS.upto(len(b) + 1)
    h = np.zeros(len(b) + 1, U64)
    np.cumsum(BYTE_VALUES[b] * p[: len(b)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end), the same wherever the bytes stand."""
    _, ip = POWERS.upto(len(h))
    return (h[end] - h[start]) * ip[start]
