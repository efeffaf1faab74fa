"""Pieces that several text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ODD = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the documents that no model may learn from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def row_key(doc_id: Column, text: Column) -> Column:
    """What tells rows of documents apart: doc_id, which may be null or repeat, and 128 bits of the
    text. Never null itself, and equal for rows that repeat both."""
    return F.struct(doc_id.alias("doc_id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("k"))


#: glibc's number of the setting, and the size from which a block of memory goes back when it is freed.
M_MMAP_THRESHOLD, GIVEN_BACK = -3, 1 << 20
_held: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any] = lambda: None) -> Any:
    """What ``make`` builds, kept by this worker process from task to task until another name's takes
    its place: workers serve one operator after the other, and only the last one's cache stays."""
    if name not in _held:
        if not _held:
            # A fixed threshold: by default glibc raises it and keeps arrays of up to 32 MB.
            getattr(ctypes.CDLL(None), "mallopt", lambda *_: 0)(M_MMAP_THRESHOLD, GIVEN_BACK)
        _held.clear()
        _held[name] = make()
    return _held[name]


class WordHashes(dict):
    """word bytes -> 64-bit hash; remembers at most ``room`` words."""

    room = 400_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.room:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(MIX_1)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(31))


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp polynomial hash, modulo 2^64, of each run of ``size`` word hashes.

    Built by doubling: the hash of a run is that of its first part times a power of
    the base, plus that of its second part.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(ODD)
    done, have, power = None, 0, np.uint64(1)
    block, width, block_power = words, 1, base
    left = size
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if done is None:
                    done, have, power = block, width, block_power
                else:
                    m = len(words) - have - width + 1
                    done = done[:m] * block_power + block[have : have + m]
                    have, power = have + width, power * block_power
            left >>= 1
            if left:
                m = len(words) - 2 * width + 1
                block = block[:m] * block_power + block[width : width + m]
                width, block_power = 2 * width, block_power * block_power
    return mixed(done[:n])


def packed_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as compressed byte planes of their differences."""
    import zstandard

    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked_sorted(data: bytes) -> np.ndarray:
    import zstandard

    if not data:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
