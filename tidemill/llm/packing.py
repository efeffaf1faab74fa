"""Packing documents into token sequences along a space-filling curve.

The token ids of a document are hashed to a signed vector, projected to a few dimensions by
fixed Gaussian directions and cut to a grid; the Hilbert index of the grid cell is its key.
Rows sort by that key over range partitions, and a running sum of lengths along the curve,
within and over partitions, gives each document its place in one long stream. Sequences are
equal cuts of the stream, so neighbours on the curve share sequences and only the very last
sequence is not full.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.tokens import ids_kind, vocabulary_path, word_ids
from tidemill.session import ship, table

DIMENSIONS, GRID_BITS, HASHED = 4, 8, 256


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of ``cells`` (unsigned, below 2^bits).

    The cells' bits are turned axis by axis into the curve's Gray code, from the coarsest
    level down, and the code's prefix parity is read off, bits of all axes interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for axis in range(axes):
            set_here = (x[axis] & top) != 0
            swap = np.where(set_here, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(set_here, low, swap)
            x[axis] ^= swap
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(axes):
            key = key << 1 | (x[axis] >> level & 1)
    return key


class CurveKeys:
    """Hilbert keys of token ids."""

    def __init__(self, seed: int = 29):
        rng = np.random.default_rng(seed)
        self.axis = rng.integers(0, HASHED, 1 << 16)
        self.sign = rng.choice([-1.0, 1.0], 1 << 16)
        self.directions = rng.standard_normal((HASHED, DIMENSIONS))

    def vector(self, ids: np.ndarray) -> np.ndarray:
        low = ids & 0xFFFF
        v = np.bincount(self.axis[low], weights=self.sign[low], minlength=HASHED)
        return np.sign(v) * np.log1p(np.abs(v))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        y = vectors @ self.directions / np.where(norms > 0, norms, 1)
        share = 0.5 * (1 + np.vectorize(math.erf)(y / math.sqrt(2)))
        return hilbert_index(np.minimum((share * (1 << GRID_BITS)).astype(np.int64), (1 << GRID_BITS) - 1), GRID_BITS)


def _tokenised(path: str, end: int):
    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, curve, squeeze = word_ids(path), CurveKeys(), zstandard.ZstdCompressor(level=1)
        stop = np.array([end], encoder.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, vectors, packed = [], [], []
                for text in part.column(1).cast(pa.large_binary()):
                    data = encoder.of(text.as_py() or b"") + stop
                    ids = np.frombuffer(data, encoder.dtype)
                    n.append(len(ids))
                    vectors.append(curve.vector(ids))
                    packed.append(squeeze.compress(data))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(curve.of(np.array(vectors)), pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "key", "n", "ids"])

    return tokenised


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the tokens before each row within its partition, and the partition's number."""
    from pyspark import TaskContext

    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = np.cumsum(n) + before
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - n, pa.int64()), batch.column(1), pa.array(np.full(len(n), part), pa.int32())], ["row", "within", "n", "part"])
        before = int(ends[-1]) if len(n) else before


def _cut(kind: str, length: int):
    """``kind``: the type of the ids as they were packed; the tokenizer itself isn't needed here."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                part = batch.slice(at, 256)
                for doc_id, place, packed in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    ids = np.frombuffer(unpack.decompress(packed.as_py()), kind).astype("<u4")
                    start = 0
                    while start < len(ids):
                        offset = (place + start) % length
                        size = min(length - offset, len(ids) - start)
                        rows.append((doc_id, start, size, zlib.crc32(ids[start : start + size].tobytes()), len(ids), (place + start) // length, offset))
                        start += size
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return cut


def pack_along_curve(docs: DataFrame, tokenizer: str | None = None, length: int = 4096, end: int = 2) -> DataFrame:
    """Packs rows of ``docs`` (doc_id, text) into sequences of ``length`` tokens.

    A document is the ids of its whole text by the tokenizer file (one that drops white space)
    and then ``end``. Returns a row for each piece: doc_id, start (ids of the document before
    it), length, ids_crc32, doc_tokens, sequence_id, offset (there, without gaps). All sequences
    but the last are full. Null and empty texts are the one id ``end``. Repeated rows are packed
    one by one; equal keys go by doc_id. No rows give no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    path = tokenizer or vocabulary_path()
    tokens = docs.select("doc_id", "text").mapInArrow(_tokenised(path, end), "doc_id long, key long, n long, ids binary")
    tokens = table(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")
    lanes = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = tokens.select("row", "n", "key", "doc_id").repartitionByRange(lanes, "key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    placed = table(sorted_rows.select("row", "n").mapInArrow(_running, "row long, within long, n long, part int"), "placed")
    sizes = placed.groupBy("part").agg(F.sum("n").alias("here"))
    before = sizes.select("part", (F.sum("here").over(W.orderBy("part")) - F.col("here")).alias("before"))
    places = table(placed.join(table(before, "before"), "part").select("row", (F.col("before") + F.col("within")).alias("place")), "places")
    joined = tokens.select("row", "doc_id", "ids").join(places, "row").select("doc_id", "place", "ids")
    return joined.mapInArrow(_cut(ids_kind(path), length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
