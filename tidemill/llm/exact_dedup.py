"""Exact dedup with counting quotient filters.

Each partition of the corpus builds a filter over 64-bit fingerprints of its normalised
texts. A filter covers one block (the leading bits of the fingerprint); the next bits are
the quotient and the rest the remainder. Remainders of one quotient form a sorted run in
the slot table, each slot with its count, under an occupied and a run-end bit vector, so
the fingerprints and their counts can be read back whole. Filters of one block from all
partitions merge by their sorted remainders, without loss. Fingerprints whose merged count
is above one route their documents to byte verification, which groups by the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.session import ship, table

WHITE = r"[\x20\x09-\x0D]+"
#: Fingerprints that a merged block holds on average; the number of blocks follows from it.
BLOCK_ROOM = 250_000


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


class QuotientFilter:
    """A counting quotient filter of the fingerprints that share their leading ``block_bits``."""

    def __init__(self, block_bits: int, quotient_bits: int, occupied: np.ndarray, run_end: np.ndarray, slots: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.block_bits, self.quotient_bits = block_bits, quotient_bits
        self.occupied, self.run_end, self.slots = occupied, run_end, slots
        self.remainders, self.counts = remainders, counts

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray, block_bits: int) -> QuotientFilter:
        """From sorted distinct fingerprints of one block and their counts."""
        n = len(prints)
        quotient_bits = max(1, int(np.ceil(np.log2(n / 0.75 + 1))))
        inner = prints << np.uint64(block_bits) if block_bits else prints
        quotients = (inner >> np.uint64(64 - quotient_bits)).astype(np.int64)
        keep = 64 - block_bits - quotient_bits
        remainders = prints & np.uint64((1 << keep) - 1)
        order = np.arange(n)
        slots = order + np.maximum.accumulate(quotients - order)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotients] = True
        last = np.append(quotients[1:] != quotients[:-1], True)
        run_end = np.zeros(int(slots[-1]) + 1, bool)
        run_end[slots[last]] = True
        return cls(block_bits, quotient_bits, occupied, run_end, slots, remainders, counts)

    def entries(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints, sorted, and their counts: what ``build`` was given."""
        run = np.concatenate(([0], np.cumsum(self.run_end[self.slots])[:-1]))
        quotients = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        keep = 64 - self.block_bits - self.quotient_bits
        lead = np.uint64(block << (64 - self.block_bits)) if self.block_bits else np.uint64(0)
        return lead | quotients << np.uint64(keep) | self.remainders, self.counts

    def to_bytes(self) -> bytes:
        used = np.zeros(len(self.run_end), bool)
        used[self.slots] = True
        width = (64 - self.block_bits - self.quotient_bits + 7) // 8
        low = np.ascontiguousarray(self.remainders.view(np.uint8).reshape(-1, 8)[:, :width])
        many = self.counts > 1
        head = np.array([self.block_bits, self.quotient_bits, len(self.run_end), len(self.remainders), many.sum()], np.int64)
        return b"".join(x.tobytes() for x in (head, np.packbits(self.occupied), np.packbits(used), np.packbits(self.run_end), low, np.packbits(many), self.counts[many].astype(np.int64)))

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        block_bits, quotient_bits, slots, n, many = (int(x) for x in np.frombuffer(data, np.int64, 5))
        at = 40

        def bits(size: int) -> np.ndarray:
            nonlocal at
            wide = (size + 7) // 8
            out = np.unpackbits(np.frombuffer(data, np.uint8, wide, at), count=size).astype(bool)
            at += wide
            return out

        occupied, used, run_end = bits(1 << quotient_bits), bits(slots), bits(slots)
        width = (64 - block_bits - quotient_bits + 7) // 8
        low = np.zeros((n, 8), np.uint8)
        low[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        which, counts = bits(n), np.ones(n, np.int64)
        counts[which] = np.frombuffer(data, np.int64, many, at)
        return cls(block_bits, quotient_bits, occupied, run_end, np.flatnonzero(used), low.view(np.uint64).ravel(), counts)

    @classmethod
    def merge(cls, filters: list[QuotientFilter], block: int) -> QuotientFilter:
        """One filter with the summed counts of all; nothing is lost."""
        parts = [f.entries(block) for f in filters]
        prints, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        counts = np.zeros(len(prints), np.int64)
        np.add.at(counts, back, np.concatenate([c for _, c in parts]))
        return cls.build(prints, counts, filters[0].block_bits)


def _filters(block_bits: int):
    """Of a partition: (block, filter) rows. A partition is gathered as 8 bytes a row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        if not got:
            return
        prints, counts = np.unique(np.concatenate(got), return_counts=True)
        if not len(prints):
            return
        blocks = (prints >> np.uint64(64 - block_bits)).astype(np.int64) if block_bits else np.zeros(len(prints), np.int64)
        edges = np.append(np.flatnonzero(np.diff(blocks, prepend=-1)), len(prints))
        for a, b in zip(edges[:-1], edges[1:]):
            data = QuotientFilter.build(prints[a:b], counts[a:b], block_bits).to_bytes()
            yield pa.RecordBatch.from_arrays([pa.array([blocks[a]], pa.int64()), pa.array([data], pa.binary())], ["block", "filter"])

    return build


def _repeated(group: pa.Table) -> pa.Table:
    block = group.column("block")[0].as_py()
    merged = QuotientFilter.merge([QuotientFilter.from_bytes(x.as_py()) for x in group.column("filter")], block)
    prints, counts = merged.entries(block)
    more = counts > 1
    return pa.table({"fp": pa.array(prints[more].view(np.int64)), "n": pa.array(counts[more])})


def repeated_prints(prints: DataFrame, rows: int) -> DataFrame:
    """(fp, n): the fingerprints of the one column of ``prints`` that occur more than once."""
    bits = max(0, int(np.ceil(np.log2(max(1, rows / BLOCK_ROOM)))))
    parts = prints.mapInArrow(_filters(bits), "block long, filter binary")
    return parts.groupBy("block").applyInArrow(_repeated, "fp long, n long")


def exact_dedup(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Groups rows of ``docs`` (doc_id, text) by identical normalised text.

    Returns doc_id, keep_id (smallest doc_id of the group), group_size, kept, text_sha256 and
    the columns of ``keep``.
    A null text counts as empty, so null and empty texts form one group. Of rows that share
    the smallest doc_id one is kept. A null doc_id sorts before all others. No rows give no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    text = normalised(F.col("text"))
    narrow = table(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("t"), *keep).select("row", "doc_id", F.xxhash64("t").alias("fp"), F.unhex(F.sha2("t", 256)).alias("sha"), *keep),
        "prints",
    )
    repeated = table(repeated_prints(narrow.select("fp"), narrow.count()).select("fp"), "repeated")
    # Byte verification: the group key is the text itself, and copies collapse before the shuffle.
    verified = (
        docs.select("doc_id", text.alias("t"))
        .withColumn("fp", F.xxhash64("t"))
        .join(repeated, "fp", "left_semi")
        .groupBy("t")
        .agg(F.count(F.lit(1)).alias("group_size"))
        .select(F.unhex(F.sha2("t", 256)).alias("sha"), "group_size")
    )
    verified = table(verified, "verified")
    first = narrow.join(repeated, "fp", "left_semi").groupBy("sha").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    groups = verified.join(first, "sha")
    found = narrow.alias("d").join(table(groups, "groups").alias("g"), "sha", "left")
    return found.select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first").isNull() | (F.col("first.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *keep,
    )
