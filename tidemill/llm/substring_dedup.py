"""Substring dedup: repeated windows of words, found by Rabin-Karp hashes.

The corpus is cut into chunks that are ranges of doc_id, so that a chunk of a lower number
holds only earlier documents. A chunk rolls the hash of every window over its texts and sends
the distinct ones, sorted and packed to about six bytes each, to the buckets of their leading
bits. A bucket counts each hash over the chunks and answers each chunk with one bit per hash:
does it occur in an earlier chunk? The chunk then knows, for each of its windows, whether the
same words start earlier there or in itself, and merges the windows that repeat into maximal
intervals of words to remove.

A hash that a third of all documents share costs each chunk one entry, and no hash is ever
looked up outside its bucket. The text is shuffled once: both passes read the same exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import WordHashes, held, packed_sorted, rolled, unpacked_sorted
from tidemill.session import ship

#: Text bytes that a chunk holds on average.
CHUNK_BYTES = 10_000_000
#: Windows that a bucket holds on average, at six text bytes a window.
BUCKET_WINDOWS = 2_000_000


class Chunk:
    """The windows of some documents in the order of (doc_id, position)."""

    def __init__(self, group: pa.Table, window: int, hashes: WordHashes):
        ids = group.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
        self.doc_id = [ids[i] for i in order]
        text = group.column("text").cast(pa.large_binary())
        self.words = [(text[i].as_py() or b"").split() for i in order]
        parts = [rolled(hashes.of(w), window) for w in self.words]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.distinct, self.back = np.unique(flat, return_inverse=True)
        # A window starts earlier in this chunk unless it is at its hash's first place.
        # Rows that share a doc_id count as the same document: equal places don't differ.
        doc = np.cumsum([i == 0 or self.doc_id[i] != self.doc_id[i - 1] for i in range(len(ids))]) if ids else np.empty(0)
        start = np.concatenate([np.arange(s) for s in self.sizes]) if parts else np.empty(0, np.int64)
        place = np.repeat(np.asarray(doc, np.int64), self.sizes) << 40 | start
        first = np.full(len(self.distinct), np.iinfo(np.int64).max)
        np.minimum.at(first, self.back, place)
        self.later = place > first[self.back]

    def intervals(self, earlier: np.ndarray, window: int):
        """Per document: (doc_id, words, [(start, end)] to remove), given which distinct hashes an earlier chunk has."""
        repeated = self.later | earlier[self.back] if len(self.back) else self.later
        at = 0
        for doc_id, words, size in zip(self.doc_id, self.words, self.sizes):
            starts = np.flatnonzero(repeated[at : at + size])
            at += size
            spans = []
            if len(starts):
                breaks = np.flatnonzero(np.diff(starts) > window)
                heads, tails = starts[np.append(0, breaks + 1)], starts[np.append(breaks, len(starts) - 1)] + window
                spans = list(zip(heads.tolist(), tails.tolist()))
            yield doc_id, words, spans


def _chunk_udf(bounds: list[int]):
    edges = np.array(bounds, np.int64)

    def chunk(doc_id: pa.Array) -> pa.Array:
        ids = doc_id.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(edges, ids, side="right").astype(np.int32))

    return F.arrow_udf(chunk, "int")


def _blocks(window: int, bits: int):
    def blocks(group: pa.Table) -> pa.Table:
        chunk = Chunk(group, window, held("hashes", WordHashes))
        lead = (chunk.distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(chunk.distinct), np.int64)
        edges = np.append(np.flatnonzero(np.diff(lead, prepend=-1)), len(lead)) if len(lead) else np.zeros(1, np.int64)
        return pa.table(
            {
                "bucket": pa.array(lead[edges[:-1]], pa.int64()),
                "chunk": pa.array(np.full(len(edges) - 1, group.column("chunk")[0].as_py()), pa.int32()),
                "hashes": pa.array([packed_sorted(chunk.distinct[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
            }
        )

    return blocks


def _answers(group: pa.Table) -> pa.Table:
    chunks = group.column("chunk").to_numpy()
    parts = [unpacked_sorted(x.as_py()) for x in group.column("hashes")]
    sizes = np.array([len(p) for p in parts])
    flat = np.concatenate(parts)
    distinct, back = np.unique(flat, return_inverse=True)
    where = np.repeat(chunks.astype(np.int64), sizes)
    first = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(first, back, where)
    earlier = first[back] < where
    edges = np.append(0, np.cumsum(sizes))
    return pa.table(
        {
            "bucket": group.column("bucket"),
            "chunk": group.column("chunk"),
            "n": pa.array(sizes, pa.int64()),
            "earlier": pa.array([np.packbits(earlier[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
        }
    )


def _removal(window: int, digest: bool):
    def removal(group: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(group, window, held("hashes", WordHashes))
        rows = sorted(answers.select(["bucket", "n", "earlier"]).to_pylist(), key=lambda r: r["bucket"])
        bits = [np.unpackbits(np.frombuffer(r["earlier"], np.uint8), count=r["n"]) for r in rows]
        earlier = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
        out: list[tuple] = []
        for doc_id, words, spans in chunk.intervals(earlier, window):
            kept, at = [], 0
            for a, b in spans:
                kept += words[at:a]
                at = b
            kept += words[at:]
            body = b" ".join(kept)
            out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest() if digest else body.decode(), [{"start": a, "end": b} for a, b in spans]))
        columns = list(zip(*out)) if out else [[]] * 5
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table(
            {
                "doc_id": pa.array(columns[0], pa.int64()),
                "n_words": pa.array(columns[1], pa.int64()),
                "n_removed": pa.array(columns[2], pa.int64()),
                "kept_sha256" if digest else "kept_text": pa.array(columns[3], pa.string()),
                "removed": pa.array(columns[4], spans_type),
            }
        )

    return removal


def substring_dedup(docs: DataFrame, window: int = 20, digest: bool = False) -> DataFrame:
    """Removes from ``docs`` (doc_id, text) each word that a repeated window covers.

    A window is ``window`` consecutive words (runs without ASCII white space) of one document;
    it repeats if its words also start in a document of smaller doc_id or earlier in its own.
    Windows are judged on the input. Returns doc_id, n_words, n_removed, removed (maximal
    intervals of word positions) and kept_text, the kept words joined by one space, or with
    ``digest`` its SHA-256 as kept_sha256.

    Null and empty texts, and those shorter than a window, lose nothing. A null doc_id sorts
    before all others. Rows that share a doc_id count as one document: a window at the same
    place of two of them doesn't repeat. No rows give no rows; other columns are ignored.
    Windows are equal when their 64-bit hashes are.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // CHUNK_BYTES))
    bits = max(0, int(np.ceil(np.log2(max(1, total / 6 / BUCKET_WINDOWS)))))
    bounds = []
    if chunks > 1:
        cuts = [i / chunks for i in range(1, chunks)]
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", cuts, max(10_000, 4 * chunks))).first()[0]))
    dealt = docs.withColumn("chunk", _chunk_udf(bounds)("doc_id"))
    answers = dealt.groupBy("chunk").applyInArrow(_blocks(window, bits), "bucket long, chunk int, hashes binary").groupBy("bucket").applyInArrow(_answers, "bucket long, chunk int, n long, earlier binary")
    kept = "kept_sha256" if digest else "kept_text"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_removal(window, digest), f"doc_id long, n_words long, n_removed long, {kept} string, removed array<struct<start:int,end:int>>")
