"""Quality by nearest-neighbour voting in a latent semantic space.

A text is hashed to counts of its words, of their shapes (runs of capitals, small letters,
digits; punctuation as it is) and of pairs of neighbouring shapes. Logarithmic counts with
inverse document frequencies are reduced to a few dimensions by the leading singular vectors of
a bounded labelled sample. The sample's latent vectors are broadcast; each document is compared
with all of them in blocks, exactly, and its nearest vote with their cosine as weight.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import held, held_out
from tidemill.session import ship

#: Bound of the labelled sample, latent dimensions, and neighbours that vote.
SAMPLE_ROWS, LATENT, NEIGHBOURS = 5000, 48, 25
#: Hashed features: shapes, pairs of shapes, words. Each part has length one before weighting.
SHAPES, PAIRS, WORDS = 384, 640, 1024
WIDTH = SHAPES + PAIRS + WORDS
PART_WEIGHTS = (1.0, 1.0, 0.4)

_CLASSES = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def shape(word: bytes) -> bytes:
    return _RUNS.sub(rb"\1", word.translate(_CLASSES))


class WordFeatures(dict):
    """word -> shape number * 65536 + word number; remembers ``room`` words at most."""

    room = 400_000

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(shape(word)) % SHAPES << 16 | zlib.crc32(word.lower().strip(b".,;:!?")) % WORDS
        if len(self) < self.room:
            self[word] = value
        return value

    def counts(self, text: bytes) -> np.ndarray:
        """Counts of WIDTH hashed features of a whole text."""
        words = text.split()
        both = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        shapes, names = both >> 16, both & 0xFFFF
        pairs = (shapes[1:] * 31 + shapes[:-1] * 7 + 1) % (PAIRS - 1) + 1
        if len(both) > 1:  # a word after itself is a feature of its own
            pairs = np.where(both[1:] == both[:-1], 0, pairs)
        return np.concatenate((np.bincount(shapes, minlength=SHAPES), np.bincount(pairs, minlength=PAIRS), np.bincount(names, minlength=WORDS)))


class NeighbourVote:
    """The fitted classifier: small enough to send to every task."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
        x = self.weighted(counts)
        _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        keep = min(LATENT, len(counts), WIDTH)
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :keep], np.float32)
        self.vectors, self.labels = self._unit(x @ self.basis), labels.astype(np.float32)

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts.astype(np.float32)) * self.idf
        at = 0
        for width, weight in zip((SHAPES, PAIRS, WORDS), PART_WEIGHTS):
            part = x[:, at : at + width]
            part *= weight / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
            at += width
        return x

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The similarity-weighted share of label 1 among the nearest labelled vectors; a text
        without features is near to none and has the share of the whole sample."""
        near = self._unit(self.weighted(counts) @ self.basis) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        # Of vectors as near as the last that votes, those first in the sample do.
        last = np.take_along_axis(near, top, axis=1).min(axis=1, keepdims=True)
        for i in np.flatnonzero((near >= last).sum(axis=1) > k):
            top[i] = np.argsort(-near[i], kind="stable")[:k]
        # In float64: the least weight, 1e-48, is zero in float32.
        weights = np.maximum(np.take_along_axis(near, top, axis=1).astype(np.float64), 1e-6) ** 8
        voted = np.clip((weights * self.labels[top]).sum(axis=1) / weights.sum(axis=1), 0, 1)
        return np.where(counts.any(axis=1), voted, self.labels.mean(dtype=np.float64))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = held("features", WordFeatures)
    for batch in batches:
        packed = [zlib.compress(np.minimum(features.counts(t.as_py() or b""), 2**32 - 1).astype("<u4").tobytes(), 1) for t in batch.column(2).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "quality", "counts"])


def fit_quality(docs: DataFrame, labels: DataFrame) -> NeighbourVote | None:
    """Fits on ``docs`` (doc_id, text) that have a quality in ``labels``, SAMPLE_ROWS of them at most.

    Held-out documents (crc32(doc_id as text) mod 5 is 0) teach nothing. Rows are sampled by a hash
    of doc_id. None if no labelled row is left.
    """
    ship(docs.sparkSession)
    usable = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE_ROWS)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("long").alias("quality"), "text")
    found = joined.mapInArrow(_sample_features, "doc_id long, quality long, counts binary")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "counts").limit(SAMPLE_ROWS).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.quality, bytes(r.counts)))
    counts = np.array([np.frombuffer(zlib.decompress(r.counts), "<u4") for r in rows])
    return NeighbourVote(counts, np.array([r.quality for r in rows]))


def _score(model: NeighbourVote | None, kept: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = held("features", WordFeatures)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if model is None:
                    got = np.full(part.num_rows, 0.5)
                else:
                    got = model.scores(np.array([features.counts(t.as_py() or b"") for t in part.column(1).cast(pa.large_binary())]))
                columns = [part.column(part.schema.get_field_index(name)) for name in kept]
                yield pa.RecordBatch.from_arrays([pa.array(got.astype(np.float64)), *columns], ["score", *kept])

    return score


def score_quality(docs: DataFrame, model: NeighbourVote | None, threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores each whole text of ``docs`` (doc_id, text).

    Returns doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on) and the columns of
    ``keep``, which may name text. Texts that are null, empty or white space have no features and
    are scored by the sample's share of label 1; without a model all scores are 0.5. Of equally near
    neighbours the first in the sample, which is sorted by doc_id, vote. Repeated rows are scored
    one by one. No rows give no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    keep = tuple(c for c in keep if c != "doc_id")
    rows = docs.select(*dict.fromkeys(["doc_id", "text", *keep]))
    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    found = rows.mapInArrow(_score(model, ["doc_id", *keep]), f"score double{kinds}")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *keep)
