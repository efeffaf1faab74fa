"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on all windows of the whole texts
of a bounded sample of labelled rows, and labels every byte position. A document is read whole, in windows of
WINDOW bytes; its probabilities are the mean over all its positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.common import held_out
from tidemill.session import ship

HIDDEN, WINDOW, LANES = 12, 128, 2048
#: Bounds of the training sample: labelled rows a language, and bytes of their texts together. Rows
#: are taken whole or not at all; texts are learned from in windows of CROP bytes.
SAMPLE_DOCS, SAMPLE_BYTES, CROP = 400, 1_500_000, 48
#: Least number of training steps, and windows a step.
STEPS, BATCH = 300, 256
LETTER = r"\p{L}"


class GatedDirection:
    """One direction: h' = n + z (h - n), n = tanh(xn + r (h Un)), with gates z and r."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.table = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)  # input weights and biases of each byte
        self.inner = rng.normal(0, 0.6 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)

    def states(self, steps: np.ndarray, keep: list) -> np.ndarray:
        """Hidden states (time, batch, hidden) for bytes (time, batch); ``keep`` gets what BPTT needs."""
        hidden, size = self.h, steps.shape[1]
        h = np.zeros((size, hidden), self.table.dtype)
        out = np.empty((len(steps), size, hidden), self.table.dtype)
        for t, byte in enumerate(steps):
            fresh = self.table[byte]
            from_h = h @ self.inner
            gates = 0.5 + 0.5 * np.tanh(0.5 * (fresh[:, : 2 * hidden] + from_h[:, : 2 * hidden]))
            z, r = gates[:, :hidden], gates[:, hidden:]
            n = np.tanh(fresh[:, 2 * hidden :] + r * from_h[:, 2 * hidden :])
            keep.append((h, z, r, n, from_h[:, 2 * hidden :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def fast_states(self, steps: np.ndarray) -> np.ndarray:
        """As ``states``, but (time, hidden, batch): one row a unit, in place, with the halves of
        the gates' tanh form folded into the weights."""
        hidden, size = self.h, steps.shape[1]
        scale = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), hidden)[:, None]
        table = np.ascontiguousarray(self.table.T, np.float32) * scale
        inner = np.ascontiguousarray(self.inner.T, np.float32) * np.float32(0.5)
        fresh, from_h = (np.empty((3 * hidden, size), np.float32) for _ in range(2))
        gates, z, r = fresh[: 2 * hidden], fresh[:hidden], fresh[hidden : 2 * hidden]
        n, h = from_h[2 * hidden :], np.zeros((hidden, size), np.float32)
        out = np.empty((len(steps), hidden, size), np.float32)
        for t, byte in enumerate(steps):
            np.take(table, byte, axis=1, out=fresh, mode="clip")
            np.matmul(inner, h, out=from_h)
            gates += from_h[: 2 * hidden]
            np.tanh(gates, out=gates)
            r += 1
            n *= r
            n += fresh[2 * hidden :]
            np.tanh(n, out=n)
            z += 1
            z *= 0.5
            h -= n
            h *= z
            h += n
            out[t] = h
        return out

    def gradients(self, steps: np.ndarray, keep: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of table and inner, by backpropagation through time."""
        hidden = self.h
        d_inner, d_all = np.zeros_like(self.inner), np.empty((*steps.shape, 3 * hidden), self.table.dtype)
        d_h = np.zeros_like(keep[0][0])
        for t in range(len(steps) - 1, -1, -1):
            h, z, r, n, hu = keep[t]
            d_h = d_h + d_out[t]
            d_n = d_h * (1 - z) * (1 - n * n)
            d_z = d_h * (h - n) * z * (1 - z)
            d_r = d_n * hu * r * (1 - r)
            d_all[t] = np.concatenate((d_z, d_r, d_n), axis=1)
            d_from_h = np.concatenate((d_z, d_r, d_n * r), axis=1)
            d_inner += h.T @ d_from_h
            d_h = d_h * z + d_from_h @ self.inner.T
        bytes_seen, flat = steps.ravel(), d_all.reshape(-1, 3 * hidden)
        d_table = np.stack([np.bincount(bytes_seen, weights=flat[:, k], minlength=256) for k in range(3 * hidden)], axis=1)
        return d_table.astype(self.table.dtype), d_inner


class ByteTagger:
    """The network: both directions and a softmax over languages at every position."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.ahead, self.back = GatedDirection(hidden, rng), GatedDirection(hidden, rng)
        self.out = rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.inner, self.back.table, self.back.inner, self.out, self.bias]

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def loss_gradients(self, steps: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions of (time, batch) bytes, and its gradients."""
        kept_a: list = []
        kept_b: list = []
        mirrored = steps[::-1]
        both = np.concatenate((self.ahead.states(steps, kept_a), self.back.states(mirrored, kept_b)[::-1]), axis=2)
        probs = self._softmax(both @ self.out + self.bias)
        at = (slice(None), np.arange(len(labels)), labels)
        loss = float(-np.log(np.maximum(probs[at], 1e-9)).mean())
        d = probs.copy()
        d[at] -= 1
        d /= probs.shape[0] * probs.shape[1]
        width = self.ahead.h
        d_both = d @ self.out.T
        d_out = np.einsum("tbh,tbk->hk", both, d, optimize=True)
        ga = self.ahead.gradients(steps, kept_a, d_both[:, :, :width])
        gb = self.back.gradients(mirrored, kept_b, d_both[::-1, :, width:])
        return loss, [*ga, *gb, d_out, d.sum(axis=(0, 1))]

    def train(self, crops: np.ndarray, labels: np.ndarray, steps: int = STEPS, rate: float = 0.02, seed: int = 6) -> None:
        """Adam on random batches of crops (rows of bytes) with as many of each language: ``steps``
        of them, or what it takes to see each crop once. No crop is seen again before all of its
        language are."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero(labels == k) for k in range(len(self.langs))]
        share = max(1, BATCH // len(of))
        steps = max(steps, -(-max(map(len, of)) // share))
        turns = [np.concatenate([rng.permutation(rows) for _ in range(-(-steps * share // len(rows)))]) for rows in of]
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        for step in range(1, steps + 1):
            pick = np.concatenate([turn[(step - 1) * share : step * share] for turn in turns])
            _, grads = self.loss_gradients(np.ascontiguousarray(crops[pick].T), labels[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            lower = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, m, v in zip(self.parameters(), grads, first, second):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (lower * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def position_sums(self, windows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sums over positions of the probabilities of windows (batch, time): the first ``counts``
        positions, or the last -``counts``."""
        steps = np.ascontiguousarray(windows.T).astype(np.intp)
        width = self.ahead.h
        logits = self.out[:width].T.astype(np.float32) @ self.ahead.fast_states(steps)
        logits += (self.out[width:].T.astype(np.float32) @ self.back.fast_states(steps[::-1]))[::-1]
        logits += self.bias[:, None].astype(np.float32)
        np.exp(np.minimum(logits, 60, out=logits), out=logits)
        logits /= logits.sum(axis=1, keepdims=True) + np.float32(1e-30)
        time = np.arange(len(steps))[:, None]
        if (counts != len(steps)).any():
            logits *= np.where(counts > 0, time < counts, time >= len(steps) + counts)[:, None, :]
        return logits.sum(axis=0).T

    def pooled(self, docs: list[bytes]) -> np.ndarray:
        """Mean position probabilities of each document (zeros for empty ones).

        What is left over after the full windows is read in the last WINDOW bytes, and a shorter
        document in a window that repeats it; only its own positions count, each once.
        """
        sums = np.zeros((len(docs), len(self.langs)))
        parts, owners, counts = [], [], []
        for i, raw in enumerate(docs):
            data = np.frombuffer(raw, np.uint8)
            full, rest = divmod(len(data), WINDOW)
            if full:
                parts.append(data[: full * WINDOW].reshape(full, WINDOW))
                owners += [i] * full
                counts += [WINDOW] * full
            if rest:
                last = data[-WINDOW:] if full else np.frombuffer((raw + b" ") * (WINDOW // len(raw) + 1), np.uint8)[:WINDOW]
                parts.append(last.reshape(1, WINDOW))
                owners.append(i)
                counts.append(-rest if full else rest)
        if parts:
            windows, owner, count = np.concatenate(parts), np.array(owners), np.array(counts)
            for at in range(0, len(windows), LANES):
                got = self.position_sums(windows[at : at + LANES], count[at : at + LANES])
                np.add.at(sums, owner[at : at + LANES], got)
        return sums / np.maximum(1, [len(d) for d in docs])[:, None]


def crops(text: bytes) -> np.ndarray:
    """All windows of CROP bytes of a text, side by side; the last ends with the text, and a text
    that is shorter repeats."""
    if len(text) < CROP:
        text = ((text + b" ") * (CROP // len(text) + 1))[:CROP]
    starts = np.minimum(np.arange(0, len(text), CROP), len(text) - CROP)
    return np.frombuffer(text, np.uint8)[starts[:, None] + np.arange(CROP)]


def training_sample(docs: DataFrame) -> DataFrame:
    """(lang, text) of at most SAMPLE_DOCS rows and SAMPLE_BYTES a language, texts as bytes.

    Rows go by a hash of doc_id and text; rows that repeat both count once. A hash below a limit
    chooses first, twice as many rows as are needed, from the number that each language has, so
    that no task orders a language's rows: what is ordered is as bounded as the sample.
    """
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    usable = usable.select("lang", F.xxhash64("doc_id", "text").alias("h"), F.encode("text", "utf-8").alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row for each language
    if not sizes:
        return usable.select("lang", "text").limit(0)
    limits = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, int(min(1.0, 2 * SAMPLE_DOCS / r.n) * 2**62))])
    some = usable.filter(F.shiftrightunsigned("h", 2) <= limits[F.col("lang")])
    once = some.groupBy("lang", "h").agg(F.first("text").alias("text"))
    order = W.partitionBy("lang").orderBy("h")
    held = F.sum(F.octet_length("text")).over(order.rowsBetween(W.unboundedPreceding, 0))
    ranked = once.withColumn("at", F.row_number().over(order)).withColumn("held", held)
    return ranked.filter((F.col("at") <= SAMPLE_DOCS) & (F.col("held") <= SAMPLE_BYTES)).select("lang", "text")


def train_tagger(docs: DataFrame) -> ByteTagger | None:
    """Learns from text and lang of ``docs`` (doc_id, text, lang), of the rows of ``training_sample``.

    Held-out documents (crc32(doc_id as text) mod 5 is 0), null langs and texts without letters
    teach nothing, and neither do texts of more than SAMPLE_BYTES. None if nothing is left to
    learn from.
    """
    ship(docs.sparkSession)
    rows = sorted((r.lang, bytes(r.text)) for r in training_sample(docs).collect())
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    windows = [crops(text) for _, text in rows]
    labels = np.repeat([langs.index(lang) for lang, _ in rows], [len(w) for w in windows])
    tagger = ByteTagger(langs)
    tagger.train(np.concatenate(windows), labels)
    return tagger


def _predict(tagger: ByteTagger | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [t.as_py() or "" for t in part.column(1)]
                lettered = [bool(x) for x in part.column(2).to_pylist()]
                if tagger is None:
                    lang, score = ["und"] * len(raw), [0.0] * len(raw)
                else:
                    probs = tagger.pooled([t.encode() if ok else b"" for t, ok in zip(raw, lettered)])
                    lang = [tagger.langs[k] if ok else "und" for k, ok in zip(probs.argmax(axis=1), lettered)]
                    score = [float(min(1.0, p)) if ok else 0.0 for p, ok in zip(probs.max(axis=1), lettered)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return predict


def predict_language(docs: DataFrame, tagger: ByteTagger | None) -> DataFrame:
    """The language of each whole text of ``docs`` (doc_id, text).

    Returns doc_id, held_out, lang_pred, score (mean position probability of that language; of
    equal ones the first by name). A text that is null or has no letter (Unicode category L) is
    ``und`` with score 0, as are all without a tagger. Very long texts are read whole, LANES windows at a time.
    Repeated rows are labelled one by one. No rows give no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    found = docs.select("doc_id", "text", F.col("text").rlike(LETTER).alias("lettered")).mapInArrow(_predict(tagger), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
