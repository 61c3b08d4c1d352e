"""A quality classifier on supervised subword embeddings, trained in numpy and applied by Spark.

Words and character n-grams are hashed to a fixed number of vectors; a document is the mean
of its vectors and goes through a softmax. Training is plain stochastic gradient descent on
a bounded sample of labelled rows. For scoring, each vector is folded with the output layer
to one number, so a document costs one table look-up per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featshift.llm.arrays import RollingHash, flat, segment_sums, slices, word_spans

BITS = 16
NGRAMS = (3, 4)
#: Most labelled rows used for training, taken by the hash of their id.
SAMPLE_ROWS = 3000
#: Text whose features are held at once.
SLICE_BYTES = 1 << 20


def _ngrams(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the ``n`` bytes from each position on (the last ``n - 1`` are missing)."""
    m = max(len(data) - n + 1, 0)
    key = np.full(m, n, dtype=np.uint32)
    for i in range(n):
        key = key * np.uint32(0x01000193) ^ data[i : i + m]
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x85EBCA6B)
    return key >> np.uint32(32 - bits)


def features(data: np.ndarray, bounds: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kinds of features in turn: bucket of each, and the index of each row's first.

    Words (after a repeat of the same word, one fixed bucket instead), byte n-grams that stay
    inside the row, and one constant feature per row, so that empty rows have a score too.
    """
    starts, ends, firsts = word_spans(data, bounds)
    words = RollingHash(data).ranges(starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
    buckets = (words >> np.uint64(64 - bits)).astype(np.int64)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = words[1:] == words[:-1]
    again[firsts[:-1][firsts[:-1] < len(words)]] = False
    buckets[again] = 0
    yield buckets, firsts
    for n in NGRAMS:
        found = _ngrams(data, n, bits)
        inside = np.ones(len(found), dtype=bool)
        for back in range(1, n):
            cut = bounds[1:-1] - back
            cut = cut[(cut >= 0) & (cut < len(found))]
            inside[cut] = False
        places = np.concatenate(([0], np.cumsum(inside)))
        yield found[inside], places[np.minimum(bounds, len(found))]
    rows = len(bounds) - 1
    yield np.ones(rows, dtype=np.int64), np.arange(rows + 1)


@dataclass(frozen=True)
class QualityModel:
    """One number per bucket: its vector times the difference of the two output vectors."""

    table: np.ndarray

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        bits = len(self.table).bit_length() - 1
        total, count = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1, dtype=np.int64)
        for buckets, firsts in features(data, bounds, bits):
            total += segment_sums(self.table[buckets].astype(np.float64), firsts)
            count += np.diff(firsts)
        return 1 / (1 + np.exp(-np.clip(total / count, -700, 700)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, dim: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> QualityModel:
    """Fit ``(label, buckets, counts)`` rows."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, size=(1 << bits, dim))
    output = np.zeros((2, dim))
    steps = epochs * len(rows)
    for step, k in enumerate(np.concatenate([rng.permutation(len(rows)) for _ in range(epochs)]) if rows else []):
        label, buckets, counts = rows[k]
        weights = counts / counts.sum()
        now = rate * (1 - step / steps)
        hidden = weights @ vectors[buckets]
        logits = output @ hidden
        p = np.exp(logits - logits.max())
        error = p / p.sum()
        error[label] -= 1
        pull = error @ output
        output -= now * np.outer(error, hidden)
        # A mean spreads the gradient over its members; it is scaled up by their number as the mean is small.
        vectors[buckets] -= now * len(buckets) * np.outer(weights, pull) / max(1.0, np.sqrt(len(buckets)))
    return QualityModel((vectors @ (output[1] - output[0])).astype(np.float32))


def held_out(doc_id: str = "doc_id", fold: int = 2, folds: int = 4):
    """Whether a row is kept from training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == fold


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Train on at most ``sample_rows`` labelled rows that are not held out.

    The sample is the smallest hashes of the ids, so it does not depend on partitions. Rows
    with a null id or label teach nothing; of repeated labels the larger mean side counts.
    Only the sample is collected, as bucket counts.
    """
    wanted = (
        labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id))
        .groupBy(F.col(doc_id).alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(wanted), "doc_id").dropDuplicates(["doc_id"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            data, bounds = flat(batch.column("text"))
            kinds = list(features(data, bounds))
            made = [np.unique(np.concatenate([b[f[i] : f[i + 1]] for b, f in kinds]), return_counts=True) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("label"), *(pa.array([m[k].astype(np.int32).tobytes() for m in made], pa.binary()) for k in (0, 1))],
                names=["doc_id", "label", "buckets", "counts"],
            )

    found = chosen.mapInArrow(task, "doc_id string, label int, buckets binary, counts binary").toArrow()
    ids, labelled = found.column("doc_id").to_pylist(), found.column("label").to_pylist()
    # Counts stay in the Arrow buffers that they came in.
    buckets, counts = ([np.frombuffer(x.as_buffer(), dtype=np.int32) for x in found.column(c)] for c in ("buckets", "counts"))
    return train([(labelled[k], buckets[k], counts[k]) for k in sorted(range(len(ids)), key=ids.__getitem__)])


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", score: str = "score", probability_from: float = 0.7, predicted: str = "predicted") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``probability_from`` on) to every row.

    Null and empty texts are scored by the constant feature alone. Columns with the names
    of the results are replaced, others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.table)  # 2^16 numbers, whatever the input

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = QualityModel(shared.value)
        for array in texts:
            batch = pa.record_batch([array], names=["text"])
            found = [fitted.score(*flat(part.column(0))) for part in slices(iter([batch]), "text", SLICE_BYTES)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (score, predicted)]
    found = docs.select(*kept, scored(F.col(text).cast("string")).alias(score))
    return found.withColumn(predicted, (F.col(score) >= probability_from).cast("int"))
