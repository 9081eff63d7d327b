"""Quality classifier: learned vectors of hashed word and character n-grams, averaged per document, softmax on top."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zocalo.llm.frames import exact, id_remainder, unit_hash
from zocalo.llm.grams import histograms

#: Buckets (as a power of two), lengths of character grams, width of the vectors.
BITS, ORDERS, WIDTH = 14, (1, 2, 3), 8
#: About how many labelled documents the classifier is fitted on, and how often it goes through them.
TRAIN_ROWS, EPOCHS = 3000, 12
#: Fixed factor between the average and the softmax layer, which sets how fast the layer learns.
SCALE = 5.0
#: Longest text, in characters, that the classifier is fitted on, so that the driver holds a bounded matrix. Scoring takes whole texts.
TRAIN_CHARS = 1 << 18
KEEP_AT = 0.7

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def weigh(counts: np.ndarray) -> np.ndarray:
    """Weights of a document's grams in its average; they add up to 1. Roots make a gram's repeats count less."""
    roots = np.sqrt(counts)
    return roots / np.maximum(roots.sum(1, keepdims=True), 1.0)


@dataclass(frozen=True)
class Classifier:
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        z = SCALE * (weigh(counts) @ self.vectors) @ self.weights + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int = 2, bits: int = BITS, width: int = WIDTH, epochs: int = EPOCHS,
        batch: int = 32, rate: float = 0.1, seed: int = 0) -> Classifier:
    """Stochastic gradient descent (per-weight step sizes) over (buckets, counts, label) rows; no rows give even odds."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (1 << bits, width)).astype(np.float32)
    weights = rng.normal(0, 0.1, (width, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    seen_v, seen_w = np.full(vectors.shape, 1e-6, np.float32), np.full(weights.shape, 1e-6, np.float32)
    labels = np.array([label for _, _, label in rows], np.int64)
    for _ in range(epochs if rows else 0):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            chosen = order[a:a + batch]
            x = np.zeros((len(chosen), 1 << bits), np.float32)
            for line, i in zip(x, chosen):
                line[rows[i][0]] = rows[i][1]
            x = weigh(x)
            hidden = SCALE * (x @ vectors)
            z = hidden @ weights + bias
            z = np.exp(z - z.max(1, keepdims=True))
            error = z / z.sum(1, keepdims=True)
            error[np.arange(len(chosen)), labels[chosen]] -= 1
            error /= len(chosen)
            step_w, step_v = hidden.T @ error, x.T @ (SCALE * error @ weights.T)
            seen_w += step_w ** 2
            seen_v += step_v ** 2
            weights -= rate * step_w / np.sqrt(seen_w)
            vectors -= rate * step_v / np.sqrt(seen_v)
            bias -= 5 * rate * error.sum(0)
    return Classifier(vectors, weights, bias)


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Grams of about ``train_rows`` labelled documents outside the held-out part, in a fixed order.

    The sample is every labelled id whose hash falls below a threshold, so it depends on the ids alone.
    """
    marked = (exact(labels, label_id="doc_id", label="quality").where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull())
              .where(id_remainder(F.col("label_id"), 4) != 2))
    share = min(1.0, train_rows / max(marked.count(), 1))
    marked = marked.where(unit_hash(F.col("label_id"), seed=4) < share)
    texts = (exact(docs, doc_id="doc_id", text="text").where(unit_hash(F.col("doc_id"), seed=4) < share)
             .where((id_remainder(F.col("doc_id"), 4) != 2) & (F.length("text") <= train_chars))
             .join(marked, F.col("doc_id") == F.col("label_id")).select("doc_id", "label", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = (line for table in histograms((t.as_py() for t in b.column(2)), ORDERS, BITS, words=True) for line in table)
            for doc_id, label, line in zip(b.column(0), b.column(1), counts):
                at = np.flatnonzero(line)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id.as_py()], pa.int64()), pa.array([label.as_py()], pa.int32()),
                     pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([line[at].astype("<f4").tobytes()], pa.binary())],
                    names=["doc_id", "label", "at", "counts"])

    found = texts.mapInArrow(run, "doc_id long, label int, at binary, counts binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["counts"])))
    return [(np.frombuffer(bytes(r["at"]), "<u2").astype(np.int64), np.frombuffer(bytes(r["counts"]), "<f4"), r["label"]) for r in found]


def score(docs: DataFrame, classifier: Classifier, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted for every whole text.

    Null and empty texts get the score of no grams; repeated rows are scored each; an empty table gives an empty result.
    """
    rows = exact(docs, doc_id="doc_id", text="text")
    rows = rows.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (t.as_py() or "" for t in b.column(2))
            parts = [shared.value.probabilities(x)[:, 1] for x in histograms(texts, ORDERS, BITS, words=True)]
            p = np.concatenate(parts).astype(float) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(p, pa.float64()),
                                              pa.array((p >= keep_at).astype(np.int32), pa.int32())], schema=ARROW)

    return rows.mapInArrow(run, SCHEMA)


def classify_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, keep_at: float = KEEP_AT,
                     train_chars: int = TRAIN_CHARS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Only the text goes into a score.

    Learns from about ``train_rows`` labelled documents of up to ``train_chars`` characters (documented bounds) and scores every whole text. Null counts as
    empty and gets the score of no grams at all; labels other than 0 and 1 are passed over, a document with both labels
    counts once with each; without labels every score is about one half; repeated rows are scored each; an empty table gives an
    empty result; other columns are ignored.
    """
    return score(docs, fit(training_rows(docs, labels, train_rows, train_chars)), keep_at)
