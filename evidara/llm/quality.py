"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics of each whole text are standardised by the mean and spread over the training rows and clipped; cos(Wx + b)
for random W and b of a fixed seed approximates a Gaussian kernel. Each partition sums its part of the normal
equations, the sums (features squared, whatever the corpus) are solved once, and pooled adjacent violators over a fixed grid of raw scores make them
probabilities. All labelled training rows take part.

Defined cases: null, empty and blank texts have statistics zero and are scored like others; a document labelled twice counts once;
a row without doc_id is scored and held out of training; rows that repeat a doc_id are scored each; without any training label every
score is 0.5. labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, slices, with_fields
from .fitting import Isotonic, fold, in_few_tasks, labels_of, partition_sum
from .textstats import NAMES, statistics

FEATURES = 384
RIDGE = 1.0
WIDTH = 6.0
CLIP = 5.0
SEED = 8
FOLDS, HELD = 5, 0
THRESHOLD = 0.3
_K = len(NAMES)


@dataclass
class Model:
    mean: np.ndarray
    sd: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    iso: Isotonic

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -CLIP, CLIP)
        return np.column_stack([np.sqrt(2.0 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.iso.apply(self.features(x) @ self.beta) if self.beta is not None else np.full(len(x), 0.5)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("stats").to_pylist()), np.float64).reshape(-1, _K)


def stats_table(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, stats[, carry]: the statistics as little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = np.ascontiguousarray(statistics(part.column("text")), dtype="<f8")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary()), *(part.column(c) for c in carry)], ["doc_id", "stats", *carry])

    read = docs.select(F.col("doc_id").cast("long"), "text", *carry)
    return read.mapInArrow(run, with_fields("doc_id long, stats binary", read, carry))


def fit(train: DataFrame, features: int = FEATURES, ridge: float = RIDGE, width: float = WIDTH, seed: int = SEED) -> Model:
    """train: stats, label."""
    label = lambda batch: batch.column("label").to_numpy()
    moments = partition_sum(train, 2 * _K + 1, lambda batch: np.concatenate([[batch.num_rows], (x := _matrix(batch)).sum(0), (x**2).sum(0)]))
    n = moments[0]
    if not n:
        return Model(np.zeros(_K), np.ones(_K), np.zeros((_K, 1)), np.zeros(1), None, Isotonic(0, 1))
    mean = moments[1 : _K + 1] / n
    sd = np.sqrt(np.maximum(moments[_K + 1 :] / n - mean**2, 0))
    rng = np.random.default_rng(seed)
    model = Model(mean, np.where(sd > 1e-9, sd, 1.0), rng.normal(size=(_K, features)) / width, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), Isotonic(-0.5, 1.5))
    d = features + 1
    half = np.triu_indices(d)  # the matrix is symmetric

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(d * (d + 1) // 2 + d)
        x, y = _matrix(batch), label(batch)
        for a in range(0, len(y), 8192):
            z = model.features(x[a : a + 8192])
            total += np.concatenate([(z.T @ z)[np.triu_indices(d)], z.T @ y[a : a + 8192]])
        return total

    sums = partition_sum(train, len(half[0]) + d, normal)
    gram = np.zeros((d, d))
    gram[half] = sums[: len(half[0])]
    gram += np.triu(gram, 1).T + ridge * np.diag([*[1.0] * features, 0.0])
    model.beta = np.linalg.solve(gram + 1e-9 * np.eye(d), sums[len(half[0]) :])
    model.iso.fit(partition_sum(train, 3 * Isotonic.BINS, lambda batch: model.iso.sums(model.features(_matrix(batch)) @ model.beta, label(batch))))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, threshold: float = THRESHOLD, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """doc_id, held_out, score, predicted[, carried columns] for each document; rows whose fold is held are never trained on."""
    table = cut(stats_table(docs, carry))
    train = table.join(labels_of(labels, "quality"), "doc_id").filter(fold(F.col("doc_id"), folds) != held).dropDuplicates(["doc_id"]).select("stats", "label")
    model = fit(in_few_tasks(train), **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)), pa.float64()), *(batch.column(c) for c in carry)], ["doc_id", "score", *carry])

    scored = table.mapInArrow(run, with_fields("doc_id long, score double", table, carry))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *carry)
