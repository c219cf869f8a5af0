"""Sums over partitions, isotonic calibration and label folds for the trained operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, release


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, label (0.0 or 1.0): one row per labelled document; rows that disagree are settled by their mean, half counting as 1."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("double").alias("label"))


def partition_sum(df: DataFrame, size: int, part: Callable[[pa.RecordBatch], np.ndarray], slots: int = 8) -> np.ndarray:
    """The sum over all batches of part(batch), size doubles. Tasks add up first, then slots tasks, then the driver adds slots rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % slots]), pa.array([total.tobytes()])], ["slot", "total"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("total"):
                total = np.frombuffer(x.as_py()) + (0 if total is None else total)
        if total is not None:  # partitions that no slot falls into send nothing to the driver
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["total"])

    sums = df.mapInArrow(add, "slot long, total binary").repartition(slots, "slot").select("total").mapInArrow(merge, "total binary")
    total = sum((np.frombuffer(r["total"]) for r in sums.collect()), np.zeros(size))
    release(df.sparkSession)
    return total


def in_few_tasks(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df, materialised, in tasks of about so many rows: passes over a small table need not start a task for each shuffle partition."""
    table = cut(df)
    return table.coalesce(max(1, -(-table.count() // rows)))


class Isotonic:
    """Monotone calibration from sums over a fixed grid of raw scores: pool adjacent violators, linear between pool centres."""

    BINS = 2000

    def __init__(self, low: float, high: float):
        self.low, self.high = low, high if high > low else low + 1.0
        self.x, self.y = np.array([low]), np.array([0.5])

    def bins(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(((raw - self.low) / (self.high - self.low) * self.BINS).astype(np.int64), 0, self.BINS - 1)

    def sums(self, raw: np.ndarray, label: np.ndarray) -> np.ndarray:
        """What partition_sum() adds up: rows, labels and raw scores of each bin."""
        b = self.bins(raw)
        return np.concatenate([np.bincount(b, w, self.BINS) for w in (np.ones(len(raw)), label, raw)])

    def fit(self, sums: np.ndarray) -> Isotonic:
        n, y, x = sums.reshape(3, self.BINS)
        on = np.flatnonzero(n)
        pools: list[list[float]] = []
        for i in on:
            pools.append([n[i], y[i], x[i]])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        if pools:
            rows, ones, raw = np.array(pools).T
            # a share stays off 0 and 1 by the weight of half a row
            self.x, self.y = raw / rows, np.maximum.accumulate((ones + 0.5 * (ones.sum() / rows.sum())) / (rows + 0.5))
        return self

    def apply(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.x, self.y), 0.0, 1.0)
