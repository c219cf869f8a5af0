"""Connected components of a table of edges.

Chunks of a fixed number of edges are contracted where they lie: each becomes stars around its smallest nodes. Large-star and small-star joins then
run until nothing changes, at any size; few edges are one chunk and change no more. No task holds a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from .common import cut, release

#: Edges that a task contracts at once: 16 bytes each, some ten times that while it does.
CHUNK = 1_000_000
#: Parts into which the edges of one centre are dealt.
SALTS = 32


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the smallest node that each reaches."""
    nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = back[: len(u)], back[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        while not np.array_equal(up := after[after], after):
            after = up
        if np.array_equal(after, label):
            return nodes, nodes[label]
        label = after


def contracted(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """u, v (u > v): each chunk of a partition as stars around its smallest nodes."""

    def stars(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes, least = least_reachable(*(np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("u", "v")))
        leaf = nodes != least
        return pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(least[leaf])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            parts.append(batch)
            held += batch.num_rows
            if held >= chunk:
                yield stars(parts)
                parts, held = [], 0
        if held:
            yield stars(parts)

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _state(edges: DataFrame) -> Row:
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()


def components(edges: DataFrame, rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """node, component (its smallest reachable node) for the nodes of edges (u, v)."""
    spark = edges.sparkSession
    found = cut(edges.filter("u <> v").select("u", "v"))
    now = cut(contracted(found.coalesce(max(1, -(-found.count() // chunk))), chunk).distinct())
    state = _state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # only centres, nodes with a larger neighbour, have edges to move: they are few, so each is there once for each part of its edges
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.max("v").alias("top")).filter("top > u")
        least = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        part = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("salt")
        large = both.filter("v > u").select("u", "v", part).join(least, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(own.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        before, state = state, _state(now)
        release(spark)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
