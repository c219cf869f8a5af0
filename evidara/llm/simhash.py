"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint: bit b is 1 if it is set in over half the XXH64 hashes of the text's word shingles, repeats
included; without words it is zero. Distinct fingerprints are laid out in tiles of one population count each;
tiles are compared by numpy exclusive-or and bit counts, and tile pairs whose population counts (of the whole or, by
their bounds, summed over four 16-bit parts) differ beyond the radius are skipped, since flipping one bit changes a count by one.
Each tile pair gives a spanning forest of its links, so copies are never expanded into all pairs and no link between
components is lost. Components come from the same steps at any size (components.py).

Defined cases: null and empty texts have fingerprint zero and are linked like any others; rows that repeat a doc_id are kept, each with
its fingerprint; a row without doc_id gets the component of its fingerprint (null if no row with an id has that one);
columns besides doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytescan import scan, xxh64
from .common import cut, slices
from .components import components

RADIUS = 3
SHINGLE_WORDS = 3
#: Fingerprints in a tile: a pair of tiles takes some 70 KB of rows, its comparison under 30 MB.
TILE = 4096
_STEP = 256
#: A byte's bits as eight counters of a byte each.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
_ROWS = 1 << 20


def bit_counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of each text's hashes have each of the 64 bits set; sizes: hashes of each text, one at least.

    Bytes are looked up as eight counters in one number, which hold the sums of up to 255 hashes.
    """
    pieces = -(-sizes // 255)
    of = np.repeat(np.arange(len(sizes)), pieces)
    first = np.cumsum(sizes) - sizes
    nth = np.arange(len(of)) - (np.cumsum(pieces) - pieces)[of]
    edges = first[of] + 255 * nth
    octets = hashes.view(np.uint8).reshape(-1, 8)
    sums = np.empty((len(edges), 8), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(edges, np.arange(0, len(hashes), _ROWS)), len(edges))).tolist()
    for a, b in zip(cuts, cuts[1:]):
        low, high = int(edges[a]), int(edges[b]) if b < len(edges) else len(hashes)
        for k in range(8):
            sums[a:b, k] = np.add.reduceat(_SPREAD[octets[low:high, k]], edges[a:b] - low)
    return np.add.reduceat(sums.view(np.uint8).reshape(-1, 64), np.cumsum(pieces) - pieces, axis=0, dtype=np.int64)


def fingerprints(texts: pa.Array, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The uint64 fingerprint of each text."""
    w = scan(texts)
    out = np.zeros(len(w.counts), np.uint64)
    if not len(w.starts):
        return out
    first = np.concatenate([[0], np.cumsum(w.counts)[:-1]])
    shingles = np.where(w.counts == 0, 0, np.maximum(w.counts - words + 1, 1))
    doc = np.repeat(np.arange(len(shingles)), shingles)
    begin = np.cumsum(shingles) - shingles
    nth = np.arange(len(doc)) - begin[doc]
    head = first[doc] + nth
    tail = first[doc] + np.minimum(nth + words, w.counts[doc]) - 1
    hashes = xxh64(w.buf, w.starts[head], w.ends[tail])
    some = np.flatnonzero(shingles)
    bits = 2 * bit_counts(hashes, shingles[some]) > shingles[some, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint_table(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(part.column("text"), words).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _parts(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _tiles(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Cut one range of the sorted fingerprints into tiles of one population count."""
    import uuid

    rest: pd.DataFrame | None = None

    def emit(pop: int, rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy(np.int64)
        parts = _parts(fp.view(np.uint64))
        return pd.DataFrame({"tile": [uuid.UUID(bytes=np.array([fp[0], fp[-1]], "<i8").tobytes()).hex], "pop": [pop], "low": [parts.min(0).tolist()], "high": [parts.max(0).tolist()], "fps": [fp.tobytes()], "ids": [rows["rep"].to_numpy(np.int64).tobytes()]})

    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        while len(rest):
            pop = rest["pop"].iloc[0]
            run = int(np.searchsorted(rest["pop"].to_numpy(), pop, side="right"))
            if run == len(rest) and run < size:
                break
            take = min(run, size)
            yield emit(int(pop), rest.iloc[:take])
            rest = rest.iloc[take:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield emit(int(rest["pop"].iloc[0]), rest)


def spanning(n: int, m: int, near: Callable[[int, int], tuple[np.ndarray, np.ndarray]], check: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, step: int = _STEP) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what all links of n rows with m others join, fewer than n + m of them.

    near(a, b) gives the candidates (row, other) of rows a to b, others numbered from 0 or, in a tile of its own (m = 0), as rows; check says which of them are links. Candidates within one
    tree are passed over; of those that would hang up one root, the first is checked, and taken or given up.
    """
    parent = np.arange(n + m)
    shift = n if m else 0
    links_u, links_v = [], []
    for k in range(0, n, step):
        u, v = near(k, min(k + step, n))
        v = v + shift
        while len(u):
            ru, rv = parent[u], parent[v]
            open_ = ru != rv
            u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
            if not len(u):
                break
            low, high = np.minimum(ru, rv), np.maximum(ru, rv)
            roots, pick = np.unique(high, return_index=True)
            if check is not None:
                ok = check(u[pick], v[pick])
                failed = pick[~ok]
                roots, pick = roots[ok], pick[ok]
            parent[roots] = low[pick]
            links_u.append(u[pick])
            links_v.append(v[pick])
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent = up
            if check is not None:
                u, v = np.delete(u, failed), np.delete(v, failed)
    none = np.zeros(0, np.int64)
    return (np.concatenate(links_u) if links_u else none), (np.concatenate(links_v) if links_v else none)


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links (index into a followed by b, likewise) that join what the pairs within the radius join; under len(a) + len(b) of them."""

    def near(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        u, v = np.nonzero(np.bitwise_count(a[i:j, None] ^ b[None, :]) <= radius)
        return u + i, v

    return spanning(len(a), 0 if same else len(b), near)


def links(reps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """reps: fp, rep (distinct fingerprints). Returns u, v: rep pairs, a spanning forest for each tile pair."""
    fp = F.col("fp")
    part = [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(65535))) for i in range(3)]
    keyed = reps.select("fp", "rep", F.bit_count(fp).cast("int").alias("pop"), *(x.alias(f"p{i}") for i, x in enumerate(part)))
    order = ["pop", "p0", "p1", "p2", "fp"]
    tiles = cut(
        keyed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("pop", "fp", "rep")
        .mapInPandas(lambda it: _tiles(it, tile), "tile string, pop int, low array<int>, high array<int>, fps binary, ids binary")
    )
    index = tiles.select("tile", "pop", "low", "high")
    a = index.select(F.col("tile").alias("a"), "pop", F.col("low").alias("low_a"), F.col("high").alias("high_a")).withColumn("to", F.explode(F.sequence(F.col("pop"), F.col("pop") + radius)))
    b = index.select(F.col("tile").alias("b"), F.col("pop").alias("to"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    gap = F.expr("aggregate(zip_with(zip_with(low_a, high_b, (x, y) -> greatest(x - y, 0)), zip_with(high_a, low_b, (x, y) -> greatest(y - x, 0)), (x, y) -> x + y), 0, (s, x) -> s + x)")
    pairs = a.join(b, "to").filter((F.col("to") > F.col("pop")) | (F.col("a") <= F.col("b"))).filter(gap <= radius).select("a", "b")
    n = max(reps.sparkSession.sparkContext.defaultParallelism * 4, 24)
    fa = tiles.select(F.col("tile").alias("a"), F.col("fps").alias("fps_a"), F.col("ids").alias("ids_a"))
    fb = tiles.select(F.col("tile").alias("b"), F.col("fps").alias("fps_b"), F.col("ids").alias("ids_b"))
    loaded = pairs.join(fa, "a").join(fb, "b").repartition(n)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = {k: batch.column(k)[row].as_py() for k in ("a", "b", "fps_a", "ids_a", "fps_b", "ids_b")}
                same = get["a"] == get["b"]
                x, y = np.frombuffer(get["fps_a"], np.uint64), np.frombuffer(get["fps_b"], np.uint64)
                ids = np.frombuffer(get["ids_a"], np.int64)
                if not same:
                    ids = np.concatenate([ids, np.frombuffer(get["ids_b"], np.int64)])
                u, v = forest(x, y, radius, same)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], ["u", "v"])

    return loaded.mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id (smallest doc_id reachable, itself included)."""
    prints = cut(fingerprint_table(docs, words))
    reps = cut(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    labels = components(links(reps, radius, tile))
    classes = reps.join(labels, reps.rep == labels.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    # copies of one text may hold a large part of all rows: adaptive skew handling splits that side of this join
    out = prints.join(classes, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
