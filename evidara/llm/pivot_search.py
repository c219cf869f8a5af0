"""Exact top-k by integer inner product with a pivot-distance index.

Components become floor(scale * x). A further component sqrt(M - |x|^2), M the largest squared norm, makes all indexed vectors equally long, so the largest
inner product is the smallest distance to the query (whose further component is 0). The index keys each vector by its nearest pivot and
its distance from it, sorted, in blocks of one pivot: annuli. By the triangle inequality a vector of a block is no nearer to a query than the query's
own distance from the pivot lies outside the block's [low, high], nor than half of how much farther this pivot is than the query's nearest one.

Queries are rows of the table, so each lies in an annulus itself: a first job scores it against that one, which gives a k-th best score to begin with. The query set lies in files of the shared folder, in blocks of a bounded
number; the second job passes over the index once: its tasks hold their annuli and take one block of queries after the other, expand the annuli outward, in order of their bounds, and stop each query at the first whose bound exceeds
its k-th best distance. Only what may be among the k best leaves a task. Bounds are widened by a rounding allowance and ties are looked at, so the result is exact.

Defined cases: null ids and vectors null, empty or with null or non-finite components take no part; zero vectors do; one row per vec_id (the smallest of those that
repeat it); vectors of different lengths do not meet; an empty table gives an empty result. Vectors whose components are so large that a sum of products might reach 2**53 are wide: pairs with one are
compared apart, without bounds, in whole numbers of any size, and rank by them; a score beyond 64 bits is given as the nearest 64-bit number, and a component whose scaled value is no double as the nearest double.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from .common import cut, drop_shared_dir, map_file, new_shared_dir, put_bytes
from .vectors import dimensions, matrix, valid_vectors

SCALE = 256
TOP = 5
EVERY = 50
PIVOTS = 64
BLOCK = 512
#: Queries in a block, about: their vectors, thresholds and best lists are what a task holds beside its part of the index.
QUERY_BLOCK = 2048
_INDEX = "cell int, low double, high double, ids binary, vectors binary"
_LONG = (-(1 << 63), (1 << 63) - 1)
_FOUND = "query_id long, vec_id long, score long"


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of vectors that are not wide."""
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)


def _wide_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole doubles of any size, as Python's integers."""
    whole = lambda x: np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
    return whole(a) @ whole(b).T


def _order_key(score: int) -> bytes:
    """Bytes that sort as the numbers do."""
    size = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    body = len(size).to_bytes(2, "big") + size
    return b"\x01" + body if score >= 0 else b"\x00" + bytes(255 - x for x in body)


class Geometry:
    """Pivots with their further component and the distances from them."""

    def __init__(self, pivots: np.ndarray, longest: int):
        self.longest = float(longest)
        self.pivots = np.column_stack([pivots, self.further(pivots)])

    def further(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest - (x.astype(np.float64) ** 2).sum(1), 0))

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        full = np.column_stack([x.astype(np.float64), np.zeros(len(x)) if query else self.further(x)])
        return np.sqrt(np.maximum((full**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * full @ self.pivots.T, 0))

    def reach(self, norm: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance of a vector of that score from a query of that squared norm, with the allowance for rounding."""
        return np.sqrt(np.maximum(norm + self.longest - 2.0 * score, 0)) * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(self.longest))


def build_index(vectors: DataFrame, dim: int, pivots: int = PIVOTS, block: int = BLOCK) -> tuple[DataFrame, Geometry] | None:
    """The index blocks of vec_id, x (whole components), and the geometry."""
    longest = vectors.agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).first()[0]
    if longest is None:
        return None
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("x").limit(pivots).collect()  # a bounded sample; every row is indexed
    geometry = Geometry(np.array([r["x"] for r in chosen], np.float64), longest)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = geometry.distances(matrix(batch.column("x"), dim), False)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["vec_id", "x", "cell", "r"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, r = batch.column("cell").to_numpy(), batch.column("r").to_numpy()
            ids, x = batch.column("vec_id").to_numpy(), matrix(batch.column("x"), dim).astype(np.int64)
            edges = [0]
            for i in [*(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]:
                while edges[-1] < i:
                    edges.append(min(edges[-1] + block, i))
            rows = [(int(cell[a]), float(r[a]), float(r[b - 1]), ids[a:b].tobytes(), x[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()))], ["cell", "low", "high", "ids", "vectors"])

    keyed = vectors.mapInArrow(key, "vec_id long, x array<double>, cell int, r double")
    return cut(keyed.repartitionByRange("cell", "r", "vec_id").sortWithinPartitions("cell", "r").mapInArrow(blocks, _INDEX)), geometry


class _Best:
    """The k best of each query so far in this task: score down, then vec_id up."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.scores = np.full((n, k), np.iinfo(np.int64).min)
        self.full = np.zeros((n, k), bool)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, own: np.ndarray) -> None:
        """scores: rows x ids; own: the queries' ids, which are no candidates of theirs."""
        ok = ids[None, :] != own[:, None]
        if len(ids) > 4 * self.k:  # enough: no tie with the k-th of these may be lost
            kth = np.partition(np.where(ok, scores, np.iinfo(np.int64).min), len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            column = np.flatnonzero((ok & (scores >= np.maximum(kth, self.scores[rows, -1])[:, None])).any(0))
            ids, scores, ok = ids[column], scores[:, column], ok[:, column]
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], 1)
        all_scores = np.concatenate([self.scores[rows], scores], 1)
        all_ok = np.concatenate([self.full[rows], ok], 1)
        order = np.lexsort((all_ids, -all_scores.astype(np.float64) if abs(all_scores[all_ok]).max(initial=0) < 2**53 else ~all_scores, ~all_ok), axis=1)[:, : self.k]
        self.ids[rows] = np.take_along_axis(all_ids, order, 1)
        self.full[rows] = np.take_along_axis(all_ok, order, 1)
        self.scores[rows] = np.where(self.full[rows], np.take_along_axis(all_scores, order, 1), np.iinfo(np.int64).min)


def _file_rows(uri: str, name: str, width: int, dtype: str = "<i8") -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of width numbers of a block's file."""
    data = map_file(uri, name)
    n = len(data) // (8 * (1 + width))
    return np.frombuffer(data, "<i8", n), np.frombuffer(data, dtype, n * width, 8 * n).reshape(n, width)


def _write_blocks(rows: DataFrame, uri: str, kind: str, blocks: int, width: int, dtype: str = "<i8") -> None:
    """rows (query_id, x: array of width numbers) as files kind-0, kind-1, ...: ids in order, then the numbers as dtype."""
    own = rows.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "x")
    none = rows.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast(own.schema["x"].dataType).alias("x"))

    def write(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        t = t.filter(pc.is_valid(t.column("query_id"))).sort_by("query_id")
        put_bytes(uri, f"{kind}-{block}", t.column("query_id").to_numpy().astype("<i8").tobytes(), t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(dtype).tobytes() if t.num_rows else b"")
        return pa.table({"n": [t.num_rows]})

    own.unionByName(none).groupBy("block").applyInArrow(write, "n long").count()


def _seeds(index: DataFrame, dim: int, k: int, every: int) -> DataFrame:
    """query_id, x: the k-th best score of each query among its own annulus' rows, and its vec_id; none where there are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, vectors in zip(batch.column("ids"), batch.column("vectors")):
                ids, x = np.frombuffer(own.as_py(), np.int64), np.frombuffer(vectors.as_py(), np.int64).reshape(-1, dim)
                asked = np.flatnonzero(ids % every == 0)
                if len(ids) > k and len(asked):
                    best = _Best(len(asked), k)
                    best.add(np.arange(len(asked)), ids, _products(x[asked], x), ids[asked])
                    last = [[int(s), int(i)] for s, i in zip(best.scores[:, -1], best.ids[:, -1])]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[asked]), pa.array(last, pa.list_(pa.int64()))], ["query_id", "x"])

    return index.mapInArrow(run, "query_id long, x array<long>")


def _search(index: DataFrame, geometry: Geometry, uri: str, blocks: int, dim: int, k: int, tally: tuple | None = None) -> DataFrame:
    """What may be among each query's k best, by one pass over the index. tally: accumulators of compared and of all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        part = pa.Table.from_batches(rows)
        cell, low, high = (part.column(c).to_numpy() for c in ("cell", "low", "high"))
        held = [(np.frombuffer(i.as_py(), np.int64), np.frombuffer(v.as_py(), np.int64).reshape(-1, dim)) for i, v in zip(part.column("ids"), part.column("vectors"))]
        for block in range(blocks):
            ids, x = _file_rows(uri, f"queries-{block}", dim)
            if not len(ids):
                continue
            norm = (x.astype(np.float64) ** 2).sum(1)
            kth, sure, kth_id = np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).min), np.full(len(ids), np.iinfo(np.int64).max)
            known, seed = _file_rows(uri, f"kth-{block}", 2)
            at = np.searchsorted(ids, known)
            kth[at], sure[at], kth_id[at] = seed[:, 0], seed[:, 0], seed[:, 1]
            far = geometry.distances(x, True)
            best = _Best(len(ids), k)
            gap = np.maximum(np.maximum(low - far[:, cell], far[:, cell] - high), 0)  # queries x annuli
            gap = np.maximum(gap, (far[:, cell] - far.min(1)[:, None]) / 2)
            use = gap <= geometry.reach(norm, kth)[:, None]
            for j in np.argsort(gap.min(0), kind="stable"):
                on = np.flatnonzero(use[:, j])
                if len(on):
                    mine = best.scores[on, -1].astype(np.float64)
                    mine[~best.full[on, -1]] = -np.inf
                    on = on[gap[on, j] <= geometry.reach(norm[on], np.maximum(mine, kth[on]))]
                if tally:
                    tally[0].add(len(on) * len(held[j][0]))
                    tally[1].add(len(ids) * len(held[j][0]))
                if len(on):
                    best.add(on, held[j][0], _products(x[on], held[j][1]), ids[on])
            # a row behind the k-th known (score down, then vec_id up) is none of the k best
            q, c = np.nonzero(best.full & ((best.scores > sure[:, None]) | ((best.scores == sure[:, None]) & (best.ids <= kth_id[:, None]))))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best.ids[q, c]), pa.array(best.scores[q, c])], ["query_id", "vec_id", "score"])

    return index.mapInArrow(run, _FOUND)


def _wide_pairs(candidates: DataFrame, queries: DataFrame, dim: int, k: int, query_block: int) -> DataFrame:
    """query_id, vec_id, score, key: what may be among the k best of each query by pairs of candidates and queries, compared one and all."""
    spark, uri = candidates.sparkSession, new_shared_dir(candidates.sparkSession, "wide-queries")
    blocks = -(-queries.count() // query_block)
    _write_blocks(queries, uri, "queries", blocks, dim, "<f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                own, x = part.column("vec_id").to_pylist(), matrix(part.column("x"), dim)
                for block in range(blocks):
                    ids, q = _file_rows(uri, f"queries-{block}", dim, "<f8")
                    rows = []
                    for i, scores in zip(ids.tolist(), _wide_products(q, x)):
                        best = sorted((-s, j) for s, j in zip(scores.tolist(), own) if i != j)[:k]
                        rows += [(i, j, max(min(-s, _LONG[1]), _LONG[0]), _order_key(-s)) for s, j in best]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["query_id", "vec_id", "score", "key"])

    out = cut(candidates.mapInArrow(run, f"{_FOUND}, key binary"))
    drop_shared_dir(spark, uri)
    return out


def _with_keys(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(_order_key, batch.column("score").to_pylist()), pa.binary())], [*batch.schema.names, "key"])

    return found.mapInArrow(run, f"{_FOUND}, key binary")


def _ranked(found: DataFrame, k: int, by: str = "score") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_top_k(table: DataFrame, k: int = TOP, every: int = EVERY, scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for every query (vec_id divisible by every): its k highest inner products, ties to the smaller vec_id. report gets how many pairs were compared, and of how many."""
    spark = table.sparkSession
    most = float(np.finfo(np.float64).max)
    component = lambda v: F.when(F.abs(v * scale) < 2.0**53, F.floor(v * scale).cast("double")).otherwise(F.greatest(F.least(v * scale, F.lit(most)), F.lit(-most)))
    whole = cut(valid_vectors(table, True).select("vec_id", F.transform("embedding", component).alias("x")))
    schema = T.StructType().add("query_id", "long").add("rank", "integer").add("vec_id", "long").add("score", "long")
    results = None
    for dim in dimensions(whole.withColumnRenamed("x", "embedding")):
        largest = float(np.floor(np.sqrt(2.0**52 / dim)))
        asked = lambda df: df.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "x")
        same, plain = whole.filter(F.size("x") == dim), F.forall("x", lambda v: F.abs(v) <= largest)
        if asked(same).isEmpty():
            continue
        wide, vectors = same.filter(~plain), same.filter(plain)
        extra = None
        if not wide.isEmpty():
            extra = _wide_pairs(wide, asked(same), dim, k, query_block)
            if not asked(wide).isEmpty():
                extra = extra.unionByName(_wide_pairs(vectors, asked(wide), dim, k, query_block))
        queries = asked(vectors)
        blocks = -(-queries.count() // query_block)
        if not blocks:
            part = _ranked(extra, k, "key").select("query_id", "rank", "vec_id", "score")
            results = part if results is None else results.unionByName(part)
            continue
        uri = new_shared_dir(spark, "pivot-queries")
        index, geometry = build_index(vectors, dim, pivots, block)
        _write_blocks(queries, uri, "queries", blocks, dim)
        _write_blocks(_seeds(index, dim, k, every), uri, "kth", blocks, 2)
        tally = (spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)) if report is not None else None
        found = _search(index, geometry, uri, blocks, dim, k, tally)
        found = _ranked(found, k) if extra is None else _ranked(_with_keys(found).unionByName(extra), k, "key")
        part = cut(found.select("query_id", "rank", "vec_id", "score"))
        if tally:
            report.update({"compared": report.get("compared", 0) + tally[0].value, "pairs": report.get("pairs", 0) + tally[1].value})
        drop_shared_dir(spark, uri)
        results = part if results is None else results.unionByName(part)
    return results if results is not None else spark.createDataFrame([], schema)


#: What op10_pivot_search returns, for DuckDB.
SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
