"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

Equal vectors are one node (its smallest ids are kept, as many as an answer can hold). Each node starts with random neighbours. A round is two Spark joins by range of nodes: the first meets
each node's neighbours with its reverse neighbours, scores the pairs among them and proposes those that would better a list; the second meets the proposals for a node with its list. Rounds end
when few lists change. Vectors and lists lie in files of the shared folder by range of nodes, which workers memory-map.
A query walks the graph from its own node: the best node not yet expanded comes next, until the beam holds none.

Reverse neighbours, and pairs proposed for one node by one neighbour, are limited (REVERSE, PROPOSE), as in the published algorithm; the index holds every row. A node that many lists name had so many
reverse edges in the round before: its edges are thinned to about HUB by chance before they are shuffled, so that what reaches it does not grow with the table.

Defined cases: null ids and vectors null, empty, zero, or with null or non-finite components take no part; one row per vec_id (the smallest of
those that repeat it); vectors of different lengths do not meet; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from .common import cut, drop_shared_dir, map_file, new_shared_dir, put_bytes, release
from .ngram_lm import mix
from .vectors import dimensions, matrix, valid_vectors

TOP = 20
EVERY = 20
NEIGHBOURS = 40
REVERSE = 24
PROPOSE = 8
HUB = 4 * REVERSE
ROUNDS = 12
SETTLED = 0.002
BEAM = 320
ENTRIES = 48
WIDTH = 2048  # nodes in a range
_CHUNK = 64


class Store:
    """The files of one index: range r holds nodes r * WIDTH on. vectors-r: doubles; small-r: the same as floats; ids-r: kept ids; list-i-r: neighbours and scores after round i."""

    def __init__(self, uri: str, n: int, dim: int, k: int, keep: int):
        self.uri, self.n, self.dim, self.k, self.keep = uri, n, dim, min(k, max(n - 1, 1)), keep
        self.maps: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {**self.__dict__, "maps": {}}

    @property
    def ranges(self) -> int:
        return -(-self.n // WIDTH)

    def size(self, r: int) -> int:
        return min(WIDTH, self.n - r * WIDTH)

    def _part(self, name: str, r: int, dtype: str, width: int) -> np.ndarray:
        key = f"{name}-{r}"
        if key not in self.maps:
            self.maps[key] = np.frombuffer(map_file(self.uri, key), dtype).reshape(self.size(r), width)
        return self.maps[key]

    def _rows(self, name: str, nodes: np.ndarray, dtype: str, width: int) -> np.ndarray:
        out = np.empty((len(nodes), width), dtype)
        part = nodes // WIDTH
        for r in np.unique(part):
            on = part == r
            out[on] = self._part(name, int(r), dtype, width)[nodes[on] - r * WIDTH]
        return out

    def small(self, nodes: np.ndarray) -> np.ndarray:
        return self._rows("small", nodes, "<f4", self.dim)

    def vectors(self, nodes: np.ndarray) -> np.ndarray:
        return self._rows("vectors", nodes, "<f8", self.dim)

    def ids(self, nodes: np.ndarray) -> np.ndarray:
        return self._rows("ids", nodes, "<i8", self.keep)

    def lists(self, i: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self._rows(f"list-{i}", nodes, "<i8", 2 * self.k)
        return both[:, : self.k], np.ascontiguousarray(both[:, self.k :]).view("<f8")

    def degrees(self, i: int, nodes: np.ndarray) -> np.ndarray:
        """About how many reverse edges were sent to each node in round i, had none been thinned."""
        return self._rows(f"degree-{i}", nodes, "<f4", 1)[:, 0]

    def put_lists(self, i: int, r: int, nbr: np.ndarray, score: np.ndarray) -> None:
        put_bytes(self.uri, f"list-{i}-{r}", np.column_stack([nbr, np.ascontiguousarray(score, "<f8").view("<i8")]).astype("<i8").tobytes())


def merge_lists(node: np.ndarray, nbr: np.ndarray, score: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct neighbours (score down, then node up) of nodes 0..size-1; -1 and -inf where there are fewer."""
    order = np.lexsort((nbr, -score, node))
    node, nbr, score = node[order], nbr[order], score[order]
    fresh = np.ones(len(node), bool)
    fresh[1:] = (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])  # one pair always has one score, so its rows stand together
    node, nbr, score = node[fresh], nbr[fresh], score[fresh]
    first = np.searchsorted(node, np.arange(size))
    rank = np.arange(len(node)) - first[node]
    on = rank < k
    out, held = np.full((size, k), -1, np.int64), np.full((size, k), -np.inf)
    out[node[on], rank[on]], held[node[on], rank[on]] = nbr[on], score[on]
    return out, held


def propose(store: Store, i: int, near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """near: a row of neighbours (both ways, -1 for none) for each node. Gives (node, neighbour, score) that better lists of round i."""
    for a in range(0, len(near), _CHUNK):
        part = near[a : a + _CHUNK]
        some = part >= 0
        if not some.any():
            continue
        nodes, back = np.unique(part[some], return_inverse=True)
        place = np.zeros(part.shape, np.int64)
        place[some] = back
        x = store.small(nodes)
        lists, scores = store.lists(i, nodes)
        worst = scores[:, -1]
        group = x[place]
        s = np.matmul(group, group.transpose(0, 2, 1))
        s[~(some[:, :, None] & some[:, None, :])] = -np.inf
        s[:, np.arange(part.shape[1]), np.arange(part.shape[1])] = -np.inf
        top = min(PROPOSE, part.shape[1] - 1)
        if top < 1:
            continue
        best = np.argpartition(-s, top - 1, axis=2)[:, :, :top]
        value = np.take_along_axis(s, best, 2)
        better = value > worst[place][:, :, None]
        g, u, t = np.nonzero(better)
        node, nbr = part[g, u], part[g, best[g, u, t]]
        known = (lists[place[g, u]] == nbr[:, None]).any(1) if len(g) else np.zeros(0, bool)
        keep = ~known & (node != nbr)
        yield node[keep], nbr[keep], value[g, u, t][keep].astype(np.float64)


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _exact(store: Store, node: np.ndarray, nbr: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", store.small(node), store.small(nbr), dtype=np.float32).astype(np.float64)


def build_store(spark: SparkSession, nodes: DataFrame, dim: int, neighbours: int, keep: int) -> Store:
    """nodes: embedding, ids (the smallest ids that have it). Writes the node files; nodes are numbered in the order of their smallest id."""
    uri = new_shared_dir(spark, "neighbours")
    ordered = cut(nodes.select(F.element_at("ids", 1).alias("rep"), "ids", "embedding").repartitionByRange("rep").sortWithinPartitions("rep"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _batch(["task", "n"], np.array([TaskContext.get().partitionId()]), np.array([sum(b.num_rows for b in batches)]))

    sizes = {r["task"]: r["n"] for r in ordered.select("rep").mapInArrow(count, "task long, n long").collect()}  # a row for each task
    first, total = {}, 0
    for task in sorted(sizes):
        first[task] = total
        total += sizes[task]
    store = Store(uri, total, dim, neighbours, keep)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = first.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            node = np.arange(at, at + b.num_rows)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(node // WIDTH), pa.array(node), b.column("ids"), b.column("embedding")], ["range", "node", "ids", "embedding"])

    def write(t: pa.Table) -> pa.Table:
        r, order = t.column("range")[0].as_py(), np.argsort(t.column("node").to_numpy())
        x = matrix(t.column("embedding"), dim)[order]
        ids = np.full((len(order), keep), -1, np.int64)
        for row, own in enumerate(t.column("ids").to_pylist()):
            ids[row, : len(own)] = own
        put_bytes(uri, f"vectors-{r}", x.astype("<f8").tobytes())
        put_bytes(uri, f"small-{r}", x.astype("<f4").tobytes())
        put_bytes(uri, f"ids-{r}", ids[order].astype("<i8").tobytes())
        return pa.table({"range": [r]})

    ordered.select("ids", "embedding").mapInArrow(number, "range long, node long, ids array<long>, embedding array<double>").groupBy("range").applyInArrow(write, "range long").count()
    return store


def _ranges(spark: SparkSession, store: Store) -> DataFrame:
    return spark.range(0, store.ranges, 1, store.ranges)


def descend(spark: SparkSession, store: Store, rounds: int = ROUNDS, settled: float = SETTLED) -> int:
    """Write the lists of rounds 0, 1, ... and give the last round's number."""
    n, k = store.n, store.k

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column("id").to_pylist():
                node = np.repeat(np.arange(r * WIDTH, r * WIDTH + store.size(r)), k + 4)
                j = np.tile(np.arange(k + 4), store.size(r))
                nbr = (mix((node * (k + 4) + j).astype(np.uint64)) % np.uint64(n)).astype(np.int64)
                if n <= k + 4:
                    nbr = j % n
                on = nbr != node
                node, nbr = node[on], nbr[on]
                score = np.concatenate([_exact(store, node[a : a + 65536], nbr[a : a + 65536]) for a in range(0, len(node), 65536)] or [np.zeros(0)])
                store.put_lists(0, r, *merge_lists(node - r * WIDTH, nbr, score, store.size(r), k))
                yield _batch(["n"], np.array([store.size(r)]))

    _ranges(spark, store).mapInArrow(start, "n long").count()

    def chance(node: np.ndarray, other: np.ndarray, i: int) -> np.ndarray:
        return (mix((node ^ (other << 24) ^ (i << 56)).astype(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53

    def reverse(i: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.column("id").to_pylist():
                    own = np.arange(r * WIDTH, r * WIDTH + store.size(r))
                    nbr, _ = store.lists(i, own)
                    node, other = np.repeat(own, k)[(on := nbr.ravel() >= 0)], nbr.ravel()[on]
                    if i:
                        kept = chance(node, other, i) * store.degrees(i - 1, other) < HUB
                        node, other = node[kept], other[kept]
                    # of the reverse edges of one node from this range, REVERSE are enough
                    order = np.lexsort((mix((node ^ (other << 20) ^ i).astype(np.uint64)), other))
                    to, by = other[order], node[order]
                    rank = np.arange(len(to)) - np.searchsorted(to, to)
                    to, by = to[rank < REVERSE], by[rank < REVERSE]
                    yield _batch(["range", "node", "nbr"], to // WIDTH, to, by)

        return run

    def join(i: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            r = left.column("range")[0].as_py()
            own = np.arange(r * WIDTH, r * WIDTH + store.size(r))
            near = np.full((store.size(r), k + REVERSE), -1, np.int64)
            near[:, :k] = store.lists(i, own)[0]
            node, nbr = right.column("node").to_numpy() - r * WIDTH, right.column("nbr").to_numpy()
            sent = np.bincount(node, minlength=store.size(r)).astype(np.float64)
            if i:
                sent /= np.minimum(1.0, HUB / np.maximum(store.degrees(i - 1, own), 1.0))
            put_bytes(store.uri, f"degree-{i}-{r}", sent.astype("<f4").tobytes())
            order = np.lexsort((mix((nbr ^ (node << 32) ^ i).astype(np.uint64)), node))
            node, nbr = node[order], nbr[order]
            rank = np.arange(len(node)) - np.searchsorted(node, node)
            on = rank < REVERSE
            near[node[on], k + rank[on]] = nbr[on]
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            got = list(propose(store, i, near))
            a, b, s = (np.concatenate(c) for c in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            return pa.table({"range": a // WIDTH, "node": a, "nbr": b, "score": s.astype(np.float64)}, schema=pa.schema([("range", pa.int64()), ("node", pa.int64()), ("nbr", pa.int64()), ("score", pa.float64())]))

        return run

    def merge(i: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            r = left.column("range")[0].as_py()
            own = np.arange(r * WIDTH, r * WIDTH + store.size(r))
            nbr, score = store.lists(i, own)
            on = nbr >= 0
            node = np.concatenate([np.repeat(own - r * WIDTH, k)[on.ravel()], right.column("node").to_numpy() - r * WIDTH])
            lists, held = merge_lists(node, np.concatenate([nbr[on], right.column("nbr").to_numpy()]), np.concatenate([score[on], right.column("score").to_numpy()]), store.size(r), k)
            store.put_lists(i + 1, r, lists, held)
            return pa.table({"changed": [int((lists != nbr).sum())]})

        return run

    for i in range(rounds):
        own = _ranges(spark, store).select(F.col("id").alias("range")).groupBy("range")
        back = _ranges(spark, store).mapInArrow(reverse(i), "range long, node long, nbr long")
        pairs = own.cogroup(back.groupBy("range")).applyInArrow(join(i), "range long, node long, nbr long, score double")
        changed = own.cogroup(pairs.groupBy("range")).applyInArrow(merge(i), "changed long").agg(F.sum("changed")).first()[0]
        release(spark)
        if changed <= settled * n * k:
            return i + 1
    return rounds


def walk(store: Store, i: int, node: int, want: int, beam: int = BEAM, entries: int = ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search from a node: the want nodes of highest inner product found, best first (double precision)."""
    q = store.small(np.array([node]))[0]
    start = np.unique(np.concatenate([[node], (mix(np.arange(entries, dtype=np.uint64) + np.uint64(node * 64)) % np.uint64(store.n)).astype(np.int64)]))
    held, score, open_ = start, store.small(start) @ q, np.ones(len(start), bool)
    seen = set(start.tolist())
    while open_.any():
        # the eight best nodes of the beam that are still closed are opened together
        pick = np.flatnonzero(open_)[:8] if len(held) > beam // 2 else np.flatnonzero(open_)[:2]
        open_[pick] = False
        found = np.unique(store.lists(i, held[pick])[0])
        fresh = np.array([x for x in found.tolist() if x >= 0 and x not in seen], np.int64)
        if not len(fresh):
            continue
        seen.update(fresh.tolist())
        held, score, open_ = np.concatenate([held, fresh]), np.concatenate([score, store.small(fresh) @ q]), np.concatenate([open_, np.ones(len(fresh), bool)])
        order = np.lexsort((held, -score))[:beam]
        held, score, open_ = held[order], score[order], open_[order]
    exact = store.vectors(held) @ store.vectors(np.array([node]))[0]
    order = np.lexsort((held, -exact))[:want]
    return held[order], exact[order]


def answer(store: Store, i: int, node: int, want: int, **options) -> tuple[np.ndarray, np.ndarray]:
    """The want smallest of (score down, id up) over the ids of the nodes found."""
    nodes, scores = walk(store, i, node, want, **options)
    ids = store.ids(nodes)
    flat, each = ids.ravel(), np.repeat(scores, ids.shape[1])
    flat, each = flat[(on := flat >= 0)], each[on]
    order = np.lexsort((flat, -each))[:want]
    return flat[order], each[order]


def nearest(table: DataFrame, k: int = TOP, every: int = EVERY, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by every, the k nearest found among all other rows."""
    spark = table.sparkSession
    whole = cut(valid_vectors(table, False))
    results = None
    for dim in dimensions(whole):
        vectors = whole.filter(F.size("embedding") == dim)
        ranked = vectors.withColumn("place", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
        nodes = ranked.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        store = build_store(spark, nodes, dim, neighbours, k + 1)
        last = descend(spark, store, rounds)

        def name(batches: Iterator[pa.RecordBatch], store: Store = store) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.column("id").to_pylist():
                    own = np.arange(r * WIDTH, r * WIDTH + store.size(r))
                    yield _batch(["node", "rep"], own, store.ids(own)[:, 0])

        def search(batches: Iterator[pa.RecordBatch], store: Store = store, last: int = last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [answer(store, last, node, k + 1, beam=beam) for node in batch.column("node").to_pylist()]
                lists = [pa.array([x.tolist() for x in col], pa.list_(kind)) for col, kind in zip(zip(*got), (pa.int64(), pa.float64()))] if got else [pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), *lists], ["rep", "ids", "scores"])

        # each query row's node by its class's smallest id
        reps = vectors.groupBy("embedding").agg(F.min("vec_id").alias("rep"))
        queries = cut(vectors.filter(F.col("vec_id") % every == 0).join(reps, "embedding").select(F.col("vec_id").alias("query_id"), "rep"))
        numbered = _ranges(spark, store).mapInArrow(name, "node long, rep long")
        wanted = numbered.join(queries.select("rep").distinct(), "rep", "left_semi").repartition(max(spark.sparkContext.defaultParallelism * 2, 12), "node")
        found = wanted.mapInArrow(search, "rep long, ids array<long>, scores array<double>")
        pairs = F.filter(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score")), lambda p: p["vec_id"] != F.col("query_id"))
        rows = queries.join(found, "rep").select("query_id", F.posexplode(F.slice(pairs, 1, k)).alias("at", "hit"))
        part = cut(rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")))
        drop_shared_dir(spark, store.uri)
        results = part if results is None else results.unionByName(part)
    if results is None:
        return spark.createDataFrame([], T.StructType().add("query_id", "long").add("rank", "integer").add("vec_id", "long").add("score", "double"))
    return results
