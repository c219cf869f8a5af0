"""Products of a stated set of vectors with all rows, a block of one against a block of the other: matrix products in place of a cross join of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.stages import materialise

#: Rows and queries of a block, about; numbers of its rows' vectors, so that blocks of long vectors hold fewer rows; scores held at once in a task.
ROW_BLOCK, QUERY_BLOCK, VALUES, HELD = 65536, 2048, 1 << 21, 1 << 20


def usable(vector: str, dimension: int) -> Column:
    """Whether a vector has this dimension and only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimension) & finite, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors of one length, in double precision."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(array):
        return np.zeros((0, 0))
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), -1)


def largest(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each column's k largest scores; of equal ones those that stand first."""
    if len(scores) <= k:
        row, column = np.indices(scores.shape).reshape(2, -1)
        return row, column
    kth = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
    above, equal = scores > kth, scores == kth
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=0) <= k - above.sum(0))))


def best_of(rows: np.ndarray, queries: np.ndarray, k: int, finish: Callable = lambda s: np.round(s, 9)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, score) of each query's k best rows by inner product, some queries at a time."""
    step, found = max(1, HELD // max(1, len(rows))), []
    for at in range(0, len(queries), step):
        scores = finish(rows @ queries[at : at + step].T)
        row, column = largest(scores, k)
        found.append((row, column + at, scores[row, column]))
    return tuple(np.concatenate(part) for part in zip(*found))


def block_rows(dimension: int) -> int:
    """Rows of a block of vectors of this dimension: a task's memory depends neither on it nor on the table."""
    return max(1, min(ROW_BLOCK, VALUES // max(1, dimension)))


def paired(rows: DataFrame, queries: DataFrame, kernel: Callable, schema: str, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """kernel(queries, rows) for each pair of a block of queries and a block of rows. Blocks go by a hash of the whole row, so a key or vector that many rows share is spread unless all columns agree."""
    r, q = (max(1, -(-df.count() // size)) for df, size in ((rows, row_block), (queries, query_block)))
    spread = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_q", spread(queries, q)).withColumn("_r", every(r))
    right = rows.withColumn("_r", spread(rows, r)).withColumn("_q", every(q))
    return left.groupBy("_r", "_q").cogroup(right.groupBy("_r", "_q")).applyInArrow(kernel, schema)


def kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _best(k: int, cosine_scale: bool, carried: list[str], left: pa.Table, right: pa.Table) -> pa.Table:
    right = right.sort_by("vec_id")
    if left.num_rows and right.num_rows:
        finish = lambda s: np.round((1 + s) / 2 if cosine_scale else s, 9)
        row, query, score = best_of(matrix(right.column("embedding")), matrix(left.column("query_vector")), k, finish)
    else:
        row, query, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    taken = right.select(carried).take(pa.array(row))
    return pa.table({"query_id": left.column("query_id").take(pa.array(query)), **{c: taken.column(c) for c in carried}, "score": score})


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, cosine_scale: bool = True) -> DataFrame:
    """query_id, vec_id, the other columns of vectors, score, rank: each query's k best rows of vectors (vec_id, embedding), ties to the smaller vec_id.

    Scores are inner products, or (1 + product) / 2, to nine places. Vectors that are null, hold null or non-finite components, or differ in dimension from the queries' longest take no part. Only a block's k best for a query leave a task.
    """
    dimension = queries.agg(F.max(F.size("query_vector"))).first()[0] or 0
    carried = [c for c in vectors.columns if c != "embedding"]
    asked = queries.select("query_id", "query_vector").filter(usable("query_vector", dimension))
    schema = f"{kinds(asked, ['query_id'])}, {kinds(vectors, carried)}, score double"
    scored = paired(vectors.filter(usable("embedding", dimension)), asked, partial(_best, k, cosine_scale, carried), schema, block_rows(dimension))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _maxima(left: pa.Table, right: pa.Table) -> pa.Table:
    if not (left.num_rows and right.num_rows):
        return pa.table({"own": pa.array([], pa.bool_()), "id": pa.array([], pa.string()), "m": pa.array([], pa.float64())})
    a, b = matrix(left.column("a")), matrix(right.column("b"))
    mine, other = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
    step = max(1, HELD // len(b))
    for at in range(0, len(a), step):
        s = a[at : at + step] @ b.T
        mine[at : at + step] = s.max(1)
        np.maximum(other, s.max(0), out=other)
    ids = pa.concat_arrays([t.column(c).combine_chunks() for t, c in ((left, "i"), (right, "j"))])
    return pa.table({"own": np.arange(len(ids)) < len(a), "id": ids, "m": np.concatenate([mine, other])})


def mean_best(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """precision, recall, f1 (one row): the best inner product of each predicted item (i, a) and of each gold one (j, b), averaged both ways.

    A pair of blocks gives the maxima of its rows and columns; running maxima are merged by partial aggregates. Unusable vectors take no part (see exact_top_k); with an empty side precision and recall are null and f1 is 0.
    """
    dimension = predicted.agg(F.max(F.size("a"))).first()[0] or 0
    left = predicted.select(F.col("i").cast("string").alias("i"), "a").filter(usable("a", dimension))
    right = gold.select(F.col("j").cast("string").alias("j"), "b").filter(usable("b", dimension))
    maxima = paired(right, left, _maxima, "own boolean, id string, m double", block_rows(dimension)).groupBy("own", "id").agg(F.max("m").alias("m"))
    p, r = (F.avg(F.when(F.col("own") == side, F.col("m"))) for side in (True, False))
    sums = maxima.agg(p.alias("p"), r.alias("q"))
    f1 = F.when(F.col("p") + F.col("q") > 0, 2 * F.col("p") * F.col("q") / (F.col("p") + F.col("q"))).otherwise(0.0)
    return sums.select(F.round("p", 6).alias("precision"), F.round("q", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def _scores(left: pa.Table, right: pa.Table, dimension: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Scores of all rows for some queries at a time; minus infinity for null, infinity for no number, as both stand in an order by falling score."""
    parts = []
    for table, name in ((right, "embedding"), (left, "query_vector")):
        column = table.column(name).combine_chunks()
        there = column.is_valid().to_numpy(zero_copy_only=False)
        whole = np.zeros((len(column), dimension))
        whole[there] = matrix(column.drop_null()).reshape(-1, dimension)
        parts.append((whole, there))
    (rows, row_there), (queries, query_there) = parts
    step = max(1, HELD // max(1, len(rows)))
    for at in range(0, len(queries), step):
        some = slice(at, at + step)
        with np.errstate(invalid="ignore"):
            scores = np.nan_to_num(np.round(rows @ queries[some].T, 9), nan=np.inf, posinf=np.inf, neginf=-np.inf)
        scores[~row_there] = -np.inf
        scores[:, ~query_there[some]] = -np.inf
        yield some, scores


def _ranked(k: int, dimension: int, left: pa.Table, right: pa.Table) -> pa.Table:
    right = right.sort_by("vec_id")
    ids, asked = right.column("vec_id").to_numpy(), left.column("query_id").to_numpy()
    codes = pa.chunked_array([*right.column("label").chunks, *left.column("label").chunks], right.column("label").type).combine_chunks().dictionary_encode().indices
    codes = pc.fill_null(codes, -1).to_numpy(zero_copy_only=False)
    kinds, wanted = codes[: len(ids)], np.where(codes[len(ids) :] < 0, -2, codes[len(ids) :])
    spare = int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else 0
    out = {c: [] for c in ("query_id", "vec_id", "score", "gain", "n")}

    def give(query, vec, score, gain, n):
        for c, v in zip(out, (query, vec, score, gain, n)):
            out[c].append(v)

    for some, scores in _scores(left, right, dimension) if len(ids) else ():
        own = asked[some]
        row, column = largest(scores, k + spare)
        other = ids[row] != own[column]
        row, column = row[other], column[other]
        give(own[column], ids[row], scores[row, column], (kinds[row] == wanted[some][column]).astype(np.int32), np.full(len(row), -1))
        relevant = (kinds[:, None] == wanted[some]) & (ids[:, None] != own)
        n = relevant.sum(0)
        best = np.where(relevant, scores, -np.inf)
        at = np.where(best.max(0) > -np.inf, best.argmax(0), relevant.argmax(0))
        give(own, ids[at], scores[at, np.arange(len(own))], np.ones(len(own), np.int32), n)
    types = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64, "gain": np.int32, "n": np.int64}
    return pa.table({c: np.concatenate(v).astype(types[c]) if v else np.zeros(0, types[c]) for c, v in out.items()})


def _above(dimension: int, left: pa.Table, right: pa.Table) -> pa.Table:
    ids, asked = right.column("vec_id").to_numpy(), left.column("query_id").to_numpy()
    score, first = left.column("at_score").to_numpy(), left.column("at_id").to_numpy()
    found = np.zeros(len(asked), np.int64)
    for some, scores in _scores(left, right, dimension) if len(ids) else ():
        before = (scores > score[some]) | ((scores == score[some]) & (ids[:, None] < first[some]))
        found[some] = (before & (ids[:, None] != asked[some]) & (ids[:, None] != first[some])).sum(0)
    return pa.table({"query_id": asked.astype(np.int64), "above": found})


def ranked_labels(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The two tables of metrics.ranking_metrics() for queries (query_id, query_vector, label) against all vectors (vec_id, embedding, label) but those of the query's id, relevant if labels are equal.

    Scores are inner products to nine places; a vector that is null, holds nulls or differs in dimension from the queries' longest has none and stands last. A block gives a query's k best, its number of relevant
    rows and the first of them; only for queries without a relevant row among their k best a second pass counts the rows before the first.
    """
    dimension = queries.agg(F.max(F.size("query_vector"))).first()[0] or 0
    whole = lambda c: F.when((F.size(c) == dimension) & F.forall(c, lambda x: x.isNotNull()), F.col(c))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole("embedding").alias("embedding"), "label")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), whole("query_vector").alias("query_vector"), "label")
    found = materialise(paired(rows, asked, partial(_ranked, k, dimension), "query_id long, vec_id long, score double, gain int, n long", block_rows(dimension)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = materialise(found.filter("n < 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "gain"))
    seen = found.filter("n >= 0").groupBy("query_id").agg(F.sum("n").alias("n_relevant"), F.max(F.when(F.col("n") > 0, F.struct("score", -F.col("vec_id")))).alias("at"))
    seen = seen.join(top.filter("gain > 0").groupBy("query_id").agg(F.min("rank").alias("near")), "query_id", "left")
    far = seen.filter("near IS NULL AND n_relevant > 0").select("query_id", F.col("at.score").alias("at_score"), (-F.col("at.col2")).alias("at_id"))
    above = paired(rows.drop("label"), asked.drop("label").join(far, "query_id"), partial(_above, dimension), "query_id long, above long", block_rows(dimension)).groupBy("query_id").agg(F.sum("above").alias("above"))
    relevant = seen.join(above, "query_id", "left")
    first = F.when(F.col("n_relevant") > 0, F.coalesce("near", F.col("above") + 1))
    return top, relevant.select("query_id", "n_relevant", first.alias("first"), F.array_repeat(F.lit(1), F.least(F.lit(k), F.col("n_relevant")).cast("int")).alias("ideal"))
