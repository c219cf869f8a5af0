"""A stored vector index: inverted lists by k-means cells with product-quantised residuals, exact scores for a shortlist.

Every usable row is in one list and has a code of a byte for each group of components. A search decodes the codes of a query's nearest cells, keeps a shortlist by approximate score, and scores that exactly on the stored vectors.
How many cells and how long a shortlist are measured when the index is built, against an exact search for a bounded sample of rows. Lists are cut into segments, so no row or task holds a whole cell however many rows share it.
"""

from __future__ import annotations

import uuid
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..sources.files import read_metadata, write_metadata
from ..sources.stages import materialise, with_places
from .blocks import HELD, QUERY_BLOCK, exact_top_k, kinds, largest, matrix, usable

#: Cells grow with the square root of the rows up to a bound; the cells and codes are fitted on a sample of some rows for each cell, every row is indexed.
MAX_CELLS, ROWS_PER_CELL, LEAST_SAMPLE = 4096, 64, 16384
CODES, GROUP, ROUNDS, SAMPLE_PARTS = 256, 4, 8, 16
#: Rows of a segment, about; sample rows that the build measures, and the share of their k nearest that cells and shortlist must each hold.
SEGMENT, PROBED, PROBED_K, TARGET = 65536, 128, 10, 0.98


class Model(NamedTuple):
    """cells: centres of the lists; codes: (groups, size, width) centres of residuals."""

    cells: np.ndarray
    codes: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = nearest(x, self.cells)
        rest = (x - self.cells[at]).reshape(len(x), len(self.codes), -1)
        return at, np.stack([nearest(rest[:, g], c) for g, c in enumerate(self.codes)], 1).astype(np.uint8)

    def decode(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        out, width = self.cells[at], self.codes.shape[2]
        for g, c in enumerate(self.codes):
            out[:, g * width : (g + 1) * width] += c[code[:, g]]
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, ties to the first."""
    half, step = (centres**2).sum(1) / 2, max(1, HELD // len(centres))
    parts = [(x[at : at + step] @ centres.T - half).argmax(1) for at in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, int)


def _sums(centres: np.ndarray, cells: np.ndarray | None, batches):
    """A partition's sums and counts by centre, of the vectors or of their residuals."""
    total, count = np.zeros(centres.shape), np.zeros(centres.shape[:2])
    for batch in batches:
        x = matrix(batch.column("embedding"))
        if not len(x):
            continue
        x = x if cells is None else x - cells[nearest(x, cells)]
        x = x.reshape(len(x), len(centres), -1)
        for g in range(len(centres)):
            at = nearest(x[:, g], centres[g])
            count[g] += np.bincount(at, minlength=centres.shape[1])
            for d in range(centres.shape[2]):
                total[g, :, d] += np.bincount(at, x[:, g, d], centres.shape[1])
    yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()], "counts": [count.tobytes()]})


def _refine(sample: DataFrame, centres: np.ndarray, cells: np.ndarray | None = None) -> np.ndarray:
    """Lloyd's rounds, each a pass over the sample's partitions; a centre without rows stays."""
    for _ in range(ROUNDS):
        parts = sample.select("embedding").mapInArrow(partial(_sums, centres, cells), "sums binary, counts binary").collect()  # SAMPLE_PARTS rows
        total = sum(np.frombuffer(r["sums"]).reshape(centres.shape) for r in parts)
        count = sum(np.frombuffer(r["counts"]).reshape(centres.shape[:2]) for r in parts)[..., None]
        centres = np.where(count > 0, total / np.maximum(count, 1), centres)
    return centres


def _firsts(sample: DataFrame, n: int) -> np.ndarray:
    return np.array([r[0] for r in sample.groupBy("embedding").agg(F.min("_h").alias("_h")).orderBy("_h").select("embedding").limit(n).collect()], float)


def fit(sample: DataFrame, n_cells: int, dimension: int) -> Model:
    """Cells and codes from a bounded sample (embedding, _h); first centres are its distinct vectors of smallest hash."""
    width = GROUP if dimension % GROUP == 0 else 1
    first = _firsts(sample, max(n_cells, CODES))
    if not len(first):
        return Model(np.zeros((1, dimension)), np.zeros((max(1, dimension // width), 1, width)))
    cells = _refine(sample, first[:n_cells][None])[0]
    rest = (first - cells[nearest(first, cells)])[:CODES].reshape(-1, dimension // width, width)
    return Model(cells, _refine(sample, np.ascontiguousarray(rest.transpose(1, 0, 2)), cells))


def _encode(model: Model, batches):
    for batch in batches:
        at, code = model.encode(matrix(batch.column("embedding"))) if batch.num_rows else (np.zeros(0, int), np.zeros((0, len(model.codes)), np.uint8))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], [*batch.schema.names, "cell", "code"])


def _write_part(rows: DataFrame, model: Model, path: str, key: str) -> tuple[str, int]:
    """Codes and vectors of the rows as one part of the index, read back and counted before anyone can see it."""
    part = f"part-{uuid.uuid4().hex}"
    rows = rows.select(key, "embedding")
    coded = materialise(rows.mapInArrow(partial(_encode, model), f"{kinds(rows, rows.columns)}, cell int, code binary"))
    sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / SEGMENT).alias("_n"))
    placed = coded.join(sizes, "cell").withColumn("segment", F.pmod(F.xxhash64(key, "embedding"), F.col("_n"))).drop("_n")
    placed.repartitionByRange("cell", "segment", key).sortWithinPartitions("cell", "segment").write.mode("errorifexists").parquet(f"{path}/{part}")
    written, wanted = rows.sparkSession.read.parquet(f"{path}/{part}").count(), coded.count()
    if written != wanted:
        raise OSError(f"part {part} holds {written} rows, not {wanted}")
    return part, written


def build(vectors: DataFrame, path: str, version: str, dimension: int, key: str = "vec_id", target: float = TARGET) -> dict:
    """Index vectors (key, embedding) under path and return the metadata, put in place by one rename when all rows are written and the recall is measured.

    Vectors that are null, of another dimension, or hold null or non-finite components are left out and counted. Sampled are rows by a hash of key and vector, min(rows, max(16384, 64 for each cell)) in expectation, 262,144 at most for 4096 cells;
    128 rows at most, drawn by another hash, are searched exactly to choose the cells a query reads and the shortlist. Exact copies of a row are each indexed.
    """
    spark = vectors.sparkSession
    marked = vectors.select(key, "embedding").withColumn("_ok", usable("embedding", dimension))
    total, n = marked.agg(F.count("*"), F.count_if("_ok")).first()
    rows = marked.filter("_ok").drop("_ok")
    cells = max(1, min(MAX_CELLS, round(n**0.5)))
    rate = min(1.0, max(LEAST_SAMPLE, ROWS_PER_CELL * cells) / max(1, n))
    hashed = rows.withColumn("_h", F.xxhash64(key, "embedding"))
    sample = materialise(hashed.filter(F.pmod("_h", F.lit(1 << 30)) < int(rate * (1 << 30))).coalesce(SAMPLE_PARTS))
    model = fit(sample, cells, dimension)
    part, written = _write_part(rows, model, path, key)
    spark.createDataFrame([("cells", list(model.cells.shape), model.cells.tobytes()), ("codes", list(model.codes.shape), model.codes.tobytes())], "name string, shape array<int>, data binary").write.mode("errorifexists").parquet(f"{path}/model-{part}")
    probes, shortlist, measured = _measure(spark.read.parquet(f"{path}/{part}"), written, model, key, target)
    metadata = {
        "index_version": version, "dimension": dimension, "key": key, "cells": len(model.cells), "model": f"model-{part}", "parts": [part], "indexed_rows": written, "left_out": total - n,
        "probes": probes, "shortlist": shortlist, "sample_recall": measured,
    }
    write_metadata(spark, f"{path}/metadata.json", metadata)
    return metadata


def _ranks(model: Model, asked: np.ndarray, bars: np.ndarray, batches):
    """How many rows of a partition pass each of a query's bars by approximate score."""
    count = np.zeros(bars.shape, np.int64)
    for batch in batches:
        if batch.num_rows:
            x = model.decode(batch.column("cell").to_numpy(), _codes(batch.column("code")))
            for at in range(0, len(x), max(1, HELD // len(asked))):
                scores = np.sort(x[at : at + max(1, HELD // len(asked))] @ asked.T, 0)
                count += np.stack([len(scores) - np.searchsorted(scores[:, q], bars[q], "right") for q in range(len(asked))])
    yield pa.RecordBatch.from_pydict({"counts": [count.tobytes()]})


def _codes(column) -> np.ndarray:
    """Codes as rows of bytes."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(array.to_pylist()), np.uint8).reshape(len(array), -1)


def _measure(rows: DataFrame, n: int, model: Model, key: str, target: float) -> tuple[int, int, float]:
    """The cells to read and the shortlist that each keep this share of the nearest rows of some sample rows, and the share both keep."""
    # drawn from all rows by a hash of its own: the first rows of the fitted sample are first centres, and nearer to their cells than others
    hashed = rows.select(key, "embedding", F.xxhash64(key, "embedding", F.lit("probe")).alias("_h"))
    drawn = hashed.filter(F.pmod("_h", F.lit(1 << 30)) < int(min(1.0, 8 * PROBED / max(1, n)) * (1 << 30))).orderBy("_h").limit(PROBED)
    asked = materialise(drawn.select(F.monotonically_increasing_id().alias("query_id"), F.col("embedding").alias("query_vector"), F.col(key).alias("_own")))
    found = exact_top_k(rows.select(F.col(key).alias("vec_id"), "cell", "code", "embedding"), asked.select("query_id", "query_vector"), PROBED_K + 1, cosine_scale=False)
    others = found.join(asked.select("query_id", "_own"), "query_id").filter(~F.col("vec_id").eqNullSafe(F.col("_own")))
    near = others.filter(F.col("rank") <= PROBED_K + 1).select("query_id", "cell", "code").collect()  # PROBED * (PROBED_K + 1) rows at most
    if not near:
        return 1, PROBED_K, 1.0
    held = asked.orderBy("query_id").collect()  # PROBED rows
    ids = {r["query_id"]: i for i, r in enumerate(held)}
    q = np.array([r["query_vector"] for r in held], float)
    place = np.argsort(np.argsort(-(q @ model.cells.T), 1, "stable"), 1)
    of = np.array([ids[r["query_id"]] for r in near])
    cell_rank = place[of, [r["cell"] for r in near]] + 1
    approx = (model.decode(np.array([r["cell"] for r in near]), np.stack([np.frombuffer(r["code"], np.uint8) for r in near])) * q[of]).sum(1)
    nth = np.array([(of[:i] == o).sum() for i, o in enumerate(of)])
    bars = np.full((len(q), nth.max() + 1), np.inf)
    bars[of, nth] = approx + 1e-12
    counts = rows.select("cell", "code").mapInArrow(partial(_ranks, model, q, bars), "counts binary")
    merged = counts.rdd.map(lambda r: np.frombuffer(r["counts"], np.int64)).treeReduce(np.add).reshape(bars.shape)
    row_rank = merged[of, nth] + 1
    probes, shortlist = (int(np.quantile(r, target, method="higher")) for r in (cell_rank, row_rank))
    return probes, shortlist, float(((cell_rank <= probes) & (row_rank <= shortlist)).mean())


def open_index(spark: SparkSession, path: str, version: str) -> tuple[dict, Model, DataFrame]:
    """Metadata, model (bounded by MAX_CELLS) and rows of all parts; an error if the index has another version."""
    metadata = read_metadata(spark, f"{path}/metadata.json")
    if metadata.get("index_version") != version:
        raise ValueError(f"the index has version {metadata.get('index_version')}, not {version}")
    stored = {r["name"]: np.frombuffer(r["data"]).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/{metadata['model']}").collect()}  # two rows
    return metadata, Model(stored["cells"], stored["codes"]), spark.read.parquet(*(f"{path}/{p}" for p in metadata["parts"]))


def append(vectors: DataFrame, path: str, version: str) -> dict:
    """Add rows as a further part, coded by the stored cells, without touching those there; metadata with appended, known and left_out of this call.

    Rows whose key is indexed already are known and stay as they were; unusable ones are left out, and so are rows without a key. One writer at a time; readers see the parts before or after.
    """
    metadata, model, rows = open_index(vectors.sparkSession, path, version)
    key = metadata["key"]
    marked = materialise(vectors.select(key, "embedding").withColumn("_ok", usable("embedding", metadata["dimension"]) & F.col(key).isNotNull()))
    fresh = materialise(marked.filter("_ok").drop("_ok").join(rows.select(key), key, "left_anti"))
    total, ok = marked.agg(F.count("*"), F.count_if("_ok")).first()
    part, written = _write_part(fresh, model, path, key)
    metadata = metadata | {"parts": [*metadata["parts"], part], "indexed_rows": metadata["indexed_rows"] + written}
    write_metadata(vectors.sparkSession, f"{path}/metadata.json", metadata)
    return metadata | {"appended": written, "known": ok - written, "left_out": total - ok}


def _probe(model: Model, n: int, batches):
    for batch in batches:
        if batch.num_rows:
            scores = matrix(batch.column("query_vector")) @ model.cells.T
            cells = np.argsort(-scores, 1, "stable")[:, :n]
            row = np.repeat(np.arange(batch.num_rows), cells.shape[1])
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells.ravel().astype(np.int32))], [*batch.schema.names, "cell"])


def _shortlist(model: Model, k: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """The best rows of a region for each query, by approximate score, of the cells that the query reads."""
    right = right.sort_by("vec_id")
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    if left.num_rows and right.num_rows:
        q, at = matrix(left.column("query_vector")), right.column("at").to_numpy()
        x = model.decode(at, _codes(right.column("code")))
        own = left.column("cells").combine_chunks()
        reads = np.zeros((len(q), len(model.cells)), bool)
        reads[np.repeat(np.arange(len(q)), own.value_lengths().to_numpy()), own.flatten().to_numpy()] = True
        step = max(1, HELD // len(x))
        for begin in range(0, len(q), step):
            scores = np.where(reads[begin : begin + step][:, at].T, np.round(x @ q[begin : begin + step].T, 9), -np.inf)
            row, query = largest(scores, k)
            on = np.isfinite(scores[row, query])
            found.append((row[on], query[on] + begin, scores[row[on], query[on]]))
    row, query, score = (np.concatenate(part) for part in zip(*found))
    return pa.table({"query_id": left.column("query_id").take(pa.array(query)), "vec_id": right.column("vec_id").take(pa.array(row)), "approx": score})


def search(spark: SparkSession, path: str, version: str, queries: DataFrame, k: int, probes: int | None = None, shortlist: int | None = None, exact: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank: each query's (query_id, query_vector) k nearest rows found, scores as exact_top_k() gives them on the stored vectors.

    probes and shortlist default to what the build measured, the shortlist to 4 k at least. exact, and queries whose cells hold fewer than k rows, go over all rows in blocks. Unusable queries take no part.
    """
    metadata, model, rows = open_index(spark, path, version)
    key, dimension = metadata["key"], metadata["dimension"]
    asked = materialise(queries.select("query_id", "query_vector").filter(usable("query_vector", dimension)))
    stored = rows.select(F.col(key).alias("vec_id"), "embedding")
    if exact:
        return exact_top_k(stored, asked, k)
    n = min(len(model.cells), probes or metadata["probes"])
    kept = max(4 * k, shortlist or metadata["shortlist"])
    slices = max(1, -(-asked.count() // QUERY_BLOCK))
    codes = rows.select(F.col(key).alias("vec_id"), F.col("cell").alias("at"), "segment", "code")
    # segments are joined up to regions of about SEGMENT rows, so a query gets one shortlist from many small cells
    segments = codes.groupBy("at", "segment").agg(F.count("*").alias("held"))
    regions = materialise(with_places(segments, ["at", "segment"], sums={"upto": "held"}).select("at", "segment", "held", F.expr(f"(upto - 1) div {SEGMENT}").alias("region")))
    pairs = asked.mapInArrow(partial(_probe, model, n), f"{kinds(asked, asked.columns)}, cell int").select("query_id", "cell")
    read = pairs.join(regions, F.col("cell") == F.col("at")).groupBy("query_id", "region").agg(F.collect_set("cell").alias("cells"), F.sum("held").alias("held"))
    read = materialise(read.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices))))
    left = read.join(asked, "query_id").select("query_id", "query_vector", "cells", F.col("region").alias("of"), "slice")
    met = read.select("region", F.col("slice").alias("part")).distinct()
    right = codes.join(regions.drop("held"), ["at", "segment"]).drop("segment").join(met, "region")
    schema = f"{kinds(asked, ['query_id'])}, vec_id {codes.schema['vec_id'].dataType.simpleString()}, approx double"
    near = left.groupBy("of", "slice").cogroup(right.groupBy("region", "part")).applyInArrow(partial(_shortlist, model, kept), schema)
    first = Window.partitionBy("query_id").orderBy(F.desc("approx"), "vec_id")
    chosen = near.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= kept).select("query_id", "vec_id").distinct()
    product = F.aggregate(F.zip_with("query_vector", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    scored = chosen.join(stored, "vec_id").join(asked, "query_id").select("query_id", "vec_id", F.round((1 + product) / 2, 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    full = read.groupBy("query_id").agg(F.sum("held").alias("held")).filter(F.col("held") >= min(k, metadata["indexed_rows"])).select("query_id")
    short = materialise(asked.join(full, "query_id", "left_anti"))
    if short.isEmpty():
        return found
    return found.join(full, "query_id", "left_semi").unionByName(exact_top_k(stored, short, k))
