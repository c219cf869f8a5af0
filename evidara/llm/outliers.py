"""Quality rules with robust multivariate outliers: minimum-covariance-determinant estimates for each language and source.

Plain counts of whole texts give the base rules. Of the documents that pass them, a vector of eight transformed statistics is compared with the others of its language and source: the minimum-covariance-determinant estimate is
the centre and covariance of that share SHARE of the vectors whose covariance has the least determinant, found by concentration steps from two robust starts (quartiles; spatial signs) and
reweighted once; a document whose squared Mahalanobis distance is over CUTOFF is rejected.

All distinct vectors take part, to three decimals, each once: a group of copies can't become the model. They are packed once in blocks of BLOCK vectors, by range of group, so that a task knows few groups; a group of any size is many blocks.
A concentration step is one pass over the blocks: distances fall into bins of a fixed logarithmic scale, each with its sums of values and products, and the nearest bins, the last in part, make the share.
Estimates stay in a table, joined to the blocks; these and the list of groups are broadcast only if their number has been counted and is at most BROADCAST_GROUPS, and else joined by shuffle.

Groups of fewer than LEAST distinct vectors are pooled by language, and such pools over all; where all of these together are fewer, nothing is rejected. FLOOR is added to each covariance's diagonal, so that constant statistics
have a spread of their own.

Defined cases: null, empty and blank texts have counts zero and fail the base rules; null languages and sources are groups of their own; rows without doc_id and rows that repeat a doc_id are judged each; labels are not
read, nor other columns; an empty table gives no rows. Windows and lines are told by 64-bit hashes within a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytescan import raw_bytes, scan, xxh64
from .common import cut, slices

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_upper", "n_marked", "n_distinct")
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SHARE = 0.6
LEAST = 50
BLOCK = 1024
STEPS = 12
#: Steps end when no group's log determinant moves by more.
SETTLED = 1e-3
CUTOFF = 150.0
BROADCAST_GROUPS = 20_000
#: The statistics' least spread, in the order of vectors().
FLOOR = np.array([0.3, 0.05, 0.25, 0.15, 0.15, 0.25, 0.25, 0.1])
D = len(FLOOR)
_TRI = np.triu_indices(D)
_SUMS = 1 + D + len(_TRI[0])
# Bins of squared distances, a factor of 2 ** (1 / 4) each, and of values for the quartiles.
_EDGES = 2.0 ** np.arange(-8, 10, 0.25)
_GRID = np.linspace(-2.0, 20.0, 441)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _again(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which (text, key) occur more than once, and which of them are not the first."""
    order = np.lexsort((key, doc))  # stable: equal ones stay in order
    many, later = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    if len(doc) > 1:
        same = (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])
        later[order[1:]] = same
        many[order[1:]] = same
        many[order[:-1]] |= same
    return many, later


def rule_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and the other counts that vectors() takes, of each text."""
    raw, offsets = raw_bytes(texts)
    n = len(offsets) - 1
    out = {c: np.zeros(n, np.int64) for c in (*COUNTS, *_MORE)}
    w = scan(texts, fold=False)
    if not len(w.starts):
        return out
    per = lambda doc, at=None: np.bincount(doc if at is None else doc[at], minlength=n).astype(np.int64)
    of = np.repeat(np.arange(n), np.diff(offsets))
    home = np.repeat(w.doc, w.ends - w.starts)
    # bytes of words, one space between two: what is not a space there and does not continue a character is a code point
    chars = w.buf[np.flatnonzero(w.buf != 0x20)]
    out["n_words"], out["word_chars"], out["n_symbols"] = w.counts.astype(np.int64), per(home, (chars & 0xC0) != 0x80), per(of, _SYMBOL[raw])
    accented = np.zeros(len(raw), bool)
    accented[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    out["n_upper"], out["n_marked"] = per(of, _UPPER[raw] | accented), per(w.doc, ~_LETTER[w.buf[w.ends - 1]])
    hashes = xxh64(w.buf, w.starts, w.ends)
    out["n_distinct"] = w.counts - per(w.doc, _again(w.doc, hashes)[1])
    if len(hashes) >= WINDOW:
        last = len(hashes) - WINDOW + 1
        with np.errstate(over="ignore"):
            window = np.zeros(last, np.uint64)
            for k in range(WINDOW):
                x = (window ^ hashes[k : k + last]) * np.uint64(0x9E3779B97F4A7C15)
                window = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        whole = np.flatnonzero(w.doc[:last] == w.doc[WINDOW - 1 :])
        found = whole[_again(w.doc[whole], window[whole])[0]]
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, found, 1)
        np.add.at(cover, found + WINDOW, -1)
        out["n_repeat_words"] = per(w.doc, np.cumsum(cover[:-1]) > 0)
    # lines with a word: from a text's begin or behind a line feed to the next
    feeds = np.flatnonzero(raw == 0x0A)
    begin = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    begin = begin[begin < len(raw)]
    text = np.searchsorted(offsets, begin, side="right") - 1
    end = np.minimum(np.append(begin[1:], len(raw)), offsets[text + 1])
    end = end - ((end > begin) & (raw[np.maximum(end - 1, 0)] == 0x0A))
    solid = np.concatenate([[0], np.cumsum(~np.isin(raw, (0x20, 9, 10, 11, 12, 13)))])
    on = np.flatnonzero(solid[end] > solid[begin])
    out["n_lines"] = per(text, on)
    out["n_dup_lines"] = per(text[on], _again(text[on], xxh64(raw, begin[on], end[on]))[1])
    return out


def vectors(c: dict[str, np.ndarray]) -> np.ndarray:
    """A row of D transformed statistics of each document: logarithms of sizes and of scaled shares, to three decimals."""
    words, chars, lines = (np.maximum(c[k], 1).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    columns = [
        np.log1p(words), np.log(chars / words), np.log1p(200 * c["n_symbols"] / chars), np.log1p(20 * c["n_upper"] / chars), np.log1p(5 * c["n_marked"] / words),
        np.log1p(20 * c["n_dup_lines"] / lines), np.log1p(20 * c["n_repeat_words"] / words), np.log(words / np.maximum(c["n_distinct"], 1)),
    ]
    return np.round(np.column_stack(columns), 3)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed, v (the vector as doubles) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            c = rule_counts(part.column("text"))
            v = [x.tobytes() for x in np.ascontiguousarray(vectors(c), "<f8")]
            names = ["doc_id", "lang", "source", *COUNTS, "v"]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in names[:3]), *(pa.array(c[k]) for k in COUNTS), pa.array(v, pa.binary())], names)

    read = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    rows = read.mapInArrow(run, f"doc_id long, lang string, source string, {', '.join(f'{c} long' for c in COUNTS)}, v binary")
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def chi_square(x: float, k: int) -> float:
    """Distribution function of chi square for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - np.exp(-x / 2) * total


def chi_square_point(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        low, high = ((low + high) / 2, high) if chi_square((low + high) / 2, k) < p else (low, (low + high) / 2)
    return low


@dataclass
class Estimate:
    centre: np.ndarray
    spread: np.ndarray
    log_det: float

    def pack(self) -> bytes:
        return np.concatenate([self.centre, self.spread[_TRI], [self.log_det]]).astype("<f8").tobytes()

    @classmethod
    def read(cls, data: bytes) -> Estimate:
        x = np.frombuffer(data, "<f8")
        return cls.of(x[:D], x[D:-1])

    @classmethod
    def of(cls, centre: np.ndarray, upper: np.ndarray) -> Estimate:
        spread = np.zeros((D, D))
        spread[_TRI] = upper
        spread += np.triu(spread, 1).T
        return cls(np.asarray(centre), spread, float(np.linalg.slogdet(spread)[1]))

    def distances(self, x: np.ndarray) -> np.ndarray:
        y = np.linalg.solve(np.linalg.cholesky(self.spread), (x - self.centre).T)
        return (y**2).sum(0)


def from_sums(s: np.ndarray, factor: float = 1.0) -> Estimate:
    """The estimate of weighted sums 1, x and x x'; factor scales the covariance before FLOOR is added."""
    centre = s[1 : D + 1] / s[0]
    upper = factor * (s[D + 1 :] / s[0] - np.outer(centre, centre)[_TRI])
    return Estimate.of(centre, upper + np.diag(FLOOR**2)[_TRI])


def weighted_sums(x: np.ndarray, bins: np.ndarray, n: int) -> np.ndarray:
    """Sums of 1, x and x x' in each of n bins."""
    terms = np.column_stack([np.ones(len(x)), x, x[:, _TRI[0]] * x[:, _TRI[1]]])
    out = np.zeros((n, _SUMS))
    np.add.at(out, bins, terms)
    return out


def nearest_share(sums: np.ndarray, share: float = SHARE) -> np.ndarray:
    """The sums over the nearest share of rows: whole bins, and of the last one a part."""
    n = sums[:, 0]
    take = np.clip(share * n.sum() - (np.cumsum(n) - n), 0, n)
    return (sums * (take / np.maximum(n, 1))[:, None]).sum(0)


def _quartiles(histogram: np.ndarray) -> np.ndarray:
    """First, second and third quartile of each statistic from its counts on _GRID."""
    total = np.cumsum(histogram.reshape(D, -1), 1)
    mid = np.append(_GRID, _GRID[-1]) - (_GRID[1] - _GRID[0]) / 2
    return np.array([[mid[np.searchsorted(t, q * t[-1])] for t in total] for q in (0.25, 0.5, 0.75)])


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_GROUPS else df


def _with_group(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """rows with g and size of their (lang, source); rows of no group have neither. n: the rows of groups."""
    of = groups.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "g", "size")
    on = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    return rows.join(_small(of, n), on, "left").drop("of_lang", "of_source")


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Blocks (g, vs: distinct vectors), the groups (lang, source, g, size) and their number."""
    distinct = cut(rows.filter("NOT base_failed").select("lang", "source", "v").distinct())
    own = distinct.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.col("n") < LEAST
    pools = own.filter(small).groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("pool"))
    level = F.when(~small, 0).when(F.col("pool") >= LEAST, 1).otherwise(2)
    key = F.struct(level.alias("level"), F.when(level < 2, F.col("lang")).alias("lang"), F.when(level < 1, F.col("source")).alias("source"))
    named = cut(own.join(pools, F.col("lang").eqNullSafe(F.col("of")), "left").select("lang", "source", "n", F.to_json(key).alias("g")))
    sizes = named.groupBy("g").agg(F.sum("n").alias("size")).filter(F.col("size") >= LEAST)
    groups = cut(named.join(sizes, "g").select("lang", "source", "g", "size"))
    n = groups.count()
    bucket = F.pmod(F.xxhash64("v"), F.ceil(F.col("size") / BLOCK))
    placed = _with_group(distinct, groups, n).filter("g IS NOT NULL").groupBy("g", bucket.alias("bucket")).agg(F.collect_list("v").alias("vs"))
    return cut(placed.repartitionByRange("g", "bucket").select("g", "vs")), groups, n


def _pass(blocks: DataFrame, models: DataFrame, n_models: int, size: int, look, settle) -> DataFrame:
    """One pass over the blocks: look(vectors, model) gives size sums, which are added up for each (g, start), and settle(sums, start, model) makes the estimates by start of them."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], list] = {}

        def flush() -> pa.RecordBatch:
            keys = list(total)
            columns = [pa.array([g for g, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.int32()), pa.array([total[k][0] for k in keys], pa.binary()), pa.array([total[k][1].tobytes() for k in keys], pa.binary())]
            total.clear()
            return pa.RecordBatch.from_arrays(columns, ["g", "start", "model", "sums"])

        for batch in batches:
            for g, start, model, block in zip(*(batch.column(c).to_pylist() for c in ("g", "start", "model", "vs"))):
                found = look(np.frombuffer(b"".join(block), "<f8").reshape(-1, D), model)
                if (g, start) in total:
                    total[g, start][1] += found
                else:
                    total[g, start] = [model, found]
                if len(total) > 200:
                    yield flush()
        yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, model = None, None, b""  # rows come sorted
        for batch in batches:
            for g, start, m, sums in zip(*(batch.column(c).to_pylist() for c in ("g", "start", "model", "sums"))):
                if (g, start) != key:
                    if key is not None:
                        yield made(key, total, model)
                    key, total, model = (g, start), np.zeros(size), m
                total += np.frombuffer(sums)
        if key is not None:
            yield made(key, total, model)

    def made(key: tuple[str, int], total: np.ndarray, model: bytes) -> pa.RecordBatch:
        found = settle(total, key[1], model)
        columns = [pa.array([key[0]] * len(found)), pa.array(list(found), pa.int32()), pa.array([m.pack() for m in found.values()], pa.binary()), pa.array([m.log_det for m in found.values()])]
        return pa.RecordBatch.from_arrays(columns, ["g", "start", "model", "log_det"])

    sums = blocks.join(_small(models, n_models), "g").mapInArrow(part, "g string, start int, model binary, sums binary")
    return cut(sums.repartition("g").sortWithinPartitions("g", "start").mapInArrow(merge, "g string, start int, model binary, log_det double"))


def _start_looks(share: float):
    """The steps that lead to the two starts: quartiles of each statistic, then the covariance of spatial signs about the medians."""

    def histogram(x: np.ndarray, _: bytes) -> np.ndarray:
        wide = len(_GRID) + 1
        at = np.searchsorted(_GRID, x, side="right") + np.arange(D) * wide
        return np.bincount(at.reshape(-1), minlength=D * wide).astype(float)

    def quartile_model(sums: np.ndarray, start: int, _: bytes) -> dict[int, Estimate]:
        low, mid, high = _quartiles(sums)
        return {start: Estimate.of(mid, np.diag(((high - low) / 1.349) ** 2 + FLOOR**2)[_TRI])}

    def signs(x: np.ndarray, model: bytes) -> np.ndarray:
        e = Estimate.read(model)
        z = (x - e.centre) / np.sqrt(np.diag(e.spread))
        z = z / np.maximum(np.sqrt((z**2).sum(1)), 1e-9)[:, None]
        return np.concatenate([[len(x)], (z.T @ z)[_TRI]])

    def sign_model(sums: np.ndarray, _: int, model: bytes) -> dict[int, Estimate]:
        e = Estimate.read(model)
        shape, scale = np.zeros((D, D)), np.sqrt(np.diag(e.spread))
        shape[_TRI] = sums[1:] / sums[0] * D
        shape += np.triu(shape, 1).T
        return {0: e, 1: Estimate.of(e.centre, (shape * np.outer(scale, scale) + np.diag(FLOOR**2))[_TRI])}

    return histogram, quartile_model, signs, sign_model


def _concentrate(x: np.ndarray, model: bytes) -> np.ndarray:
    return weighted_sums(x, np.searchsorted(_EDGES, Estimate.read(model).distances(x)), len(_EDGES) + 1).reshape(-1)


def estimates(blocks: DataFrame, groups: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """g, model: the reweighted minimum-covariance-determinant estimate of each group."""
    names = cut(groups.select("g").distinct().select("g", F.lit(0).alias("start"), F.lit(b"").alias("model")))
    n = names.count()
    point = chi_square_point(share, D)
    consistent = share / chi_square(point, D + 2)
    histogram, quartile_model, signs, sign_model = _start_looks(share)
    models = _pass(blocks, names, n, D * (len(_GRID) + 1), histogram, quartile_model)
    models = _pass(blocks, models, n, 1 + len(_TRI[0]), signs, sign_model)
    settle = lambda sums, start, _: {start: from_sums(nearest_share(sums.reshape(-1, _SUMS), share), consistent)}
    for _ in range(steps):
        fresh = _pass(blocks, models, 2 * n, (len(_EDGES) + 1) * _SUMS, _concentrate, settle)
        moved = fresh.select("g", "start", F.col("log_det").alias("now")).join(models.select("g", "start", F.col("log_det").alias("was")), ["g", "start"])
        models = fresh
        if moved.filter(F.abs(F.col("now") - F.col("was")) > SETTLED).isEmpty():
            break
    best = cut(models.groupBy("g").agg(F.min(F.struct("log_det", "start", "model")).alias("b")).select("g", F.lit(0).alias("start"), "b.model"))
    limit = chi_square_point(0.975, D)
    tail = 0.975 / chi_square(limit, D + 2)

    def within(x: np.ndarray, model: bytes) -> np.ndarray:
        near = x[Estimate.read(model).distances(x) <= limit]
        return weighted_sums(near, np.zeros(len(near), np.int64), 1).reshape(-1)

    # an estimate that no vector is near to stays as it is
    reweighted = lambda sums, start, model: {start: from_sums(sums, tail) if sums[0] >= LEAST * share else Estimate.read(model)}
    return _pass(blocks, best, n, _SUMS, within, reweighted).select("g", "model")


def judge(docs: DataFrame, cutoff: float = CUTOFF, share: float = SHARE) -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed, distance (squared; null if none is defined), kept of each document."""
    rows = cut(counted(docs))
    blocks, groups, n = _grouped(rows)
    models = estimates(blocks, groups, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = batch.column("model").to_pylist()
            x = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<f8").reshape(-1, D)
            out = np.full(len(x), np.nan)
            index: dict[bytes, list[int]] = {}
            for i, m in enumerate(models):
                if m is not None:
                    index.setdefault(m, []).append(i)
            for m, at in index.items():
                out[at] = Estimate.read(m).distances(x[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, from_pandas=True)], [*keep, "distance"])

    keep = ["doc_id", "lang", "source", *COUNTS, "base_failed"]
    joined = _with_group(rows, groups, n).join(_small(models, n), "g", "left").select(*keep, "v", "model")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields[: len(keep)])
    return joined.mapInArrow(run, f"{fields}, distance double").withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False)))
