"""Groups of texts whose sets of word shingles agree: SimHash candidates by tiled exact comparison, each link checked on the sets.

A text's set: its distinct shingles, as 32 bits of their XXH64 (two shingles of a set fall together in about one of a million). The fingerprint has LANES * 64 bits, each set if it is set in over
half the hashes of the set. Texts of equal sets are one row of a tile. Tiles hold rows of nearly one set size; tile pairs are passed over whose sizes differ by more than the similarity
allows or whose population counts differ beyond the radius. The others are compared by numpy exclusive-or and bit counts, first one lane, then all; candidates are read from the sets' files in the shared
folder and are links if the sets' intersection over their union reaches the similarity. Candidates within one tree of the tile pair are not read, so a group of
copies costs about one check a row; no link between trees is lost.

Pairs whose smaller set has SMALL shingles or fewer are told without loss: each shingle turns one of 128 bits of a signature, and two signatures differ in no more bits than the sets in shingles, (n + m) (1 - s) / (1 + s) at most for links.
For larger sets, at a similarity of s, sets of equal size have vectors at an angle of acos(2 s / (1 + s)), so LANES * 64 bits differ in that share of pi: 19.5 of 128 for 0.8, with a deviation of 4. RADIUS (36) lies
four deviations above it, and five below the 64 of unrelated texts; LANE_RADIUS (22) likewise for one lane (9.7, deviation 2.9). Simulated, 0.015 % at most of pairs of just that similarity are passed over (sets of 28 to 500 shingles, random hashes).

Defined cases: null and empty texts have the empty set, and are one class; texts of fewer words than a shingle have their whole sequence as one; rows that repeat a doc_id are kept, each with
its class; a row without doc_id gets the class of a row with an id and an equal set (null without one) and joins nothing else; an empty table gives an empty result; columns besides doc_id, text and
those to carry are not read.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytescan import scan, xxh64
from .common import SharedFile, SharedReader, cut, drop_shared_dir, new_shared_dir, slices, with_fields
from .components import components
from .ngram_lm import mix
from .simhash import bit_counts, spanning

WORDS, SIMILARITY = 5, 0.8
#: The least similarity that groups() takes: signatures are made of sets up to SMALL / SIMILARITY_LEAST.
SIMILARITY_LEAST = 0.5
LANES, RADIUS, LANE_RADIUS = 2, 36, 22
SMALL = 32
#: Rows of a tile: a pair takes under 1 MB of rows, its comparison some 20 MB.
TILE = 8192
_STEP = 128
#: Bytes of sets that a tile pair keeps at hand.
KEPT = 64 << 20
_SALTS = [np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64)) for k in range(LANES + 2)]
_ROW = np.dtype([("fp", "<u8", LANES), ("sig", "<u8", 2), ("n", "<i8"), ("rep", "<i8"), ("at", "<i8"), ("file", "V16")])


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes (32 bits) of all texts, text by text, and how many each has."""
    w = scan(texts)
    count = np.where(w.counts == 0, 0, np.maximum(w.counts - words + 1, 1))
    doc = np.repeat(np.arange(len(count)), count)
    head = (np.cumsum(w.counts) - w.counts)[doc] + np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    tail = np.minimum(head + words, np.cumsum(w.counts)[doc]) - 1
    key = (doc.astype(np.uint64) << np.uint64(32)) | (xxh64(w.buf, w.starts[head], w.ends[tail]) >> np.uint64(32))
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key.astype(np.uint32), np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(count))


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits of each set, of which each shingle turns one."""
    place = (mix(sets.astype(np.uint64) ^ _SALTS[LANES + 1]) & np.uint64(127)).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    turned = np.bincount(owner * 128 + place, minlength=128 * len(sizes)) & 1
    return np.packbits(turned.astype(np.uint8).reshape(-1, 128), axis=1, bitorder="little").view("<u8")


def fingerprints(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LANES fingerprints of each set (zero for the empty one) and a sum that tells sets apart."""
    prints, sums = np.zeros((len(sizes), LANES), np.uint64), np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        own = sizes[some]
        for k in range(LANES):
            bits = 2 * bit_counts(mix(sets.astype(np.uint64) ^ _SALTS[k]), own) > own[:, None]
            prints[some, k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
        with np.errstate(over="ignore"):
            sums[some] = np.add.reduceat(mix(sets.astype(np.uint64) ^ _SALTS[LANES]), np.cumsum(own) - own)
    return prints, sums


def print_table(docs: DataFrame, uri: str, words: int = WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, sig, n, sum, file, at[, carry]: each text's fingerprint, the size of its set, and where in the shared folder the set lies. Each attempt of a task writes a file of its own name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = uuid.uuid4()
        out = SharedFile(uri, name.hex)
        for part in slices(batches):
            sets, sizes = shingle_sets(part.column("text"), words)
            prints, sums = fingerprints(sets, sizes)
            signs = np.zeros((len(sizes), 2), np.uint64)
            few = sizes <= SMALL / SIMILARITY_LEAST
            signs[few] = signatures(sets[np.repeat(few, sizes)], sizes[few])
            at = out.size + 4 * (np.cumsum(sizes) - sizes)
            out.write(sets.tobytes())
            own = [part.column("doc_id"), pa.array([x.tobytes() for x in prints], pa.binary()), pa.array([x.tobytes() for x in signs], pa.binary()), pa.array(sizes), pa.array(sums.view(np.int64)), pa.array([name.bytes] * part.num_rows, pa.binary()), pa.array(at)]
            yield pa.RecordBatch.from_arrays([*own, *(part.column(c) for c in carry)], ["doc_id", "fp", "sig", "n", "sum", "file", "at", *carry])
        out.close()

    read = docs.select(F.col("doc_id").cast("long"), "text", *carry)
    return read.mapInArrow(run, with_fields("doc_id long, fp binary, sig binary, n long, sum long, file binary, at long", read, carry))


def _tiles(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Cut one range of the sorted rows into tiles."""
    held = np.zeros(0, _ROW)

    def emit(rows: np.ndarray) -> pd.DataFrame:
        pop = np.bitwise_count(rows["fp"]).sum(1)
        return pd.DataFrame({"tile": [uuid.uuid4().hex], "low": [int(rows["n"].min())], "high": [int(rows["n"].max())], "pop_low": [int(pop.min())], "pop_high": [int(pop.max())], "rows": [rows.tobytes()]})

    for batch in batches:
        rows = np.zeros(len(batch), _ROW)
        if len(batch):
            rows["fp"] = np.frombuffer(b"".join(batch["fp"]), "<u8").reshape(-1, LANES)
            rows["sig"] = np.frombuffer(b"".join(batch["sig"]), "<u8").reshape(-1, 2)
            rows["file"] = np.frombuffer(b"".join(batch["file"]), "V16")
        for c in ("n", "rep", "at"):
            rows[c] = batch[c]
        held = np.concatenate([held, rows])
        while len(held) >= size:
            yield emit(held[:size])
            held = held[size:]
    if len(held):
        yield emit(held)


class _Sets:
    """The sets of the rows of a tile pair, read when asked for; the last ones stay at hand."""

    def __init__(self, reader: SharedReader, rows: np.ndarray):
        self.reader, self.rows, self.held, self.kept = reader, rows, 0, OrderedDict()

    def get(self, i: int) -> np.ndarray:
        found = self.kept.get(i)
        if found is None:
            row = self.rows[i]
            found = np.frombuffer(self.reader.read(uuid.UUID(bytes=row["file"].tobytes()).hex, int(row["at"]), 4 * int(row["n"])), "<u4")
            self.kept[i] = found
            self.held += found.nbytes
            while self.held > KEPT and len(self.kept) > 2:
                self.held -= self.kept.popitem(last=False)[1].nbytes
        return found

    def alike(self, u: np.ndarray, v: np.ndarray, similarity: float) -> np.ndarray:
        out = np.zeros(len(u), bool)
        for k, (i, j) in enumerate(zip(u.tolist(), v.tolist())):
            a, b = self.get(i), self.get(j)
            both = np.sort(np.concatenate([a, b]))
            shared = np.count_nonzero(both[1:] == both[:-1])
            out[k] = shared >= similarity * (len(a) + len(b) - shared) - 1e-9
        return out


def compare(a: np.ndarray, b: np.ndarray | None, reader: SharedReader, similarity: float, radius: int, lane_radius: int) -> tuple[np.ndarray, np.ndarray]:
    """rep pairs: a spanning forest of the links within a tile (b None) or between two."""
    same = b is None
    other = a if same else b
    rows = a if same else np.concatenate([a, b])
    sets = _Sets(reader, rows)
    fa, fb, na, nb = np.ascontiguousarray(a["fp"]), np.ascontiguousarray(other["fp"]), a["n"].astype(float), other["n"].astype(float)
    lane_a, lane_b = fa[:, 0].copy(), fb[:, 0].copy()
    sa, sb = np.ascontiguousarray(a["sig"]), np.ascontiguousarray(other["sig"])
    sign_a, sign_b = sa[:, 0].copy(), sb[:, 0].copy()
    share = (1 - similarity) / (1 + similarity)

    def near(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for small in (False, True):
            if min(na[i:j].min(), nb.min()) > SMALL if small else min(na[i:j].max(), nb.max()) <= SMALL:
                continue
            if small:
                u, v = np.nonzero(np.bitwise_count(sign_a[i:j, None] ^ sign_b[None, :]) <= int(min(SMALL, na[i:j].max()) * (1 + 1 / similarity) * share + 1e-9))
            else:
                u, v = np.nonzero(np.bitwise_count(lane_a[i:j, None] ^ lane_b[None, :]) <= lane_radius)
            u += i
            less, more = np.minimum(na[u], nb[v]), np.maximum(na[u], nb[v])
            ok = (less >= similarity * more - 1e-9) & ((less <= SMALL) == small)
            if same:
                ok &= v > u
            u, v, less, more = u[ok], v[ok], less[ok], more[ok]
            apart = np.bitwise_count(sa[u] ^ sb[v] if small else fa[u] ^ fb[v]).sum(1)
            limit = (less + more) * share + 1e-9
            ok = (apart <= limit) & (limit >= 1) if small else apart <= radius  # distinct sets differ by one at least
            found.append((u[ok], v[ok], apart[ok]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        u, v, apart = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(apart, kind="stable")
        return u[order], v[order]

    u, v = spanning(len(a), 0 if same else len(b), near, lambda u, v: sets.alike(u, v, similarity), _STEP)
    return rows["rep"][u], rows["rep"][v]


def links(reps: DataFrame, uri: str, similarity: float = SIMILARITY, radius: int = RADIUS, lane_radius: int = LANE_RADIUS, tile: int = TILE) -> DataFrame:
    """reps: fp, sig, n, sum, rep, file, at (distinct sets). Returns u, v: rep pairs, a spanning forest for each tile pair."""
    order = ["n", "sum", "rep"]
    tiles = cut(reps.repartitionByRange(*order).sortWithinPartitions(*order).select("fp", "sig", "n", "rep", "at", "file").mapInPandas(lambda it: _tiles(it, tile), "tile string, low long, high long, pop_low int, pop_high int, rows binary"))
    # sizes that are near enough differ by one power of 1 / similarity at most: tiles meet on such powers instead of all with all
    power = lambda c: F.when(F.col(c) > 0, F.floor(F.log(F.col(c)) / float(np.log(1 / similarity)) + 1e-9)).otherwise(-9).cast("int")
    index = tiles.select("tile", "low", "high", "pop_low", "pop_high")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("low", "high", "pop_low", "pop_high")]
    a = index.select(F.col("tile").alias("a"), *side("a"), F.explode(F.sequence(power("low"), power("high") + 1)).alias("power"))
    b = index.select(F.col("tile").alias("b"), *side("b"), F.explode(F.sequence(power("low"), power("high"))).alias("power"))
    sizes = (F.col("high_a") >= similarity * F.col("low_b") - 1e-9) & (F.col("high_b") >= similarity * F.col("low_a") - 1e-9)
    counts = F.greatest(F.col("pop_low_a") - F.col("pop_high_b"), F.col("pop_low_b") - F.col("pop_high_a")) <= radius
    counts |= F.least("low_a", "low_b") <= SMALL
    pairs = a.join(b, "power").filter(sizes & counts).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    loaded = pairs.join(tiles.select(F.col("tile").alias("a"), F.col("rows").alias("rows_a")), "a").join(tiles.select(F.col("tile").alias("b"), F.col("rows").alias("rows_b")), "b")
    loaded = loaded.select(F.when(F.col("a") != F.col("b"), F.col("rows_b")).alias("rows_b"), "rows_a").repartition(max(reps.sparkSession.sparkContext.defaultParallelism * 8, 48))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = SharedReader(uri)
        for batch in batches:
            for x, y in zip(batch.column("rows_a"), batch.column("rows_b")):
                u, v = compare(np.frombuffer(x.as_py(), _ROW), np.frombuffer(y.as_py(), _ROW) if y.is_valid else None, reader, similarity, radius, lane_radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return loaded.mapInArrow(run, "u long, v long")


def groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, carry: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """doc_id, class_id (smallest doc_id of an equal set), component_id (smallest doc_id reachable over links, itself included), group (a number of the component)[, carry] for each document."""
    if similarity < SIMILARITY_LEAST:
        raise ValueError(f"similarity must be at least {SIMILARITY_LEAST}")
    uri = new_shared_dir(docs.sparkSession, "shingle-sets")
    prints = cut(print_table(docs, uri, words, carry))
    where = F.min(F.struct("doc_id", "file", "at", "sig")).alias("w")
    sets = prints.filter("doc_id is not null").groupBy("fp", "n", "sum").agg(where)
    # sets have numbers of their own, since rows of different texts may share a doc_id
    sets = cut(sets.select("fp", "n", "sum", F.col("w.doc_id").alias("class_id"), "w.file", "w.at", "w.sig", F.monotonically_increasing_id().alias("rep")))
    labels = components(links(sets.filter("n > 0"), uri, similarity, tile=tile))
    drop_shared_dir(docs.sparkSession, uri)
    linked = labels.join(sets.select(F.col("rep").alias("node"), "class_id"), "node")
    linked = linked.join(linked.groupBy("component").agg(F.min("class_id").alias("least")), "component").select(F.col("node").alias("rep"), "component", "least")
    classes = sets.join(linked, "rep", "left").select("fp", "n", "sum", "class_id", F.coalesce("least", "class_id").alias("component_id"), F.coalesce("component", "rep").alias("group"))
    # copies of one text may hold a large part of all rows: adaptive skew handling splits that side of this join
    return prints.join(classes, ["fp", "n", "sum"], "left").select("doc_id", "class_id", "component_id", "group", *carry)
