"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays that workers memory-map.

Tokens: words without white space, A-Z as a-z, and one end for each text. Passes:
1. words are counted by their 64-bit hash: tasks sum their part, each shard of the hash range is merged by one task, which writes its sorted array;
2. pairs (context id, word id) are counted likewise, in shards by context (the few contexts that hold much of the corpus are spread
   over all shards by the pair); each shard's sorted array of mixed 64-bit pair keys is written beside the words'; types by context and by word are
   summed over the shards, in ranges of ids;
3. any texts are scored against the mapped arrays.
The number of shards follows the number of input partitions, so a shard's size does not grow with the corpus. Nothing is pruned.

p(w|u) = max(c(u,w) - D, 0) / c(u) + g(u) p(w); p(w) interpolates continuation counts with 1 / (V + 1), V + 1 being the distinct tokens and one for all unknown words.
A context that training has not seen leaves p(w).

Word ids have 32 bits: more than 2**32 - 2 distinct words are an error.

Defined cases: a null text is an empty one (just the end); rows without doc_id are scored, never trained on; rows that repeat are counted each;
without training rows every token has probability 1; other columns are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .bytescan import scan, xxh64
from .common import cut, drop_shared_dir, map_file, new_shared_dir, put_bytes, slices
from .fitting import fold

FOLDS, HELD = 7, 2
#: Distinct keys a task gathers before it hands them on.
FLUSH = 6_000_000
#: Tokens a task counts before it hands on what it has: its counts have 32 bits. Sums have 64.
FLUSH_TOKENS = 1 << 31
#: Word shards that a worker keeps mapped.
MAPPED = 8192
#: Ids in a range, at most.
ID_RANGE = 1 << 16
END = np.uint64(0xEF46DB3751D8E999)  # XXH64 of nothing, seed 0; words are never empty
_U32 = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, text by text, and each text's number of tokens."""
    w = scan(texts)
    n = w.counts + 1
    out = np.empty(int(n.sum()), np.uint64)
    out[np.cumsum(n) - 1] = END
    out[np.arange(len(w.starts)) + w.doc] = xxh64(w.buf, w.starts, w.ends)
    return out, n


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], (np.add.reduceat(c, at) if len(at) else c)


class Gatherer:
    """Counts of keys over a task; hands on what it has when that is much."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held, self.merged, self.tokens = 0, 0, 0

    def add(self, keys: np.ndarray) -> bool:
        k, c = np.unique(keys, return_counts=True)
        self.tokens += len(keys)
        self.keys.append(k)
        self.counts.append(c.astype(np.int64))
        self.held += len(k)
        if self.held > FLUSH and self.held > 2 * self.merged:
            self._merge()
        return self.merged > FLUSH or self.tokens > FLUSH_TOKENS

    def _merge(self) -> None:
        k, c = summed(self.keys, self.counts)
        self.keys, self.counts, self.held, self.merged = [k], [c], len(k), len(k)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        k, c = summed(self.keys, self.counts)
        self.__init__()
        return k, c


@dataclass
class Model:
    """Where the arrays are and the numbers that all of them share."""

    uri: str
    bits: int  # log2 of the shards
    first: list[int] = field(default_factory=list)  # of each word shard: id of its first word
    tokens: int = 0
    types: int = 0
    texts: int = 0
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pair_discount: np.ndarray = field(default_factory=lambda: np.zeros(4))
    word_discount: np.ndarray = field(default_factory=lambda: np.zeros(4))
    pairs: int = 0
    unseen: float = 1.0  # weight of 1 / (V + 1)
    width: int = 1  # ids in a range

    @property
    def shards(self) -> int:
        return 1 << self.bits


def discounts(n: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from how many keys have counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d.append(min(max(k - (k + 1) * y * b / a, 0.0), k) if a else 0.5 * k)
    return np.array([d[0], d[1], d[2], d[3]])


def _shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _blobs(shard: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows (shard, bytes of each column); the columns are put in the order of the shards, else kept as they are."""
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0, [True]])) if len(order) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield (int(shard[order[a]]), *(np.ascontiguousarray(c[order[a:b]]).tobytes() for c in columns))


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def _by_shard(rows: DataFrame, shards: int, merge: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """merge() of the rows of each shard, a shard to a task: by hash several would meet in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            for s in pc.unique(t.column("shard")):
                yield from merge(t.filter(pc.equal(t.column("shard"), s))).to_batches()

    return rows.repartitionById(shards, "shard").mapInArrow(run, schema)


def _joined(table: pa.Table, column: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column(column)), dtype)


def _count_words(train: DataFrame, model: Model) -> None:
    names, kinds = ["shard", "keys", "counts", "texts"], [pa.int32(), pa.binary(), pa.binary(), pa.int64()]
    bits, uri = model.bits, model.uri

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, texts = Gatherer(), 0
        for batch in slices(batches):
            texts += batch.num_rows
            if got.add(token_hashes(batch.column("text"))[0]):
                k, c = got.take()
                yield _batch([(*x, 0) for x in _blobs(_shard_of(k, bits), k, c.astype("<u4"))], names, kinds)
        k, c = got.take()
        yield _batch([*((*x, 0) for x in _blobs(_shard_of(k, bits), k, c.astype("<u4"))), (0, b"", b"", texts)], names, kinds)

    def merge(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        k, c = summed([_joined(t, "keys", "<u8")], [_joined(t, "counts", "<u4").astype(np.int64)])
        put_bytes(uri, f"words-{shard}", k.astype("<u8").tobytes(), c.astype("<i8").tobytes())
        often = np.flatnonzero(c * 64 > c.sum())  # fewer than 64
        return pa.table({"shard": [shard], "types": [len(k)], "tokens": [int(c.sum())], "texts": [sum(t.column("texts").to_pylist())], "at": [often.tolist()], "count": [c[often].tolist()]}).cast(schema)

    schema = pa.schema([("shard", pa.int32()), ("types", pa.int64()), ("tokens", pa.int64()), ("texts", pa.int64()), ("at", pa.list_(pa.int64())), ("count", pa.list_(pa.int64()))])
    counted = train.select("text").mapInArrow(part, "shard int, keys binary, counts binary, texts long")
    rows = _by_shard(counted, model.shards, merge, "shard int, types long, tokens long, texts long, at array<long>, count array<long>").collect()  # a row for each shard
    by = {r["shard"]: r for r in rows}
    for s in range(model.shards):
        model.first.append(model.types)
        model.types += by[s]["types"] if s in by else 0
    model.tokens, model.texts = sum(r["tokens"] for r in rows), sum(r["texts"] for r in rows)
    often = [(model.first[r["shard"]] + i, n) for r in rows for i, n in zip(r["at"], r["count"])]
    # the begin of a text is context number types
    model.hot = np.array(sorted({i for i, n in often if n * 4 * model.shards > model.tokens} | {model.types}), np.int64)
    # beyond some 16 million words ranges have a fixed size, and their number grows instead
    model.width = min(-(-(model.types + 1) // min(model.shards, 256)), ID_RANGE)
    if model.types >= (1 << 32) - 2:
        raise ValueError("more than 2**32 distinct words")


class Words:
    """The arrays of the words; a shard is mapped when it is asked for, MAPPED at a time."""

    def __init__(self, model: Model):
        self.model, self.held = model, OrderedDict()

    def shard(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted keys of a shard and their counts."""
        if s not in self.held:
            m = self.model
            size = (m.first[s + 1] if s + 1 < m.shards else m.types) - m.first[s]
            data = map_file(m.uri, f"words-{s}") if size else b""
            self.held[s] = np.frombuffer(data, "<u8", size), np.frombuffer(data, "<i8", size, 8 * size) if size else np.zeros(0, np.int64)
            if len(self.held) > MAPPED:
                self.held.popitem(last=False)
        return self.held[s]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1 if unknown) and count of each token."""
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        edges = np.searchsorted(_shard_of(distinct, self.model.bits), np.arange(self.model.shards + 1))
        for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            keys, held = self.shard(s) if a < b else ((), ())
            if len(keys):
                at = np.minimum(np.searchsorted(keys, distinct[a:b]), len(keys) - 1)
                same = keys[at] == distinct[a:b]
                ids[a:b] = np.where(same, self.model.first[s] + at, -1)
                counts[a:b] = np.where(same, held[at], 0)
        return ids[back], counts[back]


def _contexts(ids: np.ndarray, n: np.ndarray, begin: int) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(n) - n] = begin
    return before


def _pair_shard(u: np.ndarray, pair: np.ndarray, model: Model) -> np.ndarray:
    """By context; by the mixed pair for contexts that are frequent."""
    at = np.minimum(np.searchsorted(model.hot, u), len(model.hot) - 1)
    return np.where(model.hot[at] == u, _shard_of(pair, model.bits), _shard_of(mix(u.astype(np.uint64)), model.bits))


def _count_pairs(train: DataFrame, model: Model) -> None:
    names, kinds = ["shard", "u", "w", "counts"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def rows(got: Gatherer) -> pa.RecordBatch:
        k, c = got.take()
        u, w = (k >> _U32).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype("<u4")
        shard = _pair_shard(u, mix(k), model)
        return _batch(list(_blobs(shard, u.astype("<u4"), w, c.astype("<u4"))), names, kinds)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, got = Words(model), Gatherer()
        for batch in slices(batches):
            hashes, n = token_hashes(batch.column("text"))
            ids, _ = words.ids(hashes)
            if got.add((_contexts(ids, n, model.types).astype(np.uint64) << _U32) | ids.astype(np.uint64)):
                yield rows(got)
        yield rows(got)

    out_kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def merge(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        k, c = summed([(_joined(t, "u", "<u4").astype(np.uint64) << _U32) | _joined(t, "w", "<u4").astype(np.uint64)], [_joined(t, "counts", "<u4").astype(np.int64)])
        mixed = mix(k)
        order = np.argsort(mixed)
        put_bytes(model.uri, f"pairs-{shard}", mixed[order].astype("<u8").tobytes(), c[order].astype("<i8").tobytes())
        tally = np.array([len(k), *(np.count_nonzero(c == i) for i in (1, 2, 3, 4))], "<i8")
        out = [(-1, 0, tally.tobytes(), b"")]
        u, w = (k >> _U32).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if len(u):
            at = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            kinds_of = np.column_stack([np.add.reduceat((c == 1).astype(np.int64), at), np.add.reduceat((c == 2).astype(np.int64), at), np.add.reduceat((c >= 3).astype(np.int64), at)])
            out += [(r, 0, a, b) for r, a, b in _blobs(u[at] // model.width, u[at].astype("<u4"), kinds_of.astype("<u4"))]
            own, n = np.unique(w, return_counts=True)
            out += [(r, 1, a, b) for r, a, b in _blobs(own // model.width, own.astype("<u4"), n.astype("<u4"))]
        return pa.table(_batch(out, ["range", "kind", "ids", "counts"], out_kinds).to_pydict(), schema=pa.schema(list(zip(["range", "kind", "ids", "counts"], out_kinds))))

    counted = train.select("text").mapInArrow(part, "shard int, u binary, w binary, counts binary")
    sums = cut(_by_shard(counted, model.shards, merge, "range int, kind int, ids binary, counts binary"))
    tally = sum((np.frombuffer(r["ids"], "<i8") for r in sums.filter("range = -1").select("ids").collect()), np.zeros(5, np.int64))
    model.pairs, model.pair_discount = int(tally[0]), discounts(tally[1:])
    ends = pa.schema([("types", pa.int64()), ("n", pa.list_(pa.int64()))])

    def by_id(t: pa.Table) -> pa.Table:
        r = t.column("range")[0].as_py()
        low = r * model.width
        size = min(model.width, model.types + 1 - low)
        by_context, before = np.zeros((size, 3), np.int64), np.zeros(size, np.int64)
        for kind, ids, counts in zip(*(t.column(c).to_pylist() for c in ("kind", "ids", "counts"))):
            at, n = np.frombuffer(ids, "<u4").astype(np.int64) - low, np.frombuffer(counts, "<u4").astype(np.int64)
            if kind == 0:
                by_context[at] += n.reshape(-1, 3)
            else:
                before[at] += n
        put_bytes(model.uri, f"ids-{r}", by_context.astype("<u4").tobytes(), before.astype("<u4").tobytes())
        return pa.table({"types": [int((before > 0).sum())], "n": [[*(int((before == i).sum()) for i in (1, 2, 3, 4)), int((before >= 3).sum())]]}, schema=ends)

    found = sums.filter("range >= 0").groupBy("range").applyInArrow(by_id, "types long, n array<long>").collect()
    n = sum((np.array(r["n"], np.int64) for r in found), np.zeros(5, np.int64))
    model.word_discount = discounts(n[:4])
    if model.pairs:
        model.unseen = float(model.word_discount[1] * n[0] + model.word_discount[2] * n[1] + model.word_discount[3] * n[4]) / model.pairs


class Scorer:
    """Log10 probabilities from the mapped arrays."""

    def __init__(self, model: Model):
        self.model, self.words = model, Words(model)
        self.pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _pairs(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        if s not in self.pairs:
            data = map_file(self.model.uri, f"pairs-{s}")
            size = len(data) // 16
            self.pairs[s] = np.frombuffer(data, "<u8", size), np.frombuffer(data, "<i8", size, 8 * size) if size else np.zeros(0, "<i8")
        return self.pairs[s]

    def _range(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        if r not in self.ranges:
            data = map_file(self.model.uri, f"ids-{r}")
            size = len(data) // 16
            self.ranges[r] = np.frombuffer(data, "<u4", 3 * size).reshape(size, 3), np.frombuffer(data, "<u4", size, 12 * size)
        return self.ranges[r]

    def _by_id(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Types after each context with counts 1, 2 and more, and types before each word. ids: sorted, none -1."""
        after, before = np.zeros((len(ids), 3)), np.zeros(len(ids))
        edges = np.flatnonzero(np.concatenate([[True], np.diff(ids // self.model.width) != 0, [True]])) if len(ids) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            r = int(ids[a] // self.model.width)
            x, y = self._range(r)
            after[a:b], before[a:b] = x[ids[a:b] - r * self.model.width], y[ids[a:b] - r * self.model.width]
        return after, before

    def _pair_counts(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """c(u, w) of known ids."""
        distinct, back = np.unique((u.astype(np.uint64) << _U32) | w.astype(np.uint64), return_inverse=True)
        mixed = mix(distinct)
        shard = _pair_shard((distinct >> _U32).astype(np.int64), mixed, self.model)
        order = np.lexsort((mixed, shard))
        out = np.zeros(len(distinct), np.int64)
        edges = np.searchsorted(shard[order], np.arange(self.model.shards + 1))
        for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if a < b:
                keys, counts = self._pairs(s)
                if len(keys):
                    want = mixed[order[a:b]]
                    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                    out[order[a:b]] = np.where(keys[at] == want, counts[at], 0)
        return out[back]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and score of each text."""
        m = self.model
        hashes, n = token_hashes(texts)
        first = np.cumsum(n) - n
        ids, counts = self.words.ids(hashes)
        per = lambda x: np.add.reduceat(x, first)
        known = per((counts > 0).astype(np.int64))
        base = per(np.log10((counts + 1) / (m.tokens + m.types + 1)))
        if not m.pairs:
            return n, known, base, np.zeros(len(n))
        word, back = np.unique(np.where(ids < 0, m.types, ids), return_inverse=True)
        after, before = self._by_id(word)
        before = np.where(word == m.types, 0, before)
        p = np.maximum(before - m.word_discount[np.minimum(before, 3).astype(np.int64)], 0) / m.pairs + m.unseen / (m.types + 1)
        p = p[back]
        u = _contexts(ids, n, m.types)
        total = np.empty(len(ids), np.int64)
        total[1:] = counts[:-1]
        total[first] = m.texts
        held = np.empty(len(ids))
        weight = after @ m.pair_discount[1:]
        held[1:] = weight[back[:-1]]
        begin, _ = self._by_id(np.array([m.types]))
        held[first] = float((begin @ m.pair_discount[1:])[0])
        seen = (u >= 0) & (total > 0)
        both = np.flatnonzero(seen & (ids >= 0))
        c = np.zeros(len(ids), np.int64)
        c[both] = self._pair_counts(u[both], ids[both])
        of = np.maximum(total, 1)
        mixed = np.maximum(c - m.pair_discount[np.minimum(c, 3)], 0) / of + held / of * p
        return n, known, base, per(np.log10(np.where(seen, mixed, p)))


def train_model(train: DataFrame, shards: int | None = None) -> Model:
    """Count the model of train's texts into a new shared folder."""
    wanted = shards or train.rdd.getNumPartitions()
    model = Model(new_shared_dir(train.sparkSession, "ngrams"), max(4, (max(wanted, 1) - 1).bit_length()))
    _count_words(train, model)
    _count_pairs(train, model)
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score; lazy: the model's folder is read when the result is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in slices(batches):
            scorer = scorer or Scorer(model)
            columns = scorer.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out_scores(docs: DataFrame, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """Train on the rows outside the held fold, score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    mine = fold(F.col("doc_id"), folds)
    model = train_model(docs.filter(mine != held).select("text"))
    scored = score_texts(docs, model)
    out = cut(
        scored.select(
            "doc_id",
            F.coalesce(mine == held, F.lit(False)).alias("held_out"),
            "n_tokens",
            "n_known",
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            "base_score",
            "score",
            F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
        )
    )
    drop_shared_dir(docs.sparkSession, model.uri)
    return out
