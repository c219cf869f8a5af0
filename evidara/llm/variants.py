"""Spelling variants by full neighbourhood generation.

Words are counted over whole texts. Of each word of the vocabulary all distinct deletions, replacements and insertions over the observed
alphabet are generated as 64-bit hashes, a sum of one value for each (place, sign), so that a neighbour costs an addition. Neighbours meet the vocabulary in a hash join; a joined row's neighbour
is spelt out and must equal the word met, which settles hash collisions, and no distance is computed. In front of the join stands a Bloom filter of the vocabulary, in
files of the shared folder, of FILTER_BYTES at most: what it passes over is no word, and where the vocabulary outgrows it, it only passes more.

The form of a word is its near word of largest count (ties: the smallest) if that is at least ratio times its own; roots are found by doubling the links, whose counts
grow by ratio at each step, so a chain of 2**63 occurrences ends within five rounds at ratio 5.

Defined cases: a null or empty text has no words; a null doc_id counts as an empty id; rows that repeat count each; words of any length are taken, neighbours of long ones in blocks
of places; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import cut, drop_shared_dir, new_shared_dir, put_bytes, read_file, slices

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
#: One in so many (document, word) pairs is damaged by a deletion.
DAMAGE = 199
#: Words that a task counts before it hands them on, and neighbours that it holds at once.
TABLE_WORDS = 400_000
BLOCK = 1 << 20
FILTER_BYTES = 64 << 20
PROBES = 4
BITS_A_WORD = 32
SEGMENT = 1 << 20

_LETTERS = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# The constants of splitmix64.
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
DELETE, REPLACE, INSERT = 0, 1, 2


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """word, n: runs of letters of whole texts, A-Z lowered, some damaged by the crc32 of "<doc_id>:<run>"."""

    def flush(count: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()).cast(pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[bytes, int] = {}
        for part in slices(batches):
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                begin = zlib.crc32(b":" if i is None else b"%d:" % i)
                for word, n in Counter(_LETTERS.findall(text.translate(_LOWER))).items():
                    if len(word) < min_length:
                        continue
                    h = zlib.crc32(word, begin)
                    if h % damage == 0:
                        signs = word.decode()
                        at = h % len(signs)
                        word = (signs[:at] + signs[at + 1 :]).encode()
                    count[word] = count.get(word, 0) + n
                if len(count) > TABLE_WORDS:
                    yield flush(count)
                    count = {}
        yield flush(count)

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return found.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _values(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What a sign adds to the hash of a word at a place."""
    with np.errstate(over="ignore"):
        return _mix(_mix(codes.astype(np.uint64) + _GOLD) + places.astype(np.uint64) * _GOLD)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes and code points (a row for each word) of the words of one length after another, in bounded pieces."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        step = max(1, BLOCK // (size + 1))
        for a in range(0, len(own), step):
            at = own[a : a + step]
            yield at, np.frombuffer("".join(words[i] for i in at.tolist()).encode("utf-32-le"), "<u4").reshape(len(at), size)


def word_hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for at, codes in _by_length(words):
        out[at] = _values(codes, np.arange(codes.shape[1])).sum(1, dtype=np.uint64)
    return out


def neighbours(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    """(kind, row, first place, hashes) of all distinct edits of words of one length, in blocks.

    hashes: an array (words from row on, places, signs), with one sign for deletions; zero where an edit repeats another or changes nothing.
    Of equal edits the one at the first place stands: a sign is not deleted behind its like, nor inserted behind it."""
    n, size = codes.shape
    places, signs = np.arange(size), len(alphabet)
    with np.errstate(over="ignore"):
        own = _values(codes, places)
        total = own.sum(1, dtype=np.uint64)
        zero = np.zeros((n, 1), np.uint64)
        before = np.hstack([zero, np.cumsum(own, 1, dtype=np.uint64)])  # of the signs in front of a place
        fell, rose = _values(codes[:, 1:], places[:-1]), _values(codes, places + 1)  # a place earlier, a place later
        after_less = np.hstack([np.cumsum(fell[:, ::-1], 1, dtype=np.uint64)[:, ::-1], zero])  # of the signs behind a place, moved up
        after_more = np.hstack([np.cumsum(rose[:, ::-1], 1, dtype=np.uint64)[:, ::-1], zero])  # of a place's sign and those behind, moved down
        again = np.zeros((n, size), bool)
        again[:, 1:] = codes[:, 1:] == codes[:, :-1]
        yield DELETE, 0, 0, np.where(again, np.uint64(0), before[:, :-1] + after_less)[:, :, None]
        wide = max(1, BLOCK // (signs * n))
        for p in range(0, size + 1, wide):
            q, end = min(p + wide, size), min(p + wide, size + 1)
            fresh = _values(alphabet[None, :], np.arange(p, end)[:, None])
            if q > p:
                hashes = (total[:, None] - own[:, p:q])[:, :, None] + fresh[None, : q - p]
                yield REPLACE, 0, p, np.where(codes[:, p:q, None] == alphabet, np.uint64(0), hashes)
            hashes = (before[:, p:end] + after_more[:, p:end])[:, :, None] + fresh[None]
            same = np.zeros(hashes.shape, bool)
            first = 1 if p == 0 else 0
            same[:, first:] = codes[:, p + first - 1 : end - 1, None] == alphabet
            yield INSERT, 0, p, np.where(same, np.uint64(0), hashes)


def _bits(hashes: np.ndarray, k: int, mask: int) -> np.ndarray:
    """The bit that the k-th probe looks at."""
    with np.errstate(over="ignore"):
        return (hashes if k == 0 else _mix(hashes + np.uint64(k) * _GOLD)) & np.uint64(mask)


def _filter_bits(n_words: int) -> int:
    """Bits of the filter: a power of two, BITS_A_WORD for each word and FILTER_BYTES at most."""
    return min(FILTER_BYTES * 8, 1 << max(SEGMENT.bit_length() - 1 + 3, (n_words * BITS_A_WORD - 1).bit_length()))


def _write_filter(words: DataFrame, root: str, bits: int) -> None:
    """words: h. Each segment of the filter is gathered by one task and written as a file."""
    size = min(SEGMENT * 8, bits)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([_bits(h, k, bits - 1) for k in range(PROBES)])).astype(np.int64)
            for seg in np.unique(at // size).tolist():
                mine = (at[at // size == seg] % size).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([seg]), pa.array([mine.tobytes()])], ["segment", "places"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for seg, places in zip(batch.column("segment").to_pylist(), batch.column("places").to_pylist()):
                at = np.frombuffer(places, "<u4")
                np.bitwise_or.at(kept.setdefault(seg, np.zeros(size // 8, np.uint8)), at >> 3, (1 << (at & 7)).astype(np.uint8))
        for seg, data in kept.items():
            put_bytes(root, f"segment-{seg}", data.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([len(kept)], pa.int64())], ["n"])

    done = words.select("h").mapInArrow(part, "segment long, places binary").repartition("segment").mapInArrow(gather, "n long")
    done.agg(F.sum("n")).collect()


@lru_cache(maxsize=1)
def _filter(root: str, bits: int) -> np.ndarray:
    """The whole filter in a worker's memory; segments that no word falls into were never written."""
    out = np.zeros(bits // 8, np.uint8)
    for begin in range(0, len(out), SEGMENT):
        data = read_file(root, f"segment-{begin // SEGMENT}")
        if data is not None:
            out[begin : begin + SEGMENT] = np.frombuffer(data, np.uint8)
    return out


def _candidates(words: DataFrame, alphabet: str, root: str, bits: int) -> DataFrame:
    """h (of the neighbour), own (of the word), kind, place, sign: neighbours that the filter lets through."""
    signs = np.frombuffer(alphabet.encode("utf-32-le"), "<u4")
    names = pa.array(list(alphabet), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = _filter(root, bits)
        for batch in batches:
            own_hashes = batch.column("h").to_numpy().view(np.uint64)
            words = batch.column("word").to_pylist()
            for rows, codes in _by_length(words):
                step = max(1, BLOCK // ((codes.shape[1] + 1) * len(signs)))
                for a in range(0, len(rows), step):
                    own = own_hashes[rows[a : a + step]]
                    for kind, _, place, hashes in neighbours(codes[a : a + step], signs):
                        flat = hashes.reshape(-1)
                        at = np.arange(0)
                        for k in range(PROBES):
                            probe = flat if k == 0 else flat[at]
                            bit = _bits(probe, k, bits - 1)
                            hit = np.flatnonzero((present[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                            at = hit if k == 0 else at[hit]
                        at = at[flat[at] != 0]
                        if len(at):
                            row, rest = np.divmod(at, hashes.shape[1] * hashes.shape[2])
                            where, sign = np.divmod(rest, hashes.shape[2])
                            letters = names.take(pa.array(sign)) if kind != DELETE else pa.array([""] * len(at))
                            columns = [flat[at].view(np.int64), own[row].view(np.int64), np.full(len(at), kind, np.int32), (where + place).astype(np.int32)]
                            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), letters], ["h", "own", "kind", "place", "sign"])

    return words.select("word", "h").mapInArrow(run, "h long, own long, kind int, place int, sign string")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near: all ordered pairs of words (words: word, n, h) that differ by exactly one edit."""
    n_words, letters = words.count(), words.select(F.explode(F.split("word", "")).alias("sign")).filter("sign <> ''").distinct()
    alphabet = "".join(sorted(r["sign"] for r in letters.collect()))  # as many as there are characters at most
    if not alphabet:
        return words.select("word", F.col("word").alias("near")).limit(0)
    spark = words.sparkSession
    root, bits = new_shared_dir(spark, "word-filter"), _filter_bits(n_words)
    _write_filter(words, root, bits)
    met = _candidates(words, alphabet, root, bits).join(words.select("h", F.col("word").alias("near")), "h").drop("h")
    both = met.join(words.select(F.col("h").alias("own"), "word"), "own")
    spelt = F.expr("concat(left(word, place), sign, substr(word, place + if(kind = 2, 1, 2)))")
    out = cut(both.filter(spelt == F.col("near")).select("word", "near").distinct())
    drop_shared_dir(spark, root)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that forms (word, form) lead to."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        links = step.select("word", "root")


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n) of distinct words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(word_hashes(batch.column("word").to_pylist()).view(np.int64))], ["word", "n", "h"])

    words = cut(words.select("word", F.col("n").cast("long")).mapInArrow(hashed, "word string, n long, h long"))
    counts = words.select("word", "n")
    pairs = near_pairs(words).join(counts, "word").join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.when(F.col("near_n") >= ratio * F.col("n"), F.struct((-F.col("near_n")).alias("less"), "near")))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = cut(near.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    roots = _roots(near.filter("form IS NOT NULL"))
    return counts.join(near, "word", "left").join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


#: What op11_variants returns, for DuckDB: crc32 by its table, near words by equal rests of deletions.
SQL = r"""
WITH RECURSIVE bits AS (
    SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)),
counted AS (
    SELECT doc_id, run, count(*) AS n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
        lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END)) AS bytes
    FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes::BIGINT[]), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) AS h FROM counted, crc),
words AS (
    SELECT word, sum(n)::BIGINT AS n
    FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
rests AS (SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest, substr(word, p, 1) AS gone FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM rests a JOIN rests b ON a.rest = b.rest AND a.p = b.p AND a.gone <> b.gone
    UNION SELECT a.word, a.n, b.word, b.n FROM rests a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM rests a JOIN words b ON a.rest = b.word),
best AS (
    SELECT word, count(*)::BIGINT AS n_near, min(struct_pack(less := -near_n, near := near)) FILTER (WHERE near_n >= 5 * n) AS b FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, b.near AS form, -b.less AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (
    SELECT word, word AS root FROM forms
    UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n::BIGINT AS form_n
FROM forms f JOIN (SELECT w.word, w.root FROM walk w JOIN forms f ON f.word = w.root WHERE f.form IS NULL) w ON w.word = f.word
"""
