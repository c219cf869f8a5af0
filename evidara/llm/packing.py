"""Packing of token pieces into fixed-length sequences: shortest-pack-first over the length histogram.

A document longer than a sequence is cut into whole sequences and a rest. The histogram of piece lengths (at most
max_tokens counts, whatever the corpus) goes to the driver, which places lengths longest first: each goes to the
packs that are shortest so far, all packs of one pattern at once, and new packs open where none has room. The
resulting patterns say which ranks of each length go where; ranks come from counts by (scan partition, length), so
pieces are neither sorted nor gathered, and each finds its sequence by binary search in the plan.

Defined cases: a null text is an empty document, just the end id; a row without doc_id is packed like others (null doc_id); rows that repeat a
document are packed each; other columns are not read; an empty table gives no pieces. At a tie of piece lengths ranks follow
the scan, so any two runs over the same files agree.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from .common import cut, slices
from .wordtokens import word_encoder

MAX_TOKENS = 2048


def token_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, part, nth[, ids]: pieces of at most max_tokens; nth counts those of one length in a task."""
    end = np.asarray([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = word_encoder(tokenizer), np.zeros(max_tokens + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encoder.encode(text) + end
                n = len(ids) // 4
                for start in range(0, n, max_tokens):
                    own = ids[4 * start : 4 * (start + max_tokens)]
                    k = len(own) // 4
                    rows.append((doc, start, k, zlib.crc32(own), n, part, int(seen[k])) + ((own,) if with_ids else ()))
                    seen[k] += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows), kinds)], names)

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def plan_packs(counts: dict[int, int], max_tokens: int = MAX_TOKENS) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, ranks, sequence, offset, copies) saying where the ranks of each length go, and the number of sequences.

    Rank first + j of a row goes to sequence + j // copies, at offset + (j % copies) * length.
    """
    heap: list[tuple[int, int, int, list]] = []  # -free, order of making, packs, runs (length, copies, first rank)
    made = 0
    done: list[tuple[int, list]] = []

    def keep(free: int, packs: int, runs: list) -> None:
        nonlocal made
        made += 1
        if free:
            heapq.heappush(heap, (-free, made, packs, runs))
        else:
            done.append((packs, runs))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            if heap and -heap[0][0] >= length:
                free, _, packs, runs = heapq.heappop(heap)
                take = min(packs, left)
                if take < packs:
                    keep(-free, packs - take, [(n, m, r + take * m) for n, m, r in runs])
                keep(-free - length, take, [*runs, (length, 1, rank)])
                left, rank = left - take, rank + take
            else:  # none has room: each new pack is then the shortest until it is full of this length
                each = max_tokens // length
                packs, odd = divmod(left, each)
                if packs:
                    keep(max_tokens - each * length, packs, [(length, each, rank)])
                if odd:
                    keep(max_tokens - odd * length, 1, [(length, odd, rank + packs * each)])
                left = 0
    done += [(packs, runs) for _, _, packs, runs in sorted(heap)]
    rows, sequence = [], 0
    for packs, runs in done:
        offset = 0
        for length, copies, first in runs:
            rows.append((length, first, packs * copies, sequence, offset, copies))
            offset += length * copies
        sequence += packs
    return np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 6), sequence


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """token_pieces() with sequence_id and offset in place of part and nth."""
    pieces = cut(pieces)
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    base = base.select("part", "length", F.coalesce("base", F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_tokens rows at most
    plan, _ = plan_packs(histogram, max_tokens)
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("part", "nth", "base")
    names = [f.name for f in ranked.schema if f.name != "rank"]
    # a key orders rows by (length, rank); ranks stay below 2**50
    keys = (plan[:, 0] << 50) + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, (length << 50) + rank, side="right") - 1]
            j = rank - row[:, 1]
            sequence, offset = row[:, 3] + j // row[:, 5], row[:, 4] + j % row[:, 5] * length
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = T.StructType([f for f in ranked.schema if f.name != "rank"]).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, kinds)


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids] for each piece."""
    out = pack(token_pieces(docs, tokenizer, max_tokens, end_id, with_ids), max_tokens)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
