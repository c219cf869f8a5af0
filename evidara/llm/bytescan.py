"""Words, shingles and hashes of many texts at once, as numpy operations over the Arrow byte buffers.

A word is a longest run of bytes outside {0x20, 0x09-0x0D}; A-Z count as a-z. Null texts count as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = np.where(_SPACE, 0x20, np.arange(256)).astype(np.uint8)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[_SPACE] = 0x20

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(0x9E3779B185EBCA87),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63),
    np.uint64(0x27D4EB2F165667C5),
)


@dataclass
class Words:
    """buf: bytes (A-Z as a-z, unless they are kept) with one space between words; word i of all is buf[starts[i]:ends[i]], of text doc[i]."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    counts: np.ndarray


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and len(texts) + 1 offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return everything[offsets[0] : offsets[-1]], offsets - offsets[0]


def scan(texts: pa.Array, fold: bool = True) -> Words:
    raw, offsets = raw_bytes(texts)
    n = len(offsets) - 1
    if not len(raw):
        none = np.zeros(0, np.int64)
        return Words(raw, none, none, none, np.zeros(n, np.int64))
    space = _SPACE[raw]
    fresh = np.zeros(len(raw) + 1, dtype=bool)  # where a text begins
    fresh[offsets] = True
    before = np.empty(len(raw), dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    begins = ~space & (before | fresh[:-1])
    keep = ~space | ~before
    place = np.cumsum(keep) - 1  # of kept bytes in buf
    after = np.empty(len(raw), dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    closes = ~space & (after | fresh[1:])
    at = np.flatnonzero(begins)
    doc = np.searchsorted(offsets, at, side="right") - 1
    return Words((_FOLD if fold else _PLAIN)[raw[keep]], place[at], place[np.flatnonzero(closes)] + 1, doc, np.bincount(doc, minlength=n))


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotate(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[starts[i]:ends[i]] for each i, as uint64."""
    count = len(starts)
    out = np.empty(count, np.uint64)
    if not count:
        return out
    size = ends - starts
    long = np.flatnonzero(size > 128)
    if len(long):
        whole = buf.tobytes()
        out[long] = [xxhash.xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    order = np.flatnonzero(size <= 128)
    if not len(order):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    halves = np.ndarray(shape=(len(padded) - 3,), dtype="<u4", buffer=padded, strides=(1,))
    at, left = starts[order].astype(np.int64), size[order].astype(np.int64)
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        acc = np.full(len(order), s + _P5, np.uint64)
        wide = np.flatnonzero(left >= 32)
        if len(wide):
            acc[wide] = _stripes(lanes, at[wide], left[wide] // 32, s)
            at[wide] += left[wide] // 32 * 32
        acc += left.astype(np.uint64)
        left = left % 32
        for _ in range(3):
            on = np.flatnonzero(left >= 8)
            if not len(on):
                break
            acc[on] = _rotate(acc[on] ^ _round(np.uint64(0), lanes[at[on]]), 27) * _P1 + _P4
            at[on] += 8
            left[on] -= 8
        on = np.flatnonzero(left >= 4)
        if len(on):
            acc[on] = _rotate(acc[on] ^ (halves[at[on]].astype(np.uint64) * _P1), 23) * _P2 + _P3
            at[on] += 4
            left[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(left > 0)
            if not len(on):
                break
            acc[on] = _rotate(acc[on] ^ (padded[at[on]].astype(np.uint64) * _P5), 11) * _P1
            at[on] += 1
            left[on] -= 1
        acc = (acc ^ (acc >> np.uint64(33))) * _P2
        acc = (acc ^ (acc >> np.uint64(29))) * _P3
        out[order] = acc ^ (acc >> np.uint64(32))
    return out


def _stripes(lanes: np.ndarray, at: np.ndarray, stripes: np.ndarray, seed: np.uint64) -> np.ndarray:
    """The accumulators after all whole 32-byte stripes, merged."""
    v = [np.full(len(at), x, np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
    for k in range(int(stripes.max())):
        on = np.flatnonzero(stripes > k)
        for i in range(4):
            v[i][on] = _round(v[i][on], lanes[at[on] + 32 * k + 8 * i])
    acc = _rotate(v[0], 1) + _rotate(v[1], 7) + _rotate(v[2], 12) + _rotate(v[3], 18)
    for x in v:
        acc = (acc ^ _round(np.uint64(0), x)) * _P1 + _P4
    return acc
