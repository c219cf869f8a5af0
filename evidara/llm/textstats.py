"""Statistics of whole documents, as numpy operations over the Arrow byte buffers of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .bytescan import raw_bytes, scan, xxh64

NAMES = (
    "log_bytes", "lower", "upper", "wide", "digit", "space", "newline", "stop", "odd", "bang", "bar", "log_words", "word_mean", "word_sd", "short_words", "long_words",
    "distinct_words", "top_word", "distinct_pairs", "top_pair", "mark_words", "log_lines", "line_mean", "distinct_lines", "repeated_line_bytes", "word_entropy",
)

_CLASS = np.full(256, 7, np.uint8)  # other signs
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[128:] = 2
_CLASS[48:58] = 3
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[0x0A] = 5
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 6
_CLASS[ord("!")] = 8
_CLASS[ord("|")] = 9
_KINDS = 10
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _per(doc: np.ndarray, weights: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(doc, weights, n).astype(float)


def _share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return x / np.maximum(of, 1.0)


def _groups(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, key): the text of each, its rows, and each text's number of distinct keys and largest count."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(d)))
    most = np.zeros(n)
    np.maximum.at(most, d[at], count)
    return d[at], count, np.bincount(d[at], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of len(NAMES) floats for each text; zeros for null, empty and blank ones."""
    raw, offsets = raw_bytes(texts)
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    w = scan(texts)
    if not len(w.starts):
        return out
    size = np.diff(offsets).astype(float)
    of = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    kinds = np.bincount(of * _KINDS + _CLASS[raw], minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    del of
    words = w.counts.astype(float)
    length = (w.ends - w.starts).astype(float)
    mean = _share(_per(w.doc, length, n), words)
    hashes = xxh64(w.buf, w.starts, w.ends)
    d, count, distinct, top = _groups(w.doc, hashes, n)
    p = count / words[d]
    entropy = _per(d, -p * np.log(p), n)
    last = w.buf[w.ends - 1]
    two = (w.doc[1:] == w.doc[:-1]) if len(w.doc) > 1 else np.zeros(0, bool)
    with np.errstate(over="ignore"):
        pairs = (hashes[:-1] * _PAIR + hashes[1:])[two]
    _, _, distinct2, top2 = _groups(w.doc[:-1][two], pairs, n)
    n2 = np.maximum(words - 1, 0)
    # lines: from a line feed or a text's begin to the next
    breaks = np.flatnonzero(raw == 0x0A)
    begin = np.unique(np.concatenate([offsets[:-1][size > 0], breaks + 1]))
    begin = begin[begin < len(raw)]
    close = np.minimum(np.append(begin[1:], len(raw)), offsets[np.searchsorted(offsets, begin, side="right")])
    home = np.searchsorted(offsets, begin, side="right") - 1
    full = close - begin > 1
    begin, close, home = begin[full], close[full], home[full]
    close = close - (raw[close - 1] == 0x0A)
    lines = _per(home, None, n)
    line_hash = xxh64(raw, begin, close)
    order = np.lexsort((line_hash, home))
    again = np.zeros(len(order), bool)
    if len(order) > 1:
        again[order[1:]] = (home[order][1:] == home[order][:-1]) & (line_hash[order][1:] == line_hash[order][:-1])
    columns = [
        np.log1p(size), *(_share(kinds[:, k], size) for k in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9)),
        np.log1p(words), mean, np.sqrt(np.maximum(_share(_per(w.doc, length**2, n), words) - mean**2, 0)), _share(_per(w.doc, length <= 3, n), words), _share(_per(w.doc, length >= 14, n), words),
        _share(distinct, words), _share(top, words), np.where(n2 > 0, _share(distinct2, n2), 1.0), np.where(n2 > 0, _share(top2, n2), 0.0), _share(_per(w.doc, np.isin(_CLASS[last], (6, 7, 8, 9)), n), words),
        np.log1p(lines), np.log1p(_share(size, lines)), _share(lines - _per(home, again, n), lines), _share(_per(home, (close - begin) * again, n), size), _share(entropy, np.log(words + 1)),
    ]
    out = np.column_stack(columns)
    out[words == 0] = 0.0
    return out
