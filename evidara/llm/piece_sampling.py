"""Distinct sampled segmentations of texts into SentencePiece pieces: Gumbel top-k without replacement by perturbed A-star over the lattice.

A text's lattice has an arc for each piece that matches at a place; a path is a segmentation, its log-probability the sum of its pieces' weights (times an
inverse temperature) less the lattice's log-mass. Weights are a unigram model's scores; a BPE model has merge ranks in their place, of which
the weight is -log(rank + 2), as Zipf's law has it. The best k paths by log-probability plus independent Gumbel noise are k samples without replacement.
The search holds regions of paths (those that share a begin and part from known paths at one arc) with the exact maximum
of the perturbed values in each, drawn when the region comes about: it takes the region of the highest maximum, draws its best path, and splits what is left by where other paths part
from it. The region that would come next gives the threshold t, and exp(-exp(log p - t)) the chance that a path stays out: its inclusion score.

Texts fall apart where no piece can cross (mostly at words), so arcs and masses are worked out once for each distinct part of a batch, and all texts of a batch are sampled together.
Places of a path are looked at from its begin on, until the least possible noise (_LEAST) cannot bring a later region among those wanted, or down to a log-mass of -700, below which doubles end.
Noise comes from a hash of (seed, row key, sample, part, step), so a row's samples depend on nothing else.

Defined cases: null and empty texts have one segmentation, the empty one; texts with fewer than k segmentations give all they have, with inclusion 1; characters without
a piece become their bytes' pieces; pieces that the file disables (scores of -10^8 and below) are not used; a null row key is key 0 for the noise; rows that repeat give equal samples; other
columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import slices
from .ngram_lm import mix

SAMPLES = 3
ALPHA = 1.0
SEED = 3
#: Bytes of text sampled together: the arcs of their distinct parts and all paths take some 60 times as much.
SLICE = 2 << 20
_CP = 21
#: The uniform numbers' steps of 2**-53 bound the noise: no region comes more than this over its log-mass. None is looked at below _END.
_LEAST, _END = -37.5, -700.0
#: Characters of parts whose masses are summed as they are, and the exponent of their scale: 52 * 12 lies within a double's 700.
SHORT, RISE = 52, 12.0
#: Arcs at the begin of a path among which regions are looked for first, and numbers of a matrix of paths by places.
_HEAD, _CELLS = 384, 1 << 18


class Lattice:
    """The model's pieces as a trie in sorted arrays."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.model, self.model.get_piece_size()
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) and (m.get_score(i) > -1e8 or len(m.id_to_piece(i)) == 1)]
        pieces, scores = [m.id_to_piece(i) for i in plain], np.array([m.get_score(i) for i in plain])
        scores = np.maximum(scores, scores[scores > -1e8].min(initial=0.0))
        ranks = bool(len(scores)) and bool(np.all(scores == np.round(scores))) and scores.min() < -1000
        weight = alpha * (-np.log(2.0 - scores) if ranks else scores)
        self.byte_weight = float(weight.min(initial=0.0))
        self.bytes = {m.id_to_piece(i): i for i in range(n) if m.is_byte(i)}
        self.unknown, self.spelt = m.unk_id(), {}
        spelt = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).encode() for i in range(n)]
        self.text = pa.array(spelt, pa.large_binary())
        self.weight_of = np.zeros(n)
        self.weight_of[plain] = weight
        # trie
        node: dict[tuple[int, int], int] = {}
        count, at, value, depth = 1, [-1], [0.0], [0]
        for piece, i, w in zip(pieces, plain, weight):
            here = 0
            for c in piece:
                there = node.get((here, ord(c)))
                if there is None:
                    there = node[here, ord(c)] = count
                    at.append(-1)
                    value.append(0.0)
                    depth.append(depth[here] + 1)
                    count += 1
                here = there
            at[here], value[here] = i, w
        self.bits = max(4, (4 * len(node)).bit_length())
        self.keys, self.child = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        for (a, c), b in node.items():
            at_ = int(self._slot(np.array([(a << _CP) | c]))[0])
            while self.keys[at_] >= 0:
                at_ = (at_ + 1) & ((1 << self.bits) - 1)
            self.keys[at_], self.child[at_] = (a << _CP) | c, b
        self.root = np.zeros(0x110000, np.int32)
        self.root[[c for a, c in node if a == 0]] = [b for (a, _), b in node.items() if a == 0]
        self.piece, self.weight = np.array(at, np.int32), np.array(value)
        with np.errstate(over="ignore"):
            self.raised = np.exp(self.weight + RISE * np.array(depth))  # pieces longer than SHORT may be too much for a double, and stand in no short part
        # a text may be cut before a word mark, and around line breaks and tabs, if no piece crosses there
        inside = {c for p in pieces for c in p if len(p) > 1}
        self.signs = np.zeros(256, bool)
        self.signs[[ord(c) for c in "\n\t\r" if c not in inside]] = True
        self.whole = any("▁" in p[1:] for p in pieces)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def children(self, node: np.ndarray, cp: np.ndarray) -> np.ndarray:
        """The child of each node by a character, 0 for none (hash table with linear probing)."""
        key = (node.astype(np.int64) << _CP) | cp
        slot, out = self._slot(key), np.zeros(len(key), np.int32)
        held = self.keys[slot]
        same = held == key
        out[same] = self.child[slot[same]]
        who = np.flatnonzero(~same & (held >= 0))
        while len(who):
            slot[who] = (slot[who] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[who]]
            same = held == key[who]
            out[who[same]] = self.child[slot[who[same]]]
            who = who[~same & (held >= 0)]
        return out

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The parts of normalised texts: how many each text has, the number of each part's kind, and the kinds by number."""
        own = [t.encode() for t in texts]
        data, end = b"".join(own), np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
        raw, begins = np.frombuffer(data, np.uint8), np.zeros(len(data) + 1, bool)
        begins[0] = True
        begins[end] = True
        if not self.whole and len(raw):
            mark = np.frombuffer("▁".encode(), np.uint8)
            at = np.flatnonzero(raw[: len(raw) - 2] == mark[0])
            begins[at[(raw[at + 1] == mark[1]) & (raw[at + 2] == mark[2])]] = True
            at = np.flatnonzero(self.signs[raw])
            begins[at] = True
            begins[at + 1] = True
        begins[-1] = True
        edge = np.flatnonzero(begins)
        parts = pa.LargeStringArray.from_buffers(len(edge) - 1, pa.py_buffer(edge), pa.py_buffer(data)).dictionary_encode()
        return np.diff(np.searchsorted(edge, end), prepend=0), parts.indices.to_numpy().astype(np.int64), parts.dictionary

    def fallback(self, cp: int) -> list[int]:
        """The pieces of a character's bytes."""
        found = self.spelt.get(cp)
        if found is None:
            found = self.spelt[cp] = [self.bytes.get(f"<0x{b:02X}>", self.unknown) for b in chr(cp).encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]
        return found


@lru_cache(maxsize=2)
def lattice(path: str, alpha: float) -> Lattice:
    return Lattice(path, alpha)


class Parts:
    """Arcs of the lattices of distinct parts. A state is a place in the joined parts; arcs of a state stand together."""

    def __init__(self, model: Lattice, parts: list[str] | pa.Array):
        parts = pa.array(parts, pa.large_string())
        edge = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
        cp = np.frombuffer(parts.buffers()[2].to_pybytes()[edge[0] : edge[-1]].decode().encode("utf-32-le"), np.int32)
        size = pc.utf8_length(parts).to_numpy().astype(np.int64)
        self.first = np.cumsum(size) - size
        end = np.repeat((self.first + size).astype(np.int32), size)
        starts, ends, pieces, raised = [], [], [], []
        place, node, step = np.arange(len(cp), dtype=np.int32), np.zeros(len(cp), np.int32), 0
        single = np.zeros(len(cp), bool)
        while len(place):
            node = model.children(node, cp[place + step]) if step else model.root[cp]
            ok = node > 0
            place, node = place[ok], node[ok]
            step += 1
            on = model.piece[node] >= 0
            if step == 1:
                single[place[on]] = True
            starts.append(place[on])
            ends.append(place[on] + step)
            pieces.append(model.piece[node[on]])
            raised.append(model.raised[node[on]])
            more = place + step < end[place]
            place, node = place[more], node[more]
        odd = np.flatnonzero(~single).astype(np.int32)
        starts.append(odd)
        ends.append(odd + 1)
        pieces.append(-1 - cp[odd])  # a character that becomes bytes
        kinds, back = np.unique(cp[odd], return_inverse=True)
        odd_weight = np.array([model.byte_weight * len(model.fallback(c)) for c in kinds.tolist()])
        raised.append(np.exp(odd_weight + RISE)[back] if len(odd) else np.zeros(0))
        count = np.zeros(len(cp), np.int32)
        for own in starts:
            count[own] += 1
        self.ptr = np.concatenate([[0], np.cumsum(count)])
        arcs, places = int(self.ptr[-1]), len(cp)
        start, stop = np.repeat(np.arange(places, dtype=np.int32), count), np.empty(arcs, np.int32)
        self.piece, value, free = np.empty(arcs, np.int32), np.empty(arcs), self.ptr[:-1].copy()
        # of one start the longest piece comes first: it mostly is the likeliest, so a draw ends after an arc or two
        for own, to, what, w in zip(starts[::-1], ends[::-1], pieces[::-1], raised[::-1]):
            at = free[own]
            stop[at], self.piece[at], value[at] = to, what, w
            free[own] += 1
        del starts, ends, pieces, raised, place, node, free
        over = end[start]
        last, left = stop == over, over - start
        stop[last] = places  # a place of its own after all others, where a part is done
        by = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 65536 else left, kind="stable")
        mass = np.zeros(places + 1)

        def summed(by: np.ndarray, value: np.ndarray, add) -> np.ndarray:
            """value (of the arcs by) with what lies after the arcs, place by place from the parts' ends on; puts the places' masses in mass."""
            s, to = start[by], stop[by]
            head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            for a, b in _runs(left[by]):
                own = head[np.searchsorted(head, a) : np.searchsorted(head, b)]
                mass[s[own]] = add(value, to, a, b, own - a)
            return value

        def logs(value, to, a, b, head):
            v = value[a:b]
            v += mass[to[a:b]]
            top = np.maximum.reduceat(v, head)
            return top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.append(head, b - a)))), head))

        def products(value, to, a, b, head):
            v = value[a:b]
            v *= mass[to[a:b]]
            return np.add.reduceat(v, head)

        # parts of words' sizes: sums of paths as they are, multiplied by e to RISE for each character, which keeps them far from a double's ends
        short = np.ones(arcs, bool) if not len(left) or left.max() <= SHORT else np.repeat(size <= SHORT, size)[start]
        own_by = by if short.all() else by[short[by]]
        mass[places] = 1.0
        value[own_by] = summed(own_by, value[own_by], products)
        per = np.repeat(mass[:-1], count)
        plain = short & (per > 1e-280) & (per < 1e280)
        if plain.all():
            p = np.minimum(value / per, 1.0)
            self.logp = np.log(p)
        else:  # parts with a mass near a double's ends, and long ones
            part = np.repeat(np.arange(len(parts)), size)
            far = np.zeros(len(parts), bool)
            far[part[start[~plain]]] = True
            again = far[part][start]
            p = np.minimum(np.divide(value, per, out=np.ones(arcs), where=~again & (per > 0)), 1.0)
            own_by = by[again[by]]
            own = self.piece[own_by]
            weight, mass[places] = model.weight_of[np.maximum(own, 0)], 0.0
            weight[own < 0] = odd_weight[np.searchsorted(kinds, -1 - own[own < 0])] if len(odd) else 0.0
            value[own_by] = summed(own_by, weight, logs)
            self.logp = np.where(again, np.minimum(value - np.repeat(mass[:-1], count), 0.0), np.log(p))
            p = np.exp(self.logp)
        stop[last] = -1
        self.start, self.next = start, stop
        del value, left, by, own_by, last, over, per
        self.edge = np.cumsum(p)
        if len(start):
            shift = np.concatenate([[0.0], self.edge])[self.ptr[:-1]]
            self.edge -= np.repeat(shift, count)
            self.edge[self.ptr[1:] - 1] = 2.0  # the last arc takes what rounding leaves

    def choose(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An arc of each state by a uniform number."""
        arc = self.ptr[state]
        who = np.flatnonzero(u >= self.edge[arc])
        while len(who):
            arc[who] += 1
            who = who[u[who] >= self.edge[arc[who]]]
        return arc


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(0, np.int64)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


_FULL = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def _seeds(key: np.ndarray, sample: int, place: np.ndarray | int) -> np.ndarray:
    """What the numbers of all steps come of."""
    with np.errstate(over="ignore"):
        return key + ((np.asarray(place).astype(np.uint64) << np.uint64(24)) + np.uint64(sample << 58)) * np.uint64(_STEP)


def _drawn(seeds: np.ndarray, step: int = 0) -> np.ndarray:
    x = mix(seeds + np.uint64((step * _STEP) & _FULL))
    x >>= np.uint64(11)
    u = x.astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


def _uniform(key: np.ndarray, sample: int, place: np.ndarray | int, step: int = 0) -> np.ndarray:
    """Numbers in (0, 1) by a hash of the key and the numbers."""
    return _drawn(_seeds(key, sample, place), step)


def _one(key: int, sample: int, place: int, step: int = 0) -> float:
    """_uniform() of one key, in plain numbers: an array for each number of a text takes many times as long."""
    x = (key + (((place << 24) + (sample << 58) + step) & _FULL) * _STEP) & _FULL
    x ^= x >> 30
    x = (x * 0xBF58476D1CE4E5B9) & _FULL
    x ^= x >> 27
    x = (x * 0x94D049BB133111EB) & _FULL
    x ^= x >> 31
    return ((x >> 11) + 0.5) * 2.0**-53


def _paths(parts: Parts, state: np.ndarray, key: np.ndarray, sample: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Arcs from each state (of part number place of its text) to its part's end: arcs in the order of the states, and how many each has."""
    count = np.zeros(len(state), np.int64)
    who = np.argsort(state.astype(np.int32))  # near states lie near in memory
    now, seeds, step, taken = state[who], _seeds(key, sample, place)[who], 0, []
    while len(who):
        arc = parts.choose(now, _drawn(seeds, step))
        taken.append((who, arc))
        now, step = parts.next[arc], step + 1
        on = now >= 0
        count[who[~on]] = step
        who, now, seeds = who[on], now[on], seeds[on]
    offset = np.cumsum(count) - count
    arcs = np.empty(int(count.sum()), np.int32)
    for i, (w, a) in enumerate(taken):
        arcs[offset[w] + i] = a
    return arcs, count


def _regions(parts: Parts, paths: list[np.ndarray], lead: np.ndarray, key: np.ndarray, sample: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Path, place and low (minus the logarithm of what the noise adds to exp(-limit)) of the wanted highest regions of each path from its place lead on, highest first.

    A region is all that parts from its path at one place. Its mass over an exponential number is exp(low). Paths of like length go into a matrix, with the
    first reach places; where a later region may come before the last of those found, with four times as many.
    """
    size = np.fromiter(map(len, paths), np.int64, len(paths))
    todo, reach, found = np.argsort(size, kind="stable"), _HEAD, []
    while len(todo):
        again, at = [], 0
        while at < len(todo):
            # paths go by length, so the last that fits is the widest
            width = np.minimum(size[todo[at : at + _CELLS]], reach)
            n = max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), _CELLS, side="right")))
            which, wide = todo[at : at + n], int(width[n - 1])
            at += n
            places, logp = np.arange(wide), np.zeros((n, wide))
            logp[places < width[:n, None]] = parts.logp[np.concatenate([paths[w][:reach] for w in which.tolist()])]
            total = np.cumsum(logp, axis=1)
            before = np.concatenate([np.zeros((n, 1)), total[:, :-1]], axis=1)[:, :wide]
            u = _drawn(_seeds(key[which][:, None], sample, places))
            with np.errstate(divide="ignore", invalid="ignore"):
                race = np.exp(before) * np.expm1(logp) / np.log(u)
            race[~((logp < 0) & (before > _END) & (places >= lead[which][:, None]))] = -1.0
            rows, least = np.arange(n), np.full(n, -np.inf)
            for i in range(min(wanted, wide)):
                best = race.argmax(axis=1)
                ok = np.flatnonzero(race[rows, best] >= 0)
                best = best[ok]
                with np.errstate(divide="ignore"):
                    low = before[ok, best] + np.log(-np.expm1(logp[ok, best])) - np.log(-np.log(u[ok, best]))
                race[ok, best] = -1.0
                found.append((which[ok], best, low))
                if i == wanted - 1:
                    least[ok] = low
            sure = (size[which] <= reach) | (total[:, -1] <= np.maximum(least + _LEAST, _END))
            again.append(which[~sure])
        left = np.concatenate(again)
        if len(left):
            out = np.zeros(len(paths), bool)
            out[left] = True
            found = [tuple(x[~out[f[0]]] for x in f) for f in found]
        todo, reach = left, 4 * reach
    path, place, low = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((-low, path))
    return path[by], place[by], low[by]


def _without(arcs: np.ndarray, gone: list[int]) -> np.ndarray:
    for g in gone:
        arcs = arcs[arcs != g]
    return arcs


def sample_texts(texts: list[str | None], keys: list[int | None], path: str, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, normal: list[str] | None = None) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples, best first: (piece ids, log-probability, perturbed value, log of the inclusion score). normal: the texts as the model normalises them, if they are at hand."""
    if not 0 < k < 15:
        raise ValueError("from 1 to 14 samples")
    model = lattice(path, alpha)
    sizes, code, distinct = model.split(normal if normal is not None else [model.model.normalize(t) if t else "" for t in texts])
    parts = Parts(model, distinct) if len(distinct) else None
    first = np.cumsum(sizes) - sizes
    own_key = mix(np.array([0 if x is None else x for x in keys], np.int64).view(np.uint64) ^ mix(np.array([seed], np.uint64)))
    out: list[list] = [[] for _ in texts]
    regions: list[list[tuple]] = [[] for _ in texts]  # (maximum, sample it parts from, arc it parts at, arcs that are out)
    active = np.flatnonzero(sizes > 0)
    highest, number = -np.log(-np.log(_uniform(own_key, 63, 0))), own_key.tolist()
    for d in np.flatnonzero(sizes == 0):
        out[d].append((np.zeros(0, np.int64), 0.0, float(highest[d]), []))
    paths: list[list[np.ndarray]] = [[] for _ in texts]
    for r in range(k):
        state_of, place_of, doc_of, plans = [], [], [], []
        for d in active.tolist():
            if r == 0:
                plans.append((d, None, float(highest[d])))
                state_of.append(parts.first[code[first[d] : first[d] + sizes[d]]])
                place_of.append(np.arange(sizes[d]))
            else:
                if not regions[d]:
                    continue
                best = max(range(len(regions[d])), key=lambda i: regions[d][i][0])
                value, sample, j, gone = regions[d].pop(best)
                path = paths[d][sample]
                state = int(parts.start[path[j]])
                arcs = np.arange(parts.ptr[state], parts.ptr[state + 1])
                left = _without(arcs, gone)
                p = np.cumsum(np.exp(parts.logp[left] - parts.logp[left].max()))
                u = _one(number[d], r + 16, j)
                arc = int(left[min(int(np.searchsorted(p, u * p[-1], side="right")), len(left) - 1)])
                part = int((parts.next[path[:j]] < 0).sum())
                rest = parts.first[code[first[d] + part + 1 : first[d] + sizes[d]]]
                places = np.arange(part + 1, sizes[d])
                if parts.next[arc] >= 0:
                    rest, places = np.concatenate([[parts.next[arc]], rest]), np.concatenate([[part], places])
                plans.append((d, (path[:j], arc, j, gone), value))
                state_of.append(rest)
                place_of.append(places)
            doc_of.append(np.full(len(state_of[-1]), d))
        if not plans:
            break
        doc = np.concatenate(doc_of)
        arcs, count = _paths(parts, np.concatenate(state_of).astype(np.int64), own_key[doc], r, np.concatenate(place_of))
        ends = np.cumsum(count)
        taken = 0
        whole, lead, owner, limit = [], [], [], []
        for (d, begin, value), states in zip(plans, state_of):
            a = int(ends[taken - 1]) if taken else 0
            taken += len(states)
            suffix = arcs[a : int(ends[taken - 1]) if taken else 0]
            path = suffix if begin is None else np.concatenate([begin[0], [begin[1]], suffix])
            paths[d].append(path)
            whole.append(path)
            lead.append(0 if begin is None else begin[2] + 1)
            owner.append(d)
            limit.append(value)
        whose, lead_, limit_ = own_key[np.array(owner)], np.array(lead), np.array(limit)
        wanted = k - r  # one for each sample still to come, and one for the threshold
        path, place, low = _regions(parts, whole, lead_, whose, r + 32, wanted)
        with np.errstate(over="ignore", divide="ignore"):
            value = -np.log(np.exp(-limit_[path]) + np.exp(-low))
        for w, at, v in zip(path.tolist(), place.tolist(), value.tolist()):
            if v > -np.inf:
                d = owner[w]
                regions[d].append((v, len(paths[d]) - 1, at, [int(whole[w][at])]))
        for w, (d, begin, value_) in enumerate(plans):
            if begin is not None:  # what is left of the region at the arc itself
                gone = [*begin[3], begin[1]]
                state = int(parts.start[begin[1]])
                arcs_ = np.arange(parts.ptr[state], parts.ptr[state + 1])
                left = _without(arcs_, gone)
                if len(left):
                    mass_ = float(parts.logp[begin[0]].sum()) + float(np.log(np.exp(parts.logp[left]).sum()))
                    e = -math.log(_one(number[d], r + 48, begin[2]))
                    if mass_ > -700:
                        regions[d].append((-math.log(math.exp(-value_) + e * math.exp(-mass_)), len(paths[d]) - 1, begin[2], gone))
            p = float(parts.logp[whole[w]].sum())
            out[d].append((whole[w], p, value_, None))
    result = []
    for d, samples in enumerate(out):
        threshold = max((x[0] for x in regions[d]), default=-math.inf)
        rows = []
        for arcs_, p, value, _ in samples:
            ids = np.zeros(0, np.int64)
            if len(arcs_):
                ids = parts.piece[arcs_]
                odd = ids < 0
                if odd.any():
                    spelt = [model.fallback(-1 - x) for x in ids[odd].tolist()]
                    reps = np.ones(len(ids), np.int64)
                    reps[odd] = [len(x) for x in spelt]
                    ids = np.repeat(ids, reps)
                    ids[np.repeat(odd, reps)] = list(chain.from_iterable(spelt))
            # log(1 - exp(-exp(p - t))), near p - t where that is small
            x = p - threshold
            rows.append((ids, p, value, 0.0 if threshold == -math.inf else x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))))
        result.append(rows)
    return result


def decode(ids: np.ndarray, path: str, alpha: float = ALPHA) -> bytes:
    """The normalised text (with word marks) that the pieces spell, in UTF-8."""
    if not len(ids):
        return b""
    return lattice(path, alpha).text.take(pa.array(ids)).buffers()[2].to_pybytes()


def plain_text(ids: np.ndarray, path: str, alpha: float = ALPHA) -> str:
    """The text that the pieces spell, without word marks and the mark put before it."""
    return decode(ids, path, alpha).decode("utf-8", "replace").replace("▁", " ").removeprefix(" ")


def sample_segmentations(docs: DataFrame, path: str, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, with_ids: bool = True) -> DataFrame:
    """doc_id, sample (from 1), n_pieces, ids_crc32, log_prob, perturbed, log_inclusion, round_trip (decoding gives the normalised text)[, ids]."""
    names = ["doc_id", "sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "log_inclusion", "round_trip"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            keys, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            normalize = lattice(path, alpha).model.normalize
            rows, normal = [], [normalize(t) if t else "" for t in texts]
            for key, text, samples in zip(keys, normal, sample_texts(texts, keys, path, k, alpha, seed, normal)):
                whole = text.encode()
                for i, (ids, p, value, inclusion) in enumerate(samples, 1):
                    rows.append((key, i, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), p, value, inclusion, decode(ids, path, alpha) == whole) + ((ids.tolist(),) if with_ids else ()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
