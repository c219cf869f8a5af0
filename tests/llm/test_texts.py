"""SimHash, packing, language model and segmentations against brute force, and their odd cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from evidara.llm import bytescan, ngram_lm, packing, piece_sampling as ps, simhash
from evidara.llm.queries import PACK_TOKENIZER, PIECE_MODEL, tokenizer_path
from tests.llm.conftest import ODD, sentence

rnd = random.Random(5)
NOISE = ["".join(rnd.choice("abXYé  \n\t日") for _ in range(rnd.randrange(0, 300))) for _ in range(60)]


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def test_scan_and_hash():
    texts = ODD + NOISE
    w = bytescan.scan(pa.array(texts))
    body = w.buf.tobytes()
    flat = [x for t in texts for x in words(t)]
    assert [body[a:b] for a, b in zip(w.starts, w.ends)] == flat
    assert bytescan.xxh64(w.buf, w.starts, w.ends).tolist() == [xxhash.xxh64_intdigest(x, 42) for x in flat]


def fingerprint(t):
    own = words(t)
    hashes = [xxhash.xxh64_intdigest(b" ".join(own[i : i + 3]), 42) for i in range(max(1, len(own) - 2))] if own else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(ids, prints, radius):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in zip(ids, prints):
        for b, y in zip(ids, prints):
            if a < b and (x ^ y).bit_count() <= radius:
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("tile", [3, 4096])
def test_simhash_components(spark, odd, tile):
    rows = simhash.near_duplicates(odd, tile=tile).collect()
    assert len(rows) == len(ODD) + 3
    prints = {i: fingerprint(t) for i, t in enumerate(ODD)}
    least = smallest_reachable(list(prints), list(prints.values()), 3)
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", least[r["doc_id"]])
        else:
            assert r["fingerprint"] == f"{fingerprint('no id here'):016x}"


def test_simhash_links_random_fingerprints(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 6), replace=False)) for x in base for _ in range(4)]
    prints = sorted({int(x) for x in base} | set(near))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, rep long")
    for chunk in (5, 10**6):
        got = {r["node"]: r["component"] for r in simhash.components(simhash.links(df, 3, tile=16), chunk=chunk).collect()}
        wanted = smallest_reachable(list(range(len(prints))), prints, 3)
        assert all(got.get(i, i) == c for i, c in wanted.items())


def test_simhash_empty(none):
    assert simhash.near_duplicates(none).count() == 0


def test_packing(odd, none):
    from tokenizers import Tokenizer

    path = tokenizer_path(PACK_TOKENIZER)
    plain = Tokenizer.from_file(path)
    rows = packing.pack_documents(odd, path, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        by_doc[r["doc_id"]].append((r["start"], ids.tolist(), r["doc_tokens"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(ODD):
        wanted = plain.encode(t or "", add_special_tokens=False).ids + [1]
        copies = 2 if i in (4, 12) else 1
        assert sorted(x for _, ids, _ in by_doc[i] for x in ids) == sorted(wanted * copies)
        if copies == 1:
            assert [x for _, ids, _ in sorted(by_doc[i]) for x in ids] == wanted
        assert {n for *_, n in by_doc[i]} == {len(wanted)}
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none, path).count() == 0


def test_packing_repeats_and_pads_little(spark):
    path, docs = tokenizer_path(PACK_TOKENIZER), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    once, again = (sorted(tuple(r) for r in packing.pack_documents(docs, path).collect()) for _ in range(2))
    assert once == again
    tokens, sequences = sum(r[2] for r in once), 1 + max(r[5] for r in once)
    assert tokens / (2048 * sequences) > 0.99


@pytest.mark.parametrize("lengths", [[10] * 999, [1000, 1000, 3], [rnd.randrange(1, 2049) for _ in range(5000)], [2048] * 3 + [2047, 1, 1], []])
def test_pack_plan_places_every_rank_once(lengths):
    plan, n = packing.plan_packs(Counter(lengths))
    slots, ranks = defaultdict(list), defaultdict(list)
    for length, first, count, sequence, offset, copies in plan.tolist():
        for j in range(count):
            slots[sequence + j // copies].append((offset + j % copies * length, length))
            ranks[length].append(first + j)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in Counter(lengths).items()}
    assert len(slots) == n
    for parts in slots.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


class KneserNey:
    """The same model by dictionaries."""

    def __init__(self, texts):
        docs = [[*words(t), None] for t in texts]
        self.count = Counter(w for d in docs for w in d)
        self.n, self.v, self.docs = sum(self.count.values()), len(self.count), len(docs)
        self.pairs = Counter(p for d in docs for p in zip(["begin", *d[:-1]], d))
        self.after, self.context, self.before = defaultdict(lambda: [0, 0, 0]), Counter(), Counter()
        for (u, w), c in self.pairs.items():
            self.context[u] += c
            self.after[u][min(c, 3) - 1] += 1
            self.before[w] += 1
        of = lambda values: ngram_lm.discounts([sum(x == i for x in values) for i in (1, 2, 3, 4)])
        self.d2, self.d1 = of(list(self.pairs.values())), of(list(self.before.values()))

    def word(self, w):
        c = self.before.get(w, 0)
        seen = sum(self.d1[min(x, 3)] for x in self.before.values()) / len(self.pairs)
        return max(c - self.d1[min(c, 3)], 0) / len(self.pairs) + seen / (self.v + 1)

    def score(self, t):
        out, u = 0.0, "begin"
        for w in [*words(t), None]:
            p = self.word(w)
            if u in self.context:
                c = self.pairs.get((u, w), 0)
                held = sum(a * b for a, b in zip(self.after[u], self.d2[1:]))
                p = max(c - self.d2[min(c, 3)], 0) / self.context[u] + held / self.context[u] * p
            out, u = out + math.log10(p), w
        return out


def test_language_model(spark, odd, none):
    learns = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    texts = [t for i, t in enumerate(ODD) if learns(i) for _ in range(2 if i in (4, 12) else 1)]
    model = KneserNey(texts)
    rows = ngram_lm.held_out_scores(odd).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        t = ODD[r["doc_id"]] if r["doc_id"] is not None else "no id here"
        tokens = [*words(t), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(w in model.count for w in tokens), model.n)
        assert r["held_out"] == (r["doc_id"] is not None and not learns(r["doc_id"]))
        assert math.isclose(r["base_score"], sum(math.log10((model.count[w] + 1) / (model.n + model.v + 1)) for w in tokens), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r["score"], model.score(t), rel_tol=1e-9, abs_tol=1e-9)
    assert ngram_lm.held_out_scores(none).count() == 0
    untrained = ngram_lm.held_out_scores(odd.filter("doc_id is null")).first()
    assert (untrained["score"], untrained["base_score"], untrained["train_tokens"]) == (0.0, 0.0, 0)


def test_language_model_sums_to_one(spark):
    texts = [sentence(i) for i in range(30)]
    model = ngram_lm.train_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    oracle = KneserNey(texts)
    outcomes = [*oracle.count, b"neverseen"]
    held = lambda u: sum(a * b for a, b in zip(oracle.after[u], oracle.d2[1:])) / oracle.context[u]
    for u in [w for w in oracle.context if w != "begin"][:5]:
        p = [max(oracle.pairs.get((u, w), 0) - oracle.d2[min(oracle.pairs.get((u, w), 0), 3)], 0) / oracle.context[u] + held(u) * oracle.word(w) for w in outcomes]
        assert math.isclose(sum(p), 1, rel_tol=1e-9)
    asked = [f"{sentence(1)} {w}" for w in ("neverseen", "stone", "")]
    assert np.allclose(ngram_lm.Scorer(model).score(pa.array(asked))[3], [oracle.score(t) for t in asked])


def test_segmentations_against_all_paths():
    path = tokenizer_path(PIECE_MODEL)
    model = ps.lattice(path, ps.ALPHA)
    text = "an ab\n c"
    whole = model.model.normalize(text)

    def walk(i):
        if i == len(whole):
            yield (), 0.0
            return
        node, single = 0, False
        for j in range(i, len(whole)):
            node = int(model.children(np.array([node]), np.array([ord(whole[j])]))[0])
            if not node:
                break
            if model.piece[node] >= 0:
                single |= j == i
                for ids, w in walk(j + 1):
                    yield (int(model.piece[node]), *ids), w + model.weight[node]
        if not single:
            own = model.fallback(ord(whole[i]))
            for ids, w in walk(i + 1):
                yield (*own, *ids), w + model.byte_weight * len(own)

    paths = dict(walk(0))
    mass = math.log(sum(map(math.exp, paths.values())))
    n = 4000
    got = ps.sample_texts([text] * n, list(range(n)), path, 3)
    first, second = Counter(tuple(g[0][0].tolist()) for g in got), Counter(tuple(g[1][0].tolist()) for g in got)
    p = {k: math.exp(w - mass) for k, w in paths.items()}
    after = {b: sum(p[a] * p[b] / (1 - p[a]) for a in p if a != b) for b in p}
    for found, wanted in ((first, p), (second, after)):
        assert 0.5 * sum(abs(found[k] / n - wanted[k]) for k in p) < 0.02
    for g in got[:200]:
        assert len({tuple(s[0].tolist()) for s in g}) == 3
        assert [s[2] for s in g] == sorted((s[2] for s in g), reverse=True)
        assert all(math.isclose(s[1], paths[tuple(s[0].tolist())] - mass, abs_tol=1e-9) for s in g)
    assert math.isclose(np.mean([sum(math.exp(s[1] - s[3]) for s in g) for g in got]), 1, abs_tol=0.02)


def test_masses_of_long_and_odd_parts():
    """Arcs of one state sum to one, whichever way a part's masses are summed, and agree with those of a part alone."""
    path = tokenizer_path(PIECE_MODEL)
    model = ps.lattice(path, ps.ALPHA)
    texts = ["▁the", "▁" + "x" * 400, "▁" + "\U0001F600" * 50, "▁" + "é" * 60, "▁internationalisation", "日本語" * 17, "a"]
    both = ps.Parts(model, texts)
    total = np.add.reduceat(np.exp(both.logp), both.ptr[:-1])
    assert np.allclose(total, 1, atol=1e-9) and (both.logp <= 0).all()
    for text, first in zip(texts, both.first):
        alone = ps.Parts(model, [text])
        a, b = both.ptr[first], both.ptr[first + len(text)]
        assert np.allclose(alone.logp, both.logp[a:b], atol=1e-8) and alone.piece.tolist() == both.piece[a:b].tolist()


def test_segmentations_of_a_table(odd, none):
    path = tokenizer_path(PIECE_MODEL)
    df = ps.sample_segmentations(odd, path)
    rows = df.collect()
    assert all(r["round_trip"] for r in rows)
    for r in rows:
        t = ODD[r["doc_id"]] if r["doc_id"] is not None else "no id here"
        assert ps.plain_text(np.array(r["ids"], np.int64), path) == (t or "").replace("▁", " ")
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(tuple(r["ids"]))
    assert all(len(by[k]) == 3 for k in range(9, len(ODD)))
    assert len(by[6]) == 1  # each of its characters is a piece of its own, and no longer piece fits
    assert by[0] == by[1] == {()}
    again = {(r["doc_id"], r["sample"], r["ids_crc32"]) for r in ps.sample_segmentations(odd.repartition(1), path, with_ids=False).collect()}
    assert again == {(r["doc_id"], r["sample"], r["ids_crc32"]) for r in rows}
    assert ps.sample_segmentations(none, path).count() == 0


def test_counts_have_room(monkeypatch):
    """A task hands on its counts before they outgrow 32 bits; sums and stored pairs have 64."""
    monkeypatch.setattr(ngram_lm, "FLUSH_TOKENS", 10)
    got = ngram_lm.Gatherer()
    assert not got.add(np.array([5] * 10, np.uint64)) and got.add(np.array([5, 6], np.uint64))
    keys, counts = got.take()
    assert (keys.tolist(), counts.tolist(), got.tokens) == ([5, 6], [11, 1], 0)
    parts = [np.array([3_000_000_000], "<u4").astype(np.int64)] * 3
    assert ngram_lm.summed([np.array([7], np.uint64)] * 3, parts)[1].tolist() == [9_000_000_000]


def test_pair_counts_beyond_32_bits(tmp_path):
    model = ngram_lm.Model(f"file://{tmp_path}", 0, first=[0], types=3, tokens=10**10, hot=np.array([3]))
    pair = np.array([(1 << 32) | 2], np.uint64)
    from evidara.llm.common import put_bytes

    put_bytes(model.uri, "pairs-0", ngram_lm.mix(pair).astype("<u8").tobytes(), np.array([6 * 10**9], "<i8").tobytes())
    assert ngram_lm.Scorer(model)._pair_counts(np.array([1, 1]), np.array([2, 0])).tolist() == [6 * 10**9, 0]


def test_few_word_shards_stay_mapped(spark, monkeypatch):
    docs = spark.createDataFrame([(i, sentence(i, 20)) for i in range(50)], "doc_id long, text string")
    model = ngram_lm.train_model(docs.select("text"), shards=16)
    monkeypatch.setattr(ngram_lm, "MAPPED", 2)
    hashes, _ = ngram_lm.token_hashes(pa.array([sentence(i, 20) for i in range(50)] + ["never seen"]))
    words = ngram_lm.Words(model)
    ids, counts = words.ids(hashes)
    assert len(words.held) <= 2 and (ids[:-3] >= 0).all() and ids[-3:].tolist() == [-1, -1, ids[-1]] and counts.max() > 1


def test_one_noise_number_equals_the_array_s():
    import numpy as np

    from evidara.llm import piece_sampling as ps

    keys = np.array([0, 1, (1 << 64) - 1, 1 << 63, 12345678901234567890], np.uint64)
    for sample, place, step in ((0, 0, 0), (63, 0, 0), (50, 1 << 20, 3), (17, (1 << 40) - 1, 0)):
        assert [ps._one(k, sample, place, step) for k in keys.tolist()] == ps._uniform(keys, sample, place, step).tolist()


def _text(n):
    return " ".join(sentence(i, 12) for i in range(n))


def test_regions_are_looked_for_only_where_one_may_be_wanted(monkeypatch):
    """A long text's samples need noise for its own draws and for the places near the begin, not for all places again."""
    path, drawn = tokenizer_path(PIECE_MODEL), []
    ps.lattice(path, ps.ALPHA)
    plain = ps.mix
    monkeypatch.setattr(ps, "mix", lambda x: (drawn.append(x.size), plain(x))[1])
    got = ps.sample_texts(["the and of to in " * 2000], [7], path, 3)[0]
    pieces = [len(s[0]) for s in got]
    assert min(pieces) > 8000 and sum(drawn) < sum(pieces) + 2000


def test_samples_of_a_text_do_not_change_in_company():
    path = tokenizer_path(PIECE_MODEL)
    texts = [_text(30), "an ab", _text(3), "", "日本語" * 40 + "\n\tx", _text(90)]
    alone = [ps.sample_texts([t], [i], path, 3)[0] for i, t in enumerate(texts)]
    for got, own in zip(ps.sample_texts(texts, list(range(len(texts))), path, 3), alone):
        assert [(s[0].tolist(), *s[1:]) for s in got] == [(s[0].tolist(), *s[1:]) for s in own]


def test_highest_regions_equal_those_of_all_places(monkeypatch):
    model = ps.lattice(tokenizer_path(PIECE_MODEL), ps.ALPHA)
    rng = np.random.default_rng(5)

    class Arcs:
        logp = np.concatenate([[0.0], -rng.random(400) ** 6, [-40.0, -1e-12]])

    assert model.root[ord("a")] == model.children(np.zeros(1, np.int32), np.array([ord("a")]))[0]
    paths = [rng.integers(0, 403, n).astype(np.int32) for n in (1, 2, 3, 900, 40, 40, 3000, 7)] + [np.zeros(5, np.int32), np.full(60, 402, np.int32)]
    lead, key = np.array([0, 1, 3, 700, 0, 39, 10, 2, 0, 0]), ps.mix(np.arange(10, dtype=np.uint64))
    wanted = []
    for w, own in enumerate(paths):
        logp = Arcs.logp[own]
        before = np.cumsum(logp) - logp
        at = np.flatnonzero((logp < 0) & (before > -700) & (np.arange(len(own)) >= lead[w]))
        low = before[at] + np.log(-np.expm1(logp[at])) - np.log(-np.log(ps._uniform(key[w], 33, at)))
        wanted += [(w, int(at[i]), low[i]) for i in np.argsort(-low)[:3]]
    for head, cells in ((384, 1 << 18), (2, 8), (5, 1000)):
        monkeypatch.setattr(ps, "_HEAD", head)
        monkeypatch.setattr(ps, "_CELLS", cells)
        got = list(zip(*(x.tolist() for x in ps._regions(Arcs, paths, lead, key, 33, 3))))
        assert [g[:2] for g in got] == [x[:2] for x in wanted] and np.allclose([g[2] for g in got], [x[2] for x in wanted])


def test_texts_are_split_before_words_and_around_line_breaks():
    import re

    model = ps.lattice(tokenizer_path(PIECE_MODEL), ps.ALPHA)
    texts = ["▁an▁ab", "", "x\n\n▁y\tz▁▁", "", "▀▁▂", "\n", "日▁本\r語", ""]
    sizes, code, kinds = model.split(texts)
    signs = "".join(map(chr, np.flatnonzero(model.signs)))
    found = [re.findall(f"▁[^▁{signs}]*|[{signs}]|[^▁{signs}]+", t) for t in texts]
    assert sizes.tolist() == [len(f) for f in found] and [kinds[c].as_py() for c in code.tolist()] == [p for f in found for p in f]
    assert len(set(kinds.to_pylist())) == len(kinds) and [x.tolist() for x in model.split([""])[:2]] == [[0], []] and model.split([])[0].tolist() == []
