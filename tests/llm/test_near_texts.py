"""Groups of near-duplicate texts against brute force over whole shingle sets, and their odd cases."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from evidara.llm import components as comp, near_texts, simhash
from tests.llm.conftest import ODD, sentence

SF = "/root/testdata/sf0.01"


def shingles(text, k=5):
    own = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {b" ".join(own[i : i + k]) for i in range(max(1, len(own) - k + 1))} if own else set()


def brute(texts, similarity=0.8):
    """Smallest id reachable over pairs whose sets' intersection over union is similarity or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    seen, by = defaultdict(list), defaultdict(int)
    for i in sorted(sets):
        by.clear()
        for s in sets[i]:
            for j in seen[s]:
                by[j] += 1
            seen[s].append(i)
        for j, n in by.items():
            if n >= similarity * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    empty = [i for i in sets if not sets[i]]
    return {i: root(i) if sets[i] else min(empty) for i in sets}


def test_groups_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wanted = brute({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    for tile in (64, near_texts.TILE):
        rows = near_texts.groups(docs, tile=tile).collect()
        assert {r["doc_id"]: r["component_id"] for r in rows} == wanted
    assert any(r["class_id"] != r["component_id"] for r in rows)  # texts that differ are linked


def test_groups_of_edited_texts(spark):
    rnd = random.Random(4)
    texts = []
    for g in range(12):
        base = " ".join(sentence(g * 31 + k, 8 + g) for k in range(1 + 3 * g)).split()
        for _ in range(14):
            own = list(base)
            for _ in range(rnd.randrange(0, 1 + len(own) // 30)):
                own[rnd.randrange(len(own))] = f"w{rnd.randrange(999)}"
            texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = near_texts.groups(df, tile=10).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute(dict(enumerate(texts)))


def test_odd_cases(spark, odd, none):
    rows = near_texts.groups(odd, carry=("source",)).collect()
    assert len(rows) == len(ODD) + 3
    wanted = brute(dict(enumerate(ODD)))
    for r in rows:
        assert r["component_id"] == (wanted[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["class_id"] is None or r["class_id"] >= r["component_id"]
    assert near_texts.groups(none).count() == 0
    lone = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, "z")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in near_texts.groups(lone).collect()) == [("7", "7"), ("None", "7"), ("None", "None")]


def test_sets_and_counts():
    sets, sizes = near_texts.shingle_sets(pa.array(ODD))
    want = [sorted({xxhash.xxh64_intdigest(s, 42) >> 32 for s in shingles(t)}) for t in ODD]
    assert sizes.tolist() == [len(x) for x in want] and sets.tolist() == [v for x in want for v in x]
    rng = np.random.default_rng(0)
    sizes = np.array([1, 254, 255, 256, 700, 3])
    hashes = rng.integers(0, 2**64, sizes.sum(), dtype=np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(int)
    assert np.array_equal(simhash.bit_counts(hashes, sizes), np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0))


@pytest.mark.parametrize("chunk", [3, 50, comp.CHUNK])
def test_components(spark, chunk):
    rnd = random.Random(chunk)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5060)] + [(9, 9)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(3)
    got = {r["node"]: r["component"] for r in comp.components(df, chunk=chunk).collect()}
    nodes, least = comp.least_reachable(*np.array([e for e in edges if e[0] != e[1]]).T)
    assert got == dict(zip(nodes.tolist(), least.tolist()))
    assert comp.components(df.limit(0), chunk=chunk).count() == 0


def test_small_sets_lose_no_link(spark):
    """Texts of 8 and 9 words (sets of 4 within 5 shingles) and somewhat longer ones, at a similarity of just 0.8 and just below."""
    rnd = random.Random(9)
    texts = []
    for k in range(900):
        n = rnd.choice([4, 4, 8, 12, 16, 24, 28, 32])
        own = [f"w{rnd.randrange(10**6)}" for _ in range(n + 4)]
        texts += [" ".join(own), " ".join([*own, *(f"v{rnd.randrange(10**6)}" for _ in range(n // 4 + (k % 9 == 0)))])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    wanted = brute(dict(enumerate(texts)))
    assert sum(i != c for i, c in wanted.items()) == 800
    for tile in (200, near_texts.TILE):
        assert {r["doc_id"]: r["component_id"] for r in near_texts.groups(df, tile=tile).collect()} == wanted


def test_signatures_bound_the_difference():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 40))) for _ in range(60)]
    sets, sizes = near_texts.shingle_sets(pa.array(texts), 2)
    signs = near_texts.signatures(sets, sizes)
    own = [set(x.tolist()) for x in np.split(sets, np.cumsum(sizes)[:-1])]
    for a, x in zip(own, signs):
        for b, y in zip(own, signs):
            apart = int(np.bitwise_count(x ^ y).sum())
            assert apart <= len(a ^ b) and (apart - len(a ^ b)) % 2 == 0
