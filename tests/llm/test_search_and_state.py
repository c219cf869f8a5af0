"""Vector searches against brute force, dialogues and the token ledger against their SQL, and their odd cases."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.llm import chat, neighbours, pivot_search, token_ledger
from evidara.llm.queries import op1_chat, op4_neighbours, op6_token_counts, op10_pivot_search
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query, sql", [(op1_chat, chat.SQL), (op6_token_counts, token_ledger.SQL), (op10_pivot_search, pivot_search.SQL)])
def test_against_sql(spark, query, sql):
    compare(query(spark, SF), connect(SF), sql)


def vectors(spark, n=400, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[50:120] = x[50]  # a large class of equal vectors
    x[200] = 0
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(n)]
    bad = [(1000, None, 1), (1020, [], 1), (1040, [float("nan")] * dim, 1), (1060, [float("inf")] * dim, 1), (1080, [None] * dim, 1), (None, [1.0] * dim, 1), (1100, [1.0, 2.0], 1), (1200, [2.0, 1.0], 1)]
    return x, spark.createDataFrame([*rows, *bad, rows[20], rows[60]], "vec_id long, embedding array<double>, score int").repartition(4)


def brute(x, ids, queries, k, score):
    out = {}
    for q in queries:
        found = sorted(((-score(q, i), i) for i in ids if i != q))[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


def test_pivot_search(spark):
    x, df = vectors(spark)
    z = np.floor(256 * x).astype(np.int64)
    wanted = brute(x, range(len(x)), range(0, len(x), 50), 5, lambda q, i: int(z[q] @ z[i]))
    for options in ({}, {"block": 7, "pivots": 5, "query_block": 3}):
        rows = pivot_search.exact_top_k(df, **options).collect()
        got = {}
        for r in sorted(rows, key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        small = {k: v for k, v in got.items() if k >= 1000}
        assert {k: v for k, v in got.items() if k < 1000} == wanted
        assert small == {1100: [(1200, 512 * 256 + 256 * 512)], 1200: [(1100, 512 * 256 + 256 * 512)]}
    assert pivot_search.exact_top_k(df.limit(0)).count() == 0


def test_nn_descent(spark):
    x, df = vectors(spark)
    ids = [i for i in range(len(x)) if i != 200]
    wanted = brute(x, ids, range(0, len(x), 20), 20, lambda q, i: float(x[q] @ x[i]))
    wanted.pop(200)
    got = {}
    for r in sorted(neighbours.nearest(df).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.pop(1100) == [(1200, 4.0)] and got.pop(1200) == [(1100, 4.0)]
    assert set(got) == set(wanted)
    for q, found in got.items():
        assert all(math.isclose(s, float(x[q] @ x[i]), rel_tol=1e-12, abs_tol=1e-12) for i, s in found)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    same = [q for q in wanted if 50 <= q < 120]
    assert all([i for i, _ in got[q]] == [i for i, _ in wanted[q]] for q in same)  # ties to smaller ids
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) / 20 for q in wanted])
    assert recall > 0.95
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.filter("vec_id = 40")).count() == 0
    few = neighbours.nearest(df.filter("vec_id in (40, 41, 42)")).collect()
    assert {r["query_id"] for r in few} == {40} and {r["vec_id"] for r in few} == {41, 42}


def test_recall_with_a_narrow_beam(spark):
    """2500 vectors around a hub, a beam of 48: the graph has to lead there."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2500, 10))
    x[0] = 0.001
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    hits, n = 0, 0
    rows = neighbours.nearest(df, k=10, every=50, neighbours=24, beam=48).collect()
    for q in range(0, len(x), 50):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.argsort(-s)[:10].tolist())
        hits += len(best & {r["vec_id"] for r in rows if r["query_id"] == q})
        n += 10
    assert hits / n >= 0.9


def test_pivot_index_skips_and_tells_so(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(20, 6)) * 20
    x = centre[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 6)) * 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    z = np.floor(256 * x).astype(np.int64)
    wanted = brute(x, range(len(x)), range(0, len(x), 50), 5, lambda q, i: int(z[q] @ z[i]))
    report = {}
    got = {}
    for r in sorted(pivot_search.exact_top_k(df, block=64, query_block=25, report=report).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == wanted
    assert report["pairs"] == 60 * 3000 and report["compared"] < 0.5 * report["pairs"]


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    data = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet' ORDER BY 1").fetchnumpy()
    x = np.array([np.array(v, float) for v in data["embedding"]])
    rows = op4_neighbours(spark, sf).collect()
    hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.lexsort((np.arange(len(x)), -s))[:20].tolist())
        hits += len(best & {r["vec_id"] for r in rows if r["query_id"] == q})
    assert hits / (20 * len(range(0, len(x), 20))) >= 0.95


def test_dialogues_odd_cases(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(1, 0, "system", "be nice", 1), (1, 1, "ann", "hi <|im_end|>", 1), (1, 2, None, None, 1), (1, 2, "bo b", "", 1), (1, 2, "bo b", "", 1), (2, 0, "system", "alone", 1), (None, None, "ann", "x", 1), (3, None, "ann", "first", 1), (3, 0, "bo b", "é🙂 second", 1)]
    rows += [(4, i, rnd.choice(["ann", "cy"]), f"turn {i}", 1) for i in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int").repartition(5)
    out = chat.rotate_perspectives(df)
    for r in out.collect():
        assert r["n_turns"] <= 256
        own = [r["text"][s["start"] : s["end"]] for s in r["spans"]]
        assert all(x.endswith("<|im_end|>") for x in own)
        assert len(own) == r["text"].count("<|im_start|>assistant\n")
    got = {(r["conv_id"], r["speaker"]) for r in out.collect()}
    assert got == {(1, "ann"), (1, "unknown"), (1, "bo b"), (None, "ann"), (3, "ann"), (3, "bo b"), (4, "ann"), (4, "cy")}
    assert out.filter("conv_id = 4").count() == 6
    df.write.parquet(str(tmp_path / "c.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c.parquet/*.parquet'")
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ";")
    compare(out.withColumns({"spans": spans, "n_turns": F.col("n_turns").cast("long")}), con, chat.SQL)
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


def test_ledger_batches_commit_once(spark, tmp_path):
    ledger = token_ledger.TokenLedger(spark, str(tmp_path / "ledger"))
    kind = "seq long, op string, doc_id long, source string, lang string, tokenizer string, n_tokens long, n_docs int"
    batch = lambda *rows: spark.createDataFrame([(*r, 0) for r in rows], kind)
    total = lambda: {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}
    assert total() == {}
    first = batch((1, "insert", 1, "a", "en", "v1", 10), (1, "insert", 2, "a", "en", "v1", 5), (1, None, 3, None, None, "v1", None), (1, "insert", None, "a", "en", "v1", 99), (2, "insert", 2, "a", "en", "v1", 7))
    assert ledger.apply("b1", first) and not ledger.apply("b1", first)
    assert total() == {("a", "en", "v1"): (2, 17), (None, None, "v1"): (1, 0)}
    assert ledger.apply("b2", batch((3, "revise", 1, "a", "en", "v2", 12), (3, "delete", 2, "a", "en", "v1", 0), (3, "delete", 77, "a", "en", "v1", 0), (3, "insert", 4, "b", "de", "v1", 4)))
    assert total() == {("a", "en", "v2"): (1, 12), ("b", "de", "v1"): (1, 4), (None, None, "v1"): (1, 0)}
    # a batch that broke off before its log entry leaves files that nothing names
    third = batch((4, "delete", 4, "b", "de", "v1", 0))
    ledger._write("b3", ledger._head(), third)
    assert ledger.batches() == ["b1", "b2"] and total()["b", "de", "v1"] == (1, 4)
    assert ledger.apply("b3", third) and ledger.apply("b4", third.limit(0))
    assert total() == {("a", "en", "v2"): (1, 12), (None, None, "v1"): (1, 0)}
    assert {r["doc_id"] for r in ledger.live().collect()} == {1, 3}
    # a document that comes and goes within a batch
    assert ledger.apply("b5", batch((5, "insert", 9, "z", "de", "v1", 4), (6, "delete", 9, "z", "de", "v1", 0)))
    assert total() == {("a", "en", "v2"): (1, 12), (None, None, "v1"): (1, 0)} and ledger.live().count() == 2


def test_two_writers_of_a_ledger(spark, tmp_path):
    kind = "seq long, op string, doc_id long, source string, lang string, tokenizer string, n_tokens long"
    rows = lambda *ids: spark.createDataFrame([(1, "insert", i, "a", "en", "v", 1) for i in ids], kind)
    one, two = (token_ledger.TokenLedger(spark, str(tmp_path / "ledger"), buckets=4) for _ in range(2))
    assert one.apply("first", rows(*range(40)))
    head = two._head()
    late = two._write("late", head, rows(1, 100))  # worked out on the state before the next batch
    assert one.apply("second", rows(100, 101))
    with pytest.raises(token_ledger.ConcurrentCommit):
        two._append(late)
    assert two.apply("late", rows(1, 100)) and not one.apply("late", rows(1, 100))
    assert [tuple(r) for r in one.totals().collect()] == [("a", "en", "v", 42, 42)]
    # a batch reads and writes the buckets of its documents only
    now = one._head()
    before = dict(now["state"])
    assert one.apply("few", rows(1))
    assert sum(before[b] != f for b, f in one._head()["state"].items()) == 1


def test_ledger_query_on_odd_documents(spark, odd, none, tmp_path):
    for name, docs in (("odd", odd.dropDuplicates(["doc_id"])), ("none", none)):
        docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / name / "documents.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path / name}/documents.parquet/*.parquet'")
        compare(op6_token_counts(spark, str(tmp_path / name)), con, token_ledger.SQL)


def test_counts_by_an_encoder(spark):
    def load():
        return lambda t: len(t.split())

    df = spark.createDataFrame([("a b",), (None,), ("",)], "text string")
    assert sorted(r["n_tokens"] for r in token_ledger.count_by_encoder(df, load).collect()) == [0, 0, 2]


def test_pivot_search_of_large_components(spark):
    """Components beyond what products in doubles or 64 bits can hold take part, and rank exactly."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 4)).tolist()
    x[3], x[50], x[61], x[100] = [2e7, 0.5, -1.0, 2.0], [1e300, 3.0, 1e299, -1e300], [-2e7, 1e12, 0.0, 5.0], [1e308, -1e308, 1.0, 0.25]
    x[70], x[71] = [1.0, 2e7, 0.0, 0.0], [1.0, 2e7, 0.0, 1.0]
    whole = [[math.floor(256 * v) if abs(256 * v) < 2.0**53 else int(max(min(256 * v, 1.7976931348623157e308), -1.7976931348623157e308)) for v in row] for row in x]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>").repartition(3)
    wanted = brute(whole, range(150), (0, 50, 100), 5, lambda q, i: sum(a * b for a, b in zip(whole[q], whole[i])))
    got = {q: [] for q in wanted}
    for r in sorted(pivot_search.exact_top_k(df, pivots=5, block=16, query_block=2).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == {q: [(i, max(min(s, 2**63 - 1), -(2**63))) for i, s in rows] for q, rows in wanted.items()}


def test_order_keys():
    numbers = [-(10**700), -(2**64), -256, -255, -1, 0, 1, 255, 256, 2**64, 10**700]
    assert sorted(numbers, key=pivot_search._order_key) == numbers
