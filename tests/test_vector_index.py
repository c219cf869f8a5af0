"""Exact search in blocks and the stored vector index, against numpy."""

import numpy as np
import pytest

from evidara import catalogue
from evidara.operators import blocks, vector_index as vi

SCHEMA = "vec_id long, embedding array<double>"


def _brute(ids, x, q, k):
    s = np.round((1 + x @ q) / 2, 9)
    return sorted(zip(-s, ids))[:k]


def _vectors(n, d=8, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    return out


def test_blocks_equal_brute_force(spark, monkeypatch):
    x = _vectors(300)
    x[100:200] = x[100]  # a third are copies: ties go to the smaller id, over blocks
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 8), (902, [1.0])], SCHEMA)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 300, 30)], "query_id long, query_vector array<double>")
    monkeypatch.setattr(blocks, "HELD", 500)
    monkeypatch.setattr(blocks.paired, "__defaults__", (40, 3))
    got = _rows(blocks.exact_top_k(rows, asked, 7))
    for i in range(0, 300, 30):
        assert [v for _, v in got[i]] == [v for _, v in _brute(range(300), x, x[i], 7)]
    assert blocks.exact_top_k(rows.limit(0), asked, 7).count() == 0
    assert blocks.exact_top_k(rows, asked.limit(0), 7).count() == 0


def test_mean_best_of_empty_sides(spark):
    left, right = spark.createDataFrame([(1, [1.0, 0.0])], "i long, a array<double>"), spark.createDataFrame([(2, [0.6, 0.8]), (3, [0.0, 1.0])], "j long, b array<double>")
    assert tuple(blocks.mean_best(left, right).first()) == (0.6, 0.3, 0.4)
    assert tuple(blocks.mean_best(left.limit(0), right).first()) == (None, None, 0.0)


def test_index_holds_every_row_and_finds_the_near(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "SEGMENT", 50)
    x = _vectors(900, 16)
    x[:300] = x[0]  # one cell holds a third of the rows: several segments
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [float("inf")] * 16)], SCHEMA)
    path = str(tmp_path / "index")
    built = vi.build(frame.filter("vec_id < 700 OR vec_id >= 2000"), path, "a", 16)
    assert (built["indexed_rows"], built["left_out"]) == (700, 2)
    added = vi.append(frame.filter("vec_id >= 600"), path, "a")
    assert (added["appended"], added["known"], added["left_out"], added["indexed_rows"]) == (200, 100, 2, 900)
    _, _, rows = vi.open_index(spark, path, "a")
    assert sorted(r[0] for r in rows.select("vec_id").collect()) == list(range(900))
    assert rows.groupBy("cell", "segment").count().agg({"count": "max"}).first()[0] < 150
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 900, 45)], "query_id long, query_vector array<double>")
    want = {i: _brute(range(900), x, x[i], 10) for i in range(0, 900, 45)}
    exact, found = _rows(vi.search(spark, path, "a", asked, 10, exact=True)), _rows(vi.search(spark, path, "a", asked, 10))
    assert all([v for _, v in exact[i]] == [v for _, v in want[i]] for i in want)
    assert sum(len({v for _, v in found[i]} & {v for _, v in want[i]}) for i in want) >= 0.9 * 10 * len(want)
    assert found[0] == pytest.approx(np.array(want[0])) or [v for _, v in found[0]] == [v for _, v in want[0]]
    # a cell may hold fewer rows than are asked for: all rows are searched then
    assert all(len(v) == 500 for v in _rows(vi.search(spark, path, "a", asked, 500, probes=1)).values())
    with pytest.raises(ValueError, match="version"):
        vi.search(spark, path, "b", asked, 10)


def test_empty_index(spark, tmp_path):
    path, none = str(tmp_path / "empty"), spark.createDataFrame([], SCHEMA)
    assert vi.build(none, path, "a", 8)["indexed_rows"] == 0
    asked = spark.createDataFrame([(1, [1.0] * 8)], "query_id long, query_vector array<double>")
    assert vi.search(spark, path, "a", asked, 10).count() == 0


def test_recall_on_the_given_vectors(spark):
    d = "/root/testdata/sf0.1"
    found, want = (_rows(catalogue.QUERIES[n](spark, d)) for n in ("vector_index_topk", "vector_topk"))
    hits = sum(len({v for _, v in found[q]} & {v for _, v in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_ranked_labels_equal_the_plain_ranking(spark, monkeypatch, tmp_path):
    """Copies, nulls, a query without relevant rows and one whose first relevant row stands last; the registered query has no product of rows in its plan."""
    from pyspark.sql import functions as F

    from evidara.functions.similarity import dot
    from evidara.operators import metrics as mt

    x = _vectors(120)
    x[40:80] = x[40]
    label = ["a" if i % 3 else "b" for i in range(120)]
    label[0], label[30] = "none", "far"
    rows = [(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, label))] + [(200, None, "a"), (201, [None] * 8, "far"), (202, x[5].tolist(), None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    q = v.filter("vec_id % 30 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")
    pairs = v.crossJoin(q.withColumnRenamed("label", "ql")).filter("vec_id <> query_id")
    scored = pairs.select("query_id", "vec_id", (F.col("label") == F.col("ql")).cast("int").alias("gain"), F.round(dot(F.col("query_vector"), F.col("embedding")), 9).alias("score"))
    wanted = sorted(map(tuple, mt.ranking_metrics(*mt.rank_scored(scored, 5, "vec_id"), 5).collect()))
    monkeypatch.setattr(blocks, "HELD", 200)
    monkeypatch.setattr(blocks.paired, "__defaults__", (25, 2))
    assert sorted(map(tuple, mt.ranking_metrics(*blocks.ranked_labels(v, q, 5), 5).collect())) == wanted
    v.write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = catalogue.QUERIES["recall_mrr_ndcg"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "zip_with" not in plan


def test_blocks_of_long_vectors_hold_fewer_rows(spark, monkeypatch):
    assert all(blocks.block_rows(d) * d <= blocks.VALUES for d in (64, 256, 768))
    v = spark.range(400).selectExpr("id AS vec_id", "transform(sequence(1, 256), i -> sin(id * i)) AS embedding")
    q = v.filter("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    whole = {tuple(r) for r in blocks.exact_top_k(v, q, 5).collect()}
    sizes, paired = [], blocks.paired
    monkeypatch.setattr(blocks, "VALUES", 256 * 50)
    monkeypatch.setattr(blocks, "paired", lambda *a: sizes.append(a[4]) or paired(*a))
    assert {tuple(r) for r in blocks.exact_top_k(v, q, 5).collect()} == whole and sizes == [50]
