"""Queries that take the relations of all of an order's pairs, on an order with more pairs than the cap that others set."""

import duckdb
import pytest

from evidara import catalogue
from evidara.operators import graph as gr
from tests.oracle import compare

LINES = 40


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One customer with an order of 40 parts and suppliers, and one of a single line."""
    path = tmp_path_factory.mktemp("orders")
    tables = {
        "customer": ([(1, 7)], "c_custkey long, c_nationkey int"),
        "orders": ([(1, 1, "F"), (2, 1, "O")], "o_orderkey long, o_custkey long, o_orderstatus string"),
        "lineitem": ([*((1, 100 + i, 500 + i) for i in range(LINES)), (2, 100, 500)], "l_orderkey long, l_partkey long, l_suppkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def _check(spark, folder, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    out = catalogue.QUERIES[name](spark, folder)
    compare(out, con, catalogue.ORACLE_SQL[name])
    return out.collect()


def _wanted():
    """(order, key of the target, source) of the kept relations: the customer and the nation each meet all parts and suppliers, the customer its nation."""
    ends = {1: [*range(100, 100 + LINES), *range(500, 500 + LINES)], 2: [100, 500]}
    pairs = [(qa, k, s) for qa, keys in ends.items() for k in keys for s in "cn"] + [(qa, 7, "c") for qa in ends]
    return [p for p in pairs if (p[0] * 31 + p[1]) % 100 >= 50]


def test_bidirectional_edges_of_all_pairs(spark, folder):
    assert len(_wanted()) > gr.PAIR_CAP
    rows = _check(spark, folder, "bidirectional_edges")
    assert len(rows) == 2 * len(_wanted()) == len({r["edge_id"] for r in rows})


def test_edge_materialize_counts_all_pairs(spark, folder):
    counts = {r["edge"]: r["n"] for r in _check(spark, folder, "edge_materialize")}
    assert counts["MEDICAL_RELATION"] == len(_wanted())


def test_relation_evidence_of_all_pairs(spark, folder):
    rows = _check(spark, folder, "relation_evidence_top3")
    assert len({r["relation_id"] for r in rows}) == len(_wanted()) and len(rows) == 3 * len(_wanted())
