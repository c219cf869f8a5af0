"""Queries on evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, metrics as mt
from .registry import case, table

_S_SAMPLES = "s AS (SELECT d.doc_id, round(least(1.0, length(text) / 5000.0), 3)::DOUBLE AS score, quality AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def _samples(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.round(F.least(F.lit(1.0), F.length("text") / 5000.0), 3).alias("score"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


_RATIO = "CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END"


@case(
    "prf1",
    """WITH p AS (SELECT doc_id FROM documents WHERE length(text) > 1500), g AS (SELECT doc_id FROM labels WHERE quality = 1), c AS (SELECT (SELECT count(*) FROM p WHERE doc_id IN (SELECT doc_id FROM g)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng)
    SELECT tp::BIGINT AS true_positives, round(tp / np, 6) AS precision, round(tp / ng, 6) AS recall, round(2 * (tp / np) * (tp / ng) / ((tp / np) + (tp / ng)), 6) AS f1 FROM c""",
)
def prf1(spark, d):
    predicted = table(spark, d, "documents").filter(F.length("text") > 1500).select("doc_id")
    return mt.precision_recall_f1(predicted, table(spark, d, "labels").filter("quality = 1").select("doc_id"), ["doc_id"])


@case(
    "relation_prf1",
    """WITH p AS (SELECT DISTINCT l_partkey AS a, l_returnflag AS r, l_suppkey AS b FROM lineitem WHERE l_quantity > 20), g AS (SELECT DISTINCT l_partkey AS a, l_returnflag AS r, l_suppkey AS b FROM lineitem WHERE l_discount > 0.04),
    c AS (SELECT (SELECT count(*) FROM p JOIN g USING (a, r, b)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng)
    SELECT tp::BIGINT AS true_positives, round(tp / np, 6) AS precision, round(tp / ng, 6) AS recall, round(2 * (tp / np) * (tp / ng) / ((tp / np) + (tp / ng)), 6) AS f1 FROM c""",
)
def relation_prf1(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_returnflag").alias("r"), F.col("l_suppkey").alias("b"), "l_quantity", "l_discount")
    return mt.precision_recall_f1(rows.filter("l_quantity > 20"), rows.filter("l_discount > 0.04"), ["a", "r", "b"])


@case("claim_rates", "SELECT source, round(avg((quality = 1 AND toxic <> 1)::INT), 6) AS supported_rate, round(avg((quality <> 1 AND toxic <> 1)::INT), 6) AS weak_rate, round(avg((quality <> 1 AND toxic = 1)::INT), 6) AS unsupported_rate, count(*)::BIGINT AS n FROM documents JOIN labels USING (doc_id) GROUP BY source")
def claim_rates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    status = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "both").otherwise("supported")).when(F.col("toxic") == 1, "unsupported").otherwise("weakly_supported")
    return mt.status_rates(rows.withColumn("status", status), ["source"], "status", {"supported_rate": "supported", "weak_rate": "weakly_supported", "unsupported_rate": "unsupported"})


@case(
    "recall_mrr_ndcg",
    """WITH a AS (SELECT q.vec_id AS query_id, v.vec_id, (v.label = q.label)::INT AS gain, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
    n AS (SELECT query_id, sum(gain) AS n FROM a GROUP BY 1), i AS (SELECT query_id, n, (SELECT sum(1 / log2(x + 1)) FROM range(1, least(10, n)::BIGINT + 1) t(x)) AS idcg FROM n)
    SELECT a.query_id, round(count(*) FILTER (WHERE rank <= 10 AND gain = 1) / max(n), 6) AS recall_at_k, round(coalesce(1 / min(CASE WHEN gain = 1 THEN rank END), 0), 6) AS reciprocal_rank, round(sum(CASE WHEN rank <= 10 THEN gain / log2(rank + 1) ELSE 0 END) / max(idcg), 6) AS ndcg_at_k
    FROM a JOIN i USING (query_id) GROUP BY a.query_id""",
)
def recall_mrr_ndcg(spark, d):
    """Queries are the vectors whose id is divisible by 100, against all others."""
    v = table(spark, d, "embeddings")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")
    return mt.ranking_metrics(*blocks.ranked_labels(v, q, 10), 10)


@case("auroc", f"WITH {_S_SAMPLES} SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END::DOUBLE), 6) AS auroc FROM s p, s n WHERE p.label = 1 AND n.label = 0")
def auroc(spark, d):
    return mt.auroc(_samples(spark, d))


@case("auprc", f"WITH {_S_SAMPLES}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, doc_id) AS k, sum(label) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS h FROM s) SELECT round(sum(CASE WHEN label = 1 THEN h / k END)::DOUBLE / sum(label), 6) AS auprc FROM r")
def auprc(spark, d):
    return mt.average_precision(_samples(spark, d), "doc_id")


@case(
    "calibration",
    f"""WITH {_S_SAMPLES}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS c, avg(label) AS a, sum((score - label) ** 2) AS e FROM s GROUP BY 1) SELECT round(sum(e) / sum(n), 6) AS brier, round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b""",
)
def calibration(spark, d):
    return mt.calibration(_samples(spark, d))


@case(
    "threshold_sweep",
    f"""WITH {_S_SAMPLES}, c AS (SELECT t.x AS threshold, count(*) FILTER (WHERE score >= x AND label = 1) AS tp, count(*) FILTER (WHERE score >= x AND label = 0) AS fp, count(*) FILTER (WHERE score < x AND label = 0) AS tn, count(*) FILTER (WHERE score < x AND label = 1) AS fn
        FROM s, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS x) t GROUP BY 1),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM c)
    SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS specificity FROM r""",
)
def threshold_sweep(spark, d):
    return mt.threshold_sweep(_samples(spark, d), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])


@case("latency_average", "SELECT event_type, round(sum(coalesce(value, 0)) / (SELECT count(*) FROM events), 6) AS mean_latency FROM events GROUP BY event_type")
def latency_average(spark, d):
    """Mean over all runs; a stage that a run lacks counts as zero."""
    return mt.mean_latency(table(spark, d, "events"), "event_type", "value")


@case(
    "matrix_mean_best",
    """WITH a AS (SELECT p.vec_id AS i, g.vec_id AS j, list_dot_product(p.embedding::DOUBLE[], g.embedding::DOUBLE[]) AS s FROM embeddings p, embeddings g WHERE p.vec_id % 100 = 0 AND g.vec_id % 100 <> 0),
    r AS (SELECT avg(m) AS p FROM (SELECT max(s) AS m FROM a GROUP BY i)), c AS (SELECT avg(m) AS q FROM (SELECT max(s) AS m FROM a GROUP BY j)) SELECT round(p, 6) AS precision, round(q, 6) AS recall, round(2 * p * q / (p + q), 6) AS f1 FROM r, c""",
)
def matrix_mean_best(spark, d):
    """Predicted are the vectors whose id is divisible by 100, gold are all others."""
    v = table(spark, d, "embeddings")
    predicted = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("i"), F.col("embedding").alias("a"))
    return blocks.mean_best(predicted, v.filter("vec_id % 100 <> 0").select(F.col("vec_id").alias("j"), F.col("embedding").alias("b")))
