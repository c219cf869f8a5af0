"""Evaluation metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.stages import with_places


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def precision_recall_f1(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Of two sets of keys: true_positives, precision, recall, f1."""
    p, g = predicted.select(*keys).distinct(), gold.select(*keys).distinct()
    counts = p.withColumn("p", F.lit(1)).join(g.withColumn("g", F.lit(1)), keys, "full_outer").agg(F.count(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1)).alias("tp"), F.count("p").alias("np"), F.count("g").alias("ng"))
    precision, recall = _ratio(F.col("tp"), F.col("np")), _ratio(F.col("tp"), F.col("ng"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return counts.select(F.col("tp").alias("true_positives"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def ranking_metrics(top: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, recall_at_k, reciprocal_rank, ndcg_at_k. top: query_id, rank (to k), gain (0 if irrelevant); relevant: query_id, n_relevant, first (rank of the first relevant, null without one), ideal (the
    k best gains, best first)."""
    gain = (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col("rank") + 1)
    got = top.filter(F.col("rank") <= k).groupBy("query_id").agg(F.count(F.when(F.col("gain") > 0, 1)).alias("hits"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.size("ideal"))), F.lit(0.0), lambda s, i: s + (F.pow(F.lit(2.0), F.element_at("ideal", i)) - 1) / F.log2(i + F.lit(1)))
    joined = relevant.join(got, "query_id", "left").withColumn("best", F.when(F.size("ideal") > 0, ideal).otherwise(0.0))
    return joined.select(
        "query_id",
        F.round(_ratio(F.coalesce("hits", F.lit(0)), F.col("n_relevant")), 6).alias("recall_at_k"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.coalesce(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")), F.lit(0.0)), 6).alias("ndcg_at_k"),
    )


def rank_scored(scored: DataFrame, k: int, tie: str) -> tuple[DataFrame, DataFrame]:
    """The two tables of ranking_metrics() from scored candidates (query_id, tie, score, gain): tasks keep the k best of each query and count what stands before its first relevant candidate; none
    ranks all candidates of a query."""
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), tie)
    top = scored.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "gain")
    best = scored.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), tie))).filter((F.col("nth") <= k) & (F.col("gain") > 0))
    ideal = best.groupBy("query_id").agg(F.sort_array(F.collect_list("gain"), asc=False).alias("ideal"))
    first = scored.filter("gain > 0").groupBy("query_id").agg(F.count("*").alias("n_relevant"), F.max(F.struct("score", -F.col(tie))).alias("at"))
    above = scored.join(first.select("query_id", "at"), "query_id").filter(F.struct("score", -F.col(tie)) > F.col("at")).groupBy("query_id").agg(F.count("*").alias("above"))
    queries = scored.select("query_id").distinct().join(first, "query_id", "left").join(above, "query_id", "left").join(ideal, "query_id", "left")
    rank = F.when(F.col("at").isNotNull(), F.coalesce("above", F.lit(0)) + 1)
    return top, queries.select("query_id", F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"), rank.alias("first"), F.coalesce("ideal", F.array().cast("array<int>")).alias("ideal"))


def _score_counts(samples: DataFrame) -> DataFrame:
    """Rows and positives of each distinct score: what all rank metrics need, small where scores repeat."""
    return samples.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("pos"))


def auroc(samples: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half: rank sums over the sorted distinct scores instead of the pairs."""
    counts = _score_counts(samples).withColumn("neg", F.col("n") - F.col("pos"))
    placed = with_places(counts, ["score"], sums={"upto": "neg"})
    sums = placed.agg(F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2.0)).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return sums.select(F.round(_ratio(F.col("won"), F.col("p").cast("double") * F.col("q")), 6).alias("auroc"))


def average_precision(samples: DataFrame, ordinal: str) -> DataFrame:
    """Mean precision at the positives, by falling score and, at ties, in input order."""
    run = with_places(samples, [F.desc("score"), F.col(ordinal)], sums={"hits": "label"})
    return run.agg(F.round(F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("hits") / F.col("place"))) / F.sum("label"), F.lit(0.0)), 6).alias("auprc"))


def calibration(samples: DataFrame, bins: int = 10) -> DataFrame:
    """brier, ece: equal-width bins, the last one closed, empty ones left out."""
    binned = samples.withColumn("bin", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)))
    per = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("confidence"), F.avg("label").alias("accuracy"), F.sum(F.pow(F.col("score") - F.col("label"), 2)).alias("error"))
    return per.agg(F.round(F.sum("error") / F.sum("n"), 6).alias("brier"), F.round(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n"), 6).alias("ece"))


def threshold_sweep(samples: DataFrame, thresholds: list[float]) -> DataFrame:
    """Confusion counts and rates at each threshold; the list is fixed, so each row is sent to those it passes."""
    t = F.array(*(F.lit(x) for x in thresholds))
    rows = samples.select("label", F.explode(F.transform(t, lambda x: F.struct(x.alias("threshold"), (F.col("score") >= x).alias("yes")))).alias("r"))
    count = lambda yes, label: F.count(F.when((F.col("r.yes") == yes) & (F.col("label") == label), 1))
    got = rows.groupBy(F.col("r.threshold").alias("threshold")).agg(count(True, 1).alias("tp"), count(True, 0).alias("fp"), count(False, 0).alias("tn"), count(False, 1).alias("fn"))
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    specificity = _ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    return got.select("threshold", "tp", "fp", "tn", "fn", *(F.round(c, 6).alias(n) for n, c in (("precision", precision), ("recall", recall), ("f1", f1), ("specificity", specificity))))


def status_rates(rows: DataFrame, by: list[str], status: str, names: dict[str, str]) -> DataFrame:
    """by, a rate for each name (the share of rows whose status is its value), n."""
    return rows.groupBy(*by).agg(*(F.round(F.count_if(F.col(status) == value) / F.count("*"), 6).alias(name) for name, value in names.items()), F.count("*").alias("n"))


def mean_latency(events: DataFrame, stage: str, value: str) -> DataFrame:
    """stage, mean_latency over all runs; a stage that a run lacks counts as zero."""
    total = events.agg(F.count("*").alias("n"))
    sums = events.groupBy(stage).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("s"))
    return sums.crossJoin(total).select(stage, F.round(F.col("s") / F.col("n"), 6).alias("mean_latency"))  # total is one row


def metric_status(name: str, reference: bool) -> dict[str, str]:
    """What an optional judge metric of another package can say here: unavailable with its reasons, or not run; it is never approximated."""
    import importlib.util

    reasons = [] if reference else ["reference answers and annotated contexts are required"]
    if importlib.util.find_spec(name) is None:
        reasons.append(f"the optional package {name} is not installed")
    return {"status": "unavailable", "reason": "; ".join(reasons)} if reasons else {"status": "not_run", "reason": f"{name} needs a configured judge and an evaluation set"}


def text_similarity(predicted: str, reference: str, similarity=None) -> dict[str, float | str]:
    """precision, recall and f1 of mean best token similarities by a provider (lists of tokens -> matrix); unavailable without one, or without a text."""
    if similarity is None or not predicted.strip() or not reference.strip():
        return {"status": "unavailable", "reason": "no similarity provider" if similarity is None else "an answer and a reference are required"}
    matrix = similarity(predicted.split(), reference.split())
    p, r = float(matrix.max(1).mean()), float(matrix.max(0).mean())
    return {"status": "computed", "precision": round(p, 6), "recall": round(r, 6), "f1": round(2 * p * r / (p + r), 6) if p + r > 0 else 0.0}
