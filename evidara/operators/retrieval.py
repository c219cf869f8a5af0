"""Seeds of graph search, support by vector hits, anchors of relevance, and the gate of the fallback search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import similarity as sim, terms as tm

SEED_THRESHOLD, SEED_IDENTITY, TYPE_OVERRIDE, SEEDS = 0.86, 0.86, 0.95, 2


def relevance_phrases(phrases: DataFrame) -> DataFrame:
    """query_id, phrases: the anchors of a query (query_id, place, norm, entity_type, primary_intent).

    Generic words are left out; conditions and symptoms stand for the query if there are any, unless it is about the safety of a drug or compares things.
    """
    named = phrases.filter((F.col("norm") != "") & ~tm.is_generic(F.col("norm")))
    core = F.col("entity_type").isin("DiseaseCondition", "Symptom")
    all_ = F.col("primary_intent").isin("medication_safety", "comparison")
    w = Window.partitionBy("query_id")
    kept = named.withColumn("_core", F.max(core.cast("int")).over(w)).filter(all_ | (F.col("_core") == 0) | core)
    return kept.groupBy("query_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "norm"))), lambda p: p["norm"])).alias("phrases"))


def seed_scores(primary: DataFrame, hits: DataFrame, phrases: DataFrame, fuzzy: bool = False) -> DataFrame:
    """query_id, entity_id, seed_score. Linked entities (query_id, entity_id) are hard seeds, 1.0; only queries without any take up to two
    vector hits (query_id, entity_id, title, entity_type, score, ordinal) that nearly are one of its phrases (query_id, norm, entity_type), at most 0.70."""
    hard = primary.select("query_id", "entity_id", F.lit(1.0).alias("seed_score")).distinct()
    open_ = hits.join(primary.select("query_id").distinct(), "query_id", "left_anti").filter((F.col("score") >= SEED_THRESHOLD) & ~tm.is_generic(F.col("title")))
    pairs = open_.join(phrases.select("query_id", "norm", F.col("entity_type").alias("wanted")), "query_id")
    own, other = tm.identity_tokens(tm.token_set(F.col("norm"))), tm.identity_tokens(tm.token_set(F.col("title")))
    pairs, near = pairs.withColumns({"_own": own, "_other": other}), None
    if fuzzy:
        pairs, near = sim.with_near_terms(pairs, "norm", "_own", ["_other"], sim.IDENTITY_FLOOR, "_near"), F.col("_near")
    best = pairs.withColumn("identity", sim.identity_similarity(F.col("_own"), F.col("_other"), near)).groupBy("query_id", "entity_id", "score", "ordinal", "entity_type").agg(F.max("identity").alias("identity"), F.collect_set("wanted").alias("wanted"))
    fits = (F.col("identity") >= SEED_IDENTITY) & (F.array_contains("wanted", F.col("entity_type")) | (F.col("entity_type") == "") | (F.col("identity") >= TYPE_OVERRIDE))
    ranked = best.filter(fits).withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal"))).filter(F.col("_n") <= SEEDS)
    return hard.unionByName(ranked.select("query_id", "entity_id", F.least(F.lit(0.70), 0.75 * F.col("score")).alias("seed_score")))


def support(hits: DataFrame, key: str) -> DataFrame:
    """The best score of a query's hits for each entity or qa."""
    return hits.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy("query_id", key).agg(F.max("score").alias("support"))


def needs_fallback(query_class: Column, use_vector: Column, n_primary: Column, n_unresolved: Column, tokens: Column) -> Column:
    """Whether a query that found no evidence may search again: a medical one that names something."""
    return ~query_class.isin("non_medical", "unclear") & use_vector & ((n_primary > 0) | (n_unresolved > 0) | (F.size(tm.identity_tokens(tokens)) > 0))


def stamp_embeddings(vectors: DataFrame, model: str, version: str, kind: str) -> DataFrame:
    """Vectors (id, embedding, text_hash) with what tells whether they are current."""
    return vectors.select("*", F.lit(model).alias("embedding_model"), F.size("embedding").alias("embedding_dimension"), F.lit(version).alias("embedding_graph_version"), F.lit(kind).alias("embedding_document_type"), F.current_timestamp().alias("embedding_created_at"))
