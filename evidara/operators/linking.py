"""Entity linking, intents and retrieval plans of many queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import terms as tm

# Scores of the kinds of match, and the rules on intents.
MATCH_SCORES = {"exact_canonical": 1.0, "exact_alias": 0.95, "article_normalized": 0.90, "medical_variant": 0.92}
RELATIONS_BY_INTENT = {
    "treatment_request": ["TREATED_BY", "TREATS"], "symptom_request": ["HAS_SYMPTOM", "SYMPTOM_OF"],
    "diagnosis_request": ["DIAGNOSED_BY", "DIAGNOSES"], "test_request": ["INVESTIGATED_BY", "INVESTIGATES"],
}
WITHOUT_GRAPH = ["cause_request", "prevention_request", "medication_safety"]
AGE_TERMS = "طفل طفلي ابني بنتي عمره عمرها سنه سنوات اشهر".split()
DURATION_TERMS = "منذ يوم يومين ايام اسبوع اسابيع شهر اشهر".split()
COMPARISON_TERMS = [" ام ", "او ", "هل ", "بسبب"]


def term_forms(phrases: DataFrame) -> DataFrame:
    """phrase_id, norm, entity_type, form, kind: each phrase (norm) with its spelling variant and its form without article."""
    bare = tm.strip_article(F.col("norm"))
    forms = F.array_compact(F.array(
        F.struct(F.col("norm").alias("form"), F.lit("norm").alias("kind")),
        F.when(tm.spelling_variant(F.col("norm")).isNotNull(), F.struct(tm.spelling_variant(F.col("norm")).alias("form"), F.lit("variant").alias("kind"))),
        F.when((bare != "") & (bare != F.col("norm")), F.struct(bare.alias("form"), F.lit("article").alias("kind"))),
    ))
    return phrases.select("*", F.explode(forms).alias("f")).select("*", "f.form", "f.kind").drop("f")


def link_phrases(phrases: DataFrame, entities: DataFrame) -> DataFrame:
    """phrase_id, status (linked, ambiguous, type_conflict, unresolved), entity_id, match_type, match_score for each phrase (phrase_id, norm, entity_type).

    entities: entity_id, canonical (normal form), aliases (array of normal forms), entity_type. Distinct phrases are linked once and joined back. Names and aliases are two equi-joins; an alias counts only
    if the entity's name shares a word with the phrase. Of the best matches only their number and one of them are kept, so an ambiguous name gathers nothing.
    """
    forms = term_forms(phrases.select("norm", "entity_type").distinct())
    by_name = forms.join(entities.select("entity_id", "canonical", F.col("entity_type").alias("found_type")), forms.form == F.col("canonical"))
    by_name = by_name.withColumn("match_type", F.when(F.col("kind") == "norm", "exact_canonical").when(F.col("kind") == "article", "article_normalized").otherwise("medical_variant"))
    names = entities.select("entity_id", "canonical", F.col("entity_type").alias("found_type"), F.explode("aliases").alias("alias"))
    by_alias = forms.join(names, forms.form == F.col("alias")).withColumn("match_type", F.lit("exact_alias"))
    shares = F.arrays_overlap(F.split("canonical", " "), F.split("norm", " "))
    by_alias = by_alias.filter((F.col("canonical") == F.col("norm")) | shares).drop("alias")
    key = ["norm", "entity_type"]
    columns = [*key, "entity_id", "found_type", "match_type"]
    score = reduce(lambda c, kv: F.when(F.col("match_type") == kv[0], kv[1]).otherwise(c), MATCH_SCORES.items(), F.lit(0.0))
    hits = by_name.select(*columns).unionByName(by_alias.select(*columns)).withColumn("score", score)
    best = hits.groupBy(*key, "entity_id", "found_type").agg(F.max(F.struct("score", "match_type")).alias("m"))
    same = F.col("entity_type").eqNullSafe(F.col("found_type"))
    levels = best.groupBy(*key, same.alias("same"), F.col("m.score").alias("score")).agg(F.count("*").alias("n"), F.min(F.struct("entity_id", "m.match_type")).alias("one"))
    per = levels.groupBy(*key).agg(F.max(F.when(F.col("same"), F.struct("score", "n", "one"))).alias("top"), F.max(~F.col("same")).alias("others"))
    status = F.when(F.col("others").isNull(), "unresolved").when(F.col("top").isNull(), "type_conflict").when(F.col("top.n") > 1, "ambiguous").otherwise("linked")
    only = F.when(F.col("top.n") == 1, F.col("top.one"))
    found = per.select(*(F.col(c).alias(f"_{c}") for c in key), status.alias("status"), only["entity_id"].alias("entity_id"), only["match_type"].alias("match_type"), F.col("top.score").alias("match_score"))
    joined = phrases.select("phrase_id", *key).join(found, F.col("norm").eqNullSafe(F.col("_norm")) & F.col("entity_type").eqNullSafe(F.col("_entity_type")), "left")
    return joined.select("phrase_id", F.coalesce("status", F.lit("unresolved")).alias("status"), "entity_id", "match_type", F.coalesce("match_score", F.lit(0.0)).alias("match_score"))


def _any(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in terms))


def intent(norm: Column, query_class: Column) -> Column:
    """(primary, secondary, confidence) of a normalised query by ordered keyword rules; null where none applies."""
    made = lambda name, confidence, second=F.array().cast("array<string>"): F.struct(F.lit(name).alias("primary"), second.alias("secondary"), F.lit(confidence).alias("confidence"))
    drug = _any(norm, ["دواء", "الدوا"]) & _any(norm, ["بسبب", "من الدواء", "من الدوا", "اثر", "تداخل"])
    compares = F.when(F.contains(F.concat(F.lit(" "), norm, F.lit(" ")), F.lit(" ام ")), F.array(F.lit("comparison"))).otherwise(F.array().cast("array<string>"))
    return (
        F.when(_any(norm, ["طقس", "جو اليوم"]), made("non_medical", 0.9))
        .when(query_class == "non_medical", made("non_medical", 0.9))
        .when(_any(norm, ["وقايه", "اقي", "احمي", "تجنب"]), made("prevention_request", 0.85))
        .when(drug, made("medication_safety", 0.85, F.array(F.lit("cause_request"))))
        .when(_any(norm, ["تحاليل", "تحليل", "فحص", "اشعه", "اختبار"]), made("test_request", 0.9))
        .when(_any(norm, ["تشخيص", "يشخص"]), made("diagnosis_request", 0.9))
        .when(_any(norm, ["اعراض", "عرض"]), made("symptom_request", 0.9))
        .when(_any(norm, ["علاج", "اعالج"]), made("treatment_request", 0.9))
        .when(_any(norm, ["سبب"]), made("cause_request", 0.8, compares))
    )


def complex_signals(norm: Column, n_phrases: Column) -> Column:
    """Whether a query compares, or names several things with an age or a duration."""
    compares = _any(F.concat(F.lit(" "), norm, F.lit(" ")), COMPARISON_TERMS)
    return compares | ((n_phrases >= 2) & (_any(norm, AGE_TERMS) | _any(norm, DURATION_TERMS)))


def relation_types(primary: Column, secondary: Column) -> Column:
    """The relation types of the intents in their order."""
    types = lambda i: reduce(lambda c, kv: F.when(i == kv[0], F.array(*(F.lit(r) for r in kv[1]))).otherwise(c), RELATIONS_BY_INTENT.items(), F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(F.concat(F.array(primary), secondary), types)))


def retrieval_plan(queries: DataFrame, max_hops: int = 2) -> DataFrame:
    """use_vector_search, use_graph_search, hop_depth, preferred_relation_types for queries (query_id, norm, query_class, complexity, primary_intent, secondary_intents,
    n_phrases, primary_entity_ids)."""
    out_of_scope = (F.col("query_class") == "non_medical") | (F.col("primary_intent") == "non_medical")
    graph = ~out_of_scope & (F.size("primary_entity_ids") > 0)
    deep = (F.col("query_class") == "complex_medical") | (F.col("complexity") == "high") | complex_signals(F.col("norm"), F.col("n_phrases"))
    depth = F.when(deep, min(max(max_hops, 2), 2)).when(F.col("complexity") == "medium", min(max(max_hops, 1), 2)).otherwise(1)
    none = F.array().cast("array<string>")
    types = F.when(out_of_scope | F.col("primary_intent").isin(WITHOUT_GRAPH), none).otherwise(relation_types(F.col("primary_intent"), F.col("secondary_intents")))
    return queries.select("query_id", (~out_of_scope).alias("use_vector_search"), graph.alias("use_graph_search"), F.when(graph, depth).otherwise(0).alias("hop_depth"), types.alias("preferred_relation_types"))
