"""Evidence rows of all channels, what of them may establish a fact, and their ties to relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import records as rec, text as tx

COLUMNS = ("query_id", "channel", "ordinal", "evidence_id", "source_id", "qa_id", "question", "text", "answer", "source_quality", "origin", "score", "relation_ids", "vector_similarity")


def authoritative(df: DataFrame, facts: str | None = None) -> DataFrame:
    """df (text, question, answer, source_quality, and origin_label, field if known) with origin, question_only (its own text is the question's, so it was left out) and texts: what may establish a
    fact, its own text unless the question's, the answer, and facts (a column of an array), each once."""
    label = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    norm = df.withColumns({f"_{c}": F.trim(F.coalesce(c, F.lit(""))) for c in ("text", "question", "answer")})
    norm = tx.with_nfkc(norm.withColumns({f"_n{c}": F.col(f"_{c}") for c in ("text", "question", "answer")}), "_ntext", "_nquestion", "_nanswer")
    norm = norm.withColumns({f"_n{c}": tx.query_form(F.col(f"_n{c}")) for c in ("text", "question", "answer")})
    origin = rec.evidence_origin(label("origin_label"), label("field"), F.col("source_quality"), F.col("_ntext"), F.col("_nquestion"), F.col("_nanswer"))
    out = norm.withColumn("origin", origin)
    asked = (F.col("origin") == "question") & (F.col("_text") != "")
    parts = F.array(F.when(~asked, F.col("_text")), F.col("_answer"))
    more = F.transform(F.coalesce(facts, F.array().cast("array<string>")), lambda x: F.trim(x)) if facts else F.array().cast("array<string>")
    texts = F.array_distinct(F.filter(F.concat(parts, more), lambda t: t.isNotNull() & (t != "")))
    return out.withColumns({"question_only": asked, "texts": texts}).drop(*(f"_{n}{c}" for n in ("", "n") for c in ("text", "question", "answer")))


def of_relations(relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, relation_id, evidence_id, by: the evidence of each relation, that which names it and that of its qa; a row that does both is there twice."""
    named = evidence.select("query_id", "evidence_id", F.explode("relation_ids").alias("relation_id")).join(relations.select("query_id", "relation_id"), ["query_id", "relation_id"])
    same = relations.select("query_id", "relation_id", "qa_id").join(evidence.filter(F.col("qa_id").isNotNull() & (F.col("qa_id").cast("string") != "")).select("query_id", "qa_id", "evidence_id"), ["query_id", "qa_id"])
    return named.select("query_id", "relation_id", "evidence_id", F.lit("relation").alias("by")).unionByName(same.select("query_id", "relation_id", "evidence_id", F.lit("qa").alias("by")))


def source_priors(relations: DataFrame, evidence: DataFrame, default: float = 0.6) -> DataFrame:
    """relations with source_prior: the best trust in the sources of their evidence."""
    ties = of_relations(relations, evidence).join(evidence.select("query_id", "evidence_id", "source_quality"), ["query_id", "evidence_id"])
    best = ties.groupBy("query_id", "relation_id").agg(F.max(rec.source_prior(F.col("source_quality"))).alias("source_prior"))
    return relations.join(best, ["query_id", "relation_id"], "left").withColumn("source_prior", F.coalesce("source_prior", F.lit(default)))


def facts_of(evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """query_id, evidence_id, facts: the graph facts (query_id, relation_id, fact) that evidence (relation_ids) rests on, in the order of their ids."""
    ties = evidence.select("query_id", "evidence_id", F.explode("relation_ids").alias("relation_id")).join(facts.select("query_id", "relation_id", "fact"), ["query_id", "relation_id"])
    return ties.groupBy("query_id", "evidence_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("relation_id", "fact"))), lambda x: x["fact"]).alias("facts"))


def joined_once(rows: DataFrame, by: list[str], value: str, order: str, separator: str = "\n") -> DataFrame:
    """by, value: the distinct non-empty texts of each group in the order of their first occurrence, as one text."""
    first = rows.filter(F.trim(F.coalesce(value, F.lit(""))) != "").groupBy(*by, F.trim(value).alias("_v")).agg(F.min(order).alias("_o"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda x: x["_v"])
    return first.groupBy(*by).agg(F.array_join(texts, separator).alias(value))


def most_frequent(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value: the value that most rows of a key have; of several the first seen."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_n"), F.min(order).alias("_seen"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_seen"), F.col(value))).alias(value))


def with_provenance(records: DataFrame, key: str, sources: DataFrame, direct: DataFrame, column: str, fallback: Column) -> DataFrame:
    """records with column and source_quality: the text of their own id, else what their modal source gives. direct: key, column; sources: key, value of the modal source."""
    both = records.join(sources, key, "left").join(direct.select(key, column), key, "left")
    quality = F.when(F.col(column).isNull(), "preprocessed_source_row").otherwise("preprocessed_id")
    return both.withColumns({"source_quality": quality, column: F.coalesce(F.col(column), fallback)})


def extraction_report(entities: DataFrame, mentions: DataFrame, errors: DataFrame, low: float = 0.5) -> DataFrame:
    """part, label, n: entities by type and quality, those that are not actionable, those and mentions of low confidence, mentions by model, chunks with entities, errors by severity and by the kind of rejection.

    entities: entity_type, quality, avg_confidence; mentions: chunk_id, model, confidence; errors: chunk_id, severity, error.
    """
    count = lambda df, part, label: df.groupBy(F.lit(part).alias("part"), label.cast("string").alias("label")).agg(F.count("*").alias("n"))
    total = lambda df, part, label, n: df.agg(n.alias("n")).select(F.lit(part).alias("part"), F.lit(label).alias("label"), "n")
    parts = [
        count(entities, "entity_type", F.col("entity_type")), count(entities, "quality", F.coalesce("quality", F.lit("unknown"))),
        total(entities, "entities", "not_actionable", F.count_if(F.col("quality") == "low")), total(entities, "entities", "low_confidence", F.count_if(F.coalesce("avg_confidence", F.lit(0.0)) < low)),
        total(mentions, "mentions", "low_confidence", F.count_if(F.coalesce("confidence", F.lit(0.0)) < low)), count(mentions, "model", F.coalesce("model", F.lit("unknown"))),
        total(mentions, "chunks", "with_entities", F.count_distinct("chunk_id")), count(errors, "severity", F.col("severity")), total(errors.filter("severity = 'error'"), "chunks", "failed", F.count_distinct("chunk_id")),
        count(errors.filter(F.col("error").startswith("Rejected")), "rejected", F.regexp_extract("error", r"^Rejected ([^:]+)", 1)),
    ]
    return reduce(DataFrame.unionByName, parts)
