"""Validation of model replies: entity extraction and relation decisions become tables of records and of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import records as rec, text as tx
from ..operators import entity_rules as er, graph as gr

# Entity types, and types that replies invent.
ENTITY_TYPES = ["DiseaseCondition", "Symptom", "Treatment", "Test"]
INVENTED_TYPES = ["Category", "BodyPart", "Other"]
_MENTION = "struct<qa_id: string, surface_form: string, field: string, evidence: string>"
ENTITY_PAYLOAD = f"struct<chunk_id: string, entities: array<struct<canonical_name: string, entity_type: string, aliases: array<string>, mentions: array<{_MENTION}>, confidence: double>>>"
RELATION_PAYLOAD = "struct<relations: array<struct<relation_id: string, relation_type: string, keep: boolean, confidence: string, evidence: string, reason: string>>>"


def _errors(df: DataFrame, stage: str, message: Column, severity: str = "error") -> DataFrame:
    return df.select("chunk_id", F.lit(stage).alias("stage"), F.lit(severity).alias("severity"), message.alias("error"))


def parse_replies(replies: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, p) and errors of the latest replies (chunk_id, status, response_text): calls that failed, and texts that hold no such object."""
    ok = replies.filter("status = 'ok'").select("chunk_id", F.from_json(rec.json_object(F.col("response_text")), payload).alias("p"))
    failed = _errors(replies.filter("status <> 'ok' OR status IS NULL"), "model_call", F.coalesce("status", F.lit("no status")))
    return ok.filter("p IS NOT NULL"), failed.unionByName(_errors(ok.filter("p IS NULL"), "parse", F.lit("no JSON object of the expected form")))


def validate_entities(replies: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (chunk_id, canonical_name, entity_type, quality, aliases, mentions, confidence) and errors.

    chunks: chunk_id, qa_ids. A name needs an allowed type and a mention in one of its chunk's qas; names that are no entity by themselves are rejected
    with their reason; types and names are corrected by the rules.
    """
    parsed, errors = parse_replies(replies, ENTITY_PAYLOAD)
    known = parsed.join(chunks.select("chunk_id", "qa_ids"), "chunk_id", "left")
    errors = errors.unionByName(_errors(known.filter("qa_ids IS NULL"), "validation", F.concat(F.lit("Unknown chunk_id: "), "chunk_id")))
    one = known.filter("qa_ids IS NOT NULL").select("chunk_id", "qa_ids", F.explode("p.entities").alias("e"))
    name, kind = F.trim(F.coalesce("e.canonical_name", F.lit(""))), F.trim(F.coalesce("e.entity_type", F.lit("")))
    aliases = F.array_distinct(F.filter(F.transform(F.coalesce("e.aliases", F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != ""))
    allowed = F.filter(F.coalesce("e.mentions", F.array().cast(f"array<{_MENTION}>")), lambda m: F.array_contains("qa_ids", m["qa_id"]) & (F.trim(m["surface_form"]) != ""))
    rows = one.select("chunk_id", name.alias("name"), kind.alias("kind"), aliases.alias("aliases"), allowed.alias("mentions"), rec.unit(F.col("e.confidence")).alias("confidence"))
    reason = (
        F.when(F.col("kind").isin(INVENTED_TYPES), F.concat(F.lit("Rejected accidental entity type: "), "kind")).when(~F.col("kind").isin(ENTITY_TYPES), F.concat(F.lit("Invalid entity type: "), "kind"))
        .when(F.col("name") == "", "Missing canonical_name").when(er.rejection(F.col("name")).isNotNull(), F.concat(F.lit("Rejected entity: "), er.rejection(F.col("name")))).when(F.size("mentions") == 0, "No mention in the chunk")
    )
    judged = rows.withColumn("reason", reason)
    good = judged.filter("reason IS NULL").withColumn("canonical_name", er.canonical(F.col("kind"), F.col("name"), F.col("aliases")))
    good = good.withColumn("entity_type", er.corrected_type(F.col("kind"), F.col("canonical_name"), F.col("aliases")))
    good = good.withColumn("quality", er.quality(F.col("entity_type"), F.col("canonical_name"), F.col("aliases")))
    good = good.withColumn("entity_id", rec.entity_id(F.col("entity_type"), tx.letter_form(F.col("canonical_name"))))
    return good.select("chunk_id", "entity_id", "canonical_name", "entity_type", "quality", "aliases", "mentions", "confidence"), errors.unionByName(_errors(judged.filter("reason IS NOT NULL"), "validation", F.col("reason"), "warning"))


def validate_relations(replies: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions (relation_id, relation_type, keep, confidence, evidence) and errors of replies on candidates (relation_id, chunk_id, relation_type).

    A type that is none keeps the candidate's; a confidence that is no number is 0; relations that nobody proposed are errors.
    """
    parsed, errors = parse_replies(replies, RELATION_PAYLOAD)
    one = parsed.select("chunk_id", F.explode_outer("p.relations").alias("r")).filter("r IS NOT NULL")
    named = one.select("chunk_id", F.trim(F.coalesce("r.relation_id", F.lit(""))).alias("relation_id"), F.trim(F.coalesce("r.relation_type", F.lit(""))).alias("said"), F.coalesce("r.keep", F.lit(False)).alias("keep"), rec.unit(F.col("r.confidence")).alias("confidence"), F.col("r.evidence").alias("evidence"))
    joined = named.join(candidates.select("relation_id", F.col("relation_type").alias("proposed")), "relation_id", "left")
    errors = errors.unionByName(_errors(joined.filter("proposed IS NULL"), "validation", F.concat(F.lit("Unknown relation_id: "), "relation_id"), "warning"))
    types = sorted(set(gr.RELATION_TYPES.values()))
    kind = F.when(F.col("said").isin(types), F.col("said")).otherwise(F.col("proposed"))
    return joined.filter("proposed IS NOT NULL").select("relation_id", kind.alias("relation_type"), "keep", "confidence", "evidence"), errors
