"""Scalar helpers of records: ids, hashes, numbers, flags, JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Trust in a source by its quality label.
SOURCE_PRIORS = {
    "preprocessed_id": 1.0, "ahd_heldout_safe_corpus": 0.95, "preprocessed_source_row": 0.90, "supplemental_dataset_validated": 0.80,
    "unknown": 0.65, "": 0.65, "mention_evidence": 0.55,
}


def entity_id(kind: Column, norm: Column) -> Column:
    return F.concat(F.lit("ent_"), F.lower(kind), F.lit("_"), F.substring(F.sha1(F.concat(kind, F.lit("::"), norm).cast("binary")), 1, 12))


def relation_id(*parts: Column) -> Column:
    return F.concat(F.lit("rel_seed_"), F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 16))


def mention_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *parts).cast("binary"))


def content_hash(question: Column, answer: Column, category: Column) -> Column:
    return F.sha2(F.concat_ws("\n", question, answer, category).cast("binary"), 256)


def passage(*parts: Column) -> Column:
    """The text to embed: non-empty parts after a prefix."""
    kept = F.filter(F.array(*(F.trim(F.coalesce(p, F.lit(""))) for p in parts)), lambda p: p != "")
    return F.concat(F.lit("passage: "), F.array_join(kept, " "))


def unit(c: Column) -> Column:
    """A number within [0, 1]; 0 for what is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(c.cast("string").try_cast("double"), F.lit(0.0)), F.lit(0.0))))


def flag(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "on"), F.lit(False))


def null_like(c: Column) -> Column:
    """Trimmed text; the words for nothing are empty."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(text).isin("none", "null", "nan"), "").otherwise(text)


def source_prior(quality: Column) -> Column:
    out = F.lit(SOURCE_PRIORS["unknown"])
    for name, value in SOURCE_PRIORS.items():
        out = F.when(quality == name, F.lit(value)).otherwise(out)
    return out


def json_object(c: Column) -> Column:
    """The JSON object in a reply: from its first "{" to its last "}" (a code fence around it falls away); null without one."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def aliases(c: Column, canonical: Column) -> Column:
    """A JSON list of names: trimmed, distinct in their order, without empty ones and the canonical name."""
    names = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n.isNotNull() & (n != "") & (n != canonical)))


def reliability_label(score: Column) -> Column:
    return F.when(score >= 0.80, "high").when(score >= 0.55, "medium").otherwise("low")


def evidence_origin(explicit: Column, field: Column, quality: Column, evidence: Column, question: Column, answer: Column) -> Column:
    """Where a passage comes from: what its labels say, else the text that holds it (all texts in normal form)."""
    names = {"question": ("question", "source_question"), "answer": ("answer", "source_answer", "qa_answer"), "validated_relation": ("validated_relation", "relation", "graph_relation")}
    out = None
    for label in (explicit, field):
        value = F.lower(F.trim(F.coalesce(label, F.lit(""))))
        for origin, values in names.items():
            out = F.when(value.isin(*values), origin) if out is None else out.when(value.isin(*values), origin)
    holds = lambda text: (evidence != "") & (text != "") & F.contains(text, evidence)
    in_answer, in_question = holds(answer), holds(question)
    out = out.when(evidence == "", "unknown").when(in_answer & ~in_question, "answer").when(in_question & ~in_answer, "question")
    mixed = F.trim(quality) == "mention_evidence"
    return out.when(mixed & in_answer & (answer != ""), "answer").when(mixed & in_question, "question").otherwise("unknown")
