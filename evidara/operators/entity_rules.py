"""Rules on extracted entities: names, types, quality, rejection; resolution of mentions; phrases of a query."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx

# Vocabularies of the entity rules, as written; they are compared in letter form.
GENERIC_ALONE = "مريض طبيب علاج الحالة حالة مرض مشكلة طبيعي دواء الم حبوب هلاج".split()
ANTIHISTAMINES = ["مضاد الهستامين", "مضاد الهيستامين", "مضاد هيسامين", "مضاد هيستامين"]
ANTIHISTAMINE = "مضاد الهيستامين"
CANONICAL_NAMES = {
    "تهاب لوز": "التهاب اللوزتين", "التهاب لوز": "التهاب اللوزتين", "حمل": "الحمل", "اسبرين": "الأسبرين", "الاسبرين": "الأسبرين", "تحليل حساسيه": "تحليل الحساسية",
    "تحليل مخبري": "تحاليل مخبرية", "تحاليل مخبريه": "تحاليل مخبرية", "ضيق النفس": "ضيق تنفس", "ضيق نفس": "ضيق تنفس", "نزله معويه": "نزلة معوية",
}
FORCED_TYPES = {"الجلطة الدماغية": "DiseaseCondition", "حمى": "Symptom", "الجلوكوز": "Test", "جلوكوز": "Test"}
CATEGORY_LIKE = ["أمراض القلب و الشرايين", "أمراض القلب والشرايين"]
CONTEXT_ONLY = ["النوم", "نوم"]
INFLAMMATION = ["التهاب", "تهاب"]
TREATMENT_MARKERS = "علاج دواء مضاد مرهم كريم قطرة شراب اقراص حبوب".split()
BROAD_TREATMENTS = ["الرياضة", "رياضة", "جرعة", "بلسم", "برامج رقية", "شوفان", "عيش الغراب"]
TRIGGERS = ["جلوتين", "الجلوتين", "حليب البقر"]
BACKGROUND_MEDICATION = ["علاج الضغط", "علاج للضغط", "علاج الكوليسترول", "علاج للكوليسترول"]
CONDITIONS = ["حساسية الصدر", "نزلة معوية", "الارتكاريا", "ارتكاريا"]
SYMPTOMS = ["ضيق تنفس", "ضيق النفس", "سعال", "بلغم", "حكة", "تعب", "صداع"]
BODY_PARTS = "العين عين الحلق حلق القلب قلب الكلى كلى الكبد كبد المعدة معدة الجلد جلد الرأس رأس الصدر صدر الظهر ظهر البطن بطن الرحم رحم المبيض مبيض".split()
REJECTS = {
    "generic": GENERIC_ALONE, "body_part": BODY_PARTS, "trigger": TRIGGERS, "background_medication": BACKGROUND_MEDICATION, "category": CATEGORY_LIKE, "context_only": CONTEXT_ONLY,
}


def _plain(word: str) -> str:
    return " ".join(word.translate(str.maketrans(*tx.LETTERS)).split()).lower()


def _forms(words) -> list[str]:
    return sorted({_plain(w) for w in words})


def names_norm(name: Column, aliases: Column) -> Column:
    """The letter forms of a name and its aliases."""
    return F.array_distinct(F.concat(F.array(tx.letter_form(name)), F.transform(aliases, tx.letter_form)))


def rejection(name: Column) -> Column:
    """Why a name is no entity by itself, the first reason that applies; null if none does."""
    norm, out = tx.letter_form(name), F.lit(None).cast("string")
    for reason, words in reversed(REJECTS.items()):
        out = F.when(norm.isin(_forms(words)), F.lit(reason)).otherwise(out)
    return out


def canonical(kind: Column, name: Column, aliases: Column) -> Column:
    """The name under which an entity goes: overrides by its letter form; one name for all antihistamines that are treatments."""
    out, norm = name, tx.letter_form(name)
    for key, value in CANONICAL_NAMES.items():
        out = F.when(norm == _plain(key), F.lit(value)).otherwise(out)
    family = F.arrays_overlap(F.array_union(names_norm(out, aliases), F.array(norm)), F.array(*(F.lit(w) for w in _forms(ANTIHISTAMINES))))
    return F.when((kind == "Treatment") & family, F.lit(ANTIHISTAMINE)).otherwise(out)


def corrected_type(kind: Column, name: Column, aliases: Column) -> Column:
    """The entity type after the overrides: forced names (by name order), symptoms, conditions, inflammations that name no treatment."""
    norms = names_norm(name, aliases)
    has = lambda words: F.arrays_overlap(norms, F.array(*(F.lit(w) for w in _forms(words))))
    holds = lambda words: F.exists(norms, lambda n: _any_in(n, _forms(words)))
    out = F.when(has(SYMPTOMS), "Symptom").when(has(CONDITIONS), "DiseaseCondition").when(holds(INFLAMMATION) & ~holds(TREATMENT_MARKERS), "DiseaseCondition").otherwise(kind)
    for key in sorted({_plain(k) for k in FORCED_TYPES}, reverse=True):
        value = next(v for k, v in FORCED_TYPES.items() if _plain(k) == key)
        out = F.when(F.array_contains(norms, key), F.lit(value)).otherwise(out)
    return out


def _any_in(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def quality(kind: Column, name: Column, aliases: Column) -> Column:
    """low, medium or high; low ones are not actionable."""
    broad = F.arrays_overlap(names_norm(name, aliases), F.array(*(F.lit(w) for w in _forms(BROAD_TREATMENTS))))
    treatment = kind == "Treatment"
    single = F.size(F.split(tx.one_line(name), " ")) == 1
    return F.when(treatment & (broad | (F.length(name) > 80)), "low").when(treatment & single, "medium").otherwise("high")


def resolve_by_evidence(mentions: DataFrame, records: DataFrame) -> DataFrame:
    """mention_id, qa_id: the one record of a mention's chunk whose text holds its evidence; none where several do.

    mentions: mention_id, chunk_id, evidence; records: chunk_id, qa_id, body (a few of each chunk).
    """
    hits = mentions.join(records, "chunk_id").filter((F.col("evidence") != "") & F.contains("body", "evidence"))
    per = hits.groupBy("mention_id").agg(F.count_distinct("qa_id").alias("n"), F.min("qa_id").alias("qa_id"))
    return per.filter("n = 1").select("mention_id", "qa_id")


def distinct_phrases(phrases: DataFrame, near: float = 0.78) -> DataFrame:
    """phrases (query_id, norm, entity_type, source) without those that an earlier phrase of the query holds, or that nearly equal one of the same type.

    Phrases of the corrected query come first, longer ones before shorter ones. Each decision depends on what was kept, so a query's few phrases are folded in Python, many queries in a batch; a single phrase is not sent there.
    """

    def fold(norms: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([None if n is None else _first_places(n, k, near) for n, k in zip(norms, kinds)])

    place = F.when(F.col("source") == "corrected_query", 0).when(F.col("source") == "reformulated_query", 1).otherwise(9)
    one = F.struct(place.alias("place"), (-F.length("norm")).alias("n"), "norm", "entity_type", "source")
    per = phrases.filter("norm <> ''").groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("p"))
    several = lambda c: F.when(F.size("p") > 1, F.col(f"p.{c}"))
    kept = F.coalesce(F.pandas_udf(fold, "array<int>")(several("norm"), several("entity_type")), F.array(F.lit(0)))
    return per.withColumn("i", F.explode(kept)).withColumn("p", F.get("p", "i")).select("query_id", "p.norm", "p.entity_type", "p.source")


def _first_places(norms: list[str], kinds: list[str], near: float) -> list[int]:
    kept: list[int] = []
    for i, (norm, kind) in enumerate(zip(norms, kinds)):
        if not any(norm in norms[k] or (kinds[k] == kind and SequenceMatcher(None, norm, norms[k]).ratio() >= near) for k in kept):
            kept.append(i)
    return kept
