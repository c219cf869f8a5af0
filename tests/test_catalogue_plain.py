"""Queries without SQL against plain Python over whole tables of the smallest scale."""

import difflib
import re
import unicodedata

from evidara import catalogue
from evidara.operators import claims as cl
from evidara.plans.cases_text import SAMPLES
from tests.test_answering import concepts, own, plain_verdict

SF = "/root/testdata/sf0.001"


def pairs(spark):
    turns = {(r["conv_id"], r["turn"]): r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    return {c * 1000 + t: (r["text"], turns[c, t + 1]["text"]) for (c, t), r in turns.items() if r["role"] == "user" and (c, t + 1) in turns and turns[c, t + 1]["role"] == "assistant"}


def one_line(t):
    return " ".join(t.split())


def claims_of(answer):
    """place, claim of the sentences of three words or more, once each."""
    out, seen = [], set()
    for place, raw in enumerate(re.split(cl.SENTENCE_END, answer)):
        line = one_line(raw.removeprefix("-"))
        if len(line.split(" ")) >= 3 and line not in seen:
            seen.add(line)
            out.append((place, line))
    return out


def test_claim_split(spark):
    wanted = []
    for qa, (_, answer) in pairs(spark).items():
        for place, claim in claims_of(answer):
            parts = [one_line(p).strip(" ،") for p in re.split(cl.CLAUSE_END, claim)]
            useful = [p for p in parts if len(p.split(" ")) >= 3]
            wanted += [(qa, place, p) for p in (useful if len(useful) > 1 else [claim])]
    got = [(r["qa_id"], r["place"], r["claim"]) for r in catalogue.QUERIES["claim_split"](spark, SF).collect()]
    assert sorted(got) == sorted(wanted) and len(got) > 20


def test_claim_verify(spark):
    wanted = {}
    for qa, (question, answer) in pairs(spark).items():
        for place, claim in claims_of(answer):
            rows = []
            for name, body in (("E1", answer), ("E2", question)):
                row = {"texts": [body] if one_line(body) else [], "coverage": 1.0, "answer_relevance": qa % 5 / 5.0, "entity_identity": 0.8, "vector": 0.9, "intent": 1.0}
                status, score = plain_verdict(claim, question, row)
                a, b = own(claim), own(question)
                relevance = max(len(set(a) & set(b)) / min(len(a), len(b)) if a and b else 0.0, row["answer_relevance"])
                coverage = len(set(concepts(question)) & set(concepts(claim))) / len(concepts(question)) if concepts(question) else 1.0
                rows.append((-["unsupported", "weakly_supported", "supported"].index(status), -score, -relevance, -coverage, name, status))
            best = min(rows)
            wanted[f"{qa}-{place}"] = (best[5], best[4], round(-best[1], 6), round(-best[2], 6), round(-best[3], 6))
    got = {r["claim_id"]: (r["status"], r["best_evidence_id"], r["support_score"], r["question_relevance"], r["query_concept_coverage"]) for r in catalogue.QUERIES["claim_verify"](spark, SF).collect()}
    assert got == wanted and len({v[0] for v in got.values()}) > 1


def test_fuzzy_tokens(spark):
    words = {w for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").collect() for w in re.findall(r"\w+", r["p_name"].lower())}
    wanted = {(a, b, round(difflib.SequenceMatcher(None, a, b).ratio(), 6)) for a in words for b in words if difflib.SequenceMatcher(None, a, b).ratio() >= 0.78}
    assert {(r["left"], r["right"], r["ratio"]) for r in catalogue.QUERIES["fuzzy_tokens"](spark, SF).collect()} == wanted


def test_query_normalization_steps(spark):
    def steps(text):
        t, out = unicodedata.normalize("NFKC", text), []
        for name, f in (
            ("remove_urls", lambda x: re.sub(r"(?i)https?://\S+|www\.\S+", " ", x)), ("remove_emails", lambda x: re.sub(r"\b[\w.+-]+@[\w.-]+\.\w+\b", " ", x)),
            ("normalize_arabic_persian_digits", lambda x: x.translate(str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"))), ("remove_tatweel", lambda x: re.sub("ـ+", "", x)),
            ("remove_diacritics", lambda x: re.sub("[ً-ٰٟۖ-ۭ]", "", x)), ("normalize_arabic_letter_variants", lambda x: x.translate(str.maketrans("أإآٱىئؤة", "ااااييوه"))),
            ("normalize_punctuation", lambda x: x.translate(str.maketrans("؟،؛“”‘’", "?,;\"\"''"))), ("collapse_repeated_punctuation", lambda x: re.sub(r"([!?؟،,.;:])\1+", r"\1", x)), ("collapse_whitespace", lambda x: re.sub(r"\s+", " ", x)),
            ("trim_and_lowercase", lambda x: x.strip().lower()),
        ):
            after = f(t)
            if after != t:
                out.append(name)
            t = after
        return t, ",".join(out)

    got = {r["id"]: (r["norm"], r["steps"]) for r in catalogue.QUERIES["query_normalization_steps"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: steps(f"{SAMPLES[r['doc_id'] % len(SAMPLES)][1]} {r['text']}") for r in rows}
