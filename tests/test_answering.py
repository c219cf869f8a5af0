"""The answering pipeline against a plain Python version of its later steps, its channels, and how often it asks its providers."""

import hashlib
import json
import math
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from evidara.operators import context as ctx, rerank as rr, retrieval as rt
from evidara.plans import answering as aw
from evidara.sources.config import Corpus, Settings

QAS = [
    (1, "how to treat high fever in children", "Rest and plenty of water help with fever. Take 2 tablets of paracetamol daily", "a"),
    (2, "treat fever with cold water", "Cold water lowers fever quickly; use a wet towel for 10 minutes", "a"),
    (3, "what causes knee pain after running", "Knee pain comes from overuse of the joint: reduce running for a week", "b"),
    (4, "knee pain treatment", "Ice and rest reduce knee pain, and a doctor can check the joint", "b"),
    (5, "dry cough at night", "Honey and warm water calm a dry cough at night", "c"),
    (6, "treat high fever in children", "Rest and plenty of water help with fever. Take 2 tablets of paracetamol daily", "a"),
]
QUESTIONS = [(10, "treat high fever in children"), (11, "knee pain after running"), (12, "zzz unknown words"), (13, "dry cough at night and knee pain treatment")]


def frames(spark):
    return spark.createDataFrame(QUESTIONS, "query_id long, query string"), spark.createDataFrame(QAS, "qa_id long, question string, answer string, category string")


def words(t):
    return list(dict.fromkeys(re.findall(r"\w+", t.lower())))


def own(t):
    return [w for w in words(t) if len(w) > 1]


def concepts(t):
    return [w for w in own(t) if len(w) > 2 and not re.search(r"\d", w)]


def numbers(t):
    return set(re.findall(r"[0-9]+(?:[.,][0-9]+)?", t))


def plain_context(rows):
    """The greedy choice over gated rows of one query."""
    rows = sorted((r for r in rows if r["gate"] is None), key=lambda r: (-r["coverage"], -r["answer_relevance"], -r["final_score"], r["evidence_id"]))
    if not rows:
        return []
    top, taken, content, covered, uses = rows[0]["final_score"], [], set(), set(), Counter()
    for r in rows:
        free, mine = r["anchor"] or r["semantic"], set(r["matched_concepts"])
        q = words(r["query"])
        touch = max(len(set(q) & set(words(t))) / len(q) for t in (r["question"], f"{r['text']} {r['answer']}"))
        body = hashlib.md5("\x01".join((r["question"], r["text"], r["answer"])).encode()).hexdigest()
        if (touch < 0.05 and not free) or (r["final_score"] < top - ctx.MARGIN and not mine - covered and not free) or body in content or uses[r["qa_id"]] >= 2:
            continue
        taken.append(r["evidence_id"])
        content.add(body)
        covered |= mine
        uses[r["qa_id"]] += 1
        if len(taken) == 6:
            break
    n = rows[0]["n_concepts"]
    if n and taken and len(covered) / n < 0.25 and not any(r["anchor"] for r in rows if r["evidence_id"] in taken):
        return []
    return taken


def plain_verdict(claim, query, row):
    """Status and support of one claim by the one passage it cites."""
    best = (1, 0.0, "")
    for text in row["texts"]:
        whole = " ".join(text.split())
        parts = [" ".join(p.split()) for p in re.split(r"(?<![A-Za-z])\.|[!؟?؛;\n،:]+|(?:-{2,}|(?<=\s)[-–—](?=\s))", whole)]
        parts = [p for p in parts if p]
        for s in [*parts, *([" ".join(parts)] if len(parts) > 1 else []), whole]:
            score = len(set(own(claim)) & set(own(s))) / len(own(claim)) if own(s) else 0.0
            best = min(best, (1 if numbers(claim) - numbers(s) else 0, -score, s))
    ok, score = best[0] == 0, -best[1]
    direct = len(set(own(claim)) & set(own(query))) / min(len(own(claim)), len(own(query)))
    relevance = max(direct, row["answer_relevance"])
    n = len(concepts(query))
    coverage = len(set(concepts(query)) & set(concepts(claim))) / n if n else 1.0
    floor = 1 / n if n else 0.0
    scope = floor == 0 or coverage >= floor or (row["coverage"] >= floor and row["answer_relevance"] >= 0.75)
    trusted = row["answer_relevance"] >= 0.8 and row["entity_identity"] >= 0.75 and row["vector"] >= 0.84 and row["intent"] >= 0.5
    if ok and scope and (score >= 0.4 or (score >= 0.25 and trusted)) and relevance >= 0.25:
        return "supported", score
    return ("weakly_supported" if ok and scope and score >= 0.25 and relevance >= 0.15 else "unsupported"), score


def test_later_steps_in_plain_python(spark):
    questions, qas = frames(spark)
    out = aw.answer_questions(questions, qas, encoder=aw.hashing_encoder)
    by = lambda name, key="query_id": defaultdict(list, {k: [r for r in rows if r[key] == k] for rows in [[r.asDict() for r in out[name].collect()]] for k in {r[key] for r in rows}})
    gated, context, claims, verdicts, answers = (by(n) for n in ("evidence", "context", "claims", "verdicts", "answers"))
    assert set(answers) == {10, 11, 12, 13}
    supported = 0
    for q, query in QUESTIONS:
        chosen = sorted(context[q], key=lambda r: r["place"])
        assert [r["evidence_id"] for r in chosen] == plain_context(gated[q])
        shown = [r for r in chosen if r["texts"]]
        made = {}
        for r in shown[:2]:
            claim = " ".join(" ".join(r["texts"][0].split())[:800].split(".")[0].split())
            made.setdefault(claim, r)
        got = {c["claim"]: c["evidence_id"] for c in claims[q] if c["error"] is None}
        if any(r["direct_anchor"] for r in shown):  # one passage may stand alone
            assert len(got) <= 2 and all(c in {" ".join(r["texts"][0].split(".")[0].split()) for r in shown} for c in got)
        else:
            assert got == {c: r["display_id"] for c, r in made.items() if len(c.split(" ")) >= 3}
        rows = {r["display_id"]: r for r in chosen}
        status = []
        for v in verdicts[q]:
            wanted, score = plain_verdict(v["claim"], query, rows[got[v["claim"]]])
            assert (v["status"], v["support_score"]) == (wanted, round(score, 6))
            status.append(v)
        kept = [v for v in sorted(status, key=lambda v: v["n"]) if v["status"] == "supported"]
        supported += len(kept)
        a = answers[q][0]
        assert a["kept"] == len(kept) and a["removed"] == len(status) - len(kept)
        assert a["answer"] == ("\n".join(v["claim"] for v in kept) or aw.INSUFFICIENT)
        covered = set(concepts(" ".join(v["claim"] for v in kept))) & set(concepts(query))
        share = len(covered) / len(concepts(query))
        assert math.isclose(a["query_coverage"], round(share, 6))
        label = "insufficient_evidence" if not kept else "fully_answerable" if share >= 0.8 and len(kept) == len(status) else "partially_answerable" if share >= 0.5 else "supported_but_incomplete"
        assert a["answerability"] == label
        if status:
            worth = {"fully_answerable": 1.0, "partially_answerable": 0.65, "supported_but_incomplete": 0.35, "insufficient_evidence": 0.0}[label]
            mean = lambda key: sum(v[key] for v in kept) / len(kept) if kept else 0.0
            score = 0.30 * len(kept) / len(status) + 0.20 * mean("support_score") + 0.15 * len(kept) / len(status) + 0.15 * sum(rows[got[v["claim"]]]["source_reliability"] for v in kept) / max(1, len(kept)) + 0.05 * worth
            assert math.isclose(a["reliability"], round(min(score, 0.2) if not kept else score, 6), abs_tol=2e-6)
    assert supported >= 2 and answers[12][0]["answerability"] == "insufficient_evidence" and answers[12][0]["generation_status"] == "no evidence"


def test_each_prompt_is_asked_once(spark, tmp_path):
    log = tmp_path / "calls"

    def provider(prompts):
        with open(log, "a") as f:
            f.write("".join(p + "\n" for p in prompts))
        return aw.extractive_provider(prompts)

    questions, qas = frames(spark)
    out = aw.answer_questions(questions, qas, provider, encoder=aw.hashing_encoder)
    for name, df in out.items():
        if df is not None:
            df.collect(), df.count()
            assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") < 50, name
    calls = log.read_text().splitlines()
    assert len(calls) == len(set(calls)) == out["context"].select("query_id").distinct().count()


def test_a_failing_provider_is_told_from_lacking_evidence(spark):
    def provider(prompts):
        raise aw.ProviderError("down", retryable=False)

    questions, qas = frames(spark)
    rows = {r["query_id"]: r for r in aw.answer_questions(questions, qas, provider)["answers"].collect()}
    assert rows[10]["answer"] == aw.UNAVAILABLE and "down" in rows[10]["generation_status"] and rows[12]["answer"] == aw.INSUFFICIENT


def test_graph_analysis_and_fallback(spark):
    def analyser(prompts):
        out = []
        for p in prompts:
            q = json.loads(p)["query"]
            named = [{"surface_form": n, "normalized_form": n, "entity_type": "Symptom", "source": "corrected_query", "confidence": 0.9} for n in ("fever", "knee pain") if n in q]
            out.append(json.dumps({"corrected_query": q, "reformulated_query": q, "query_class": "simple_medical", "complexity": "low", "primary_intent": "treatment_request", "secondary_intents": [], "medical_phrases": named, "confidence": 0.9, "warnings": []}) if "zzz" not in q else "broken")
        return out

    entities = spark.createDataFrame([("e1", "Fever", "fever", [], "Symptom"), ("e2", "Paracetamol", "paracetamol", [], "Treatment"), ("e3", "Knee pain", "knee pain", [], "Symptom"), ("e4", "Ice", "ice", [], "Treatment")], "entity_id string, name string, canonical string, aliases array<string>, entity_type string")
    edge = lambda i, a, b, x, y, qa: (i, i, a, b, x, y, "TREATED_BY", "direct", 0.9, f"{y} helps with {x}", qa)
    edges = spark.createDataFrame([edge("r1", "e1", "e2", "fever", "paracetamol", "1"), edge("r2", "e3", "e4", "knee pain", "ice", "4")], "relation_id string, source_relation_id string, source_entity_id string, target_entity_id string, source_name string, target_name string, graph_relation_type string, direction string, confidence double, evidence string, qa_id string")
    mentions = spark.createDataFrame([("m1", "1", "plenty of water help with fever", "answer", QAS[0][1], QAS[0][2], "preprocessed_id")], "mention_id string, qa_id string, evidence string, field string, question string, answer string, source_quality string")
    questions, qas = frames(spark)
    out = aw.answer_questions(questions, qas, graph=aw.Graph(entities, edges, mentions), encoder=aw.hashing_encoder, analyser=analyser)
    plan = {r["query_id"]: r for r in out["plan"].collect()}
    assert plan[10]["primary_entity_ids"] == ["e1"] and plan[10]["use_graph_search"] and plan[10]["preferred_relation_types"] == ["TREATED_BY", "TREATS"]
    assert {(r["query_id"], r["relation_id"]) for r in out["relations"].collect()} >= {(10, "r1"), (11, "r2"), (13, "r2")}
    found = {(r["query_id"], r["evidence_id"]): r for r in out["evidence"].collect()}
    assert (10, "relation::r1") in found and found[10, "relation::r1"]["origin"] == "validated_relation"
    assert plan[12]["analysis_status"] == "fallback" and not plan[12]["use_graph_search"]
    facts = {(r["query_id"], r["fact"]) for r in out["facts"].collect()}
    assert facts <= {(10, "fever --TREATED_BY--> paracetamol"), (11, "knee pain --TREATED_BY--> ice"), (13, "knee pain --TREATED_BY--> ice")}
    assert out["answers"].count() == 4
    # a shortlist that gives no context is tried again, wider and by vectors
    narrow = Settings(corpus=Corpus(lexical_candidate_k=1, semantic_top_k=1))
    gone = out["context"].limit(0)
    again = aw.fall_back(out["plan"], gone, qas, out["evidence"].limit(0).select(*aw.ev.COLUMNS), (aw.encode(out["plan"].select("query_id", F.col("reformulated_query").alias("t")), "t", aw.hashing_encoder, "query_vector"), aw.encode(qas.select("qa_id", F.col("question").alias("t")), "t", aw.hashing_encoder)), narrow)
    assert again is not None and {r["channel"] for r in again.collect()} >= {4}
    assert aw.context_only(questions, qas, encoder=aw.hashing_encoder).count() > 0


def test_misspelt_names_count(spark):
    """A near-equal spelling stands for the name in seeds, relations and evidence, as in plain Python; other words do not."""
    near = lambda a, b: SequenceMatcher(None, a, b).ratio()
    asked = [(1, "paracetamoll tablets"), (2, "paracetamol tablets"), (3, "ibuprofen tablets")]
    rows = [(q, t, t, "", f"e{q}", "dose of paracetamol", "take paracetamol daily", "", "", 0.5, 0.0, 0.0, 0.0) for q, t in asked]
    df = spark.createDataFrame(rows, "query_id int, original_query string, query string, primary_intent string, evidence_id string, question string, text string, answer string, source_quality string, score double, relation_support double, qa_support double, vector_similarity double")
    got = {r["query_id"]: r for r in rr.rerank_evidence(df, fuzzy=True).collect()}
    held = "dose of paracetamol take paracetamol daily"
    for q, t in asked:
        hits = [c for c in concepts(t) if any(c == x or near(c, x) >= 0.92 for x in concepts(held))]
        assert got[q]["matched_concepts"] == hits and got[q]["coverage"] == round(len(hits) / len(concepts(t)), 6)
    assert got[1]["text_identity"] == near("paracetamoll", "paracetamol") and got[2]["text_identity"] == 0.5 and got[3]["text_identity"] == 0.0
    assert "paracetamoll" in got[1]["matched_concepts"] and got[1]["final_score"] > got[3]["final_score"]
    exact = {r["query_id"]: r for r in rr.rerank_evidence(df).collect()}
    assert exact[1]["matched_concepts"] == [] and exact[2]["final_score"] == got[2]["final_score"]
    hits = spark.createDataFrame([(q, f"x{q}", "paracetamol", "Treatment", 0.95, 0) for q, _ in asked], "query_id int, entity_id string, title string, entity_type string, score double, ordinal int")
    named = spark.createDataFrame([(1, "paracetamoll", "Treatment"), (2, "paracetamol", "Treatment"), (3, "ibuprofen", "Treatment")], "query_id int, norm string, entity_type string")
    none = spark.createDataFrame([], "query_id int, entity_id string")
    assert {r["query_id"] for r in rt.seed_scores(none, hits, named, fuzzy=True).collect()} == {1, 2}
    assert {r["query_id"] for r in rt.seed_scores(none, hits, named).collect()} == {2}
    relation = [(q, t, f"r{q}", f"r{q}", 0.9, "TREATED_BY", ["TREATED_BY"], 0.5, 0.7, "", "fever", "paracetamol", "direct", False, False) for q, t in asked]
    df = spark.createDataFrame(relation, "query_id int, query string, relation_id string, source_relation_id string, confidence double, relation_type string, preferred array<string>, semantic double, seed_score double, evidence string, source_name string, target_name string, direction string, generic_seed boolean, type_conflict boolean")
    got = {r["query_id"]: r["medical_identity"] for r in rr.score_relations(df, fuzzy=True).collect()}
    assert got == {1: near("paracetamoll", "paracetamol"), 2: 1.0, 3: 0.0}


def test_encoder_gives_unit_vectors():
    v = aw.hashing_encoder(["a b c", "", "a b c"])
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 0, 1]) and np.allclose(v[0], v[2])


def test_encoder_gets_few_texts_at_once(spark, monkeypatch):
    monkeypatch.setattr(aw, "ENCODED", 3)
    df = spark.range(20, numPartitions=1).selectExpr("id", "CASE WHEN id % 7 <> 0 THEN concat('t', id) END AS t")

    def encoder(texts):
        assert len(texts) <= 3 and None not in texts
        return np.array([[len(t), len(texts)] for t in texts], np.float32)

    got = aw.encode(df, "t", encoder).collect()
    assert [r["embedding"][0] for r in got] == [0 if i % 7 == 0 else len(f"t{i}") for i in range(20)] and got[0]["t"] is None
