import math
import re
import sqlite3

from pyspark.sql import functions as F

from evidara.functions import terms as tm
from evidara.operators import claims as cl, corpus, entity_rules as er, graph as gr, metrics as mt, search as se


def test_bm25_equals_fts5(spark):
    docs = [(1, "fever and pain", "take rest and water", "a"), (2, "pain in the knee", "see a doctor for pain", "b"), (3, "cough", "honey", "a"), (4, "fever fever", "rest", "pain")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(question, answer, category)")
    con.executemany("INSERT INTO t(rowid, question, answer, category) VALUES (?, ?, ?, ?)", docs)
    wanted = dict(con.execute("SELECT rowid, -bm25(t, 3.0, 1.0, 0.3) FROM t WHERE t MATCH '\"fever\" OR \"pain\" OR \"honey\"'").fetchall())
    index, stats = se.postings(spark.createDataFrame(docs, "qa_id long, question string, answer string, category string"), "qa_id")
    terms = spark.createDataFrame([(1, "fever"), (1, "pain"), (1, "honey")], "query_id int, term string")
    got = {r["qa_id"]: r["bm25"] for r in se.bm25(index, stats, terms, "qa_id", 10).collect()}
    assert got.keys() == wanted.keys()
    assert all(math.isclose(got[k], wanted[k], rel_tol=1e-6, abs_tol=1e-8) for k in got)


def test_waterfall_reasons(spark):
    rows = [(2, "q1", "a1", "c"), (3, "q1", "a1", "c"), (4, "Q1!", "a1", "c"), (5, "", "a", "c"), (6, "held", "a", "c"), (7, "known", "pair", "c"), (8, "x", "y", "c"), (9, "eq", "ea", "c")]
    df = spark.createDataFrame(rows, "row_id long, question string, answer string, category string")
    pair = lambda q, a: spark.createDataFrame([(q, a)], "question_norm string, answer_norm string")
    out = corpus.skip_reasons(df, spark.createDataFrame([(8,)], "row_id long"), pair("known", "pair"), pair("eq", "ea"), spark.createDataFrame([("held",)], "question_norm string"))
    got = {r["row_id"]: r["reason"] for r in out.collect()}
    assert got == {2: "kept", 3: "duplicate", 4: "normalized_duplicate", 5: "empty", 6: "evaluation_query", 7: "existing_pair", 8: "existing_row", 9: "evaluation_pair"}


def test_chunks_follow_the_greedy_rule(spark):
    sizes = [3000, 3000, 600, 7000, 10, *[1] * 9]
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)], "g string, k long, size int")
    got = [r["chunk"] for r in corpus.chunk_numbers(df, ["g"], "k", "size").orderBy("k").collect()]
    assert got == chunks(sizes)


def chunks(sizes):
    out, chunk, n, chars = [], 0, 0, 0
    for s in sizes:
        if n >= 8 or (n and chars + s > 6500):
            chunk, n, chars = chunk + 1, 0, 0
        out.append(chunk)
        n, chars = n + 1, chars + s
    return out


def test_two_hops_use_no_edge_twice(spark):
    edges = spark.createDataFrame([("e1", "a", "b", "T"), ("e2", "b", "c", "T"), ("e3", "c", "d", "T"), ("e4", "a", "b", "U")], "relation_id string, source_entity_id string, target_entity_id string, graph_relation_type string")
    seeds = spark.createDataFrame([("a",), ("c",)], "entity_id string")
    got = {(r["seed_entity_id"], r["relation_id"]) for r in gr.hop_edges(edges, seeds, 2).collect()}
    assert got == {("a", "e1"), ("a", "e2"), ("a", "e4"), ("c", "e2"), ("c", "e3"), ("c", "e1"), ("c", "e4")}


def test_inverse_edges_match_direct_ones(spark):
    rel = spark.createDataFrame([("r1", "HAS_SYMPTOM", "a", "b", "X", "Y"), ("r2", "OTHER", "a", "c", "X", "Z")], "relation_id string, relation_type string, source_entity_id string, target_entity_id string, source_type string, target_type string")
    rows = {r["edge_id"]: r for r in gr.both_directions(rel).collect()}
    assert set(rows) == {"r1", "r1__inverse", "r2"}
    assert (rows["r1__inverse"]["source_entity_id"], rows["r1__inverse"]["graph_relation_type"], rows["r1__inverse"]["source_type"]) == ("b", "SYMPTOM_OF", "Y")


def test_rank_metrics(spark):
    samples = [(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0), (0.3, 1)]
    df = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(samples)], "id int, score double, label int")
    pos, neg = [s for s, y in samples if y], [s for s, y in samples if not y]
    wanted = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert mt.auroc(df).first()[0] == round(wanted, 6)
    assert mt.average_precision(df, "id").first()[0] == round((1 + 2 / 3 + 3 / 4) / 3, 6)


def test_claims_from_an_answer(spark):
    text = "- Rest helps with fever [E1]. Short one. Rest helps with fever [E1]! Drink much warm water [E2, E3]\nلا توجد أدلة كافية على ذلك"
    rows = cl.extract_claims(spark.createDataFrame([(1, text)], "id int, answer string"), "id", "answer").orderBy("place").collect()
    # a full stop after a Latin letter ends no sentence
    assert [(r["claim"], r["citations"]) for r in rows] == [("Rest helps with fever", ["E1"]), ("Short one. Rest helps with fever", ["E1"]), ("Drink much warm water", ["E2", "E3"])]


def test_verdicts(spark):
    rows = [("good", "rest lowers fever", "rest lowers fever quickly"), ("number", "take 3 pills for fever", "take 5 pills for fever"), ("weak", "rest and sleep and water lower fever", "fever needs rest now"), ("none", "rest lowers fever", None)]
    claims = spark.createDataFrame([(i, c, "fever treatment rest", "none", i, "E1") for i, c, _ in rows], "claim_id string, claim string, query string, primary_intent string, query_id string, evidence_id string")
    evidence = spark.createDataFrame([(i, "E1", [s] if s else [], i == "none", 0.9, 0.9, 0.9, None, 1.0) for i, _, s in rows], "query_id string, evidence_id string, texts array<string>, question_only boolean, answer_relevance double, entity_identity double, vector_similarity double, intent_support double, cited_coverage double")
    got = {r["claim_id"]: (r["status"], r["failed_checks"]) for r in cl.verify(claims, evidence, ["query_id", "evidence_id"]).collect()}
    assert got["good"] == ("supported", [])
    assert got["number"][0] == "unsupported" and "number_mismatch" in got["number"][1]
    assert got["weak"][0] == "supported"  # a third of its words, from a passage past the trust gates
    assert got["none"][0] == "unsupported" and "question_only_evidence" in got["none"][1]


def test_segments_join_those_of_equal_polarity(spark):
    df = spark.createDataFrame([(1, ["يفيد الماء. لا يفيد السكر. يفيد النوم", ""]), (2, None)], "id int, texts array<string>")
    got = {(r["segment"], r["only"]) for r in cl.segments(df, ["id"]).collect()}
    assert got == {("يفيد الماء", None), ("لا يفيد السكر", None), ("يفيد النوم", None), ("يفيد الماء يفيد النوم", False), ("يفيد الماء. لا يفيد السكر. يفيد النوم", True)}


def test_distinct_phrases(spark):
    rows = [(1, "fever", "Symptom", "corrected_query"), (1, "high fever", "Symptom", "corrected_query"), (1, "high fevers", "Symptom", "reformulated_query"), (1, "cough", "Symptom", "reformulated_query"), (2, "fever", "Symptom", "corrected_query")]
    got = {(r["query_id"], r["norm"]) for r in er.distinct_phrases(spark.createDataFrame(rows, "query_id int, norm string, entity_type string, source string")).collect()}
    assert got == {(1, "high fever"), (1, "cough"), (2, "fever")}


def test_mention_resolution_needs_one_record(spark):
    mentions = spark.createDataFrame([("m1", "c", "cough"), ("m2", "c", "fever"), ("m3", "c", "zzz")], "mention_id string, chunk_id string, evidence string")
    records = spark.createDataFrame([("c", 1, "a cough and fever"), ("c", 2, "fever")], "chunk_id string, qa_id int, body string")
    assert [tuple(r) for r in er.resolve_by_evidence(mentions, records).collect()] == [("m1", 1)]


def test_sample_is_balanced_and_repeats(spark):
    df = spark.createDataFrame([(i, "ab"[i % 10 == 0]) for i in range(100)], "id int, cat string")
    a = corpus.balanced_sample(df, "cat", "id", 30, "s").collect()
    b = corpus.balanced_sample(df.repartition(7), "cat", "id", 30, "s").collect()
    assert {r["id"] for r in a} == {r["id"] for r in b}
    assert sum(r["cat"] == "b" for r in a) == 10 and len(a) == 30


def test_entity_replies(spark):
    import json

    from evidara.operators import extraction as ex

    mention = lambda qa: {"qa_id": qa, "surface_form": "x", "field": "answer", "evidence": "x"}
    entity = lambda name, kind, qa="q1": {"canonical_name": name, "entity_type": kind, "aliases": [" y ", ""], "mentions": [mention(qa)], "confidence": 2}
    body = json.dumps({"chunk_id": "c1", "entities": [entity("اسبرين", "Treatment"), entity("عين", "Symptom"), entity("a", "Other"), entity("b", "Nonsense"), entity("", "Test"), entity("c", "Test", "q9")]})
    replies = spark.createDataFrame([("c1", "ok", f"```json\n{body}\n```"), ("c2", "error", None), ("c3", "ok", "no json"), ("c9", "ok", body)], "chunk_id string, status string, response_text string")
    good, bad = ex.validate_entities(replies, spark.createDataFrame([("c1", ["q1"]), ("c3", ["q2"])], "chunk_id string, qa_ids array<string>"))
    rows = good.collect()
    assert [(r["canonical_name"], r["entity_type"], r["quality"], r["aliases"], r["confidence"]) for r in rows] == [("الأسبرين", "Treatment", "medium", ["y"], 1.0)]
    errors = sorted((r["chunk_id"], r["stage"]) for r in bad.collect())
    assert errors == [("c1", "validation")] * 5 + [("c2", "model_call"), ("c3", "parse"), ("c9", "validation")]


def test_relation_replies(spark):
    import json

    from evidara.operators import extraction as ex

    body = json.dumps({"relations": [{"relation_id": "r1", "relation_type": "NONSENSE", "keep": True, "confidence": "0.7"}, {"relation_id": "r2", "relation_type": "TREATED_BY", "keep": False, "confidence": "high"}, {"relation_id": "zz", "keep": True}]})
    replies = spark.createDataFrame([("c1", "ok", body)], "chunk_id string, status string, response_text string")
    good, bad = ex.validate_relations(replies, spark.createDataFrame([("r1", "HAS_SYMPTOM"), ("r2", "DIAGNOSED_BY")], "relation_id string, relation_type string"))
    assert {(r["relation_id"], r["relation_type"], r["keep"], r["confidence"]) for r in good.collect()} == {("r1", "HAS_SYMPTOM", True, 0.7), ("r2", "TREATED_BY", False, 0.0)}
    assert [r["error"] for r in bad.collect()] == ["Unknown relation_id: zz"]


def test_anchors_and_fallback(spark):
    from evidara.operators import retrieval as rt

    rows = [(1, 0, "دواء", "Treatment", "x"), (1, 1, "سعال", "Symptom", "x"), (1, 2, "اسبرين", "Treatment", "x"), (2, 0, "سعال", "Symptom", "comparison"), (2, 1, "اسبرين", "Treatment", "comparison"), (3, 0, "اسبرين", "Treatment", "x")]
    got = {r["query_id"]: r["phrases"] for r in rt.relevance_phrases(spark.createDataFrame(rows, "query_id int, place int, norm string, entity_type string, primary_intent string")).collect()}
    assert got == {1: ["سعال"], 2: ["سعال", "اسبرين"], 3: ["اسبرين"]}
    df = spark.createDataFrame([("simple_medical", True, 0, 0, "سعال"), ("unclear", True, 1, 1, "سعال"), ("simple_medical", True, 0, 0, "ما"), ("simple_medical", False, 1, 0, "ما"), ("simple_medical", True, 1, 0, "ما")], "c string, v boolean, p int, u int, t string")
    out = [r[0] for r in df.select(rt.needs_fallback(F.col("c"), F.col("v"), F.col("p"), F.col("u"), tm.token_set(F.col("t")))).collect()]
    assert out == [True, False, False, False, True]


def test_chunks_go_on_over_partitions(spark):
    import random

    rnd = random.Random(3)
    groups = {g: [rnd.choice([1, 40, 900, 3000, 7000]) for _ in range(n)] for g, n in (("a", 700), (None, 90), ("b", 3), ("c", 1), ("d", 200))}
    rows = [(g, i, s) for g, sizes in groups.items() for i, s in enumerate(sizes)]
    rnd.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "3", "17", "150"):  # many partitions within a group, some of a row or two
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            df = spark.createDataFrame(rows, "g string, k long, size int")
            got = {(r["g"], r["k"]): r["chunk"] for r in corpus.chunk_numbers(df, ["g"], "k", "size").collect()}
            assert got == {(g, i): c for g, sizes in groups.items() for i, c in enumerate(chunks(sizes))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_places_and_running_sums(spark):
    from evidara.sources.stages import with_places

    df = spark.createDataFrame([(i * 7 % 50, i % 3) for i in range(50)], "k int, v int").repartition(6)
    rows = sorted((r["k"], r["place"], r["s"]) for r in with_places(df, ["k"], sums={"s": "v"}).collect())
    value = {i * 7 % 50: i % 3 for i in range(50)}
    assert rows == [(k, k + 1, sum(value[j] for j in range(k + 1))) for k in range(50)]


def test_contained_items(spark):
    docs = ["xx the quick brown fox jumps over it yy", "quick brown fox", "the quick  brown fox jumps over it", "nothing", "ab cd", "a b c d", None]
    items = ["he quick brown fox jumps over it", "brown fox", "quick brown", "b c", "cd", "quick", "zzz"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id int, needle string")
    got = {(r["doc_id"], r["item_id"]) for r in corpus.contained(d, "doc_id", "text", b, "item_id", "needle").collect()}
    assert got == {(i, j) for i, t in enumerate(docs) for j, n in enumerate(items) if t and n in t}


def test_sequence_ids_and_distinct_mentions(spark):
    df = spark.createDataFrame([("b", 2), ("a", 9), ("a", 1), (None, 5)], "g string, k int")
    got = {(r["g"], r["k"]): r["sequence_id"] for r in corpus.sequence_ids(df, ["g"], "k", "chunk_", 5).collect()}
    assert got == {(None, 5): "chunk_00001", ("a", 1): "chunk_00002", ("a", 9): "chunk_00003", ("b", 2): "chunk_00004"}
    m = spark.createDataFrame([(1, "x", "late", 5), (1, "x", "first", 2), (2, "x", "one", 9)], "qa int, e string, v string, ordinal int")
    assert {tuple(r) for r in corpus.distinct_mentions(m, ["qa", "e"]).collect()} == {(1, "x", "first", 2), (2, "x", "one", 9)}


def test_stored_index(spark, tmp_path):
    import pytest

    rows = [(1, "fever and pain", "rest", "a"), (2, "pain in the knee", "doctor for pain", "b"), (3, "held out", "x", "a"), (4, "Fever and  pain", "rest", "a"), (5, "", "x", "a"), (6, "cough", "honey", None)]
    df = spark.createDataFrame(rows, "qa_id long, question string, answer string, category string")
    held = spark.createDataFrame([("held out",)], "question_norm string")
    found = se.write_index(df, str(tmp_path / "index"), "v1", held)
    assert (found["source_rows"], found["indexed_rows"], found["heldout_rows"], found["duplicate_rows"], found["invalid_rows"]) == (6, 3, 1, 1, 1)
    postings, stats, records = se.open_index(spark, str(tmp_path / "index"), "v1")
    asked = spark.createDataFrame([(1, "fever pain"), (2, "honey")], "query_id int, query string")
    plain = se.search_qa(records, asked).select("query_id", "qa_id", "position", "bm25", "score", "rank").collect()
    stored = se.search_qa(records, asked, index=(postings, stats)).select("query_id", "qa_id", "position", "bm25", "score", "rank").collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, stored)) and {r["qa_id"] for r in stored} == {1, 2, 6}
    se.write_index(df.filter("qa_id < 3"), str(tmp_path / "index"), "v2")
    assert se.open_index(spark, str(tmp_path / "index"), "v2")[2].count() == 2
    with pytest.raises(ValueError, match="version"):
        se.open_index(spark, str(tmp_path / "index"), "v1")


def test_compatibility_forms_in_search_and_links(spark):
    from evidara.operators import linking as li
    from evidara.functions import text as tx

    qas = spark.createDataFrame([(1, "\ufed3\ufed8\ufeae \ufe8d\ufedf\ufeaa\ufee1", "x", "c"), (2, "other words", "y", "c")], "qa_id long, question string, answer string, category string")
    plain = spark.createDataFrame([(1, "فقر الدم"), (2, "\ufed3\ufed8\ufeae \ufe8d\ufedf\ufeaa\ufee1")], "query_id int, query string")
    terms = {r["query_id"]: (r["terms"], r["legacy"]) for r in se.index_terms(plain).collect()}
    assert terms[1] == (["فقر", "الدم"], []) and terms[2][0] == ["فقر", "الدم"] and len(terms[2][1]) == 2
    got = {r["query_id"]: (r["qa_id"], r["score"]) for r in se.search_qa(qas, plain).collect()}
    assert got[2][0] == 1 and got[2][1] > 0.9  # found by its own glyphs, scored by the plain words
    names = tx.with_nfkc(qas, "question").select(F.col("qa_id").cast("string").alias("entity_id"), tx.query_form(F.col("question")).alias("canonical"), F.array().cast("array<string>").alias("aliases"), F.lit("T").alias("entity_type"))
    phrases = plain.filter("query_id = 1").select(F.col("query_id").alias("phrase_id"), tx.query_form(F.col("query")).alias("norm"), F.lit("T").alias("entity_type"))
    assert [(r["status"], r["entity_id"]) for r in li.link_phrases(phrases, names).collect()] == [("linked", "1")]


def test_links_count_ties_without_gathering_them(spark):
    from evidara.operators import linking as li

    ents = spark.createDataFrame([("e1", "fever", ["heat"], "S"), ("e2", "pain", [], "S"), ("e3", "pain", [], "S"), ("e4", "drug", [], "T")], "entity_id string, canonical string, aliases array<string>, entity_type string")
    phrases = spark.createDataFrame([(1, "fever", "S"), (2, "pain", "S"), (3, "drug", "S"), (4, "zzz", "S"), (5, "fever", "S"), (6, "heat", "S")], "phrase_id int, norm string, entity_type string")
    got = {r["phrase_id"]: (r["status"], r["entity_id"]) for r in li.link_phrases(phrases, ents).collect()}
    assert got == {1: ("linked", "e1"), 2: ("ambiguous", None), 3: ("type_conflict", None), 4: ("unresolved", None), 5: ("linked", "e1"), 6: ("unresolved", None)}


def test_query_analysis(spark):
    import json

    from evidara.operators import analysis as an

    base = {"corrected_query": "علاج الصداع", "reformulated_query": "ما علاج الصداع؟", "query_class": "simple_medical", "complexity": "low", "primary_intent": "general_medical_advice", "secondary_intents": ["comparison", "comparison"], "medical_phrases": [], "confidence": 0.7, "warnings": [" w ", ""]}
    phrase = lambda **k: {"surface_form": "الصداع", "normalized_form": "صداع", "entity_type": "Symptom", "source": "corrected_query", "confidence": 0.8} | k
    make = lambda **k: json.dumps(base | k, ensure_ascii=False)
    replies = [
        (1, "علاج الصداع", make(medical_phrases=[phrase(), phrase(surface_form="السكر"), phrase(entity_type="Body"), phrase(confidence="x"), phrase(confidence=3), "no object"])),
        (2, "اشعر بالم", make(corrected_query="اشعر بالم", reformulated_query="سبب الالم")),
        (3, "علاج", make(query_class="odd")), (4, "ما اعراض البرد", "no json"), (5, "طقس", json.dumps({k: v for k, v in base.items() if k != "warnings"})), (6, "x", make(confidence=2)),
        (7, "شيء", make(corrected_query="شيء", reformulated_query="شيء", query_class="non_medical", primary_intent="treatment_request")), (8, "شيء", make(query_class="non_medical", medical_phrases=[phrase()])),
        (9, "x", json.dumps({"query_class": " ", "confidence": "y", "secondary_intents": ["no", "comparison"], "medical_phrases": 3})),
    ]
    df = spark.createDataFrame([(i, q, q, r) for i, q, r in replies], "query_id int, original_query string, normalized_query string, reply string")
    analysis, phrases = an.validate(df)
    got = {r["query_id"]: r for r in analysis.collect()}
    assert (got[1]["primary_intent"], got[1]["confidence"], got[1]["preferred_relation_types"], got[1]["analysis_status"]) == ("treatment_request", 0.9, ["TREATED_BY", "TREATS"], "model")
    assert got[1]["warnings"][0] == "w" and got[1]["warnings"][1:] == [
        "phrase[1].normalized_form.replaced", "phrase[2].surface_form.not_there", "phrase[3].entity_type.unknown:Body", "phrase[4].confidence.no_number", "phrase[5].confidence.range", "phrase[6].no_object",
    ]
    assert [(r["query_id"], r["norm"], r["entity_type"]) for r in phrases.collect()] == [(1, "الصداع", "Symptom")]
    assert got[2]["reformulated_query"].startswith("ما التوجيه") and "reformulated_query.new_intent" in got[2]["warnings"]
    assert got[3]["analysis_status"] == "fallback" and got[3]["warnings"][0] == "reply.refused:query_class.unknown:odd" and got[3]["primary_intent"] == "treatment_request"
    assert got[4]["primary_intent"] == "symptom_request" and got[4]["warnings"][:2] == ["reply.refused:reply.no_object", "intent.by_rules"]
    assert got[5]["primary_intent"] == "non_medical" and got[5]["query_class"] == "non_medical" and got[5]["warnings"][0] == "reply.refused:warnings.absent"
    assert got[6]["warnings"][0] == "reply.refused:confidence.range" and got[6]["primary_intent"] == "unclear_intent"
    assert (got[7]["primary_intent"], got[7]["secondary_intents"]) == ("non_medical", [])
    assert got[7]["analysis_status"] == "model" and got[8]["analysis_status"] == "fallback" and got[8]["warnings"][0] == "reply.refused:medical_phrases.unexpected"
    assert got[9]["warnings"][0] == (
        "reply.refused:corrected_query.absent,reformulated_query.absent,complexity.absent,primary_intent.absent,warnings.absent,query_class.unknown:,medical_phrases.no_list,secondary_intents.unknown:no,confidence.no_number"
    )


def test_authoritative_texts_and_ties(spark):
    from evidara.operators import evidence as ev

    rows = [("q", "qa::1", "what helps", "what helps", "rest helps", "mention_evidence", None, ["r1"], "1"), ("q", "qa::2", "rest helps", "what", "rest helps", "x", None, [], "1"), ("q", "r", "a fact", "", "", "x", "validated_relation", ["r1", "r2"], "")]
    df = spark.createDataFrame(rows, "query_id string, evidence_id string, text string, question string, answer string, source_quality string, origin_label string, relation_ids array<string>, qa_id string")
    df = df.withColumn("facts", F.when(F.col("evidence_id") == "r", F.array(F.lit(" f "), F.lit(""))))
    got = {r["evidence_id"]: (r["origin"], r["question_only"], r["texts"]) for r in ev.authoritative(df, "facts").collect()}
    assert got == {"qa::1": ("question", True, ["rest helps"]), "qa::2": ("answer", False, ["rest helps"]), "r": ("validated_relation", False, ["a fact", "f"])}
    relations = spark.createDataFrame([("q", "r1", "1"), ("q", "r2", "9")], "query_id string, relation_id string, qa_id string")
    ties = sorted((r["relation_id"], r["evidence_id"], r["by"]) for r in ev.of_relations(relations, df).collect())
    assert ties == [("r1", "qa::1", "qa"), ("r1", "qa::1", "relation"), ("r1", "qa::2", "qa"), ("r1", "r", "relation"), ("r2", "r", "relation")]
    priors = {r["relation_id"]: r["source_prior"] for r in ev.source_priors(relations, df).collect()}
    assert priors == {"r1": 0.65, "r2": 0.65}
    facts = spark.createDataFrame([("q", "r1", "one"), ("q", "r2", "two")], "query_id string, relation_id string, fact string")
    assert {r["evidence_id"]: r["facts"] for r in ev.facts_of(df, facts).collect()} == {"qa::1": ["one"], "r": ["one", "two"]}


def test_reports_and_joined_texts(spark):
    from evidara.operators import analysis as an, evidence as ev

    ents = spark.createDataFrame([("Test", "low", 0.4), ("Test", "high", 0.9), ("Symptom", None, None)], "entity_type string, quality string, avg_confidence double")
    ments = spark.createDataFrame([("c1", "m", 0.1), ("c1", None, 0.9), ("c2", "m", None)], "chunk_id string, model string, confidence double")
    errs = spark.createDataFrame([("c1", "error", "x"), ("c3", "error", "y"), ("c1", "warning", "Rejected entity: generic"), ("c1", "warning", "Rejected accidental entity type: Other")], "chunk_id string, severity string, error string")
    got = {(r["part"], r["label"]): r["n"] for r in ev.extraction_report(ents, ments, errs).collect()}
    assert got == {
        ("entity_type", "Test"): 2, ("entity_type", "Symptom"): 1, ("quality", "low"): 1, ("quality", "high"): 1, ("quality", "unknown"): 1, ("entities", "not_actionable"): 1, ("entities", "low_confidence"): 2, ("mentions", "low_confidence"): 2,
        ("model", "m"): 2, ("model", "unknown"): 1, ("chunks", "with_entities"): 2, ("severity", "error"): 2, ("severity", "warning"): 2, ("chunks", "failed"): 2, ("rejected", "entity"): 1, ("rejected", "accidental entity type"): 1,
    }
    rows = spark.createDataFrame([("a", " x ", 2), ("a", "y", 1), ("a", "x", 3), ("a", " ", 0), ("b", None, 1)], "k string, v string, o int")
    assert [tuple(r) for r in ev.joined_once(rows, ["k"], "v", "o").collect()] == [("a", "y\nx")]
    assert {tuple(r) for r in ev.most_frequent(rows, "k", "v", "o").collect()} >= {("b", None)}
    lists = spark.createDataFrame([(["a", "", "b"], None, ["b", "c", None])], "x array<string>, y array<string>, z array<string>")
    assert lists.select(an.ordered_union(F.col("x"), F.col("y"), F.col("z"))).first()[0] == ["a", "b", "c"]


def test_optional_metrics():
    import numpy as np

    assert mt.metric_status("no_such_package", True)["status"] == "unavailable" and mt.metric_status("json", True)["status"] == "not_run"
    assert mt.text_similarity("a b", "b c")["status"] == "unavailable"
    same = lambda p, r: np.array([[float(x == y) for y in r] for x in p])
    assert mt.text_similarity("a b", "b c", same) == {"status": "computed", "precision": 0.5, "recall": 0.5, "f1": 0.5}




def test_block_max_equals_bm25(spark):
    """The blocked search gives the rows of the plain one at any k and block size, and reads fewer postings for fewer results."""
    import random

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rnd.choices(words[i // 20 * 6 : i // 20 * 6 + 8] + ["the"], k=rnd.randrange(0, 12))), rnd.choice([None, "", "the cause", "w3 w3"]), rnd.choice(["a", None])) for i in range(200)]
    docs += [(200, docs[7][1], docs[7][2], docs[7][3]), (201, None, None, None)]
    df = spark.createDataFrame(docs, "qa_id long, question string, answer string, category string").repartition(3)
    asked = [(f"q{i}", t) for i in range(25) for t in {*rnd.sample(words, 3), *(["the"] if i % 2 else [])}] + [("none", "unheard"), ("common", "the")]
    queries = spark.createDataFrame(asked, "query_id string, term string")
    rows, stats = se.postings(df, "qa_id")
    columns = ["query_id", "qa_id", "bm25", "position"]
    shares = {}
    for size in (5, 64):
        blocks, same = se.blocked(df, "qa_id", size=size)
        for k in (1, 10, 300):
            shares[size, k] = {}
            plain = {tuple(r) for r in se.bm25(rows, stats, queries, "qa_id", k).select(columns).collect()}
            found = {tuple(r) for r in se.block_max(blocks, same, queries, "qa_id", k, shares[size, k], size).select(columns).collect()}
            assert found == plain
    assert shares[5, 1]["read"] < shares[5, 10]["read"] <= shares[5, 300]["read"] == shares[5, 300]["of"] and shares[5, 1]["read"] < 0.6 * shares[5, 1]["of"]
    assert blocks.filter("n > 64").isEmpty()  # no block holds a common term's whole list
    assert se.block_max(blocks, same, queries.limit(0), "qa_id", 3).collect() == []
    none, empty = se.blocked(df.limit(0), "qa_id")
    assert se.block_max(none, empty, queries, "qa_id", 3).collect() == []


def test_block_max_over_several_tiles_and_slices(spark, monkeypatch):
    """Queries in slices against tiles of documents give the plain search's rows, ties to smaller keys among copies too."""
    import random

    rnd = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = [(1000 - i, " ".join(rnd.choices(words, k=rnd.randrange(1, 9))), "w1 w2", "a") for i in range(90)] + [(i, "w1 w2 w3", "w1 w2", "a") for i in range(40)]
    df = spark.createDataFrame(docs, "qa_id long, question string, answer string, category string")
    queries = spark.createDataFrame([(i, w) for i in range(30) for w in rnd.sample(words, 4)], "query_id long, term string")
    monkeypatch.setattr(se, "TILE_DOCS", 32)
    monkeypatch.setattr(se, "LEAST_QUERIES", 10)
    rows, stats = se.postings(df, "qa_id")
    blocks, same = se.blocked(df, "qa_id", size=8)
    for k in (3, 50):
        plain = {tuple(r) for r in se.bm25(rows, stats, queries, "qa_id", k).collect()}
        report = {}
        assert {tuple(r) for r in se.block_max(blocks, same, queries, "qa_id", k, report, 8).collect()} == plain
        assert 0 < report["read"] <= report["of"]


def test_search_deals_out_numbers(spark):
    """What tiles and slices are sent has no term's text and no posting as a row of its own; texts of terms do not matter to what is sent for a query."""
    df = spark.createDataFrame([(1, "w1 w2", "w3", "a")], "qa_id long, question string, answer string, category string")
    out = se.block_max(*se.blocked(df, "qa_id"), spark.createDataFrame([(1, "w1")], "query_id long, term string"), "qa_id", 3)
    line = next(x for x in out._jdf.queryExecution().analyzed().toString().splitlines() if "FlatMapCoGroupsInArrow" in x)
    sent = re.findall(r"\b(\w+)#\d+", line)
    assert "keys" in sent and "weights" in sent and "postings" not in sent
    assert [r["qa_id"] for r in out.collect()] == [1]


def test_merge_entities_takes_name_and_type_of_one_first_mention(spark):
    """Mentions of one ordinal: the file's first names the entity, whatever order tasks see them in."""
    schema = "entity_id string, ordinal long, canonical_name string, entity_type string, quality string, actionable boolean, alias string, chunk_id long, qa_id long, model string, confidence double, record long"
    rows = [("e", 5, f"name{i:02d}", f"type{i:02d}", "high", True, "a", 1, 1, "m", 0.5, i) for i in range(40)]
    got = gr.merge_entities(spark.createDataFrame(rows[::-1], schema).repartition(8), ("record",)).first()
    assert (got["canonical_name"], got["entity_type"]) == ("name00", "type00")


def test_holdout_check_normalises_documents_once(spark):
    """The keys of documents are kept for the checks: what is left of the plan reads them, as hashes."""
    from evidara import catalogue

    df = catalogue.QUERIES["holdout_overlap_check"](spark, "/root/testdata/sf0.001")
    assert "documents.parquet" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df._jdf.queryExecution().toString().count("\\ufeff") <= 1 and df.count() == 3


def test_hints_find_words_before_their_edges(spark):
    from evidara.operators import corpus

    rows = spark.createDataFrame([(1, "in"), (2, "inn bin _in in_"), (3, "binin in."), (4, "in the"), (5, "inin,in"), (6, "éin")], "k int, t string")
    found = corpus.detect_hints(rows, "k", F.col("t"), [("p", "x", ["in", "in the"])])
    assert {(r["k"], r["matched_variant"]) for r in found.collect()} == {(1, "in"), (3, "in"), (4, "in the"), (5, "in")}
    assert "\\Qin\\E(?!" in found._jdf.queryExecution().toString()


def test_single_phrases_are_not_folded(spark):
    """Phrases of many queries go to Python in batches, not as a group for each query; the result is that of the fold."""
    rows = [(1, "abc", "Test", "corrected_query"), (2, "b", "Test", "reformulated_query"), (2, "bcd", "Test", "corrected_query"), (2, "bcdef", "Symptom", "reformulated_query"), (2, "bcdefg", "Symptom", "reformulated_query"), (3, "", "Test", "corrected_query"), (3, None, "Test", "x"), (4, "q", None, "x"), (4, "q", None, "y")]
    found = er.distinct_phrases(spark.createDataFrame(rows, "query_id int, norm string, entity_type string, source string"))
    assert sorted(tuple(r)[:2] for r in found.collect()) == [(1, "abc"), (2, "bcd"), (2, "bcdefg"), (4, "q")]
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()


def test_a_segment_that_is_its_whole_text_stands_once(spark):
    df = spark.createDataFrame([(1, ["rest lowers fever", "rest lowers fever"]), (2, ["لا يفيد السكر"]), (3, ["يفيد الماء."]), (4, ["no. no"])], "id int, texts array<string>")
    got = sorted(((r["id"], r["segment"], r["only"], r["negated"]) for r in cl.segments(df, ["id"]).collect()), key=str)
    assert got == [(1, "rest lowers fever", None, False), (2, "لا يفيد السكر", None, True), (3, "يفيد الماء", None, False), (3, "يفيد الماء.", False, False), (4, "no. no", None, False)]


def test_features_come_before_citations(spark):
    """Claims may bring features worked out before they were repeated for each citation; the query for claims does that, and shuffles no pairs of claims and segments by claim alone."""
    rows = [("a", "rest lowers fever", "fever rest"), ("b", "لا يفيد السكر ابدا", "هل يفيد السكر"), ("c", "take 3 pills daily", "how many pills")]
    claims = spark.createDataFrame([(*r, "none", "q", e) for r in rows for e in ("E1", "E2")], "claim_id string, claim string, query string, primary_intent string, query_id string, evidence_id string")
    evidence = spark.createDataFrame(
        [("q", "E1", ["rest lowers fever quickly! take 3 pills"], 0.9, 0.9, 0.9, None, 1.0), ("q", "E2", ["يفيد السكر. لا يفيد السكر"], 0.5, 0.9, 0.9, 0.6, 1.0)],
        "query_id string, evidence_id string, texts array<string>, answer_relevance double, entity_identity double, vector_similarity double, intent_support double, cited_coverage double",
    )
    ready = cl.query_features(cl.claim_features(claims)).drop("claim", "query")
    got, plain = (sorted(cl.verify(c, evidence, ["query_id", "evidence_id"]).collect()) for c in (ready, claims))
    assert got == plain and [(r["claim_id"], r["best_evidence_id"]) for r in got] == [("a", "E1"), ("b", "E2"), ("c", "E1")]
    plan = cl.verify(ready, evidence, ["query_id", "evidence_id"])._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line and "claim_id" in line and "evidence_id" in line]
