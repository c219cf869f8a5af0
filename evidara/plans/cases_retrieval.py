"""Queries on retrieval, reranking, context and claims. Asked are the questions of all conversations; the corpus are all question-answer pairs. Vector queries are the rows whose id is divisible by 100."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import records as rec, similarity as sim, terms as tm, text as tx
from ..operators import claims as cl, context as ctx, corpus, rerank as rr, search as se, vector_index as vi
from ..operators import linking as li
from ..sources.stages import shared_folder
from .registry import QA_PAIRS, case, s_index_tokens, s_list, s_match, s_tokens, table

def asked(spark, d):
    return qas(spark, d).select(F.col("qa_id").alias("query_id"), F.col("question").alias("query"))


def qas(spark, d):
    return corpus.qa_pairs(table(spark, d, "conversations")).withColumn("category", F.lit("chat"))


def _t(c: str) -> str:
    return s_tokens(s_match(c))


_STOP = s_list(tm.QUERY_STOPWORDS)
S_BM25 = f"""{QA_PAIRS},
ask AS (SELECT qa_id AS query_id, question AS query, list_filter({_t('question')}, lambda x: length(x) >= 2 AND NOT list_contains({_STOP}, x)) AS own FROM qa),
e0 AS (SELECT query_id, unnest(own) AS term, unnest(range(len(own))) AS pos FROM ask),
e1 AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS n FROM e0 GROUP BY query_id, term),
qt AS (SELECT query_id, list(term) AS terms FROM e1 WHERE n <= 24 GROUP BY 1),
it AS (SELECT DISTINCT query_id, unnest({s_index_tokens('term')}) AS term FROM e1 WHERE n <= 24),
f0 AS (SELECT qa_id, 3.0::DOUBLE AS w, unnest({s_index_tokens('question')}) AS term FROM qa UNION ALL SELECT qa_id, 1.0, unnest({s_index_tokens('answer')}) FROM qa UNION ALL SELECT qa_id, 0.3, 'chat' FROM qa),
dl AS (SELECT qa_id, count(*) AS dlen FROM f0 GROUP BY 1), st AS (SELECT count(*) AS nd, avg(dlen) AS al FROM dl),
p AS (SELECT term, qa_id, sum(w) AS f FROM f0 GROUP BY ALL), df AS (SELECT term, count(*) AS n FROM p GROUP BY 1),
sc AS (SELECT query_id, p.qa_id, round(sum((CASE WHEN ln((nd - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((nd - n + 0.5) / (n + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dlen / al))), 9) AS bm25
    FROM it JOIN p USING (term) JOIN df USING (term) JOIN dl ON dl.qa_id = p.qa_id, st GROUP BY ALL),
short AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, qa_id) AS position FROM sc QUALIFY position <= 80),
lx AS (SELECT s.*, terms, list_distinct({_t('question')}) AS toks FROM short s JOIN qt USING (query_id) JOIN qa USING (qa_id)),
ly AS (SELECT *, len(list_intersect(terms, toks)) AS b FROM lx),
lz AS (SELECT *, CASE WHEN len(terms) > 0 AND len(toks) > 0 THEN least(1.0::DOUBLE, 0.45::DOUBLE + 0.30::DOUBLE * (b / len(terms)) + 0.15::DOUBLE * (CASE WHEN b > 0 THEN 2 * (b / len(toks)) * (b / len(terms)) / ((b / len(toks)) + (b / len(terms))) ELSE 0 END)
    + 0.10::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + 0.08::DOUBLE * greatest(0, position - 1)))) ELSE 0 END AS score FROM ly),
found AS (SELECT query_id, qa_id, position::INT AS position, bm25, score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, position))::INT AS rank FROM lz QUALIFY rank <= 8)"""


@case("bm25_topk", f"WITH {S_BM25} SELECT query_id, qa_id, round(bm25, 6) AS bm25, position::INT AS position FROM short")
def bm25_topk(spark, d):
    index, stats = se.blocked(qas(spark, d), "qa_id")
    terms = asked(spark, d).select("query_id", tm.search_terms(F.col("query")).alias("t"))
    terms = terms.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform("t", tx.index_tokens)))).alias("term"))
    return se.block_max(index, stats, terms, "qa_id", se.SHORTLIST).withColumn("bm25", F.round("bm25", 6))


@case("qa_search", f"WITH {S_BM25} SELECT query_id, qa_id, position, round(bm25, 6) AS bm25, round(score, 6) AS score, rank FROM found")
def qa_search(spark, d):
    return se.search_qa(qas(spark, d), asked(spark, d)).withColumns({"bm25": F.round("bm25", 6), "score": F.round("score", 6)})


_S_VEC = "list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


def _vec(spark, d):
    v = table(spark, d, "embeddings")
    return v, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@case("vector_topk", f"SELECT q.vec_id AS query_id, v.vec_id, round((1 + {_S_VEC}) / 2, 6) AS score, (row_number() OVER (PARTITION BY q.vec_id ORDER BY round((1 + {_S_VEC}) / 2, 9) DESC, v.vec_id))::INT AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10")
def vector_topk(spark, d):
    v, q = _vec(spark, d)
    return se.vector_top_k(v.select("vec_id", "embedding"), q, 10).withColumn("score", F.round("score", 6))


@case(
    "vector_overfetch_filter",
    f"""WITH a AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round((1 + {_S_VEC}) / 2, 9) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round((1 + {_S_VEC}) / 2, 9) DESC, v.vec_id) AS r FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
    SELECT query_id, vec_id, round(s, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY r))::INT AS rank FROM a WHERE r <= 30 AND label % 2 = 0 QUALIFY rank <= 10""",
)
def vector_overfetch_filter(spark, d):
    """Three times as many as wanted, then a filter, then the limit: fewer than wanted may be left."""
    from pyspark.sql.window import Window

    v, q = _vec(spark, d)
    wide = se.vector_top_k(v.select("vec_id", "label", "embedding"), q, 30).filter("label % 2 = 0")
    order = Window.partitionBy("query_id").orderBy("rank")
    return wide.withColumn("n", F.row_number().over(order)).filter("n <= 10").select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("n").alias("rank"))


@case(
    "vector_channels_union",
    f"""WITH a AS (SELECT q.vec_id AS query_id, v.vec_id, v.label % 3 AS channel, round((1 + {_S_VEC}) / 2, 9) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY s DESC, vec_id) AS r FROM a)
    SELECT query_id, channel::INT AS channel, vec_id, r::INT AS rank, quality FROM k LEFT JOIN labels ON doc_id = vec_id WHERE r <= CASE channel WHEN 2 THEN 5 ELSE 10 END""",
)
def vector_channels_union(spark, d):
    v, q = _vec(spark, d)
    parts = [se.vector_top_k(v.filter(F.col("label") % 3 == c).select("vec_id", "embedding"), q, 5 if c == 2 else 10).withColumn("channel", F.lit(c)) for c in range(3)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.join(table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), "quality"), "vec_id", "left").select("query_id", "channel", "vec_id", "rank", "quality")


def _stored_index(spark, d):
    """An index of all vectors: built from the rows of one parity of label, those of the other appended."""
    path, v = f"{shared_folder(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}", table(spark, d, "embeddings")
    first = F.coalesce(F.col("label") % 2 == 0, F.lit(True))
    vi.build(v.filter(first), path, "v1", 64)
    return path, vi.append(v.filter(~first), path, "v1")


@case("vector_index_topk")
def vector_index_topk(spark, d):
    """The ten nearest rows found by the stored index; tests hold its recall against vector_topk."""
    path, _ = _stored_index(spark, d)
    return vi.search(spark, path, "v1", _vec(spark, d)[1], 10).withColumn("score", F.round("score", 6))


@case("vector_index_exact", f"SELECT q.vec_id AS query_id, v.vec_id, round((1 + {_S_VEC}) / 2, 6) AS score, (row_number() OVER (PARTITION BY q.vec_id ORDER BY round((1 + {_S_VEC}) / 2, 9) DESC, v.vec_id))::INT AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 QUALIFY rank <= 25")
def vector_index_exact(spark, d):
    """The exact way over the stored index' rows: every row is there once, with its own vector."""
    path, _ = _stored_index(spark, d)
    return vi.search(spark, path, "v1", _vec(spark, d)[1], 25, exact=True).withColumn("score", F.round("score", 6))


@case(
    "embedding_validation",
    "SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE embedding IS NULL)::BIGINT AS missing, count(*) FILTER (WHERE len(embedding) <> 64)::BIGINT AS bad_dimension, count(*) FILTER (WHERE abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 1e-3)::BIGINT AS not_unit, count(*) FILTER (WHERE label IS NULL)::BIGINT AS no_label FROM embeddings",
)
def embedding_validation(spark, d):
    v = table(spark, d, "embeddings")
    norm = F.sqrt(sim.dot(F.col("embedding"), F.col("embedding")))
    return v.agg(F.count("*").alias("total"), F.count_if(F.col("embedding").isNull()).alias("missing"), F.count_if(F.size("embedding") != 64).alias("bad_dimension"), F.count_if(F.abs(norm - 1) > 1e-3).alias("not_unit"), F.count_if(F.col("label").isNull()).alias("no_label"))


@case(
    "embedding_stale",
    "WITH n AS (SELECT doc_id, sha256('passage: ' || trim(text) || ' ' || source) AS h FROM documents), o AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE h END AS h, CASE WHEN doc_id % 7 = 0 THEN 32 ELSE 64 END AS dim FROM n WHERE doc_id % 5 <> 0) SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'missing' WHEN o.h <> n.h THEN 'text' ELSE 'dimension' END AS why FROM n LEFT JOIN o USING (doc_id) WHERE o.doc_id IS NULL OR o.h <> n.h OR o.dim <> 64",
)
def embedding_stale(spark, d):
    """Documents whose stored vector is missing or was made from another text or dimension."""
    now = table(spark, d, "documents").select("doc_id", F.sha2(rec.passage(F.col("text"), F.col("source")).cast("binary"), 256).alias("h"))
    old = now.filter("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("h")).alias("old_h"), F.when(F.col("doc_id") % 7 == 0, 32).otherwise(64).alias("dim"), F.lit(True).alias("there"))
    why = F.when(F.col("there").isNull(), "missing").when(F.col("old_h") != F.col("h"), "text").when(F.col("dim") != 64, "dimension")
    return now.join(old, "doc_id", "left").select("doc_id", why.alias("why")).filter("why IS NOT NULL")


# The evidence of each query: what the search found, as passages of answers.
def evidence(spark, d):
    found = se.search_qa(qas(spark, d), asked(spark, d))
    rows = found.join(qas(spark, d), "qa_id").join(asked(spark, d), "query_id")
    return rows.select(
        "query_id", F.col("query").alias("original_query"), "query", F.lit("general_medical_advice").alias("primary_intent"), F.concat(F.lit("qa::"), F.col("qa_id").cast("string")).alias("evidence_id"), "qa_id", "question",
        F.col("answer").alias("text"), "answer", F.lit("ahd_heldout_safe_corpus").alias("source_quality"), F.round("score", 6).alias("score"), F.lit(0.0).alias("relation_support"), F.lit(0.0).alias("qa_support"),
        (F.col("qa_id") % 10 / 10.0).alias("vector_similarity"), "position",
    )


def _ident(tokens: str) -> str:
    strip = "CASE WHEN starts_with(t, 'بال') AND length(t) > 4 THEN t[4:] WHEN starts_with(t, 'كال') AND length(t) > 4 THEN t[4:] WHEN starts_with(t, 'لل') AND length(t) > 3 THEN t[3:] WHEN starts_with(t, 'ال') AND length(t) > 3 THEN t[3:] ELSE t END"
    return f"list_distinct(list_filter(list_transform(list_filter({tokens}, lambda t: length(t) > 1), lambda t: {strip}), lambda t: NOT list_contains({s_list(tm.IDENTITY_STOPWORDS)}, t) AND length(t) > 2 AND NOT regexp_matches(t, '\\p{{Nd}}')))"


def _share(part: str, whole: str) -> str:
    return f"(CASE WHEN len({part}) > 0 AND len({whole}) > 0 THEN len(list_intersect({part}, {whole})) / len({whole}) ELSE 0.0::DOUBLE END)"


def _simil(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE WHEN len(list_intersect({a}, {b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) ELSE 0.0::DOUBLE END)"


_NUM = "list_distinct(regexp_extract_all({c}, '[0-9]+(?:[.,][0-9]+)?'))"
# Latin texts name no anatomy and no constraint but numbers.
S_EVIDENCE = f"""{S_BM25},
ev AS (SELECT f.query_id, query, 'qa::' || qa_id AS evidence_id, qa_id, question, answer AS text, answer, round(score, 6) AS score, (qa_id % 10) / 10.0::DOUBLE AS vec, list_distinct({_t('query')}) AS q, list_distinct({_t('question')}) AS s,
    list_distinct({_t("(answer || ' ' || answer)")}) AS p, list_distinct({_t("(question || ' ' || answer || ' ' || answer)")}) AS c, {_NUM.format(c='query')} AS qn, {_NUM.format(c="(question || ' ' || answer || ' ' || answer)")} AS cn FROM found f JOIN ask USING (query_id) JOIN qa USING (qa_id)),
ei AS (SELECT *, {_ident('q')} AS qi, {_ident('s')} AS si, {_ident('c')} AS ci FROM ev),
ec AS (SELECT *, list_intersect(qi, ci) AS hit, len(qi) AS n, len(ci) AS m FROM ei),
ef AS (SELECT *, CASE WHEN n > 0 THEN round(len(hit) / n, 6) ELSE 1.0 END AS coverage, CASE WHEN m > 0 THEN round(len(hit) / m, 6) ELSE 0.0 END AS precision, CASE WHEN len(qn) > 0 THEN round(len(list_intersect(qn, cn)) / len(qn), 6) ELSE 1.0 END AS cons,
    n > 0 AND m > 0 AND len(hit) = 0 AND vec < 0.90 AS unrelated, CASE WHEN n > 0 THEN 1.0::DOUBLE / n ELSE 0.0 END AS cfloor, {_share('s', 'q')} AS qr, {_share('p', 'q')} AS pr, {_simil('qi', 'si')} AS ident, n > 0 AND m = 0 AS generic FROM ec),
eg AS (SELECT *, greatest(qr, pr, ident) AS anchor, qr >= 0.98 OR (qr >= 0.85 AND vec >= 0.90) AS direct FROM ef),
eh AS (SELECT *, vec >= 0.84 AND anchor >= 0.10 AND (cfloor = 0 OR coverage >= cfloor) AND NOT unrelated AS strong FROM eg),
ej AS (SELECT *, greatest(0.25::DOUBLE * qr + 0.25::DOUBLE * ident + 0.30::DOUBLE * coverage + 0.15::DOUBLE * 0.5::DOUBLE + 0.05::DOUBLE * cons - CASE WHEN unrelated THEN 0.30 ELSE 0.0 END - CASE WHEN generic THEN 0.10 ELSE 0.0 END,
    CASE WHEN strong THEN 0.55::DOUBLE * vec + 0.25::DOUBLE * anchor + 0.20::DOUBLE * 0.5::DOUBLE ELSE -9 END, CASE WHEN direct THEN 0.55::DOUBLE * qr + 0.25::DOUBLE * vec + 0.20::DOUBLE * 0.5::DOUBLE ELSE -9 END) AS ar FROM eh),
ek AS (SELECT *, 0.10::DOUBLE * score + 0.24::DOUBLE * greatest(0.0, ar) + 0.12::DOUBLE * (0.75::DOUBLE * qr + 0.25::DOUBLE * pr) + 0.20::DOUBLE * coverage + 0.08::DOUBLE * cons + 0.10::DOUBLE * 0.95::DOUBLE + 0.06::DOUBLE * 0.5::DOUBLE + 0.05::DOUBLE
    - CASE WHEN qr < 0.05 AND pr > 0 THEN 0.15 ELSE 0.0 END - CASE WHEN cfloor > 0 AND coverage < cfloor AND NOT direct THEN 0.20 ELSE 0.0 END - CASE WHEN unrelated THEN 0.30 ELSE 0.0 END - CASE WHEN generic THEN 0.10 ELSE 0.0 END AS raw FROM ej),
er AS (SELECT *, round(least(1.0, greatest(0.0, ar)), 6) AS answer_relevance, round(least(1.0, greatest(0.0, raw)), 6) AS final_score FROM ek)"""


def _reranked(spark, d):
    return rr.rerank_evidence(evidence(spark, d))


@case(
    "evidence_rerank",
    f"WITH {S_EVIDENCE} SELECT query_id, evidence_id, answer_relevance, final_score, coverage, round(qr, 6) AS question_relevance, strong AS strong_semantic, direct AS direct_anchor, (row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, evidence_id))::INT AS rank FROM er QUALIFY rank <= 12",
)
def evidence_rerank(spark, d):
    return _reranked(spark, d).select("query_id", "evidence_id", "answer_relevance", "final_score", "coverage", F.round("question_relevance", 6).alias("question_relevance"), "strong_semantic", "direct_anchor", "rank")


@case("relevance_features", f"WITH {S_EVIDENCE} SELECT query_id, evidence_id, n::INT AS n_concepts, m::INT AS n_candidate_concepts, coverage, precision, cons AS constraint_coverage, unrelated, round(cfloor, 6) AS concept_floor FROM er")
def relevance_features(spark, d):
    return _reranked(spark, d).select("query_id", "evidence_id", "n_concepts", "n_candidate_concepts", "coverage", "precision", "constraint_coverage", "unrelated", F.round("concept_floor", 6).alias("concept_floor"))


def _gated(spark, d):
    rows = _reranked(spark, d).withColumns({"origin": F.lit("answer"), "source_reliability": rec.source_prior(F.col("source_quality"))})
    return ctx.gate_reasons(rows)


@case(
    "context_gate",
    f"""WITH {S_EVIDENCE}, g AS (SELECT *, direct AND qr >= 0.85 AS anc, strong AND NOT unrelated AS sem FROM er)
    SELECT query_id, evidence_id, CASE WHEN unrelated AND NOT anc THEN 'unrelated' WHEN answer_relevance < 0.35 AND NOT anc AND NOT sem THEN 'answer_relevance' WHEN final_score < 0.40 AND NOT anc AND NOT sem THEN 'score'
    WHEN cfloor > 0 AND coverage < cfloor AND NOT anc THEN 'coverage' END AS gate FROM g""",
)
def context_gate(spark, d):
    return _gated(spark, d).select("query_id", "evidence_id", "gate")


@case("context_select")
def context_select(spark, d):
    return ctx.display_ids(ctx.select_context(_gated(spark, d)), "E")


@case(
    "generation_mode",
    f"""WITH {S_EVIDENCE}, k AS (SELECT query_id, evidence_id, answer_relevance >= 0.75 AND 0.75 <= 0.75 AND coverage >= 0.75 AND cons >= 1.0 AND NOT unrelated AND (direct OR ident >= 0.5) AS ok, direct, answer_relevance, coverage, ident, final_score FROM er WHERE text <> '')
    SELECT query_id, CASE WHEN bool_or(ok) THEN 'strong_direct_evidence' ELSE 'partial_or_mixed_evidence' END AS mode, max_by(evidence_id, (direct, answer_relevance, coverage, ident, final_score, evidence_id)) FILTER (WHERE ok) AS evidence_id FROM k GROUP BY 1""",
)
def generation_mode(spark, d):
    rows = _reranked(spark, d).withColumns({"evidence": F.col("text"), "origin": F.lit("answer"), "source_reliability": rec.source_prior(F.col("source_quality")), "intent": F.lit(0.75)})
    return cl.generation_mode(rows)


@case(
    "evidence_dedup",
    f"""WITH {S_BM25}, c AS (SELECT f.query_id, 0 AS channel, position AS ordinal, qa_id, round(score, 6) AS score, question, answer FROM found f JOIN qa USING (qa_id) UNION ALL
        SELECT s.query_id, 1, position, qa_id, round(0.5 / position, 6), question, CASE WHEN qa_id % 2 = 0 THEN answer ELSE '' END FROM short s JOIN qa USING (qa_id) WHERE position <= 20),
    n AS (SELECT *, {s_match('question')} AS qn, {s_match('answer')} AS an FROM c), k AS (SELECT *, CASE WHEN qn <> '' AND an <> '' THEN 'qa' || chr(1) || qn || chr(1) || an ELSE 'text' || chr(1) || qa_id || chr(1) || an END AS key FROM n),
    u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, channel, ordinal) = 1)
    SELECT query_id, channel, qa_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, channel, ordinal))::INT AS rank FROM u QUALIFY rank <= 24""",
)
def evidence_dedup(spark, d):
    q = qas(spark, d)
    found = se.search_qa(q, asked(spark, d)).join(q, "qa_id").select("query_id", F.lit(0).alias("channel"), F.col("position").alias("ordinal"), "qa_id", F.round("score", 6).alias("score"), "question", "answer")
    index, stats = se.blocked(q, "qa_id")
    terms = asked(spark, d).select("query_id", tm.search_terms(F.col("query")).alias("t"))
    terms = terms.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform("t", tx.index_tokens)))).alias("term"))
    other = se.block_max(index, stats, terms, "qa_id", 20).join(q, "qa_id")
    other = other.select("query_id", F.lit(1).alias("channel"), F.col("position").alias("ordinal"), "qa_id", F.round(0.5 / F.col("position"), 6).alias("score"), "question", F.when(F.col("qa_id") % 2 == 0, F.col("answer")).otherwise("").alias("answer"))
    both = found.unionByName(other).withColumn("text", F.col("answer"))
    return rr.distinct_evidence(both).select("query_id", "channel", "qa_id", "score", "rank")


_R_SQL = f"""r AS (SELECT l_orderkey * 10 + l_linenumber AS relation_id, l_partkey AS source_relation_id, l_discount * 10 AS confidence, CASE l_linenumber % 2 WHEN 0 THEN 'TREATED_BY' ELSE 'HAS_SYMPTOM' END AS relation_type, l_tax AS semantic,
    CASE WHEN l_suppkey % 3 = 0 THEN 0.95::DOUBLE ELSE 0.5::DOUBLE END AS seed, p_name AS source_name, p_brand AS target_name, p_type AS evidence, CASE WHEN l_linenumber < 3 THEN 'direct' ELSE 'inverse' END AS direction, p_size < 5 AS generic_seed, p_size > 48 AS type_conflict
    FROM lineitem JOIN part ON p_partkey = l_partkey),
rt AS (SELECT *, ['blue', 'small', 'tin', 'brand'] AS q, list_distinct({_t('source_name')}) AS st, list_distinct({_t('target_name')}) AS tt, list_distinct({_t('evidence')}) AS et FROM r),
rf AS (SELECT *, seed >= 0.9 AS hard, greatest({_simil("['blue', 'small', 'tin', 'brand']", _ident('st'))}, {_simil("['blue', 'small', 'tin', 'brand']", _ident('tt'))}) AS mi, greatest({_share('st', 'q')}, {_share('tt', 'q')}) AS no, {_share('et', 'q')} AS er FROM rt),
rp AS (SELECT *, CASE WHEN relation_type = 'TREATED_BY' THEN 1.0::DOUBLE ELSE 0.15::DOUBLE END AS intent, CASE WHEN hard THEN 1.0::DOUBLE ELSE 0.30::DOUBLE END AS ids,
    0.0::DOUBLE + CASE WHEN generic_seed THEN 0.22::DOUBLE ELSE 0.0 END + CASE WHEN type_conflict THEN 0.25::DOUBLE ELSE 0.0 END + CASE WHEN NOT hard AND mi < 0.86 THEN 0.25::DOUBLE ELSE 0.0 END AS pen FROM rf WHERE hard OR NOT (generic_seed OR type_conflict)),
rs AS (SELECT *, round(least(1.0, greatest(0.0, 0.12::DOUBLE * confidence + 0.30::DOUBLE * ids + 0.10::DOUBLE * intent + 0.10::DOUBLE * semantic + 0.20::DOUBLE * er + 0.12::DOUBLE * greatest(no, mi) + CASE WHEN direction = 'direct' THEN 0.03::DOUBLE ELSE 0.0 END - pen)), 6) AS hybrid_score FROM rp),
rb AS (SELECT * FROM rs QUALIFY row_number() OVER (PARTITION BY source_relation_id ORDER BY hybrid_score DESC, relation_id) = 1)"""


def _relations(spark, d):
    """All lines as relations of their part; the words of a part's texts are worked out once for each part."""
    parts = table(spark, d, "part").select("p_partkey", "p_size", F.col("p_type").alias("evidence"), F.col("p_name").alias("source_name"), F.col("p_brand").alias("target_name"))
    rows = table(spark, d, "lineitem").join(rr.relation_tokens(parts), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber")
    return rr.score_relations(rows.select(
        F.lit(1).alias("query_id"), F.lit("blue small tin brand").alias("query"), (F.col("l_orderkey") * 10 + n).alias("relation_id"), F.col("l_partkey").alias("source_relation_id"), (F.col("l_discount") * 10).alias("confidence"),
        F.when(n % 2 == 0, "TREATED_BY").otherwise("HAS_SYMPTOM").alias("relation_type"), F.array(F.lit("TREATED_BY")).alias("preferred"), F.col("l_tax").alias("semantic"), F.when(F.col("l_suppkey") % 3 == 0, 0.95).otherwise(0.5).alias("seed_score"),
        "evidence", "source_name", "target_name", *rr.RELATION_TOKENS, F.when(n < 3, "direct").otherwise("inverse").alias("direction"), (F.col("p_size") < 5).alias("generic_seed"), (F.col("p_size") > 48).alias("type_conflict"),
    ))


@case("relation_hybrid_score", f"WITH {_R_SQL} SELECT source_relation_id, relation_id, hybrid_score, round(mi, 6) AS medical_identity, round(pen, 6) AS total_penalty FROM rb")
def relation_hybrid_score(spark, d):
    return _relations(spark, d).select("source_relation_id", "relation_id", "hybrid_score", F.round("medical_identity", 6).alias("medical_identity"), F.round("total_penalty", 6).alias("total_penalty"))


@case(
    "relation_rerank",
    f"""WITH {_R_SQL}, c AS (SELECT *, {_ident(f"list_distinct({_t(chr(40) + 'source_name || chr(32) || target_name || chr(32) || evidence' + chr(41))})")} AS ci, list_distinct({_t("(source_name || ' ' || target_name)")}) AS nt FROM rb),
    f AS (SELECT *, round(len(list_intersect(['blue', 'small', 'tin', 'brand'], ci)) / 4, 6) AS coverage, greatest(er, {_share('et', 'q')}, {_share('nt', 'q')}) AS sup, len(ci) > 0 AND len(list_intersect(['blue', 'small', 'tin', 'brand'], ci)) = 0 AND semantic < 0.9 AS unrelated FROM c),
    z AS (SELECT *, round(least(1.0, greatest(0.0, 0.18::DOUBLE * hybrid_score + 0.03::DOUBLE * confidence + 0.07::DOUBLE * semantic + 0.12::DOUBLE * sup + 0.18::DOUBLE * ids + 0.22::DOUBLE * coverage + 0.08::DOUBLE + 0.06::DOUBLE * 0.65::DOUBLE + 0.06::DOUBLE * intent - 0.35::DOUBLE * pen
        - CASE WHEN coverage < 0.25 THEN 0.25::DOUBLE ELSE 0.0 END - CASE WHEN unrelated THEN 0.35::DOUBLE ELSE 0.0 END)), 6) AS rerank_score FROM f)
    SELECT relation_id, rerank_score, (row_number() OVER (ORDER BY rerank_score DESC, relation_id))::INT AS rank FROM z QUALIFY rank <= 12""",
)
def relation_rerank(spark, d):
    rows = _relations(spark, d).withColumns({"candidate": F.concat_ws(" ", "source_name", "target_name", "evidence"), "source_prior": F.lit(0.65), "vector_similarity": F.col("semantic")}).drop("anatomy_mismatch")
    return rr.rerank_relations(rows).select("relation_id", "rerank_score", "rank")


_ASKS = ((1, "ما علاج الصداع منذ يومين", "simple_medical", "low", 1), (2, "هل الدواء بسبب الحساسيه", "complex_medical", "high", 2), (3, "حاله الطقس اليوم", "non_medical", "low", 0), (4, "ما اعراض فقر الدم عند طفلي", "simple_medical", "medium", 2), (5, "تجنب المرض", "simple_medical", "medium", 1), (6, "شيء اخر", "unclear", "low", 0))


def _intents(spark, d):
    """A query for each customer, by its key one of the phrasings."""
    k = (F.col("c_custkey") % len(_ASKS) + 1).cast("int")
    part = lambda n: F.element_at(F.array(*(F.lit(a[n]) for a in _ASKS)), k)
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(part(1), F.lit(" "), F.col("c_custkey")).alias("norm"), part(2).alias("query_class"), part(3).alias("complexity"), part(4).alias("n_phrases"))
    q = q.withColumn("i", li.intent(F.col("norm"), F.col("query_class")))
    none = F.array().cast("array<string>")
    return q.withColumns({"primary_intent": F.coalesce("i.primary", F.lit("unclear_intent")), "secondary_intents": F.coalesce("i.secondary", none), "confidence": F.coalesce("i.confidence", F.lit(0.0))})


S_INTENTS = f"""q AS (SELECT c_custkey AS query_id, v.norm || ' ' || c_custkey AS norm, query_class, complexity, n_phrases FROM customer JOIN (VALUES {", ".join(str(a) for a in _ASKS)}) v(k, norm, query_class, complexity, n_phrases) ON v.k = c_custkey % {len(_ASKS)} + 1),
    intents AS (SELECT *, CASE WHEN regexp_matches(norm, 'طقس|جو اليوم') OR query_class = 'non_medical' THEN 'non_medical' WHEN regexp_matches(norm, 'وقايه|اقي|احمي|تجنب') THEN 'prevention_request' WHEN regexp_matches(norm, 'دواء|الدوا') AND regexp_matches(norm, 'بسبب|من الدواء|من الدوا|اثر|تداخل') THEN 'medication_safety'
    WHEN regexp_matches(norm, 'تحاليل|تحليل|فحص|اشعه|اختبار') THEN 'test_request' WHEN regexp_matches(norm, 'تشخيص|يشخص') THEN 'diagnosis_request' WHEN regexp_matches(norm, 'اعراض|عرض') THEN 'symptom_request' WHEN regexp_matches(norm, 'علاج|اعالج') THEN 'treatment_request' WHEN contains(norm, 'سبب') THEN 'cause_request' ELSE 'unclear_intent' END AS primary_intent FROM q)"""


@case("intent_rules", f"WITH {S_INTENTS} SELECT query_id, primary_intent FROM intents")
def intent_rules(spark, d):
    return _intents(spark, d).select("query_id", "primary_intent")


_PAD = "' ' || norm || ' '"


@case(
    "retrieval_plan",
    f"""WITH {S_INTENTS},
    s AS (SELECT *, query_class <> 'non_medical' AND primary_intent <> 'non_medical' AS inside, query_class = 'complex_medical' OR complexity = 'high' OR {" OR ".join(f"contains({_PAD}, '{w}')" for w in li.COMPARISON_TERMS)}
        OR (n_phrases >= 2 AND ({" OR ".join(f"contains(norm, '{w}')" for w in (*li.AGE_TERMS, *li.DURATION_TERMS))})) AS deep FROM intents)
    SELECT query_id, inside AS use_vector_search, inside AND n_phrases > 0 AS use_graph_search, CASE WHEN NOT (inside AND n_phrases > 0) THEN 0 WHEN deep OR complexity = 'medium' THEN 2 ELSE 1 END AS hop_depth,
        CASE WHEN NOT inside THEN '' {" ".join(f"WHEN primary_intent = '{i}' THEN '{' '.join(r)}'" for i, r in li.RELATIONS_BY_INTENT.items())} ELSE '' END AS preferred FROM s""",
)
def retrieval_plan(spark, d):
    rows = _intents(spark, d).withColumn("primary_entity_ids", F.when(F.col("n_phrases") > 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")))
    return li.retrieval_plan(rows).select("query_id", "use_vector_search", "use_graph_search", "hop_depth", F.array_join("preferred_relation_types", " ").alias("preferred"))


def _claims(spark, d):
    return cl.extract_claims(corpus.qa_pairs(table(spark, d, "conversations")), "qa_id", "answer")


@case("claim_split")
def claim_split(spark, d):
    return _claims(spark, d).select("qa_id", "place", F.explode(cl.split_clauses(F.col("claim"))).alias("claim"))


_S_CT = lambda t: f"list_distinct(list_transform(list_filter({t}, lambda t: length(t) > 1), lambda t: t))"  # noqa: E731  Latin tokens: nothing to strip


@case(
    "claim_support",
    f"""WITH {QA_PAIRS}, t AS (SELECT qa_id, {_S_CT(_t('question'))} AS q, {_S_CT(_t('answer'))} AS a FROM qa)
    SELECT qa_id, round({_share('a', 'q')}, 6) AS support, round(CASE WHEN len(q) > 0 AND len(a) > 0 THEN len(list_intersect(q, a)) / least(len(q), len(a)) ELSE 0 END, 6) AS relevance FROM t""",
)
def claim_support(spark, d):
    qa = corpus.qa_pairs(table(spark, d, "conversations")).select("qa_id", tm.token_set(F.col("question")).alias("q"), tm.token_set(F.col("answer")).alias("a"))
    own, asked_ = tm.claim_tokens(F.col("q")), tm.claim_tokens(F.col("a"))
    relevance = F.when((F.size(own) > 0) & (F.size(asked_) > 0), F.size(F.array_intersect(own, asked_)) / F.least(F.size(own), F.size(asked_))).otherwise(0.0)
    return qa.select("qa_id", F.round(cl.support(F.col("q"), F.col("a")), 6).alias("support"), F.round(relevance, 6).alias("relevance"))


def _verdicts(spark, d):
    """Claims of answers against their own answer (E1) and its question (E2)."""
    qa = corpus.qa_pairs(table(spark, d, "conversations"))
    cites = F.explode(F.array(F.lit("E1"), F.lit("E2"))).alias("evidence_id")
    claims = cl.claim_features(_claims(spark, d)).join(cl.query_features(qa.select("qa_id", F.col("question").alias("query"))).drop("query"), "qa_id")
    claims = claims.withColumns({"claim_id": F.concat_ws("-", F.col("qa_id").cast("string"), F.col("place").cast("string")), "primary_intent": F.lit("general_medical_advice")}).select("*", cites)
    evidence = qa.select(
        "qa_id", F.explode(F.array(F.struct(F.lit("E1").alias("evidence_id"), F.col("answer").alias("body")), F.struct(F.lit("E2").alias("evidence_id"), F.col("question").alias("body")))).alias("e"),
        (F.col("qa_id") % 5 / 5.0).alias("answer_relevance"), F.lit(0.8).alias("entity_identity"), F.lit(0.9).alias("vector_similarity"), F.lit(None).cast("double").alias("intent_support"), F.lit(1.0).alias("cited_coverage"),
    )
    return cl.verify(claims, evidence.select("*", "e.evidence_id", F.array("e.body").alias("texts")).drop("e"), ["qa_id", "evidence_id"])


@case("claim_verify")
def claim_verify(spark, d):
    return _verdicts(spark, d).withColumn("failed_checks", F.array_join("failed_checks", ","))


_S_VERDICT = "v AS (SELECT doc_id // 10 AS query_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'supported' WHEN toxic = 1 THEN 'unsupported' ELSE 'weakly_supported' END AS status, (doc_id % 7) / 7.0::DOUBLE AS support_score, doc_id % 3 <> 0 AS cited, (doc_id % 11) / 11.0::DOUBLE AS rc, (doc_id % 4) / 4.0::DOUBLE AS sr, ((doc_id // 10) % 10) / 10.0::DOUBLE AS cov FROM labels)"


def _derived(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "labels").select(
        F.expr("doc_id div 10").alias("query_id"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "supported").when(F.col("toxic") == 1, "unsupported").otherwise("weakly_supported").alias("status"),
        (i % 7 / 7.0).alias("support_score"), (i % 3 != 0).alias("cited"), (i % 11 / 11.0).alias("relation_confidence"), (i % 4 / 4.0).alias("source_reliability"), (F.expr("doc_id div 10") % 10 / 10.0).alias("query_coverage"),
    )


_S_MITIGATE = f"""{_S_VERDICT}, m AS (SELECT query_id, count(*) FILTER (WHERE status = 'supported') AS kept, count(*) FILTER (WHERE status <> 'supported') AS removed, max(cov) AS coverage FROM v GROUP BY 1),
a AS (SELECT *, CASE WHEN kept = 0 THEN 'insufficient_evidence' WHEN coverage >= 0.80 AND removed = 0 THEN 'fully_answerable' WHEN coverage >= 0.50 THEN 'partially_answerable' ELSE 'supported_but_incomplete' END AS answerability FROM m)"""


@case("mitigation", f"WITH {_S_MITIGATE} SELECT query_id, kept::BIGINT AS kept, removed::BIGINT AS removed, coverage, answerability FROM a")
def mitigation(spark, d):
    return cl.mitigate(_derived(spark, d))


@case(
    "reliability_score",
    f"""WITH {_S_MITIGATE}, c AS (SELECT v.query_id, count(*) FILTER (WHERE status = 'supported') / count(*) AS cs, count(*) FILTER (WHERE status = 'unsupported') / count(*) AS hr, coalesce(avg(support_score) FILTER (WHERE status = 'supported'), 0) AS ms,
        count(*) FILTER (WHERE status = 'supported' AND cited) / count(*) AS ec, coalesce(avg(rc) FILTER (WHERE status = 'supported'), 0) AS rc, coalesce(avg(sr) FILTER (WHERE status = 'supported'), 0) AS sr, min(answerability) AS lab FROM v JOIN a USING (query_id) GROUP BY 1),
    s AS (SELECT *, CASE lab WHEN 'fully_answerable' THEN 1.0 WHEN 'partially_answerable' THEN 0.65 WHEN 'supported_but_incomplete' THEN 0.35 ELSE 0.0 END::DOUBLE AS an FROM c),
    t AS (SELECT *, 0.30::DOUBLE * cs + 0.20::DOUBLE * ms + 0.15::DOUBLE * ec + 0.15::DOUBLE * rc + 0.15::DOUBLE * sr + 0.05::DOUBLE * an AS raw FROM s),
    u AS (SELECT *, least(1.0, greatest(0.0, CASE WHEN lab = 'insufficient_evidence' THEN least(raw, 0.20) ELSE raw END)) AS sc FROM t)
    SELECT query_id, round(sc, 6) AS score, CASE WHEN sc >= 0.80 THEN 'high' WHEN sc >= 0.55 THEN 'medium' ELSE 'low' END AS label, round(cs, 6) AS claim_support, round(ms, 6) AS mean_support, round(ec, 6) AS evidence_coverage, round(rc, 6) AS relation_confidence, round(sr, 6) AS source_reliability, round(an, 6) AS answerability, round(hr, 6) AS hallucination_rate FROM u""",
)
def reliability_score(spark, d):
    verdicts = _derived(spark, d)
    return cl.reliability(verdicts.join(cl.mitigate(verdicts).select("query_id", "answerability"), "query_id"))


@case("answer_questions")
def answer_questions(spark, d):
    """The whole pipeline with the offline providers, over words and vectors: an answer for each question of the conversations whose id is divisible by 100, against all pairs."""
    from .answering import answer_questions as run, hashing_encoder

    first = qas(spark, d).filter("conv_id % 100 = 0").select(F.col("qa_id").alias("query_id"), F.col("question").alias("query"))
    return run(first, qas(spark, d), encoder=hashing_encoder)["answers"]
