"""The question-answering pipeline for many questions in one job: analysis, links, plan, search over words, vectors and the graph, rerank, context, answer, claims, verdicts, reliability.

Models stay behind providers: functions over batches of prompts or texts. Every stage that later ones read more than once is written to the shared folder (sources/stages.py): plans stay small, each prompt is
asked once whichever of the returned tables is read, and claims and verdicts come from the same replies. The offline defaults are deterministic.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from ..functions import records as rec, terms as tm, text as tx
from ..operators import analysis as an, claims as cl, context as ctx, evidence as ev, graph as gr, linking as li, rerank as rr, retrieval as rt, search as se
from ..sources.config import Settings
from ..sources.stages import materialise

#: A provider takes prompts and gives replies, one each; it raises for a failed call.
Provider = Callable[[list[str]], list[str]]
#: An encoder takes texts and gives unit vectors, one each.
Encoder = Callable[[list[str]], np.ndarray]
#: Texts that an encoder gets at once, at most.
ENCODED = 2048
INSUFFICIENT = "The retrieved evidence is not enough for an answer."
UNAVAILABLE = "No answer was made: the generation service failed although evidence was found."
INCOMPLETE = "The answer is limited to the retrieved evidence, which does not cover the rest of the question."
MEDICAL = "general_medical_advice"


@dataclass(frozen=True)
class Graph:
    """The knowledge graph's tables.

    entities: entity_id, name, canonical (normal form), aliases (normal forms), entity_type; edges: relation_id, source_relation_id, source_entity_id, target_entity_id, source_name, target_name,
    graph_relation_type, direction, confidence, evidence, qa_id; mentions: mention_id, qa_id, evidence, field, question, answer, source_quality.
    """

    entities: DataFrame
    edges: DataFrame
    mentions: DataFrame


class ProviderError(Exception):
    """A failed call: whether trying again may help, and how long the server asks to wait."""

    def __init__(self, message: str, retryable: bool = True, retry_after: float | None = None):
        super().__init__(message)
        self.retryable, self.retry_after = retryable, retry_after


def status_error(status: int, body: str = "", headers: dict[str, str] | None = None) -> ProviderError:
    """The error of an HTTP reply: rate limits and server faults may pass, other statuses do not. Only the headers on limits and the begin of the body are told."""
    low = {k.lower(): v for k, v in (headers or {}).items()}
    told = [f"{k}={v}" for k, v in low.items() if k == "retry-after" or k.startswith("x-ratelimit-")]
    text = " ".join(body.split())[:500]
    try:
        after = float(low["retry-after"])
    except (KeyError, ValueError):
        after = None
    return ProviderError("; ".join([f"HTTP {status}", *told, *([f"body={text}"] if text else [])]), status == 429 or status >= 500, after)


def retryable(problem: Exception) -> bool:
    """Whether another attempt may succeed: limits, timeouts, broken connections and malformed replies."""
    return problem.retryable if isinstance(problem, ProviderError) else isinstance(problem, (TimeoutError, ConnectionError, ValueError, KeyError))


def retry_wait(attempt: int, retry_after: float | None = None, base: float = 2.0, most: float = 30.0) -> float:
    """Seconds before the attempt after this one (from 1): doubling, at least what the server asks for, never above most."""
    return max(0.0, min(most, max(base * 2 ** max(0, attempt - 1), retry_after or 0.0)))


def with_retries(provider: Provider, attempts: int = 3, base: float = 2.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Provider:
    """The provider with attempts for each prompt; one that keeps failing, or whose failure is final, gives an error reply, and others are not affected."""

    def run(prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            reply = json.dumps({"error": "no attempt"})
            for n in range(1, attempts + 1):
                try:
                    reply = provider([prompt])[0]
                    break
                except Exception as problem:  # any failure of a remote call is recorded with its row
                    reply = json.dumps({"error": f"{type(problem).__name__}: {problem}", "attempts": n})
                    if not retryable(problem) or n == attempts:
                        break
                    sleep(retry_wait(n, getattr(problem, "retry_after", None), base, most))
            out.append(reply)
        return out

    return run


def extractive_provider(prompts: list[str]) -> list[str]:
    """Offline default: cites the first sentences of the evidence that the prompt holds, in the payload's form."""
    out = []
    for prompt in prompts:
        rows = json.loads(prompt)["evidence"]
        made = [{"claim": r["text"].split(".")[0].strip(), "citations": [r["id"]]} for r in rows[:2] if r["text"].strip()]
        out.append(json.dumps({"claims": made, "limitations": []}, ensure_ascii=False))
    return out


def hashing_encoder(texts: list[str], dimension: int = 256) -> np.ndarray:
    """Offline default: unit vectors of hashed words."""
    out = np.zeros((len(texts), dimension))
    for row, text in zip(out, texts):
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode())
            row[h % dimension] += 1 if h >> 31 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1.0)


def encode(df: DataFrame, text: str, encoder: Encoder, column: str = "embedding") -> DataFrame:
    """df with the encoder's vector of each text, ENCODED texts at a time. Write the result before using it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODED):
                part = batch.slice(at, ENCODED)
                vectors = np.ascontiguousarray(encoder(pc.fill_null(part.column(text), "").to_pylist()), np.float64)
                ends = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, vectors.ravel())], [*part.schema.names, column])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(T.DoubleType()))]))


def ask(df: DataFrame, provider: Provider, prompt: str = "prompt", reply: str = "reply") -> DataFrame:
    """df with the provider's reply to each prompt. Write the result before using it twice: a lazy plan would call again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{reply: provider(batch[prompt].tolist()) if len(batch) else []})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(reply, T.StringType())]))


def analyse(questions: DataFrame, provider: Provider | None, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(analysis, phrases) of questions (query_id, query[, primary_intent]); by rules alone without a provider. An intent that a question comes with stands."""
    q = questions.withColumns({"original_query": F.col("query"), "_t": F.col("query")})
    q = tx.with_nfkc(q, "_t").withColumn("normalized_query", tx.query_form(F.col("_t"))).drop("_t")
    if provider is None:
        found = an.fallback(q.withColumn("reason", F.lit("No query analysis provider is configured.")))
        # without an analysis a question is taken for one that may be answered
        found = found.withColumn("query_class", F.when(F.col("query_class") == "unclear", "simple_medical").otherwise(F.col("query_class")))
        found = found.withColumn("primary_intent", F.when(F.col("primary_intent") == "unclear_intent", MEDICAL).otherwise(F.col("primary_intent")))
        phrases = q.limit(0).select("query_id", F.lit("").alias("norm"), F.lit("").alias("entity_type"), F.lit("").alias("source"), F.lit(0.0).alias("confidence"))
        found = found.withColumn("reformulated_query", F.col("original_query"))
    else:
        prompts = q.select("query_id", "original_query", "normalized_query", F.to_json(F.struct(F.lit(settings.analysis.prompt_version).alias("version"), F.col("normalized_query").alias("query"))).alias("prompt"))
        g = settings.generation
        replies = materialise(ask(prompts, with_retries(provider, g.max_attempts, g.retry_base_seconds, g.retry_max_seconds)))
        found, phrases = an.validate(replies)
        phrases = materialise(phrases)
    if "primary_intent" in questions.columns:
        own = questions.select("query_id", F.col("primary_intent").alias("_own"))
        found = found.join(own, "query_id", "left").withColumn("primary_intent", F.coalesce("_own", "primary_intent")).drop("_own")
        found = found.withColumn("preferred_relation_types", li.relation_types(F.col("primary_intent"), F.col("secondary_intents")))
    return materialise(found), phrases


def plan(analysis: DataFrame, phrases: DataFrame, graph: Graph | None, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(plan, links): what each query searches, and the entities that its phrases name."""
    if graph is None:
        links = phrases.limit(0).select("query_id", F.lit(0).alias("place"), "norm", F.lit("").alias("status"), F.lit("").alias("entity_id"), F.lit("").alias("canonical"), F.lit(0.0).alias("match_score"))
    else:
        keyed = phrases.withColumn("phrase_id", F.concat_ws("\x01", F.col("query_id").cast("string"), "norm", "entity_type", "source"))
        found = li.link_phrases(keyed, graph.entities).join(keyed.select("phrase_id", "query_id", "norm", F.when(F.col("source") == "corrected_query", 0).otherwise(1).alias("place")), "phrase_id")
        links = found.join(graph.entities.select("entity_id", "canonical"), "entity_id", "left")
    links = materialise(links)
    none = F.array().cast("array<string>")
    counted = phrases.groupBy("query_id").agg(F.count("*").cast("int").alias("n_phrases"))
    q = analysis.join(an.linked_by_query(links), "query_id", "left").join(counted, "query_id", "left")
    q = q.withColumns({**{c: F.coalesce(c, none) for c in ("primary_entity_ids", "low_specificity_entity_ids", "unresolved_phrases")}, "n_phrases": F.coalesce("n_phrases", F.lit(0))})
    text = q.withColumn("norm", tx.query_form(F.concat_ws(" ", "corrected_query", "reformulated_query")))
    made = li.retrieval_plan(text, settings.retrieval.max_hops)
    low = F.when(F.size("low_specificity_entity_ids") > 0, F.array(F.lit("links.too_general"))).otherwise(none)
    open_ = F.when(F.size("unresolved_phrases") > 0, F.array(F.lit("links.unresolved"))).otherwise(none)
    return materialise(q.drop("preferred_relation_types").join(made, "query_id").withColumn("warnings", an.ordered_union(F.col("warnings"), low, open_))), links


def _lexical(found: DataFrame, qas: DataFrame, channel: int, similarity) -> DataFrame:
    """Search results as evidence rows."""
    return found.join(qas, "qa_id").select(
        "query_id", F.lit(channel).alias("channel"), F.col("position").cast("long").alias("ordinal"), F.concat(F.lit("qa::"), F.col("qa_id").cast("string")).alias("evidence_id"), F.col("qa_id").cast("string").alias("source_id"),
        F.col("qa_id").cast("string").alias("qa_id"), "question", F.col("answer").alias("text"), "answer", F.lit("ahd_heldout_safe_corpus").alias("source_quality"), F.lit("answer").alias("origin"), "score",
        F.array().cast("array<string>").alias("relation_ids"), similarity.cast("double").alias("vector_similarity"),
    )


def _walk(planned: DataFrame, phrases: DataFrame, graph: Graph, hits: DataFrame, qa_hits: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(scored relations, evidence rows) of the graph: seeds are linked entities, else vector hits that nearly are what the query names. hits and qa_hits: query_id, entity_id or qa_id, score."""
    r = settings.retrieval
    primary = planned.filter("use_vector_search OR use_graph_search").select("query_id", F.explode("primary_entity_ids").alias("entity_id"))
    named = phrases.select("query_id", "norm", "entity_type")
    own = planned.join(phrases.select("query_id").distinct(), "query_id", "left_anti").filter("use_vector_search").select("query_id", tx.query_form(F.col("reformulated_query")).alias("norm"), F.lit("").alias("entity_type"))
    kinds = graph.entities.select("entity_id", F.col("entity_type").alias("seed_type"), F.col("canonical").alias("seed_name"))
    seeds = materialise(rt.seed_scores(primary, hits, named.unionByName(own), fuzzy=True).join(kinds, "entity_id", "left"))
    depth = planned.select("query_id", F.when(F.col("hop_depth") > 0, F.col("hop_depth")).when(F.col("complexity") == "high", 2).otherwise(1).alias("hops"), "preferred_relation_types", "low_specificity_entity_ids")
    each = seeds.join(depth, "query_id")
    walked = [gr.hop_edges(graph.edges, each.filter(F.col("hops") == n).select("entity_id").distinct(), n).join(each.filter(F.col("hops") == n), F.col("seed_entity_id") == F.col("entity_id")) for n in (1, 2)]
    found = walked[0].unionByName(walked[1])
    wanted = (F.size("preferred_relation_types") == 0) | F.array_contains("preferred_relation_types", F.col("graph_relation_type"))
    kept = ["seed_score", "entity_id", "seed_type", "seed_name", "source_relation_id", "source_entity_id", "target_entity_id", "source_name", "target_name", "graph_relation_type", "direction", "confidence", "evidence", "qa_id", "preferred_relation_types", "low_specificity_entity_ids"]
    found = found.filter(wanted).groupBy("query_id", "relation_id").agg(F.max(F.struct(*kept)).alias("x")).select("query_id", "relation_id", "x.*")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "relation_id"))
    found = materialise(found.withColumn("_n", best).filter(F.col("_n") <= 3 * r.relation_top_k).drop("_n"))
    mentioned = gr.first_mentions(found.select("query_id", "relation_id", "qa_id"), graph.mentions).join(graph.mentions.drop("qa_id"), "mention_id")
    texts = mentioned.groupBy("query_id", "relation_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "evidence", "question", "answer"))), " ").alias("_texts"))
    types = phrases.groupBy("query_id").agg(F.collect_set("entity_type").alias("_types"))
    rows = found.join(planned.select("query_id", F.col("reformulated_query").alias("query")), "query_id").join(types, "query_id", "left").join(texts, ["query_id", "relation_id"], "left")
    by_entity, by_qa = rt.support(hits, "entity_id"), rt.support(qa_hits, "qa_id")
    for end in ("source", "target"):
        rows = rows.join(by_entity.select("query_id", F.col("entity_id").alias(f"{end}_entity_id"), F.col("support").alias(f"_{end}")), ["query_id", f"{end}_entity_id"], "left")
    rows = rows.withColumn("qa_id", F.col("qa_id").cast("string")).join(by_qa.select("query_id", "qa_id", F.col("support").alias("_of_qa")), ["query_id", "qa_id"], "left")
    rows = rows.withColumns({
        "semantic": F.greatest(*(F.coalesce(c, F.lit(0.0)) for c in ("_source", "_target", "_of_qa"))), "relation_type": F.col("graph_relation_type"), "preferred": F.col("preferred_relation_types"), "own_evidence": F.col("evidence"),
        "evidence": F.concat_ws(" ", "evidence", "_texts"), "generic_seed": F.array_contains("low_specificity_entity_ids", F.col("entity_id")) | tm.is_generic(F.coalesce("seed_name", F.lit(""))),
        "type_conflict": F.coalesce((F.size("_types") > 0) & (F.col("seed_type") != "") & ~F.array_contains("_types", F.col("seed_type")), F.lit(False)),
    }).drop("_source", "_target", "_of_qa", "_texts", "_types", "low_specificity_entity_ids", "entity_id")
    scored = rr.score_relations(rows, fuzzy=True).withColumn("evidence", F.col("own_evidence")).drop("own_evidence")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), "relation_id"))
    scored = materialise(scored.withColumn("place", place).filter(F.col("place") <= r.relation_top_k))
    items = scored.select("query_id", "relation_id", "qa_id", "evidence", "hybrid_score", "place")
    first = gr.first_mentions(items.select("query_id", "relation_id", "qa_id", "hybrid_score", "place"), graph.mentions).join(graph.mentions.drop("qa_id"), "mention_id")
    blank = F.lit("")
    of_relations = items.filter(F.trim(F.coalesce("evidence", blank)) != "").select(
        "query_id", F.lit(0).alias("channel"), F.col("place").cast("long").alias("ordinal"), F.concat(F.lit("relation::"), "relation_id").alias("evidence_id"), F.col("relation_id").alias("source_id"), F.col("qa_id").cast("string").alias("qa_id"), blank.alias("question"),
        F.col("evidence").alias("text"), blank.alias("answer"), blank.alias("source_quality"), F.lit("validated_relation").alias("origin"), F.col("hybrid_score").alias("score"), F.array("relation_id").alias("relation_ids"), F.lit(0.0).alias("vector_similarity"),
    )
    text = F.when(F.trim(F.coalesce("evidence", blank)) != "", F.col("evidence")).otherwise(F.col("answer"))
    of_mentions = first.filter(F.trim(F.coalesce(text, blank)) != "").select(
        "query_id", F.lit(1).alias("channel"), (F.col("place") * 10 + F.col("mention_rank")).cast("long").alias("ordinal"), F.concat(F.lit("mention::"), "mention_id").alias("evidence_id"), F.col("mention_id").cast("string").alias("source_id"), F.col("qa_id").cast("string").alias("qa_id"),
        F.coalesce("question", blank).alias("question"), text.alias("text"), F.coalesce("answer", blank).alias("answer"), F.coalesce("source_quality", blank).alias("source_quality"), F.coalesce("field", blank).alias("origin"), F.col("hybrid_score").alias("score"),
        F.array("relation_id").alias("relation_ids"), F.lit(0.0).alias("vector_similarity"),
    )
    return scored, of_relations.unionByName(of_mentions)


def retrieve(planned: DataFrame, phrases: DataFrame, qas: DataFrame, graph: Graph | None, encoder: Encoder | None, settings: Settings, index: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """relations, evidence (distinct over all channels), query vectors and the corpus' vectors (None without an encoder)."""
    r, c = settings.retrieval, settings.corpus
    open_ = planned.filter("use_vector_search OR use_graph_search").select("query_id", "original_query", F.col("reformulated_query").alias("query"))
    rows, vectors, hits = [], None, None
    if encoder is not None:
        asked = materialise(encode(open_.select("query_id", F.concat(F.lit("query: "), "query").alias("t")), "t", encoder, "query_vector").drop("t"))
        stored = materialise(encode(qas.select("qa_id", rec.passage(F.col("question"), F.col("answer"), F.col("category")).alias("t")), "t", encoder).drop("t"))
        vectors = (asked, stored)
        near = se.vector_top_k(stored.withColumnRenamed("qa_id", "vec_id"), asked, r.qa_top_k).select("query_id", F.col("vec_id").alias("qa_id"), F.col("rank").alias("position"), "score")
        rows.append(materialise(_lexical(near, qas, 2, F.col("score"))))
        if graph is not None:
            entities = materialise(encode(graph.entities.select("entity_id", "name", "entity_type", rec.passage(F.col("name")).alias("t")), "t", encoder).drop("t"))
            best = se.vector_top_k(entities.withColumnRenamed("entity_id", "vec_id"), asked, r.entity_top_k)
            titles = tx.with_nfkc(best, "name").withColumn("title", tx.query_form(F.col("name")))
            hits = materialise(titles.select("query_id", F.col("vec_id").alias("entity_id"), "title", "entity_type", "score", F.col("rank").alias("ordinal")))
    if c.enabled:
        rows.append(materialise(_lexical(se.search_qa(qas, open_, c.lexical_candidate_k, max(r.qa_top_k, c.semantic_top_k), index), qas, 3, F.lit(0.0))))
    relations = None
    if graph is not None:
        if hits is None:
            hits = planned.limit(0).select("query_id", F.lit("").alias("entity_id"), F.lit("").alias("title"), F.lit("").alias("entity_type"), F.lit(0.0).alias("score"), F.lit(0).alias("ordinal"))
        known = [x.select("query_id", "qa_id", "score") for x in rows] or [planned.limit(0).select("query_id", F.lit("").alias("qa_id"), F.lit(0.0).alias("score"))]
        relations, found = _walk(planned, phrases, graph, hits, known[0] if len(known) == 1 else known[0].unionByName(known[1]), settings)
        rows.append(found)
    if not rows:
        raise ValueError("nothing to search: the corpus is switched off, and there is neither an encoder nor a graph")
    evidence = rows[0]
    for more in rows[1:]:
        evidence = evidence.unionByName(more)
    return {"relations": relations, "evidence": materialise(rr.distinct_evidence(evidence, 2 * r.context_top_k).drop("rank")), "vectors": vectors}


def rerank(planned: DataFrame, evidence: DataFrame, relations: DataFrame | None, settings: Settings) -> DataFrame:
    """Reranked evidence of each query, with its authoritative texts and the gate that stops it."""
    queries = planned.select("query_id", "original_query", F.col("reformulated_query").alias("query"), "primary_intent")
    rows = evidence.join(queries, "query_id").withColumns({"relation_support": F.when(F.size("relation_ids") > 0, 1.0).otherwise(0.0), "qa_support": F.lit(0.0)})
    ranked = rr.rerank_evidence(rows, settings.retrieval.context_top_k, fuzzy=True)
    judged = ev.authoritative(ranked.withColumns({"origin_label": F.col("origin"), "field": F.lit("")}).drop("origin"))
    return ctx.gate_reasons(judged.withColumn("source_reliability", rec.source_prior(F.col("source_quality"))))


def select(gated: DataFrame, settings: Settings) -> DataFrame:
    """The evidence that a generator may see: evidence rows with place and display_id."""
    r = settings.retrieval
    picked = ctx.select_context(gated, r.context_relative_margin, max_items=r.context_max_items, min_coverage=r.context_min_aggregate_concept_coverage)
    return ctx.display_ids(picked.join(gated, ["query_id", "evidence_id"]), "E")


def fall_back(planned: DataFrame, context: DataFrame, qas: DataFrame, evidence: DataFrame, vectors: tuple[DataFrame, DataFrame] | None, settings: Settings, index=None) -> DataFrame | None:
    """More candidates, by vectors over a wider shortlist, for queries that found no context but name something; None if no query needs them."""
    c = settings.corpus
    if not (c.enabled and c.semantic_fallback_enabled) or vectors is None:
        return None
    lacking = planned.join(context.select("query_id").distinct(), "query_id", "left_anti")
    norm = tm.token_set(tx.query_form(F.col("reformulated_query")), True)
    needs = lacking.filter(rt.needs_fallback(F.col("query_class"), F.col("use_vector_search"), F.size("primary_entity_ids"), F.size("unresolved_phrases"), norm))
    needs = materialise(needs.select("query_id", "original_query", F.col("reformulated_query").alias("query")))
    if needs.isEmpty():
        return None
    found = se.search_qa(qas, needs, c.semantic_fallback_candidate_k, c.semantic_top_k, index, vectors)
    more = _lexical(found, qas, 4, F.col("score"))
    old = evidence.join(needs.select("query_id"), "query_id", "left_semi")
    return materialise(rr.distinct_evidence(old.unionByName(more.select(*old.columns)), 2 * settings.retrieval.context_top_k).drop("rank"))


def graph_facts(context: DataFrame, relations: DataFrame | None, settings: Settings) -> DataFrame | None:
    """query_id, relation_id, display_id (R1, ...), fact, confidence: the relations that selected evidence rests on, best first."""
    if relations is None:
        return None
    used = context.select("query_id", F.explode("relation_ids").alias("relation_id")).distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    kept = relations.join(used, ["query_id", "relation_id"]).withColumn("nth", place).filter(F.col("nth") <= settings.retrieval.context_max_items)
    return ctx.display_ids(kept.withColumn("fact", ctx.fact("source_name", "relation_type", "target_name")), "R", "nth").select("query_id", "relation_id", "display_id", "fact", "confidence")


_REPLY = "struct<claims: array<struct<claim: string, citations: array<string>>>, limitations: array<string>, error: string, attempts: int>"


def validated_claims(replies: DataFrame, most: int = 2) -> DataFrame:
    """query_id, n, claim, evidence_id, error of replies (query_id, reply, allowed ids): payloads of another form are error rows; a claim needs three words, one allowed citation, and counts once."""
    parsed = replies.select("query_id", "allowed", rec.json_object(F.col("reply")).alias("j")).select("query_id", "allowed", F.from_json("j", _REPLY).alias("p"), F.json_object_keys("j").alias("keys"))
    other = F.array_except("keys", tm.words(["claims", "limitations", "error", "attempts"]))
    error = (
        F.when(F.col("p").isNull() | F.col("keys").isNull(), "not JSON").when(F.col("p.error").isNotNull(), F.col("p.error")).when(F.col("p.claims").isNull(), "claims missing")
        .when(F.size(other) > 0, F.concat(F.lit("unexpected fields: "), F.array_join(other, ", "))).when(F.size("p.claims") > most, "too many claims").when(F.size("p.limitations") > 1, "too many limitations")
    )
    marked = parsed.withColumn("error", error)
    bad = marked.filter("error IS NOT NULL").select("query_id", F.lit(-1).alias("n"), F.lit(None).cast("string").alias("claim"), F.lit(None).cast("string").alias("evidence_id"), "error")
    good = marked.filter("error IS NULL").select("query_id", "allowed", F.posexplode("p.claims").alias("n", "c")).select("query_id", "allowed", "n", tx.one_line(F.col("c.claim")).alias("claim"), "c.citations")
    valid = (F.size(F.split("claim", " ")) >= 3) & (F.size("citations") == 1) & F.array_contains("allowed", F.element_at("citations", 1)) & ~cl.is_limitation(F.col("claim"))
    first = good.filter(valid).groupBy("query_id", "claim").agg(F.min(F.struct("n", F.element_at("citations", 1).alias("evidence_id"))).alias("f"))
    return first.select("query_id", "f.n", "claim", "f.evidence_id", F.lit(None).cast("string").alias("error")).unionByName(bad)


def prompts_of(context: DataFrame, facts: DataFrame | None, modes: DataFrame) -> DataFrame:
    """query_id, prompt, allowed: what the generator sees of each query, authoritative texts with their ids (one alone where it is strong enough) and the graph's facts."""
    shown = context.join(modes.select("query_id", "mode", F.col("evidence_id").alias("_one")), "query_id", "left").filter((F.col("mode") != "strong_direct_evidence") | F.col("mode").isNull() | (F.col("evidence_id") == F.col("_one")))
    first = F.element_at(F.concat("texts", F.array(F.lit(""))), 1)
    rows = F.array_sort(F.collect_list(F.when(first != "", F.struct("place", F.col("display_id").alias("id"), tx.compact(first, 800).alias("text")))))
    grouped = shown.groupBy("query_id", "query", F.coalesce("mode", F.lit("partial_or_mixed_evidence")).alias("mode")).agg(rows.alias("rows")).filter(F.size("rows") > 0)
    if facts is not None:
        told = facts.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("display_id", "fact"))), lambda x: F.struct(x["display_id"].alias("id"), x["fact"].alias("fact"))).alias("facts"))
        grouped = grouped.join(told, "query_id", "left")
    else:
        grouped = grouped.withColumn("facts", F.lit(None).cast("array<struct<id: string, fact: string>>"))
    items = F.transform("rows", lambda r: F.struct(r["id"].alias("id"), r["text"].alias("text")))
    prompt = F.to_json(F.struct("query", "mode", items.alias("evidence"), F.col("facts").alias("graph_facts")))
    return grouped.select("query_id", prompt.alias("prompt"), F.transform("rows", lambda r: r["id"]).alias("allowed"))


def answer_questions(
    questions: DataFrame, qas: DataFrame, provider: Provider = extractive_provider, settings: Settings | None = None, graph: Graph | None = None, encoder: Encoder | None = None, analyser: Provider | None = None,
    index: tuple[DataFrame, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """The tables of the pipeline: analysis, plan, links, relations, evidence, context, facts, claims, verdicts, answers (one row for each question).

    questions: query_id, query[, primary_intent]; qas: qa_id, question, answer, category. Words are always searched, vectors with an encoder, the graph with one. Questions that find no context but name something
    search again by vectors over a wider shortlist. All returned tables are written, so reading one calls no provider.
    """
    s = settings or Settings()
    qas = materialise(qas.select("qa_id", "question", "answer", "category"))
    analysis, phrases = analyse(questions, analyser, s)
    planned, links = plan(analysis, phrases, graph, s)
    found = retrieve(planned, phrases, qas, graph, encoder, s, index)
    relations, evidence = found["relations"], found["evidence"]
    gated = materialise(rerank(planned, evidence, relations, s))
    context = materialise(select(gated, s))
    more = fall_back(planned, context, qas, evidence, found["vectors"], s, index)
    if more is not None:
        again = materialise(rerank(planned, more, relations, s))
        gated = materialise(gated.join(again.select("query_id").distinct(), "query_id", "left_anti").unionByName(again))
        context = materialise(context.unionByName(select(again, s)))
    facts = graph_facts(context, relations, s)
    facts = materialise(facts) if facts is not None else None
    modes = cl.generation_mode(context.withColumn("evidence", F.col("text")))
    g = s.generation
    replies = materialise(ask(prompts_of(context, facts, modes), with_retries(provider, g.max_attempts, g.retry_base_seconds, g.retry_max_seconds)))
    claims = materialise(validated_claims(replies))
    cited = claims.filter("error IS NULL").withColumn("claim_id", F.concat_ws("-", F.col("query_id").cast("string"), F.col("n").cast("string")))
    cited = materialise(cited.join(cl.query_features(planned.select("query_id", F.col("reformulated_query").alias("query"), "primary_intent")), "query_id"))
    rows = context.select(
        "query_id", F.col("display_id").alias("evidence_id"), F.col("evidence_id").alias("item"), "texts", "question_only", "answer_relevance", "entity_identity", F.col("vector").alias("vector_similarity"), F.col("intent").alias("intent_support"),
        F.col("coverage").alias("cited_coverage"), "source_reliability", "relation_ids",
    )
    if facts is not None:
        told = ev.facts_of(context.select("query_id", "evidence_id", "relation_ids"), facts)
        rows = rows.join(told.select("query_id", F.col("evidence_id").alias("item"), "facts"), ["query_id", "item"], "left").withColumn("texts", F.array_distinct(F.concat("texts", F.coalesce("facts", F.array().cast("array<string>"))))).drop("facts")
    rows = materialise(rows)
    found_ = cl.verify(cited, rows, ["query_id", "evidence_id"])
    confidence = F.lit(None).cast("double")
    tied = rows.select("query_id", F.col("evidence_id").alias("best_evidence_id"), "source_reliability", "relation_ids")
    verdicts = found_.join(cited.select("claim_id", "query_id", "n", "claim", "query"), "claim_id").join(tied, ["query_id", "best_evidence_id"], "left")
    if facts is not None:
        strength = verdicts.select("claim_id", "query_id", F.explode("relation_ids").alias("relation_id")).join(facts.select("query_id", "relation_id", "confidence"), ["query_id", "relation_id"]).groupBy("claim_id").agg(F.max("confidence").alias("relation_confidence"))
        verdicts = verdicts.join(strength, "claim_id", "left")
    else:
        verdicts = verdicts.withColumn("relation_confidence", confidence)
    verdicts = materialise(verdicts.withColumns({"relation_confidence": F.coalesce("relation_confidence", F.lit(0.0)), "cited": F.col("best_evidence_id").isNotNull()}))
    return {"analysis": analysis, "plan": planned, "links": links, "relations": relations, "evidence": gated, "context": context, "facts": facts, "claims": claims, "verdicts": verdicts, "answers": materialise(assemble(planned, claims, verdicts))}


def assemble(planned: DataFrame, claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """query_id, answer, answerability, kept, removed, reliability, label, query_coverage, missing_concepts, limitation, generation_status, warnings: one row for each question."""
    kept = verdicts.filter("status = 'supported'").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "claim"))), lambda x: x["claim"]), "\n").alias("kept_text"))
    wanted = planned.select("query_id", "warnings", tm.concepts(tm.token_set(F.col("reformulated_query"))).alias("wanted"))
    covered = wanted.join(kept, "query_id", "left").withColumn("got", tm.concepts(tm.token_set(F.coalesce("kept_text", F.lit("")))))
    share = F.when(F.size("wanted") > 0, F.size(F.array_intersect("wanted", "got")) / F.size("wanted")).otherwise(1.0)
    covered = materialise(covered.select("query_id", "warnings", "kept_text", share.alias("query_coverage"), F.array_except("wanted", "got").alias("missing_concepts")))
    judged = verdicts.join(covered.select("query_id", "query_coverage"), "query_id")
    mitigated = materialise(cl.mitigate(judged))
    scored = cl.reliability(judged.join(mitigated.select("query_id", "answerability"), "query_id"))
    failed = claims.filter("error IS NOT NULL").groupBy("query_id").agg(F.min("error").alias("error"))
    out = covered.join(mitigated.select("query_id", "answerability", "kept", "removed"), "query_id", "left").join(scored.select("query_id", F.col("score").alias("reliability"), "label"), "query_id", "left").join(failed, "query_id", "left")
    lost = F.col("kept_text").isNull()
    none = F.array().cast("array<string>")
    return out.select(
        "query_id", F.when(~lost, F.col("kept_text")).when(F.col("error").isNotNull(), UNAVAILABLE).otherwise(INSUFFICIENT).alias("answer"), F.coalesce("answerability", F.lit("insufficient_evidence")).alias("answerability"),
        F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("removed", F.lit(0)).alias("removed"), F.coalesce("reliability", F.lit(0.0)).alias("reliability"), F.coalesce("label", F.lit("low")).alias("label"),
        F.round("query_coverage", 6).alias("query_coverage"), F.array_join("missing_concepts", " ").alias("missing_concepts"), F.when(lost, INSUFFICIENT).when(F.size("missing_concepts") > 0, INCOMPLETE).otherwise("").alias("limitation"),
        F.when(F.col("error").isNotNull(), F.concat(F.lit("failed: "), "error")).when(lost & F.col("answerability").isNull(), "no evidence").otherwise("generated").alias("generation_status"),
        F.array_join(an.ordered_union(F.col("warnings"), F.array(F.lit("reliability.uncalibrated")), none), " | ").alias("warnings"),
    )


def context_only(questions: DataFrame, qas: DataFrame, settings: Settings | None = None, graph: Graph | None = None, encoder: Encoder | None = None, analyser: Provider | None = None) -> DataFrame:
    """The selected evidence alone: no generator is asked."""
    s = settings or Settings()
    qas = materialise(qas.select("qa_id", "question", "answer", "category"))
    analysis, phrases = analyse(questions, analyser, s)
    planned, _ = plan(analysis, phrases, graph, s)
    found = retrieve(planned, phrases, qas, graph, encoder, s)
    context = materialise(select(materialise(rerank(planned, found["evidence"], found["relations"], s)), s))
    more = fall_back(planned, context, qas, found["evidence"], found["vectors"], s)
    return context if more is None else context.unionByName(select(materialise(rerank(planned, more, found["relations"], s)), s))
