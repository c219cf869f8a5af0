"""Queries on entities, relations, the property graph and its walks.

The graph comes from orders by one rule: the customer of an order is a DiseaseCondition, the customer's nation a Symptom, the order's parts Treatments and
its suppliers Tests; an order is the qa. A relation's confidence is ((qa * 31 + key of its target) % 100) / 100; those of 0.5 or more are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import records as rec, text as tx
from ..operators import adjacency as ad, corpus, graph as gr
from ..sources.stages import shared_folder
from .registry import ORACLE_SQL, case, s_match, table

S_MENTIONS = """m0 AS (
    SELECT o_orderkey AS qa_id, 'customer:' || o_custkey AS entity_id, 'DiseaseCondition' AS entity_type, o_custkey AS k, 0 AS kind FROM orders
    UNION SELECT o_orderkey, 'nation:' || c_nationkey, 'Symptom', c_nationkey, 1 FROM orders JOIN customer ON c_custkey = o_custkey
    UNION SELECT l_orderkey, 'part:' || l_partkey, 'Treatment', l_partkey, 2 FROM lineitem
    UNION SELECT l_orderkey, 'supplier:' || l_suppkey, 'Test', l_suppkey, 3 FROM lineitem),
m AS (SELECT *, sha1(entity_id || '|' || qa_id) AS mention_id, row_number() OVER (PARTITION BY qa_id ORDER BY kind, k) AS place FROM m0)"""
_TYPE = """CASE s.entity_type || '>' || t.entity_type WHEN 'DiseaseCondition>Symptom' THEN 'HAS_SYMPTOM' WHEN 'DiseaseCondition>Treatment' THEN 'TREATED_BY' WHEN 'Symptom>Treatment' THEN 'TREATED_BY'
    WHEN 'DiseaseCondition>Test' THEN 'DIAGNOSED_BY' WHEN 'Symptom>Test' THEN 'INVESTIGATED_BY' END"""
S_CANDIDATES = f"""{S_MENTIONS},
c0 AS (SELECT s.qa_id, s.entity_id AS source_entity_id, s.entity_type AS source_type, t.entity_id AS target_entity_id, t.entity_type AS target_type, t.k, {_TYPE} AS relation_type,
    s.place AS sp, t.place AS tp FROM m s JOIN m t ON s.qa_id = t.qa_id AND s.entity_id <> t.entity_id),
c AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY sp, tp) AS pair_rank, 'rel_seed_' || left(sha1(source_entity_id || '|' || relation_type || '|' || target_entity_id || '|' || qa_id), 16) AS relation_id,
    ((qa_id * 31 + k) % 100) / 100.0::DOUBLE AS confidence FROM c0 WHERE relation_type IS NOT NULL)"""
S_RELATIONS = f"""{S_CANDIDATES},
r AS (SELECT * FROM c WHERE pair_rank <= 25 AND confidence >= 0.5)"""
# the relations of all of an order's pairs
S_ALL_RELATIONS = f"""{S_CANDIDATES},
r AS (SELECT * FROM c WHERE confidence >= 0.5)"""
_S_BOTH = """
e AS (SELECT relation_id, relation_id AS edge_id, qa_id, source_entity_id, target_entity_id, relation_type AS graph_relation_type, 'direct' AS edge_direction, confidence FROM r
    UNION ALL SELECT relation_id, relation_id || '__inverse', qa_id, target_entity_id, source_entity_id,
        CASE relation_type WHEN 'HAS_SYMPTOM' THEN 'SYMPTOM_OF' WHEN 'TREATED_BY' THEN 'TREATS' WHEN 'DIAGNOSED_BY' THEN 'DIAGNOSES' ELSE 'INVESTIGATES' END, 'inverse', confidence FROM r)"""
S_EDGES = f"{S_RELATIONS},{_S_BOTH}"
S_ALL_EDGES = f"{S_ALL_RELATIONS},{_S_BOTH}"


def mentions(spark, d):
    """mention_id, qa_id, entity_id, entity_type, k, place: each entity once in each order, customers first. Numbers are dealt out by order, once; names and places are worked out where they lie."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    row = lambda df, qa, key, n: df.select(F.col(qa).alias("qa_id"), F.lit(n).alias("kind"), F.col(key).cast("long").alias("k"))
    nations = orders.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    parts = row(orders, "o_orderkey", "o_custkey", 0).unionByName(row(nations, "o_orderkey", "c_nationkey", 1))
    parts = parts.unionByName(row(lines, "l_orderkey", "l_partkey", 2)).unionByName(row(lines, "l_orderkey", "l_suppkey", 3))
    place = F.row_number().over(Window.partitionBy("qa_id").orderBy("kind", "k"))
    by_kind = lambda *values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("kind") + 1)
    named = parts.repartition("qa_id").distinct().withColumn("place", place).withColumns({
        "entity_id": F.concat(by_kind("customer:", "nation:", "part:", "supplier:"), F.col("k").cast("string")),
        "entity_type": by_kind("DiseaseCondition", "Symptom", "Treatment", "Test"),
    })
    return named.withColumn("mention_id", rec.mention_key(F.col("entity_id"), F.col("qa_id").cast("string")))


def relations(spark, d, cap=gr.PAIR_CAP):
    found = gr.relation_candidates(mentions(spark, d), cap)
    key = F.substring_index("target_entity_id", ":", -1).cast("long")
    return found.withColumn("confidence", ((F.col("qa_id") * 31 + key) % 100) / 100.0)


def kept(spark, d, cap=gr.PAIR_CAP):
    return relations(spark, d, cap).filter("confidence >= 0.5")


def edges(spark, d, cap=gr.PAIR_CAP):
    columns = ["relation_id", "relation_type", "qa_id", "source_entity_id", "source_type", "target_entity_id", "target_type", "confidence"]
    return gr.both_directions(kept(spark, d, cap).select(*columns))


@case("stable_ids", "SELECT p_partkey, 'ent_treatment_' || left(sha1('Treatment::' || lower(p_name)), 12) AS entity_id FROM part")
def stable_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", rec.entity_id(F.lit("Treatment"), F.lower("p_name")).alias("entity_id"))


@case("latest_record_per_key", "SELECT user_id, max_by(event_id, event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_record_per_key(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("r"))
    return last.select("user_id", "r.event_id", "r.event_type")


@case(
    "resume_pending",
    """WITH q AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS n FROM (SELECT DISTINCT user_id FROM events)), done AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id % 3 <> 0)
    SELECT user_id FROM q WHERE n BETWEEN 11 AND 100 AND user_id NOT IN (SELECT user_id FROM done)""",
)
def resume_pending(spark, d):
    """The slice of the work list that has no completed record yet: tasks keep its first 100 keys, and only those are numbered."""
    events = table(spark, d, "events")
    queue = events.select("user_id").distinct().orderBy("user_id").limit(100).withColumn("n", F.row_number().over(Window.orderBy("user_id")))
    done = events.filter("event_type = 'purchase' AND user_id % 3 <> 0").select("user_id").distinct()
    return queue.filter("n BETWEEN 11 AND 100").join(done, "user_id", "left_anti").select("user_id")


@case("json_payload_parse", "SELECT event_id, json_extract_string(regexp_extract('Reply: ```json ' || props || ' ```', '(?s)\\{.*\\}'), '$.page') AS page, regexp_extract('Reply: ' || props, '(?s)\\{.*\\}') AS payload FROM events")
def json_payload_parse(spark, d):
    reply = F.concat(F.lit("Reply: ```json "), "props", F.lit(" ```"))
    return table(spark, d, "events").select("event_id", F.get_json_object(rec.json_object(reply), "$.page").alias("page"), rec.json_object(F.concat(F.lit("Reply: "), "props")).alias("payload"))


_S_PART_MENTIONS = """pm AS (SELECT l_orderkey * 100 + l_linenumber AS ordinal, 'brand:' || p_brand AS entity_id, p_name AS canonical_name, p_type AS entity_type,
    CASE l_linenumber % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS quality, l_quantity > 1 AS actionable, p_type AS alias, l_suppkey AS chunk_id, l_orderkey AS qa_id, l_returnflag AS model, l_discount AS confidence
    FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _part_mentions(spark, d):
    """Lines as mentions of their part's brand. Lines may share order and number, so each carries its place in the files."""
    lines = table(spark, d, "lineitem").withColumns({"file": F.col("_metadata.file_path"), "record": F.col("_metadata.row_index")}).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber") % 3
    return lines.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ordinal"), F.concat(F.lit("brand:"), "p_brand").alias("entity_id"), F.col("p_name").alias("canonical_name"), F.col("p_type").alias("entity_type"),
        F.when(n == 0, "low").when(n == 1, "medium").otherwise("high").alias("quality"), (F.col("l_quantity") > 1).alias("actionable"), F.col("p_type").alias("alias"), F.col("l_suppkey").alias("chunk_id"),
        F.col("l_orderkey").alias("qa_id"), F.col("l_returnflag").alias("model"), F.col("l_discount").alias("confidence"), "file", "record",
    )


@case(
    "entity_merge",
    f"""WITH {_S_PART_MENTIONS} SELECT entity_id, min_by(canonical_name, ordinal) AS canonical_name, min_by(entity_type, ordinal) AS entity_type, CASE min(CASE quality WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS quality,
    bool_and(actionable) AS actionable, string_agg(DISTINCT alias, '|' ORDER BY alias) AS aliases, count(*)::BIGINT AS mention_count, count(DISTINCT chunk_id)::BIGINT AS source_chunk_count, count(DISTINCT qa_id)::BIGINT AS qa_count,
    round(avg(confidence), 6) AS avg_confidence, string_agg(DISTINCT model, '|' ORDER BY model) AS models FROM pm GROUP BY entity_id""",
)
def entity_merge(spark, d):
    out = gr.merge_entities(_part_mentions(spark, d), ("file", "record"))
    return out.withColumns({"aliases": F.array_join("aliases", "|"), "models": F.array_join("models", "|"), "avg_confidence": F.round("avg_confidence", 6)})


@case("alias_support", f"WITH {_S_PART_MENTIONS} SELECT entity_id, alias, count(*)::BIGINT AS support_count, count(DISTINCT qa_id)::BIGINT AS qa_count FROM pm GROUP BY ALL")
def alias_support(spark, d):
    return gr.alias_support(_part_mentions(spark, d))


@case("relation_candidates", f"WITH {S_RELATIONS} SELECT relation_type, count(*)::BIGINT AS n, count(DISTINCT qa_id)::BIGINT AS n_qa, min(relation_id) AS first_id, max(relation_id) AS last_id FROM c GROUP BY 1")
def relation_candidates(spark, d):
    found = relations(spark, d, cap=None)
    return found.groupBy("relation_type").agg(F.count("*").alias("n"), F.count_distinct("qa_id").alias("n_qa"), F.min("relation_id").alias("first_id"), F.max("relation_id").alias("last_id"))


@case("candidate_cap", f"WITH {S_RELATIONS} SELECT qa_id, count(*)::BIGINT AS n, max(pair_rank)::INT AS last_rank, max(relation_id) AS top_id FROM c WHERE pair_rank <= 25 GROUP BY qa_id")
def candidate_cap(spark, d):
    return relations(spark, d).groupBy("qa_id").agg(F.count("*").alias("n"), F.max("pair_rank").alias("last_rank"), F.max("relation_id").alias("top_id"))


@case("bidirectional_edges", f"WITH {S_ALL_EDGES} SELECT edge_id, relation_id, graph_relation_type, edge_direction, source_entity_id, target_entity_id, confidence FROM e")
def bidirectional_edges(spark, d):
    return edges(spark, d, cap=None).select("edge_id", "relation_id", "graph_relation_type", "edge_direction", "source_entity_id", "target_entity_id", "confidence")


@case(
    "graph_counts",
    f"""WITH {S_EDGES} SELECT 'entity' AS part, entity_type AS label, count(DISTINCT entity_id)::BIGINT AS n FROM m GROUP BY 2 UNION ALL SELECT 'mention', entity_type, count(*) FROM m GROUP BY 2
    UNION ALL SELECT 'edge', graph_relation_type, count(*) FROM e GROUP BY 2""",
)
def graph_counts(spark, d):
    m = mentions(spark, d)
    parts = [m.groupBy(F.lit("entity").alias("part"), F.col("entity_type").alias("label")).agg(F.count_distinct("entity_id").alias("n")), m.groupBy(F.lit("mention").alias("part"), F.col("entity_type").alias("label")).agg(F.count("*").alias("n"))]
    e = edges(spark, d).groupBy(F.lit("edge").alias("part"), F.col("graph_relation_type").alias("label")).agg(F.count("*").alias("n"))
    return parts[0].unionByName(parts[1]).unionByName(e)


@case("relation_types", f"WITH {S_EDGES} SELECT DISTINCT graph_relation_type FROM e")
def relation_types(spark, d):
    return edges(spark, d).select("graph_relation_type").distinct()


@case(
    "graph_validation",
    f"""WITH {S_RELATIONS}, ents AS (SELECT DISTINCT entity_id FROM m WHERE entity_type <> 'Test'), qas AS (SELECT o_orderkey AS qa_id FROM orders WHERE o_orderstatus <> 'P')
    SELECT 'duplicate_entities' AS "check", 0::BIGINT AS n UNION ALL SELECT 'duplicate_mentions', count(*) - count(DISTINCT mention_id) FROM m UNION ALL SELECT 'duplicate_relations', count(*) - count(DISTINCT relation_id) FROM r
    UNION ALL SELECT 'mention_without_entity', count(*) FROM m WHERE entity_id NOT IN (SELECT entity_id FROM ents) UNION ALL SELECT 'mention_without_qa', count(*) FROM m WHERE qa_id NOT IN (SELECT qa_id FROM qas)
    UNION ALL SELECT 'relation_without_source', count(*) FROM r WHERE source_entity_id NOT IN (SELECT entity_id FROM ents) UNION ALL SELECT 'relation_without_target', count(*) FROM r WHERE target_entity_id NOT IN (SELECT entity_id FROM ents)
    UNION ALL SELECT 'relation_without_qa', count(*) FROM r WHERE qa_id NOT IN (SELECT qa_id FROM qas)""",
)
def graph_validation(spark, d):
    m = mentions(spark, d)
    entities = m.filter("entity_type <> 'Test'").select("entity_id").distinct()
    qas = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("qa_id"))
    return gr.validate(entities, m, qas, kept(spark, d))


@case(
    "qa_provenance_fallback",
    """WITH l AS (SELECT l_orderkey AS qa_id, l_suppkey AS src, min(l_linenumber) AS seen, count(*) AS n FROM lineitem GROUP BY ALL),
    mode AS (SELECT qa_id, src FROM l QUALIFY row_number() OVER (PARTITION BY qa_id ORDER BY n DESC, seen, src) = 1),
    names AS (SELECT l_orderkey AS qa_id, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1)
    SELECT mode.qa_id, coalesce(o_orderpriority, 'supplier ' || src) AS question, CASE WHEN o_orderkey IS NULL THEN 'preprocessed_source_row' ELSE 'preprocessed_id' END AS source_quality, flags
    FROM mode JOIN names USING (qa_id) LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = mode.qa_id""",
)
def qa_provenance_fallback(spark, d):
    """Texts by the qa's own id, else by the source that most of its rows name (ties: the first seen)."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qa_id"), F.col("l_suppkey").alias("src"), "l_linenumber", "l_returnflag")
    counts = lines.groupBy("qa_id", "src").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("seen"))
    mode = counts.groupBy("qa_id").agg(F.min_by("src", F.struct(-F.col("n"), F.col("seen"), F.col("src"))).alias("src"))
    names = lines.groupBy("qa_id").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("flags"))
    direct = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("qa_id"), "o_orderpriority")
    out = mode.join(names, "qa_id").join(direct, "qa_id", "left")
    quality = F.when(F.col("o_orderpriority").isNull(), "preprocessed_source_row").otherwise("preprocessed_id")
    return out.select("qa_id", F.coalesce("o_orderpriority", F.concat(F.lit("supplier "), F.col("src").cast("string"))).alias("question"), quality.alias("source_quality"), "flags")


@case(
    "edge_materialize",
    f"""WITH {S_ALL_RELATIONS} SELECT 'MENTIONED_IN' AS edge, count(*)::BIGINT AS n FROM m JOIN orders ON o_orderkey = qa_id AND o_orderstatus = 'F' UNION ALL
    SELECT 'EVIDENCE_FROM', count(*) FROM m WHERE entity_id IN (SELECT DISTINCT entity_id FROM m WHERE kind < 3) UNION ALL SELECT 'MEDICAL_RELATION', count(*) FROM r""",
)
def edge_materialize(spark, d):
    m = mentions(spark, d)
    qas = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("qa_id"))
    entities = m.filter("kind < 3").select("entity_id").distinct()
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("edge"), "n")
    return count(m.join(qas, "qa_id"), "MENTIONED_IN").unionByName(count(m.join(entities, "entity_id"), "EVIDENCE_FROM")).unionByName(count(kept(spark, d, cap=None), "MEDICAL_RELATION"))


@case(
    "graph_upsert",
    """WITH o AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) END AS name, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 5 <> 0)
    SELECT coalesce(n.k, o.k) AS k, coalesce(n.name, o.name) AS name, coalesce(n.bal, o.bal) AS bal FROM o FULL JOIN n ON o.k = n.k""",
)
def graph_upsert(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    new = c.filter("k % 5 <> 0").select("k", F.when(F.col("k") % 2 == 0, F.upper("name")).alias("name"), (F.col("bal") + 1).alias("bal"))
    return gr.upsert(c.filter("k % 3 <> 0"), new, "k")


# Seeds of the walks: the entities whose key is divisible by 100.
_S_SEEDS = "s AS (SELECT DISTINCT entity_id AS seed FROM m WHERE k % 100 = 0 AND kind {kinds})"


def _seeds(spark, d, *kinds):
    """The customers, parts or suppliers whose key is divisible by 100."""
    key = {"customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey"}
    rows = [table(spark, d, k).select(F.col(key[k]).alias("k")).filter("k % 100 = 0").select(F.concat(F.lit(f"{k}:"), F.col("k").cast("string")).alias("entity_id")) for k in kinds]
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])


@case(
    "graph_hop1",
    f"""WITH {S_EDGES}, {_S_SEEDS.format(kinds="IN (0, 2)")}
    SELECT DISTINCT seed AS seed_entity_id, edge_id, graph_relation_type FROM (SELECT * FROM e WHERE edge_direction = 'direct') JOIN s ON seed = source_entity_id
    UNION SELECT DISTINCT seed, edge_id, graph_relation_type FROM (SELECT * FROM e WHERE edge_direction = 'direct') JOIN s ON seed = target_entity_id""",
)
def graph_hop1(spark, d):
    direct = edges(spark, d).filter("edge_direction = 'direct'")
    return gr.hop_edges(direct, _seeds(spark, d, "customer", "part"), 1).select("seed_entity_id", "edge_id", "graph_relation_type")


@case(
    "graph_hop2",
    f"""WITH {S_EDGES}, d AS (SELECT relation_id, source_entity_id AS a, target_entity_id AS b, graph_relation_type FROM e WHERE edge_direction = 'direct'),
    u AS (SELECT relation_id, a, b FROM d UNION ALL SELECT relation_id, b, a FROM d), {_S_SEEDS.format(kinds="= 0")},
    h1 AS (SELECT seed, relation_id, b FROM u JOIN s ON a = seed), v AS (SELECT seed, b, count(DISTINCT relation_id) AS n, min(relation_id) AS only FROM h1 GROUP BY ALL),
    h2 AS (SELECT DISTINCT v.seed, u.relation_id FROM v JOIN u ON u.a = v.b WHERE v.n > 1 OR u.relation_id <> v.only),
    x AS (SELECT seed, relation_id FROM h1 UNION SELECT seed, relation_id FROM h2)
    SELECT seed AS seed_entity_id, relation_id, graph_relation_type FROM x JOIN d USING (relation_id) WHERE graph_relation_type IN ('TREATED_BY', 'HAS_SYMPTOM')""",
)
def graph_hop2(spark, d):
    direct = edges(spark, d).filter("edge_direction = 'direct'")
    found = gr.hop_edges(direct, _seeds(spark, d, "customer"), 2, ["TREATED_BY", "HAS_SYMPTOM"])
    return found.select("seed_entity_id", "relation_id", "graph_relation_type")


def _stored(spark, d) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/adjacency-{uuid.uuid4().hex}"
    direct = edges(spark, d).filter("edge_direction = 'direct'")
    ad.write_adjacency(direct.select("relation_id", "edge_id", "source_entity_id", "target_entity_id", "graph_relation_type"), path)
    return path


@case("stored_hop1", ORACLE_SQL["graph_hop1"])
def stored_hop1(spark, d):
    """graph_hop1 over the stored adjacency."""
    return ad.stored_walk(spark, _stored(spark, d), _seeds(spark, d, "customer", "part"), 1).select("seed_entity_id", "edge_id", "graph_relation_type")


@case("stored_hop2", ORACLE_SQL["graph_hop2"])
def stored_hop2(spark, d):
    """graph_hop2 over the stored adjacency."""
    found = ad.stored_walk(spark, _stored(spark, d), _seeds(spark, d, "customer"), 2, ["TREATED_BY", "HAS_SYMPTOM"])
    return found.select("seed_entity_id", "relation_id", "graph_relation_type")


@case(
    "relation_evidence_top3",
    f"""WITH {S_ALL_RELATIONS}, k AS (SELECT qa_id, mention_id, row_number() OVER (PARTITION BY qa_id ORDER BY mention_id) AS mention_rank FROM m)
    SELECT relation_id, mention_id, mention_rank::INT AS mention_rank FROM r LEFT JOIN (SELECT * FROM k WHERE mention_rank <= 3) k USING (qa_id)""",
)
def relation_evidence_top3(spark, d):
    return gr.first_mentions(kept(spark, d, cap=None), mentions(spark, d)).select("relation_id", "mention_id", "mention_rank")


@case("entity_point_lookup", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 17")
def entity_point_lookup(spark, d):
    return table(spark, d, "part").filter("p_partkey = 17").select("p_partkey", "p_name", "p_brand").limit(1)


@case(
    "entity_link",
    f"""WITH ents AS (SELECT 'part:' || p_partkey AS entity_id, {s_match('p_name')} AS canonical, {s_match('p_brand')} AS alias, CASE WHEN p_size > 25 THEN 'Test' ELSE 'Treatment' END AS kind FROM part),
    q AS (SELECT 'part:' || p_partkey AS phrase_id, CASE p_partkey % 3 WHEN 0 THEN {s_match('p_name')} WHEN 1 THEN {s_match('p_brand')} ELSE 'unknown thing' END AS norm, 'Treatment' AS kind FROM part),
    hit AS (SELECT phrase_id, q.norm, q.kind AS wanted, entity_id, ents.kind, canonical, 'exact_canonical' AS match_type FROM q JOIN ents ON canonical = norm
        UNION ALL SELECT phrase_id, q.norm, q.kind, entity_id, ents.kind, canonical, 'exact_alias' FROM q JOIN ents ON alias = norm AND canonical <> norm),
    ok AS (SELECT * FROM hit WHERE match_type = 'exact_canonical' OR len(list_intersect(string_split(canonical, ' '), string_split(norm, ' '))) > 0),
    z AS (SELECT *, CASE match_type WHEN 'exact_canonical' THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END AS s, kind = wanted AS same FROM ok),
    b AS (SELECT *, max(CASE WHEN same THEN s END) OVER (PARTITION BY phrase_id) AS best FROM z),
    g AS (SELECT phrase_id, count(*) FILTER (WHERE same AND s = best) AS n_best, min(entity_id) FILTER (WHERE same AND s = best) AS entity_id, max(best) AS best, count(*) FILTER (WHERE NOT same) AS n_other FROM b GROUP BY 1)
    SELECT q.phrase_id, CASE WHEN g.phrase_id IS NULL THEN 'unresolved' WHEN n_best = 0 THEN 'type_conflict' WHEN n_best > 1 THEN 'ambiguous' ELSE 'linked' END AS status, CASE WHEN n_best = 1 THEN entity_id END AS entity_id, coalesce(best, 0.0)::DOUBLE AS match_score
    FROM q LEFT JOIN g ON g.phrase_id = q.phrase_id""",
)
def entity_link(spark, d):
    from ..operators.linking import link_phrases

    parts = tx.with_nfkc(table(spark, d, "part"), "p_name", "p_brand")
    norm = lambda c: tx.query_form(F.col(c))
    entities = parts.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity_id"), norm("p_name").alias("canonical"), F.array(norm("p_brand")).alias("aliases"), F.when(F.col("p_size") > 25, "Test").otherwise("Treatment").alias("entity_type"))
    n = F.col("p_partkey") % 3
    text = F.when(n == 0, norm("p_name")).when(n == 1, norm("p_brand")).otherwise("unknown thing")
    phrases = parts.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("phrase_id"), text.alias("norm"), F.lit("Treatment").alias("entity_type"))
    return link_phrases(phrases, entities).select("phrase_id", "status", "entity_id", "match_score")


_NAMES = (
    (1, "Treatment", "رياضة"), (2, "Treatment", "اسبرين"), (3, "Symptom", "التهاب الحلق"), (4, "Treatment", "علاج التهاب"), (5, "Test", "صداع"), (6, "DiseaseCondition", "حمى"), (7, "Treatment", "مضاد هيستامين"), (8, "Treatment", "مرهم موضعي"),
    (9, "Symptom", "العين"), (10, "DiseaseCondition", "مرض"),
)


@case(
    "entity_rules",
    f"""WITH n AS (SELECT p_partkey AS id, coalesce(v.kind, 'Treatment') AS kind, coalesce(v.name, p_name) AS name FROM part LEFT JOIN (VALUES {", ".join(str(x) for x in _NAMES)}) v(k, kind, name) ON v.k = p_partkey % 13)
    SELECT id, CASE WHEN name = 'اسبرين' THEN 'الأسبرين' WHEN kind = 'Treatment' AND name LIKE 'مضاد ه%' THEN 'مضاد الهيستامين' ELSE name END AS canonical,
        CASE WHEN name = 'حمى' OR name = 'صداع' THEN 'Symptom' WHEN contains(name, 'تهاب') AND NOT regexp_matches(name, 'علاج|دواء|مضاد|مرهم') THEN 'DiseaseCondition' ELSE kind END AS entity_type,
        CASE WHEN kind = 'Treatment' AND name IN ('رياضة', 'الرياضة', 'جرعة') THEN 'low' WHEN kind = 'Treatment' AND NOT contains(name, ' ') THEN 'medium' ELSE 'high' END AS quality,
        CASE name WHEN 'العين' THEN 'body_part' WHEN 'مرض' THEN 'generic' END AS rejection FROM n""",
)
def entity_rules(spark, d):
    from ..operators import entity_rules as er

    # a part goes by one of the names, by its key, or by its own
    k = (F.col("p_partkey") % 13).cast("int")
    own = lambda n, other: F.coalesce(F.get(F.array(F.lit(None).cast("string"), *(F.lit(x[n]) for x in _NAMES)), k), other)
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), own(1, F.lit("Treatment")).alias("kind"), own(2, F.col("p_name")).alias("name"), F.array().cast("array<string>").alias("aliases"))
    k, n, a = F.col("kind"), F.col("name"), F.col("aliases")
    return rows.select("id", er.canonical(k, n, a).alias("canonical"), er.corrected_type(k, n, a).alias("entity_type"), er.quality(k, n, a).alias("quality"), er.rejection(n).alias("rejection"))


@case("entities_by_version", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#11'")
def entities_by_version(spark, d):
    """A scan of one label and version: the filter reaches the Parquet scan."""
    return table(spark, d, "part").filter("p_brand = 'Brand#11'").select("p_partkey", "p_name")


@case(
    "vector_support",
    """WITH h AS (SELECT vec_id % 50 AS query_id, label AS entity_id, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / (1 + vec_id % 7) AS score FROM embeddings) SELECT query_id, entity_id, round(max(score), 6) AS support FROM h GROUP BY ALL""",
)
def vector_support(spark, d):
    from ..functions.similarity import dot
    from ..operators.retrieval import support

    v = table(spark, d, "embeddings")
    hits = v.select((F.col("vec_id") % 50).alias("query_id"), F.col("label").alias("entity_id"), (dot(F.col("embedding"), F.col("embedding")) / (1 + F.col("vec_id") % 7)).alias("score"))
    return support(hits, "entity_id").withColumn("support", F.round("support", 6))


@case(
    "seed_scores",
    f"""WITH p AS (SELECT p_partkey, {s_match('p_name')} AS norm, p_partkey // 100 * 100 AS query_id FROM part), prim AS (SELECT query_id, 'e' || p_partkey AS entity_id FROM p WHERE p_partkey = query_id AND query_id // 100 % 4 = 1),
    h AS (SELECT query_id, 'e' || p_partkey AS entity_id, norm AS title, 0.8::DOUBLE + (p_partkey % 19) / 100.0::DOUBLE AS score, p_partkey AS ordinal FROM p), q AS (SELECT query_id, norm FROM p WHERE p_partkey = query_id),
    o AS (SELECT h.*, q.norm, string_split(title, ' ') AS t, string_split(q.norm, ' ') AS n FROM h JOIN q USING (query_id) WHERE query_id NOT IN (SELECT query_id FROM prim) AND score >= 0.86),
    i AS (SELECT *, len(list_intersect(list_filter(t, lambda x: length(x) > 2), list_filter(n, lambda x: length(x) > 2))) / least(len(list_distinct(list_filter(t, lambda x: length(x) > 2))), len(list_distinct(list_filter(n, lambda x: length(x) > 2)))) AS ident FROM o),
    r AS (SELECT query_id, entity_id, score FROM i WHERE ident >= 0.86 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) <= 2)
    SELECT query_id, entity_id, 1.0::DOUBLE AS seed_score FROM prim UNION ALL SELECT query_id, entity_id, round(least(0.70, 0.75 * score), 9)::DOUBLE FROM r""",
)
def seed_scores(spark, d):
    """Each part is a hit of the query of its hundred; the queries are the parts whose key is divisible by 100."""
    from ..operators.retrieval import seed_scores as run

    p = table(spark, d, "part").select("p_partkey", tx.query_form(F.col("p_name")).alias("norm"), F.expr("p_partkey div 100 * 100").alias("query_id"), F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("entity_id"))
    hits = p.select("query_id", "entity_id", F.col("norm").alias("title"), F.lit("Treatment").alias("entity_type"), (0.8 + F.col("p_partkey") % 19 / 100.0).alias("score"), F.col("p_partkey").alias("ordinal"))
    phrases = p.filter("p_partkey = query_id").select("query_id", "norm", F.lit("Treatment").alias("entity_type"))
    return run(p.filter("p_partkey = query_id AND query_id div 100 % 4 = 1"), hits, phrases).withColumn("seed_score", F.round("seed_score", 9))
