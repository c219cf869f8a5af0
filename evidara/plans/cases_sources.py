"""Queries on sources, sinks, records and the checks of model replies: tables go through the engine's own files and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from ..functions import records as rec, terms as tm, text as tx
from ..operators import analysis as an, corpus, entity_rules as er, evidence as ev, extraction as ex, retrieval as rt, search as se
from ..sources import files
from ..sources.stages import materialise, shared_folder
from ..streaming import response_log as log
from .cases_retrieval import S_BM25, asked, qas
from .registry import QA_PAIRS, case, s_list, s_match, table, texts


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CUSTOMER = T.StructType().add("c_custkey", "long").add("c_name", "string").add("c_mktsegment", "string").add("c_acctbal", "double")


@case("csv_round_trip", "SELECT c_custkey, c_name || chr(10) || '\"x\", y' AS c_name, c_mktsegment, c_acctbal FROM customer")
def csv_round_trip(spark, d):
    """Quoted fields with line breaks, written and read by name."""
    path = _folder(spark, "customers")
    rows = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit('\n"x", y')).alias("c_name"), "c_mktsegment", "c_acctbal")
    files.write_table(rows, path, ["c_mktsegment", "c_custkey", "c_name", "c_acctbal"], "csv")
    return files.read_csv(spark, path, _CUSTOMER)


@case("record_numbers", "SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) + 1 AS source_row_number FROM nation")
def record_numbers(spark, d):
    """The records of a file in its order; the header is row 1."""
    path = _folder(spark, "nations")
    files.write_table(table(spark, d, "nation").orderBy("n_nationkey").coalesce(1), path, ["n_nationkey", "n_name"], "csv")
    return files.with_record_numbers(files.read_csv(spark, path, T.StructType().add("n_nationkey", "integer").add("n_name", "string")))


@case("jsonl_round_trip", "SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN text END AS text, 'record' AS kind FROM conversations UNION ALL SELECT conv_id, NULL, NULL, 'no json ' || conv_id, 'bad' FROM conversations WHERE turn = 0")
def jsonl_round_trip(spark, d):
    """JSON lines with nulls kept, and bad lines told from records."""
    path, turns = _folder(spark, "turns"), table(spark, d, "conversations")
    kept = turns.select("conv_id", "turn", "role", F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text"))
    files.write_jsonl(kept, path, ["turn", "conv_id", "role", "text"])
    turns.filter("turn = 0").select(F.concat(F.lit("no json "), F.col("conv_id").cast("string"))).write.mode("append").text(path)
    good, bad = files.read_jsonl(spark, path, T.StructType().add("conv_id", "long").add("turn", "long").add("role", "string").add("text", "string"))
    number = F.element_at(F.split("line", " "), -1).cast("long")
    lost = bad.select(number.alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("line").alias("text"), F.lit("bad").alias("kind"))
    return good.withColumn("kind", F.lit("record")).unionByName(lost)


@case("reliability_samples", "SELECT quality AS label, count(*)::BIGINT AS n, round(sum(toxic / 2.0), 6)::DOUBLE AS total FROM labels GROUP BY 1")
def reliability_samples(spark, d):
    path = _folder(spark, "samples")
    files.write_jsonl(table(spark, d, "labels").select((F.col("toxic") / 2.0).alias("score"), F.col("quality").alias("label")), path, ["score", "label"])
    return files.read_reliability(spark, path).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


@case("dictionary_join", "SELECT c_custkey, CASE WHEN n_nationkey % 3 <> 0 THEN n_name ELSE '' END AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey")
def dictionary_join(spark, d):
    """A translation table from a file; what it lacks is empty."""
    path = _folder(spark, "dictionary")
    nations = table(spark, d, "nation").filter("n_nationkey % 3 <> 0").select(F.col("n_nationkey").cast("string").alias("key"), F.concat(F.lit(" "), "n_name").alias("name"))
    files.write_table(nations.coalesce(1), path, ["key", "name"], "csv")
    names = files.read_dictionary(spark, path, "key", "name")
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("key"))
    return corpus.translated(rows, "key", names, "name", "nation").select("c_custkey", "nation")


@case("replaced_table", "SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def replaced_table(spark, d):
    """A table that takes another's place in one step."""
    path, orders = _folder(spark, "orders"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    files.replace_table(orders.limit(10), path)
    files.replace_table(orders, path, ["o_orderstatus"])
    return files.read_table(spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@case("snapshot_check", "SELECT 'orders' AS name, count(*)::BIGINT AS n FROM orders UNION ALL SELECT 'parts', count(*) FROM part")
def snapshot_check(spark, d):
    """The counts of a snapshot's tables against its manifest."""
    path = _folder(spark, "snapshot")
    counts = files.snapshot_counts({"orders": table(spark, d, "orders"), "parts": table(spark, d, "part")})
    files.write_metadata(spark, f"{path}/manifest.json", {"graph_version": "v1", "counts": counts})
    found = files.check_manifest(spark, f"{path}/manifest.json", "v1", counts)["counts"]
    return spark.createDataFrame(sorted(found.items()), "name string, n long")


@case("index_search", f"WITH {S_BM25.replace(chr(39) + 'chat' + chr(39) + ' FROM qa)', 'unnest([' + chr(39) + 'chat' + chr(39) + ', qa_id::VARCHAR]) FROM qa)')} SELECT query_id, qa_id, position, round(bm25, 6) AS bm25, round(score, 6) AS score, rank FROM found")
def index_search(spark, d):
    """The search over a stored index of a checked version."""
    path = _folder(spark, "index")
    se.write_index(qas(spark, d).withColumn("category", F.concat(F.lit("chat "), F.col("qa_id").cast("string"))), path, "v1")
    postings, stats, records = se.open_index(spark, path, "v1")
    return se.search_qa(records, asked(spark, d), index=(postings, stats)).withColumns({"bm25": F.round("bm25", 6), "score": F.round("score", 6)})


@case(
    "scalar_records",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, value / 10)) END::DOUBLE AS unit, event_type IN ('click', 'view') AS flag, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS named,
        CASE WHEN length(props) > 7 THEN left(props, 7) || '...[truncated]' ELSE props END AS cut, CASE WHEN length(props) > 8 THEN rtrim(left(props, 5)) || '...' ELSE props END AS short FROM events""",
)
def scalar_records(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", rec.unit(F.when(i % 5 == 0, "none").otherwise((F.col("value") / 10).cast("string"))).alias("unit"), rec.flag(F.when(F.col("event_type").isin("click", "view"), F.lit(" Yes ")).otherwise(F.col("event_type"))).alias("flag"),
        rec.null_like(F.when(i % 4 == 0, " NaN ").otherwise(F.concat(F.lit(" "), "event_type"))).alias("named"), tx.truncate(F.col("props"), 7).alias("cut"), tx.compact(F.col("props"), 8).alias("short"),
    )


@case("alias_lists", "SELECT p_partkey, p_brand || ',x' AS names FROM part")
def alias_lists(spark, d):
    raw = F.to_json(F.array(F.concat(F.lit(" "), "p_brand"), F.lit(""), F.col("p_name"), F.lit("x"), F.col("p_brand")))
    return table(spark, d, "part").select("p_partkey", F.array_join(rec.aliases(raw, F.col("p_name")), ",").alias("names"))


@case("repaired_texts", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN text || ' Ø 日' WHEN turn % 3 = 1 THEN text || ' سعال' ELSE text END AS text, turn % 3 = 1 AS misread FROM conversations")
def repaired_texts(spark, d):
    """Every third turn ends with an Arabic word and is read in the wrong encoding, which it shows by its marks, and comes back as it was; every other third shows a mark but was read rightly."""
    turn = F.col("turn") % 3
    rows = texts(spark, d, "conversations").select("conv_id", "turn", F.when(turn == 2, F.concat("text", F.lit(" Ø 日"))).when(turn == 1, F.concat("text", F.lit(" سعال"))).otherwise(F.col("text")).alias("text"))
    wrong = rows.withColumn("text", F.when(turn == 1, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text")))
    return tx.mojibake(wrong.withColumn("misread", F.coalesce(F.col("text").rlike("[ØÙ]"), F.lit(False)) & (turn == 1)), "text")


@case("hourly_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def hourly_counts(spark, d):
    counts = log.windowed_counts(table(spark, d, "events").select("ts", "event_type"), "ts", ["event_type"])
    return counts.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


@case("log_stream", "SELECT user_id::VARCHAR AS request_id, max(event_id) AS ordinal, max_by(event_type, event_id) AS status FROM events GROUP BY user_id")
def log_stream(spark, d):
    """The response log followed as a stream of JSON lines, in two arrivals."""
    root = _folder(spark, "log")
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("request_id"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("status"), F.col("props").alias("response_text"))
    half = rows.agg(F.max("ordinal")).first()[0] // 2
    for part in (rows.filter(F.col("ordinal") <= half), rows.filter(F.col("ordinal") > half)):
        part.write.mode("append").json(f"{root}/in")
        log.follow(spark, f"{root}/in", f"{root}/state", f"{root}/offsets").awaitTermination()
    return log.current(spark, f"{root}/state").select("request_id", "ordinal", "status")


@case("pending_requests", "SELECT DISTINCT user_id::VARCHAR AS request_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def pending_requests(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("request_id"), F.col("event_type").alias("status"))
    return log.pending(rows.select("request_id").distinct(), rows, ("purchase",))


@case(
    "entity_replies",
    """WITH p AS (SELECT *, p_partkey % 7 AS m FROM part), e AS (SELECT p_partkey, m, p_name, CASE m WHEN 1 THEN 'Other' WHEN 2 THEN 'Nonsense' WHEN 3 THEN 'Treatment' ELSE 'Test' END AS kind FROM p WHERE m NOT IN (5, 6))
    SELECT 'kept' AS outcome, kind AS what, CASE WHEN kind = 'Treatment' AND NOT contains(trim(p_name), ' ') THEN 'medium' ELSE 'high' END AS detail, count(*)::BIGINT AS n FROM e WHERE m IN (0, 3) GROUP BY ALL
    UNION ALL SELECT 'error', 'validation', CASE m WHEN 1 THEN 'Rejected accidental entity type: Other' WHEN 2 THEN 'Invalid entity type: Nonsense' ELSE 'No mention in the chunk' END, count(*) FROM e WHERE m IN (1, 2, 4) GROUP BY ALL
    UNION ALL SELECT 'error', 'model_call', 'error', count(*) FROM p WHERE m = 5 GROUP BY ALL UNION ALL SELECT 'error', 'parse', 'no JSON object of the expected form', count(*) FROM p WHERE m = 6 GROUP BY ALL""",
)
def entity_replies(spark, d):
    """A reply for each part, by its key modulo seven one that passes or one of the faults."""
    m, key = F.col("p_partkey") % 7, F.col("p_partkey").cast("string")
    kind = F.when(m == 1, "Other").when(m == 2, "Nonsense").when(m == 3, "Treatment").otherwise("Test")
    mention = F.struct(F.when(m == 4, "elsewhere").otherwise(key).alias("qa_id"), F.lit("x").alias("surface_form"), F.lit("answer").alias("field"), F.lit("x").alias("evidence"))
    entity = F.struct(F.col("p_name").alias("canonical_name"), kind.alias("entity_type"), F.array(F.lit("y")).alias("aliases"), F.array(mention).alias("mentions"), F.lit(0.5).alias("confidence"))
    body = F.to_json(F.struct(key.alias("chunk_id"), F.array(entity).alias("entities")))
    replies = table(spark, d, "part").select(key.alias("chunk_id"), F.when(m == 5, "error").otherwise("ok").alias("status"), F.when(m == 6, "nothing").otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("response_text"))
    good, bad = ex.validate_entities(replies, table(spark, d, "part").select(key.alias("chunk_id"), F.array(key).alias("qa_ids")))
    kept = good.groupBy(F.lit("kept").alias("outcome"), F.col("entity_type").alias("what"), F.col("quality").alias("detail")).agg(F.count("*").alias("n"))
    return kept.unionByName(bad.groupBy(F.lit("error").alias("outcome"), F.col("stage").alias("what"), F.col("error").alias("detail")).agg(F.count("*").alias("n")))


@case(
    "relation_replies",
    """WITH r AS (SELECT o_orderkey, o_orderkey % 4 AS m FROM orders)
    SELECT 'rel' || o_orderkey AS relation_id, CASE m WHEN 0 THEN 'TREATED_BY' ELSE 'HAS_SYMPTOM' END AS relation_type, m <> 2 AS keep, CASE m WHEN 3 THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence, NULL AS error FROM r WHERE m <> 1
    UNION ALL SELECT NULL, NULL, NULL, NULL, 'Unknown relation_id: odd' || o_orderkey FROM r WHERE m = 1""",
)
def relation_replies(spark, d):
    m, key = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    one = F.struct(F.concat(F.when(m == 1, "odd").otherwise("rel"), key).alias("relation_id"), F.when(m == 0, "TREATED_BY").otherwise("NONSENSE").alias("relation_type"), (m != 2).alias("keep"), F.when(m == 3, "high").otherwise("0.5").alias("confidence"))
    replies = table(spark, d, "orders").select(key.alias("chunk_id"), F.lit("ok").alias("status"), F.to_json(F.struct(F.array(one).alias("relations"))).alias("response_text"))
    good, bad = ex.validate_relations(replies, table(spark, d, "orders").select(F.concat(F.lit("rel"), key).alias("relation_id"), F.lit("HAS_SYMPTOM").alias("relation_type")))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return good.select("relation_id", "relation_type", "keep", "confidence", none("string", "error")).unionByName(bad.select(none("string", "relation_id"), none("string", "relation_type"), none("boolean", "keep"), none("double", "confidence"), "error"))


@case(
    "mention_resolution",
    f"""WITH {QA_PAIRS}, m AS (SELECT qa_id AS mention_id, conv_id, left(answer, 25) AS evidence FROM qa)
    SELECT mention_id, min(qa.qa_id) AS qa_id FROM m JOIN qa USING (conv_id) WHERE evidence <> '' AND contains(answer, evidence) GROUP BY 1 HAVING count(DISTINCT qa.qa_id) = 1""",
)
def mention_resolution(spark, d):
    qa = corpus.qa_pairs(table(spark, d, "conversations"))
    mentions = qa.select(F.col("qa_id").alias("mention_id"), F.col("conv_id").alias("chunk_id"), F.left("answer", F.lit(25)).alias("evidence"))
    return er.resolve_by_evidence(mentions, qa.select(F.col("conv_id").alias("chunk_id"), "qa_id", F.col("answer").alias("body")))


@case("distinct_mentions", "SELECT user_id, event_type, min(event_id) AS event_id, min_by(value, event_id) AS value FROM events GROUP BY ALL")
def distinct_mentions(spark, d):
    return corpus.distinct_mentions(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@case("sequence_numbers", "SELECT c_custkey, 'chunk_' || lpad((row_number() OVER (ORDER BY c_mktsegment, c_nationkey, c_custkey))::VARCHAR, 5, '0') AS sequence_id FROM customer")
def sequence_numbers(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return corpus.sequence_ids(rows, ["c_mktsegment", "c_nationkey"], "c_custkey", "chunk_", 5).select("c_custkey", "sequence_id")


@case("joined_texts", "SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY o) AS o_orderpriority FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o FROM orders GROUP BY ALL) GROUP BY 1")
def joined_texts(spark, d):
    return ev.joined_once(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey", "|")


@case(
    "evidence_relations",
    """WITH r AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS relation_id, l_orderkey AS qa_id FROM lineitem), e AS (SELECT 'e' || o_orderkey AS evidence_id, o_orderkey AS qa_id, o_orderkey * 10 + 1 AS named, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.55 ELSE 0.65 END AS prior FROM orders),
    t AS (SELECT relation_id, prior FROM r JOIN e ON named = relation_id UNION ALL SELECT relation_id, prior FROM r JOIN e USING (qa_id))
    SELECT relation_id::VARCHAR AS relation_id, count(*)::BIGINT AS n_evidence, max(prior)::DOUBLE AS source_prior FROM t GROUP BY 1""",
)
def evidence_relations(spark, d):
    """Evidence that names a relation, and evidence of its qa; the best trust in their sources."""
    query = F.lit(1).alias("query_id")
    relations = table(spark, d, "lineitem").select(query, (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("relation_id"), F.col("l_orderkey").alias("qa_id")).distinct()
    quality = F.when(F.col("o_orderstatus") == "F", "preprocessed_id").when(F.col("o_orderstatus") == "O", "mention_evidence").otherwise("unknown")
    evidence = table(spark, d, "orders").select(query, F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("evidence_id"), F.col("o_orderkey").alias("qa_id"), F.array((F.col("o_orderkey") * 10 + 1).cast("string")).alias("relation_ids"), quality.alias("source_quality"))
    counts = ev.of_relations(relations, evidence).groupBy("relation_id").agg(F.count("*").alias("n_evidence"))
    return ev.source_priors(relations, evidence).join(counts, "relation_id").select("relation_id", "n_evidence", "source_prior")


@case(
    "relation_facts",
    """SELECT 'e' || o_orderkey AS evidence_id, string_agg(DISTINCT p_name || ' --IS--> ' || p_brand, '|' ORDER BY p_name || ' --IS--> ' || p_brand) AS facts FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def relation_facts(spark, d):
    """The facts of the relations that evidence names."""
    query = F.lit(1).alias("query_id")
    lines = table(spark, d, "lineitem")
    evidence = lines.groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("relation_ids")).select(query, F.concat(F.lit("e"), F.col("l_orderkey").cast("string")).alias("evidence_id"), "relation_ids")
    facts = table(spark, d, "part").select(query, F.col("p_partkey").cast("string").alias("relation_id"), F.concat("p_name", F.lit(" --IS--> "), "p_brand").alias("fact"))
    return ev.facts_of(evidence, facts).select("evidence_id", F.array_join(F.array_sort(F.array_distinct("facts")), "|").alias("facts"))


@case(
    "authoritative_texts",
    f"""WITH {QA_PAIRS}, n AS (SELECT qa_id, question, answer, {s_match('question')} AS q, {s_match('answer')} AS a, CASE qa_id % 3 WHEN 0 THEN left(question, 20) WHEN 1 THEN left(answer, 20) ELSE 'zzz' END AS t FROM qa),
    k AS (SELECT *, {s_match('t')} AS x FROM n), o AS (SELECT *, contains(a, x) AND a <> '' AND x <> '' AS ia, contains(q, x) AND q <> '' AND x <> '' AS iq FROM k)
    SELECT qa_id, CASE WHEN x = '' THEN 'unknown' WHEN ia AND NOT iq THEN 'answer' WHEN iq AND NOT ia THEN 'question' ELSE 'unknown' END AS origin,
        len(list_distinct(list_filter([CASE WHEN NOT (iq AND NOT ia) THEN trim(t) END, trim(answer)], lambda v: v IS NOT NULL AND v <> '')))::INT AS n_texts FROM o""",
)
def authoritative_texts(spark, d):
    i = F.col("qa_id") % 3
    rows = corpus.qa_pairs(table(spark, d, "conversations")).withColumn("text", F.when(i == 0, F.left("question", F.lit(20))).when(i == 1, F.left("answer", F.lit(20))).otherwise("zzz"))
    return ev.authoritative(rows.withColumn("source_quality", F.lit("preprocessed_id"))).select("qa_id", "origin", F.size("texts").alias("n_texts"))


@case(
    "extraction_report",
    """SELECT 'entity_type' AS part, p_type AS label, count(*)::BIGINT AS n FROM part GROUP BY 2 UNION ALL SELECT 'quality', CASE WHEN p_size < 10 THEN 'low' ELSE 'high' END, count(*) FROM part GROUP BY 2
    UNION ALL SELECT 'entities', 'not_actionable', count(*) FILTER (WHERE p_size < 10) FROM part UNION ALL SELECT 'entities', 'low_confidence', count(*) FILTER (WHERE p_size / 50.0 < 0.5) FROM part
    UNION ALL SELECT 'mentions', 'low_confidence', count(*) FILTER (WHERE l_discount * 10 < 0.5) FROM lineitem UNION ALL SELECT 'model', l_returnflag, count(*) FROM lineitem GROUP BY 2
    UNION ALL SELECT 'chunks', 'with_entities', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'severity', CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END, count(*) FROM events GROUP BY 2
    UNION ALL SELECT 'chunks', 'failed', count(DISTINCT user_id) FROM events WHERE event_type = 'error' UNION ALL SELECT 'rejected', event_type, count(*) FROM events WHERE event_type <> 'error' GROUP BY 2""",
)
def extraction_report(spark, d):
    entities = table(spark, d, "part").select(F.col("p_type").alias("entity_type"), F.when(F.col("p_size") < 10, "low").otherwise("high").alias("quality"), (F.col("p_size") / 50.0).alias("avg_confidence"))
    mentions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_returnflag").alias("model"), (F.col("l_discount") * 10).alias("confidence"))
    bad = F.col("event_type") == "error"
    errors = table(spark, d, "events").select(F.col("user_id").alias("chunk_id"), F.when(bad, "error").otherwise("warning").alias("severity"), F.when(bad, "Call failed").otherwise(F.concat(F.lit("Rejected "), "event_type", F.lit(": x"))).alias("error"))
    return ev.extraction_report(entities, mentions, errors)


@case(
    "query_analysis",
    """WITH q AS (SELECT c_custkey AS query_id, c_custkey % 8 AS m, c_name FROM customer)
    SELECT query_id, CASE WHEN m IN (1, 2, 3, 4) THEN 'fallback' ELSE 'model' END AS analysis_status, CASE WHEN m IN (1, 2, 3, 4) THEN 'unclear_intent' WHEN m = 5 THEN 'non_medical' ELSE 'general_medical_advice' END AS primary_intent,
        CASE m WHEN 1 THEN 'reply.refused:reply.no_object' WHEN 2 THEN 'reply.refused:complexity.unknown:huge' WHEN 3 THEN 'reply.refused:confidence.range' WHEN 4 THEN 'reply.refused:warnings.absent'
            WHEN 6 THEN 'phrase[1].surface_form.not_there' ELSE '' END AS warnings, (m IN (0, 7))::INT AS n_phrases FROM q""",
)
def query_analysis(spark, d):
    """A reply for each customer's name as a query, by its key modulo eight one that passes or one of the faults."""
    m, name = F.col("c_custkey") % 8, F.col("c_name")
    phrase = F.struct(F.when(m == 6, "elsewhere").otherwise(name).alias("surface_form"), F.lower(F.when(m == 6, "elsewhere").otherwise(name)).alias("normalized_form"), F.lit("Test").alias("entity_type"), F.lit("corrected_query").alias("source"), F.lit(0.5).alias("confidence"))
    fields = [
        name.alias("corrected_query"), name.alias("reformulated_query"), F.when(m == 5, "non_medical").otherwise("simple_medical").alias("query_class"), F.when(m == 2, "huge").otherwise("low").alias("complexity"), F.lit("general_medical_advice").alias("primary_intent"),
        F.array().cast("array<string>").alias("secondary_intents"), F.when(m == 5, F.array().cast("array<struct<surface_form: string, normalized_form: string, entity_type: string, source: string, confidence: double>>")).otherwise(F.array(phrase)).alias("medical_phrases"), F.when(m == 3, 7.0).otherwise(0.5).alias("confidence"),
    ]
    whole, part = F.to_json(F.struct(*fields, F.array().cast("array<string>").alias("warnings"))), F.to_json(F.struct(*fields))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), name.alias("original_query"), tx.query_form(name).alias("normalized_query"), F.when(m == 1, "none").when(m == 4, part).otherwise(whole).alias("reply"))
    analysis, phrases = an.validate(materialise(rows))
    n = phrases.groupBy("query_id").agg(F.count("*").cast("int").alias("n_phrases"))
    return analysis.join(n, "query_id", "left").select("query_id", "analysis_status", "primary_intent", F.array_join("warnings", "|").alias("warnings"), F.coalesce("n_phrases", F.lit(0)).alias("n_phrases"))


_SAID = ((1, "ما هذا", "شرح", "سعال"), (2, "اشعر بالم", "علاج الالم", "سعال"), (3, "تعبان؟", "تحليل دم", "سعال"), (4, "علاج", "علاج", "الالتهاب"), (5, "وجع", "وجع", "دواء"))
_GENERAL = s_list(sorted({*tm.GENERIC_PHRASES, *an._plain(tm.GENERIC_PHRASES)}))


@case(
    "intent_predicates",
    f"""WITH v AS (SELECT o_orderkey AS id, v.q || ' ' || o_orderkey AS q, v.r, CASE WHEN o_orderkey % 10 < 5 THEN v.name ELSE v.name || ' ' || o_orderkey END AS name FROM orders JOIN (VALUES {", ".join(str(x) for x in _SAID)}) v(k, q, r, name) ON v.k = o_orderkey % 5 + 1),
    f AS (SELECT *, {s_match('q')} AS qn, {s_match('r')} AS rn, {s_match('name')} AS t FROM v)
    SELECT id, len(list_intersect(string_split_regex(trim(regexp_replace(q, '[؟?]', ' ? ', 'g')), '\\s+'), {s_list(an.QUESTION_MARKERS)})) > 0 AS opened, {" OR ".join(f"(contains(rn, '{w}') AND NOT contains(qn, '{w}'))" for w in an._plain(an.INTENT_TERMS))} AS added,
        list_contains({_GENERAL}, t) OR (starts_with(t, 'ال') AND list_contains({_GENERAL}, t[3:])) AS generic FROM f""",
)
def intent_predicates(spark, d):
    """What is said of each order, by its key: whether it asks, brings in an intent, names something too general."""
    part = lambda n: F.element_at(F.array(*(F.lit(x[n]) for x in _SAID)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    key = F.concat(F.lit(" "), F.col("o_orderkey"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(part(1), key).alias("q"), part(2).alias("r"), F.when(F.col("o_orderkey") % 10 < 5, part(3)).otherwise(F.concat(part(3), key)).alias("name"))
    form = lambda c: tx.query_form(F.col(c))
    return rows.select("id", an.asks_openly(F.col("q")).alias("opened"), an.new_intent(form("q"), form("r")).alias("added"), an.low_specificity(form("name"), form("name")).alias("generic"))


@case("ordered_unions", "SELECT user_id, string_agg(w, ',' ORDER BY o) AS warnings FROM (SELECT user_id, event_type AS w, min(event_id) AS o FROM events GROUP BY ALL) GROUP BY 1")
def ordered_unions(spark, d):
    """The distinct values of two lists in the order of their first occurrence."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("all"))
    half = F.ceil(F.size("all") / 2).cast("int")
    return rows.select("user_id", F.array_join(an.ordered_union(F.slice("all", 1, half), F.array(F.lit("")), F.slice("all", 1, F.size("all"))), ",").alias("warnings"))


@case("relevance_anchors", "SELECT o_custkey AS query_id, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS phrases FROM (SELECT *, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS core FROM orders) WHERE core = 0 OR o_orderstatus = 'F' GROUP BY 1")
def relevance_anchors(spark, d):
    """The phrases that anchor a query: conditions and symptoms stand for it if there are any."""
    kind = F.when(F.col("o_orderstatus") == "F", "Symptom").otherwise("Treatment")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("norm"), kind.alias("entity_type"), F.lit("treatment_request").alias("primary_intent"))
    return rt.relevance_phrases(rows).select("query_id", F.array_join(F.array_sort("phrases"), "|").alias("phrases"))


@case("fallback_gate", "SELECT c_custkey, c_custkey % 5 NOT IN (0, 1) AND c_custkey % 3 <> 0 AS eligible FROM customer")
def fallback_gate(spark, d):
    i = F.col("c_custkey")
    kind = F.when(i % 5 == 0, "non_medical").when(i % 5 == 1, "unclear").otherwise("simple_medical")
    return table(spark, d, "customer").select("c_custkey", rt.needs_fallback(kind, i % 3 != 0, F.lit(0), F.lit(0), tm.token_set(F.col("c_name"))).alias("eligible"))


@case("stamped_vectors", "SELECT vec_id, 'm' AS embedding_model, 64 AS embedding_dimension, 'v1' AS embedding_graph_version, 'QARecord' AS embedding_document_type FROM embeddings")
def stamped_vectors(spark, d):
    return rt.stamp_embeddings(table(spark, d, "embeddings"), "m", "v1", "QARecord").drop("embedding_created_at", "embedding", "label")


@case("holdout_questions", f"SELECT DISTINCT {s_match('text')} AS question_norm FROM benchmark WHERE item_id % 2 = 0 AND {s_match('text')} <> ''")
def holdout_questions(spark, d):
    splits = table(spark, d, "benchmark").select(F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, "eval_test").otherwise("train").alias("split"))
    return files.holdout_questions(splits)
