"""Queries on text normalisation, terms and corpus preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as rec, similarity as sim, terms as tm, text as tx
from ..operators import corpus
from ..sources.stages import materialise
from .registry import QA_PAIRS, case, s_clean, s_dedupe, s_letters, s_list, s_match, s_tokens, table, texts

# Arabic samples that the tables do not have.
SAMPLES = (
    (1, "ما هو عِلاج التهاب المَعِدة؟؟ عمري ٣٥ سنة"),
    (2, "أعراض فقر الدم ، والصداع !! info@site.org"),
    (3, "هل تحليل السكّري ضروري للحامل منذ ٣ أشهر"),
    (4, "وجع بالرأس وركبتها ـــ  https://a.b/c الإسهال"),
    (5, ""),
    (6, "من هو الطبيب"),
)
#: Every document behind one of the samples, by its key.
_SAMPLED = f"(SELECT d.doc_id AS id, v.text || ' ' || d.text AS text FROM documents d JOIN (VALUES {', '.join(f"({i}, '{t}')" for i, t in SAMPLES)}) AS v(id, text) ON v.id = d.doc_id % {len(SAMPLES)} + 1)"
_VALUES = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in SAMPLES) + ") AS v(id, text)"

#: Terms to look for in documents: canonical name, type, variants.
HINTS = [
    ("connective", "function", ["and the", "and", "und"]),
    ("article", "function", ["the", "der", "la"]),
    ("preposition", "place", ["in the", "in", "of", "de"]),
    ("pronoun", "person", ["they", "he", "we"]),
    ("insult", "tone", ["idiot", "stupid"]),
]


def _samples(spark):
    return spark.createDataFrame(list(SAMPLES), "id int, text string")


def _sampled(spark, d):
    sample = F.element_at(F.array(*(F.lit(t) for _, t in SAMPLES)), (F.col("doc_id") % len(SAMPLES) + 1).cast("int"))
    return texts(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(sample, F.lit(" "), "text").alias("text"))


@case("clean_text", f"SELECT doc_id, {s_clean('text')} AS cleaned, length({s_clean('text')})::BIGINT AS n FROM documents")
def clean_text(spark, d):
    c = tx.clean(F.col("text"))
    return texts(spark, d, "documents").select("doc_id", c.alias("cleaned")).select("doc_id", "cleaned", F.length("cleaned").cast("long").alias("n"))


@case("normalize_dedupe_key", f"SELECT doc_id, {s_dedupe('text')} AS dedupe_key FROM documents")
def normalize_dedupe_key(spark, d):
    return texts(spark, d, "documents").select("doc_id", tx.dedupe_key(F.col("text")).alias("dedupe_key"))


@case("normalize_matching", f"SELECT doc_id, {s_match('text')} AS norm, length(text)::BIGINT AS n_text, length({s_match('text')})::BIGINT AS n_norm FROM documents")
def normalize_matching(spark, d):
    docs = texts(spark, d, "documents").select("doc_id", "text", tx.matching_form(F.col("text")).alias("norm"))
    return docs.select("doc_id", "norm", F.length("text").cast("long").alias("n_text"), F.length("norm").cast("long").alias("n_norm"))


@case(
    "arabic_normalize_literals",
    f"SELECT id, {s_clean('text')} AS cleaned, {s_dedupe('text')} AS dedupe_key, {s_match('text')} AS matching, {s_letters('text')} AS letters FROM {_SAMPLED}",
)
def arabic_normalize_literals(spark, d):
    c = F.col("text")
    return _sampled(spark, d).select("id", tx.clean(c).alias("cleaned"), tx.dedupe_key(c).alias("dedupe_key"), tx.matching_form(c).alias("matching"), tx.letter_form(c).alias("letters"))


@case("query_normalization_steps")
def query_normalization_steps(spark, d):
    fixed = tx.with_nfkc(_sampled(spark, d), "text")
    return tx.with_normalization_steps(fixed, "text", "norm", "steps").select("id", "norm", F.array_join("steps", ",").alias("steps"))


@case(
    "token_stats",
    f"""WITH t AS (SELECT doc_id, {s_tokens(s_match('text'))} AS own FROM documents)
    SELECT doc_id, len(own)::BIGINT AS n_tokens, len(list_distinct(own))::BIGINT AS n_distinct, md5(array_to_string(list_sort(list_distinct(own)), ' ')) AS set_hash FROM t""",
)
def token_stats(spark, d):
    t = texts(spark, d, "documents").select("doc_id", tm.all_tokens(tx.query_form(F.col("text"))).alias("own"))
    t = t.withColumn("kinds", F.array_distinct("own"))
    return t.select("doc_id", F.size("own").cast("long").alias("n_tokens"), F.size("kinds").cast("long").alias("n_distinct"), F.md5(F.array_join(F.array_sort("kinds"), " ").cast("binary")).alias("set_hash"))


_STOP = s_list(tm.QUERY_STOPWORDS)


@case(
    "fts_terms",
    f"""WITH t AS (SELECT item_id AS id, {s_tokens(s_match('text'))} AS own FROM benchmark UNION ALL SELECT 1000000 + id, {s_tokens(s_match('text'))} FROM {_VALUES}),
    l AS (SELECT id, list_filter(own, lambda x: length(x) >= 2) AS own FROM t),
    e AS (SELECT id, unnest(list_filter(own, lambda x: NOT list_contains({_STOP}, x))) AS term, unnest(range(len(list_filter(own, lambda x: NOT list_contains({_STOP}, x))))) AS pos FROM l),
    f AS (SELECT id, term, min(pos) AS pos FROM e GROUP BY ALL),
    g AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY pos) AS place FROM f),
    k AS (SELECT id, string_agg(term, ' ' ORDER BY place) AS terms FROM g WHERE place <= 24 GROUP BY id)
    SELECT l.id::BIGINT AS id, coalesce(k.terms, array_to_string(own[1:24], ' ')) AS terms FROM l LEFT JOIN k ON k.id = l.id""",
)
def fts_terms(spark, d):
    both = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text").unionByName(_samples(spark).select((F.col("id") + 1000000).cast("long").alias("id"), "text"))
    return both.select("id", F.array_join(tm.search_terms(F.col("text")), " ").alias("terms"))


_STRIP = "CASE WHEN starts_with(t, 'بال') AND length(t) > 4 THEN t[4:] WHEN starts_with(t, 'كال') AND length(t) > 4 THEN t[4:] WHEN starts_with(t, 'لل') AND length(t) > 3 THEN t[3:] WHEN starts_with(t, 'ال') AND length(t) > 3 THEN t[3:] ELSE t END"
_CONJ = "CASE WHEN (starts_with(t, 'و') OR starts_with(t, 'ف')) AND length(t) > 3 THEN t[2:] ELSE t END"


@case(
    "term_sets",
    f"""WITH n AS (SELECT id, text, {s_tokens(s_match('text'))} AS own FROM {_SAMPLED}),
    c AS (SELECT *, list_distinct(list_transform(list_filter(own, lambda t: length(t) > 1), lambda t: {_STRIP})) AS content FROM n),
    i AS (SELECT *, list_filter(content, lambda t: NOT list_contains({s_list(tm.IDENTITY_STOPWORDS)}, t) AND length(t) > 2 AND NOT regexp_matches(t, '\\p{{Nd}}')) AS identity FROM c),
    a1 AS (SELECT id, unnest(own) AS t FROM n),
    a2 AS (SELECT id, t FROM a1 UNION SELECT id, {_CONJ} FROM a1 UNION SELECT id, {_STRIP} FROM (SELECT id, {_CONJ} AS t FROM a1)),
    a3 AS (SELECT id, t FROM a2 UNION SELECT id, t[:-2] FROM a2 WHERE length(t) > 3 AND right(t, 1) IN ('ي', 'ك', 'ه') UNION SELECT id, t[:-3] FROM a2 WHERE length(t) > 4 AND right(t, 2) IN ('ها', 'نا')),
    a4 AS (SELECT id, t FROM a3 UNION SELECT id, t[2:] FROM a3 WHERE length(t) > 3 AND left(t, 1) IN ('ب', 'ل')),
    a AS (SELECT id, string_agg(DISTINCT t, ' ' ORDER BY t) AS anatomy FROM a4 WHERE list_contains({s_list(tm.ANATOMY)}, t) GROUP BY id)
    SELECT i.id, array_to_string(list_sort(content), ' ') AS content, array_to_string(list_sort(identity), ' ') AS identity, coalesce(anatomy, '') AS anatomy,
        array_to_string(list_sort(list_concat(list_filter(content, lambda t: list_contains({s_list(tm.CONSTRAINTS)}, t)),
            list_distinct(list_transform(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?'), lambda x: 'number:' || x)))), ' ') AS constraints
    FROM i LEFT JOIN a ON a.id = i.id""",
)
def term_sets(spark, d):
    t = _sampled(spark, d).withColumn("own", tm.token_set(F.col("text")))
    joined = lambda c: F.array_join(F.array_sort(c), " ")
    own = F.col("own")
    return t.select("id", joined(tm.content_terms(own)).alias("content"), joined(tm.identity_tokens(own)).alias("identity"), joined(tm.anatomy_terms(own)).alias("anatomy"), joined(tm.constraint_terms(F.col("text"), own)).alias("constraints"))


_SKIP_ROWS = "rows AS (SELECT doc_id AS row_id, text AS question, lang AS answer, source AS category FROM documents)"


@case(
    "skip_waterfall",
    f"""WITH {_SKIP_ROWS},
    k AS (SELECT row_id, {s_clean('question')} AS question, {s_clean('answer')} AS answer, {s_clean('category')} AS category, {s_dedupe('question')} AS qn, {s_dedupe('answer')} AS an, {s_dedupe('category')} AS cn FROM rows),
    known AS (SELECT DISTINCT {s_dedupe('question')} AS qn, {s_dedupe('answer')} AS an FROM rows WHERE row_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
    e AS (SELECT *, CASE WHEN question = '' OR answer = '' OR category = '' THEN 'empty' WHEN row_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'existing_row'
        WHEN (qn, an) IN (SELECT qn, an FROM known) THEN 'existing_pair' WHEN qn IN (SELECT {s_dedupe('text')} FROM benchmark) THEN 'evaluation_query' END AS early FROM k),
    x AS (SELECT *, early IS NULL AND row_number() OVER (PARTITION BY early IS NULL, question, answer, category ORDER BY row_id) > 1 AS again FROM e),
    y AS (SELECT *, early IS NULL AND NOT again AND row_number() OVER (PARTITION BY early IS NULL, again, qn, an, cn ORDER BY row_id) > 1 AS near FROM x)
    SELECT coalesce(early, CASE WHEN again THEN 'duplicate' WHEN near THEN 'normalized_duplicate' ELSE 'kept' END) AS reason, count(*)::BIGINT AS n FROM y GROUP BY 1""",
)
def skip_waterfall(spark, d):
    rows = texts(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("question"), F.col("lang").alias("answer"), F.col("source").alias("category"))
    known_rows = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("row_id"))
    known = rows.join(known_rows.distinct(), "row_id", "left_semi")
    known_pairs = known.select(tx.dedupe_key(F.col("question")).alias("question_norm"), tx.dedupe_key(F.col("answer")).alias("answer_norm"))
    held = table(spark, d, "benchmark").select(tx.dedupe_key(F.col("text")).alias("question_norm"))
    found = corpus.skip_reasons(rows, known_rows, known_pairs, known_pairs.limit(0), held)
    return found.groupBy("reason").agg(F.count("*").alias("n"))


@case(
    "dedup_exact_then_normalized",
    f"""WITH a AS (SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)
    SELECT doc_id FROM a QUALIFY row_number() OVER (PARTITION BY {s_dedupe('text')} ORDER BY doc_id) = 1""",
)
def dedup_exact_then_normalized(spark, d):
    docs = texts(spark, d, "documents").select("doc_id", "text")
    return corpus.first_of(corpus.first_of(docs, ["text"], ["doc_id"]), [tx.dedupe_key(F.col("text"))], ["doc_id"]).select("doc_id")


@case(
    "dedup_content_hash",
    f"""WITH {QA_PAIRS}, h AS (SELECT qa_id, sha256({s_match('question')} || chr(10) || {s_match('answer')} || chr(10) || 'chat') AS content_hash FROM qa)
    SELECT content_hash, min(qa_id) AS qa_id FROM h GROUP BY 1""",
)
def dedup_content_hash(spark, d):
    qa = corpus.qa_pairs(table(spark, d, "conversations"))
    hashed = qa.select("qa_id", rec.content_hash(tx.query_form(F.col("question")), tx.query_form(F.col("answer")), F.lit("chat")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("qa_id").alias("qa_id"))


@case(
    "holdout_overlap_check",
    f"""WITH held AS (SELECT DISTINCT {s_dedupe('text')} AS k FROM benchmark), docs AS (SELECT doc_id, {s_dedupe('text')} AS k FROM documents)
    SELECT 'documents_in_holdout' AS "check", count(*)::BIGINT AS n FROM docs WHERE k IN (SELECT k FROM held)
    UNION ALL SELECT 'kept_in_holdout', count(*) FROM docs WHERE k NOT IN (SELECT k FROM held) AND k IN (SELECT k FROM held)
    UNION ALL SELECT 'labelled_documents', count(*) FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)""",
)
def holdout_overlap_check(spark, d):
    key = F.unhex(F.sha2(tx.dedupe_key(F.col("text")).cast("binary"), 256)).alias("k")
    docs = materialise(texts(spark, d, "documents").select("doc_id", key))  # read by three checks
    held = table(spark, d, "benchmark").select(key).distinct()
    kept = docs.join(held, "k", "left_anti")
    return corpus.overlaps({"documents_in_holdout": (docs, held, ["k"]), "kept_in_holdout": (kept, held, ["k"]), "labelled_documents": (docs, table(spark, d, "labels"), ["doc_id"])})


@case(
    "benchmark_containment",
    """WITH hits AS (SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))
    SELECT doc_id, count(*)::BIGINT AS n_items, CASE WHEN count(*) = 1 THEN min(item_id) END AS only_item FROM hits GROUP BY doc_id""",
)
def benchmark_containment(spark, d):
    """Which item's text a document holds; resolved only if it is one."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("needle"))
    hits = corpus.contained(texts(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", items, "item_id", "needle")
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.when(F.count("*") == 1, F.min("item_id")).alias("only_item"))


@case(
    "balanced_sample",
    """WITH r AS (SELECT doc_id, lang, md5('7:' || doc_id::VARCHAR) AS h FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) > (SELECT greatest(1, 300 // count(DISTINCT lang)) FROM documents) AS late FROM r)
    SELECT doc_id, lang FROM k ORDER BY late, CASE WHEN late THEN '' ELSE lang END, h, doc_id LIMIT 300""",
)
def balanced_sample(spark, d):
    return corpus.balanced_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 300, "7")


@case("category_distribution", "SELECT source, lang, count(*)::BIGINT AS n, count(DISTINCT text)::BIGINT AS n_texts FROM documents GROUP BY ALL")
def category_distribution(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_texts"))


def _s_hints(source: str, key: str) -> str:
    """One branch for each term: its longest variant found between word boundaries."""
    branches = []
    for place, (name, kind, variants) in enumerate(HINTS):
        arms = " ".join(f"WHEN regexp_matches(norm, '(^|[^\\p{{L}}\\p{{N}}_]){v}($|[^\\p{{L}}\\p{{N}}_])') THEN '{v}'" for v in sorted(sorted(variants), key=len, reverse=True))
        branches.append(f"SELECT {key}, {place} AS term, '{name}' AS canonical, '{kind}' AS type, CASE {arms} END AS matched_variant FROM {source}")
    return "SELECT * FROM (" + " UNION ALL ".join(branches) + ") WHERE matched_variant IS NOT NULL"


def _hints(spark, d):
    docs = texts(spark, d, "documents").select("doc_id", tx.matching_form(F.col("text")).alias("norm"))
    return corpus.detect_hints(docs, "doc_id", F.col("norm"), HINTS)


_NORM = f"n AS (SELECT doc_id, {s_match('text')} AS norm FROM documents)"


@case("hint_detection", f"WITH {_NORM} SELECT doc_id, term, canonical, type, matched_variant FROM ({_s_hints('n', 'doc_id')})")
def hint_detection(spark, d):
    return _hints(spark, d)


@case(
    "hint_top",
    f"WITH {_NORM}, h AS ({_s_hints('n', 'doc_id')}) SELECT coalesce(type, '*') AS type, canonical, count(*)::BIGINT AS n FROM h GROUP BY GROUPING SETS ((type, canonical), (canonical))",
)
def hint_top(spark, d):
    """Counts of each term within its type and, as type "*", over all types."""
    grouped = _hints(spark, d).groupBy("canonical", "type").agg(F.count("*").alias("n"))
    every = grouped.groupBy(F.lit("*").alias("type"), "canonical").agg(F.sum("n").alias("n"))
    return grouped.select("type", "canonical", "n").unionByName(every)


@case(
    "length_stats",
    "SELECT lang, round(avg(length(text)), 2) AS avg_len, max(length(text))::BIGINT AS max_len, count(*) FILTER (WHERE length(text) > 2500)::BIGINT AS n_long, count(DISTINCT source)::BIGINT AS n_sources FROM documents GROUP BY lang",
)
def length_stats(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.round(F.avg(n), 2).alias("avg_len"), F.max(n).cast("long").alias("max_len"), F.count_if(n > 2500).alias("n_long"), F.count_distinct("source").alias("n_sources"))


_PIECE = "'[QA_ID: ' || doc_id::VARCHAR || ' | SOURCE_ROW: ' || doc_id::VARCHAR || ']' || chr(10) || 'Category: ' || source || ' (' || lang || ')' || chr(10) || 'Question: ' || text"
_S_CHUNKS = f"""p AS (SELECT doc_id, source, lang, {_PIECE} AS piece, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS pos FROM documents),
    walk AS (
        SELECT doc_id, source, lang, piece, pos, 0 AS chunk, 1 AS n, length(piece)::BIGINT AS chars FROM p WHERE pos = 1
        UNION ALL
        SELECT p.doc_id, p.source, p.lang, p.piece, p.pos, CASE WHEN w.n >= 8 OR w.chars + length(p.piece) > 6500 THEN w.chunk + 1 ELSE w.chunk END,
            CASE WHEN w.n >= 8 OR w.chars + length(p.piece) > 6500 THEN 1 ELSE w.n + 1 END,
            CASE WHEN w.n >= 8 OR w.chars + length(p.piece) > 6500 THEN length(p.piece) ELSE w.chars + length(p.piece) END
        FROM walk w JOIN p ON p.source = w.source AND p.lang = w.lang AND p.pos = w.pos + 1),
    chunks AS (SELECT source, lang, chunk, count(*) AS row_count, string_agg(piece, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id) AS body FROM walk GROUP BY ALL)"""


def _chunks(spark, d):
    t = lambda s: F.lit(s)
    key = F.col("doc_id").cast("string")
    piece = F.concat(t("[QA_ID: "), key, t(" | SOURCE_ROW: "), key, t("]\nCategory: "), "source", t(" ("), "lang", t(")\nQuestion: "), "text")
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", piece.alias("piece")).withColumn("size", F.length("piece"))
    placed = corpus.chunk_numbers(rows, ["source", "lang"], "doc_id", "size")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "piece"))), lambda p: p["piece"]), corpus.SEPARATOR)
    return placed, placed.groupBy("source", "lang", "chunk").agg(F.count("*").alias("row_count"), body.alias("body"))


@case(
    "chunk_pack",
    f"WITH RECURSIVE {_S_CHUNKS} SELECT source, lang, chunk::INT AS chunk, row_count::BIGINT AS row_count, length(body)::BIGINT AS char_count, length(body) > 6500 AS oversized, md5(body) AS body_hash FROM chunks",
)
def chunk_pack(spark, d):
    n = F.length("body")
    return _chunks(spark, d)[1].select("source", "lang", "chunk", "row_count", n.cast("long").alias("char_count"), (n > corpus.CHUNK_CHARS).alias("oversized"), F.md5(F.col("body").cast("binary")).alias("body_hash"))


@case(
    "chunk_report",
    f"""WITH RECURSIVE {_S_CHUNKS} SELECT lang, count(*)::BIGINT AS n, round(avg(row_count), 2) AS avg_rows, max(row_count)::BIGINT AS max_rows, round(avg(length(body)), 2) AS avg_chars,
    max(length(body))::BIGINT AS max_chars, count(*) FILTER (WHERE length(body) > 6500)::BIGINT AS oversized, count(*) FILTER (WHERE length(body) > 6500 AND row_count = 1)::BIGINT AS oversized_single FROM chunks GROUP BY lang""",
)
def chunk_report(spark, d):
    n = F.length("body")
    over = n > corpus.CHUNK_CHARS
    return _chunks(spark, d)[1].groupBy("lang").agg(
        F.count("*").alias("n"), F.round(F.avg("row_count"), 2).alias("avg_rows"), F.max("row_count").alias("max_rows"), F.round(F.avg(n), 2).alias("avg_chars"),
        F.max(n).cast("long").alias("max_chars"), F.count_if(over).alias("oversized"), F.count_if(over & (F.col("row_count") == 1)).alias("oversized_single"),
    )


@case(
    "chunk_hint_topk",
    f"""WITH RECURSIVE {_S_CHUNKS}, {_NORM}, h AS ({_s_hints('n', 'doc_id')}),
    c AS (SELECT w.source, w.lang, w.chunk, h.canonical, count(*) AS n, min(w.pos * 100 + h.term) AS seen FROM walk w JOIN h ON h.doc_id = w.doc_id GROUP BY ALL)
    SELECT source, lang, chunk::INT AS chunk, canonical, n::BIGINT AS n, (row_number() OVER (PARTITION BY source, lang, chunk ORDER BY n DESC, seen))::INT AS rank FROM c
    QUALIFY rank <= 3""",
)
def chunk_hint_topk(spark, d):
    from pyspark.sql.window import Window

    placed = _chunks(spark, d)[0].select("doc_id", "source", "lang", "chunk")
    pos = placed.withColumn("pos", F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id")))
    counts = pos.join(_hints(spark, d), "doc_id").groupBy("source", "lang", "chunk", "canonical").agg(F.count("*").alias("n"), F.min(F.col("pos") * 100 + F.col("term")).alias("seen"))
    return corpus.largest_groups(counts, ["source", "lang", "chunk"], [F.desc("n"), F.col("seen")], 3).drop("seen")


@case(
    "evidence_origin",
    f"""WITH {QA_PAIRS}, n AS (SELECT qa_id, {s_match('question')} AS q, {s_match('answer')} AS a FROM qa),
    e AS (SELECT *, CASE qa_id % 3 WHEN 0 THEN left(q, 20) WHEN 1 THEN left(a, 20) ELSE 'zzz' END AS x FROM n)
    SELECT qa_id, CASE WHEN x = '' THEN 'unknown' WHEN a <> '' AND contains(a, x) AND NOT (q <> '' AND contains(q, x)) THEN 'answer' WHEN q <> '' AND contains(q, x) AND NOT (a <> '' AND contains(a, x)) THEN 'question'
        WHEN a <> '' AND contains(a, x) THEN 'answer' WHEN q <> '' AND contains(q, x) THEN 'question' ELSE 'unknown' END AS origin, 0.55::DOUBLE AS prior FROM e""",
)
def evidence_origin(spark, d):
    qa = corpus.qa_pairs(table(spark, d, "conversations")).select("qa_id", tx.query_form(F.col("question")).alias("q"), tx.query_form(F.col("answer")).alias("a"))
    x = F.when(F.col("qa_id") % 3 == 0, F.left("q", F.lit(20))).when(F.col("qa_id") % 3 == 1, F.left("a", F.lit(20))).otherwise("zzz")
    quality = F.lit("mention_evidence")
    return qa.withColumn("x", x).select("qa_id", rec.evidence_origin(F.lit(None), F.lit(""), quality, F.col("x"), F.col("q"), F.col("a")).alias("origin"), rec.source_prior(quality).alias("prior"))


@case("fuzzy_tokens")
def fuzzy_tokens(spark, d):
    """Nearly equal words of part names: the pairs an exact join cannot find."""
    names = table(spark, d, "part").select(F.explode(tm.token_set(F.col("p_name"))).alias("t")).distinct()
    return sim.fuzzy_pairs(names, names, 0.78).select("left", "right", F.round("ratio", 6).alias("ratio"))
