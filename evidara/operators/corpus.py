"""Corpus preparation: question-answer pairs, exclusion waterfall, duplicates, samples, hints, chunks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.stages import materialise

CHUNK_ROWS, CHUNK_CHARS = 8, 6500
SEPARATOR = "\n\n---\n\n"


def qa_pairs(conversations: DataFrame) -> DataFrame:
    """qa_id, question, answer: each user turn with the assistant turn after it."""
    user = conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return user.join(reply, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("qa_id"), "conv_id", "question", "answer")


def first_of(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def skip_reasons(rows: DataFrame, known_rows: DataFrame, known_pairs: DataFrame, held_pairs: DataFrame, held_questions: DataFrame) -> DataFrame:
    """row_id, reason for rows (row_id, question, answer, category): why a row is left out, the first that applies, or "kept".

    known_rows: row_id; known_pairs, held_pairs: question_norm, answer_norm; held_questions: question_norm. Duplicates are told by the exact texts first,
    then, among first rows, by their normal forms; only rows without an earlier reason count as seen. Texts become hashes in the scan; first rows are found by partial minima and
    joined by row_id, so neither texts nor the rows of a common text meet in a task.
    """
    sign = lambda *c: F.md5(F.concat_ws("\x01", *c).cast("binary"))
    cleaned = rows.select("row_id", *(tx.clean(F.col(c)).alias(c) for c in ("question", "answer", "category")))
    keyed = cleaned.select("*", *(tx.dedupe_key(F.col(c)).alias(f"{c}_norm") for c in ("question", "answer", "category")))
    empty = (F.col("question") == "") | (F.col("answer") == "") | (F.col("category") == "")
    hashed = materialise(keyed.select(
        "row_id", empty.alias("empty"), sign("question", "answer", "category").alias("exact"), sign("question_norm").alias("asked"), sign("question_norm", "answer_norm").alias("pair"),
        sign("question_norm", "answer_norm", "category_norm").alias("near"),
    ))
    mark = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    joined = hashed.join(mark(known_rows, "row_id", "_row"), "row_id", "left")
    joined = joined.join(mark(known_pairs.select(sign("question_norm", "answer_norm").alias("pair")), "pair", "_pair"), "pair", "left")
    joined = joined.join(mark(held_pairs.select(sign("question_norm", "answer_norm").alias("pair")), "pair", "_held"), "pair", "left")
    joined = joined.join(mark(held_questions.select(sign("question_norm").alias("asked")), "asked", "_query"), "asked", "left")
    early = F.when(F.col("empty"), "empty").when(F.col("_row"), "existing_row").when(F.col("_pair"), "existing_pair").when(F.col("_held"), "evaluation_pair").when(F.col("_query"), "evaluation_query")
    staged = materialise(joined.select("row_id", "exact", "near", early.alias("early")))
    first = staged.filter("early IS NULL").groupBy("exact").agg(F.min(F.struct("row_id", "near")).alias("f")).select("f.row_id", "f.near")
    kept = first.groupBy("near").agg(F.min("row_id").alias("row_id")).select("row_id", F.lit(True).alias("_kept"))
    again = first.select("row_id", F.lit(True).alias("_first"))
    late = F.when(F.col("_kept"), "kept").when(F.col("_first"), "normalized_duplicate").otherwise("duplicate")
    return staged.join(again, "row_id", "left").join(kept, "row_id", "left").select("row_id", F.coalesce("early", late).alias("reason"))


def balanced_sample(rows: DataFrame, category: str, key: str, target: int, seed: str) -> DataFrame:
    """target rows: a quota of each category first, the rest from what is left; order by a hash of seed and key, so samples repeat.

    Each task keeps no more than the quota of a category and twice the target overall; only those rows move.
    """
    order = F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")).cast("binary"))
    hashed = rows.withColumn("_hash", order)
    count = rows.agg(F.count_distinct(category)).first()[0]
    quota = max(1, target // max(1, count))
    ranked = hashed.withColumn("_rank", F.row_number().over(Window.partitionBy(category).orderBy("_hash", key))).filter(F.col("_rank") <= quota).drop("_rank")
    early = ranked.orderBy(category, "_hash", key).limit(target)
    taken = early.select(F.col(key).alias("_key"), F.col("_hash").alias("_taken"))
    rest = hashed.orderBy("_hash", key).limit(2 * target).join(taken, (F.col(key).eqNullSafe(F.col("_key"))) & (F.col("_hash") == F.col("_taken")), "left_anti")
    both = early.withColumn("_late", F.lit(0)).unionByName(rest.withColumn("_late", F.lit(1)))
    chosen = both.orderBy("_late", F.when(F.col("_late") == 0, F.col(category)).otherwise(F.lit("")), "_hash", key).limit(target)
    return chosen.drop("_hash", "_late")


def detect_hints(rows: DataFrame, key: str, text: Column, dictionary: list[tuple[str, str, list[str]]]) -> DataFrame:
    """key, canonical, type, matched_variant, term: dictionary terms found on word boundaries; the longest variant of a term that occurs stands for it.

    The dictionary is a fixed list, so it becomes one expression over each row instead of a join; a pattern runs only where its words are somewhere in the text,
    but not between spaces, which settles it; it looks for the words before their edges.
    """
    edge = rf"[{tx.WORD}]"
    stands = lambda v: F.contains(text, F.lit(f" {v} ")) | (F.contains(text, F.lit(v)) & text.rlike(rf"\Q{v}\E(?!{edge})(?<!{edge}\Q{v}\E)"))
    found = []
    for place, (canonical, kind, variants) in enumerate(dictionary):
        hit = F.lit(None).cast("string")
        for v in reversed(sorted(sorted(set(variants)), key=len, reverse=True)):  # at a tie the first by name
            hit = F.when(stands(v), F.lit(v)).otherwise(hit)
        found.append(F.struct(F.lit(place).alias("term"), F.lit(canonical).alias("canonical"), F.lit(kind).alias("type"), hit.alias("matched_variant")))
    hits = F.filter(F.array(*found), lambda h: h["matched_variant"].isNotNull())
    return rows.select(key, F.explode(hits).alias("h")).select(key, "h.term", "h.canonical", "h.type", "h.matched_variant")


def _next_start(sizes: np.ndarray, max_rows: int, max_chars: int) -> np.ndarray:
    """For each row, where the chunk after one that begins there begins (len(sizes) where the rows end before it is known to be full)."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    full = np.searchsorted(total, total[:-1] + max_chars, side="right") - 1
    return np.clip(np.minimum(np.arange(n) + max_rows, full), np.arange(n) + 1, n)


def _walk(sizes: np.ndarray, first: int, max_rows: int, max_chars: int) -> tuple[list[int], tuple[int, int]]:
    """Where chunks begin from row first on, and the rows and characters of the last one, which is open."""
    step, starts, at = _next_start(sizes, max_rows, max_chars).tolist(), [], first
    while at < len(step):
        starts.append(at)
        at = step[at]
    last = starts[-1] if starts else len(sizes)
    return starts, (len(sizes) - last, int(sizes[last:].sum()))


def chunk_numbers(rows: DataFrame, group: list[str], key: str, size: str, max_rows: int = CHUNK_ROWS, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """rows with chunk (from 0 in each group): pieces in the order of key go to the open chunk until it has max_rows of them or would pass max_chars.

    A chunk depends on the chunk before only by where it begins, and within max_rows rows of a partition's first row one begins, so each partition of the sorted keys has at most max_rows ways to go
    on. Tasks report for each way how many chunks begin and what is left open; the driver (max_rows short rows for each partition) finds the way that was taken; tasks then number their rows. No
    group is gathered, and texts stay out of it: they are joined by (group, key).
    """
    slim = rows.select(*group, F.col(key), F.col(size).cast("long").alias("_size"))
    order = [*group, key]
    held = materialise(slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    names = [*group, key, "_size"]

    def runs(frame: pd.DataFrame) -> list[tuple[int, int]]:
        if not len(frame):
            return []
        same = np.ones(len(frame), bool)
        for g in group:
            code = pd.factorize(frame[g])[0]
            same[1:] &= code[1:] == code[:-1]
        same[0] = False
        cuts = [*np.flatnonzero(~same).tolist(), len(frame)]
        return list(zip(cuts, cuts[1:]))

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(batches) or [pd.DataFrame(columns=[*names, "_part"])], ignore_index=True)
        found = runs(frame)
        if not found:
            return
        sizes = frame["_size"].to_numpy(np.int64)
        a, b = found[0]
        ways = [_walk(sizes[a:b], w, max_rows, max_chars) for w in range(min(max_rows, b - a) + 1)]
        c, d = found[-1]
        last = _walk(sizes[c:d], 0, max_rows, max_chars) if len(found) > 1 else ([], (0, 0))
        state = {"head": sizes[a : min(b, a + max_rows)].tolist(), "rows": b - a, "ways": [[len(s), *o] for s, o in ways], "tail": [len(last[0]), *last[1]], "one": len(found) == 1}
        groups = [[None if pd.isna(v) else str(v) for v in frame.loc[k, group]] for k in (a, c)]
        yield pd.DataFrame({"part": [int(frame["_part"].iloc[0])], "state": [json.dumps(state)], "groups": [json.dumps(groups)]})

    reports = sorted((r["part"], json.loads(r["state"]), json.loads(r["groups"])) for r in held.mapInPandas(report, "part int, state string, groups string").collect())  # a row for each partition
    plan: dict[int, tuple[int, int]] = {}  # part: (row of its first group where a chunk begins, number of that chunk)
    before, open_, number = None, (0, 0), 0
    for part, state, (first, last) in reports:
        if first == before:
            n, chars = open_
            way = 0
            while way < state["rows"] and way < len(state["head"]) and not (n >= max_rows or (n and chars + state["head"][way] > max_chars)):
                n, chars, way = n + 1, chars + state["head"][way], way + 1
        else:
            way, number, n, chars = 0, 0, 0, 0
        plan[part] = (way, number)
        begun, rows_open, chars_open = state["ways"][way]
        if state["one"]:
            number += begun
            open_ = (rows_open, chars_open) if begun else (n, chars)
        else:
            begun, *rest = state["tail"]
            number, open_ = begun, tuple(rest)
        before = last

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(batches) or [pd.DataFrame(columns=[*names, "_part"])], ignore_index=True)
        if not len(frame):
            return
        sizes = frame["_size"].to_numpy(np.int64)
        chunk = np.zeros(len(frame), np.int32)
        for k, (a, b) in enumerate(runs(frame)):
            way, number = plan[int(frame["_part"].iloc[0])] if k == 0 else (0, 0)
            begins = np.zeros(b - a, np.int32)
            begins[_walk(sizes[a:b], way, max_rows, max_chars)[0]] = 1
            chunk[a:b] = np.cumsum(begins) + number - 1
        yield frame[[*group, key]].assign(chunk=chunk)

    kinds = T.StructType([*(held.schema[c] for c in [*group, key]), T.StructField("chunk", T.IntegerType())])
    numbered = held.mapInPandas(assign, kinds)
    on = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(numbered[c]) for c in [*group, key]))
    return rows.join(numbered, on).select(rows["*"], numbered["chunk"])


def contained(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, needle: str, words: int = 4) -> DataFrame:
    """key, item: which documents hold which items' whole texts (substrings, as written).

    The words inside an item, without its first and last, stand in a document that holds it as whole words. So items of words + 2 words and more go by the hash of their inner words in the middle, documents by
    those of all their runs of words, and only rows that meet are compared. Shorter items have no run that tells them apart; they go by one inner word, and those without any are looked for in every document.
    """
    tokens = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    own = items.select(item, needle).withColumn("_w", tokens(F.col(needle)))
    n = F.size("_w")
    # where the text begins or ends with white space, its first or last word is whole as well, which only makes the choice of inner words narrower than it could be
    run = lambda k: F.xxhash64(F.array_join(F.slice("_w", F.greatest(F.lit(2), F.floor((n - k) / 2).cast("int") + 1), k), " "))
    keyed = own.filter(n >= 3).select(item, needle, F.when(n >= words + 2, F.lit(words)).otherwise(1).alias("_k"), F.when(n >= words + 2, run(words)).otherwise(run(1)).alias("_h"))
    keyed = materialise(keyed)
    sizes = [r[0] for r in keyed.select("_k").distinct().collect()]  # two at most
    split = docs.select(key, text, tokens(F.col(text)).alias("_w"))
    found = own.filter(n < 3).select(item, needle).join(docs.select(key, text), F.contains(text, needle)).select(key, item)
    for k in sorted(sizes):
        at = F.sequence(F.lit(1), n - k + 1)
        grams = F.when(n >= k, F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice("_w", i, F.lit(k)), " "))))) if k > 1 else F.transform(F.array_distinct("_w"), lambda w: F.xxhash64(w))  # noqa: B023
        met = split.select(key, F.explode(grams).alias("_h")).join(keyed.filter(F.col("_k") == k).select(item, "_h"), "_h").select(key, item)
        pairs = met.join(items.select(item, needle), item).join(docs.select(key, text), key)
        found = found.unionByName(pairs.filter(F.contains(text, needle)).select(key, item))
    return found


def largest_groups(counts: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order) if by else None
    ranked = counts.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k)


def overlaps(pairs: dict[str, tuple[DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """check, n: rows of the first table whose key the second one has, for each check."""
    parts = [a.join(b.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, (a, b, keys) in pairs.items()]
    return reduce(DataFrame.unionByName, parts)


def sequence_ids(groups: DataFrame, by: list[str], within: str, prefix: str, width: int, column: str = "sequence_id") -> DataFrame:
    """groups with running ids (prefix and a number of so many digits, from 1) over the sorted groups, then the order within them: counts of groups become offsets, so only those are sorted in one place."""
    counts = groups.groupBy(*by).agg(F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(*(F.col(c).alias(f"_{c}") for c in by), offset.alias("_base"))
    nth = groups.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(within)))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    numbered = nth.join(base, on)
    number = (F.col("_base") + F.col("_nth")).cast("string")
    digits = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
    return numbered.withColumn(column, F.concat(F.lit(prefix), digits)).drop("_nth", "_base", *(f"_{c}" for c in by))


def distinct_mentions(mentions: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """The first mention of each key."""
    rest = [c for c in mentions.columns if c not in keys]
    first = mentions.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_m"))
    return first.select(*keys, "_m.*").select(*mentions.columns)


def translated(rows: DataFrame, key: str, names: DataFrame, name: str, column: str) -> DataFrame:
    """rows with column: what a dictionary (key, name) has for their key, empty where it has nothing."""
    return rows.join(names.select(F.col(key).alias("_key"), F.col(name).alias(column)), F.col(key) == F.col("_key"), "left").withColumn(column, F.coalesce(column, F.lit(""))).drop("_key")
