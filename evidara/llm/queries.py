"""The queries opN_<name>: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, neighbours, ngram_lm, outliers, packing, piece_sampling, pivot_search, quality, simhash, token_ledger, toxicity, turn_repair, variants
from .common import cut, drop_shared_dir, new_shared_dir, table

#: The vocabulary file's name in the folder of public tokenizers.
PACK_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as "start-end;..." text."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ";")
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations")).select("conv_id", "speaker", "part", F.col("n_turns").cast("long").alias("n_turns"), "text", spans.alias("spans"))


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.held_out_scores(table(spark, sf_dir, "documents"))


def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sample_segmentations(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL), with_ids=False)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents, revise those that the second tokenizer counts otherwise, delete copies of a text but the first; two batches are applied twice."""
    docs, text = table(spark, sf_dir, "documents"), F.col("text")
    counted = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            "lang",
            token_ledger.count_by_pattern(text, token_ledger.WORDS_1).alias("a"),
            token_ledger.count_by_pattern(text, token_ledger.WORDS_2).alias("b"),
            F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("same"),
        )
    )
    # the first of each text by partial minima, told apart by id: the copies of a common text never meet in a task
    first = counted.groupBy("same").agg(F.min("doc_id").alias("doc_id"))
    copies = counted.filter("doc_id IS NOT NULL").join(first.select("doc_id"), "doc_id", "left_anti")
    batches = {
        "1-insert": counted.select(F.lit(1).alias("seq"), F.lit("insert").alias("op"), "doc_id", "source", "lang", F.lit("words-1").alias("tokenizer"), F.col("a").alias("n_tokens")),
        "2-revise": counted.filter("a <> b").select(F.lit(2).alias("seq"), F.lit("revise").alias("op"), "doc_id", "source", "lang", F.lit("words-2").alias("tokenizer"), F.col("b").alias("n_tokens")),
        "3-delete": copies.select(F.lit(3).alias("seq"), F.lit("delete").alias("op"), "doc_id", "source", "lang", F.lit("words-1").alias("tokenizer"), F.lit(0).alias("n_tokens")),
    }
    root = new_shared_dir(spark, "token-ledger")
    ledger = token_ledger.TokenLedger(spark, root)
    for name in (*batches, "2-revise", "1-insert"):
        ledger.apply(name, batches[name])
    out = cut(ledger.totals())
    drop_shared_dir(spark, root)
    return out


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(PACK_TOKENIZER))


def op10_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.exact_top_k(table(spark, sf_dir, "embeddings"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_groups(variants.word_counts(table(spark, sf_dir, "documents")))


def op12_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents")).select("doc_id", *outliers.COUNTS, "base_failed", "kept", "distance")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_ngram_lm": op2_ngram_lm,
    "op3_piece_sampling": op3_piece_sampling,
    "op4_neighbours": op4_neighbours,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_pivot_search": op10_pivot_search,
    "op11_variants": op11_variants,
    "op12_outliers": op12_outliers,
    "op13_turn_repair": op13_turn_repair,
}
ORACLE_SQL: dict[str, str] = {"op1_chat": chat.SQL, "op6_token_counts": token_ledger.SQL, "op10_pivot_search": pivot_search.SQL, "op11_variants": variants.SQL, "op13_turn_repair": turn_repair.SQL}
