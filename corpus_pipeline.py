"""Corpus pipeline: quality filter, toxicity filter, SimHash near-dedup, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns what the next one reads
as its documents. A row is told by its doc_id and a hash of its text, so rows that lack or repeat a doc_id have decisions of their own.

Near-dedup works on five words and a similarity of 0.8: of each group one document stays, that of the smallest doc_id (of equal rows of that id the first). A row without doc_id
goes if a row with one has an equal set of shingles, or if another such row has its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidara.llm import near_texts, packing, quality, toxicity
from evidara.llm.common import cut, drop_shared_dir, new_shared_dir, table
from evidara.llm.queries import PACK_TOKENIZER, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MARK = "_text_mark"
KEY = ["doc_id", MARK]


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64("text").alias(MARK))


def _without(marked: DataFrame, rejected: DataFrame) -> DataFrame:
    gone = rejected.select(F.col("doc_id").alias("_gone_id"), F.col(MARK).alias("_gone_mark")).distinct()
    return marked.join(gone, (marked[MARK] == gone["_gone_mark"]) & marked["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]), "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    marked = _marked(docs)
    scores = quality.quality_scores(marked, table(spark, sf_dir, "labels"), carry=(MARK,))
    return _without(marked, scores.filter("predicted = 0")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    marked = _marked(docs)
    scores = toxicity.toxicity_scores(marked, table(spark, sf_dir, "labels"), carry=(MARK,))
    return _without(marked, scores.filter("predicted = 1")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    marked = _marked(docs)
    found = cut(near_texts.groups(marked, carry=(MARK,)))
    gone = found.filter("doc_id <> component_id OR (doc_id IS NULL AND component_id IS NOT NULL)").select(*KEY)
    # rows that repeat the id (or, without one, the text) of a row that stays: none in tables of unique ids
    stays = found.filter("doc_id = component_id OR component_id IS NULL").groupBy(F.coalesce("group", MARK).alias("own"), "doc_id").agg(F.count("*").alias("n"), F.min(MARK).alias("first"))
    again = cut(stays.filter("n > 1"))
    if again.isEmpty():
        return _without(marked, gone).select(*COLUMNS)
    others = found.join(again.select("own", F.col("doc_id").alias("_id"), "first"), (F.col("group") == F.col("own")) & (F.col("doc_id") == F.col("_id")))
    return _without(marked, gone.unionByName(others.filter(F.col(MARK) != F.col("first")).select(*KEY))).dropDuplicates(KEY).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their sequence and offset."""
    return packing.pack_documents(docs, tokenizer_path(PACK_TOKENIZER))


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("packing", pack)]

#: Trained models, hashing and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    root = new_shared_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    out = cut(docs)
    drop_shared_dir(spark, root)
    return out
