"""The pipeline: stages in order, their decisions against brute-force versions, and odd cases."""

import zlib
from collections import defaultdict

import corpus_pipeline
from evidara.llm import quality, toxicity
from evidara.llm.common import table
from evidara.llm.queries import PACK_TOKENIZER, tokenizer_path
from tests.llm.conftest import ODD
from tests.llm.test_near_texts import brute

SF = "/root/testdata/sf0.01"


def encoder():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path(PACK_TOKENIZER))
    return lambda t: plain.encode(t or "", add_special_tokens=False).ids + [1]


def check_packing(rows, texts):
    """Every id of every text once, sequences gapless, and as few sequences as a first fit by falling length takes."""
    encode = encoder()
    wanted = sorted((i, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in encode(t)[a : a + 2048])), a, min(2048, len(encode(t)) - a)) for i, t in texts for a in range(0, len(encode(t)), 2048))
    assert sorted((r["doc_id"], r["ids_crc32"], r["start"], r["length"]) for r in rows if r["doc_id"] is not None) == wanted
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        assert all(a == sum(n for _, n in sorted(parts)[:k]) for k, (a, _) in enumerate(sorted(parts)))
        assert sum(n for _, n in parts) <= 2048
    free = []
    for n in sorted((r["length"] for r in rows), reverse=True):
        at = next((k for k, room in enumerate(free) if room >= n), None)
        if at is None:
            free.append(2048 - n)
        else:
            free[at] -= n
    assert len(by) <= 1.01 * len(free) + 1
    assert sorted(by) == list(range(len(by)))


def test_stages_follow_their_operators(spark, tmp_path):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    state = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = state
        stage(spark, before, SF).write.parquet(f"{tmp_path}/{k}")
        state = spark.read.parquet(f"{tmp_path}/{k}")
        all_ = {r["doc_id"]: r["text"] for r in before.select("doc_id", "text").collect()}
        if name == "packing":
            check_packing(state.collect(), list(all_.items()))
            continue
        assert state.columns == list(corpus_pipeline.COLUMNS)
        kept = {r["doc_id"] for r in state.select("doc_id").collect()}
        if name == "quality":
            wanted = {r["doc_id"] for r in quality.quality_scores(before, labels).collect() if r["predicted"] == 1}
        elif name == "toxicity":
            wanted = {r["doc_id"] for r in toxicity.toxicity_scores(before, labels).collect() if r["predicted"] == 0}
        else:
            wanted = {i for i, c in brute(all_).items() if i == c}
        assert kept == wanted and kept < set(all_)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "packing"]


def test_odd_documents(spark, odd, none):
    for docs in (odd, none):
        state = docs
        for _, stage in corpus_pipeline.STAGES[:3]:
            state = stage(spark, state, "/root/testdata/sf0.001")
        ids = [r["doc_id"] for r in state.select("doc_id").collect() if r["doc_id"] is not None]
        assert len(ids) == len(set(ids))
        rows = state.select("doc_id", "text").collect()
        check_packing(corpus_pipeline.pack(spark, state, "/root/testdata/sf0.001").collect(), [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None])
    rows = corpus_pipeline.pack(spark, odd, "/root/testdata/sf0.001").collect()
    check_packing(rows, [*enumerate(ODD), (4, ODD[4]), (12, ODD[12])])


def test_rows_decide_for_themselves(spark):
    """Rows that lack or repeat an id go by their own text."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    row = lambda i, t: (i, t, "en", "s", len(t))
    one, two, three = "a b c d e f g h", "b c d e f g h i j k l m n", "z y x w v u t"
    df = spark.createDataFrame([row(1, one), row(1, two), row(1, one), row(2, two), row(None, three), row(None, three), row(None, one), row(3, "z y x w v u t s r q p")], kind)
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("1", one), ("1", two), ("None", three), ("3", "z y x w v u t s r q p")])
