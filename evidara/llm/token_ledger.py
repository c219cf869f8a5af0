"""Token totals by source, language and tokenizer version, kept up to date by batches of changes.

A change inserts, deletes or revises a document's count. The ledger keeps each document's live count in buckets by a hash of its id. A batch reads the buckets that its documents fall into, and only those, and writes them
anew together with what changed; what no longer holds counts minus, what now does plus, and these signed sums by group are added to the totals before, so totals are never counted afresh.

A batch is committed by one numbered log entry that names the folder of each bucket's newest state and of the totals. Entries are put in place by a rename that fails if the number is taken: of two writers at once one commits and the other
works its batch out again on top of it. A batch that is in the log already is a no-op; one that broke off before its entry leaves files that nothing names. A document has at most one live count.

Defined cases: of several changes to a document in a batch the one of the largest seq holds (ties: delete before revise before insert, then larger values); inserting
a live document revises it, revising an unknown one inserts it, deleting an unknown one does nothing; a null op is an insert, a null count 0; null
sources, languages and versions are groups of their own; changes without doc_id cannot be told apart and are left out; other columns are not read; an empty batch is committed and adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut

KEYS = ("source", "lang", "tokenizer")
#: Buckets of a new ledger; a batch of few documents of a large ledger reads few of them.
BUCKETS = 64
_STATE = "doc_id long, live boolean, source string, lang string, tokenizer string, n_tokens long, changed boolean, was boolean, was_source string, was_lang string, was_tokenizer string, was_tokens long"
_SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

# Tokenizer versions that DataFrame functions can count, by name.
WORDS_1 = r"[^\x20\x09-\x0D]+"
WORDS_2 = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"


def count_by_pattern(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def count_by_encoder(docs: DataFrame, load: Callable[[], Callable[[str], int]], column: str = "n_tokens") -> DataFrame:
    """docs with the count of a tokenizer that load() makes in the worker, for versions beyond patterns."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = load()
        for texts in batches:
            yield texts.fillna("").map(count).astype("int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(column, F.pandas_udf(run, "long")("text"))


class ConcurrentCommit(Exception):
    """Another writer took the log number."""


class TokenLedger:
    """The ledger in a folder that all executors share: log/<number>.json, and a folder of files for each attempt at a batch."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.new_buckets = spark, path.rstrip("/"), buckets

    def _fs(self, *names: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _log(self) -> list[str]:
        fs, path = self._fs("log")
        return sorted(n for s in fs.listStatus(path) if (n := s.getPath().getName()).endswith(".json") and n[0] != ".") if fs.exists(path) else []

    def _entry(self, name: str) -> dict:
        fs, path = self._fs("log", name)
        source = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _head(self) -> dict:
        log = self._log()
        return self._entry(log[-1]) if log else {"number": 0, "buckets": self.new_buckets, "state": {}, "totals": None, "batches": []}

    def _append(self, entry: dict) -> None:
        """Put a log entry in place, whole, unless its number is taken."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        name = f"{entry['number']:012d}.json"
        fs, fresh = self._fs("log", f".{name}.{uuid.uuid4().hex}")
        out = fs.create(fresh, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        _, target = self._fs("log", name)
        fresh, target = fs.makeQualified(fresh), fs.makeQualified(target)
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(fresh, target, options)
        except Py4JJavaError as problem:
            fs.delete(fresh, False)
            if "FileAlreadyExists" in str(problem.java_exception):
                raise ConcurrentCommit(name) from problem
            raise

    def batches(self) -> list[str]:
        """The committed batches."""
        return sorted(self._head()["batches"])

    def _state(self, head: dict, buckets: list[int]) -> DataFrame:
        """The live counts of some buckets: doc_id, KEYS, n_tokens."""
        where = [f"{self.path}/{head['state'][str(b)]}/state/bucket={b}" for b in buckets if str(b) in head["state"]]
        read = self.spark.read.schema(_STATE).parquet(*where) if where else self.spark.createDataFrame([], _STATE)
        return read.filter("live").select("doc_id", *KEYS, "n_tokens")

    def live(self) -> DataFrame:
        """The counts that hold now, a row for each document."""
        head = self._head()
        return self._state(head, list(range(head["buckets"])))

    def apply(self, batch: str, changes: DataFrame, attempts: int = 20) -> bool:
        """Commit changes (seq, op, doc_id, source, lang, tokenizer, n_tokens) once; False if the batch was committed before."""
        for _ in range(attempts):
            head = self._head()
            if batch in head["batches"]:
                return False
            try:
                self._append(self._write(batch, head, changes))
                return True
            except ConcurrentCommit:
                continue
        raise RuntimeError(f"batch {batch} met other writers {attempts} times")

    def _write(self, batch: str, head: dict, changes: DataFrame) -> dict:
        """Write what the batch makes of the state at head, and give the log entry that would commit it."""
        n, folder = head["buckets"], f"files/{head['number'] + 1:012d}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
        rank = F.expr("CASE coalesce(op, 'insert') WHEN 'delete' THEN 2 WHEN 'revise' THEN 1 ELSE 0 END")
        fields = [F.col(k).cast("string").alias(k) for k in KEYS] + [F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens")]
        change = F.struct(F.col("seq").cast("long").alias("seq"), rank.alias("rank"), *fields)
        last = changes.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(change).alias("c"))
        last = cut(last.withColumn("bucket", bucket))
        touched = sorted(r[0] for r in last.select("bucket").distinct().collect())  # as many as there are buckets at most
        totals = head["totals"]
        if touched:
            old = self._state(head, touched).select("doc_id", F.struct(*KEYS, "n_tokens").alias("o"))
            both = last.select("doc_id", "c").join(old, "doc_id", "full_outer")
            new, kept, was = F.col("c.rank") < 2, F.col("c").isNull(), F.col("o").isNotNull()
            both = both.select(
                "doc_id", (kept | new).alias("live"), *(F.when(kept, F.col(f"o.{k}")).otherwise(F.col(f"c.{k}")).alias(k) for k in (*KEYS, "n_tokens")), (~kept & (was | new)).alias("changed"), was.alias("was"),
                *(F.col(f"o.{k}").alias(f"was_{k}") for k in KEYS), F.col("o.n_tokens").alias("was_tokens"), bucket.alias("bucket"),
            )
            # a document that came and went within the batch leaves nothing; one that went is there once more, not live, for the sums
            both.filter("live OR changed").repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}/state")
            written = [f"{self.path}/{folder}/state/bucket={b}" for b in touched if self._fs(folder, "state", f"bucket={b}")[0].exists(self._fs(folder, "state", f"bucket={b}")[1])]
            rows = (self.spark.read.schema(_STATE).parquet(*written) if written else self.spark.createDataFrame([], _STATE)).filter("changed")
            gone = rows.filter("was").select(*(F.col(f"was_{k}").alias(k) for k in KEYS), F.lit(-1).cast("long").alias("n_docs"), (-F.col("was_tokens")).alias("n_tokens"))
            come = rows.filter("live").select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")
            sums = gone.unionByName(come).unionByName(self._read_totals(totals)).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            sums.filter("n_docs <> 0 OR n_tokens <> 0").coalesce(1).write.parquet(f"{self.path}/{folder}/totals")
            totals = f"{folder}/totals"
            there = {int(p.rsplit("=", 1)[1]) for p in written}
            state = {**{b: f for b, f in head["state"].items() if int(b) not in touched}, **{str(b): folder for b in touched if b in there}}
        else:
            state = head["state"]
        return {"number": head["number"] + 1, "batch": batch, "buckets": n, "state": state, "totals": totals, "batches": [*head["batches"], batch]}

    def _read_totals(self, where: str | None) -> DataFrame:
        return self.spark.read.schema(_SUMS).parquet(f"{self.path}/{where}") if where else self.spark.createDataFrame([], _SUMS)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, without groups that hold no document any more."""
        return self._read_totals(self._head()["totals"])


#: What op6_token_counts returns, for DuckDB: the state that its batches lead to, counted afresh.
SQL = r"""
WITH counted AS (
    SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS a, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]')) AS b,
        min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
    FROM documents WHERE doc_id IS NOT NULL)
SELECT source, lang, CASE WHEN a = b THEN 'words-1' ELSE 'words-2' END AS tokenizer, count(*)::BIGINT AS n_docs, sum(b)::BIGINT AS n_tokens
FROM counted WHERE doc_id = first GROUP BY ALL
"""
