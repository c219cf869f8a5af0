"""The append-only log of provider responses, as a stream: new JSON lines become the latest record of each request.

The stream's checkpoint plays the part of "resume": a line is taken once. Each micro-batch is written under its batch number, so a batch that is replayed replaces
itself, and the current state is the latest record of each request over all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

SCHEMA = T.StructType().add("request_id", "string").add("ordinal", "long").add("status", "string").add("response_text", "string")


def latest(df: DataFrame, key: str = "request_id", order: str = "ordinal") -> DataFrame:
    """The last record of each key."""
    rest = [c for c in df.columns if c not in (key, order)]
    top = df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("r"))
    return top.select(key, F.col(f"r.{order}").alias(order), *(F.col(f"r.{c}").alias(c) for c in rest))


def follow(spark: SparkSession, source: str, state: str, checkpoint: str, schema: T.StructType = SCHEMA) -> StreamingQuery:
    """Take what is new in source (a folder of JSON-lines files) into state, then stop."""

    def merge(batch: DataFrame, number: int) -> None:
        latest(batch.filter("request_id IS NOT NULL")).write.mode("overwrite").parquet(f"{state}/batch={number}")

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, state: str) -> DataFrame:
    """The latest record of each request."""
    return latest(spark.read.parquet(state).drop("batch"))


def pending(requests: DataFrame, responses: DataFrame, done: tuple[str, ...] = ("ok",)) -> DataFrame:
    """Requests without a completed response."""
    return requests.join(responses.filter(F.col("status").isin(*done)).select("request_id"), "request_id", "left_anti")


def windowed_counts(events: DataFrame, time: str, by: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows of each time window and group, for a table or a stream; a stream drops rows later than the watermark."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
