"""Tables that several later steps read: written once to the shared folder, so a plan stays small and nothing is computed, or asked of a provider, twice."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, on a local master only (tests), one of our own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="evidara-stages-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files give fewer: costly expressions on a small table would otherwise run in a task or two. Larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_places(df: DataFrame, order: list, place: str = "place", sums: dict[str, str] | None = None) -> DataFrame:
    """df with each row's place (from 1) in the order, and running sums (name: column) up to and with it: a range partitioned sort, sums within its partitions, and the totals of those before.

    No task holds more than a partition; the totals are a row for each.
    """
    from pyspark.sql.window import Window

    sums = {place: None, **(sums or {})}
    held = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    value = lambda c: F.count("*") if c is None else F.sum(c)
    totals = held.groupBy("_part").agg(*(value(c).alias(f"_{n}") for n, c in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = held.withColumns({n: value(c).over(within) for n, c in sums.items()}).join(totals, "_part")
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", *(f"_{n}" for n in sums))
