"""Similarities without a JVM function: matching-block ratio of strings; dot products of arrays."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.stages import materialise

NEAR = 0.92
IDENTITY_FLOOR = 0.90


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def matching_ratio(left: Column, right: Column) -> Column:
    """2 * matched characters / all characters by longest matching blocks."""
    return F.pandas_udf(_matching_ratio, T.DoubleType())(left, right)


def _matching_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        matcher, out = SequenceMatcher(None), []
        for a, b in zip(left, right):
            if a is None or b is None:
                out.append(None)
                continue
            matcher.set_seqs(a, b)
            out.append(matcher.ratio())
        yield pd.Series(out, dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """No pair of strings of these lengths has a higher matching ratio."""
    n, m = F.length(a), F.length(b)
    return F.when(n + m == 0, 1.0).otherwise(2.0 * F.least(n, m) / (n + m))


def _characters(term: Column) -> Column:
    """The set of a term's characters, each with how often it stood before: sets of two terms share as many elements as the terms share characters."""
    one = F.transform(F.sequence(F.lit(1), F.length(term)), lambda i: F.substring(term, i, F.lit(1)))
    return F.transform(one, lambda c, i: F.concat(c, F.size(F.filter(F.slice(one, 1, i + 1), lambda x: x == c)).cast("string")))


def _least_matched(n: Column, m: Column, floor: float) -> Column:
    """How many characters must match for terms of lengths n and m to reach the floor."""
    return F.ceil(floor * (n + m) / 2 - 1e-9).cast("int")


def near_candidates(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """Distinct pairs (left, right) of different terms among which all with a matching ratio of floor or more are found.

    If M characters must match, n - M of the left and m - M of the right term lie outside the matches; the left term, cut into one segment more than that, has a segment
    that none of them touches, which the right term holds at most n - M places earlier or m - M later. So terms meet by lengths, segment and its text only; pairs that then
    share fewer than M characters, wherever they stand, are left out. Where a term is too short for so many segments (floors under 2/3), the pairs of two lengths all meet.
    """
    if not 0 < floor <= 1:
        raise ValueError("the floor is a ratio over 0 and at most 1")
    terms = lambda df, name, size: df.select(F.col(df.columns[0]).alias(name)).filter(F.length(name) > 0).distinct().withColumn(size, F.length(name))
    reach = (2.0 - floor) / floor
    other = lambda c: F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(F.col(c) / reach - 1e-9).cast("int")), F.floor(F.col(c) * reach + 1e-9).cast("int")))
    n, m = F.col("n"), F.col("m")
    least = _least_matched(n, m, floor)
    cuts = F.when(n + m - 2 * least < n, n + m - 2 * least + 1).otherwise(0)
    begin = lambda i: F.floor(i * n / F.greatest(F.col("cuts"), F.lit(1))).cast("int")
    text = lambda name, at, size: F.substring(F.col(name), at + 1, size)
    a = terms(left, "left", "n").withColumn("m", other("n")).withColumn("cuts", cuts)
    a = a.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.col("cuts") - 1, F.lit(0)))))
    a = a.select("left", "n", "m", "i", F.when(F.col("cuts") == 0, "").otherwise(text("left", begin(F.col("i")), begin(F.col("i") + 1) - begin(F.col("i")))).alias("held"))
    b = terms(right, "right", "m").withColumn("n", other("m")).withColumns({"cuts": cuts, "least": least})
    b = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.col("cuts") - 1, F.lit(0)))))
    b = b.withColumns({"at": begin(F.col("i")), "size": begin(F.col("i") + 1) - begin(F.col("i"))})
    first, last = F.greatest(F.lit(0), F.col("at") - (n - F.col("least"))), F.least(m - F.col("size"), F.col("at") + (m - F.col("least")))
    places = F.when(F.col("cuts") == 0, F.array(F.lit(0))).when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    b = b.withColumn("p", F.explode(places)).select("right", "n", "m", "i", F.when(F.col("cuts") == 0, "").otherwise(text("right", F.col("p"), F.col("size"))).alias("held")).distinct()
    met = a.join(b, ["n", "m", "i", "held"]).filter("left <> right").select("left", "right").distinct()
    shared = F.size(F.array_intersect(_characters(F.col("left")), _characters(F.col("right"))))
    return met.filter(shared >= _least_matched(F.length("left"), F.length("right"), floor))


def fuzzy_pairs(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """Pairs (left, right) of distinct terms with a ratio of floor or more; equal terms have ratio 1, nulls take no part. Only near_candidates() are compared."""
    a = left.select(F.col(left.columns[0]).alias("left")).filter("left IS NOT NULL").distinct()
    b = right.select(F.col(right.columns[0]).alias("right")).distinct()
    same = a.join(b, F.col("left") == F.col("right")).select("left", "right", F.lit(1.0).alias("ratio"))
    other = near_candidates(left, right, floor).select("left", "right", matching_ratio(F.col("left"), F.col("right")).alias("ratio"))
    return same.unionByName(other.filter(F.col("ratio") >= floor))


def with_near_terms(df: DataFrame, key: str, wanted: str, found: list[str], floor: float, near: str) -> DataFrame:
    """df with the column near (array of own, term, ratio): for a row's key, whose terms stand in the array column wanted (the same for all rows of a key), the terms of df's array columns found
    that nearly are one of them. df is written once, since it is read three times. Each pair of distinct terms is compared once, however many rows hold them; a row carries only the near terms of its key."""
    df = materialise(df)
    held = F.flatten(F.array(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in found)))
    own = df.select(F.col(key).alias("_key"), F.explode(wanted).alias("own")).distinct()
    close = fuzzy_pairs(own.select("own"), df.select(F.explode(F.array_distinct(held)).alias("term")), floor).filter("left <> right")
    lists = own.join(close, F.col("own") == F.col("left")).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("own", F.col("right").alias("term"), "ratio"))).alias(near))
    empty = F.array().cast("array<struct<own:string,term:string,ratio:double>>")
    return df.join(lists, F.col(key) == F.col("_key"), "left").drop("_key").withColumn(near, F.coalesce(near, empty))


def near_matches(wanted: Column, found: Column, near: Column, floor: float = NEAR) -> Column:
    """Of two sets, the terms of the first that the second has, exactly or, by with_near_terms() at floor or less, nearly."""
    return F.filter(wanted, lambda t: F.array_contains(found, t) | F.exists(near, lambda x: (x["own"] == t) & (x["ratio"] >= floor) & F.array_contains(found, x["term"])))


def best_ratio(wanted: Column, found: Column, near: Column) -> Column:
    """The best ratio by with_near_terms() between terms of two sets if it reaches the identity floor, else 0."""
    held = F.filter(near, lambda x: (x["ratio"] >= IDENTITY_FLOOR) & F.array_contains(wanted, x["own"]) & F.array_contains(found, x["term"]))
    return F.coalesce(F.array_max(F.transform(held, lambda x: x["ratio"])), F.lit(0.0))


def identity_similarity(left: Column, right: Column, near: Column | None = None) -> Column:
    """Shared identity tokens over the smaller set; without any, the best near-exact ratio if near (with_near_terms() at IDENTITY_FLOOR) is given, else 0."""
    both = F.size(F.array_intersect(left, right))
    rest = best_ratio(left, right, near) if near is not None else F.lit(0.0)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).when(both > 0, both / F.least(F.size(left), F.size(right))).otherwise(rest)
