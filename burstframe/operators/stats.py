"""Counting and ranking helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def percentages(counts: DataFrame, count: str = "n") -> DataFrame:
    """Adds pct, the share of all in percent, to three decimals. The sum is one row and is broadcast."""
    total = counts.agg(F.sum(count).alias("all"))
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", F.round(100 * F.col(count) / F.col("all"), 3)).drop("all")


def bucket_counts(values: DataFrame, column: str, buckets: Sequence[float]) -> DataFrame:
    """(bucket, n): values equal to a bucket; the last one also takes all that is larger."""
    last = buckets[-1]
    counts = [F.count_if(F.col(column) >= b if b == last else F.col(column) == b).alias(f"b{i}") for i, b in enumerate(buckets)]
    pairs = F.array(*(F.struct(F.lit(float(b)).alias("bucket"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)))
    return values.agg(*counts).select(F.inline(pairs))


def cumulative(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(value).alias(value))


def tag_histogram(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    """(tag, n) of arrays of (word, tag)."""
    return tokens.select(F.explode(F.transform(column, lambda t: t.tag)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def overlap(a: Column, b: Column) -> Column:
    """How many elements of a, repeats counted, are in b."""
    return F.size(F.filter(a, lambda x: F.array_contains(b, x)))


def ordered(rows: DataFrame, by: str, key: str, descending: bool = True) -> DataFrame:
    return rows.orderBy(F.desc(by) if descending else F.asc(by), key)


def ordered_with(rows: DataFrame, other: DataFrame, key: str, by: str) -> DataFrame:
    """Rows in order with the other table's value at their key."""
    return rows.join(other, key).orderBy(F.desc(by), key)


def top_rows(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(by), key).limit(n)


def top_by_entry(rows: DataFrame, vector: str, entry: int, key: str, n: int) -> DataFrame:
    """The n rows with the largest entry of a vector column, equal ones by key."""
    return rows.orderBy(F.desc(F.get(vector, F.lit(entry))), key).limit(n)


def top_in_groups(rows: DataFrame, groups: Sequence[str], by: str, key: str, n: int) -> DataFrame:
    """The n largest of each group, equal ones by key, with their rank."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(F.desc(by), key)))
    return ranked.where(F.col("rank") <= n)


def numbered(rows: DataFrame, key: str, first: str, name: str = "number", parts: int = 64) -> DataFrame:
    """(key, number): distinct keys numbered from 0 by where they first occur. `first` is a number.

    Keys are ranked within ranges of places, and the sizes of the ranges before are added. The bounds of the ranges are
    `parts` quantiles, read by the driver once so that every task sees the same; equal places never part.
    """
    seen = rows.where(F.col(key).isNotNull() & F.col(first).isNotNull()).groupBy(key).agg(F.min(first).cast("double").alias("_first"))
    bounds = seen.agg(F.percentile_approx("_first", [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    part = F.size(F.filter(F.array(*(F.lit(float(b)) for b in sorted(set(bounds)))), lambda b: b < F.col("_first"))) if bounds else F.lit(0)
    ranged = seen.withColumn("_part", part)
    local = ranged.withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy("_first", key)) - 1)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))  # at most `parts` rows
    offsets = sizes.withColumn("_offset", F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    joined = local.join(F.broadcast(offsets), "_part")
    return joined.select(key, (F.coalesce("_offset", F.lit(0)) + F.col("_rank")).cast("bigint").alias(name))


def chunked(rows: DataFrame, number: str, size: int) -> DataFrame:
    """Adds chunk, the run of `size` consecutive numbers that a row is in."""
    return rows.withColumn("chunk", F.floor(F.col(number) / size))
