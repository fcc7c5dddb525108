"""Log2 histograms: bucketing, merging and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 40


def log2_bucket(value: Column) -> Column:
    """0 for values up to 1, else the place of the highest bit, at most 39; exact for every long, nulls stay."""
    return F.when(value <= 1, F.lit(0)).otherwise(F.least(F.lit(BUCKETS - 1), F.length(F.bin(value)) - 1)).cast("int")


def histogram(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    """(keys, bucket, n): counts by bucket, one shuffle of partial counts."""
    return df.where(value.isNotNull()).groupBy(*keys, log2_bucket(value).alias("bucket")).agg(F.count("*").alias("n"))


def merge_arrays(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Adds ragged histograms bucket by bucket; nulls and empty arrays add nothing, groups without buckets vanish."""
    return df.select(*keys, F.posexplode(column).alias("bucket", "n")).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def to_array(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, hist) from (keys, bucket, n); at most 40 buckets a key, trailing zeros trimmed."""
    m = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"), F.max("bucket").alias("top"))
    return m.select(*keys, F.transform(F.sequence(F.lit(0), F.col("top")), lambda i: F.coalesce(F.col("m")[i], F.lit(0))).alias("hist"))


def quantile_buckets(df: DataFrame, qs: list[float], *keys: str) -> DataFrame:
    """(keys, q, value): 1 or 2**i for the first bucket whose running count reaches max(1, floor(q * N)).

    Three rows a key at 40 buckets each: the window never holds more than a histogram.
    """
    over = W.partitionBy(*keys)
    ranked = df.withColumn("c", F.sum("n").over(over.orderBy("bucket"))).withColumn("total", F.sum("n").over(over))
    wanted = ranked.select("*", F.explode(F.array(*map(F.lit, qs))).alias("q"))
    hit = wanted.where(F.col("c") >= F.greatest(F.lit(1), F.floor(F.col("q") * F.col("total"))))
    return hit.groupBy(*keys, "q").agg(F.min("bucket").alias("bucket")).withColumn("value", F.expr("shiftleft(1L, bucket)"))


def quantile_of_array(hist: Column, q: float) -> Column:
    """The same from one array; -1 where there is none or it counts nothing."""
    total = F.aggregate(hist, F.lit(0).cast("long"), lambda a, x: a + x)
    target = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(q) * total))
    start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).alias("i"), F.lit(-1).alias("at"))

    def step(a: Column, x: Column) -> Column:
        c = a["c"] + x
        return F.struct(c.alias("c"), (a["i"] + 1).alias("i"), F.when((a["at"] < 0) & (c >= target), a["i"]).otherwise(a["at"]).alias("at"))

    found = F.aggregate(hist, start, step)["at"]
    return F.when(hist.isNull() | (total == 0) | (found < 0), F.lit(-1).cast("long")).otherwise(F.pow(F.lit(2.0), found).cast("long"))


def shown_duration(bucket: Column) -> Column:
    """A duration stands for 1.5 * 2**i of its bucket; bucket 0 stays 1."""
    return F.when(bucket == 0, F.lit(1.0)).otherwise(F.lit(1.5) * F.pow(F.lit(2.0), bucket))


def total_seconds(hist: Column) -> Column:
    """Sum of counts at 1.5 * 2**i microseconds, in seconds; none gives 0."""
    terms = F.transform(hist, lambda x, i: x.cast("double") * 1.5 * F.pow(F.lit(2.0), i.cast("double")))
    return F.coalesce(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 1e6, F.lit(0.0))
