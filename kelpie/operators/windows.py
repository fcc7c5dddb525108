"""Ordered analytics: running sums without a single task, back-off, rates, exact percentiles, nearest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_before(df: DataFrame, order: list[str], value: str, name: str, parts: int = 64) -> DataFrame:
    """The sum of ``value`` over all rows before each in a total order.

    The first order column is cut into ranges; a window runs within each range, and the sums of whole ranges before
    it, of which there are at most ``parts``, come back to the driver and are added.
    """
    marks = df.agg(F.percentile_approx(order[0], [i / parts for i in range(1, parts)], 1000).alias("m")).first()["m"] or []
    splits = sorted(set(marks))
    part = F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s <= F.col(order[0]))) if splits else F.lit(0)
    rows = df.withColumn("part_", part)
    own = F.coalesce(F.sum(value).over(W.partitionBy("part_").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = {r["part_"]: r["sum_"] or 0 for r in rows.groupBy("part_").agg(F.sum(value).alias("sum_")).collect()}
    base, total = [], 0
    for i in range(len(splits) + 1):
        base.append(total)
        total += sums.get(i, 0)
    return rows.withColumn(name, own + F.get(F.array(*map(F.lit, base)), F.col("part_"))).drop("part_")


def exact_percentiles(df: DataFrame, value: str, qs: dict[str, float], *keys: str) -> DataFrame:
    """The value at rank floor(n * q), at most n - 1, from 0; by counts of distinct values, never interpolated."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value_")).agg(F.count("*").alias("count_"))
    over = W.partitionBy(*keys)
    ranked = counts.withColumn("upto_", F.sum("count_").over(over.orderBy("value_"))).withColumn("total_", F.sum("count_").over(over))
    at = lambda q: F.least(F.col("total_") - 1, F.floor(F.col("total_") * q))
    return ranked.groupBy(*keys).agg(*(F.min(F.when(F.col("upto_") > at(q), F.col("value_"))).alias(name) for name, q in qs.items()), F.max("total_").alias("n"))


def nearest(left: DataFrame, right: DataFrame, key: str, time: str, prefer: str) -> DataFrame:
    """Each left row with the right row of its key nearest in time; ties go to the later, then the larger ``prefer``.

    Right rows carry ``r_`` names.  Neighbours before and after are found by one sort of both sides together.
    """
    columns = right.columns
    pack = F.struct(F.col(f"r_{time}").alias("t"), F.col(f"r_{prefer}").alias("p"), *(c for c in columns if c not in (key, f"r_{time}", f"r_{prefer}")))
    right_rows = right.select(key, F.col(f"r_{time}").alias("t_"), pack.alias("right_"), F.lit(None).cast(left.withColumn("left_", F.struct(*left.columns)).schema["left_"].dataType).alias("left_"))
    left_rows = left.select(key, F.col(time).alias("t_"), F.lit(None).cast(right_rows.schema["right_"].dataType).alias("right_"), F.struct(*left.columns).alias("left_"))
    both = right_rows.unionByName(left_rows)
    before = F.max("right_").over(W.partitionBy(key).orderBy("t_").rangeBetween(W.unboundedPreceding, 0))
    after = F.when(F.col("right_").isNotNull(), F.struct(F.col("right_.t").alias("t"), (-F.col("right_.p")).alias("n"), F.col("right_").alias("row")))
    later = F.min(after).over(W.partitionBy(key).orderBy("t_").rangeBetween(0, W.unboundedFollowing))
    found = both.withColumn("b", before).withColumn("a", later).where("left_ IS NOT NULL")
    use_after = F.col("b").isNull() | (F.col("a.row").isNotNull() & (F.col("a.t") - F.col("t_") <= F.col("t_") - F.col("b.t")))
    return found.select("left_.*", F.when(use_after, F.col("a.row")).otherwise(F.col("b")).alias("nearest"))


def preferred_latest(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("r = 1").drop("r")


def back_off(df: DataFrame, key: str, order: list[str], failed: str, first_s: int = 600, most_s: int = 3600) -> DataFrame:
    """Failures with their number since the last success and the seconds their mark lasts: doubling, at most ``most_s``."""
    w = W.partitionBy(key).orderBy(*order)
    rows = df.withColumn("era_", F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w))
    failures = rows.where(failed).withColumn("count", F.row_number().over(W.partitionBy(key, "era_").orderBy(*order))).drop("era_")
    return failures.withColumn("mark_s", F.least(F.lit(most_s), F.lit(first_s) * F.pow(F.lit(2.0), F.least(F.col("count") - 1, F.lit(30)))).cast("long"))


def rates(df: DataFrame, key: str, order: list[str], time: str, value: str) -> DataFrame:
    """Change of a value over the change of time between consecutive rows; null for the first and where no time passed."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("rate", F.try_divide(F.col(value) - F.lag(value).over(w), F.nullif(F.col(time) - F.lag(time).over(w), F.lit(0))))


def gaps_between(df: DataFrame, worker: str, issued: str, done: str) -> DataFrame:
    """Compute time of a worker: its next issue less its last completion."""
    w = W.partitionBy(worker).orderBy(issued)
    return df.withColumn("gap", F.lead(issued).over(w) - F.col(done))


def sessions(df: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """(key, session, start, stop, n): rows at most ``gap`` apart."""
    w = W.partitionBy(key).orderBy(time)
    new = F.when(F.col(time) - F.lag(time).over(w) <= gap, 0).otherwise(1)
    rows = df.withColumn("new_", new).withColumn("session", F.sum("new_").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.groupBy(key, "session").agg(F.min(time).alias("start"), F.max(time).alias("stop"), F.count("*").alias("n"))


def mean_by_eighth(df: DataFrame, order: str, value: str, *keys: str) -> DataFrame:
    """Mean of a value by eighths of the order."""
    return df.withColumn("eighth", F.ntile(8).over(W.partitionBy(*keys).orderBy(order))).groupBy(*keys, "eighth").agg(F.avg(value).alias("mean"))


def every_nth(df: DataFrame, n: int, order: list[str], *keys: str) -> DataFrame:
    """Every n-th row of each class, from the first: a sampling operator."""
    return df.withColumn("o_", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).where(F.col("o_") % n == 0).drop("o_")


def top_and_rest(df: DataFrame, value: str, name: str, top: int, others: str = "rest") -> DataFrame:
    """The ``top`` rows by value and one row with the sum of all others."""
    best = df.select(name, value).orderBy(F.col(value).desc(), name).limit(top)
    rest = df.join(best.select(name), name, "left_anti").agg(F.sum(value).alias(value)).where(F.col(value).isNotNull()).select(F.lit(others).alias(name), value)
    return best.unionByName(rest)


def scaled_counts(readings: DataFrame, *keys: str) -> DataFrame:
    """(keys, value, duty, scaled) of counters that shared their unit: counts by the time enabled over the time running.

    A counter that was never enabled counts for nothing; one that never ran adds to the time enabled alone.  ``duty`` is
    null where none was enabled.  ``value`` is a whole number; what is rounded to larger units starts from ``scaled``.
    """
    on, ran = F.col("enabled"), F.least("running", "enabled")
    scaled = F.when(F.col("running") >= on, F.col("value").cast("double")).otherwise(F.try_divide(F.col("value").cast("double") * on, F.col("running")))
    rows = readings.withColumns({"scaled_": F.when(on > 0, scaled), "on_": F.when(on > 0, on).otherwise(0), "ran_": F.when(on > 0, ran).otherwise(0)})
    out = rows.groupBy(*keys).agg(F.coalesce(F.sum("scaled_"), F.lit(0.0)).alias("s"), F.sum("on_").alias("on"), F.sum("ran_").alias("ran"))
    return out.select(*keys, F.floor(F.col("s") + 0.5).cast("long").alias("value"), F.try_divide(F.col("ran"), F.col("on")).cast("double").alias("duty"), F.col("s").alias("scaled"))
