"""Interval algebra over byte ranges, and the ordered scans that go with it.

A range is [lo, hi) or (off, len) within a key; keys are columns named by the caller.  Unions are islands over a
running maximum, overlaps are equi-joins on buckets of 2**20 bytes followed by the exact condition, so no plan has a
nested loop.  Greedy cuts, which restart at a limit, are ordered folds over one key's sorted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIB = 1 << 20
READV_LIMIT = (2 << 20) - 16
U32 = (1 << 32) - 1


def round_span(page: Column, size: Column, off: Column, length: Column) -> dict[str, Column]:
    """A span rounded outward to pages and cut at the end of the file; one that begins beyond it, or whose rounded length needs more than 32 bits, stays."""
    lo = F.floor(off / page) * page
    hi = F.least(F.ceil((off + length) / page) * page, size)
    plain = (off >= size) | (length <= 0) | (hi - lo > U32)
    return {"lo": F.when(plain, off).otherwise(lo).cast("long"), "hi": F.when(plain, off + length).otherwise(hi).cast("long")}


def readv_elements(df: DataFrame, page: int, limit: int = READV_LIMIT) -> DataFrame:
    """Rows [lo, hi) cut into elements of at most ``limit`` bytes with interior cuts on pages; a larger page is one element."""
    step = max(page, limit // page * page)
    first = F.least(F.col("hi"), (F.floor(F.col("lo") / page) * page + step).cast("long"))
    starts = F.concat(F.array("lo"), F.when(first < F.col("hi"), F.sequence(first, F.col("hi") - 1, F.lit(step).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)")))
    cut = df.withColumn("s", starts).select(*df.columns, "s", F.posexplode("s").alias("element", "e_lo"))
    return cut.withColumn("e_hi", F.coalesce(F.get("s", F.col("element") + 1), F.col("hi"))).drop("s")


def union_ranges(df: DataFrame, *keys: str, gap: int = 0) -> DataFrame:
    """(keys, lo, hi): touching and overlapping ranges joined, and those at most ``gap`` apart; empty ranges are left out."""
    order = W.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = df.where("hi > lo").withColumn("new", F.when(before.isNull() | (F.col("lo") > before + gap), 1).otherwise(0))
    islands = starts.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return islands.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def covered(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, bytes): length of the union."""
    return union_ranges(df, *keys).groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias("bytes"))


def footprint(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, buckets, unique_bytes, request_bytes) of reads clipped at the file's ``size``."""
    rows = df.withColumn("hi", F.least("hi", "size")).where("hi > lo")
    buckets = explode_buckets(rows, "lo", "hi").groupBy(*keys).agg(F.count_distinct("bucket").alias("buckets"))
    return buckets.join(covered(rows, *keys).withColumnRenamed("bytes", "unique_bytes"), list(keys)).join(rows.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias("request_bytes")), list(keys))


def explode_buckets(df: DataFrame, lo: str, hi: str, width: int = MIB) -> DataFrame:
    """A row for each bucket that [lo, hi) touches."""
    return df.select("*", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))).alias("bucket"))


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: int = MIB) -> DataFrame:
    """Pairs of left [lo, hi) and right [r_lo, r_hi) of one key that overlap, each pair once.

    Both sides are dealt into buckets; of the buckets a pair shares, the first one yields it.
    """
    a = explode_buckets(left.where("hi > lo"), "lo", "hi", width)
    b = explode_buckets(right.where("r_hi > r_lo"), "r_lo", "r_hi", width)
    first = F.floor(F.greatest("lo", "r_lo") / width)
    return a.join(b, [key, "bucket"]).where((F.col("lo") < F.col("r_hi")) & (F.col("r_lo") < F.col("hi")) & (F.col("bucket") == first)).drop("bucket")


def overlaps_any(left: DataFrame, right: DataFrame, key: str, width: int = MIB) -> DataFrame:
    """Left ranges that overlap some right one (semi join)."""
    hits = overlap_join(left.select(key, "lo", "hi").distinct(), right.select(key, "r_lo", "r_hi"), key, width).select(key, "lo", "hi").distinct()
    return left.join(hits, [key, "lo", "hi"], "left_semi")


def half_covered(reads: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """(key, unit columns, n) of units [r_lo, r_hi) of which the union of reads covers at least half."""
    joined = overlap_join(union_ranges(reads, key), units, key)
    n = F.sum(F.least("hi", "r_hi") - F.greatest("lo", "r_lo"))
    return joined.groupBy(*units.columns).agg(n.alias("n")).where(2 * F.col("n") >= F.col("r_hi") - F.col("r_lo"))


def fully_inside(points: DataFrame, spans: DataFrame, key: str, at: str, width: int = MIB) -> DataFrame:
    """Points of a key with the span [r_lo, r_hi) they lie in."""
    p = points.withColumn("bucket", F.floor(F.col(at) / width))
    return p.join(explode_buckets(spans, "r_lo", "r_hi", width), [key, "bucket"]).where((F.col(at) >= F.col("r_lo")) & (F.col(at) < F.col("r_hi"))).drop("bucket")


def islands(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, first, last, n): runs of consecutive distinct integers."""
    rows = df.select(*keys, value).distinct()
    order = W.partitionBy(*keys).orderBy(value)
    return rows.withColumn("g", F.col(value) - F.row_number().over(order)).groupBy(*keys, "g").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("g")


def capped_runs(df: DataFrame, value: str, most: int, *keys: str) -> DataFrame:
    """Runs of consecutive integers cut anew after every ``most`` of them: a run's restart points follow from its start."""
    runs = islands(df, value, *keys)
    starts = F.explode(F.sequence("first", "last", F.lit(most).cast("long")))
    return runs.select(*keys, starts.alias("first"), F.col("last").alias("end")).select(*keys, "first", F.least(F.col("first") + most - 1, F.col("end")).alias("last")).withColumn("n", F.col("last") - F.col("first") + 1)


def absent_runs(present: DataFrame, bounds: DataFrame, value: str, *keys: str) -> DataFrame:
    """Runs of integers in [lo, hi] of ``bounds`` that are not present; found between neighbours, without listing the range."""
    inside = present.select(*keys, value).distinct().join(bounds, list(keys)).where(F.col(value).between(F.col("lo"), F.col("hi")))
    edges = inside.select(*keys, value).unionByName(bounds.select(*keys, (F.col("lo") - 1).alias(value))).unionByName(bounds.select(*keys, (F.col("hi") + 1).alias(value)))
    follows = F.lead(value).over(W.partitionBy(*keys).orderBy(value))
    return edges.withColumn("next", follows).where(F.col("next") > F.col(value) + 1).select(*keys, (F.col(value) + 1).alias("first"), (F.col("next") - 1).alias("last"))


def chunk_runs(df: DataFrame, ordinal: str, *keys: str) -> DataFrame:
    """(keys, off, len, n): chunks that lie end to end in the given order."""
    order = W.partitionBy(*keys).orderBy(ordinal)
    new = F.when(F.lag(F.col("off") + F.col("len")).over(order) == F.col("off"), 0).otherwise(1)
    runs = df.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return runs.groupBy(*keys, "run").agg(F.min_by("off", ordinal).alias("off"), F.sum("len").alias("len"), F.count("*").alias("n"))


def merge_records(df: DataFrame, max_run: int, max_gap: int, *keys: str) -> DataFrame:
    """(keys, runs): records sorted by offset joined while the run stays within ``max_run`` and gaps within ``max_gap``; an overlap breaks.

    A greedy cut: one fold over a key's sorted records.
    """
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("off", "len"))).alias("r"))
    none = F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)")

    def step(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        hi = x["off"] + x["len"]
        joins = last.isNotNull() & (x["off"] >= last["hi"]) & (x["off"] - last["hi"] <= max_gap) & (hi - last["lo"] <= max_run)
        one = F.array(F.struct(F.when(joins, last["lo"]).otherwise(x["off"]).alias("lo"), hi.alias("hi")))
        return F.concat(F.when(joins, F.slice(a, 1, F.size(a) - 1)).otherwise(a), one)

    return rows.select(*keys, F.explode(F.aggregate("r", none, step)).alias("r")).select(*keys, "r.lo", "r.hi")


def sequential(df: DataFrame, ordinal: str, *keys: str) -> DataFrame:
    """Marks reads that begin where the one before ended."""
    order = W.partitionBy(*keys).orderBy(ordinal)
    return df.withColumn("sequential", F.coalesce(F.lag(F.col("off") + F.col("len")).over(order) == F.col("off"), F.lit(False)))


def first_touch(df: DataFrame, ordinal: str, *keys: str) -> DataFrame:
    """Marks the first row of each key."""
    return df.withColumn("first_touch", F.row_number().over(W.partitionBy(*keys).orderBy(ordinal)) == 1)


def placements(df: DataFrame, length: str, order: str, *keys: str) -> DataFrame:
    """Each row's start when rows lie one after the other."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("place", F.coalesce(F.sum(length).over(w), F.lit(0)))


def within_budget(df: DataFrame, length: str, order: str, budget: int, *keys: str) -> DataFrame:
    """Rows until what was taken before reaches a budget: the row that crosses it is still taken."""
    return placements(df, length, order, *keys).where(F.col("place") < budget)


def frontier(df: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """The running maximum, the one before, and whether a value lies behind it."""
    w = W.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("frontier", F.max(value).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.withColumn("before", F.max(value).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("passed_over", F.coalesce(F.col(value) < F.col("before"), F.lit(False)))


def free_place(live: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, place) for a block of ``len`` bytes, eight-aligned: before the first live range if it fits there from ``front``, else after the last if that is within ``limit``, else in the first gap; null where nothing fits."""
    align = lambda c: (F.ceil(c / 8) * 8).cast("long")
    merged = union_ranges(live, key)
    nexts = merged.withColumn("next", F.lead("lo").over(W.partitionBy(key).orderBy("lo")))
    ends = merged.groupBy(key).agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    gaps = nexts.where("next IS NOT NULL").join(wanted, key).where(align(F.col("hi")) + F.col("len") <= F.col("next")).groupBy(key).agg(F.min(align(F.col("hi"))).alias("gap"))
    rows = wanted.join(ends, key, "left").join(gaps, key, "left")
    front = align(F.col("front"))
    place = F.when(F.col("first").isNull() | (front + F.col("len") <= F.col("first")), front).when(align(F.col("last")) + F.col("len") <= F.col("limit"), align(F.col("last"))).otherwise(F.col("gap"))
    return rows.select(key, place.alias("place"))


def max_concurrency(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, peak): most [lo, hi) open at once; an end comes before a start of the same time."""
    steps = df.where("hi > lo").select(*keys, F.explode(F.array(F.struct(F.col("lo").alias("t"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("t"), F.lit(-1).alias("d")))).alias("s")).select(*keys, "s.t", "s.d")
    # Steps of one instant are added first, so a hot instant is one row.
    net = steps.groupBy(*keys, "t").agg(F.sum("d").alias("d"))
    open_ = F.sum("d").over(W.partitionBy(*keys).orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow))
    return net.withColumn("open", open_).groupBy(*keys).agg(F.max("open").alias("peak"))


def reader_wait(df: DataFrame, thread: str = "thread", tier: str = "tier") -> DataFrame:
    """(tier, wait): the union of each thread's outstanding intervals, each island charged to its highest tier."""
    order = W.partitionBy(thread).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    # A new island begins only when nothing is outstanding.
    rows = df.where("hi > lo").withColumn("new", F.when(before.isNull() | (F.col("lo") >= before), 1).otherwise(0)).withColumn("island", F.sum("new").over(order))
    per = rows.groupBy(thread, "island").agg((F.max("hi") - F.min("lo")).alias("wait"), F.max(tier).alias(tier))
    return per.groupBy(tier).agg(F.sum("wait").alias("wait"))


def exact_origin_ranges(reads: DataFrame, slots: DataFrame, key: str) -> DataFrame:
    """Virtual reads as original ranges: the slots a read covers whole; a read that cuts a slot is unknown (null ranges)."""
    hit = overlap_join(reads, slots, key)
    whole = (F.col("lo") <= F.col("r_lo")) & (F.col("hi") >= F.col("r_hi"))
    return hit.groupBy(key, "lo", "hi").agg(F.when(F.min(whole), F.sort_array(F.collect_list(F.struct("orig_lo", "orig_hi")))).alias("ranges"))
