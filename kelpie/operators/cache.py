"""Cache inventory: usage, coverage, eviction, clean-up, merges of sidecars, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.operators.intervals import overlap_join
from kelpie.operators.windows import running_before


def coverage(set_pages: Column, pages: Column) -> Column:
    return F.coalesce(F.try_divide(set_pages.cast("double"), pages), F.lit(0.0))


def usage(entries: DataFrame) -> DataFrame:
    return entries.agg(F.coalesce(F.sum(F.col("cached_bytes") + F.col("replica_bytes")), F.lit(0)).alias("usage"))


# The floor of free space that is kept where none is set: at most this, a tenth of the disk and half of what
# is free; a fifth of it where the disk does not tell.
FREE_FLOOR = 50 << 30


def free_floor(min_free: Column, automatic: Column, avail: Column, total: Column) -> Column:
    """Bytes to keep free: as set, else none unless the budget is automatic; ``avail`` and ``total`` are null or 0 if unknown."""
    known = F.coalesce((avail > 0) & (total > 0), F.lit(False))
    own = F.when(known, F.least(F.lit(FREE_FLOOR), F.floor(total / 10).cast("long"), F.floor(avail / 2).cast("long"))).otherwise(F.lit(FREE_FLOOR // 5))
    return F.when(min_free > 0, min_free).when(~automatic, F.lit(0)).otherwise(own)


def eviction_due(used: Column, max_bytes: Column, high_water: float, avail: Column, min_free: Column, now: Column, last_check: Column, every_s: Column, last_evicted: Column) -> Column:
    """Whether to evict now: over the mark of the budget, or below the floor of free space, at most once in ``every_s``.

    The pace does not hold back a cache over its mark whose last eviction freed something.  A limit of 0 is none.
    """
    over = (max_bytes > 0) & (used > F.floor(max_bytes * high_water))
    paced = (every_s > 0) & (now < last_check + every_s) & ~(over & (last_evicted != 0))
    return ~paced & (over | ((min_free > 0) & F.coalesce(avail < min_free, F.lit(False))))


def eviction_victims(entries: DataFrame, max_bytes: int, low_water: float, now: int, window_s: int, avail: int = 1 << 62, min_free: int = 0, parts: int = 64) -> DataFrame:
    """Entries to drop, oldest first, while usage is above the target or free space below its floor.

    Pinned entries, live ones, those in use and those read within the window are passed over.  Both conditions fall
    with the bytes freed, so one exclusive running sum decides; it runs over ranges of atime, not in one task.
    """
    used = usage(entries).first()["usage"]
    target = int(low_water * max_bytes) if max_bytes else None
    resume = min_free + min_free // 10
    credit = F.col("cached_bytes") + F.col("replica_bytes") + F.col("earlier_replica_bytes")
    free = entries.where("NOT pinned AND NOT live AND NOT in_use")
    if window_s:
        free = free.where(F.col("atime") < now - window_s)
    ordered = running_before(free.withColumn("credit", credit), ["atime", "key"], "credit", "freed", parts)
    over = F.lit(used) - F.col("freed") > target if target is not None else F.lit(False)
    return ordered.where(over | (F.lit(avail) + F.col("freed") < resume)).drop("credit")


def admission_blocked(entries: DataFrame, victims: DataFrame, max_bytes: int, low_water: float, now: int, window_s: int) -> DataFrame:
    """Whether usage stays above the target after the victims and a protected entry was seen."""
    left = entries.join(victims.select("key"), "key", "left_anti")
    protected = F.col("pinned") | F.col("live") | F.col("in_use") | (F.lit(window_s > 0) & (F.col("atime") >= now - window_s))
    return left.agg(((F.coalesce(F.sum(F.col("cached_bytes") + F.col("replica_bytes")), F.lit(0)) > int(low_water * max_bytes)) & F.coalesce(F.bool_or(protected), F.lit(False))).alias("blocked"))


def cleanup(entries: DataFrame, mode: str, arg: int = 0, now: int = 0, keep_pinned: bool = True, parts: int = 64) -> DataFrame:
    """Victims of a clean-up: 'all', 'older_than', 'newer_than' (seconds), or 'to_size' (bytes; oldest first)."""
    rows = entries.where("NOT pinned") if keep_pinned else entries
    if mode == "all":
        return rows
    if mode == "older_than":
        return rows.where(F.col("atime") < now - arg)
    if mode == "newer_than":
        return rows.where(F.col("atime") >= now - arg)
    if mode != "to_size":
        raise ValueError(mode)
    total = usage(entries).first()["usage"]
    ordered = running_before(rows.withColumn("credit", F.col("cached_bytes") + F.col("replica_bytes")), ["atime", "key"], "credit", "freed", parts)
    return ordered.where(F.lit(total) - F.col("freed") > arg).drop("credit")


def merge_sidecars(disk: DataFrame, sets: DataFrame, clears: DataFrame) -> DataFrame:
    """(key, page, crc) after a commit: what is on disk, mine set over it, and what I cleared taken away (a clear wins)."""
    mine = sets.select("key", "page", F.col("crc").alias("mine"))
    both = disk.join(mine, ["key", "page"], "full").select("key", "page", F.coalesce("mine", "crc").alias("crc"))
    return both.join(clears.select("key", "page").distinct(), ["key", "page"], "left_anti")


def merge_headers(disk: DataFrame, mine: DataFrame) -> DataFrame:
    """Headers after a commit: the pin only if I touched it, size confirmations or-ed, the later atime."""
    m = mine.select("key", *(F.col(c).alias(f"m_{c}") for c in ("pinned", "pin_touched", "size_confirmed", "atime")))
    rows = disk.join(m, "key", "full")
    no = F.lit(False)
    return rows.select("key", F.when(F.coalesce("m_pin_touched", no), F.col("m_pinned")).otherwise(F.coalesce("pinned", no)).alias("pinned"), (F.coalesce("size_confirmed", no) | F.coalesce("m_size_confirmed", no)).alias("size_confirmed"), F.greatest("atime", "m_atime").alias("atime"))


def orphans(artifacts: DataFrame, entries: DataFrame, key: str = "hash") -> DataFrame:
    """Artifacts of which no entry is left."""
    return artifacts.join(entries.select(key).distinct(), key, "left_anti")


def with_artifacts(entries: DataFrame, listing: DataFrame, suffixes: list[str]) -> DataFrame:
    """Entries with a flag per kind of artifact beside them."""
    flags = listing.groupBy("hash").agg(*(F.bool_or(F.col("suffix") == s).alias(f"has_{s}") for s in suffixes))
    return entries.join(flags, "hash", "left").fillna(False, [f"has_{s}" for s in suffixes])


#: Seconds after which whoever holds an entry says so again.
HOLD_REFRESH_S = 600


def in_use(entries: DataFrame, ranges: DataFrame, now: int, window_s: int) -> DataFrame:
    """Entries with a range (hash, last_s, hold_s) that is live: read within the window, or held and said so lately.

    Either time may be null or 0, which is never; one ahead of the clock counts as live.
    """
    last, hold = F.coalesce("last_s", F.lit(0)), F.coalesce("hold_s", F.lit(0))
    live = ranges.where(((last != 0) & (last + window_s > now)) | ((hold != 0) & (hold + 2 * HOLD_REFRESH_S > now)))
    return entries.join(live.select("hash").distinct(), "hash", "left_semi")


def in_use_ranges(asked: DataFrame, ranges: DataFrame, now: int, window_s: int) -> DataFrame:
    """Asked ranges (hash, lo, hi) with ``in_use``, whether a live range [r_lo, r_hi) overlaps, and ``free_at_s``.

    ``free_at_s`` is when the last overlapping range ends to be live, by its read and by its hold, and 0 where none
    overlaps.  Ranges meet in buckets of bytes.  Rows that repeat stay; empty ranges overlap nothing.
    """
    last, hold = F.coalesce("last_s", F.lit(0)), F.coalesce("hold_s", F.lit(0))
    until = F.greatest(F.when(last != 0, last + window_s).otherwise(0), F.when(hold != 0, hold + 2 * HOLD_REFRESH_S).otherwise(0))
    met = overlap_join(asked.select("hash", "lo", "hi").distinct(), ranges.select("hash", "r_lo", "r_hi", until.alias("until")), "hash").groupBy("hash", "lo", "hi").agg(F.max("until").alias("free_at_s"))
    return asked.join(met, ["hash", "lo", "hi"], "left").fillna(0, ["free_at_s"]).withColumn("in_use", F.col("free_at_s") > now)


def live_faults(faults: DataFrame, now: int, fault_s: int) -> DataFrame:
    """Faults proven within ``fault_s``; one ahead of the clock by over a minute is none."""
    return faults.where((F.col("last_s") + fault_s > now) & (F.col("last_s") <= now + 60))


#: Seconds for which an answer of the origin is trusted.
FRESH_S = 7 * 86400


def fresh(checked_at: Column, has_sidecar: Column, now: Column, window_s: int = FRESH_S) -> Column:
    """Whether an entry can be opened without asking its origin: it was checked within the window and has its sidecar."""
    return F.coalesce((now <= checked_at + window_s) & has_sidecar, F.lit(False))


def complete_entries(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries (key, n_pages) with ``complete``: all their pages are there, and there is one."""
    there = pages.select("key", "page").distinct().groupBy("key").agg(F.count("*").alias("there"))
    return entries.join(there, "key", "left").withColumn("complete", (F.col("n_pages") > 0) & (F.coalesce("there", F.lit(0)) == F.col("n_pages"))).drop("there")


def status(entries: DataFrame, now: int, window_s: int) -> DataFrame:
    """The status report: counts, bytes, protected entries and the upper median of coverage."""
    protected = ~F.col("pinned") & ((F.col("atime") >= now - window_s) | F.col("in_use"))
    size = F.col("cached_bytes") + F.col("replica_bytes")
    one = entries.agg(
        F.count("*").alias("entries"), F.count_if("pinned").alias("pinned"), F.count_if(protected).alias("protected"), F.sum(F.when(protected, size).otherwise(0)).alias("protected_bytes"),
        F.sum("file_size").alias("file_bytes"), F.sum("cached_bytes").alias("cached_bytes"), F.sum("replica_bytes").alias("replica_bytes"), F.count_if("declined").alias("declined"), F.sum("earlier_replica_bytes").alias("earlier_bytes"),
    )
    # Upper median by counts of values: as many rows as there are distinct coverages, and a task per range of them.
    counts = entries.groupBy("coverage").agg(F.count("*").alias("n"))
    ranked = running_before(counts, ["coverage"], "n", "before")
    half = F.floor(F.lit(entries.count()) / 2)
    median = ranked.where((F.col("before") <= half) & (F.col("before") + F.col("n") > half)).agg(F.max("coverage").alias("median_coverage"))
    k = F.lit(1)
    return one.withColumn("k", k).join(median.withColumn("k", k), "k", "left").drop("k").withColumn("cached_pct", F.try_divide(100.0 * F.col("cached_bytes"), F.col("file_bytes")))


def list_entries(entries: DataFrame, sort: str = "size") -> DataFrame:
    """Entries by cached bytes (largest first) or by age (oldest first); equal ones by key."""
    return entries.orderBy(F.col("cached_bytes").desc(), "key") if sort == "size" else entries.orderBy("atime", "key")


def adoptable(mode: str) -> Column:
    """Whether a stored entry fits what the origin says now, by validation mode."""
    size = F.col("stored_size") == F.col("origin_size")
    checks = {"none": F.lit(True), "size": size, "size+mtime": size & (F.col("stored_mtime") == F.col("origin_mtime")), "cksum": size & (F.col("stored_cksum") == F.col("origin_cksum"))}
    return F.coalesce(checks[mode], F.lit(False))


def validation_for(key: Column, default: str) -> Column:
    """Logical names are checked by size, local files by size and time."""
    return F.when(key.startswith("lfn:"), "size").when(key.startswith("root://local"), "size+mtime").otherwise(default)


def admission() -> Column:
    """What becomes of a new entry: the first rule that holds."""
    differs = F.col("live_size").isNotNull() & ((F.col("live_size") != F.col("size")) | (F.col("check_mtime") & (F.col("live_mtime") != F.col("mtime"))))
    return F.when(F.col("blocked"), "refused").when(differs, "size_disagreement").when(F.col("live_size").isNotNull(), "adopt").otherwise("start")


def map_due(covered: Column, converted: Column, last_made: Column, last_write: Column, now: int, interval: int, quiet: int) -> Column:
    """Whether a store's map should be made anew."""
    uncovered = converted - covered
    least = F.greatest(converted / 20, F.least(F.lit(8 << 20).cast("double"), covered.cast("double")))
    return (uncovered > 0) & (uncovered >= least) & (F.lit(now) >= last_made + interval) & (F.lit(now) >= last_write + quiet)


def capped_events(events: DataFrame, order: str, per_key: int = 16, queue: int = 4096, keys: tuple[str, ...] = ("file", "server", "cls")) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped count): at most ``per_key`` of a key, uncounted beyond; then the queue's cap, counted."""
    kept = events.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("r") <= per_key).drop("r")
    ranked = running_before(kept.withColumn("one", F.lit(1)), [order], "one", "before")
    return ranked.where(F.col("before") < queue).drop("one", "before"), ranked.agg(F.count_if(F.col("before") >= queue).alias("records_dropped"))


def uncommitted(mine: DataFrame, committed: DataFrame) -> DataFrame:
    """Slots of mine that nobody committed yet."""
    return mine.join(committed.select("branch", "slot").distinct(), ["branch", "slot"], "left_anti")


def newest_slots(blocks: DataFrame) -> DataFrame:
    """Of every slot the entry of the last valid block."""
    return blocks.where("valid").groupBy("branch", "slot").agg(F.max_by(F.struct("off", "len", "crc"), "block").alias("e")).select("branch", "slot", "e.*")


def resolve_aliases(aliases: DataFrame, entries: DataFrame) -> DataFrame:
    """Aliases whose entry exists in the generation they name; of several links of one alias the first made wins."""
    first = aliases.groupBy("alias").agg(F.min_by(F.struct("hash", "generation"), "made").alias("l")).select("alias", "l.*")
    return first.join(entries.select("hash", "generation"), ["hash", "generation"])
