"""Run analytics: per-run measures, matching of runs that did the same work, gain estimates, totals and datasets.

A run is one row (stem, host, pid, start_s, end_s, counters); its files are rows (stem, key, ...) merged from its
per-file records.  Runs with the same files, read in the same way, are of one class.  What two runs have in common is
that of their classes, so matching joins classes with classes and runs with classes, on the file key; no pair of runs is
made before the best reference of each class is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.functions.hashes import run_signatures
from kelpie.functions.hist import merge_arrays, to_array, total_seconds
from kelpie.functions.tables import written
from kelpie.sources.records import FILE_SUMS

MIN_BYTES = 64 << 20
MIN_S = 30
MIN_REFERENCE_S = 10
MIN_OVERLAP = 0.70
MIN_FILE_OVERLAP = 0.90
MIN_AGREEMENT = 0.90
MIN_COVERAGE = 0.50
MAX_OTHER_TIER = 0.05
ORIGIN_SHARE, ORIGIN_SHARE_CORRECTED, MAX_OVERHEAD = 0.90, 0.80, 0.10
ESTIMATE_CAP = 100

zero = lambda c: F.coalesce(F.col(c), F.lit(0))


def merge_file_records(records: DataFrame) -> DataFrame:
    """One row per (stem, key) from its records in order (``pos``).

    Sizes and times take the largest, counters add up; the read signature is that of the most buckets (the later at
    ties); the mode is the first non-empty one unless one is 'relay'; the data server is the last non-empty one.  The
    footprint (orig_bytes, unique_bytes) is an ordered fold: the largest counts, and a later record that has a
    millisecond time but no footprint clears what came before.
    """
    named = lambda c: F.nullif(F.col(c), F.lit(""))
    # The last clearing record; only records after it can give the footprint.
    cleared = F.max(F.when(F.col("orig_bytes").isNull() & F.col("ts_ms").isNotNull(), F.col("pos"))).over(W.partitionBy("stem", "key"))
    marked = records.withColumn("live", F.col("orig_bytes").isNotNull() & (F.col("pos") > F.coalesce(cleared, F.lit(-1))))
    footprint = F.max_by(F.struct("orig_bytes", "unique_bytes"), F.when(F.col("live"), F.struct("orig_bytes", "pos")))
    out = marked.groupBy("stem", "key").agg(
        F.max(zero("ts")).alias("ts"), F.max(zero("ts_ms")).alias("ts_ms"), F.max(zero("origin_size")).alias("origin_size"),
        *(F.sum(zero(c)).alias(c) for c in FILE_SUMS),
        F.max_by("read_sig", F.when(named("read_sig").isNotNull(), F.struct(zero("read_buckets").alias("b"), "pos"))).alias("read_sig"),
        F.max(F.when(named("read_sig").isNotNull(), zero("read_buckets"))).alias("read_buckets"),
        F.when(F.max(F.when(F.col("mode") == "relay", 1)) == 1, F.lit("relay")).otherwise(F.min_by("mode", F.when(named("mode").isNotNull(), F.col("pos")))).alias("mode"),
        F.max_by("data_server", F.when(named("data_server").isNotNull(), F.col("pos"))).alias("data_server"),
        F.max_by("url_host", F.when(named("url_host").isNotNull(), F.col("pos"))).alias("url_host"),
        footprint.alias("f"),
    )
    return out.select("*", "f.orig_bytes", "f.unique_bytes").drop("f")


def delivered() -> Column:
    return F.col("served_bytes") + F.col("replica_bytes") + F.col("wire_bytes")


def cache_bytes() -> Column:
    return zero("hit_bytes") + zero("replica_bytes_served")


def faults() -> Column:
    return zero("crc_failures") + zero("replica_crc_failures") + zero("replica_invalid") + zero("failopen_events") + zero("meta_corrupt")


def duration_s() -> Column:
    """Never zero."""
    return F.when(F.col("end_s") > F.col("start_s"), F.col("end_s") - F.col("start_s")).otherwise(F.lit(1))


def run_kind() -> Column:
    """The first that holds: baseline, fill, warm, mixed, idle."""
    origin, cache = zero("origin_bytes"), cache_bytes()
    return F.when(zero("disabled") != 0, "baseline").when((origin > 0) & (cache == 0), "fill").when((origin == 0) & (cache > 0), "warm").when((origin > 0) & (cache > 0), "mixed").otherwise("idle")


def file_mode() -> Column:
    """How a file was delivered, from its byte counts."""
    return F.when(F.col("direct_bytes") > F.col("served_bytes") + F.col("replica_bytes"), "relay").when(F.col("wire_bytes") > F.col("served_bytes"), "fill").otherwise("cached")


def has_token(settings: str, token: str) -> Column:
    return F.coalesce(F.array_contains(F.split(settings, " "), token), F.lit(False))


def name_hash(settings: str) -> Column:
    """The hash of the prefixes by which a run keyed its files, from its settings; '' where it did not."""
    return F.regexp_extract(F.concat(F.lit(" "), F.coalesce(F.col(settings), F.lit(""))), r"^.*? logical_names=on/([^ ]*)", 1)


def keyed_by_name(lines: DataFrame, prefixes_hash: str) -> bool:
    """Whether any line of a counter file, not only the last, tells of keys by these prefixes; reading ends at the first."""
    return not lines.where((name_hash("run_settings") == prefixes_hash) & (F.lit(prefixes_hash) != "")).isEmpty()


def without_trivial(runs: DataFrame) -> DataFrame:
    """Runs that opened, read or recorded something."""
    return runs.where((F.coalesce(F.col("n_files"), F.lit(0)) > 0) | (zero("files_opened") + zero("served_bytes") + zero("relay_bytes") + zero("origin_bytes") > 0))


def load_runs(spark: SparkSession, stats: str, archive: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, files) of one or two folders of records, ready for the other operators; newest run first.

    A stem in both folders is read from the first.  Names that do not parse are left alone.  A run without a complete
    counter line is there, with ``complete`` false and an end by its files, if it recorded any file.
    """
    from kelpie.sources import records

    def folder(path: str) -> tuple[DataFrame, DataFrame]:
        stems = records.run_stems(spark, path)
        counters = records.load_counters(spark, path).withColumn("complete", F.lit(True))
        return stems.join(counters, "stem", "left").fillna(False, ["complete"]), records.load_file_records(spark, path)

    counters, lines = folder(stats)
    if archive:
        older, older_lines = folder(archive)
        counters = records.union_by_stem(counters, older)
        lines = lines.unionByName(older_lines.join(records.run_stems(spark, stats), "stem", "left_anti"))
    named = counters.withColumns(records.parse_stem(F.col("stem"))).where("host IS NOT NULL AND pid IS NOT NULL AND start_s IS NOT NULL").withColumn("end_s", F.coalesce("ts", F.lit(0)))
    files = merge_file_records(lines).join(named.select("stem"), "stem", "left_semi")
    return join_files(named, files).where("complete OR n_files > 0").orderBy(F.col("start_s").desc(), F.col("pid").desc()), files


def join_files(runs: DataFrame, files: DataFrame, signed: bool = True) -> DataFrame:
    """Runs with what their files add: counts, sums, the share that came from the origin, a later end, and signatures (``sig``, ``run_read_sig``) unless ``signed`` is false."""
    d = delivered()
    weight = F.when(d > 0, F.when(F.col("origin_size") > 0, F.col("origin_size")).otherwise(d))
    per = files.groupBy("stem").agg(
        F.count("*").alias("n_files"), F.max("ts").alias("last_ts"), F.sum(d).alias("work"), F.sum(F.col("served_bytes") + F.col("replica_bytes")).alias("cache_work"),
        F.sum("wire_bytes").alias("wire"), F.sum("replica_bytes").alias("replica"), F.sum("origin_size").alias("input_size"),
        (F.sum(weight * F.try_divide(F.col("wire_bytes").cast("double"), d)) / F.sum(weight)).alias("share"),
    )
    if signed:
        per = per.join(run_signatures(files).select("stem", "sig", F.col("read_sig").alias("run_read_sig")), "stem", "left")
    both = runs.join(per, "stem", "left").fillna(0, ["n_files", "work", "cache_work", "wire", "replica", "input_size"])
    share = F.coalesce(F.col("share"), F.when(zero("disabled") != 0, 1.0).otherwise(0.0))
    return both.withColumn("end_s", F.greatest("end_s", "last_ts")).withColumn("origin_share", share).drop("last_ts", "share")


def measures(runs: DataFrame) -> DataFrame:
    """Adds what every later operator asks of a run (after ``join_files``)."""
    write_wait = total_seconds(F.col("hist_flush_write_us")) + total_seconds(F.col("hist_meta_flush_us")) + zero("buffer_stall_us") / 1e6
    rows = runs.withColumns({"duration_s": duration_s(), "cache_bytes": cache_bytes(), "faults": faults(), "kind": run_kind(), "is_disabled": zero("disabled") != 0, "origin_wait_s": total_seconds(F.col("hist_origin_rt_us")), "write_wait_s": write_wait})
    rows = rows.withColumn("overhead", F.when(F.col("origin_wait_s") > 0, F.col("write_wait_s") / F.col("origin_wait_s")).otherwise(0.0))
    quiet = (zero("prefetch_issued_bytes") == 0) & (zero("prefetch_served_bytes") == 0) & (zero("cold_replica_in_bytes") == 0)
    candidate = (F.col("origin_share") >= ORIGIN_SHARE_CORRECTED) & (zero("origin_bytes") >= F.col("cache_bytes")) & (F.col("origin_wait_s") > 0) & (F.col("overhead") <= MAX_OVERHEAD) & quiet
    stall, cpu = zero("buffer_stall_us"), zero("cpu_us")
    return rows.withColumns({"fill_candidate": candidate, "warm": (zero("origin_bytes") == 0) & (F.col("cache_bytes") > 0)}).withColumns(
        {
            "qualified": F.col("fill_candidate") & (F.col("origin_share") >= ORIGIN_SHARE),
            "fill_cost": F.when(stall == 0, 0.0).when(cpu <= 0, 1.0).otherwise(stall / (cpu + stall)),
            "cores_busy": cpu / 1e6 / F.col("duration_s"), "cores_writing": stall / 1e6 / F.col("duration_s"),
            "duration_ms": F.when((zero("start_ms") > 0) & (zero("ts_ms") >= zero("start_ms")), zero("ts_ms") - zero("start_ms")),
        }
    )


def _classes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stem, cls) of runs, and (cls, key, sig, wired) of the files of each class, both written.

    Runs are of one class if they have the same keys with the same read signatures, and the same of them came by wire.
    A class is named by the number of its files and two hashes of 64 bits over them.
    """
    marked = files.select("stem", "key", F.coalesce("read_sig", F.lit("")).alias("sig"), F.coalesce(F.col("wire_bytes") > 0, F.lit(False)).alias("wired"))
    sums = [F.hex(F.bit_xor(F.xxhash64(F.lit(salt), "key", "sig", "wired"))) for salt in (1, 2)]
    of = written(marked.groupBy("stem").agg(F.concat_ws("-", F.count("*"), *sums).alias("cls")))
    return of, written(marked.join(of.groupBy("cls").agg(F.min("stem").alias("stem")), "stem").drop("stem"))


def _class_pairs(members: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(cls, ref_cls, common, sig_pairs, sig_agree, and the same of the files that the reference has by wire) of classes with files in common."""
    a = members.join(left.select("cls").distinct(), "cls", "left_semi").select("cls", "key", F.col("sig").alias("sig_a"))
    b = members.join(right.select("cls").distinct(), "cls", "left_semi").select(F.col("cls").alias("ref_cls"), "key", F.col("sig").alias("sig_b"), "wired")
    both, w = (F.col("sig_a") != "") & (F.col("sig_b") != ""), F.col("wired")
    same = both & (F.col("sig_a") == F.col("sig_b"))
    return a.join(b, "key").groupBy("cls", "ref_cls").agg(
        F.count("*").alias("common"), F.count_if(both).alias("sig_pairs"), F.count_if(same).alias("sig_agree"),
        F.count_if(w).alias("wired_common"), F.count_if(w & both).alias("wired_pairs"), F.count_if(w & same).alias("wired_agree"),
    )


def _nearest_warm(fills: DataFrame, warm: DataFrame) -> DataFrame:
    """Fills with ``w``, the warm run of their group nearest in time but not themselves; ties go to the later start, then the larger pid.

    fills: grp, stem, start_s, ...; warm: grp, ref, warm_start_s, warm_pid, warm_s.
    """
    one = F.struct(F.col("warm_pid").alias("pid"), "ref", "warm_s", F.col("warm_start_s").alias("at"))
    # Of one start two are enough, as only a run itself is left out.
    at = warm.groupBy("grp", F.col("warm_start_s").alias("t")).agg(F.slice(F.sort_array(F.collect_list(one), False), 1, 2).alias("two"))
    asked = fills.select("grp", F.col("start_s").alias("t"), F.struct(*(c for c in fills.columns if c != "grp")).alias("fill"))
    rows = at.unionByName(asked, allowMissingColumns=True)
    there = F.col("two").isNotNull()
    # Both windows run from their start on: one that runs to the end of its group is summed up anew for each row.
    before = F.max(F.when(there, F.struct("t", "two"))).over(W.partitionBy("grp").orderBy("t").rangeBetween(W.unboundedPreceding, -1))
    after = F.max(F.when(there, F.struct((-F.col("t")).alias("t"), "two"))).over(W.partitionBy("grp").orderBy(F.col("t").desc()).rangeBetween(W.unboundedPreceding, -1))
    found = rows.withColumns({"b": before, "a": after, "now": F.max("two").over(W.partitionBy("grp", "t"))}).where("fill IS NOT NULL")
    now = F.get(F.filter("now", lambda x: x["ref"] != F.col("fill.stem")), F.lit(0))
    later = F.col("b").isNull() | (-F.col("a.t") - F.col("t") <= F.col("t") - F.col("b.t"))
    return found.select("fill.*", F.coalesce(now, F.get(F.when(F.col("a").isNotNull() & later, F.col("a.two")).otherwise(F.col("b.two")), F.lit(0))).alias("w"))


def reference_corrections(runs: DataFrame, files: DataFrame, classes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(stem, cache_share, warm_s, warm_start_s, corrected_s) of fills that a warm run of the same work corrects."""
    of, members = classes or _classes(files)
    fills = runs.where("NOT is_disabled AND n_files > 0 AND fill_candidate").select("stem", "start_s", "n_files", "duration_s", "origin_share").join(of, "stem")
    warm = runs.where(f"NOT is_disabled AND n_files > 0 AND faults = 0 AND duration_s >= {MIN_REFERENCE_S} AND work > 0 AND wire <= {MAX_OTHER_TIER} * work AND replica <= {MAX_OTHER_TIER} * work")
    warm = warm.select(F.col("stem").alias("ref"), F.col("start_s").alias("warm_start_s"), F.col("pid").alias("warm_pid"), F.col("n_files").alias("warm_files"), F.col("duration_s").alias("warm_s"), "stem").join(of, "stem").drop("stem")
    pairs = _class_pairs(members, fills, warm)
    agree = (F.col("sig_pairs") == 0) | (F.col("sig_pairs") < MIN_COVERAGE * F.col("common")) | (F.col("sig_agree") >= MIN_AGREEMENT * F.col("sig_pairs"))
    sizes = fills.select("cls", "n_files").distinct(), warm.select(F.col("cls").alias("ref_cls"), "warm_files").distinct()
    near = pairs.where(agree).join(sizes[0], "cls").join(sizes[1], "ref_cls").where((F.col("common") >= MIN_FILE_OVERLAP * F.col("n_files")) & (F.col("common") >= MIN_FILE_OVERLAP * F.col("warm_files")))
    group = F.concat_ws("/", "cls", "n_files").alias("grp")
    near = written(near.select(group, "ref_cls", "warm_files"))
    best = _nearest_warm(fills.select(group, "stem", "start_s", "duration_s", "origin_share"), near.join(warm.withColumnRenamed("cls", "ref_cls"), ["ref_cls", "warm_files"]).select("grp", "ref", "warm_start_s", "warm_pid", "warm_s")).where("w IS NOT NULL")
    f = F.greatest(F.lit(0.0), 1 - F.col("origin_share"))
    off = F.when(f < 1, (F.col("duration_s") - f * F.col("w.warm_s")) / (1 - f)).otherwise(0.0)
    return best.select("stem", f.alias("cache_share"), F.col("w.warm_s").cast("double").alias("warm_s"), F.col("w.at").alias("warm_start_s"), off.alias("corrected_s")).where("corrected_s > 0")


def estimate_gains(runs: DataFrame, files: DataFrame, fixes: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """Per run what the cache saved against a measured reference, or why that cannot be said.

    ``fixes`` are the ``reference_corrections`` where they are at hand.  ``only`` has the stems that are asked for, if
    not all are; references are sought among all runs even so.  A reference fits a run by what it shares with the run's
    class, and the run by what it shares with the reference's; the best reference of each pair of classes is found
    before runs and references meet.
    """
    of, members = classes = _classes(files)
    fixes = written(reference_corrections(runs, files, classes)) if fixes is None else fixes
    refs = runs.join(fixes, "stem", "left").where(
        f"(is_disabled OR (fill_candidate AND (qualified OR corrected_s IS NOT NULL))) AND n_files > 0 AND duration_s >= {MIN_S} AND faults = 0 AND wire >= {MIN_BYTES}"
    )
    refs = refs.join(of, "stem").select(F.col("stem").alias("ref"), F.col("cls").alias("ref_cls"), F.col("is_disabled").alias("ref_disabled"), F.col("start_s").alias("ref_start_s"), F.col("pid").alias("ref_pid"), F.col("duration_s").alias("ref_s"), F.col("wire").alias("ref_wire"), "cache_share", "corrected_s")
    refs = written(refs)
    why = (
        F.when(F.col("is_disabled"), "is_baseline").when(zero("origin_bytes") > F.col("cache_bytes"), "filled").when(F.col("cache_bytes") == 0, "incomplete")
        .when(F.col("cache_bytes") < MIN_BYTES, "too_small").when(F.col("n_files") == 0, "incomplete").when(F.col("duration_s") < MIN_S, "too_short").when(F.col("work") == 0, "incomplete")
    )
    asked = (runs if only is None else runs.join(only.select("stem"), "stem", "left_semi")).withColumn("refused", why)
    open_runs = written(asked.where("refused IS NULL").select("stem", "work").join(of, "stem"))
    pairs = _class_pairs(members, open_runs, refs.select(F.col("ref_cls").alias("cls"))).where("wired_common > 0")
    checkable = (F.col("wired_pairs") > 0) & (F.col("wired_pairs") >= MIN_COVERAGE * F.col("wired_common"))
    agreement = F.coalesce(F.try_divide(F.col("wired_agree"), F.col("wired_pairs")), F.lit(1.0))
    pairs = written(pairs.withColumn("checkable", checkable).withColumn("differs", F.col("checkable") & (agreement < MIN_AGREEMENT)))
    alike = pairs.where("NOT differs").select("cls", "ref_cls")
    # What of a reference the classes of runs hold, once for all classes of the same keys, and what of a run the classes of references hold.
    asking = members.join(open_runs.select("cls").distinct(), "cls", "left_semi").select("cls", "key")
    sets = written(asking.groupBy("cls").agg(F.concat_ws("-", F.count("*"), *(F.hex(F.bit_xor(F.xxhash64(F.lit(salt), "key"))) for salt in (1, 2))).alias("keys")))
    asking = asking.join(sets.groupBy("keys").agg(F.min("cls").alias("cls")), "cls").select("keys", "key")
    wires = files.where("wire_bytes > 0").select(F.col("stem").alias("ref"), "key", "wire_bytes").join(refs.select("ref"), "ref", "left_semi")
    offers = wires.join(asking, "key").groupBy("ref", "keys").agg(F.sum("wire_bytes").alias("matched_wire")).join(refs, "ref").withColumn("c", F.col("matched_wire") / F.col("ref_wire")).where(F.col("c") >= MIN_OVERLAP)
    order = [F.col("ref_disabled").desc(), F.col("ref_start_s").desc(), F.col("ref_pid").desc(), F.col("ref")]
    # Two of each set of keys and class, as a run that is among the references is not its own.
    offers = offers.withColumn("r", F.row_number().over(W.partitionBy("keys", "ref_cls").orderBy(*order))).where("r <= 2").drop("r")
    offers = written(offers.join(sets, "keys").drop("keys").join(alike, ["cls", "ref_cls"], "left_semi"))
    given = members.where("wired").join(refs.select(F.col("ref_cls").alias("cls")).distinct(), "cls", "left_semi").select(F.col("cls").alias("ref_cls"), "key")
    works = files.select("stem", "key", delivered().alias("work_a")).join(open_runs.select("stem"), "stem", "left_semi")
    takes = works.join(given, "key").groupBy("stem", "ref_cls").agg(F.sum("work_a").alias("matched_work")).join(open_runs, "stem").withColumn("d", F.col("matched_work") / F.col("work")).where(F.col("d") >= MIN_OVERLAP)
    fits = takes.select("stem", "cls", "ref_cls", "d").join(offers, ["cls", "ref_cls"]).where("stem <> ref")
    best = fits.withColumn("r", F.row_number().over(W.partitionBy("stem").orderBy(*order))).where("r = 1").drop("r")
    seen = pairs.select("cls", "ref_cls", F.col("common").alias("matched_files"), F.col("wired_pairs").alias("sig_pairs"), F.col("wired_common").alias("common"), "checkable")
    fixed = ~F.col("ref_disabled") & (F.coalesce("cache_share", F.lit(0.0)) > 0)
    best = best.join(seen, ["cls", "ref_cls"]).drop("cls").withColumn("corrected", fixed).withColumn("used_s", F.when(fixed, F.col("corrected_s")).otherwise(F.col("ref_s").cast("double")))
    misses = open_runs.select("stem", "cls").join(pairs.groupBy("cls").agg(F.max("differs").alias("any_differs")), "cls").drop("cls")
    out = asked.join(best, "stem", "left").join(misses, "stem", "left")
    saved = F.col("used_s") * F.col("c") - F.col("duration_s") * F.col("d")
    return out.select(
        "stem", F.coalesce("refused", F.when(F.col("ref").isNotNull(), "measured").when(F.col("any_differs"), "read_different").otherwise("no_baseline")).alias("why"),
        F.col("ref").isNotNull().alias("valid"), "ref", saved.alias("saved_s"), ((F.col("duration_s") + saved) / F.col("duration_s")).alias("gain"),
        (F.col("ref_wire") / F.col("ref_s") / 1e6).alias("origin_mb_s"), F.when(F.col("ref").isNotNull(), F.col("cache_work") / F.col("duration_s") / 1e6).alias("cache_mb_s"),
        F.col("matched_wire").alias("origin_equivalent"), "matched_files", F.col("n_files").alias("run_files"), "sig_pairs", F.col("common").alias("compared_files"),
        F.col("checkable").alias("verified"), "corrected", F.when(F.col("corrected"), F.col("corrected_s")).alias("corrected_s"), "ref_start_s",
    )


def work_pairs(lines: DataFrame, least: float, each: int = 1 << 19) -> DataFrame:
    """(stem, ref, common, c, d) of every two readers that share at least ``least`` of the keys of both; c, d: what of the reference's and of the reader's own amount lies there.

    ``lines`` are (s, k, q).  Keys are dealt by ranges of about ``each`` lines, so that readers near each other meet in
    few tasks and are summed up there before anything is sent; pairs are made one way round.
    """
    lines = lines.where("s IS NOT NULL")
    own = lines.repartitionByRange(max(1, -(-lines.count() // each)), "k").groupBy("s", "k").agg(F.sum("q").alias("q"))
    # Written, so that a range of keys stays in one file and its task.
    lists = written(own.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("s", "q"))).alias("own")))
    totals_ = written(lists.select(F.explode("own").alias("o")).groupBy("o.s").agg(F.count("*").alias("n"), F.sum("o.q").alias("t")))
    side = lambda s, x: totals_.select(F.col("s").alias(s), F.col("n").alias(f"n{x}"), F.col("t").alias(f"t{x}"))
    firsts = lists.where("k IS NOT NULL").select("own", F.posexplode("own").alias("i", "a"))
    pairs = firsts.select("a", F.explode(F.slice("own", F.col("i") + 2, F.size("own"))).alias("b")).select(F.col("a.s").alias("stem"), F.col("b.s").alias("ref"), F.col("a.q").alias("qa"), F.col("b.q").alias("qb"))
    per = pairs.groupBy("stem", "ref").agg(F.count("*").alias("common"), F.sum("qa").alias("qa"), F.sum("qb").alias("qb"))
    found = written(per.join(side("stem", "a"), "stem").join(side("ref", "b"), "ref").where((F.col("common") >= least * F.col("na")) & (F.col("common") >= least * F.col("nb"))))
    there, back = F.col("qa") / F.col("ta"), F.col("qb") / F.col("tb")
    one_way = found.select("stem", "ref", "common", back.alias("c"), there.alias("d"))
    return one_way.unionByName(found.select(F.col("ref").alias("stem"), F.col("stem").alias("ref"), "common", there.alias("c"), back.alias("d")))


def newest(runs: DataFrame, cap: int) -> DataFrame:
    """The newest ``cap`` runs, by start and process; ties go by name, so that two calls find the same runs."""
    return runs.orderBy(F.col("start_s").desc(), F.col("pid").desc(), "stem").limit(cap)


def long_enough(runs: DataFrame) -> DataFrame:
    """Runs that last long enough for totals to time them."""
    return runs.where(f"duration_s >= {MIN_REFERENCE_S}")


def totals(runs: DataFrame, files: DataFrame, gains: DataFrame, cap: int = ESTIMATE_CAP) -> DataFrame:
    """One row of totals; the gain is a ratio of sums over the newest ``cap`` runs that last long enough to be timed.

    Runs without a cache take their place among them; ``gain_capped`` counts what lies beyond.  ``gains`` of the newest
    ``cap`` of ``long_enough(runs)`` are enough.
    """
    g = newest(long_enough(runs), cap).select("stem", "duration_s").join(gains.where("valid").select("stem", "saved_s"), "stem").agg(F.count("*").alias("runs_estimated"), F.sum("saved_s").alias("saved_s"), F.sum("duration_s").alias("estimated_s"))
    own = runs.agg(
        F.count("*").alias("runs"), F.min("start_s").alias("first_start_s"), F.max("end_s").alias("last_end_s"), F.sum("duration_s").alias("duration_s"), F.sum(zero("hit_bytes")).alias("hit_bytes"),
        F.sum(zero("replica_bytes_served")).alias("replica_bytes"), F.sum(zero("relay_bytes")).alias("relay_bytes"), F.sum(zero("origin_bytes")).alias("origin_bytes"), F.sum("faults").alias("faults"),
        F.greatest(F.lit(0), F.count_if(F.col("duration_s") >= MIN_REFERENCE_S) - cap).alias("gain_capped"),
    )
    distinct = files.select("key").distinct().agg(F.count("*").alias("distinct_files"))
    # Three rows of one: joined on a constant key.
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(own).join(one(distinct), "k").join(one(g), "k").drop("k").withColumn("gain", F.when(F.col("estimated_s") > 0, (F.col("estimated_s") + F.col("saved_s")) / F.col("estimated_s")))


def usable_as_reference(runs: DataFrame, corrections: DataFrame) -> DataFrame:
    """Stems that can serve as a reference at all."""
    fixed = corrections.select("stem", F.lit(True).alias("fixed"))
    return runs.join(fixed, "stem", "left").where(f"duration_s >= {MIN_REFERENCE_S} AND (is_disabled OR qualified OR (fill_candidate AND fixed))").select("stem")


def datasets(runs: DataFrame, files: DataFrame, gains: DataFrame, cap: int = ESTIMATE_CAP, fixes: DataFrame | None = None) -> DataFrame:
    """One row per set of input files, by falling bytes read: runs, references, bytes, and the gains of its two tiers.

    Gains are those of the newest ``cap`` runs with a cache that last long enough, over all sets.
    """
    usable = usable_as_reference(runs, reference_corrections(runs, files) if fixes is None else fixes).withColumn("usable", F.lit(1))
    dirs = files.groupBy("stem").agg(F.count_distinct(F.regexp_replace("key", "/[^/]*$", "")).alias("n_dirs"))
    timed = newest(runs.where(f"n_files > 0 AND NOT is_disabled AND duration_s >= {MIN_REFERENCE_S}"), cap).select("stem")
    measured = gains.where("valid").join(timed, "stem").select("stem", F.lit(True).alias("valid"), "saved_s")
    rows = runs.where("n_files > 0").join(usable, "stem", "left").join(measured, "stem", "left").join(dirs, "stem", "left")
    replica = F.col("valid") & (zero("replica_bytes_served") > zero("hit_bytes"))
    byte = F.col("valid") & ~(zero("replica_bytes_served") > zero("hit_bytes"))
    largest = F.max_by(F.struct("n_files", "n_dirs", "input_size"), F.struct("n_files", "start_s", "pid"))
    out = rows.groupBy("sig").agg(
        F.count("*").alias("runs"), F.count_if(~F.col("complete")).alias("incomplete"), F.count("usable").alias("baselines"), F.sum(zero("served_bytes")).alias("read_bytes"), F.count_if("valid").alias("measured"), F.sum(F.when(F.col("valid"), zero("served_bytes")).otherwise(0)).alias("measured_bytes"), largest.alias("l"),
        F.count_if(byte).alias("byte_runs"), F.sum(F.when(byte, F.col("duration_s"))).alias("byte_wall"), F.sum(F.when(byte, F.col("saved_s"))).alias("byte_saved"),
        F.count_if(replica).alias("replica_runs"), F.sum(F.when(replica, F.col("duration_s"))).alias("replica_wall"), F.sum(F.when(replica, F.col("saved_s"))).alias("replica_saved"),
    )
    gain = lambda w, s: F.try_divide(F.col(w) + F.col(s), F.col(w))
    return out.select("sig", "runs", "incomplete", "baselines", "measured", "measured_bytes", "read_bytes", F.col("l.n_files").alias("files"), F.col("l.n_dirs").alias("dirs"), F.col("l.input_size").alias("origin_size"), "byte_runs", gain("byte_wall", "byte_saved").alias("byte_gain"), "replica_runs", gain("replica_wall", "replica_saved").alias("replica_gain")).orderBy(F.col("read_bytes").desc(), "sig")


def attribute_origin(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(stem, key, origin_host): the data server behind a redirector or a logical name, else the stored or named host.

    Only runs with failover look behind redirectors, by the host and port of the key; files without a host stay with null.
    """
    from kelpie.functions.urls import host_of, host_port_of

    info = runs.select("stem", F.split(F.lower(F.coalesce("redirector_hosts", F.lit(""))), " ").alias("redirectors"), has_token("run_settings", "failover=on").alias("failover"))
    stored, server = F.nullif(F.col("url_host"), F.lit("")), F.nullif(F.col("data_server"), F.lit(""))
    behind = F.col("failover") & F.array_contains("redirectors", host_port_of(F.col("key")))
    named = F.col("key").startswith("lfn:") & stored.isNull()
    host = F.when((F.coalesce(behind, F.lit(False)) | named) & server.isNotNull(), server).otherwise(F.coalesce(stored, F.nullif(host_of(F.col("key")), F.lit(""))))
    return files.join(info, "stem").select("stem", "key", host.alias("origin_host"))


def origin_counts(origins: DataFrame) -> DataFrame:
    """(stem, origin_host, files) after ``attribute_origin``; files without a host do not count."""
    return origins.where("origin_host IS NOT NULL").groupBy("stem", "origin_host").agg(F.count("*").alias("files"))


def origin_histograms(files: DataFrame, origins: DataFrame, by_domain: bool = False) -> DataFrame:
    """(stem, origin, hist): round trips of a run's files by host, or with the hosts of a registrable domain summed into it."""
    from kelpie.functions.urls import registrable_domain

    name = registrable_domain(F.col("origin_host")) if by_domain else F.col("origin_host")
    rows = files.select("stem", "key", "origin_rt_us").join(origins.where("origin_host IS NOT NULL"), ["stem", "key"]).withColumn("origin", name)
    return to_array(merge_arrays(rows, "origin_rt_us", "stem", "origin"), "stem", "origin")


def origin_domains(origins: DataFrame) -> DataFrame:
    """(stem, domain), each once."""
    from kelpie.functions.urls import registrable_domain

    return origins.where("origin_host IS NOT NULL").select("stem", registrable_domain(F.col("origin_host")).alias("domain")).distinct()


def reason_counts(runs: DataFrame, gains: DataFrame, cap: int = ESTIMATE_CAP) -> DataFrame:
    """(why, runs) of the newest ``cap`` runs that were not measured; their ``gains`` are enough."""
    return newest(runs, cap).select("stem").join(gains.select("stem", "why"), "stem").where("why <> 'measured'").groupBy("why").agg(F.count("*").alias("runs"))


def top_by_count(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Per key the most frequent value, the smallest at ties."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("n").desc(), value))).where("r = 1").drop("r")


def workflow_ratios(runs: DataFrame) -> DataFrame:
    """Ratios of a stats report, each null where its denominator is zero.

    Counters that ``runs`` lacks count as 0.  Figures per read are null where records of two versions meet: counters of
    some runs have ``replica_read_bytes`` and of others not.
    """
    names = (
        "opens files_opened hit_bytes ram_hit_bytes replica_bytes_served relay_bytes origin_bytes served_bytes hit_disk_reads hit_disk_bytes hit_disk_seq "
        "replica_reads first_touch_bytes readv_chunks readv_calls flush_runs flush_run_bytes"
    ).split()
    has = F.col("replica_read_bytes").isNotNull() if "replica_read_bytes" in runs.columns else F.lit(False)
    read = F.coalesce("replica_read_bytes", zero("replica_bytes_served")) if "replica_read_bytes" in runs.columns else zero("replica_bytes_served")
    s = runs.agg(*(F.sum(zero(c) if c in runs.columns else F.lit(0)).alias(c) for c in names), F.sum(read).alias("replica_read_bytes"), ((F.count_if(has) > 0) & (F.count_if(~has) > 0)).alias("mixed"))
    total = F.col("hit_bytes") + F.col("replica_bytes_served") + F.col("relay_bytes") + F.col("origin_bytes")
    share = lambda c: F.try_divide(100.0 * c, total)
    per_read = lambda a, b, by=1.0: F.when(~F.col("mixed"), F.try_divide(by * F.col(a), F.col(b)))
    return s.select(
        F.try_divide(F.col("opens"), F.col("files_opened")).alias("opens_per_file"), share(F.col("relay_bytes")).alias("direct_pct"), share(F.col("origin_bytes")).alias("fill_pct"), share(F.least("ram_hit_bytes", "hit_bytes")).alias("ram_pct"),
        share(F.greatest(F.lit(0), F.col("hit_bytes") - F.col("ram_hit_bytes"))).alias("disk_pct"), share(F.col("replica_bytes_served")).alias("replica_pct"), per_read("hit_disk_bytes", "hit_disk_reads").alias("mean_disk_read"),
        per_read("hit_disk_seq", "hit_disk_reads", 100.0).alias("sequential_pct"), per_read("replica_read_bytes", "replica_reads").alias("mean_replica_read"), F.when(F.col("hit_bytes") > 0, F.try_divide(F.col("hit_bytes"), F.col("first_touch_bytes"))).alias("reread"),
        per_read("readv_chunks", "readv_calls").alias("vector_width"), F.try_divide(F.col("flush_run_bytes"), F.col("flush_runs")).alias("mean_flush"), "mixed",
    )


def history(runs: DataFrame, top: int = 20) -> DataFrame:
    """The newest runs as report rows, and one ALL row over every run.

    ``tera_ins`` and ``giga_ins_s`` are null for a run without counted instructions, ``cores`` without CPU time and
    ``overhead_pct`` where nothing was asked of the origin; the ALL row has none of them.
    """
    total = zero("hit_bytes") + zero("replica_bytes_served") + zero("relay_bytes") + zero("origin_bytes")
    sums = {c: zero(c) for c in ("hit_bytes", "replica_bytes_served", "relay_bytes", "origin_bytes")}
    ins = F.nullif(F.col("instructions"), F.lit(0)) if "instructions" in runs.columns else F.lit(None).cast("long")
    own = {
        "tera_ins": ins / 1e12, "giga_ins_s": ins / 1e9 / F.col("duration_s"), "cores": F.nullif(zero("cpu_us"), F.lit(0)) / 1e6 / F.col("duration_s"),
        "overhead_pct": F.when(F.col("origin_wait_s") > 0, 100.0 * F.col("overhead")),
    }
    rows = runs.select("stem", "kind", "start_s", "pid", "duration_s", *(v.alias(k) for k, v in sums.items()), total.alias("total_bytes"), *(v.cast("double").alias(k) for k, v in own.items()))
    none = lambda kind, *names: (F.lit(None).cast(kind).alias(n) for n in names)
    every = rows.agg(*(F.sum(c).alias(c) for c in ("duration_s", *sums, "total_bytes"))).select(F.lit("ALL").alias("stem"), *none("string", "kind"), *none("long", "start_s", "pid"), "duration_s", *sums, "total_bytes", *none("double", *own))
    shown = rows.orderBy(F.col("start_s").desc(), F.col("pid").desc()).limit(max(1, top))
    pct = lambda c: F.try_divide(100.0 * F.col(c), F.col("total_bytes"))
    return shown.unionByName(every).select("stem", "kind", "start_s", "duration_s", (F.col("total_bytes") / 1e9).alias("gb"), F.try_divide(F.col("total_bytes") / 1e9, F.col("duration_s")).alias("gb_s"), pct("hit_bytes").alias("hit_pct"), pct("replica_bytes_served").alias("replica_pct"), pct("relay_bytes").alias("relay_pct"), pct("origin_bytes").alias("origin_pct"), *own)


def aggregate_counters(counters: DataFrame) -> DataFrame:
    """One row over all processes: sums of the counters they were loaded with, maxima of high-water marks, and whether schemas mix."""
    from kelpie.sources.records import MARKS, SUMS

    has = F.col("replica_read_bytes").isNotNull()
    sums = [F.sum(F.coalesce(F.col(c), F.col("replica_bytes_served") if c == "replica_read_bytes" else F.lit(0), F.lit(0))).alias(c) for c in SUMS if c in counters.columns]
    return counters.agg(F.count("*").alias("files"), *sums, *(F.max(zero(c)).alias(c) for c in MARKS), (F.count_if(has) > 0).alias("any_new"), (F.count_if(~has) > 0).alias("any_old")).withColumn("mixed", F.col("any_new") & F.col("any_old")).drop("any_new", "any_old")


def raw_field_sums(files: DataFrame) -> DataFrame:
    """Per run sums with the number of files each is over; a field that no file has stays null."""
    return files.groupBy("stem").agg(*(x for c in ("orig_bytes", "unique_bytes") for x in (F.sum(c).alias(c), F.count(c).alias(f"{c}_files"))), F.sum("origin_size").alias("files_bytes"))


def per_key_stats(files: DataFrame, top: int = 20) -> DataFrame:
    """Per file sums over runs; the ``top`` by delivered bytes as rows and the rest as one."""
    sums = ("opens", "served_bytes", "ram_bytes", "replica_bytes", "disk_reads", "disk_seq", "disk_bytes", "first_touch_bytes")
    per = files.groupBy("key").agg(*(F.sum(c).alias(c) for c in sums)).withColumn("total", F.col("served_bytes") + F.col("replica_bytes"))
    best = per.orderBy(F.col("total").desc(), "key").limit(top)
    rest = per.join(best.select("key"), "key", "left_anti").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in (*sums, "total"))).where("n > 0").withColumn("key", F.concat(F.lit("+"), F.col("n"))).drop("n")
    return best.unionByName(rest.select(best.columns)).withColumns({"sequential_pct": F.try_divide(100.0 * F.col("disk_seq"), F.col("disk_reads")), "reread": F.try_divide(F.col("disk_bytes"), F.col("first_touch_bytes"))})
