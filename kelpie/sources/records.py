"""Loaders for append-only records: counter lines, per-file records, events, traces, marks, holds, roles, benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Names of counters that add up over processes, high-water marks that do not, and histograms.
SUMS = (
    "opens validations_failed size_disagreements name_size_mismatches hit_bytes miss_bytes origin_bytes served_bytes origin_reads fetches_joined "
    "prefetch_issued_bytes prefetch_served_bytes prefetch_refetched_bytes prefetch_dropped_unread prefetch_late_bytes prefetch_parses "
    "prefetch_bridge_bytes prefetch_disabled prefetch_fetch_errors origin_readvs page_writes crc_failures meta_corrupt evicted_entries "
    "evicted_bytes failopen_events admissions_bypassed copier_handles copies_refused direct_read_files direct_read_bytes open_retries "
    "open_retries_exhausted replica_opens replica_published replica_invalid replica_crc_failures replica_punched_bytes replica_orphans_swept "
    "files_opened ram_hit_bytes first_touch_bytes hit_disk_reads hit_disk_bytes hit_disk_seq replica_bytes_served cold_replica_files "
    "cold_replica_in_bytes cold_replica_out_bytes cold_replica_baskets cold_replica_baskets_kept origin_checks_passed origin_checks_failed "
    "origin_checks_none origin_checks_unjudged origin_checks_skipped origin_checks_not_examined cold_replica_convert_us cold_replica_declined "
    "cold_replica_skipped cold_replica_waits cold_replica_wait_us cold_replica_completed cold_replica_completed_bytes fill_completed "
    "fill_completed_bytes slow_cache_episodes slow_cache_us fill_not_kept_bytes slot_maps_made slot_map_opens slot_map_full replica_reads "
    "replica_read_bytes relay_bytes readv_chunks readv_calls readv_mixed flush_runs flush_run_bytes buffer_stalls buffer_stall_us "
    "origin_open_attempts origin_open_failures origin_failures_client origin_failures_site origin_failures_notfound origin_failures_data "
    "origin_failures_expired origin_failures_other records_dropped open_failovers opens_recovered opens_failed_everywhere "
    "open_deadline_expiries failover_locates offline_copies_skipped open_check_bytes_kept bad_entries_dropped site_name_queries "
    "site_names_missing role_queries role_redirectors role_unanswered requests_parked_for_parse site_faults_marked site_marks_cleared "
    "copy_faults_marked marked_copies_last hosts_avoided cpu_us instructions cycles"
).split()
MARKS = ("handles_high_water", "threads_high_water", "peak_cores", "reads_in_flight_high_water", "origin_reads_in_flight_high_water")
HISTOGRAMS = (
    "hist_hit_read_us", "hist_origin_rt_us", "hist_open_us", "hist_replica_read_us", "hist_flush_write_us", "hist_meta_flush_us", "hist_relay_rt_us",
    "hist_req_read_bytes", "hist_hit_read_bytes", "hist_replica_read_bytes", "hist_origin_open_us",
)
# What the analysis of runs reads of them; its plans join runs many times, so they stay narrow.
RUN_SUMS = (
    "opens files_opened served_bytes hit_bytes ram_hit_bytes replica_bytes_served relay_bytes origin_bytes origin_reads origin_readvs "
    "prefetch_served_bytes prefetch_issued_bytes cold_replica_in_bytes hit_disk_reads hit_disk_bytes replica_reads replica_read_bytes crc_failures "
    "replica_crc_failures replica_invalid failopen_events meta_corrupt validations_failed evicted_entries evicted_bytes page_writes flush_runs "
    "flush_run_bytes buffer_stalls buffer_stall_us cpu_us instructions cycles"
).split()
TIMES = ("ts", "start_ms", "ts_ms", "disabled")
TEXTS = ("run_settings", "redirector_hosts", "counter_source")
FILE_SUMS = ("opens", "served_bytes", "ram_bytes", "replica_bytes", "disk_reads", "disk_seq", "disk_bytes", "first_touch_bytes", "wire_bytes", "span_us")
FILE_SCHEMA = ", ".join([f"{c} long" for c in ("ts", "ts_ms", *FILE_SUMS, "origin_size", "read_buckets", "orig_bytes", "unique_bytes")] + ["key string", "read_sig string", "mode string", "data_server string", "data_servers string", "url_host string", "kind string", "origin_rt_us array<long>"])


def counter_schema(sums: list[str]) -> str:
    return ", ".join([f"{c} long" for c in (*TIMES, *sums, *MARKS)] + [f"{c} array<long>" for c in HISTOGRAMS] + [f"{c} string" for c in TEXTS] + ["pmu_duty double"])


STEM = r"^(.+)-(\d+)-(\d+)-(\d+)$"


def lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(stem, pos, line): complete lines in file order; a line is complete when it ends with a brace."""
    raw = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    named = raw.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    return named.where(F.col("line").endswith("}")).select(F.regexp_replace("file", r"(\.files|\.trace)?\.jsonl$", "").alias("stem"), "file", "pos", "line")


def last_lines(all_lines: DataFrame) -> DataFrame:
    """The last complete line of every stem; a torn tail is skipped."""
    return all_lines.groupBy("stem").agg(F.max_by("line", "pos").alias("line"))


#: How a field of each kind looks in a line that does not parse as a whole.
_LOOSE = {"number": r'"(\w+)"\s*:\s*(-?[0-9.]+)', "string": r'"(\w+)"\s*:\s*"([^"]*)"', "array": r'"(\w+)"\s*:\s*\[([0-9, ]*)\]'}


def _field(name: str, kind: str) -> Column:
    """One field of a broken line, read on its own: the first of its name and kind."""
    of = "array" if kind == "array<long>" else "string" if kind == "string" else "number"
    text = F.nullif(F.try_element_at(F.col(f"loose.{of}.v"), F.nullif(F.array_position(f"loose.{of}.k", name), F.lit(0)).cast("int")), F.lit(""))
    if of == "array":
        return F.transform(F.split(text, r"\s*,\s*"), lambda x: x.try_cast("long"))
    return text if of == "string" else text.try_cast(kind)


def parse(all_lines: DataFrame, schema: str) -> DataFrame:
    """Lines as columns: the parser first, and field by field where one malformed value would null a whole line."""
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    found = lambda p, i: F.regexp_extract_all("line", F.lit(p), F.lit(i))
    loose = F.struct(*(F.struct(found(p, 1).alias("k"), found(p, 2).alias("v")).alias(of) for of, p in _LOOSE.items()))
    parsed = all_lines.withColumn("j", F.from_json("line", schema, {"mode": "PERMISSIVE"})).withColumn("broken", F.to_json("j") == "{}").withColumn("loose", F.when(F.col("broken"), loose))
    return parsed.select("*", *(F.when(F.col("broken"), _field(n, t)).otherwise(F.col(f"j.{n}")).alias(n) for n, t in fields)).drop("j", "broken", "loose", "line")


def parse_stem(stem: Column) -> dict[str, Column]:
    """Host (which may hold dashes), pid, start and sequence number, read from the right; null where it does not fit."""
    get = lambda i: F.nullif(F.regexp_extract(stem, STEM, i), F.lit(""))
    return {"host": get(1), "pid": get(2).try_cast("long"), "start_s": get(3).try_cast("long"), "seq": get(4).try_cast("long")}


def load_counters(spark: SparkSession, path: str, sums: list[str] = RUN_SUMS) -> DataFrame:
    """One row per counter file: its last complete snapshot.  Any stem will do; ``SUMS`` reads every counter."""
    own = lines(spark, path, "*.jsonl").where(~F.col("file").rlike(r"\.(files|trace)\.jsonl$"))
    return parse(last_lines(own), counter_schema(sums))


def run_stems(spark: SparkSession, path: str) -> DataFrame:
    """(stem) of every counter file of a folder, also of one without a complete line."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return names.where(~F.col("file").rlike(r"\.(files|trace)\.jsonl$")).select(F.regexp_replace("file", r"\.jsonl$", "").alias("stem"))


def load_file_records(spark: SparkSession, path: str) -> DataFrame:
    """Per-file records with their place in the file; lines without a key are left out."""
    return parse(lines(spark, path, "*.files.jsonl").drop("file"), FILE_SCHEMA).where(F.coalesce(F.col("key"), F.lit("")) != "")


def load_events(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Version 1 lines of one kind that carry no key."""
    rows = lines(spark, path, "*.files.jsonl").select("stem", "pos", F.from_json("line", f"kind string, v int, key string, {schema}").alias("j")).select("stem", "pos", "j.*")
    return rows.where((F.col("kind") == kind) & (F.col("v") == 1) & F.col("key").isNull()).drop("key")


def load_trace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(operations, legend, header) of trace files, told apart by ``op``."""
    schema = "t long, w long, op string, k string, off long, len long, us long, ds string, t0 long, nc long, key string, v int"
    rows = lines(spark, path, "*.trace.jsonl").select("stem", "pos", F.from_json("line", schema).alias("j")).select("stem", "pos", "j.*")
    return (rows.where(~F.col("op").isin("key", "meta")).drop("key", "v"), rows.where("op = 'key'").select("stem", "k", "key"), rows.where("op = 'meta'").select("stem", "t0", "v"))


def name_operations(operations: DataFrame, legend: DataFrame) -> DataFrame:
    """Operations with the key their hash stands for; unknown hashes stay with a null key."""
    return operations.join(legend.dropDuplicates(["stem", "k"]), ["stem", "k"], "left")


def union_by_stem(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both loads, where a stem in both is taken from the first."""
    both = first.withColumn("rank_", F.lit(0)).unionByName(second.withColumn("rank_", F.lit(1)))
    return both.withColumn("best_", F.min("rank_").over(W.partitionBy("stem"))).where("rank_ = best_").drop("rank_", "best_")


def text_lines(spark: SparkSession, path: str, complete: bool = False) -> DataFrame:
    """(file, pos, line) of small text records; ``complete`` leaves out a last line without its end."""
    parts = F.split("value", "\n", -1)
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.slice(parts, 1, F.size(parts) - 1) if complete else parts).alias("pos", "line")).where("line <> ''")


def parse_source_marks(all_lines: DataFrame, header: str) -> DataFrame:
    """server, site_name, domain, count, first_s, last_s, until_s: the newest per server of files with the right header; bad lines are skipped."""
    good = all_lines.withColumn("head", F.min_by("line", "pos").over(W.partitionBy("file"))).where((F.col("head") == header) & (F.col("pos") > 0))
    p = F.split("line", " ")
    number = lambda i: F.try_element_at(p, F.lit(i)).try_cast("long")
    rows = good.where(F.size(p) == 7).select(F.element_at(p, 1).alias("server"), F.element_at(p, 2).alias("site_name"), F.element_at(p, 3).alias("domain"), number(4).alias("count"), number(5).alias("first_s"), number(6).alias("last_s"), number(7).alias("until_s"))
    rows = rows.dropna(subset=["count", "first_s", "last_s", "until_s"])
    return rows.groupBy("server").agg(F.max_by(F.struct("site_name", "domain", "count", "first_s", "last_s", "until_s"), F.struct("last_s", "until_s", "count")).alias("m")).select("server", "m.*")


def parse_in_use(all_lines: DataFrame, header: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(settings, high, ranges, faults) of holds whose first line is the header; lines with a bad value are left out.

    settings: file, layout_version, slot_factor, codecs of the last good line ('-' is none); high: file, high, the
    largest; ranges: file, store_id, lo, hi, last_s, hold_s, pid; faults: file, site, server, last_s, first_s, reason,
    count.
    """
    from kelpie.functions.urls import decode_site

    head = F.min_by("line", "pos").over(W.partitionBy("file"))
    rows = all_lines.withColumn("head", head).where((F.col("head") == header) & (F.col("pos") > 0)).withColumn("p", F.filter(F.split("line", r"\s+"), lambda t: t != ""))
    text = lambda i: F.try_element_at(F.col("p"), F.lit(i))
    number = lambda i: text(i).try_cast("long")
    tagged = lambda tag: rows.where(text(1) == tag)
    settings = tagged("settings").select("file", "pos", number(2).alias("layout_version"), number(3).alias("slot_factor"), text(4).alias("codecs")).where("layout_version IS NOT NULL AND slot_factor BETWEEN 0 AND 65535 AND codecs IS NOT NULL")
    codecs = F.when(F.col("codecs") == "-", "").otherwise(F.col("codecs"))
    last = settings.groupBy("file").agg(F.max_by(F.struct("layout_version", "slot_factor", codecs.alias("codecs")), "pos").alias("s")).select("file", "s.*")
    high = tagged("high").select("file", number(2).alias("high")).where("high IS NOT NULL").groupBy("file").agg(F.max("high").alias("high"))
    ranges = tagged("range").where(text(2).rlike("^[0-9A-Fa-f]{1,16}$")).select("file", F.lower(text(2)).alias("store_id"), number(3).alias("lo"), number(4).alias("hi"), number(5).alias("last_s"), number(6).alias("hold_s"), number(7).alias("pid"))
    faults = tagged("fault").select("file", decode_site(text(2)).alias("site"), F.lower(text(3)).alias("server"), number(4).alias("last_s"), number(5).alias("first_s"), text(6).alias("reason"), number(7).alias("count"))
    return last, high, ranges.dropna().where("hi >= lo"), faults.dropna(subset=["server", "last_s", "first_s", "reason", "count"])


def parse_roles(all_lines: DataFrame, now: int, days: int = 30, most: int = 4096) -> DataFrame:
    """server, role, saved_at of verdicts at most ``days`` old; of a server the newest, of servers the ``most`` newest."""
    p = F.split("line", " ", 4)
    rows = all_lines.select(F.try_element_at(p, F.lit(1)).alias("server"), F.try_element_at(p, F.lit(2)).alias("role"), F.try_element_at(p, F.lit(3)).try_cast("long").alias("saved_at"), F.try_element_at(p, F.lit(4)).alias("text"))
    live = rows.where((F.col("saved_at") <= now) & (F.col("saved_at") > now - days * 86400)).groupBy("server").agg(F.max_by(F.struct("role", "saved_at", "text"), F.struct("saved_at", "role")).alias("m")).select("server", "m.*")
    return live.orderBy(F.col("saved_at").desc(), "server").limit(most)


def parse_bench(all_lines: DataFrame) -> DataFrame:
    """(file, pos, kind, json) of ``<kind>: {json}`` lines; the payload stays text, so numbers are re-emitted as written."""
    return all_lines.where(F.col("line").rlike(r"^[a-z_]+: \{.*\}$")).select("file", "pos", F.substring_index("line", ": ", 1).alias("kind"), F.regexp_extract("line", r"^[a-z_]+: (.*)$", 1).alias("json"))


def entry_names(all_lines: DataFrame, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(logical names, URLs) of names files: the last ``lfn`` line of a file, and of its ``url`` lines the newest distinct ones.

    A later line is newer, and a URL that is repeated counts at its last place; ``r`` is 1 for the newest.  Lines are
    those of ``text_lines(..., complete=True)``.
    """
    tag, name = F.substring_index("line", " ", 1), F.expr("substring(line, 5)")
    lfn = all_lines.where((tag == "lfn") & F.col("line").contains(" ")).groupBy("file").agg(F.max_by(name, "pos").alias("lfn"))
    last = all_lines.where((tag == "url") & F.col("line").contains(" ")).groupBy("file", name.alias("url")).agg(F.max("pos").alias("pos"))
    return lfn, last.withColumn("r", F.row_number().over(W.partitionBy("file").orderBy(F.col("pos").desc()))).where(F.col("r") <= most)


def settings(layers: dict[str, DataFrame]) -> DataFrame:
    """(key, value, source): layers from lowest to highest, each (key, value); the highest that names a key wins."""
    every = None
    for i, (name, rows) in enumerate(layers.items()):
        own = rows.select("key", "value", F.lit(name).alias("source"), F.lit(i).alias("layer"))
        every = own if every is None else every.unionByName(own)
    return every.where("value IS NOT NULL").groupBy("key").agg(F.max_by(F.struct("value", "source"), "layer").alias("m")).select("key", "m.*")


def parse_settings(all_lines: DataFrame) -> DataFrame:
    """(key, value) of ``key = value`` lines; comments and blanks are skipped, a later line wins."""
    clean = all_lines.withColumn("line", F.trim(F.regexp_replace("line", r"#.*$", ""))).where(F.col("line").contains("="))
    rows = clean.select("pos", F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.regexp_replace("line", r"^[^=]*=", "")).alias("value"))
    return rows.groupBy("key").agg(F.max_by("value", "pos").alias("value"))
