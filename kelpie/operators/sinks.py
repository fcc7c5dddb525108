"""Sinks: history as JSON, published payloads, text records, event appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.functions.units import date_utc
from kelpie.functions.urls import coarse_url, salted_hash


def append_lines(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines; null fields are left out, so absent stays absent."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


def history_json(runs: DataFrame, shown: int = 200, redacted: bool = False, oldest_first: bool = False) -> DataFrame:
    """(place, json) of the newest runs; redacted ones lose host and stem and keep only the day."""
    newest = runs.orderBy(F.col("start_s").desc(), F.col("pid").desc()).limit(shown)
    rows = newest.withColumn("day", date_utc(F.col("start_s")))
    if redacted:
        rows = rows.drop("stem", "host", "pid", "start_s", "end_s", "run_settings", "redirector_hosts")
        order = [F.col("day").asc() if oldest_first else F.col("day").desc()]
    else:
        order = [F.col("start_s").asc(), F.col("pid").asc()] if oldest_first else [F.col("start_s").desc(), F.col("pid").desc()]
    # At most ``shown`` rows are numbered.
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order, F.xxhash64(*[c for c in rows.columns]))))
    return placed.select("place", F.to_json(F.struct(*[c for c in rows.columns])).alias("json"))


def serialize_marks(marks: DataFrame) -> DataFrame:
    """Source marks as text lines."""
    return marks.select(F.concat_ws(" ", "server", "site_name", "domain", "count", "first_s", "last_s", "until_s").alias("line"))


def serialize_roles(roles: DataFrame) -> DataFrame:
    return roles.select(F.concat_ws(" ", "server", "role", "saved_at", "text").alias("line"))


def serialize_hold(settings: DataFrame, ranges: DataFrame, faults: DataFrame) -> DataFrame:
    """(file, pos, line) of in-use records: settings, then ranges, then faults."""
    a = settings.select("file", F.lit(0).alias("part"), F.lit(0).cast("long").alias("o"), F.concat_ws(" ", F.lit("settings"), "settings").alias("line"))
    b = ranges.select("file", F.lit(1).alias("part"), F.col("lo").alias("o"), F.concat_ws(" ", F.lit("range"), "lo", "hi").alias("line"))
    c = faults.select("file", F.lit(2).alias("part"), F.col("at_s").alias("o"), F.concat_ws(" ", F.lit("fault"), "at_s", "what").alias("line"))
    return a.unionByName(b).unionByName(c).withColumn("pos", F.row_number().over(W.partitionBy("file").orderBy("part", "o"))).select("file", "pos", "line")


def redact_records(records: DataFrame, salt: Column, allowed: list[str], urls: list[str], hashed: list[str]) -> DataFrame:
    """What may leave a site: allowed fields as they are, URLs coarsened, names hashed; everything else is dropped."""
    keep = [F.col(c) for c in allowed if c in records.columns]
    keep += [coarse_url(F.col(c)).alias(c) for c in urls if c in records.columns]
    keep += [salted_hash(salt, F.col(c)).alias(c) for c in hashed if c in records.columns]
    return records.select(*keep)


def publish_payload(records: DataFrame, *keys: str) -> DataFrame:
    """(keys, payload): the records of a key as one JSON array, sorted."""
    return records.groupBy(*keys).agg(F.sort_array(F.collect_list(F.to_json(F.struct(*[c for c in records.columns if c not in keys])))).alias("r")).select(*keys, F.concat(F.lit("["), F.array_join("r", ","), F.lit("]")).alias("payload"))
