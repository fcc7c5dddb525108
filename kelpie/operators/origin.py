"""Origins and failover: failure classes, redirect chains, server tallies, expiring marks, ranking of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.functions.urls import site_of

# Client status codes and server error numbers of the protocol.
STATUS = {
    "data_error": 14, "invalid_address": 101, "socket_error": 102, "socket_timeout": 103, "socket_disconnected": 104, "poller_error": 105, "socket_option_error": 106,
    "stream_disconnect": 107, "connection_error": 108, "invalid_session": 109, "tls_error": 110, "handshake_failed": 202, "auth_failed": 204, "operation_expired": 206,
    "threshold_exceeded": 208, "invalid_response": 303, "not_found": 304, "redirect_limit": 306, "error_response": 400,
}
ERRNO = {
    "file_locked": 3003, "fs_error": 3005, "io_error": 3007, "no_memory": 3008, "not_authorized": 3010, "not_found": 3011, "server_error": 3012, "no_server": 3014,
    "cancelled": 3017, "it_exists": 3018, "overloaded": 3024, "request_timed_out": 3034,
}
IS_SERVER, IS_MANAGER, IS_META = 1, 2, 0x100
MARK_FIRST_S, MARK_MOST_S, MARK_SLACK_S = 600, 3600, 60
TOP_SERVERS = 8


def _status(code: Column, *names: str) -> Column:
    return code.isin([STATUS[n] for n in names])


def _errno(code: Column, errno: Column, *names: str) -> Column:
    return (code == STATUS["error_response"]) & errno.isin([ERRNO[n] for n in names])


def classify_failure(code: Column, errno: Column) -> Column:
    """none, client, expired, site, not_found, data or other."""
    return (
        F.when(code == 0, "none")
        .when(_status(code, "socket_error", "socket_timeout", "socket_disconnected", "stream_disconnect", "connection_error", "invalid_session", "tls_error", "auth_failed") | _errno(code, errno, "not_authorized"), "client")
        .when(_status(code, "operation_expired"), "expired").when(_status(code, "redirect_limit"), "site")
        .when(_status(code, "not_found") | _errno(code, errno, "not_found"), "not_found").when(_status(code, "data_error"), "data")
        .when(_errno(code, errno, "file_locked", "fs_error", "io_error", "server_error", "cancelled", "it_exists", "overloaded"), "site").otherwise("other")
    )


def site_fault(code: Column, errno: Column, own_time: Column, job_stream: Column) -> Column:
    """Which fault counts against a site: stall, server or none."""
    stall = (_status(code, "socket_timeout") & ~job_stream) | (_status(code, "operation_expired") & own_time)
    return F.when(stall, "stall").when(_errno(code, errno, "fs_error", "io_error", "server_error", "no_memory", "overloaded"), "server").otherwise("none")


def stale_advice(code: Column, errno: Column, first_attempt: Column) -> Column:
    """Whether a failure allows, blocks or says nothing about advising a held copy."""
    missing = _status(code, "not_found") | _errno(code, errno, "not_found")
    allows = (code == 0) | _status(
        code, "data_error", "invalid_address", "socket_error", "socket_timeout", "socket_disconnected", "poller_error", "socket_option_error", "stream_disconnect", "connection_error",
        "invalid_session", "tls_error", "handshake_failed", "operation_expired", "invalid_response", "redirect_limit",
    ) | _errno(code, errno, "io_error", "fs_error", "server_error", "overloaded", "no_server", "request_timed_out", "no_memory")
    return F.when(missing & first_attempt, "blocks").when(missing, "neutral").when(allows, "allows").otherwise("blocks")


def retryable_open(code: Column, errno: Column) -> Column:
    return _status(code, "connection_error", "socket_error", "socket_timeout", "operation_expired", "threshold_exceeded") | _errno(code, errno, "it_exists", "server_error", "fs_error", "io_error", "no_server", "cancelled", "file_locked", "overloaded")


def retry_bound_ms(attempt: Column, base: int, cap: int) -> Column:
    """The base doubled for every attempt after the first, at most the cap."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.least(F.greatest(attempt, F.lit(1)) - 1, F.lit(40)))).cast("long")


def open_deadline(now: Column, budget: Column, limit: Column, spent: Column) -> dict[str, Column]:
    """When an open has to end, and whether its time is spent."""
    deadline = F.least(now + budget, F.coalesce(limit, now + budget))
    return {"deadline": deadline, "left": F.greatest(F.lit(0), deadline - now - spent), "budget_spent": spent >= budget}


def read_chain(df: DataFrame, hops: str = "hops") -> DataFrame:
    """last, effective, regional (places from 0, -1 for none) and via_redirector of an array of (host, port, flags)."""
    n = F.size(hops)
    flag = lambda h, bit: h["flags"].bitwiseAND(F.lit(bit)) != 0
    at = F.transform(hops, lambda h, i: F.struct(i.alias("i"), flag(h, IS_MANAGER).alias("m"), flag(h, IS_META).alias("meta"), flag(h, IS_SERVER).alias("s")))
    place = lambda xs, least: F.coalesce((F.array_min if least else F.array_max)(F.transform(xs, lambda x: x["i"])), F.lit(-1))
    regional = place(F.filter(at, lambda x: x["m"] & ~x["meta"]), True)
    sent_on = place(F.filter(at, lambda x: ~x["m"] & x["s"] & (x["i"] + 1 < n)), False)
    plain_end = (n > 0) & ~F.coalesce(F.try_element_at(at, F.lit(-1))["m"], F.lit(True))
    return df.withColumns({"last": n - 1, "regional": regional, "effective": F.when(sent_on >= 0, sent_on).when(plain_end, n - 1).otherwise(F.lit(-1)), "via_redirector": F.exists(at, lambda x: x["m"])})


def server_tally(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, server, opens, bytes, slowest): sums and maxima per server."""
    return df.groupBy(*keys, "server").agg(F.sum("opens").alias("opens"), F.sum("bytes").alias("bytes"), F.max("slowest").alias("slowest"))


def tally_text(tally: DataFrame, value: str, *keys: str, top: int = TOP_SERVERS) -> DataFrame:
    """(keys, text): the top servers as 'name value' and '+N value' for the rest, equal ones by name."""
    ranked = tally.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(value).desc(), "server")))
    # Beyond the top the rest is one sum, so a key never gathers more than top + 1 rows.
    cut = ranked.groupBy(*keys, F.least("r", F.lit(top + 1)).alias("r")).agg(F.min("server").alias("server"), F.sum(value).alias("v"), F.count("*").alias("n"))
    name = F.when(F.col("r") <= top, F.col("server")).otherwise(F.concat(F.lit("+"), F.col("n")))
    parts = cut.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("r", F.concat_ws(" ", name, F.col("v")).alias("t")))).alias("p"))
    return parts.select(*keys, F.array_join(F.transform("p", lambda x: x["t"]), ", ").alias("text"))


def top_server(tally: DataFrame, value: str, *keys: str) -> DataFrame:
    """Per key the server with the largest value, the first by name at ties."""
    return tally.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(value).desc(), "server"))).where("r = 1").drop("r")


def mark_seconds(count: Column) -> Column:
    return F.least(F.lit(MARK_MOST_S), F.lit(MARK_FIRST_S) * F.pow(F.lit(2.0), F.least(F.greatest(count, F.lit(1)) - 1, F.lit(20)))).cast("long")


def mark_live(now: Column) -> Column:
    """A mark that has not ended and does not end later than any mark could: the clock may have gone back."""
    return (F.col("count") > 0) & (F.col("until_s") > now) & (F.col("until_s") - now <= MARK_MOST_S + MARK_SLACK_S)


def forget_marks(marks: DataFrame, now: int) -> DataFrame:
    """Marks that stay at the next write: those that ended more than a day ago go with their count."""
    return marks.where((F.col("count") > 0) & (F.col("until_s") + 86400 >= now))


def same_site(a: str, b: str) -> Column:
    """Names where both are known, else domains; not transitive, hence a condition and not a key."""
    name = lambda t: F.nullif(F.col(f"{t}.site_name"), F.lit(""))
    domain = lambda t: F.nullif(F.col(f"{t}.domain"), F.lit(""))
    return F.when(name(a).isNotNull() & name(b).isNotNull(), name(a) == name(b)).otherwise(F.coalesce(domain(a) == domain(b), F.lit(False)))


def marked_sites(asked: DataFrame, marks: DataFrame, now: int) -> DataFrame:
    """Asked (site_name, domain) pairs that at least two live marks match, with the newest failure.

    Every pair that matches shares its name or its domain, so two equi-joins find the candidates.
    """
    live = marks.where(mark_live(F.lit(now))).select("server", "site_name", "domain", "last_s").alias("m")
    ask = asked.select("site_name", "domain").distinct().alias("a")
    known = lambda t, c: F.nullif(F.col(f"{t}.{c}"), F.lit(""))
    pick = lambda d: d.where(same_site("a", "m")).select("a.site_name", "a.domain", "m.server", "m.last_s")
    pairs = pick(ask.join(live, known("a", "site_name") == known("m", "site_name"))).unionByName(pick(ask.join(live, known("a", "domain") == known("m", "domain")))).distinct()
    return pairs.groupBy("site_name", "domain").agg(F.count("*").alias("marks"), F.max("last_s").alias("newest_s")).where("marks >= 2")


def failed_sites(failures: DataFrame, *keys: str) -> DataFrame:
    """Distinct sites among failures that were not avoided, by name or else domain (an approximation: see ``same_site``)."""
    site = F.coalesce(F.nullif(F.col("site_name"), F.lit("")), F.nullif(F.col("domain"), F.lit("")), F.col("server"))
    return failures.where(F.coalesce(F.col("avoided"), F.lit("")) == "").groupBy(*keys).agg(F.count_distinct(site).alias("sites"))


def after_failure(sites: Column, most: int, spent: Column, seen: Column) -> Column:
    return F.when((sites >= most) | spent, "stop").when(seen, "repeat").otherwise("retry")


def order_locations(listed: DataFrame, tried: DataFrame, failures: DataFrame, marks: DataFrame, now: int) -> DataFrame:
    """Copies of a file in the order to try them, as ``rank`` per file.

    Online copies, then pending ones, then marked ones (the oldest failure first, online before pending), each in
    listed order.  Copies at a failed site come only if nothing else is left, the oldest failure first, and a server
    that refused never.  What the reader has tried is left out.
    """
    rows = listed.withColumn("server", F.concat(F.lower("host"), F.lit(":"), F.col("port").cast("string"))).withColumn("site", site_of(F.col("host")))
    gone = tried.select(F.col("file").alias("t_file"), F.lower("host").alias("t_host")).distinct()
    rows = rows.join(gone, (F.col("file") == F.col("t_file")) & (F.lower("host") == F.col("t_host")), "left_anti")
    bad = failures.where(F.coalesce(F.col("avoided"), F.lit("")) == "").select("file", F.lower("server").alias("server"), "domain", "position", "refused")
    by_server = bad.groupBy("file", "server").agg(F.min("position").alias("p1"), F.bool_or("refused").alias("refused"))
    by_site = bad.where("domain <> ''").groupBy("file", F.col("domain").alias("site")).agg(F.min("position").alias("p2"))
    live = marks.where(mark_live(F.lit(now))).select(F.lower("server").alias("server"), F.col("last_s").alias("marked_at"))
    joined = rows.join(by_server, ["file", "server"], "left").join(by_site, ["file", "site"], "left").join(live, "server", "left").withColumn("age", F.least("p1", "p2"))
    tier = F.when(F.col("age").isNotNull(), 3).when(F.col("marked_at").isNotNull(), 2).when(F.col("pending"), 1).otherwise(0)
    tiered = joined.where(~(F.col("age").isNotNull() & F.coalesce(F.col("refused"), F.lit(False)))).withColumn("tier", tier)
    best = F.min("tier").over(W.partitionBy("file"))
    usable = tiered.withColumn("best", best).where((F.col("tier") < 3) | (F.col("best") == 3))
    order = W.partitionBy("file").orderBy("tier", F.coalesce("age", "marked_at", F.lit(0)), F.col("pending"), "listed")
    return usable.withColumn("rank", F.row_number().over(order)).select("file", "host", "port", "listed", "tier", "rank")


def storage_grade(p50_ms: Column, iops16: Column, sequential_mb_s: Column) -> Column:
    """GOOD by latency of one reader, else by what many readers get."""
    return F.when(p50_ms <= 0.5, "GOOD").when(iops16 >= 3000, "GOOD").when(sequential_mb_s >= 300, "REPLICA-ONLY").otherwise("BAD")
