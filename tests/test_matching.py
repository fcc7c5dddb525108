"""Matching of runs by classes: against every pair of runs in plain Python, and with too many pairs to be made."""

import random

from pyspark.sql import functions as F

from kelpie.operators import runs as R
from kelpie.plans import registry

MIB = 1 << 20
RUNS = "stem string, pid long, start_s long, duration_s long, is_disabled boolean, fill_candidate boolean, qualified boolean, origin_share double, origin_bytes long, cache_bytes long, cache_work long, n_files long, work long, wire long, replica long, faults long"
FILES = "stem string, key string, read_sig string, wire_bytes long, served_bytes long, replica_bytes long"


def some_runs(rng, n):
    """Runs of few keys; some can be a reference and be asked for, or fill and be warm, at once."""
    runs, files = [], []
    for i in range(n):
        own = []
        for key in rng.sample("abcdef", rng.randrange(1, 7)) if rng.random() < 0.4 else "abcd":
            wire, served = rng.choice([(40, 0), (0, 40), (35, 5), (1, 60), (50, 50)])
            own.append((f"r{i}", key, rng.choice([None, "", "x", "x", "x", "x", "y"]), wire * MIB, served * MIB, 0))
        wire, work = sum(f[3] for f in own), sum(f[3] + f[4] for f in own)
        disabled = rng.random() < 0.1
        candidate = not disabled and rng.random() < 0.5
        runs.append((f"r{i}", i % 7, 1000 + rng.randrange(n // 2), rng.randrange(5, 200), disabled, candidate, candidate and rng.random() < 0.5, rng.choice([0.8, 0.9, 1.0]), 100 * MIB, rng.choice([100, 100, 200, 50]) * MIB, work - wire, len(own), work, wire, 0, int(rng.random() < 0.1)))
        files += own
    return [r for i, r in enumerate(runs) if (r[1], r[2]) not in {(x[1], x[2]) for x in runs[:i]}], files


def by_pairs(runs, files):
    """{stem: corrected_s} and {stem: (why, ref, matched_files, sig_pairs, compared_files, saved_s)} from all pairs of runs."""
    names = [c.split()[0] for c in RUNS.split(", ")]
    rows = [dict(zip(names, r)) for r in runs]
    own = {r["stem"]: {} for r in rows}
    for stem, key, sig, wire, served, _ in files:
        if stem in own:
            own[stem][key] = (sig or "", wire, wire + served)

    def common(a, b, wired):
        keys = [k for k in own[a] if k in own[b] and (not wired or own[b][k][1] > 0)]
        signed = [k for k in keys if own[a][k][0] and own[b][k][0]]
        return keys, len(signed), sum(own[a][k][0] == own[b][k][0] for k in signed)

    fixes = {}
    for a in rows:
        near = []
        for b in rows:
            if a is b or a["is_disabled"] or not a["fill_candidate"] or b["is_disabled"] or b["faults"] or b["duration_s"] < 10 or b["wire"] > 0.05 * b["work"]:
                continue
            keys, signed, same = common(a["stem"], b["stem"], False)
            n = len(keys)
            if n and n >= 0.9 * a["n_files"] and n >= 0.9 * b["n_files"] and (signed == 0 or signed < 0.5 * n or same >= 0.9 * signed):
                near.append((abs(a["start_s"] - b["start_s"]), -b["start_s"], -b["pid"], b["duration_s"]))
        if near:
            f = max(0.0, 1 - a["origin_share"])
            off = (a["duration_s"] - f * min(near)[3]) / (1 - f)
            if off > 0:
                fixes[a["stem"]] = (f, off)
    found = {}
    for a in rows:
        why = "is_baseline" if a["is_disabled"] else "filled" if a["origin_bytes"] > a["cache_bytes"] else "too_small" if a["cache_bytes"] < 64 * MIB else "too_short" if a["duration_s"] < 30 else None
        fits, differs = [], False
        for b in rows if why is None else ():
            if a is b or b["duration_s"] < 30 or b["faults"] or b["wire"] < 64 * MIB or not (b["is_disabled"] or b["fill_candidate"] and (b["qualified"] or b["stem"] in fixes)):
                continue
            keys, signed, same = common(a["stem"], b["stem"], True)
            other = signed > 0 and signed >= 0.5 * len(keys) and same / signed < 0.9
            differs = differs or other
            c, d = sum(own[b["stem"]][k][1] for k in keys) / b["wire"], sum(own[a["stem"]][k][2] for k in keys) / a["work"]
            if keys and not other and c >= 0.7 and d >= 0.7:
                share, off = fixes.get(b["stem"], (0.0, None))
                used = off if not b["is_disabled"] and share > 0 else b["duration_s"]
                fits.append((b["is_disabled"], b["start_s"], b["pid"], b["stem"], len(common(a["stem"], b["stem"], False)[0]), signed, len(keys), round(used * c - a["duration_s"] * d, 6)))
        best = max(fits)[3:] if fits else (None,) * 5
        found[a["stem"]] = (why or ("measured" if fits else "read_different" if differs else "no_baseline"), *best)
    return {s: round(off, 6) for s, (_, off) in fixes.items()}, found


def test_classes_give_what_all_pairs_give(spark):
    runs, files = some_runs(random.Random(3), 300)
    fixes, found = by_pairs(runs, files)
    r, f = spark.createDataFrame(runs, RUNS), spark.createDataFrame(files, FILES)
    f = f.join(r.select("stem"), "stem", "left_semi")
    got = {x.stem: round(x.corrected_s, 6) for x in R.reference_corrections(r, f).collect()}
    assert got == fixes and len(got) > 10
    gains = {x.stem: (x.why, x.ref, x.matched_files, x.sig_pairs, x.compared_files, None if x.saved_s is None else round(x.saved_s, 6)) for x in R.estimate_gains(r, f).collect()}
    assert gains == found and {g[0] for g in gains.values()} >= {"measured", "read_different", "too_short", "filled"}


def test_runs_of_the_same_files_are_not_paired(spark):
    """40,000 runs of the same four files: 400 million pairs with a reference."""
    n = 40_000
    ids = spark.range(n).withColumn("stem", F.concat(F.lit("r"), "id")).withColumn("filled", F.col("id") % 2 == 0)
    bytes_ = 4 * 64 * MIB
    runs = ids.selectExpr(
        "stem", "id AS pid", "1000 + id * 2 AS start_s", "100L AS duration_s", "false AS is_disabled", "filled AS fill_candidate", "filled AS qualified", "1.0D AS origin_share", f"if(filled, {bytes_}L, 0L) AS origin_bytes",
        f"if(filled, 0L, {bytes_}L) AS cache_bytes", f"if(filled, 0L, {bytes_}L) AS cache_work", "4L AS n_files", f"{bytes_}L AS work", f"if(filled, {bytes_}L, 0L) AS wire", "0L AS replica", "0L AS faults",
    )
    files = ids.select("stem", "filled", F.explode(F.split(F.lit("a b c d"), " ")).alias("key")).selectExpr("stem", "key", "'x' AS read_sig", f"if(filled, {64 * MIB}L, 0L) AS wire_bytes", f"if(filled, 0L, {64 * MIB}L) AS served_bytes", "0L AS replica_bytes")
    assert R.reference_corrections(runs, files).agg(F.count("*"), F.sum("warm_start_s")).first() == (n // 2, sum(1000 + (i + 1) * 2 for i in range(0, n, 2)))
    gains = R.estimate_gains(runs, files).where("valid").agg(F.count("*"), F.min("ref"), F.max("ref"), F.max("matched_files")).first()
    assert gains == (n // 2, f"r{n - 2}", f"r{n - 2}", 4)


def sent(spark):
    """Rows written to shuffles by all stages so far."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_of_readers_are_summed_up_where_they_meet(spark, tmp_path):
    """60 groups of 40 readers of the same 40 parts: 46,800 pairs, each in 40 places."""
    lines = spark.range(60 * 40 * 40).selectExpr("id div 1600 * 40 + id % 40 AS l_suppkey", "id div 40 AS l_partkey", "double(id % 40 + 1) AS l_quantity")
    lines.repartition(4).write.parquet(str(tmp_path / "lineitem.parquet"))
    before = sent(spark)
    found = registry.QUERIES["q08_matching_work"](spark, str(tmp_path))
    assert found.agg(F.count("*"), F.min("common"), F.max("common"), F.min("c"), F.max("d"), F.count_if(F.col("stem") < F.col("ref"))).first() == (93_600, 40, 40, 1.0, 1.0, 46_800)
    # The lines themselves, the pairs once, and little else.
    assert sent(spark) - before < 96_000 + 46_800 + 20_000


def test_estimates_of_some_runs_use_references_of_all(spark):
    """What ``only`` leaves out is not estimated, and those left have what they had among all."""
    runs, files = some_runs(random.Random(8), 300)
    _, found = by_pairs(runs, files)
    r, f = spark.createDataFrame(runs, RUNS), spark.createDataFrame(files, FILES)
    f = f.join(r.select("stem"), "stem", "left_semi")
    newest = R.newest(R.long_enough(r), 40)
    gains = {x.stem: (x.why, x.ref, x.matched_files, x.sig_pairs, x.compared_files, None if x.saved_s is None else round(x.saved_s, 6)) for x in R.estimate_gains(r, f, only=newest).collect()}
    assert gains == {x.stem: found[x.stem] for x in newest.collect()}
    # Some references lie beyond those asked for.
    assert {g[1] for g in gains.values()} - {None} - set(gains)


def many_runs(spark, path):
    """Lines of 6,000 runs of 4, 7 or 10 files."""
    spark.range(60_000).selectExpr("id div 30 AS l_suppkey", "substr('ANR', int(id % 3) + 1, 1) AS l_returnflag", "id % 30 div 3 AS l_partkey", "double(id % 50 + 20) AS l_quantity").repartition(4).write.parquet(f"{path}/lineitem.parquet")


def test_totals_estimate_the_runs_that_they_count(spark, tmp_path):
    many_runs(spark, tmp_path)
    before = sent(spark)
    found = registry.QUERIES["q47_run_totals"](spark, str(tmp_path)).collect()
    assert [tuple(x) for x in found] == [(6000, 1_227_000, 462, 10, 36, 5865, 1580.172414, 1.206667)]
    # No signatures, and what classes of 60 runs have in common with others.
    assert sent(spark) - before < 130_000


def test_reasons_are_sought_for_the_runs_that_they_tell_of(spark, tmp_path):
    many_runs(spark, tmp_path)
    before = sent(spark)
    found = registry.QUERIES["q60_reasons"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [("filled", 12), ("is_baseline", 12)]
    assert sent(spark) - before < 130_000


def test_references_are_corrected_without_signatures(spark, tmp_path):
    many_runs(spark, tmp_path)
    before = sent(spark)
    found = registry.QUERIES["q46_corrected_references"](spark, str(tmp_path)).collect()
    assert len(found) == 987 and ("1-A", 0.130435, 42.0) in map(tuple, found)
    assert sent(spark) - before < 100_000
