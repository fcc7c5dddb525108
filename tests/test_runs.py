"""Run records on disk through loaders, merging, measures and gain estimates."""

import json

import pytest
from pyspark.sql import functions as F

from kelpie.operators import runs as R
from kelpie.sources import records as S

GIB, MIB = 1 << 30, 1 << 20


class Folder:
    def __init__(self, path):
        self.path = path

    def run(self, start, seconds, counters, files=(), host="node-7.example", pid=None, extra=(), torn=""):
        stem = f"{host}-{pid or start}-{start}-0"
        line = json.dumps({"ts": start + seconds, "start_ms": start * 1000, "ts_ms": (start + seconds) * 1000, **counters}, separators=(",", ":"))
        (self.path / f"{stem}.jsonl").write_text("\n".join([*extra, line]) + "\n" + torn)
        (self.path / f"{stem}.files.jsonl").write_text("".join(json.dumps({"ts": start, **f}, separators=(",", ":")) + "\n" for f in files))
        return stem


def origin_hist(seconds):
    return [0] * 20 + [round(seconds / 1.572864)]


def fill(n):
    return {"origin_bytes": n, "served_bytes": n, "hit_bytes": 0, "opens": 1, "files_opened": 1}


def warm(n):
    return {"origin_bytes": 0, "served_bytes": n, "hit_bytes": n, "opens": 1, "files_opened": 1}


def baseline(n):
    return {"disabled": 1, "relay_bytes": n, "opens": 1, "files_opened": 1}


def wire(key, n, **more):
    return {"key": key, "wire_bytes": n, "origin_size": n, **more}


def served(key, n, **more):
    return {"key": key, "served_bytes": n, **more}


@pytest.fixture
def folder(tmp_path):
    return Folder(tmp_path)


def load(spark, folder):
    counters = S.load_counters(spark, str(folder.path))
    files = R.merge_file_records(S.load_file_records(spark, str(folder.path)))
    named = counters.withColumns(S.parse_stem(F.col("stem"))).withColumn("end_s", F.col("ts")).withColumn("complete", F.lit(True)).where("host IS NOT NULL")
    files = local(spark, files)
    return local(spark, R.measures(R.join_files(named, files))), files


def local(spark, df):
    """The same rows without their plan, so that the joins under test do not read the files again and again."""
    return spark.createDataFrame(df.collect(), df.schema)


def gain(spark, folder, stem):
    runs, files = load(spark, folder)
    return R.estimate_gains(runs, files).where(F.col("stem") == stem).first()


def test_stem_and_last_complete_line(spark, folder):
    folder.run(1700000000, 60, {"opens": 7, "hit_bytes": 1234}, host="DESKTOP-NJ0BO90", pid=4242, extra=['{"ts":1,"opens":1,"hit_bytes":5}'], torn='{"ts":99,"hit_b')
    runs, _ = load(spark, folder)
    r = runs.first()
    assert (r.host, r.pid, r.start_s, r.opens, r.hit_bytes, r.duration_s) == ("DESKTOP-NJ0BO90", 4242, 1700000000, 7, 1234, 60)


def test_malformed_histogram_drops_that_field_only(spark, folder):
    (folder.path / "h-1-2-0.jsonl").write_text('{"ts":9,"hist_origin_rt_us":[1,2,x,4],"threads_high_water":32}\n')
    r = S.load_counters(spark, str(folder.path)).first()
    assert r.hist_origin_rt_us is None and r.threads_high_water == 32 and r.ts == 9


def test_counters_sum_over_processes(spark, folder):
    (folder.path / "hostA-100-1.jsonl").write_text('{"opens":5,"hit_bytes":100,"origin_bytes":40,"origin_reads":2}\n{"opens":10,"hit_bytes":200,"origin_bytes":50,"origin_reads":4}\n')
    (folder.path / "hostB-200-1.jsonl").write_text('{"opens":3,"hit_bytes":30,"served_bytes":7,"failopen_events":1,"threads_high_water":4}\n')
    (folder.path / "hostC-1-1.jsonl").write_text("")
    (folder.path / "x.txt").write_text("no")
    a = R.aggregate_counters(S.load_counters(spark, str(folder.path))).first()
    assert (a.files, a.opens, a.hit_bytes, a.origin_bytes, a.origin_reads, a.served_bytes, a.failopen_events, a.threads_high_water, a.mixed) == (2, 13, 230, 50, 4, 7, 1, 4, False)


def test_every_counter_is_summed(spark, folder):
    for i in (1, 2):
        (folder.path / f"h-{i}-1-0.jsonl").write_text(json.dumps({c: i * (n + 1) for n, c in enumerate(S.SUMS)}, separators=(",", ":")) + "\n")
    a = R.aggregate_counters(S.load_counters(spark, str(folder.path), S.SUMS)).first()
    assert [a[c] for c in S.SUMS] == [3 * (n + 1) for n in range(len(S.SUMS))] and set(S.RUN_SUMS) < set(S.SUMS)


def test_gain_of_a_baseline(spark, folder):
    half = GIB // 2
    folder.run(500, 100, baseline(GIB), [wire("a", half), wire("b", half)])
    stem = folder.run(2000, 50, warm(GIB), [served("a", half), served("b", half)])
    g = gain(spark, folder, stem)
    assert g.valid and g.gain == pytest.approx(2.0) and g.saved_s == pytest.approx(50) and g.matched_files == 2 and g.origin_equivalent == GIB


REFUSED = [
    (fill(GIB), (50, warm(GIB), [served("a", GIB)]), "no_baseline"),
    (baseline(GIB), (50, {**fill(GIB), "hit_bytes": 8 * MIB}, [served("a", 8 * MIB)]), "filled"),
    (baseline(GIB), (50, warm(8 * MIB), [served("a", 8 * MIB)]), "too_small"),
    (baseline(GIB), (20, warm(GIB), [served("a", GIB)]), "too_short"),
    (baseline(GIB), (50, warm(GIB), []), "incomplete"),
    ({**baseline(GIB), "crc_failures": 3}, (50, warm(GIB), [served("a", GIB)]), "no_baseline"),
    (baseline(GIB), (50, baseline(GIB), [wire("a", GIB)]), "is_baseline"),
]


def test_refusals(spark, folder):
    """All cases at once: files of different cases have different keys."""
    want = {}
    for i, (reference, (seconds, counters, files), why) in enumerate(REFUSED):
        key = lambda fs, i=i: [{**f, "key": f"{f['key']}{i}"} for f in fs]
        folder.run(500 + i * 10_000, 100, reference, key([wire("a", GIB)]))
        want[folder.run(2000 + i * 10_000, seconds, counters, key(files))] = why
    runs, files = load(spark, folder)
    got = {r.stem: (r.valid, r.why) for r in R.estimate_gains(runs, files).collect()}
    assert {s: got[s] for s in want} == {s: (False, w) for s, w in want.items()}


def test_losses_are_not_clamped_and_coverage_counts(spark, folder):
    folder.run(500, 175, baseline(GIB), [wire("a", GIB)])
    stem = folder.run(2000, 250, warm(GIB), [served("a", GIB)])
    assert gain(spark, folder, stem).gain == pytest.approx(0.70)
    other = folder.run(9000, 50, warm(GIB), [served("z", GIB)])
    assert gain(spark, folder, other).why == "no_baseline"


def test_different_reads_are_refused(spark, folder):
    folder.run(500, 100, baseline(GIB), [wire("a", GIB, read_sig="x", read_buckets=3)])
    stem = folder.run(2000, 50, warm(GIB), [served("a", GIB, read_sig="y", read_buckets=3)])
    assert gain(spark, folder, stem).why == "read_different"


def test_latest_baseline_and_corrected_fill(spark, folder):
    folder.run(2900, 100, baseline(GIB), [wire("a", GIB)])
    folder.run(5000, 200, baseline(GIB), [wire("a", GIB)])
    stem = folder.run(3000, 50, warm(GIB), [served("a", GIB)])
    g = gain(spark, folder, stem)
    assert g.ref_start_s == 5000 and g.gain == pytest.approx(4.0)


def test_fill_corrected_by_the_nearest_warm_run(spark, folder):
    n = GIB
    part = [wire("a", int(n * 0.85), served_bytes=n - int(n * 0.85))]
    part[0]["origin_size"] = n
    folder.run(1000, 200, {**fill(int(n * 0.85)), "hit_bytes": n - int(n * 0.85), "hist_origin_rt_us": origin_hist(1000)}, part)
    folder.run(9000, 150, warm(n), [served("a", n, origin_size=n)])
    stem = folder.run(1300, 50, warm(n), [served("a", n, origin_size=n)])
    g = gain(spark, folder, stem)
    assert g.valid and g.corrected and g.corrected_s == pytest.approx((200 - 0.15 * 50) / 0.85, rel=1e-6)


def test_totals_datasets_history(spark, folder):
    half = GIB // 2
    folder.run(500, 100, baseline(GIB), [wire("d/a", half), wire("d/b", half)])
    folder.run(2000, 50, warm(GIB), [served("d/a", half), served("d/b", half)])
    folder.run(3000, 50, warm(MIB), [served("d/c", MIB)])
    runs, files = load(spark, folder)
    gains = R.estimate_gains(runs, files)
    t = R.totals(runs, files, gains).first()
    assert (t.runs, t.distinct_files, t.runs_estimated, t.faults) == (3, 3, 1, 0) and t.gain == pytest.approx(2.0) and t.saved_s == pytest.approx(50)
    sets = R.datasets(runs, files, gains).collect()
    assert [(d.files, d.runs, d.baselines, d.measured) for d in sets] == [(2, 2, 1, 1), (1, 1, 0, 0)]
    h = R.history(runs, 2).collect()
    assert [x.stem for x in h][-1] == "ALL" and len(h) == 3
    assert R.without_trivial(runs).count() == 3


def test_record_merge_is_an_ordered_fold(spark, folder):
    folder.run(
        1, 60, fill(1),
        [
            {"key": "k", "ts_ms": 1001000, "orig_bytes": 400, "unique_bytes": 380, "origin_rt_us": [1], "mode": "", "data_server": "s1"},
            {"key": "k", "ts_ms": 1003000, "orig_bytes": 700, "mode": "fill", "read_sig": "p", "read_buckets": 2},
            {"key": "k", "ts_ms": 1002000, "orig_bytes": 100, "unique_bytes": 90, "mode": "cached", "data_server": "s2", "read_sig": "q", "read_buckets": 2},
            {"key": "m", "ts_ms": 1, "orig_bytes": 842310, "unique_bytes": 140371}, {"key": "m", "ts_ms": 2},
            {"key": "n", "ts_ms": 1, "orig_bytes": 842310}, {"key": "n", "ts_ms": 2}, {"key": "n", "ts_ms": 3, "orig_bytes": 900000, "unique_bytes": 239745, "mode": "relay"}, {"key": ""},
        ],
    )
    rows = {r.key: r for r in R.merge_file_records(S.load_file_records(spark, str(folder.path))).collect()}
    k, m, n = rows["k"], rows["m"], rows["n"]
    assert (k.orig_bytes, k.unique_bytes, k.ts_ms, k.mode, k.data_server, k.read_sig) == (700, None, 1003000, "fill", "s2", "q")
    assert (m.orig_bytes, m.unique_bytes) == (None, None) and (n.orig_bytes, n.unique_bytes, n.mode) == (900000, 239745, "relay")


def test_runs_of_two_folders(spark, tmp_path):
    (tmp_path / "now").mkdir()
    (tmp_path / "old").mkdir()
    now, old = Folder(tmp_path / "now"), Folder(tmp_path / "old")
    both = now.run(3000, 50, warm(GIB), [served("root://h//a", GIB, ts=3090)])
    old.run(3000, 10, warm(5), [served("root://h//b", 5)])
    older = old.run(1000, 20, fill(7), [wire("root://h//c", 7)])
    killed = old.run(2000, 0, {}, [wire("root://h//d", 9, ts=2500)], host="k")
    (old.path / f"{killed}.jsonl").write_text('{"opens":1')
    (now.path / "empty-1-2500-0.jsonl").write_text("")
    (now.path / "notes.jsonl").write_text('{"opens":1}\n')
    runs, files = R.load_runs(spark, str(now.path), str(old.path))
    got = [(r.stem, r.complete, r.end_s, r.n_files) for r in runs.collect()]
    assert got == [(both, True, 3090, 1), (killed, False, 2500, 1), (older, True, 1020, 1)]
    assert sorted(r.key for r in files.collect()) == ["root://h//a", "root://h//c", "root://h//d"]
    assert R.load_runs(spark, str(now.path))[0].count() == 1


def test_names_in_settings(spark):
    rows = spark.createDataFrame([("a=1 logical_names=on/7f logical_names=on/8",), ("logical_names=on/9",), ("xlogical_names=on/9",), ("logical_names=on/",), (None,)], "run_settings string")
    assert [r[0] for r in rows.select(R.name_hash("run_settings")).collect()] == ["7f", "9", "", "", ""]
    assert R.keyed_by_name(rows, "9") and not R.keyed_by_name(rows, "8") and not R.keyed_by_name(rows, "")


def test_ratios_of_mixed_records(spark):
    rows = spark.createDataFrame([(10, 4, 2, 5), (30, 6, 2, None)], "hit_bytes long, first_touch_bytes long, hit_disk_reads long, replica_read_bytes long")
    rest = {c: F.lit(0) for c in ("opens", "files_opened", "ram_hit_bytes", "replica_bytes_served", "relay_bytes", "origin_bytes", "served_bytes", "hit_disk_bytes")}
    r = R.workflow_ratios(rows.withColumns(rest)).first()
    assert (r.mixed, r.reread, r.mean_disk_read, r.sequential_pct, r.vector_width) == (True, 4.0, None, None, None)
