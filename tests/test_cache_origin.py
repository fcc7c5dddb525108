import pytest
from pyspark.sql import functions as F

from kelpie.operators import cache, columns, origin, physics
from kelpie.sources import records

ENTRY = "key string, hash string, file_size long, cached_bytes long, replica_bytes long, earlier_replica_bytes long, atime long, coverage double, pinned boolean, live boolean, in_use boolean, declined boolean"


def entries(spark, rows):
    return spark.createDataFrame([(k, k, n, n, 0, 0, t, 1.0, pin, False, False, False) for k, n, t, pin in rows], ENTRY)


def test_eviction_and_cleanup(spark):
    e = entries(spark, [(f"e{i}", 163840, 1000 + i, False) for i in range(3)])
    assert {r.key for r in cache.eviction_victims(e, 1_000_000, 0.25, 5000, 0).collect()} == {"e0", "e1"}
    assert cache.eviction_victims(e, 1_000_000, 0.75, 5000, 0).count() == 0
    assert cache.eviction_victims(e, 1_000_000, 0.25, 1500, 600).count() == 0
    assert cache.admission_blocked(e, e.limit(0), 1_000_000, 0.25, 1500, 600).first().blocked is True
    old = entries(spark, [("ancient", 1, 0, False), ("recent", 1, 9000, False), ("kept", 1, 0, True)])
    keys = lambda mode, arg: {r.key for r in cache.cleanup(old, mode, arg, 10_000).collect()}
    assert keys("older_than", 3600) == {"ancient"} and keys("newer_than", 3600) == {"recent"} and keys("all", 0) == {"ancient", "recent"}
    three = entries(spark, [(f"e{i}", 40960, i, False) for i in range(3)])
    assert {r.key for r in cache.cleanup(three, "to_size", 40960 + 4096).collect()} == {"e0", "e1"}


def test_merges_orphans_status(spark):
    disk = spark.createDataFrame([("k", 0, 1), ("k", 1, 2), ("k", 2, 3)], "key string, page int, crc long")
    sets = spark.createDataFrame([("k", 1, 9), ("k", 5, 8)], "key string, page int, crc long")
    clears = spark.createDataFrame([("k", 5), ("k", 0)], "key string, page int")
    assert sorted(tuple(r) for r in cache.merge_sidecars(disk, sets, clears).collect()) == [("k", 1, 9), ("k", 2, 3)]
    e = entries(spark, [("a", 10, 5, False), ("b", 20, 50, False), ("c", 30, 60, True)])
    s = cache.status(e, 60, 20).first()
    assert (s.entries, s.pinned, s.protected, s.protected_bytes, s.median_coverage) == (3, 1, 1, 20, 1.0)
    art = spark.createDataFrame([("a", "rep"), ("z", "rep")], "hash string, suffix string")
    assert [r.hash for r in cache.orphans(art, e).collect()] == ["z"]
    assert {r.key: r.has_rep for r in cache.with_artifacts(e, art, ["rep"]).collect()} == {"a": True, "b": False, "c": False}


def test_failures_and_chains(spark):
    rows = [(0, 0, "none", "none"), (103, 0, "client", "stall"), (206, 0, "expired", "none"), (400, 3011, "not_found", "none"), (400, 3024, "site", "server"), (14, 0, "data", "none"), (999, 0, "other", "none")]
    df = spark.createDataFrame(rows, "code int, errno int, cls string, fault string")
    no = F.lit(False)
    for r in df.withColumn("c", origin.classify_failure(F.col("code"), F.col("errno"))).withColumn("f", origin.site_fault(F.col("code"), F.col("errno"), no, no)).collect():
        assert (r.c, r.f) == (r.cls, r.fault)
    hops = spark.createDataFrame([([("m", 1, 2 | 256), ("r", 1, 2), ("s", 1, 1), ("t", 1, 1)],), ([("m", 1, 2)],), ([],)], "hops array<struct<host:string,port:int,flags:int>>")
    assert [(r.last, r.regional, r.effective, r.via_redirector) for r in origin.read_chain(hops).collect()] == [(3, 1, 2, True), (0, 0, -1, True), (-1, -1, -1, False)]


def test_marks_and_ranking(spark):
    assert [spark.range(1).select(origin.mark_seconds(F.lit(n)).alias("s")).first().s for n in (1, 2, 3, 9)] == [600, 1200, 2400, 3600]
    marks = spark.createDataFrame([("a:1", "S", "x", 1, 1, 10, 13600), ("b:1", "S", "y", 1, 1, 20, 13600), ("c:1", "", "z", 1, 1, 5, 13600)], "server string, site_name string, domain string, count int, first_s long, last_s long, until_s long")
    live = lambda now: marks.where(origin.mark_live(F.lit(now))).count()
    assert (live(10000), live(9940), live(9939), live(13600)) == (3, 3, 0, 0)
    asked = spark.createDataFrame([("S", ""), ("", "z")], "site_name string, domain string")
    assert [(r.site_name, r.marks, r.newest_s) for r in origin.marked_sites(asked, marks, 10000).collect()] == [("S", 2, 20)]
    listed = spark.createDataFrame([("f", h, 1, i, p) for i, (h, p) in enumerate([("a", False), ("p.q.r", True), ("o.q.s", False), ("bad.w.x", False), ("t.q.z", False)])], "file string, host string, port int, listed int, pending boolean")
    tried = spark.createDataFrame([("f", "T.q.z")], "file string, host string")
    failures = spark.createDataFrame([("f", "bad.w.x:1", "w.x", 0, False, "")], "file string, server string, domain string, position int, refused boolean, avoided string")
    got = origin.order_locations(listed, tried, failures, marks, 10000).orderBy("rank").collect()
    assert [r.host for r in got] == ["o.q.s", "p.q.r", "a"]


def test_tally(spark):
    rows = spark.createDataFrame([("u", f"s{i}", 10 - i, 1, 1) for i in range(10)], "k string, server string, opens int, bytes int, slowest int")
    assert origin.tally_text(origin.server_tally(rows, "k"), "opens", "k").first().text == "s0 10, s1 9, s2 8, s3 7, s4 6, s5 5, s6 4, s7 3, +2 3"


def test_column_groups_and_clusters(spark):
    units = spark.createDataFrame([("f", b, 1000 + 10000 * b + 1000 * i, n) for b, n in enumerate((25, 25, 50, 100, 300)) for i in range(4)], "file string, grp int, r_lo long, n long").selectExpr("file", "grp", "r_lo", "r_lo + n AS r_hi")
    reads = spark.createDataFrame([("f", 1000, 1025), ("f", 31000, 31080)], "file string, lo long, hi long")
    assert sorted(r.grp for r in columns.groups_of(reads, units, "file").collect()) == [0, 3]
    baskets = spark.createDataFrame([("f", 0, i, 1000 + i * 10, 10, i * 1000) for i in range(20)] + [("f", 0, 20, 0, 0, 20000)], "file string, branch int, basket int, seek long, bytes long, first_entry long")
    clusters = spark.createDataFrame([("f", 0), ("f", 10000), ("f", 20000)], "file string, start long")
    ask = lambda b: sorted(r.basket for r in columns.cluster_siblings(spark.createDataFrame([("f", 1000 + b * 10, 1001 + b * 10)], "file string, r_lo long, r_hi long"), baskets, clusters).collect())
    assert ask(3) == [0, 1, 2, 4, 5, 6, 7, 8, 9] and ask(19) == list(range(10, 19))
    assert spark.range(1).select(columns.codec_of_setting(F.lit(-1), F.lit(505)).alias("c")).first().c == "zstd"


def test_read_decisions(spark):
    sizes = spark.createDataFrame([(0, 100), (1, 100), (2, 200), (3, 400), (4, 1200)], "grp int, bytes long")
    steps = lambda xs: spark.createDataFrame([("r", i, g) for i, gs in enumerate(xs) for g in gs], "k string, step int, grp int")
    run = lambda xs: [r.decision for r in columns.read_decisions(steps(xs), sizes, 25, "k").orderBy("step").collect()]
    assert run([[0], [1], [2], [3]]) == [-1, -1, -1, 1] and run([[0], [1], [0, 1]]) == [-1, -1, 0]


def test_physics(spark):
    df = spark.createDataFrame([(2, [30.0, 30.0], [0.0, 0.0], [0.0, 3.14159265], [0.1, 0.1], [1, -1]), (2, [1.0, 1.0], [0.0, 0.0], [0.0, 0.0], [0.1, 0.1], [1, 1])], "n_muon int, muon_pt array<double>, muon_eta array<double>, muon_phi array<double>, muon_mass array<double>, muon_charge array<int>")
    pairs = physics.select_pairs(df)
    assert [r.pair_mass for r in pairs.collect()] == [pytest.approx(60.0, rel=1e-4)]
    h = physics.mass_histogram(pairs)
    assert physics.fingerprint(h).first().fingerprint == h.first().bin + 1


def test_text_records(spark, tmp_path):
    (tmp_path / "m").write_text("marks 1\na - x 1 1 5 9\na - x 2 1 7 9\nbad line\n")
    got = records.parse_source_marks(records.text_lines(spark, str(tmp_path)), "marks 1").collect()
    assert [(r["server"], r["count"], r["last_s"]) for r in got] == [("a", 2, 7)]
    layers = {"default": [("a", "1"), ("b", "2")], "env": [("b", "3")]}
    rows = records.settings({k: spark.createDataFrame(v, "key string, value string") for k, v in layers.items()}).collect()
    assert {(r.key, r.value, r.source) for r in rows} == {("a", "1", "default"), ("b", "3", "env")}


def test_holds(spark, tmp_path):
    (tmp_path / "h").write_text("hold 1\nsettings 2 300 -\nsettings 3 70000 zstd\nhigh 5\nhigh 3\nhigh x\nrange 0A 10 20 100 0 7\nrange zz 1 2 3 4 5\nrange b 9 8 1 1 1\nfault S%201 Srv:1 100 50 - 2\nfault - srv:2 100\nother\n")
    (tmp_path / "bad").write_text("hold 2\nhigh 9\n")
    settings, high, ranges, faults = records.parse_in_use(records.text_lines(spark, str(tmp_path)), "hold 1")
    assert [tuple(r) for r in settings.collect()] == [("h", 2, 300, "")] and [tuple(r) for r in high.collect()] == [("h", 5)]
    assert [tuple(r) for r in ranges.collect()] == [("h", "0a", 10, 20, 100, 0, 7)]
    assert [tuple(r) for r in faults.collect()] == [("h", "S 1", "srv:1", 100, 50, "-", 2)]
    at = lambda now: cache.live_faults(faults, now, 1000).count()
    assert [at(n) for n in (39, 40, 1099, 1100)] == [0, 1, 1, 0]


def test_names_of_an_entry(spark, tmp_path):
    urls = [f"url u{i}" for i in range(10)]
    (tmp_path / "e").write_text("\n".join(["lfn /a", *urls, "url u1", "lfn /b", "note", ""]) + "url torn")
    lfn, found = records.entry_names(records.text_lines(spark, str(tmp_path), complete=True))
    assert [tuple(r) for r in lfn.collect()] == [("e", "/b")]
    assert [r.url for r in found.orderBy("r").collect()] == ["u1", "u9", "u8", "u7", "u6", "u5", "u4", "u3"]
