import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kelpie.operators import intervals as I
from kelpie.operators import windows as Wn

RELAXED = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
spans = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.integers(0, 15)), min_size=1, max_size=40)


def cells(rows):
    out = {}
    for k, lo, n in rows:
        out.setdefault(k, set()).update(range(lo, lo + n))
    return out


@RELAXED
@given(spans)
def test_union_covers_the_same_cells_and_touches_nowhere(spark, rows):
    df = spark.createDataFrame([(k, lo, lo + n) for k, lo, n in rows], "k int, lo long, hi long")
    got = sorted((r.k, r.lo, r.hi) for r in I.union_ranges(df, "k").collect())
    assert cells([(k, lo, hi - lo) for k, lo, hi in got]) == {k: v for k, v in cells(rows).items() if v}
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(got, got[1:]))


@RELAXED
@given(spans, spans)
def test_overlap_join_equals_brute_force(spark, left, right):
    a = spark.createDataFrame([(k, lo, lo + n) for k, lo, n in left], "k int, lo long, hi long").distinct()
    b = spark.createDataFrame([(k, lo, lo + n) for k, lo, n in right], "k int, r_lo long, r_hi long").distinct()
    got = sorted(tuple(r) for r in I.overlap_join(a, b, "k", 7).collect())
    want = sorted((x.k, x.lo, x.hi, y.r_lo, y.r_hi) for x in a.collect() for y in b.collect() if x.k == y.k and x.lo < y.r_hi and y.r_lo < x.hi and x.hi > x.lo and y.r_hi > y.r_lo)
    assert got == want


def test_footprint_and_rounding(spark):
    reads = spark.createDataFrame([("f", o, o + n, 10_000) for o, n in ((100, 50), (150, 50), (120, 200), (400, 10))], "file string, lo long, hi long, size long")
    assert sorted((r.lo, r.hi) for r in I.union_ranges(reads, "file").collect()) == [(100, 320), (400, 410)]
    f = I.footprint(reads, "file").first()
    assert (f.buckets, f.unique_bytes, f.request_bytes) == (1, 230, 310)
    for size, off, n, lo, hi in ((1 << 20, 1000, 5000, 0, 8192), (100000, 500000, 10, 500000, 500010), (100000, 90000, 20000, 86016, 100000)):
        span = I.round_span(F.lit(4096), F.lit(size), F.lit(off), F.lit(n))
        assert tuple(spark.range(1).select(span["lo"], span["hi"]).first()) == (lo, hi)
    e = sorted((r.e_lo, r.e_hi) for r in I.readv_elements(spark.createDataFrame([(0, 15 << 20)], "lo long, hi long"), 4096).collect())
    assert len(e) >= 8 and e[0][0] == 0 and e[-1][1] == 15 << 20 and all(x[1] == y[0] and y[0] % 4096 == 0 for x, y in zip(e, e[1:]))


def test_runs_gaps_and_folds(spark):
    pages = spark.createDataFrame([("f", p) for p in (1, 2, 3, 7, 8, 10)], "k string, p long")
    assert sorted((r.first, r.last) for r in I.islands(pages, "p", "k").collect()) == [(1, 3), (7, 8), (10, 10)]
    assert sorted((r.first, r.last) for r in I.capped_runs(pages, "p", 2, "k").collect()) == [(1, 2), (3, 3), (7, 8), (10, 10)]
    bounds = spark.createDataFrame([("f", 0, 11), ("g", 0, 2)], "k string, lo long, hi long")
    assert sorted((r.k, r.first, r.last) for r in I.absent_runs(pages, bounds, "p", "k").collect())[:4] == [("f", 0, 0), ("f", 4, 6), ("f", 9, 9), ("f", 11, 11)]
    rec = spark.createDataFrame([("k", 0, 10), ("k", 12, 10), ("k", 21, 5), ("k", 40, 10), ("k", 50, 100)], "k string, off long, len long")
    assert sorted((r.lo, r.hi) for r in I.merge_records(rec, 30, 5, "k").collect()) == [(0, 22), (21, 26), (40, 50), (50, 150)]
    seq = spark.createDataFrame([("k", 1, 0, 5), ("k", 2, 5, 5), ("k", 3, 20, 5)], "k string, o int, off long, len long")
    assert [(r.off, r.len) for r in I.chunk_runs(seq, "o", "k").orderBy("off").collect()] == [(0, 10), (20, 5)]


def test_places_concurrency_wait(spark):
    live = spark.createDataFrame([("k", 100, 200), ("k", 232, 300)], "k string, lo long, hi long")
    ask = lambda front, n, limit: I.free_place(live, spark.createDataFrame([("k", front, n, limit)], "k string, front long, len long, limit long"), "k").first().place
    assert (ask(0, 96, 1000), ask(0, 150, 1000), ask(0, 150, 400), ask(50, 60, 320), ask(90, 32, 310)) == (0, 304, None, None, 200)
    jobs = spark.createDataFrame([("k", 0, 10), ("k", 5, 15), ("k", 10, 20)], "k string, lo long, hi long")
    assert I.max_concurrency(jobs, "k").first().peak == 2
    waits = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 5, 12), ("a", 1, 12, 15), ("b", 3, 0, 4)], "thread string, tier int, lo long, hi long")
    assert {r.tier: r.wait for r in I.reader_wait(waits).collect()} == {2: 12, 1: 3, 3: 4}


def test_running_sums_and_percentiles_without_one_task(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(50), rng.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(rows, "key long, atime long, n long")
    got = {r.key: r.before for r in Wn.running_before(df, ["atime", "key"], "n", "before", 7).collect()}
    total, want = 0, {}
    for k, _, n in sorted(rows, key=lambda r: (r[1], r[0])):
        want[k], total = total, total + n
    assert got == want
    p = Wn.exact_percentiles(df, "n", {"p50": 0.5, "p99": 0.99}).first()
    ordered = sorted(r[2] for r in rows)
    assert (p.p50, p.p99) == (ordered[250], ordered[min(499, int(500 * 0.99))])
