import math

import numpy as np
from pyspark.sql import functions as F

from kelpie.llm import embeddings as E
from tests.llm.test_simhash import plain_components


def cosine(a, b):
    return float(np.dot(a, b) / math.sqrt(np.dot(a, a)) / math.sqrt(np.dot(b, b)))


def rows(seed=1, n=150, size=12):
    rng = np.random.default_rng(seed)
    out = [(i, rng.normal(size=size).tolist()) for i in range(n)]
    for k in range(40):
        base = np.array(out[k % 7][1])
        out.append((n + k, (base * rng.uniform(0.1, 9) + rng.normal(size=size) * 0.12 * np.linalg.norm(base)).tolist()))
    out += [(500 + k, out[3][1]) for k in range(5)]
    out += [(600, None), (601, [0.0] * size), (602, [float("nan")] * size), (603, [float("inf")] + [1.0] * (size - 1)), (604, []), (605, [None] * size), (606, [1e-200] * size), (607, [1e200] * size), (608, [1.0, 0.0]), (609, [2.0, 0.01]), (3, out[3][1]), (None, out[5][1]), (None, out[3][1]), (None, [0.0, 1.0]), (None, None)]
    return out


def test_links_equal_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    good = [(i, v) for i, v in data if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    scaled = [np.array(v) / max(map(abs, v)) for _, v in good]
    linked = lambda a, b: len(scaled[a]) == len(scaled[b]) and cosine(scaled[a], scaled[b]) >= E.THRESHOLD
    roots = plain_components(range(len(good)), linked)
    least = {}
    for k, (i, _) in enumerate(good):
        if i is not None:
            least[roots[k]] = min(least.get(roots[k], i), i)
    want = [(i, sum(linked(k, m) for m in range(len(good)) if m != k), least.get(roots[k])) for k, (i, _) in enumerate(good)]
    want += [(i, 0, i) for i, v in data if not any(i == g and v is w for g, w in good)]
    frame = df.withColumns({"v": F.lit(1), "node": F.lit("x"), "component": F.lit(2)})
    got = [tuple(r) for r in E.near_duplicates(frame).collect()]
    assert sorted(map(str, got)) == sorted(str((*w, w[0] is not None and w[0] == w[2])) for w in want)
    assert sorted(map(str, map(tuple, E.near_duplicates(frame, tile=9).collect()))) == sorted(map(str, got))


def test_close_pairs_prune_without_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 32)) * np.linspace(3, 0.1, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = E.close_pairs(x, x, 0.9)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(x @ x.T >= 0.9 - E.SLACK))))


def test_empty_and_unusable(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert E.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in E.near_duplicates(spark.createDataFrame([(1, None, 2)], schema)).collect()] == [(1, 0, 1, True)]


def test_sql_gives_the_same(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    data = [r for r in rows() if r[0] not in (606, 607)]  # their squares vanish or overflow in SQL
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", data)
    got = E.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(E.ORACLE).fetchall()))
