import collections
import math
import re
import time
import zlib

import pytest

from kelpie.llm import scoring


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [x for x in re.split("[\x20\x09-\x0d]+", low) if x] + [None]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_plain_counts(docs, rows, order):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    grams = [collections.Counter() for _ in range(order + 1)]
    contexts = collections.Counter()
    total = 0
    for d, t in rows:
        if held(d):
            continue
        w = [0, *tokens(t)]  # one mark stands before a text
        total += len(w) - 1
        for i in range(1, len(w)):
            for k in range(1, min(order, i + 1) + 1):
                grams[k][tuple(w[i - k + 1 : i + 1])] += 1
                contexts[tuple(w[i - k + 1 : i])] += 1
    types = len(grams[1])
    want = []
    for d, t in rows:
        w = [0, *tokens(t)]
        base = score = known = 0
        for i in range(1, len(w)):
            p = (grams[1][(w[i],)] + 1) / (total + types + 1)
            base += math.log10(p)
            known += grams[1][(w[i],)] > 0
            for k in range(2, min(order, i + 1) + 1):
                context = tuple(w[i - k + 1 : i])
                p = (grams[k][(*context, w[i])] + scoring.MASS * p) / (contexts[context] + scoring.MASS)
            score += math.log10(p)
        want.append((str(d), held(d), len(w) - 1, known, total, base, score))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scoring.score_documents(docs, order).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_empty_and_better_than_base(spark, empty):
    assert scoring.score_documents(empty).collect() == []
    df = spark.createDataFrame([(i, f"the cat sat on the mat and the dog ran after the cat {i % 5}") for i in range(200)], "doc_id long, text string")
    out = scoring.score_documents(df).where("held_out").agg({"base_score": "sum", "score": "sum"}).first()
    assert out["sum(score)"] > out["sum(base_score)"]


def test_blocks_share_what_they_know(docs):
    """Tiny blocks and parts give the very scores that one block gives."""
    want = sorted(map(str, scoring.rounded(scoring.score_documents(docs.coalesce(1))).collect()))
    assert sorted(map(str, scoring.rounded(scoring.score_documents(docs.repartition(5), block_bytes=500, part_tokens=40)).collect())) == want


def test_sql_gives_the_same(spark, docs):
    import duckdb

    frame = docs.select("doc_id", "text").toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", frame)
    found = con.execute(scoring.ORACLE).fetchall()
    got = scoring.rounded(scoring.score_documents(docs)).collect()
    key = lambda r: (str(r[0]), tuple(r[1:]))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(found, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-6)


def shuffled(spark):
    """Numbers of the shuffles whose files are there."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name.split("_")[1] for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_what_was_asked_is_not_kept(spark, docs):
    """Of all orders' questions and answers no shuffle is left: only those of the blocks and of three sums may be."""
    before = shuffled(spark)
    out = scoring.score_documents(docs)
    until = time.monotonic() + 20
    while len(shuffled(spark) - before) > 4 and time.monotonic() < until:
        time.sleep(0.5)
    assert len(shuffled(spark) - before) <= 4
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert out.count() == docs.count()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_texts_side_by_side_equal_texts_one_by_one(rows, monkeypatch, order):
    """Each text carries its own state, so others beside it change no bit of its score; few steps are taken text by text."""
    texts = [(t or "").encode() for _, t in rows]
    g = scoring.Grams(scoring.X.pack_rows([d for d, _ in rows], texts), order, 6)
    while len(g.total) < order:
        asked = g.asked()
        g.take([scoring.X.planes(g.own[len(g.total)][asked].astype("u8") << 1 | 1)])
    read, alone = {}, []
    whole = scoring.Automaton._go_on
    monkeypatch.setattr(scoring.Automaton, "_go_on", lambda self, grams, *rest: (alone.append(len(grams[0])), whole(self, grams, *rest))[1])
    for abreast in (1, 5, 10**9):
        monkeypatch.setattr(scoring, "ABREAST", abreast)
        alone.clear()
        read[abreast] = scoring.scores(g, int(g.own[0].sum()), len(g.own[0]), len(rows), 8.0), sum(alone)
    assert read[1][0] == read[5][0] == read[10**9][0]
    assert (read[1][1], read[10**9][1]) == (0, int(g.sizes.sum())) and 0 < read[5][1] < g.sizes.sum()
