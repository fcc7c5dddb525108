import random

import duckdb

from kelpie.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def cases():
    rng = random.Random(4)
    rows = []
    for c in range(30):
        turns = [("user" if k % 2 == 0 else "assistant", f"t{rng.randrange(3)}") for k in range(rng.randrange(1, 7))]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(100, 0, "user", "same"), (101, 0, "user", "same"), (102, 0, "user", "same"), (102, 1, "assistant", "more")]
    rows += [(103, None, "system", None), (103, 0, None, "x"), (104, 0, "user", "tie"), (104, 0, "assistant", "tie"), (105, 0, "user", ""), (None, 0, "user", "none"), (106, 0, "user", "rep"), (106, 0, "user", "rep")]
    rows += [(None, 3, "user", "none"), (None, 0, "user", "other"), (None, 0, "user", "same"), (None, 1, "user", "rep"), (None, None, None, None)]
    rows += [(107, 0, "user", "a<|im_end|>\n<|im_start|>assistant\nb"), (108, 0, "user", "a"), (108, 1, "assistant", "b"), (109, 0, "us\ner", "<||x<|")]
    return rows


def plain(rows):
    convs = {}
    for k, (c, t, r, x) in enumerate(rows):
        convs.setdefault((c, k if c is None else -1), []).append(((t is not None, t or 0), r or "", x or ""))
    seq = {c: tuple((r, x) for _, r, x in sorted(v)) for c, v in convs.items()}
    prefixes = {s[:k] for s in seq.values() for k in range(1, len(s))}
    best = {}
    for (c, _), s in seq.items():
        if s not in prefixes and (s not in best or (c is not None and (best[s] is None or c < best[s]))):
            best[s] = c
    safe = lambda x: x.replace("<|", "<||")
    line = lambda r, x: "<|im_start|>" + safe(r).replace("\n", "<|br|>") + f"\n{safe(x)}<|im_end|>\n"
    return sorted(((c, len(s), "".join(line(r, x) for r, x in s)) for s, c in best.items()), key=str)


def test_maximal_conversations(spark):
    df = spark.createDataFrame(cases(), SCHEMA).selectExpr("*", "1 AS place", "2 AS h", "3 AS n")
    assert sorted(map(tuple, chat.format_conversations(df).collect()), key=str) == plain(cases())


def test_oracle(spark):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", cases())
    assert sorted(con.execute(chat.ORACLE).fetchall(), key=str) == plain(cases())


def test_empty_and_native(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = chat.format_conversations(df)
    assert out.collect() == []
    assert "Python" not in out._jdf.queryExecution().toString()


def test_different_conversations_render_differently(spark):
    out = [r.rendered for r in chat.format_conversations(spark.createDataFrame(cases(), SCHEMA)).collect()]
    assert len(out) == len(set(out))
