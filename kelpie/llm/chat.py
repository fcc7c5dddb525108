"""Chat formatting: maximal conversations, rendered.  DataFrame operations only.

Logging services write a conversation again after every turn, so many logged conversations are prefixes of longer
ones.  A turn's hash covers its place, role and text; the rolling hash of a prefix is the exclusive-or of its turns'
hashes, a running window over the conversation's turns.  The hash of a whole conversation that equals the hash of a
proper prefix of a longer one marks it as a snapshot, and an anti-join drops it.  Of conversations that are equal
turn by turn, the one with the smallest conv_id stays.

Two 64-bit hashes of differing seeds stand for a prefix, beside its length.  Turns are ordered by ``turn``, nulls
first, then by role and text; a null role or text counts as empty, which is told apart from nothing by its place.
Repeated rows are turns of their own.  A row whose conv_id is null belongs to no other: it is a conversation of one turn,
and of such that are equal one stays, unless it prefixes a longer conversation or equals a numbered one.  What a turn
holds cannot pass for a mark: ``<|`` becomes ``<||``, and a line end in a role ``<|br|>``.  An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle

#: What opens a turn, stands between its role and text, and closes it.
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)


def _hashes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("x", F.xxhash64("place", "role", "text")).withColumn("y", F.xxhash64("text", F.lit("y"), "role", "place"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Of every turn its place, the two rolling hashes of the prefix it ends, and whether it ends the conversation."""
    rows = _turns(turns)
    by_turn = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = _hashes(rows.where("conv_id IS NOT NULL").withColumn("place", F.row_number().over(by_turn)))
    so_far = W.partitionBy("conv_id").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    ended = F.lead("place").over(W.partitionBy("conv_id").orderBy("place")).isNull()
    rolled = placed.select("conv_id", "place", F.bit_xor("x").over(so_far).alias("h"), F.bit_xor("y").over(so_far).alias("g"), ended.alias("whole"))
    # Without an id: turns of their own, which no window has to gather.
    alone = _hashes(rows.where("conv_id IS NULL").withColumn("place", F.lit(1)))
    return rolled.unionByName(alone.select("conv_id", "place", F.col("x").alias("h"), F.col("y").alias("g"), F.lit(True).alias("whole")))


def maximal(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of conversations that prefix no longer one and repeat no earlier one: those with an id, and those without."""
    marks = settle(prefixes(turns))
    # A conversation's own last prefix is not a proper one.
    proper = marks.where("NOT whole").select("place", "h", "g").distinct()
    first = marks.where("whole").groupBy("place", "h", "g").agg(F.min("conv_id").alias("kept_id"))
    kept = first.join(proper, ["place", "h", "g"], "left_anti")
    rows = _turns(turns)
    numbered = rows.join(kept.where("kept_id IS NOT NULL").select(F.col("kept_id").alias("conv_id")), "conv_id", "left_semi")
    single = _hashes(rows.where("conv_id IS NULL").distinct().withColumn("place", F.lit(1)))
    nameless = kept.where("kept_id IS NULL").select(F.col("h").alias("x"), F.col("g").alias("y"))
    # Turn numbers of equal single turns may differ: one row of them stays.
    return numbered, single.join(nameless, ["x", "y"], "left_semi").select("conv_id", "role", "text").distinct()


def _line():
    role, text = (F.replace(F.col(c), F.lit("<|"), F.lit("<||")) for c in ("role", "text"))
    return F.concat(F.lit(OPEN), F.replace(role, F.lit("\n"), F.lit("<|br|>")), F.lit(BREAK), text, F.lit(CLOSE))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of each maximal conversation."""
    numbered, nameless = maximal(turns)
    rows = numbered.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "role", "text", _line().alias("line")))).alias("lines"))
    rendered = rows.select("conv_id", "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))
    return rendered.unionByName(nameless.select("conv_id", F.lit(1).cast("long").alias("n_turns"), _line().alias("rendered")))


ORACLE = f"""
    WITH t AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id, CASE WHEN conv_id IS NULL THEN r END ORDER BY turn NULLS FIRST, role, text) AS place,
            CASE WHEN conv_id IS NULL THEN r ELSE -1 END AS own, role, text
        FROM (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)),
    p AS (SELECT *, count(*) OVER c AS n,
            string_agg('{OPEN}' || replace(replace(role, '<|', '<||'), chr(10), '<|br|>') || chr(10) || replace(text, '<|', '<||') || '<|im_end|>' || chr(10), '') OVER o AS rendered,
            list(role || chr(1) || text) OVER o AS turns
        FROM t WINDOW c AS (PARTITION BY conv_id, own), o AS (PARTITION BY conv_id, own ORDER BY place)),
    w AS (SELECT min(conv_id) AS conv_id, n, turns, min(rendered) AS rendered FROM p WHERE place = n GROUP BY n, turns)
    SELECT conv_id, n AS n_turns, rendered FROM w WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.place < q.n AND q.turns = w.turns)"""
