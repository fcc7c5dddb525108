"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of every text is addressed by its content (SHA-256).  A ledger holds, per blob, which rules at which
version have read it and what they found; a scan reads a blob only with the rules that the ledger lacks for it, and
findings are joined back to every path that holds the blob.

A match's place comes from the pieces between matches: the text is split and extracted by one pattern, and a running
sum over piece lengths gives code-point offsets, so nothing leaves the JVM.  Matches are leftmost and do not overlap
within a rule; those that fail a rule's length are dropped after matching, as the rule says.

Nulls count as empty texts and have no findings; repeated paths give a row each; an empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import renamed, settle, text_or_empty


class Rule(NamedTuple):
    """One kind of secret; ``group`` must have ``least`` code points, and base rules come first in order."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    base: bool = True


# The rules, in the order that breaks ties.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
    Rule("webtoken", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, False),
)
#: A cheap test that a text can have a match that counts, where the plain pattern matches almost any text.
HINTS = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "hex": r"[0-9a-f]{16}"}
SPANS = "array<struct<start:long,ord:int,kind:string,end:long>>"


def name(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def _pieces(rule: Rule, order: int) -> Column:
    """Per match: the code points before it since the last one, its own, and whether it counts."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all("text", pattern, F.lit(0))
    measured = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else matches
    zipped = F.arrays_zip(F.split("text", rule.pattern, -1).alias("gap"), matches.alias("hit"), measured.alias("part"))
    found = F.transform(
        F.filter(zipped, lambda x: x["hit"].isNotNull()),
        lambda x, i: F.struct(F.lit(order).alias("ord"), i.alias("i"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("len"), (F.length(x["part"]) >= rule.least).alias("ok")),
    )
    none = F.expr("cast(array() as array<struct<ord:int,i:int,gap:long,len:long,ok:boolean>>)")
    return F.when(F.array_contains("todo", name(rule)) & F.col("text").rlike(HINTS.get(rule.kind, rule.pattern)), found).otherwise(none)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rules, spans) of each row (blob, text, todo): what the rules named in ``todo`` find."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    rows = blobs.select("blob", "todo", F.explode_outer(F.concat(*(_pieces(r, i) for i, r in enumerate(rules)))).alias("m")).select("blob", "todo", "m.*")
    until = W.partitionBy("blob", "ord").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(until))
    span = F.struct((F.col("end") - F.col("len")).alias("start"), "ord", F.element_at(kinds, F.col("ord") + 1).alias("kind"), "end")
    return placed.groupBy("blob").agg(F.first("todo").alias("rules"), F.sort_array(F.collect_list(F.when(F.col("ok"), span))).cast(SPANS).alias("spans"))


def versions(docs: DataFrame, path: str = "doc_id") -> DataFrame:
    """(path, blob, text) of every version."""
    text = text_or_empty().cast("string")
    return docs.select(F.col(path).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def update(history: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger (blob, rules, spans) after a scan of the unseen pairs of blob and rule version in ``history``.

    A hot blob is reduced to one row before the shuffle.  Rows that the history no longer holds stay.
    """
    names = F.array(*(F.lit(name(r)) for r in rules))
    unseen = history.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", names)
    if ledger is None:
        return scan(unseen, rules)
    # Blobs are met with the ledger before their texts are read by any rule.
    unseen = unseen.join(ledger.select("blob", F.col("rules").alias("done")), "blob", "left").withColumn("todo", F.array_except("todo", F.coalesce("done", F.expr("cast(array() as array<string>)"))))
    fresh = scan(unseen.where(F.size("todo") > 0), rules).select("blob", F.col("rules").alias("more"), F.col("spans").alias("found"))
    empty = F.expr(f"cast(array() as {SPANS})")
    nothing = F.expr("cast(array() as array<string>)")
    return ledger.join(fresh, "blob", "full").select(
        "blob",
        F.concat(F.coalesce("rules", nothing), F.coalesce("more", nothing)).alias("rules"),
        F.sort_array(F.concat(F.coalesce("spans", empty), F.coalesce("found", empty))).alias("spans"),
    )


def findings(history: DataFrame, ledger: DataFrame) -> DataFrame:
    """(path, blob, spans) of every version; spans are empty where nothing was found."""
    found = ledger.where(F.size("spans") > 0).select("blob", "spans")
    return history.select("path", "blob").join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row of ``findings``."""
    base = [i for i, r in enumerate(rules) if r.base]
    spans = F.col("spans")
    of_rule = lambda i: F.filter(spans, lambda s: s["ord"] == i)
    counts = [F.size(of_rule(i)).cast("long").alias(f"n_{rules[i].kind}") for i in base]
    own = F.filter(spans, lambda s: s["ord"].isin(base))
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(_listed(own), 256).alias("base_sha256"), _listed(spans).alias("spans"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """The findings of every document, from an empty ledger.

    The ledger is a table: once it is settled, a blob that a third of all paths hold is split where findings are joined
    back, since neither side of that join is dealt out by an aggregation.
    """
    history = versions(docs)
    return digest(findings(history, settle(update(history))))


def redact(docs: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every found span replaced by ``mark``; all other columns stay, n_chars follows the text.

    Findings are joined by content, so no column is taken for a key.  Overlapping spans of several rules are merged.
    Null texts stay null, repeated rows are redacted one by one, and columns of any other name stay as they are.
    """
    rows, name = renamed(docs)
    text = name["text"]
    found = settle(update(versions(rows.select(F.col(text).alias("text"), F.lit(0).alias("doc_id"))), None, rules)).where(F.size("spans") > 0)
    joined = rows.withColumn("own", F.sha2(text_or_empty(text).cast("string"), 256))
    joined = joined.join(found.select(F.col("blob").alias("own"), "spans"), "own", "left")
    # Walks the spans from left to right, keeping the gaps before marks and where the walk stands; texts are put together once.
    start = F.struct(F.expr("cast(array() as array<struct<at:bigint,len:bigint>>)").alias("gaps"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, span: Column) -> Column:
        gap = F.array(F.struct(state["at"].alias("at"), (span["start"] - state["at"]).alias("len")))
        return F.struct(F.when(span["start"] >= state["at"], F.concat(state["gaps"], gap)).otherwise(state["gaps"]).alias("gaps"), F.greatest(state["at"], span["end"]).alias("at"))

    part = lambda g: F.substring(F.col(text), (g["at"] + 1).cast("int"), g["len"].cast("int"))
    last = lambda s: F.array(F.struct(s["at"].alias("at"), F.lit(2147483647).cast("long").alias("len")))
    walked = F.aggregate("spans", start, step, lambda s: F.array_join(F.transform(F.concat(s["gaps"], last(s)), part), mark))
    clean = joined.withColumn(text, F.when(F.col("spans").isNull(), F.col(text)).otherwise(walked))
    if "n_chars" in name:
        clean = clean.withColumn(name["n_chars"], F.length(text).cast("long"))
    return clean.select(*(F.col(c).alias(n) for n, c in name.items()))


def _oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same findings in SQL that has lists, split and extract, written from the same rules."""
    # Case-blind groups are spelt out: some engines fold further letters into A to Z.
    spelt = lambda m: "(?:" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in m[1]) + ")"
    q = lambda r: "'" + re.sub(r"\(\?i:([^)]*)\)", spelt, r.pattern).replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT r, {i} AS ord, '{x.kind}' AS kind, {x.least} AS least, regexp_extract_all(text, {q(x)}, 0) AS hits, "
        f"regexp_extract_all(text, {q(x)}, {x.group}) AS parts, regexp_split_to_array(text, {q(x)}) AS gaps FROM d"
        for i, x in enumerate(rules)
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    s AS (SELECT r, ord, kind, least, generate_subscripts(hits, 1) AS i, unnest(hits) AS hit, unnest(parts) AS part, gaps FROM ({found})),
    p AS (SELECT *, sum(length(gaps[i]) + length(hit)) OVER (PARTITION BY r, ord ORDER BY i) AS stop FROM s),
    f AS (SELECT r, ord, kind, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM p WHERE length(part) >= least),
    a AS (
        SELECT r, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex,
            string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (WHERE ord < 3) AS base,
            string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM f GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a USING (r)"""


ORACLE = _oracle()
