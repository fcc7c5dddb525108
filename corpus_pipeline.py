"""A cleaning pipeline over ``documents``: toxicity, near-duplicates, repeated passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of ``documents``, with further columns as they were.  Null texts count as empty and stay null, empty tables give
no rows, and rows that repeat are rows of their own until the stage of near-duplicates keeps one of them.  SQL cannot express the stages (a fitted grammar, SimHash components), so there is no oracle;
the tests hold each stage and the whole against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm import packing, secrets, simhash, substrings, toxicity
from kelpie.llm.common import drop_table, read, renamed, table, text_or_empty

#: A document is rejected as toxic from this score on.
REJECT_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the limit; a null text scores as an empty one."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.keep_below(docs, model, REJECT_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one document; see ``simhash.keep_one`` for which, and for repeated or null ids."""
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that an earlier document's windows hold; a text that loses nothing stays as it is.

    Rows are met by doc_id and the digest of their text, so rows of one id with different texts keep their own.  A null
    id comes after all others.  ``n_chars``, where there is one, follows the text.
    """
    found = substrings.deduplicate(docs.select("doc_id", "text"), keep_text=True).where("n_removed > 0")
    changed = found.select(F.col("doc_id").alias("__id"), F.col("source_sha256").alias("__sha"), F.col("kept").alias("__kept")).dropDuplicates(["__id", "__sha"])
    rows, name = renamed(docs)
    joined = rows.withColumn("own", F.sha2(text_or_empty(name["text"]).cast("string"), 256))
    joined = joined.join(changed, F.col(name["doc_id"]).eqNullSafe(F.col("__id")) & (F.col("own") == F.col("__sha")), "left")
    put = {name["text"]: F.coalesce("__kept", name["text"])}
    if "n_chars" in name:
        put[name["n_chars"]] = F.when(F.col("__kept").isNull(), F.col(name["n_chars"])).otherwise(F.length("__kept").cast("long"))
    return joined.withColumns(put).select(*(F.col(c).alias(own) for own, c in name.items()))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every found secret replaced by a mark; ``n_chars``, where there is one, follows the text."""
    return secrets.redact(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence; only doc_id and text are read."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again.

    A stage's table goes once the next one's is written; the last one's stays for the result to be read from.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs, path = table(stage(spark, docs, sf_dir))
        if before:
            drop_table(spark, before)
        before = path
    return docs
