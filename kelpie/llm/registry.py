"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import chat, embeddings, fingerprints, packing, scoring, secrets, sentencepieces, simhash, substrings, toxicity
from .common import read


def _documents(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text")


def op1_chat(spark, sf_dir):
    return chat.format_conversations(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op2_sentencepieces(spark, sf_dir):
    return sentencepieces.round_trip(_documents(spark, sf_dir), sentencepieces.model_path())


def op3_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_documents(_documents(spark, sf_dir))


def op4_toxicity(spark, sf_dir):
    return toxicity.score_documents(_documents(spark, sf_dir), read(spark, sf_dir, "labels", "doc_id", "toxic"))


def op5_packing(spark, sf_dir):
    return packing.pack_documents(_documents(spark, sf_dir))


def op6_scoring(spark, sf_dir):
    return scoring.rounded(scoring.score_documents(_documents(spark, sf_dir)))


def op7_secrets(spark, sf_dir):
    return secrets.scan_documents(_documents(spark, sf_dir))


def op8_substrings(spark, sf_dir):
    return substrings.deduplicate(_documents(spark, sf_dir)).drop("kept", "source_sha256")


def op9_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(_documents(spark, sf_dir))


QUERIES = {
    "op1_chat": op1_chat,
    "op2_sentencepieces": op2_sentencepieces,
    "op3_fingerprints": op3_fingerprints,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_scoring": op6_scoring,
    "op7_secrets": op7_secrets,
    "op8_substrings": op8_substrings,
    "op9_embeddings": op9_embeddings,
    "op10_simhash": op10_simhash,
}

ORACLE = {"op1_chat": chat.ORACLE, "op6_scoring": scoring.ORACLE, "op7_secrets": secrets.ORACLE, "op8_substrings": substrings.ORACLE, "op9_embeddings": embeddings.ORACLE}
