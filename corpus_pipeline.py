"""The corpus pipeline: five stages over ``documents``, each an operator of ``chronocohort.llm``.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the columns of ``documents``; the last
returns the encoded corpus. Rows with a null doc_id pass the stages that decide by document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from chronocohort.llm import byte_bpe, decontaminate, jaccard, recompression, toxicity
from chronocohort.llm.components import stored
from chronocohort.llm.registry import table, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; labels of the fifth held out are not learned from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS).where("score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    joined = jaccard.join(docs)
    kept = joined.where("key = component").select(F.col("key").alias("doc_id")).distinct()
    return docs.join(kept, "doc_id", "left_semi").union(docs.where("doc_id is null")).select(COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that start in an earlier document go from the text; other texts stay as they are."""
    cut = recompression.dedup(docs, keep=["lang", "source", "n_chars"])
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("bigint")).otherwise(F.col("row.n_chars"))
    return cut.select(F.col("key").alias("doc_id"), F.col("kept").alias("text"), "row.lang", "row.source", n_chars.alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that aligns with a benchmark item go."""
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select(F.col("key").alias("doc_id")).distinct(), "doc_id", "left_anti").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed ids of what is left, and whether they decode to the text's own bytes."""
    ranks, pattern = vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
    encoded = byte_bpe.encode(rows, ranks, pattern, keep=["doc_id", "lang", "source", "text_sha256"])
    decoded = byte_bpe.decode(encoded, ranks, pattern)
    same = F.sha2("decoded", 256) == F.col("text_sha256")
    return decoded.select("doc_id", "lang", "source", byte_bpe.n_tokens().alias("n_tokens"), "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

# Scores learned from labels and alignment scores have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
