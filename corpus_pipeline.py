"""A corpus pipeline: each stage works on the documents its predecessor kept.

All stages but the last return the columns of ``documents``. Between two stages
the documents are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import byte_bpe, decontaminate, line_dedup, near_copies, toxicity
from quadrille.llm.queries import RANKS
from quadrille.plans.registry import table
from quadrille.session import materialise


BLOCK_CHARS = 1 << 21


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("score") < 0.5).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of a line, within the edit threshold, go; the first stays. Every document stays, if only with an empty text."""
    return line_dedup.without_repeats(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word Jaccard similarity of 0.8 or more stays; fingerprints find the candidates."""
    return near_copies.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("spans") == 0).select("row.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    path = public_tokenizers.path(RANKS)
    kept = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "text")
    # Small blocks: workers and heaps of this stage have grown in the stages before.
    decoded = byte_bpe.decode(byte_bpe.encode(kept, path, block_chars=BLOCK_CHARS), path)
    return decoded.select("row.doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                          (F.sha2("decoded", 256) == F.col("row.text_sha256")).alias("round_trip"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("simhash", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", encoding_stage),
]

# Learned scores and fingerprints are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
