"""From raw documents to a training mix: five stages, each a function of the documents that
the one before it kept.  Every stage is written as Parquet and read again by the next.

A row that cannot be judged (no text, no id) is no reason to lose it: each operator's
docstring says what becomes of such rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneshelf.llm import decontam, fast_minhash, kn_toxicity, line_chunks, mix_schedule
from tuneshelf.llm.common import fresh, load
from tuneshelf.session import cut_lineage, ship_package


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models reject go."""
    return kn_toxicity.drop_toxic(docs, load(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; a document that loses all goes."""
    removed = fresh(docs, "n_removed")
    out = line_chunks.dedup_lines(docs, report=removed, whole=True)
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, changed).otherwise(F.col("n_chars")))
    return out.drop(removed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return fast_minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.remove_documents(docs, load(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document: doc_id, size, source_size, target, taken."""
    return mix_schedule.mix(docs).taken


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Near-duplicate components and language-model scores are not SQL: tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
