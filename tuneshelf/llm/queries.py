"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontam, fast_minhash, hard_negatives, kn_toxicity, line_chunks, mix_schedule, pii_cooccur, poly_dedup, posting_ann,
               prefix_trie, style_tree, url_redirects, warc_zstd)
from .common import load


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_cooccur.sanitise(load(spark, sf_dir, "documents")).drop("row", "terms")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_ann.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(load(spark, sf_dir, "pages"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("spans", "text_key")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return line_chunks.dedup_lines(docs, drop_empty=False, report="n_removed")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc_zstd.write_archives(load(spark, sf_dir, "pages"))
    return warc_zstd.read_archives(manifest).drop("url")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fast_minhash.near_duplicates(load(spark, sf_dir, "documents"), k=4)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_toxicity.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).drop("text_key")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_schedule.mix(load(spark, sf_dir, "documents")).taken


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_redirects.judge(load(spark, sf_dir, "pages"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered(prefix_trie.turn_keys(load(spark, sf_dir, "conversations")))
    return prefix_trie.trie(prefix_trie.with_shared_heads(turns))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poly_dedup.exact_duplicates(load(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").where(hard_negatives.finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), hard_negatives.quantise(F.col("embedding")).alias("vec"))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


LLM_QUERIES = {
    "op1_pii": op1_pii,
    "op2_ann": op2_ann,
    "op3_html": op3_html,
    "op4_decontam": op4_decontam,
    "op5_lines": op5_lines,
    "op6_warc": op6_warc,
    "op7_minhash": op7_minhash,
    "op8_toxicity": op8_toxicity,
    "op9_mix": op9_mix,
    "op10_urls": op10_urls,
    "op11_trie": op11_trie,
    "op12_exact": op12_exact,
    "op13_negatives": op13_negatives,
    "pipeline": corpus_pipeline.run,
}
LLM_ORACLES = {
    "op4_decontam": decontam.ORACLE,
    "op5_lines": line_chunks.ORACLE,
    "op6_warc": warc_zstd.ORACLE,
    "op9_mix": mix_schedule.ORACLE,
    "op10_urls": url_redirects.ORACLE,
    "op11_trie": prefix_trie.ORACLE,
    "op12_exact": poly_dedup.ORACLE,
    "op13_negatives": hard_negatives.ORACLE,
}
