"""Shared plan fragments over the driver tables.

``Catalog`` is the per-job view of the catalogue: the deduplicated catalogue is
written once (one row per item) under the shared checkpoint folder, and the
documents, the text index and the embedded documents all derive from that table.
Without it every branch of a plan re-scans and re-aggregates ``lineitem`` (the
branches prune different columns, so the optimizer cannot reuse the exchange).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import embed as E
from ..operators import textindex as T
from ..options import DEFAULT, Settings
from ..session import cut_lineage
from ..sources import tables as S


class Catalog:
    """Catalogue-derived tables of one job; each is built at most once."""

    def __init__(self, spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT):
        self.spark, self.sf_dir, self.settings = spark, sf_dir, settings

    @cached_property
    def unique(self) -> DataFrame:
        return cut_lineage(D.dedup_tracks(S.catalogue(self.spark, self.sf_dir)), "catalogue")

    @cached_property
    def tracks(self) -> DataFrame:
        return D.track_documents(self.unique, self.settings)

    @cached_property
    def rollup(self) -> DataFrame:
        return D.artist_rollup(self.unique)

    @cached_property
    def docs(self) -> DataFrame:
        # written once: lookups, catalogues and the embedder all read the documents
        return cut_lineage(D.all_documents(self.tracks, D.artist_documents(self.rollup)), "documents")

    def hit_docs(self, hits: DataFrame) -> DataFrame:
        """``docs`` of the hit ids only.  A track's id and an artist's are known before their texts
        are written, so the other documents need no text, no shuffle and no table."""
        if "docs" in self.__dict__:  # they are written already
            return self.docs
        ids = hits.select(F.col("doc_id").alias("hit_id")).distinct()
        own = lambda df: df.join(ids, F.col("doc_id") == F.col("hit_id"), "left_semi")
        return D.all_documents(own(self.tracks), own(D.artist_documents(self.rollup)))

    @cached_property
    def index(self) -> T.TextIndex:
        corpus = T.catalogue_corpus(self.unique, self.settings.null_text)
        return T.build_text_index(corpus, "doc_id", "text", "popularity", self.settings)

    @cached_property
    def embedded_docs(self) -> DataFrame:
        # written once: a reader of the documents without their vectors would still compute them
        vecs = cut_lineage(E.hashed_embedding(self.docs, self.settings.embed_dim, "doc_id", "blurb"), "document-vectors")
        return self.docs.join(vecs, "doc_id")


def unique_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedup_tracks(S.catalogue(spark, sf_dir))


def track_docs(spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT) -> DataFrame:
    return D.track_documents(unique_catalog(spark, sf_dir), settings)


def all_docs(spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT) -> DataFrame:
    cat = unique_catalog(spark, sf_dir)
    return D.all_documents(D.track_documents(cat, settings), D.artist_documents(D.artist_rollup(cat)))


def catalogue_index(spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT) -> T.TextIndex:
    corpus = T.catalogue_corpus(unique_catalog(spark, sf_dir), settings.null_text)
    return T.build_text_index(corpus, "doc_id", "text", "popularity", settings)


def document_index(spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT) -> T.TextIndex:
    return T.build_text_index(S.text_corpus(spark, sf_dir), "doc_id", "text", "popularity", settings, long_texts=True)


def embedded_docs(spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT) -> DataFrame:
    """All catalogue documents with the hashed embedding of their blurb."""
    docs = all_docs(spark, sf_dir, settings)
    vecs = E.hashed_embedding(docs, settings.embed_dim, "doc_id", "blurb")
    return docs.join(vecs, "doc_id")


def embedding_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as documents: labels 0-7 are tracks, 8-9 artists."""
    e = S.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), "embedding",
                    F.when(F.col("label") < 8, "track").otherwise("artist").alias("doc_type"))
