"""TF-IDF text index as three tables: per-document term counts, a capped
vocabulary with smoothed idf, and unit-norm postings.

Plan shape (checked with ``explain``): the corpus is hash-partitioned on its id
once (a shuffle of the raw text, which is smaller than the term rows); term
counting, the broadcast vocabulary join and the per-document norm window then
reuse that partitioning with no further exchange.  Corpus statistics are a
partial + final hash aggregate on ``term``; the vocabulary is capped, so it is
broadcast with a proven bound.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import bigrams, kept_tokens, with_terms
from ..options import DEFAULT, Settings
from ..session import cut_lineage, job_scratch, scratch_path
from .sizing import spread_by
from .termblocks import TermBlocks, build_blocks


@dataclass
class TextIndex:
    vocab: DataFrame      # term, df, cf, idf, term_rank
    postings: DataFrame   # doc_id, term, weight, popularity
    docs: DataFrame       # doc_id, popularity (every document, with or without terms)
    n_docs: Column        # scalar subquery: number of documents
    settings: Settings = DEFAULT
    stored: TermBlocks | None = None  # the block layout, if it was stored with the index

    @cached_property
    def blocks(self) -> TermBlocks:
        """Postings by term block; built at the first ranking, unless stored."""
        return self.stored or build_blocks(self.postings, self.settings)


def search_text(df: DataFrame, null_text: str = "nan") -> Column:
    """``name artist genre subgenre`` joined by spaces; missing cells print ``nan``."""
    parts = [R.cell_text(c, null_text) if c in df.columns else F.lit("")
             for c in ["track_name", "track_artist", "playlist_genre", "playlist_subgenre"]]
    return F.concat_ws(" ", *parts)


def term_counts(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: list[str] | None = None) -> DataFrame:
    """(id, term, tf [, keep...]) with the corpus hash-partitioned on ``id_col``."""
    keep = keep or []
    d = spread_by(corpus.select(id_col, text_col, *keep), id_col)
    return _counted(with_terms(d, text_col, "terms"), id_col, keep)


def _counted(d: DataFrame, id_col: str, keep: list[str]) -> DataFrame:
    """(id, term, tf [, keep...]) of the ``terms`` of rows that are partitioned by ``id_col``."""
    # explode_outer + null filter: an inner explode makes the optimizer infer
    # size(terms) > 0 and push that (the whole tokeniser) below the repartition
    # into the scan, running it twice
    return (d.select(id_col, *keep, F.explode_outer("terms").alias("term"))
            .filter(F.col("term").isNotNull())
            .groupBy(id_col, "term", *keep).agg(F.count(F.lit(1)).alias("tf")))


def frequent_term_counts(corpus: DataFrame, vocab_size: int, id_col: str = "doc_id", text_col: str = "text",
                         keep: list[str] | None = None) -> DataFrame:
    """``term_counts`` without terms that cannot be among the ``vocab_size`` most frequent ones.

    A pair of words is never more frequent than either word, and there are already ``vocab_size``
    terms as frequent as the last of so many words.  So only words that reach that count, and
    pairs of two such words, are counted by document; most pairs of long texts are met once or
    twice and would be most of the rows.  Texts are tokenised once."""
    keep = keep or []
    d = spread_by(corpus.select(id_col, text_col, *keep), id_col)
    kept = cut_lineage(d.select(id_col, *keep, kept_tokens(text_col).alias("kept")), "kept-tokens")
    words = kept.select(F.explode("kept").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cf"))
    words = cut_lineage(words, "word-counts")
    last = words.orderBy(F.col("cf").desc()).limit(vocab_size).agg(F.count(F.lit(1)), F.min("cf")).collect()[0]
    toks = F.col("kept")
    if last[0] == vocab_size and vocab_size:
        often = [r["word"] for r in words.where(F.col("cf") >= last[1]).limit(2 * vocab_size + 1).collect()]
        if len(often) <= 2 * vocab_size:  # else too many are as frequent as the last
            toks = F.transform("kept", lambda t: F.when(t.isin(*often), t).otherwise(F.lit("")))  # a gap joins nothing
    # as one text: an array takes four times the bytes in the shuffle
    d = spread_by(kept.select(id_col, *keep, F.array_join(toks, " ").alias("text")), id_col)
    d = d.select(id_col, *keep, F.split("text", " ").alias("kept"))
    d = d.select(id_col, *keep, F.concat(F.filter("kept", lambda t: t != ""), bigrams(F.col("kept"))).alias("terms"))
    return _counted(d, id_col, keep)


def capped_vocabulary(stats: DataFrame, n_docs: Column, vocab_size: int) -> DataFrame:
    """Top ``vocab_size`` terms of (term, df, cf) by corpus count (ties: term order), smoothed idf."""
    top = stats.orderBy(F.col("cf").desc(), F.col("term").asc()).limit(vocab_size)
    idf = F.log((n_docs + 1).cast("double") / (F.col("df") + 1).cast("double")) + F.lit(1.0)
    return top.select("term", "df", "cf", idf.alias("idf"))


def vocabulary(counts: DataFrame, n_docs: Column, vocab_size: int, id_col: str = "doc_id") -> DataFrame:
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return capped_vocabulary(stats, n_docs, vocab_size)


def unit_weights(counts: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """tf * idf over vocabulary terms (unknown terms vanish), L2-normalised per id."""
    w = (counts.join(F.broadcast(vocab.select("term", "idf")), "term")
         .withColumn("__w", F.col("tf").cast("double") * F.col("idf")))
    norm = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy(id_col)))
    return w.withColumn("weight", F.col("__w") / norm).drop("__w", "idf")


def build_text_index(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     pop_col: str | None = "popularity", settings: Settings = DEFAULT, long_texts: bool = False) -> TextIndex:
    """``long_texts``: terms that cannot be in the vocabulary are left out before the counts are written."""
    pop = (F.coalesce(R.nan_to_null(F.col(pop_col).cast("double")), F.lit(0.0))
           if pop_col else F.lit(0.0))
    docs = corpus.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                         pop.alias("popularity"))
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    if settings.checkpoint_counts:
        # both the vocabulary and the postings read the counts: write them once to
        # the shared checkpoint folder instead of tokenising the corpus twice
        path = scratch_path(docs.sparkSession, "term-counts")
        with job_scratch(docs.sparkSession):  # the tokens are read for the counts only
            count = frequent_term_counts if long_texts else term_counts
            more = {"vocab_size": settings.vocab_size} if long_texts else {}
            count(docs, id_col="doc_id", text_col="text", keep=["popularity"], **more).write.parquet(path)
        counts = docs.sparkSession.read.parquet(path)
    else:
        counts = term_counts(docs, "doc_id", "text", keep=["popularity"])
    vocab = vocabulary(counts, n_docs, settings.vocab_size)
    if settings.checkpoint_counts:
        # <= vocab_size rows, read by the postings and by every question batch:
        # write it once instead of re-aggregating all terms for each reader
        vocab = cut_lineage(vocab, "vocabulary")
    postings = unit_weights(counts, vocab, "doc_id").select("doc_id", "term", "weight", "popularity")
    return TextIndex(vocab=vocab, postings=postings, docs=docs.select("doc_id", "popularity"), n_docs=n_docs, settings=settings)


def catalogue_corpus(docs_or_catalog: DataFrame, null_text: str = "nan") -> DataFrame:
    """Track rows as a text corpus: search text + raw popularity (NaN/missing -> 0)."""
    df = docs_or_catalog
    pop = F.col("track_popularity") if "track_popularity" in df.columns else F.lit(0.0)
    from .documents import track_doc_id
    return df.select(track_doc_id(df, null_text).alias("doc_id"),
                     search_text(df, null_text).alias("text"),
                     pop.cast("double").alias("popularity"))


def question_vectors(questions: DataFrame, vocab: DataFrame,
                     id_col: str = "question_id", text_col: str = "question") -> DataFrame:
    """Questions through the same tokeniser, vocabulary, idf and norm."""
    counts = term_counts(questions, id_col, text_col)
    return unit_weights(counts, vocab, id_col).select(id_col, "term", F.col("weight").alias("qweight"))


def document_token_stats(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: kept tokens (after stop words), 1+2-gram terms and distinct terms."""
    d = with_terms(corpus.select(id_col, text_col), text_col, "terms")
    return d.select(
        id_col,
        F.size(F.filter("terms", lambda t: ~F.instr(t, " ").cast("boolean"))).cast("long").alias("n_tokens"),
        F.size("terms").cast("long").alias("n_terms"),
        F.size(F.array_distinct("terms")).cast("long").alias("n_distinct_terms"),
    )
