"""Question routing, hybrid TF-IDF + popularity top-k, and hit lookup.

TF-IDF top-k never pairs every question with every document.  A document that
shares no term with a question scores only ``w_pop * pop / 100`` (weights are
non-negative), so if it reaches that question's top-k it is also in the global
popularity top-k under the same ranking key.  Candidates are therefore:

* matched documents: the term blocks whose score bound can reach the question's k-th score
  (``termblocks``); a block is scored inside a task, and no pair becomes a row,
* the global popularity top-k, attached to each question through an equi-join on
  a rank position (fan-out bounded by k).

Ranking key everywhere: ``round_half_up(score, 10)`` descending, then ``doc_id``
ascending, so float summation order cannot flip ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import rules as R
from ..options import DEFAULT, Settings
from .sizing import broadcast_if_bounded
from .termblocks import bounded_topk
from .textindex import TextIndex, question_vectors


def rank_key(score: str | Column) -> Column:
    return R.round_half_up(score, 10)


def top_n(df: DataFrame, group: str, n: int, score: str = "score", tie: str = "doc_id",
          rank_col: str = "rank") -> DataFrame:
    """Per-group top-n (planned as WindowGroupLimit: a partial limit runs before
    the shuffle, so a hot group sends at most n rows per map task)."""
    w = Window.partitionBy(group).orderBy(rank_key(score).desc(), F.col(tie).asc())
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def hybrid_score(cos: Column, pop: Column, s: Settings) -> Column:
    return F.lit(s.w_cosine) * cos + F.lit(s.w_popularity) * (pop / F.lit(100.0))


def validate_questions(questions: DataFrame, id_col: str = "question_id",
                       text_col: str = "question") -> DataFrame:
    """Strip all surrounding whitespace; empty questions are flagged, not dropped."""
    q = R.strip_ws(text_col)
    return questions.select(
        id_col, q.alias("question"),
        (F.coalesce(F.length(q), F.lit(0)) > 0).alias("is_valid"),
        F.when(F.coalesce(F.length(q), F.lit(0)) == 0, F.lit(fixed.EMPTY_QUESTION))
         .alias("reason"))


def route(questions: DataFrame, force_tfidf: Column | None = None, text_col: str = "question") -> DataFrame:
    """``retrieval_mode``: a caller override wins, else the substring router."""
    routed = R.routes_to_tfidf(text_col)
    use = F.coalesce(force_tfidf, routed) if force_tfidf is not None else routed
    return questions.withColumn("retrieval_mode", F.when(use, "tfidf").otherwise("semantic"))


def tfidf_topk(index: TextIndex, questions: DataFrame, k: int, settings: Settings = DEFAULT,
               id_col: str = "question_id", text_col: str = "question", stats: dict | None = None) -> DataFrame:
    """(question_id, rank, doc_id, cosine, popularity, score) for the top-k per question."""
    qvec = question_vectors(questions, index.vocab, id_col, text_col)
    # global popularity top-k: the key of a document with cosine 0
    pop_key = hybrid_score(F.lit(0.0), F.col("popularity"), settings)
    # k rows (TakeOrderedAndProject: per-partition top-k, then a k-way merge); the
    # window that numbers them runs over those k rows only
    pop_top = (index.docs.withColumn("score", pop_key)
               .orderBy(rank_key("score").desc(), F.col("doc_id").asc()).limit(k)
               .withColumn("pos", F.row_number().over(
                   Window.orderBy(rank_key("score").desc(), F.col("doc_id").asc())))
               .select("pos", "doc_id", "popularity"))
    slots = questions.select(id_col, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("pos"))
    popular = (slots.join(F.broadcast(pop_top), "pos")
               .select(F.col(id_col).alias("qid"), "doc_id", F.lit(0.0).alias("cosine"), "popularity"))
    popular = popular.withColumn("score", hybrid_score(F.col("cosine"), F.col("popularity"), settings))
    best = bounded_topk(index.blocks, qvec.withColumnRenamed(id_col, "qid"), popular, k, settings, stats)
    return best.select(F.col("qid").alias(id_col), "rank", "doc_id", "cosine", "popularity", "score")


def lookup_hits(hits: DataFrame, docs: DataFrame, settings: Settings = DEFAULT,
                n_questions: int | None = None, k: int | None = None) -> DataFrame:
    """Inner join ranked ids to documents after ranking (misses drop out, so fewer
    than k may return); only track documents are kept, numbered from 1 without gaps.  Hits
    are at most questions x k rows: broadcast when that bound is small, else a keyed join."""
    tracks = docs.filter(F.col("doc_type") == "track")
    bound = (n_questions * (k or settings.top_k)) if n_questions is not None else settings.broadcast_max_rows + 1
    found = broadcast_if_bounded(hits, bound, settings.broadcast_max_rows).join(tracks, "doc_id", "inner")
    # an answer cites 1..n: the numbers close up after a miss (at most k rows a question)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank")))


def retrieval_stats(questions: DataFrame, hits: DataFrame, id_col: str = "question_id") -> DataFrame:
    """Per question: hit count and score range (0 when there are no hits)."""
    agg = hits.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_hits"),
                                   F.min("score").alias("min_score"),
                                   F.max("score").alias("max_score"))
    return (questions.select(id_col).join(agg, id_col, "left")
            .select(id_col, F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"),
                    F.coalesce("min_score", F.lit(0.0)).alias("min_score"),
                    F.coalesce("max_score", F.lit(0.0)).alias("max_score")))
