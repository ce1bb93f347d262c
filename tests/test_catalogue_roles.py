"""The role data can make the catalogue queries fail: terms meet, hits differ, rows miss."""

from conftest import SF_SMALL
from pyspark.sql import functions as F

from tuneshelf.operators import documents as D
from tuneshelf.operators import grounding as G
from tuneshelf.operators import retrieve as RT
from tuneshelf.operators.textindex import question_vectors
from tuneshelf.plans import catalog_jobs as J
from tuneshelf.plans.queries import QUERIES
from tuneshelf.sources import tables as S


def test_questions_meet_the_catalogue(spark):
    cat = J.Catalog(spark, SF_SMALL)
    questions = S.catalogue_questions(spark, SF_SMALL)
    joined = cat.index.postings.join(question_vectors(questions, cat.index.vocab), "term")
    assert joined.count() > 100
    hits = RT.tfidf_topk(cat.index, questions, 12)
    sets = hits.groupBy("question_id").agg(F.sort_array(F.collect_set("doc_id")).alias("s")).select("s").distinct()
    assert sets.count() > 20
    modes = {r.retrieval_mode for r in QUERIES["route_questions"](spark, SF_SMALL).collect()}
    assert modes == {"tfidf", "semantic"}


def test_planted_rows_take_effect(spark):
    assert QUERIES["grounding_check"](spark, SF_SMALL).first()["n_missing"] > 0
    stats = QUERIES["ingest_stats"](spark, SF_SMALL).first()
    assert stats["n_catalog_rows"] > stats["n_unique_tracks"] and stats["n_dropped_ids"] == 0
    assert QUERIES["validate_questions"](spark, SF_SMALL).where("not is_valid").count() > 0
    blurbs = QUERIES["track_blurb"](spark, SF_SMALL)
    assert blurbs.count() > blurbs.where(F.col("blurb").contains("N/A")).count() > 0


def test_numbers_close_up_after_a_miss(spark):
    hits = spark.createDataFrame([("q", i, f"d{i}", 0.5) for i in (1, 2, 3)], "question_id string, rank int, doc_id string, score double")
    docs = spark.createDataFrame([("d1", "track"), ("d3", "track")], "doc_id string, doc_type string")
    found = RT.lookup_hits(hits, docs, n_questions=1, k=3).orderBy("rank").collect()
    assert [(r["rank"], r.doc_id) for r in found] == [(1, "d1"), (2, "d3")]
    answer = spark.createDataFrame([("[2] [3]", 2)], "a string, n int").select(G.refs_text(G.bad_citations("a", "n")).alias("b")).first()
    assert answer.b == "3"


def test_ids_that_share_a_long_prefix_stay_apart(spark):
    rows = [(i, "x" * 100 + str(i), "n", "a" * 80 + str(i), "g", "s") for i in range(2)]
    cat = spark.createDataFrame(rows, "ordinal long, track_id string, track_name string, track_artist string, playlist_genre string, playlist_subgenre string")
    cat = S.ensure_columns(cat, {**{c: "double" for c in S.FEATURES}, "track_album_name": "string", "track_album_release_date": "string"})
    assert D.build_documents(cat).count() == 4


def test_hits_are_broadcast_within_a_bound_of_bytes(spark):
    """The driver holds a broadcast table several times over: two million rows are too many for it
    when they are wide, however few rows the limit allows."""
    from tuneshelf.operators.sizing import broadcast_if_bounded, broadcast_if_small

    hits = spark.createDataFrame([("1:0", 1, "p1", 0.5, 3.0, 0.4)], "question_id string, rank int, doc_id string, cosine double, popularity double, score double")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_bounded(hits, 12_000, 2_000_000))
    assert not hinted(broadcast_if_bounded(hits, 1_660_824, 2_000_000))
    long = spark.range(40).selectExpr("id", "repeat('x', 1 << 20) as text")
    assert not hinted(broadcast_if_small(long, 2_000_000)) and hinted(broadcast_if_small(long.limit(20), 2_000_000))
    assert hinted(broadcast_if_small(hits.limit(0), 2_000_000))


def test_hits_and_documents_meet_without_a_broadcast_too(spark):
    docs = spark.createDataFrame([("p1", "track", "a"), ("p2", "track", "b"), ("x", "artist", "c")], "doc_id string, doc_type string, track_name string")
    hits = spark.createDataFrame([("1:0", r, d, 0.5) for r, d in enumerate(["p2", "x", "gone", "p1"], 1)], "question_id string, rank int, doc_id string, score double")
    few, many = (sorted(map(tuple, RT.lookup_hits(hits, docs, n_questions=n, k=12).select("rank", "doc_id").collect())) for n in (1, 138_402))
    assert few == many == [(1, "p2"), (2, "p1")]
