"""Embedder and generator hooks, store open/build-if-absent."""

import pytest
from pyspark.sql import functions as F

from tuneshelf.operators import embed as E
from tuneshelf.plans import pipeline as PL
from tuneshelf.plans import store as ST
from tuneshelf.plans.catalog_jobs import Catalog
from tuneshelf.session import scratch_path
from tuneshelf.sources import tables as S

from conftest import SF_SMALL


def test_python_embedder_hook_equals_expression_embedder(spark):
    docs = S.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    a = {r["doc_id"]: list(r["embedding"]) for r in E.hashed_embedding(docs, 64).collect()}
    b = {r["doc_id"]: list(r["embedding"]) for r in E.embed_with(docs, E.python_hashed_embedder(64)).collect()}
    assert a.keys() == b.keys() and len(a) > 0
    same = sum(1 for k in a if a[k] == b[k])
    assert same == len(a)


def test_generator_hook_bad_citations_are_annotated(spark):
    def make():
        def generate(pairs):
            assert all("RETRIEVED TRACK CATALOG" in prompt and system for system, prompt in pairs)
            if any("bad" in prompt.split("USER REQUEST: ")[1] for _, prompt in pairs):
                raise RuntimeError("refused")
            return ["Try [1] and [99]." for _ in pairs]
        return generate

    cat = Catalog(spark, SF_SMALL)
    qs = spark.createDataFrame([("q1", "top pop songs"), ("q2", "   "), ("q3", "top bad songs")], "question_id string, question string")
    out = sorted(PL.answer_with(cat.index, cat.embedded_docs, qs, generator=make).collect(), key=lambda r: r["question_id"])
    assert [r["question_id"] for r in out] == ["q1", "q3"]      # the empty question is rejected
    assert out[1]["answer"] is None and out[1]["error"] == "RuntimeError: refused" and out[0]["error"] is None
    assert len(out[0]["tracks"]) == out[0]["n_tracks"] == 12
    assert out[0]["tracks"][0]["similarity_score"] >= out[0]["tracks"][-1]["similarity_score"]
    assert out[0]["retrieval_mode"] == "tfidf"
    assert out[0]["answer"].startswith("Try [1] and [99].")
    assert "catalog entries [99]" in out[0]["answer"]


def test_open_before_ingest_raises(spark):
    root = scratch_path(spark, "missing-index")
    with pytest.raises(RuntimeError, match="ingest"):
        ST.open_index(spark, root)
    assert not ST.is_built(spark, root)


def test_build_if_absent(spark):
    root = scratch_path(spark, "index-test")
    assert ST.ensure_built(spark, SF_SMALL, root) is True
    assert ST.ensure_built(spark, SF_SMALL, root) is False
    docs = ST.open_docs(spark, root)
    # partitioned by doc_type: a track-only read prunes the artist partition
    plan = docs.filter(F.col("doc_type") == "track")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "doc_type" in plan
