"""Every registered query against its DuckDB SQL on sf0.001 (row count + values)."""

import math

import pytest

from tuneshelf.plans.oracle import ORACLES
from tuneshelf.plans.queries import QUERIES

from conftest import SF_SMALL

FAST = ["safe_numeric", "threshold_buckets", "track_blurb", "track_metadata", "dedup_keep_first",
        "artist_rollup", "artist_blurb", "all_documents", "tokenize", "tfidf_vocab", "tfidf_postings",
        "tfidf_topk", "tfidf_topk_documents", "semantic_topk", "semantic_topk_prefilter", "cosine_pairs",
        "embed_documents", "profile_score", "profile_topk", "profile_topk_reasons", "profile_explain",
        "profile_questions", "batch_profiles", "route_questions", "validate_questions", "lookup_hits",
        "build_catalog", "build_prompt", "verify_citations", "grounding_check", "retrieval_stats",
        "hit_listing", "display_features", "answer_questions", "scan_catalog", "scan_songs_strict",
        "ingest_stats", "index_roundtrip", "route_override", "result_records", "generated_answers",
        "names_said", "semantic_topk_codes", "index_snapshots", "incremental_vocab", "incremental_rollup", "stream_retries"]


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8) + 0.0)
    return "∅" if v is None else str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in data)


def test_every_query_has_an_oracle_or_is_rows_only():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"semantic_topk_learned"}


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLES[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert rows(df.columns, got) == rows(ocols, res.fetchall())
