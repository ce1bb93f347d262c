"""Plan shape: no cross products in retrieval; per-group limits are planned."""

from tuneshelf.plans.queries import QUERIES

from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_tfidf_topk_has_no_cross_product(spark):
    p = plan(QUERIES["tfidf_topk_documents"](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "WindowGroupLimit" in p and "FlatMapCoGroupsInArrow" in p


def test_catalogue_scans_lines_once(spark):
    from tuneshelf.sources import tables as S
    p = S.catalogue(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in ln and "lineitem" in ln for ln in p.splitlines()) == 1


def test_profile_topk_has_no_cross_product(spark):
    p = plan(QUERIES["profile_topk"](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "WindowGroupLimit" in p


def test_semantic_topk_has_no_cross_product(spark):
    p = plan(QUERIES["semantic_topk"](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "FlatMapCoGroupsInPandas" in p


def test_scan_prunes_columns(spark):
    p = QUERIES["threshold_buckets"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    # the part scan reads only the columns the catalogue needs
    assert "p_retailprice" not in p


def test_codes_have_no_cross_product(spark):
    p = plan(QUERIES["semantic_topk_codes"](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_tokeniser_not_pushed_into_scan(spark):
    # an inner explode would make the optimizer infer size(terms) > 0 and run the
    # tokeniser inside the documents scan as a data filter
    p = QUERIES["tokenize"](spark, SF_SMALL)
    from tuneshelf.operators.textindex import term_counts
    from tuneshelf.sources import tables as S
    counts = term_counts(S.text_corpus(spark, SF_SMALL), "doc_id", "text")
    scan_lines = [ln for ln in counts._jdf.queryExecution().executedPlan().toString().splitlines()
                  if "FileScan" in ln and "documents" in ln]
    assert scan_lines and not any("regexp_extract_all" in ln for ln in scan_lines)
    assert p is not None


def test_no_registered_query_plans_a_cross_product(spark):
    """Sweep: no executed plan of any registered batch query pairs rows without a key."""
    bad = {}
    for name, fn in QUERIES.items():
        # stream runs (their per-batch plan is answer_questions) and jobs that read back what they wrote
        if name.startswith(("stream_", "incremental_", "index_snapshots")):
            continue
        p = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        hits = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin") if w in p]
        if hits:
            bad[name] = hits
    assert bad == {}
