"""The learned embedding spans what an exact decomposition does."""

import numpy as np

from tuneshelf.operators import lsa
from tuneshelf.operators import textindex as T
from tuneshelf.plans.catalog_jobs import Catalog
from tuneshelf.plans.queries import QUERIES

from conftest import SF_SMALL


def dense(index):
    terms = sorted(r["term"] for r in index.vocab.collect())
    docs = sorted(r["doc_id"] for r in index.docs.collect())
    a = np.zeros((len(docs), len(terms)))
    for r in index.postings.collect():
        a[docs.index(r["doc_id"]), terms.index(r["term"])] = r["weight"]
    return docs, a


def test_basis_equals_the_exact_decomposition(spark):
    index = Catalog(spark, SF_SMALL).index
    docs, a = dense(index)
    basis = lsa.learn_basis(index, 8, passes=12)
    _, values, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(basis.values, values[:8], rtol=1e-3)
    assert np.allclose(basis.vectors.T @ basis.vectors, np.eye(8), atol=1e-9)
    best = np.linalg.norm(a - a @ vt[:8].T @ vt[:8])  # no subspace of that size leaves less
    assert np.linalg.norm(a - a @ basis.vectors @ basis.vectors.T) <= best * 1.001
    got = {r["doc_id"]: r["embedding"] for r in lsa.embed_documents(index, basis).collect()}
    assert set(got) == set(docs) and np.allclose(np.array([got[d] for d in docs]), a @ basis.vectors, atol=1e-9)


def test_texts_without_known_terms_and_empty_corpora(spark):
    corpus = spark.createDataFrame([("a", "red ring"), ("b", "blue ring"), ("c", ""), ("d", None)], "doc_id string, text string")
    index = T.build_text_index(corpus, pop_col=None)
    basis = lsa.learn_basis(index, 50)
    got = {r["doc_id"]: np.array(r["embedding"]) for r in lsa.embed_documents(index, basis).collect()}
    assert set(got) == {"a", "b", "c", "d"} and not got["c"].any() and not got["d"].any()
    _, a = dense(index)
    assert np.allclose([np.linalg.norm(got[d]) for d in "ab"], np.linalg.norm(a[:2], axis=1))  # all of the rank is kept
    questions = spark.createDataFrame([(1, "ring"), (2, "green"), (3, None)], "question_id long, question string")
    asked = {r["question_id"]: np.array(r["embedding"]) for r in lsa.embed_questions(index, basis, questions).collect()}
    assert asked[1].any() and not asked[2].any() and not asked[3].any()
    empty = T.build_text_index(corpus.limit(0), pop_col=None)
    assert lsa.learn_basis(empty, 4).vectors.shape[0] == 0


def test_learned_ranking_finds_the_named_items(spark):
    rows = QUERIES["semantic_topk_learned"](spark, SF_SMALL).collect()
    assert rows and all(-1 - 1e-9 <= r["score"] <= 1 + 1e-9 for r in rows)
    assert np.mean([r["score"] for r in rows if r["rank"] == 1]) > 0.5
