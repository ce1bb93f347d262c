"""Questions whose bounds reach most documents read their table; nothing is copied to blocks."""

from unittest import mock

import numpy as np
import pytest
from conftest import SF_SMALL
from test_bounded_retrieval import brute_cosine, clustered, ranked, vectors_frame

from tuneshelf.operators import semantic as SM
from tuneshelf.operators.vectorblocks import bounded_cells
from tuneshelf.options import Settings
from tuneshelf.plans import catalog_jobs as J
from tuneshelf.sources import files


def run_counted(spark, q, d, m, s):
    """Results and the rows of the right side of each call of the cells."""
    cells = []

    def seen(qs, ds, m, score_cells, merge, settings, stats):
        def counted(left, right, keys):
            cells.append(right.count())
            return score_cells(left, right, keys)
        return bounded_cells(qs, ds, m, counted, merge, settings, stats)

    with mock.patch.object(SM, "bounded_cells", seen):
        rows = SM.dense_topk(vectors_frame(spark, q, "question_id"), vectors_frame(spark, d, "doc_id"), m, s).collect()
    return ranked(rows), cells


def test_spread_documents_are_not_copied_to_the_questions(spark):
    rng = np.random.default_rng(5)
    d = np.concatenate([rng.standard_normal((700, 12)), np.zeros((3, 12)), np.ones((40, 12))])
    q = np.concatenate([rng.standard_normal((60, 12)), np.zeros((3, 12)), np.ones((2, 12))])
    s = Settings(document_block=100, question_block=10, pivots=6)
    got, cells = run_counted(spark, q, d, 7, s)
    assert got == brute_cosine(q, d, 7)
    assert cells[0] == 743 and sum(cells[1:]) < 200  # the nearest pivot's blocks, and what few questions still need


def test_questions_of_both_kinds_and_repeated_ids(spark):
    d = clustered(1, 400, 8)
    q = np.concatenate([clustered(3, 30, 8), np.random.default_rng(4).standard_normal((30, 16))])
    s = Settings(document_block=50, question_block=8, pivots=8)
    got, cells = run_counted(spark, q, d, 5, s)
    assert got == brute_cosine(q, d, 5) and len(cells) == 2
    twice = vectors_frame(spark, np.concatenate([q, q]), "question_id").selectExpr(f"question_id % {len(q)} as question_id", "embedding")
    got = SM.dense_topk(twice, vectors_frame(spark, d, "doc_id"), 4, s).collect()
    best = brute_cosine(q, d, 4)
    assert {(r["question_id"], r["rank"]): r["doc_id"] for r in got} == {(i, r): best[i][(r - 1) // 2] for i in best for r in range(1, 5)}


def test_string_ids_and_a_table_that_tasks_cannot_open(spark):
    rng = np.random.default_rng(6)
    d, q = np.repeat(rng.standard_normal((60, 8)), 5, axis=0), rng.standard_normal((20, 8))
    names = [f"d{i * 7 % 300}é" for i in range(300)]
    docs = spark.createDataFrame([(n, [float(v) for v in x]) for n, x in zip(names, d, strict=True)], "doc_id string, embedding array<double>")
    order = sorted(range(300), key=lambda i: names[i])
    want = {i: [names[order[j]] for j in best] for i, best in brute_cosine(q, d[order], 8).items()}
    s = Settings(document_block=64, pivots=4)
    assert ranked(SM.dense_topk(vectors_frame(spark, q, "question_id"), docs, 8, s).collect()) == want
    with mock.patch.object(files, "parts_for_tasks", lambda *a: []):
        assert ranked(SM.dense_topk(vectors_frame(spark, q, "question_id"), docs, 8, s).collect()) == want


@pytest.mark.parametrize("dim,shape", [(8, (64, 128)), (64, (37, 11))])
def test_products_of_four_byte_numbers_lose_nothing(dim, shape):
    rng = np.random.default_rng(7)
    du, qu = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.standard_normal((n, dim)) for n in shape))
    du[::5] = qu[0]  # equal ones: close calls, and a crowd
    s = du @ qu.T
    bar = np.sort(s, axis=0)[-3]
    pos, q = SM._reaching(du, qu, qu.astype(np.float32), bar)
    assert set(zip(*np.nonzero(s >= bar), strict=True)) <= set(zip(pos, q, strict=True))


def test_readers_of_documents_do_not_embed_them_again(spark):
    docs = J.Catalog(spark, SF_SMALL).embedded_docs
    assert "MapInArrow" not in docs.select("doc_id", "doc_type")._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_written_once(spark):
    """Beyond one block the documents' vectors are in one table, the questions' in two; below it in none."""
    from tuneshelf.plans.queries import QUERIES
    from tuneshelf.session import ensure_checkpoint_dir

    def tables():
        return set(files.names(spark, ensure_checkpoint_dir(spark)))

    before = tables()
    QUERIES["semantic_topk_learned"](spark, SF_SMALL).collect()
    learned = {n[:-13] for n in tables() - before}
    assert learned and not any(n.startswith("learned") for n in learned)
    before, x = tables(), np.random.default_rng(8).standard_normal((300, 8))
    SM.dense_topk(vectors_frame(spark, x[:20], "question_id"), vectors_frame(spark, x, "doc_id"), 5, Settings(document_block=100, pivots=4)).collect()
    assert {n[:-13] for n in tables() - before} == {"pivot-input", "pivot-asked", "pivot-rest", "pivot-seen", "pivot-parts"}
