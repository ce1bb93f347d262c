"""Rankings that skip work by bounds equal brute force, and skip it where the data allow."""

import math
import random
from collections import Counter
from unittest import mock

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tuneshelf.operators import embed as E
from tuneshelf.operators import mentions as M
from tuneshelf.operators import pq as PQ
from tuneshelf.operators import profiles as P
from tuneshelf.operators import retrieve as RT
from tuneshelf.operators import semantic as SM
from tuneshelf.operators import textindex as T
from tuneshelf.operators.vectorblocks import bounded_cells
from tuneshelf.options import Settings
from tuneshelf.plans.queries import QUERIES
from tuneshelf.sources import tables as S

from conftest import SF_CHECK, SF_SMALL

# ---------------------------------------------------------------- term blocks ---


def random_corpus(seed, n=300, topics=12):
    """Short texts; a topic's texts share words of their own."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = i % topics
        words = [f"topic{t}w{rnd.randint(0, 3)}" for _ in range(rnd.randint(0, 4))] + [f"common{rnd.randint(0, 5)}" for _ in range(rnd.randint(0, 3))]
        rows.append((f"d{i:04d}", " ".join(words), float(rnd.choice([0, 0, 10, 50, 100]))))
    return rows


def brute_hybrid(index, questions, k):
    """Top k of every question over all documents, from the index's own weights."""
    weights, vocab = {}, {r["term"] for r in index.vocab.collect()}
    for r in index.postings.collect():
        weights.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    pops = {r["doc_id"]: r["popularity"] for r in index.docs.collect()}
    out = {}
    for q in T.question_vectors(questions, index.vocab).groupBy("question_id").agg(F.collect_list(F.struct("term", "qweight")).alias("v")).collect():
        out[q["question_id"]] = {t: w for t, w in q["v"] if t in vocab}
    ranked = {}
    for q in [r["question_id"] for r in questions.collect()]:
        v = out.get(q, {})
        scored = [(-math.floor((0.7 * sum(w * weights.get(d, {}).get(t, 0.0) for t, w in v.items()) + 0.3 * (p / 100.0)) * 1e10 + 0.5), d)
                  for d, p in pops.items()]
        ranked[q] = [d for _, d in sorted(scored)[:k]]
    return ranked


@pytest.mark.parametrize(("block", "part", "k", "cells"), [(20, 3, 5, 0), (7, 1000, 12, 0), (4096, 2048, 400, 20_000)])
def test_term_blocks_equal_brute_force(spark, block, part, k, cells):
    docs = spark.createDataFrame(random_corpus(block), "doc_id string, text string, popularity double")
    asked = [("q1", "topic3w1 topic3w2 common1"), ("q2", "common0 common1 common2"), ("q3", "unknown words"), ("q4", ""), ("q5", None),
             *[(f"r{i}", f"topic{i}w0 topic{i}w1 topic{i}w2 topic{i}w3") for i in range(12)]]
    questions = spark.createDataFrame(asked, "question_id string, question string")
    s = Settings(term_block=block, question_part=part, bound_cells=cells)
    index = T.build_text_index(docs, settings=s)
    stats = {}
    got = {}
    for r in sorted(RT.tfidf_topk(index, questions, k, s, stats=stats).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["question_id"], []).append(r["doc_id"])
    assert got == brute_hybrid(index, questions, k)
    if block == 20:
        assert stats["scored"] < stats["cells"]  # topics gather in few blocks: others are skipped


def test_blocks_of_a_frequent_term_are_cut_by_popularity(spark):
    """240 documents with one heaviest term make 12 blocks: a question needs the popular ones only,
    and looks into one group of blocks instead of 12 of them."""
    rnd = random.Random(5)
    docs = [(f"d{i:03}", "river stone" if i % 3 else "river stone bridge", float(i * 7 % 101)) for i in range(240)]
    docs += [(f"z{i:02}", "cloud " + rnd.choice(["rain", "snow"]), 50.0) for i in range(10)]
    corpus = spark.createDataFrame(docs, "doc_id string, text string, popularity double")
    questions = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(["river stone", "stone", "river bridge", "rain", ""])], "question_id string, question string")
    s = Settings(term_block=20, bound_cells=0)
    index, stats, got = T.build_text_index(corpus, settings=s), {}, {}
    for r in sorted(RT.tfidf_topk(index, questions, 6, s, stats=stats).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["question_id"], []).append(r["doc_id"])
    assert got == brute_hybrid(index, questions, 6)
    tops = index.blocks.tops
    assert tops.select("block").distinct().count() > 6 > tops.select("grp").distinct().count()
    assert stats["scored"] <= 14 < stats["cells"]  # of 3 x 12 cells and more


# -------------------------------------------------------------- vector blocks ---


def clustered(seed, n, clusters, dim=16, noise=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    return centres[np.arange(n) % clusters] + noise * rng.standard_normal((n, dim))


def vectors_frame(spark, x, id_name):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in enumerate(x)], f"{id_name} long, embedding array<double>")


def brute_cosine(q, d, m):
    qn, dn = np.linalg.norm(q, axis=1), np.linalg.norm(d, axis=1)
    den = qn[:, None] * dn[None, :]
    s = np.where(den > 0, (q @ d.T) / np.where(den > 0, den, 1), 0.0)
    return {i: list(np.lexsort((np.arange(len(d)), -np.floor(s[i] * 1e10 + 0.5)))[:m]) for i in range(len(q))}


def ranked(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["question_id"], []).append(r["doc_id"])
    return out


def test_vector_blocks_equal_brute_force_and_skip_clusters(spark):
    d = np.concatenate([clustered(1, 400, 8), np.zeros((2, 16))])
    q = np.concatenate([clustered(2, 40, 8), clustered(1, 16, 8), np.zeros((1, 16)), -clustered(1, 4, 8)])
    s = Settings(document_block=30, question_block=9, pivots=8, pivot_sample=200)
    share = {}
    for name, docs in (("clustered", d), ("spread", np.random.default_rng(3).standard_normal((402, 16)))):
        stats = {}
        got = SM.dense_topk(vectors_frame(spark, q, "question_id"), vectors_frame(spark, docs, "doc_id"), 5, s, stats=stats).collect()
        assert ranked(got) == brute_cosine(q, docs, 5)
        share[name] = stats["scored"] / stats["cells"]
    assert share["clustered"] < 0.5 and share["clustered"] < share["spread"]


def test_many_questions_of_a_cell_and_ties(spark):
    """Equal documents keep the order of their ids over all chunks of a cell, and a cell holds as
    many questions as documents: those are not copied to each ``question_block`` of them."""
    rng = np.random.default_rng(4)
    d = np.repeat(rng.standard_normal((30, 8)), 40, axis=0)[rng.permutation(1200)]
    q = np.concatenate([d[:50], rng.standard_normal((50, 8)), np.zeros((1, 8))])
    with mock.patch.object(SM, "_CHUNK", 64):
        got = SM._cell_topk(7, "long", "long")(None, pd.DataFrame({"qid": range(101), "vec": list(q)}), pd.DataFrame({"did": range(1200), "vec": list(d)}))
    want = brute_cosine(q, d, 7)
    assert {i: list(g["did"]) for i, g in got.groupby("qid")} == want
    cells = []

    def seen(qs, ds, m, score_cells, merge, settings, stats):
        def counted(left, right, keys):
            cells.append(right.count())
            return score_cells(left, right, keys)
        return bounded_cells(qs, ds, m, counted, merge, settings, stats)

    with mock.patch.object(SM, "bounded_cells", seen):
        s = Settings(document_block=400, question_block=2, pivots=4)
        found = SM.dense_topk(vectors_frame(spark, q, "question_id"), vectors_frame(spark, d, "doc_id"), 7, s).collect()
    assert ranked(found) == want and max(cells) <= 1200  # 25 copies with question blocks of 2


def test_answers_rank_before_they_broadcast(spark):
    """No broadcast of the answer job contains a ranking (it would wait for it, and time out)."""
    plan = QUERIES["answer_questions"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan


def test_hashed_embedding_of_repeated_and_missing_ids(spark):
    """Rows of one id share the sum of their tokens; a row without id or text has the zero vector."""
    rows = [(1, "red ring ring"), (1, "blue bolt"), (2, None), (3, ""), (None, "red ring"), (4, "Über ring 12")]
    got = sorted((str(r["doc_id"]), r["embedding"]) for r in E.hashed_embedding(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect())
    make = E.python_hashed_embedder(8)()
    a, b, c = make(["red ring ring", "blue bolt", "Über ring 12"])
    one = [x + y for x, y in zip(a, b, strict=True)]
    assert got == sorted([("1", one), ("1", one), ("2", [0.0] * 8), ("3", [0.0] * 8), ("None", [0.0] * 8), ("4", c)])
    assert "collect_list(struct" not in E.hashed_embedding(spark.createDataFrame(rows, "doc_id long, text string"), 8)._jdf.queryExecution().toString()


def test_cells_meet_without_adaptive_partitions(spark):
    """Keys of both sides are dealt alike when nothing coalesces the partitions (as in a stream)."""
    x = np.random.default_rng(9).standard_normal((2100, 8))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for s in (Settings(question_block=9), Settings(document_block=500, pivots=4)):
            got = SM.dense_topk(vectors_frame(spark, x[:30], "question_id"), vectors_frame(spark, x, "doc_id"), 5, s).collect()
            assert ranked(got) == brute_cosine(x[:30], x, 5)
        assert ranked(PQ.pq_topk(vectors_frame(spark, x[:30], "question_id"), vectors_frame(spark, x, "doc_id"), 5).collect()) == brute_cosine(x[:30], x, 5)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


# -------------------------------------------------------------- product codes ---


@pytest.mark.parametrize("sf", [SF_CHECK, "/root/testdata/sf0.1"])
def test_product_codes_recall(spark, sf):
    e = S.table(spark, sf, "embeddings")
    q, d = e.select(F.col("vec_id").alias("question_id"), "embedding"), e.select(F.col("vec_id").alias("doc_id"), "embedding")
    stats = {}
    got = {(r["question_id"], r["doc_id"]) for r in PQ.pq_topk(q, d, 12, stats=stats).collect()}
    want = {(r["question_id"], r["doc_id"]) for r in SM.dense_topk(q, d, 12).collect()}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.99
    assert stats["compared"] < 0.1 * e.count() ** 2  # the rest was decided by codes


def test_product_codes_of_odd_tables(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat(rng.standard_normal((3, 7)), 40, axis=0), np.zeros((3, 7)), rng.standard_normal((20, 7))])  # copies, zeros, odd length
    got = ranked(PQ.pq_topk(vectors_frame(spark, x, "question_id"), vectors_frame(spark, x, "doc_id"), 6).collect())
    assert got == brute_cosine(x, x, 6)
    none = vectors_frame(spark, x[:0], "doc_id")
    assert PQ.pq_topk(vectors_frame(spark, x, "question_id"), none, 6).count() == 0
    few = ranked(PQ.pq_topk(vectors_frame(spark, x[:2], "question_id"), vectors_frame(spark, x[:3], "doc_id"), 6).collect())
    assert {k: len(v) for k, v in few.items()} == {0: 3, 1: 3}


def test_product_codes_copy_and_write_few_rows(spark):
    """Cells are as many as the cores need, and each returns k rows of a question at most: no
    (question, candidate) pair is written or joined with vectors."""
    bq, bd = PQ.grid(100_000, 100_000, 12)
    assert bq <= 7 and bd <= 7 and bq * bd >= 36
    assert max(PQ.grid(600_000, 600_000, 12)) <= 10
    x = np.random.default_rng(4).standard_normal((4000, 16))
    hits = PQ.pq_topk(vectors_frame(spark, x[:50], "question_id"), vectors_frame(spark, x, "doc_id"), 5)
    assert ranked(hits.collect()) == brute_cosine(x[:50], x, 5)
    assert "Join" not in hits._jdf.queryExecution().executedPlan().toString()


def test_product_codes_of_repeated_ids(spark):
    """An id stands for all its rows on either side; a row without id takes no part."""
    x = np.random.default_rng(6).standard_normal((30, 8))
    rows = [(i, x[i].tolist()) for i in range(30)] + [(3, x[3].tolist()), (None, x[4].tolist())]
    got = {}
    hits = PQ.pq_topk(spark.createDataFrame(rows, "question_id long, embedding array<double>"), spark.createDataFrame(rows, "doc_id long, embedding array<double>"), 6)
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["question_id"], []).append(r["doc_id"])
    assert set(got) == set(range(30)) and all(None not in d and len(d) == 6 for d in got.values())
    assert got[3] == [3] * 6 and got[5][0] == 5
    assert all(d.count(3) in (0, 4) or 3 in d[-3:] for i, d in got.items() if i != 3)


# --------------------------------------------------------------- energy lists ---


def test_energy_lists_equal_brute_force(spark):
    rnd = random.Random(6)
    songs = [(i, f"t{i}", rnd.choice(["pop", "rock", None]), rnd.choice(["happy", "sad"]), rnd.randint(0, 100) / 100) for i in range(200)]
    songs += [(i, "t", "jazz", "calm", 0.5) for i in range(200, 230)] + [(300, "none", "pop", "happy", None)]
    profiles = [(i, rnd.choice(["pop", "rock", "jazz", "none", ""]), rnd.choice(["happy", "sad", "calm", ""]), rnd.choice([0.0, 1.0, 0.5, rnd.random(), 7.0, -3.0]))
                for i in range(60)]
    sf = spark.createDataFrame(songs, "song_id long, title string, genre string, mood string, energy double")
    pf = spark.createDataFrame(profiles, "profile_id long, favorite_genre string, favorite_mood string, target_energy double")
    for limit in (2_000, 0):
        got = {}
        top = P.profile_topk(pf, sf, 4, max_broadcast_lists=limit)
        assert {"title", "score", "rank"} <= set(top.columns)
        for r in sorted(top.collect(), key=lambda r: r["rank"]):
            got.setdefault(r["profile_id"], []).append(r["song_id"])
        for i, g, m, t in profiles:
            def key(s):
                score = (s[2] == g) + (s[3] == m) + 2.0 * (1.0 - abs(s[4] - t))
                return -math.floor(score * 1e10 + 0.5), s[0]
            assert got[i] == [s[0] for s in sorted((s for s in songs if s[4] is not None), key=key)[:4]]


def test_profiles_rank_without_sorting_candidates(spark):
    """The candidates of a profile whose id is its own are ranked in its row: their score needs no window."""
    rnd = random.Random(3)
    songs = [(i, f"t{i}", rnd.choice(["pop", "rock"]), rnd.choice(["happy", "sad"]), rnd.randint(0, 100) / 100) for i in range(300)]
    sf = spark.createDataFrame(songs, "song_id long, title string, genre string, mood string, energy double")
    rows = [(1, "pop", "sad", 0.5), (2, "rock", "happy", 0.1), (2, "rock", "happy", 0.1), (None, "pop", "sad", 0.9)]
    top = P.profile_topk(spark.createDataFrame(rows, "profile_id long, favorite_genre string, favorite_mood string, target_energy double"), sf, 3)
    got = sorted((str(r["profile_id"]), r["rank"], r["song_id"], r["score"]) for r in top.collect())
    assert [g[:2] for g in got if g[0] != "2"] == [(p, n) for p in ("1", "None") for n in (1, 2, 3)]
    twos = [g[2] for g in got if g[0] == "2"]
    assert twos and len(set(twos)) == len(twos)  # rows that repeat an id share their winners
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan and plan.count("Window [row_number()") == 2  # both for repeated ids


# ------------------------------------------------------------ names in answers ---


def brute_mentions(texts, names):
    import regex
    pat = regex.compile(r"[\p{L}\p{N}_]{2,}")
    known = {tuple(pat.findall(n.lower())) for n in names if n} - {()}
    out = Counter()
    for i, t in {(i, t) for i, t in texts if t is not None}:
        w = pat.findall(t.lower())
        spans = [(a, a + len(n)) for n in known for a in range(len(w) - len(n) + 1) if tuple(w[a: a + len(n)]) == n]
        out.update((i, " ".join(w[a:b]), a + 1, b - a) for a, b in spans if not any((c, d) != (a, b) and c <= a and d >= b for c, d in spans))
    return out


def test_mentions_equal_brute_force(spark):
    rnd = random.Random(8)
    words = ["gold", "ring", "blue", "sea", "the", "Ünder"]
    names = ["gold ring", "ring", "the blue sea", "blue", "sea", "GOLD", "ring the", "ünder", "", None, "!!", "one two three four five"]
    texts = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for i in range(40)] + [(50, None), (51, ""), (52, "one two three four five six"),
                                                                                        (53, "Gold, ring."), (53, "Gold, ring."), (53, "the blue SEA")]
    got = M.mentions(spark.createDataFrame(texts, "question_id long, raw_answer string"),
                     M.phrase_dictionary(spark.createDataFrame([(n,) for n in names], "name string")))
    assert Counter(tuple(r) for r in got.collect()) == brute_mentions(texts, names)
    nobody = M.phrase_dictionary(spark.createDataFrame([], "name string"))
    assert M.mentions(spark.createDataFrame(texts, "question_id long, raw_answer string"), nobody).count() == 0


def test_names_that_were_retrieved_are_no_news(spark):
    answers = spark.createDataFrame([(1, "Try gold ring, gold ring and blue sea."), (2, "Blue sea!")], "question_id long, raw_answer string")
    hits = spark.createDataFrame([(1, "Blue Sea"), (2, "gold ring")], "question_id long, track_name string")
    names = spark.createDataFrame([("gold ring",), ("Blue Sea",), ("ring",)], "track_name string")
    got = {tuple(r) for r in M.names_not_retrieved(answers, hits, names).collect()}
    assert got == {(1, "gold ring", 2), (2, "blue sea", 1)}
    assert SF_SMALL
