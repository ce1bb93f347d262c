"""Near-duplicates, toxicity, nearest neighbours and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuneshelf.llm import fast_minhash, kn_toxicity, posting_ann
from tuneshelf.llm.centroid_graph import CentroidGraph, balanced_centroids
from tuneshelf.llm.common import components
from tuneshelf.llm.shingles import shingle_sets, sketches

DOCS = "doc_id long, text string, source string, band string, rep string, label string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "b", "r", "l") for i, t in rows], DOCS)


# ----------------------------------------------------------------- components ---

def brute_components(edges):
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def test_components_match_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(45)] + [(i + 1, i) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    edges += [(None, 3), (4, None), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_components(edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------- near-duplicates ---

def shingles(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_near(rows, k, threshold=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    edges = [(i, i2) for n, (i, a) in enumerate(sets) for i2, b in sets[n + 1:] if i is not None and i2 is not None and a and b
             and 100 * len(a & b) >= threshold * len(a | b)]
    label = brute_components(edges)
    return Counter((i, len(s), None if i is None else label.get(i, i)) for i, s in sets)


def copies(seed, n_base=12, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghij", k=4))
    bases = [[word() for _ in range(rnd.randint(3, 120))] for _ in range(n_base)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w) if rnd.random() < 0.8 else "\n".join(w).upper()))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,seed", [(4, 1), (5, 2)])
def test_near_duplicates_match_brute_force(spark, k, seed):
    rows = copies(seed) + [(1000, None), (1001, ""), (1002, " \t "), (None, "a b c d e f"), (1003, "a b c d e f"), (1004, "one"), (1005, "ONE"),
                           (1006, "x " * 30_000), (1007, "x " * 20_000), (3, "a b c d e f")]
    got = fast_minhash.near_duplicates(frame(spark, rows), k=k).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("seed", [7, 8])
def test_borderline_copies_without_an_original(spark, seed):
    """Many copies of few originals that are not there, most pairs near the threshold: links
    that no centre has are found by what copies have in common against the centre."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghij", k=5))
    base = [word() for _ in range(60)]
    variants = [list(base) for _ in range(3)]
    for v in variants[1:]:
        for j in rnd.sample(range(60), 4):
            v[j] = word()
    rows = []
    for i in range(90):
        w = list(rnd.choice(variants))
        for j in rnd.sample(range(60), rnd.choice([1, 1, 2, 2, 3, 4])):
            w[j] = rnd.choice([word(), "shared"])
        rows.append((i, " ".join(w)))
    want = brute_near(rows, 4)
    assert 1 < len({c for _, _, c in want}) < 80
    got = fast_minhash.near_duplicates(frame(spark, rows), k=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_shingles_that_no_other_component_has_never_become_rows(spark, monkeypatch):
    """Of what copies add to their centre's shingles only those that others have are joined."""
    own = {0: [*range(1, 11)], 1: [*range(1, 9), 100, 101], 2: [*range(1, 9), 100, 102], 3: [*range(200, 210)]}
    sets = spark.createDataFrame(list(own.items()), "doc long, elements array<long>")
    covered = spark.createDataFrame([(i, [e for e in own[i] if e < 100 or e == 100]) for i in (1, 2, 3)], "doc long, common array<long>")
    members = spark.createDataFrame([(7, i, i) for i in (1, 2, 3)], "band long, doc long, label long")
    centres = spark.createDataFrame([(7, 0)], "band long, centre long")
    labels = spark.createDataFrame([], "node long, component long")
    written, cut = {}, fast_minhash.cut_lineage

    def recorded(df, name="stage"):
        written[name] = cut(df, name)
        return written[name]

    monkeypatch.setattr(fast_minhash, "cut_lineage", recorded)
    pairs = fast_minhash._differences(members, covered, centres, labels, sets, 80).collect()
    assert {frozenset((r.doc, r.centre)) for r in pairs} == {frozenset((1, 2))}
    rows = {r.doc: sorted(d.e for d in r.apart) for r in written["near-apart"].collect()}
    assert rows == {1: [9, 10, 100], 2: [9, 10, 100]}  # 3 cannot link, and 101 and 102 are nobody else's


def test_any_member_can_be_the_centre_of_the_last_round(spark):
    """A centre that was never compared with a member gets its links with it too: such pairs have no common differences."""
    own = {0: [*range(1, 11)], 1: [*range(1, 11), 100], 2: [*range(1, 6), *range(200, 205)], 3: [*range(1, 6), *range(200, 204), 300]}
    sets = spark.createDataFrame(list(own.items()), "doc long, elements array<long>")
    members = spark.createDataFrame([(7, i, i) for i in own], "band long, doc long, label long")
    centres = spark.createDataFrame([(7, 0)], "band long, centre long")
    labels = spark.createDataFrame([], "node long, component long")
    covered = spark.createDataFrame([(i, [e for e in x if e not in (100, 300)]) for i, x in own.items()], "doc long, common array<long>")
    pairs = fast_minhash._differences(members, covered, centres, labels, sets, 80).collect()
    assert {frozenset((r.doc, r.centre)) for r in pairs} == {frozenset((0, 1)), frozenset((2, 3))}


def test_one_of_each_group_stays(spark):
    rows = copies(3) + [(None, "no id"), (500, None)]
    kept = fast_minhash.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    expected = Counter(i for (i, _, c), n in brute_near(rows, 5).items() for _ in range(n) if i == c)
    assert Counter(r.doc_id for r in kept.collect()) == expected
    assert fast_minhash.near_duplicates(frame(spark, [])).count() == 0


def test_sketch_coordinates_fill_and_estimate():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [base[:1], base[:7], base[:300], base[60:360], base]
    s = sketches(np.concatenate(sets), np.array([len(x) for x in sets]), 96)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[2] == s[3]).mean() - 240 / 360) < 0.2
    _, sizes = shingle_sets(["", None, "a b", "a b c d e a b c d e"], 4)
    assert sizes.tolist() == [0, 0, 1, 5]


# ------------------------------------------------------------------- toxicity ---

def toxic_corpus(n=400):
    rnd = random.Random(9)
    syllables = ["ba", "re", "mo", "ti", "lu", "sen", "gra", "vol"]
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rnd.randint(10, 200))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), "zwok" + rnd.choice(["", "ed", "ing", "ba", "re"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_corpus()
    odd = [(9000, None), (9001, ""), (None, "zwok zwok zwok"), (9002, "12 34"), (9003, "zwoked " * 3 + "mo " * 30_000), (0, docs[0][1])]
    lab = spark.createDataFrame([*labels, (1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    got = kn_toxicity.score(frame(spark, docs + odd), lab).collect()
    assert len(got) == len(docs) + len(odd)
    truth, by_id = dict(labels), {r.doc_id: r for r in got}
    held = [r for i, r in by_id.items() if i in truth and r.held_out]
    assert {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2} == {r.doc_id for r in held}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert by_id[None].predicted == 1 and not by_id[None].held_out
    assert by_id[9000].score == by_id[9001].score == by_id[9002].score
    clean = kn_toxicity.drop_toxic(frame(spark, docs + odd), lab)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in got if not r.predicted}


def test_scores_do_not_see_held_out_labels(spark):
    docs, labels = toxic_corpus(120)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    a, b = (sorted((r.doc_id, r.score) for r in kn_toxicity.score(frame(spark, docs), spark.createDataFrame(x, "doc_id long, toxic int")).collect())
            for x in (labels, flipped))
    assert a == b


def test_toxicity_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in kn_toxicity.score(frame(spark, [(1, "a"), (2, None)]), none).collect()] == [0.0, 0.0]
    assert kn_toxicity.score(frame(spark, []), none).count() == 0


def brute_kneser_ney(all_texts, labelled):
    """Both class models in plain Python: functions p(class, word) and p(class, word, before)."""
    d = kn_toxicity.DISCOUNT
    shared, counts = Counter(), [Counter(), Counter()]
    for t in all_texts:
        shared.update(kn_toxicity.words_of(t))
    for t, toxic in labelled:
        w = kn_toxicity.words_of(t)
        counts[0 if toxic else 1].update(zip([b"", *w[:-1]], w, strict=True) if w else ())

    def way(w):
        steps, before = [], b""
        for i, size in enumerate(kn_toxicity.PIECES):
            if len(w) > (kn_toxicity.PIECES[i - 1] if i else 0):
                steps.append((before, w[:size]))
                before = w[:size]
        return [*steps, (before, w + b"!")]

    total, heard = Counter(), [Counter(), Counter()]
    for w, n in shared.items():
        total[b""] += n
        total.update({node: n for _, node in way(w)})
    kids, mass = [{}, {}], [Counter(), Counter()]
    for c in (0, 1):
        for (_, w) in counts[c]:
            heard[c].update(node for _, node in way(w))
    for c in (0, 1):
        for w in {w for _, w in counts[c]}:
            for before, node in way(w):
                kids[c].setdefault(before, set()).add(node)
        for before, own in kids[c].items():
            mass[c][before] = sum(heard[c][n] for n in own)

    def word(c, w):
        p = 1.0
        for before, node in way(w):
            low = total[node] / total[before]
            p *= (max(heard[c][node] - d, 0) + d * len(kids[c][before]) * low) / mass[c][before] if mass[c][before] else low
        return p

    def pair(c, h, w):
        n = sum(v for (a, _), v in counts[c].items() if a == h)
        k = sum(a == h for a, _ in counts[c])
        return (max(counts[c][h, w] - d, 0) + d * k * word(c, w)) / n if n else word(c, w)
    return set(shared), word, pair


def test_evidence_equals_kneser_ney_in_plain_python(spark):
    rnd = random.Random(12)
    plain = ["the", "of", "sea", "seasons", "seasonal", "ringing", "rings", "an", "Über", "überall", "it's"]
    rude = ["idiot", "idiotic", "idio", "scumbag", "the"]
    texts = []
    for i in range(40):
        words = rnd.choices(plain, k=rnd.randint(0, 12)) + (rnd.choices(rude, k=3) if i % 4 == 0 else [])
        rnd.shuffle(words)
        texts.append((i, " ".join(words), i % 4 == 0))
    unseen = [(100, "idiotically seasoned rings of scum", None), (101, "xyz idi", None), (102, None, None), (103, "", None)]
    docs = frame(spark, [(i, t) for i, t, _ in texts] + [(i, t) for i, t, _ in unseen])
    sample = spark.createDataFrame([(i, bool(x), i % 2) for i, _, x in texts], "doc_id long, toxic boolean, part int")
    model = kn_toxicity.collect_model(kn_toxicity.tables(kn_toxicity.word_counts(docs), kn_toxicity.pair_counts(docs, sample)))
    words, word, pair = brute_kneser_ney([t for _, t, _ in texts + unseen], [(t, x) for _, t, x in texts])
    for c in (0, 1):  # distributions over the words of all documents
        assert abs(sum(word(c, w) for w in words) - 1) < 1e-9
        for h in (b"", b"the", b"idiot", b"xyz"):
            assert abs(sum(pair(c, h, w) for w in words) - 1) < 1e-9
    lists = [kn_toxicity.words_of(t) for _, t, _ in texts + unseen]
    full, alone = model.evidence(lists, {})
    want = [(np.log(pair(0, h, w) / pair(1, h, w)), np.log(word(0, w) / word(1, w)))
            for own in lists for h, w in zip([b"", *own[:-1]], own)]
    assert np.allclose(np.stack([full, alone], 1), np.array(want), atol=1e-4)


def test_rude_expressions_of_ordinary_words(spark):
    """Every word is in both classes as often; only its neighbour tells."""
    rnd = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        fill = rnd.choices(["go", "get", "lost", "you", "home", "now", "we", "are"], k=12)
        words = [*fill[:6], *(("get", "lost", "you") if i % 3 == 0 else ("lost", "get", "you", "are")), *fill[6:]]
        docs.append((i, " ".join(w for w in words)))
        labels.append((i, int(" get lost you " in f" {docs[-1][1]} ")))
    got = kn_toxicity.score(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out]
    toxic, plain = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([a > b for a in toxic for b in plain]) > 0.9


# --------------------------------------------------------- nearest neighbours ---

VECS = "vec_id long, embedding array<float>, list string, q string, block string"


def vec_frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "l", "q", "b") for i, v in rows], VECS)


def brute_nearest(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i, v in queries:
        d = np.sqrt(((x - np.array(v, np.float32).astype(float)) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    x[500:900] = x[500]  # many equal vectors, queries among them
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0] * 16), (5002, [float("nan")] * 16), (5003, [None] + [1.0] * 15), (5004, [1.0, 2.0]), (None, [1.0] * 16),
           (5005, []), (5006, [float("inf")] * 16), (7, rows[7][1])]
    got: dict = {}
    for r in posting_ann.nearest(vec_frame(spark, rows + odd), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    queries = [r for r in rows if r[0] % 50 == 0]
    want = brute_nearest(rows, queries, 10)
    assert set(got) == set(want)
    hits = 0
    for i, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and i not in {f[1] for f in found}
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        if 500 <= i < 900:  # all at distance 0: the smallest ids but its own
            assert [f[1] for f in found] == [j for j in range(500, 512) if j != i][:10]
        hits += len({f[1] for f in found} & {j for j, _ in want[i]})
    assert hits >= 0.95 * 10 * len(want)


def test_ids_beyond_the_integers_of_a_double(spark):
    big = 1 << 53
    rows = [(0, [1.0, 0.0]), *[(big + i, [1.0, 0.5]) for i in range(6)]]
    got = sorted((r["rank"], r.vec_id) for r in posting_ann.nearest(vec_frame(spark, rows), F.col("vec_id") == 0).collect())
    assert got == [(i + 1, big + i) for i in range(6)]


def test_few_vectors(spark):
    rows = [(0, [1.0, 0]), (1, [0, 1.0]), (100, [1.0, 0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in posting_ann.nearest(vec_frame(spark, rows), F.col("vec_id") % 100 == 0).collect())
    root = float(np.sqrt(2.0))
    assert got == [(0, 1, 100, 0.0), (0, 2, 1, root), (100, 1, 0, 0.0), (100, 2, 1, root)]
    assert posting_ann.nearest(vec_frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert posting_ann.nearest(vec_frame(spark, [(1, [1.0, 0]), (2, [0, 1.0])]), F.col("vec_id") % 100 == 0).count() == 0


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 8)).astype(np.float32)
    c = balanced_centroids(x, 200)
    sizes = np.bincount(((x[:, None] - c[None]) ** 2).sum(2).argmin(1), minlength=len(c))
    assert len(c) == 200 and sizes.max() <= 6 * sizes.mean()
    g = CentroidGraph(c)
    q = rng.normal(size=(300, 8)).astype(np.float32)
    ids, _ = g.search(q, 16)
    true = ((q[:, None] - c[None]) ** 2).sum(2).argsort(1)[:, :4]
    assert np.mean([len(set(ids[i]) & set(true[i])) for i in range(300)]) >= 3.9
    ones = np.ones(200, np.int64)
    assert all(len(w) == 200 for w in g.within(q, 100.0, ones, 1, width=8))
    assert all(len(w) >= 30 for w in g.within(q, 1.0, ones, 30, width=8))


# ------------------------------------------------------------------- pipeline ---

def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline
    from conftest import SF_SMALL
    from tuneshelf.session import cut_lineage

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SF_SMALL), f"test-{name}")
        counts.append(docs.count())
        assert name == "mixing" or docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0
    total, taken = docs.agg(F.sum("size"), F.sum("taken")).first()
    assert abs(taken - 1.5 * total) <= docs.select("target").distinct().count()
