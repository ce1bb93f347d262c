"""Prefix trie, exact duplicates and hard negatives against brute force, and odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuneshelf.llm import hard_negatives, poly_dedup, prefix_trie

# ------------------------------------------------------------------------- trie ---

TURNS = "conv_id long, turn long, role string, text string, path string, shard string, ends string"


def conversations(spark, rows):
    """Rows (conv_id, turn, role, text) with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "p", "s", "e") for r in rows], TURNS)


def ordered(rows):
    """conv_id -> [(role, text)] by turn, null first, then by the digest of role and text."""
    def key(r):
        role, text = r[2] or "", r[3] or ""
        return (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest())
    out = {}
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def brute_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = Counter(path[:-1] for path in members if path)
    out = Counter()
    for path, own in members.items():
        below = [(p, m) for p, m in members.items() if p[:len(path)] == path]
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))
        out[(min(own), len(path), min(members[path[:-1]]) if path else None, len(own), kids[path], sum(not kids[p] for p, _ in below),
             sum((len(m) - 1) * len(p[-1][1]) for p, m in below if p), hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def random_conversations(seed, n=60):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.choice([0, 1, 2, 3, 5, 7])):
            rows.append((c * 7, t, rnd.choice(["user", "bot"]) if t else "user", rnd.choice(["a", "bé", "ccc"])))
    return rows


ODD_TURNS = [(None, 0, "user", "nobody"), (5000, None, None, None), (5000, 0, "user", ""), (5001, 0, "user", "x" * 200_000),
             (5002, 0, "user", "x" * 200_000), (5003, 0, "user", "a"), (5003, 0, "user", "a"), (5003, 0, "bot", "b"), (-250, 0, "user", "a")]


@pytest.mark.parametrize(("members", "turns"), [(1024, 50_000), (3, 50_000), (1, 1), (7, 9)])
def test_trie_matches_brute_force(spark, members, turns):
    rows = random_conversations(members) + ODD_TURNS
    keys = prefix_trie.numbered(prefix_trie.turn_keys(conversations(spark, rows)))
    got = prefix_trie.trie(keys, shard_members=members, shard_turns=turns)
    assert Counter(tuple(r) for r in got.collect()) == brute_trie(ordered(rows))


def test_rebuilt_conversations_match_brute_force(spark):
    rnd = random.Random(2)
    rows = [(c, t, "user", rnd.choice("ab")) for c in [*range(0, 40), *range(100, 130), *range(231, 260), *range(300, 330), -150, -100, -120]
            for t in range(rnd.choice([1, 2, 4, 6, 8]))]
    own, convs = ordered(rows), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        convs[c] = own.get(base, [])[:h] + own[c][h:]
    assert any(not t for t in convs.values())  # some are turnless
    keys = prefix_trie.numbered(prefix_trie.turn_keys(conversations(spark, rows)))
    got = prefix_trie.trie(prefix_trie.with_shared_heads(keys), shard_members=16)
    assert Counter(tuple(r) for r in got.collect()) == brute_trie(convs)


def test_trie_of_copies_long_chains_and_empty_tables(spark):
    chain = [(c, t, "user", f"t{t}") for c in (1, 2) for t in range(3000)] + [(c, 0, "user", "t0") for c in range(10, 400)]
    keys = prefix_trie.numbered(prefix_trie.turn_keys(conversations(spark, chain)))
    got = {r.depth: r for r in prefix_trie.trie(keys, shard_members=50).collect()}
    assert len(got) == 3001 and got[0].n_convs == 392 and got[1].n_convs == 392 and got[2].n_convs == 2
    assert got[0].n_leaves == 1 and got[0].saved_tokens == 391 * 2 + sum(len(f"t{t}") for t in range(1, 3000))
    assert got[1].ends_sha256 == hashlib.sha256(",".join(map(str, range(10, 400))).encode()).hexdigest()
    assert prefix_trie.trie(prefix_trie.numbered(prefix_trie.turn_keys(conversations(spark, [])))).count() == 0


# --------------------------------------------------------------- exact duplicates ---

DOCS = "doc_id long, text string, h1 long, place string, scan_key string, part string, n string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 0, "p", "k", "x", "n") for i, t in rows], DOCS)


def lower(t):
    return (t or "").encode().lower().decode()


def brute_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = Counter()
    for i, t in rows:
        own = groups[lower(t)]
        keep = max((x for x in own if x is not None), default=None)
        out[(i, keep, len(own), i == keep, hashlib.sha256(lower(t).encode()).hexdigest())] += 1
    return out


def copies():
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["Same Text", "same text", "SAME TEXT", "Él", "él", "éL", "a" * rnd.randint(0, 5), None, ""])) for i in range(80)]
    long = "".join(rnd.choices("abcXYZ é", k=150_000))
    return rows + [(200, long), (201, long.replace("X", "x")), (202, long[:-1] + "q"), (203, long), (203, long), (None, "Same Text"),
                   (None, "only here"), (None, "only here"), (204, "twice"), (204, "twice"), (204, "Twice"), (205, long.replace("é", "É"))]


@pytest.mark.parametrize(("large", "piece", "modulus"), [(1 << 23, 1 << 16, poly_dedup.MODULUS), (1000, 100, poly_dedup.MODULUS), (1000, 7, 3), (1 << 23, 1 << 16, 1)])
def test_copies_match_brute_force(spark, large, piece, modulus):
    """Texts hashed in place and in spread rows; and fingerprints that collide nearly always."""
    rows = copies()
    got = poly_dedup.exact_duplicates(documents(spark, rows), large=large, piece=piece, modulus=modulus)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute_copies(rows)


def test_polynomials_combine_wherever_a_text_is_cut():
    rnd = random.Random(9)
    data = rnd.randbytes(70_001)
    p, b = poly_dedup.MODULUS, poly_dedup.BASES
    whole = poly_dedup.polynomial(data)
    slow = 0
    for x in data:
        slow = (slow * b[0] + x) % p
    assert whole[0] == slow
    for cut in (0, 1, 16_384, 16_385, 50_000, 70_001):
        left, right = poly_dedup.polynomial(data[:cut]), poly_dedup.polynomial(data[cut:])
        assert whole == [poly_dedup.combine(x, y, len(data) - cut, base) for x, y, base in zip(left, right, b, strict=True)]


def test_rows_of_spread_texts_have_the_fingerprints_of_texts_hashed_in_place(spark, monkeypatch):
    monkeypatch.setattr(poly_dedup, "SPREAD", 1000)
    docs = documents(spark, copies())
    a, b = ({tuple(r) for r in poly_dedup.fingerprints(docs, large=n).collect()} for n in (1 << 23, 0))
    assert a == b


def test_one_row_of_each_class_stays(spark):
    rows = copies()
    kept = poly_dedup.drop_copies(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    got = [(r.doc_id, lower(r.text)) for r in kept.collect()]
    assert len(got) == len({t for _, t in got}) == len({lower(t) for _, t in rows})
    best = {}
    for i, t in rows:
        best[lower(t)] = max(best.get(lower(t), -1), -1 if i is None else i)
    assert {t: -1 if i is None else i for i, t in got} == best


def test_copies_of_empty_tables(spark):
    assert poly_dedup.exact_duplicates(documents(spark, [])).count() == 0
    assert poly_dedup.drop_copies(documents(spark, [])).count() == 0


# ----------------------------------------------------------------- hard negatives ---

VECTORS = "vec_id long, label int, vec array<long>, dim string, a_id string, positives string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "d", "a", "p") for r in rows], VECTORS)


def brute_negatives(rows, anchors, m=5, k=3, low=50, high=95):
    own = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and None not in v:
            own[i] = min(own.get(i, (label, v)), (label, v))
    out = Counter()
    for a in anchors:
        if a not in own:
            continue
        label, x = own[a]
        scored = sorted((-sum(p * q for p, q in zip(x, v, strict=True)), i, lab) for i, (lab, v) in own.items() if i != a and len(v) == len(x))
        for ps, pid, _ in [s for s in scored if s[2] == label][:m]:
            fit = [s for s in scored if s[2] != label and low * -ps <= 100 * -s[0] <= high * -ps][:k]
            out.update((a, pid, r, nid, -ps, -ns) for r, (ns, nid, _) in enumerate(fit, 1))
    return out


def random_vectors(seed, n=300, spread=9, dim=6):
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(0, 3), [rnd.randint(-2, spread) for _ in range(dim)]) for i in range(n)]
    return rows + [(n, None, [1] * dim), (n + 1, 1, None), (n + 2, 1, [1, None, *[1] * (dim - 2)]), (None, 1, [5] * dim), (10, 0, [99] * dim),
                   (10, 0, [99] * dim), (n + 4, 2, [1]), (n + 5, 1, []), (n + 6, 1, []), (n + 7, 2, []), (n + 8, 9, [0] * dim), (n + 9, 8, [4] * dim)]


@pytest.mark.parametrize(("seed", "block"), [(1, 32_768), (2, 40), (3, 7)])
def test_negatives_match_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", block)
    rows = random_vectors(seed)
    got = hard_negatives.mine(vectors(spark, rows), (F.col("vec_id") % 5 == 0) | (F.col("vec_id") >= 300))
    anchors = [i for i, _, _ in rows if i is not None and (i % 5 == 0 or i >= 300)]
    want = brute_negatives(rows, sorted(set(anchors)))
    assert want and Counter(tuple(r) for r in got.collect()) == want


def test_windows_with_equal_limits_and_large_numbers(spark):
    same = [(i, 0, [3, 4]) for i in range(10)] + [(i, 1, [2, 2]) for i in range(10, 20)]  # ties everywhere
    big = [(i, i % 2, [2_000_000_000 + i, -i]) for i in range(20)]
    big += [(i, 1, [1_200_000_000 + i, 5]) for i in range(20, 40)]
    for rows in (same, big):
        got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 2 == 0)
        want = brute_negatives(rows, range(0, len(rows), 2))
        assert want and Counter(tuple(r) for r in got.collect()) == want


def test_slots_are_disjoint_and_below_their_limits():
    limits = np.array([90, 70, 70, 20])
    assert hard_negatives.slots_of(np.array([91, 90, 71, 70, 21, 20, -5]), limits).tolist() == [-1, 0, 0, 2, 2, 3, 3]


def test_negatives_of_empty_tables_and_odd_components(spark):
    assert hard_negatives.mine(vectors(spark, []), F.lit(True)).count() == 0
    raw = spark.createDataFrame([(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, None)], "vec_id long, v array<double>")
    got = raw.where(hard_negatives.finite(F.col("v"))).select("vec_id", hard_negatives.quantise(F.col("v")).alias("q")).collect()
    assert [(r.vec_id, r.q) for r in got] == [(1, [128, -1])]
