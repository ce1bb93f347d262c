"""Decontamination, line dedup, mixing and personal data on small fixtures and odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tuneshelf.llm import decontam, line_chunks, mix_schedule, pii_cooccur

DOCS = "doc_id long, text string, source string, row string, len string, h string"


def frame(spark, rows):
    """Rows (id, text, source) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, "r", "l", "h") for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", None), (3, "   ", "a"), (None, "no id here. " * 3, "a"), (4, "same text.", "b"),
       (4, "same text.", "b"), (5, "x" * 50_000 + " " + "word " * 20_000, "a")]


# -------------------------------------------------------------- decontamination ---

def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute_contamination(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, it in items:
            x = words(it)
            n = min(10, len(x))
            if not n:
                continue
            wins = {tuple(x[j: j + n]) for j in range(len(x) - n + 1)}
            for j in range(len(w) - n + 1):
                if tuple(w[j: j + n]) in wins:
                    hit.update(range(j, j + n))
                    found.add("null" if item is None else str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("block", [1_000_000, 7])
def test_decontamination_matches_brute_force(spark, block):
    rnd = random.Random(3)
    vocab = ["a", "b", "É", "é", "7", "Zz", "zz", "ß"]
    items = [(n, " ".join(rnd.choices(vocab, k=rnd.randint(0, 14)))) for n in range(20)] + [(None, "only nameless words here"), (99, None)]
    docs = [(i, "; ".join(rnd.choices(vocab, k=rnd.randint(0, 60)))) for i in range(40)] + [(i, t) for i, t, _ in ODD]
    docs += [(77, "x, Only NAMELESS\nwords here!")]
    got = decontam.contamination(frame(spark, [(i, t, None) for i, t in docs]), bench(spark, items), block_windows=block)
    assert Counter(tuple(r)[:6] for r in got.collect()) == brute_contamination(docs, items)


def test_decontamination_of_empty_tables(spark):
    none = bench(spark, [])
    rows = decontam.contamination(frame(spark, ODD), none).collect()
    assert len(rows) == len(ODD) and not any(r.contaminated for r in rows)
    assert decontam.contamination(frame(spark, []), bench(spark, [(1, "a b c")])).count() == 0


def test_contaminated_rows_and_spans_go(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = frame(spark, [(1, "clean Text, kept.", "s"), (2, "before " + item + " after", "s"), (None, "x " + item, "s"), (None, "kept too", "s")])
    kept = decontam.remove_documents(docs, bench(spark, [(1, item)]))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "kept too"), (1, "clean Text, kept.")]
    cut = {r.text for r in decontam.remove_spans(docs, bench(spark, [(1, item)])).collect()}
    assert cut == {"clean Text, kept.", "before after", "x", "kept too"}


# ------------------------------------------------------------------ line dedup ---

def passage(n, seed):
    rnd = random.Random(seed)
    return " ".join(" ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(7)).capitalize() + "." for _ in range(n))


def test_repeated_passage_goes_from_later_documents(spark):
    shared = passage(9, 1)
    rows = [(i, passage(6, 100 + i) + " tail " + shared + " head " + passage(5, 200 + i), "s") for i in range(1, 7)]
    got = {r.doc_id: r.text for r in line_chunks.dedup_lines(frame(spark, rows)).collect()}
    assert got[1] == rows[0][1]
    inner = shared.split(". ")[3]
    for i, text, _ in rows[1:]:
        assert shared not in got[i] and inner not in got[i]
        assert got[i].startswith(passage(5, 100 + i)[:60]) and got[i].endswith(passage(5, 200 + i)[-40:])


def test_whole_runs_and_long_sentences_go(spark):
    # five shared lines between own ones: chunk boundaries glue some outer line to a neighbour
    shared = [passage(5, 300 + j) for j in range(12)]
    sentence = " ".join(f"word{'abcdefghij'[n % 10]}{'klmnop'[n // 10]}" for n in range(53)) + "."
    rows = [(1000, " ".join(shared) + "\n" + sentence, "s")]
    rows += [(2000 + j, f"{passage(3, 400 + j)} {shared[j]} {passage(3, 500 + j)}", "s") for j in range(12)]
    rows += [(3000, f"{passage(3, 600)} {sentence} {passage(3, 601)}", "s"), (3001, "Short stock line. " + passage(2, 602), "s"),
             (3002, "Short stock line. " + passage(2, 603), "s")]
    stock = {r.doc_id: r.text for r in line_chunks.dedup_lines(frame(spark, rows), whole=True).collect()}
    assert stock[1000] == rows[0][1] and stock[3001] == rows[-2][1] and stock[3002] == rows[-1][1]
    for j in range(12):
        assert stock[2000 + j] == f"{passage(3, 400 + j)} {passage(3, 500 + j)}"
    assert stock[3000] == f"{passage(3, 600)} {passage(3, 601)}"


def test_stock_lines_marks_and_odd_rows_stay(spark):
    line = "All rights reserved. Thank you."
    rows = ODD + [(i, passage(3, i) + "\n" + line, "s") for i in range(10, 14)] + [(20, "odd \x1e\x1e marks \x1e. " + passage(4, 20), "s")]
    got = line_chunks.dedup_lines(frame(spark, rows), drop_empty=False)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((i, t) for i, t, _ in rows)
    assert line_chunks.dedup_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("drop_empty", [True, False])
def test_each_text_is_cut_once(spark, drop_empty):
    """Lines are read once for each text, and the lost ones are looked up, not computed for each line."""
    shared = passage(9, 1)
    rows = [(i, passage(6, 100 + i) + " tail " + shared, "s") for i in range(1, 4)]
    out = line_chunks.dedup_lines(frame(spark, rows), drop_empty=drop_empty)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "sequence(" not in plan
    assert sum(shared in r.text for r in out.collect()) == 1


def test_lost_lines_are_flags_up_to_the_last(spark):
    df = spark.createDataFrame([([(3, 2), (4, 1), (7, 1)],), ([(1, 1)],)], "c array<struct<last:int,n:int>>")
    got = [r[0] for r in df.select(line_chunks.lost_lines(df["c"])).collect()]
    assert got == [[False, True, True, True, False, False, True], [True]]


def test_copies_lose_everything_but_the_first(spark):
    text = "mark \x1e here " + passage(12, 5)
    rows = [(3, text, "s"), (1, text, "s"), (2, text, "s"), (None, text, "s"), (1, text, "s")]
    kept = line_chunks.dedup_lines(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter({(1, text): 2, (None, text): 1})


# --------------------------------------------------------------------- mixing ---

def test_mix_meets_its_targets(spark):
    rnd = random.Random(7)
    sizes = {"a": 900, "b": 60, "c": 200, "d": 30, None: 40}
    rows = [(i, " ".join(["w"] * rnd.randint(0, 80)), s) for i, s in enumerate(x for x, n in sizes.items() for _ in range(n))]
    m = mix_schedule.mix(frame(spark, rows), block=16)
    got = m.taken.collect()
    again = mix_schedule.mix(frame(spark, rows), block=16).taken.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    of = {i: s for i, _, s in rows}
    total = sum(r["size"] for r in got)
    per, target, size = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        per[of[r.doc_id]] += r.taken
        size[of[r.doc_id]] += r["size"]
        target[of[r.doc_id]] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * total)
    for s in sizes:
        assert per[s] == int(target[s]) and target[s] <= 2 * size[s]
    # water-filling by hand: 5, 2, 1, 5, 2 in code-point order, null last
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    cut: set = set()
    while True:
        left = 1.5 * total - sum(2 * size[s] for s in cut)
        lam = left / sum(weight[s] for s in sizes if s not in cut)
        more = {s for s in sizes if s not in cut and lam * weight[s] > 2 * size[s]}
        if not more:
            break
        cut |= more
    for s in sizes:
        assert target[s] == pytest.approx(2 * size[s] if s in cut else lam * weight[s])


def test_schedule_is_spread_evenly(spark):
    rows = [(i, "w " * 64, "a" if i % 3 else "b") for i in range(300)]
    slots = mix_schedule.mix(frame(spark, rows), block=32).schedule.orderBy("slot").collect()
    share = Counter(s.sid for s in slots)
    seen = Counter()
    for n, s in enumerate(slots, 1):
        seen[s.sid] += 1
        for sid in share:
            assert abs(seen[sid] - n * share[sid] / len(slots)) < 6


def test_mix_of_odd_rows(spark):
    got = mix_schedule.mix(frame(spark, ODD)).taken.collect()
    assert Counter(r["size"] for r in got) == Counter(len((t or "").split()) for _, t, _ in ODD)
    assert mix_schedule.mix(frame(spark, [])).taken.count() == 0
    assert [r.taken for r in mix_schedule.mix(frame(spark, [(1, None, None), (2, "", "a")])).taken.collect()] == [0, 0]


# -------------------------------------------------------------- personal data ---

def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        odd = sum(map(int, d[-1::-2])) + sum(sum(map(int, str(2 * int(x)))) for x in d[-2::-2])
        if 16 <= len(d) <= 19 and odd % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rnd = random.Random(11)
    pieces = ["a.b", "@", "x-y.z", ".", "1.2.3.4", "256", "+1 (555) 010-9999", "4111 1111 1111 1111", "é", " ", "-", "+", "12", "@@", "a@b", "..", "%",
              "0000255.1.1.1", "4111-1111-1111-1111", "\n", "(", "𝒳"]
    for _ in range(4000):
        t = "".join(rnd.choices(pieces, k=rnd.randint(1, 14)))
        assert pii_cooccur.base_spans(t) == brute_spans(t), t


def test_long_runs_are_linear():
    for t in ("a" * 400_000, "a@" * 200_000, "1" * 400_000, "1." * 200_000, "+1" + "(" * 400_000, "9 " * 200_000):
        pii_cooccur.base_spans(t)


def test_terms_that_give_an_entity_away(spark):
    rnd = random.Random(2)
    common = ["the", "of", "and", "to", "in", "was", "for", "with"]
    filler = lambda n: " ".join(rnd.choices(common, k=n))
    rows = [(i, filler(40) + f" rumpelstilt writes to rs@castle{0}.example.com " + filler(40), "s") for i in range(6)]
    rows += [(i, filler(200), "s") for i in range(10, 60)]
    got = {r.doc_id: r for r in pii_cooccur.sanitise(frame(spark, rows + ODD)).collect()}
    spans = got[0].spans.split(",")
    text = rows[0][1]
    told = {text[int(a): int(b)] for k, a, b in (x.split(":") for x in spans) if k in ("remove", "generalise")}
    assert spans[0].startswith("email:") and "rumpelstilt" in told and not told & set(common)
    assert got[0].base_sha256 == hashlib.sha256(spans[0].encode()).hexdigest() and got[0].n_email == 1
    assert got[1 if 1 in got else 10] is not None and got[10].spans == ""
    clean = {r.doc_id: r.text for r in pii_cooccur.masked(frame(spark, rows)).collect()}
    assert "rumpelstilt" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == rows[6][1]


def told(spark, rows):
    """Per id the terms that are removed or generalised."""
    out = {}
    for r in pii_cooccur.sanitise(frame(spark, [(i, t, "s") for i, t in rows])).collect():
        text = dict(rows)[r.doc_id]
        out.setdefault(r.doc_id, set()).update(text[t.a: t.b] for t in r.terms or [])
    return out


def test_terms_seen_beside_one_entity_or_one_host(spark):
    rnd = random.Random(4)
    common = ["the", "of", "and", "to", "in", "was", "for", "with"]
    filler = lambda n: " ".join(rnd.choices(common, k=n))
    rows = [(i, filler(200)) for i in range(100, 600)]
    rows += [(1, f"{filler(40)} zaphodine at +1 555 010 9999 {filler(40)}")]
    # each address once, their host several times: a term of the host
    rows += [(10 + i, f"{filler(40)} grindelwerk u{i}@castle.example.com {filler(40)}") for i in range(4)]
    # copies of one text are one text: elsewhere the word stands alone
    rows += [(30 + i, rows[-1][1].replace("grindelwerk", "gizmo").replace("u3@castle", "me@lone")) for i in range(1)]
    rows += [(40 + i, rows[-1][1]) for i in range(5)]
    rows += [(60 + i, f"{filler(40)} gizmo {filler(40)}") for i in range(25)]
    got = told(spark, rows)
    assert "zaphodine" in got[1] and all("grindelwerk" in got[10 + i] for i in range(4))
    assert not any("gizmo" in x or x & set(common) for x in got.values())


def test_levels_of_an_entity(spark):
    near = spark.createDataFrame([("email:a.b@x.org", "t"), ("ip:10.0.2.7", "t"), ("phone:+155501", "t")], "entity string, term string")
    assert {r.entity for r in pii_cooccur.with_levels(near).collect()} == {
        "email:a.b@x.org", "email person:a.b", "email host:x.org", "email kind:", "ip:10.0.2.7", "ip net:10.0.2", "ip kind:",
        "phone:+155501", "phone kind:"}


def test_personal_data_of_odd_rows(spark):
    got = pii_cooccur.sanitise(frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert pii_cooccur.sanitise(frame(spark, [])).count() == 0
