"""Versioned snapshots, incremental ingest, scratch clean-up and the hooks' lengths."""

import os

import pytest
from pyspark.sql import functions as F

from tuneshelf.operators import documents as D
from tuneshelf.operators import embed as E
from tuneshelf.operators import grounding as G
from tuneshelf.operators import textindex as T
from tuneshelf.options import Settings
from tuneshelf.plans import increment as I
from tuneshelf.plans import store as ST
from tuneshelf.plans.catalog_jobs import Catalog
from tuneshelf.session import cut_lineage, job_scratch, scratch_path
from tuneshelf.sources import files

from conftest import SF_CHECK, SF_SMALL


def test_an_ingest_that_dies_leaves_the_version_before_it(spark, monkeypatch):
    root = scratch_path(spark, "store")
    assert ST.ingest(spark, SF_SMALL, root) == 1
    before = ST.open_docs(spark, root).count()
    for part in ("vocab", "postings", "blocks"):
        whole = ST.write_part

        def dies(df, path, partition_by=None, part=part, whole=whole):
            if path.endswith("/" + part):
                raise OSError("lost the store")
            whole(df, path, partition_by)

        with monkeypatch.context() as m:
            m.setattr(ST, "write_part", dies)
            with pytest.raises(OSError, match="lost"):
                ST.ingest(spark, SF_CHECK, root)
        assert ST.snapshot(spark, root).number == 1 and ST.open_docs(spark, root).count() == before
    assert ST.ingest(spark, SF_SMALL, root, Settings(vocab_size=50)) == 2
    old = ST.snapshot(spark, root, 1)
    assert ST.open_index(spark, root).vocab.count() == 50 < ST.open_index(spark, root, old).vocab.count()
    assert ST.vacuum(spark, root, keep=1) == [old.manifest["version"]]
    assert ST.open_docs(spark, root).count() == before and not files.exists(spark, old.path("docs"))
    with pytest.raises(RuntimeError, match="no published index 1"):
        ST.snapshot(spark, root, 1)


def test_a_manifest_is_created_once(spark):
    path = scratch_path(spark, "manifest") + "/00000001.json"
    assert files.create_new(spark, path, '{"a": "é"}') and not files.create_new(spark, path, "other")
    assert files.read_text(spark, path) == '{"a": "é"}' and files.names(spark, os.path.dirname(path)) == ["00000001.json"]
    root = scratch_path(spark, "conflict")
    assert ST.publish(spark, root, {"version": "a"}) == 1 and ST.publish(spark, root, {"version": "b"}, after=1) == 2
    with pytest.raises(RuntimeError, match="published after 1"):
        ST.publish(spark, root, {"version": "c"}, after=1)


def test_postings_of_a_term_are_together(spark):
    root = scratch_path(spark, "layout")
    ST.ingest(spark, SF_SMALL, root)
    placed = ST.open_index(spark, root).postings.select("term", F.input_file_name().alias("file"))
    files_of = placed.groupBy("term").agg(F.countDistinct("file").alias("n"))
    assert files_of.agg(F.avg("n")).first()[0] < 1.5


CATALOGUE = "ordinal long, track_id string, track_name string, track_artist string, playlist_genre string, playlist_subgenre string, track_popularity double"


def changes(spark, rows):
    df = spark.createDataFrame(rows, CATALOGUE + ", deleted boolean")
    return df.select("*", *[F.lit(None).cast("double").alias(c) for c in D.ROLLUP_FEATURES])


def test_change_sets_equal_a_rebuild(spark):
    root = scratch_path(spark, "live")
    state = {}
    sets = [
        [(1, "a", "red ring", "Ann", "pop", "p1", 10.0, False), (2, "b", "blue ring", "Bob", "pop", "p1", None, None), (3, "c", "red sea", "Ann", "rock", "r", 5.0, False)],
        [(2, "b", "blue sea", "Cid", "jazz", "j", 7.0, False), (4, "d", "red red", None, None, "x", 1.0, False), (9, "z", "", "", "", "", 0.0, True)],
        [(3, "c", None, None, None, None, None, True), (2, "b", None, None, None, None, None, True)],
        [(3, "c", "sea again", "Bob", "pop", "p1", 5.0, False), (8, "c", "a later row loses", "Eve", "pop", "p1", 5.0, False)],
    ]
    for step, rows in enumerate(sets):
        I.apply_changes(spark, root, changes(spark, rows))
        for r in sorted(rows, reverse=True):
            state[r[1]] = None if r[7] else r
        if step == 2:
            I.compact(spark, root)
        alive = changes(spark, [r for r in state.values() if r]).drop("deleted")
        whole = T.build_text_index(T.catalogue_corpus(alive), "doc_id", "text", "popularity")
        live = I.live_index(spark, root)
        for part, cols in (("vocab", ["term", "df", "cf", "idf"]), ("postings", ["doc_id", "term", "weight", "popularity"]), ("docs", ["doc_id", "popularity"])):
            a, b = (sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in getattr(i, part).select(*cols).collect()) for i in (live, whole))
            assert a == b, (step, part)
        cols = ["track_artist", "n_tracks", "genres", "subgenres"]
        assert {tuple(r) for r in I.live_rollup(spark, root).select(*cols).collect()} == {tuple(r) for r in D.artist_rollup(alive).select(*cols).collect()}


def test_scratch_of_a_job_is_removed(spark):
    outside = cut_lineage(spark.range(3), "outside")
    with job_scratch(spark):
        inner = cut_lineage(outside.union(outside), "inside")
        path = inner.inputFiles()[0]
        assert inner.count() == 6 and os.path.exists(path.removeprefix("file:").replace("//", "/"))
    assert not os.path.exists(os.path.dirname(path.removeprefix("file:").replace("//", "/"))) and outside.count() == 3


def prompts(spark, n):
    return spark.createDataFrame([(i, "system", f"prompt {i}") for i in range(n)], "question_id long, system_prompt string, prompt string").coalesce(1)


@pytest.mark.parametrize("kind", ["short", "long", "iterator", "none"])
def test_a_wrong_number_of_texts_gives_nobody_anothers_answer(spark, kind):
    def make():
        def generate(pairs):
            texts = [f"answer to {p}" for _, p in pairs]
            if len(pairs) > 1:
                return {"short": texts[1:], "long": [*texts, "more"], "iterator": iter(texts[1:]), "none": None}[kind]
            return [] if "prompt 3" in pairs[0][1] else texts
        return generate

    got = {r["question_id"]: r for r in G.generate_with(prompts(spark, 7), make, batch=2).collect()}
    assert len(got) == 7
    for i, r in got.items():
        if i == 3:
            assert r["raw_answer"] is None and r["error"] == "ValueError: 0 texts for 1 questions"
        else:
            assert r["raw_answer"] == f"answer to prompt {i}" and r["error"] is None


def test_an_embedder_of_another_length_is_an_error(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string").coalesce(1)
    with pytest.raises(Exception, match="4 vectors for 5 texts"):
        E.embed_with(docs, lambda: lambda texts: [[1.0]] * (len(texts) - 1)).collect()


def test_catalogue_is_the_same_through_a_job(spark):
    cat = Catalog(spark, SF_SMALL)
    assert cat.unique.count() == cat.unique.select("track_id").distinct().count()
