"""The question stream gives exactly the batch answers."""

from tuneshelf.plans.queries import QUERIES

from conftest import SF_SMALL


def test_stream_equals_batch(spark):
    cols = ["question_id", "retrieval_mode", "n_tracks", "track_ids", "answer"]
    s = sorted(tuple(r) for r in QUERIES["stream_questions"](spark, SF_SMALL).select(*cols).collect())
    b = sorted(tuple(r) for r in QUERIES["answer_questions"](spark, SF_SMALL).select(*cols).collect())
    assert s and s == b


def test_a_retry_that_works_is_an_answer(spark, tmp_path):
    """A generator that fails for a question until a later run; repeats and odd questions."""
    from tuneshelf.plans import store as ST
    from tuneshelf.session import scratch_path
    from tuneshelf.streaming.questions import answer_stream

    clock = tmp_path / "run"

    def make():
        def generate(pairs):
            run, out = int(clock.read_text()), []
            for _, prompt in pairs:
                need = next((n for n in (1, 2, 3, 4) if f"try{n}" in prompt), 1)
                if run < need:
                    raise RuntimeError("not yet")
                out.append(f"[1] in run {run}")
            return out
        return generate

    base = scratch_path(spark, "retry-stream")
    ST.ingest(spark, SF_SMALL, f"{base}/index")
    asked = [(f"q{n}", f"top songs try{n}") for n in (1, 2, 3, 4)] + [("q1", "top songs try1"), (None, "nobody"), ("q0", "  ")]
    spark.createDataFrame(asked, "question_id string, question string").coalesce(1).write.parquet(f"{base}/in")
    for run in (1, 2, 3):
        clock.write_text(str(run))
        if run == 2:  # sent again: answered and failed ones alike
            spark.createDataFrame(asked[:4], "question_id string, question string").coalesce(1).write.mode("append").parquet(f"{base}/in")
            ST.ingest(spark, SF_SMALL, f"{base}/index")
        answer_stream(spark, f"{base}/in", f"{base}/index", f"{base}/out", f"{base}/checkpoint", attempts=3, generator=make).awaitTermination()
    got = {r["question_id"]: r for r in spark.read.parquet(f"{base}/out/answers").collect()}
    assert {k: (r["answer"].split("\n")[0], r["attempt"], r["snapshot"]) for k, r in got.items()} == {
        "q1": ("[1] in run 1", 1, 1), "q2": ("[1] in run 2", 2, 2), "q3": ("[1] in run 3", 3, 2)}
    lost = {r["question_id"]: r["reason"] for r in spark.read.parquet(f"{base}/out/rejected").collect()}
    assert lost == {"q4": "RuntimeError: not yet", "q0": "Question must not be empty."}
