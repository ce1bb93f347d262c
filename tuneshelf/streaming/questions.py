"""Question stream: files of questions -> keyed state -> per micro-batch answer job -> Parquet.

``readStream`` over a folder of question files and one over a folder of retries; a stateful
operator keyed by question id (``transformWithState``) lets each question through once, however
often it is sent, and a retry only if it is the next one of its question.  Its state is a number.
In a stream that runs on it is forgotten ``remember_ms`` after the last row of that question (a time
to live on the state); a run over what is there keeps it, as a clock that may always expire
something would never let such a run end.
Each micro-batch then runs the batch pipeline (``answer_with``) against the index snapshot that
is current when the batch begins, so a newly published index is used from the next batch on.

A question whose answer fails is written to the retries until it had ``attempts`` of them; then
it, like an empty question, goes to the rejected sink with a reason.  Output goes to
``answers/batch_id=N`` with overwrite of that one partition, so a replayed batch rewrites
the same rows, and its retries, read a second time, are dropped by the state.  Offsets, commits
and state live in the checkpoint under the shared folder; tables that a batch writes on the way
are removed when the batch is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import retrieve as RT
from ..options import DEFAULT, Settings
from ..plans import pipeline as PL
from ..plans import store as ST
from ..session import cut_lineage, job_scratch, scratch_path
from ..sources import files
from ..sources import tables as S

QUESTION_SCHEMA = "question_id string, question string"
RETRY_SCHEMA = QUESTION_SCHEMA + ", attempt int"
ATTEMPTS = 3
REMEMBER_MS = 7 * 24 * 3600 * 1000
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class OncePerAttempt(StatefulProcessor):
    """Keeps the number of the last attempt of a question and lets only the next one through.
    Of rows of one attempt in one batch the smallest text goes on (null last)."""

    def __init__(self, remember_ms: int | None) -> None:
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_attempt", "attempt int", ttlDurationMs=self.remember_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else 0
        best: dict[int, str | None] = {}
        for pdf in rows:
            for attempt, text in zip(pdf["attempt"], pdf["question"], strict=True):
                text = None if pd.isna(text) else text
                if attempt not in best or (text is not None and (best[attempt] is None or text < best[attempt])):
                    best[attempt] = text
        if last + 1 in best:
            self.last.update((last + 1,))
            yield pd.DataFrame({"question_id": pd.Series([key[0]], dtype=object), "question": pd.Series([best[last + 1]], dtype=object),
                                "attempt": pd.Series([last + 1], dtype="int32")})

    def close(self) -> None:
        pass


def once_each(asked: DataFrame, remember_ms: int | None = None) -> DataFrame:
    """The rows of a stream (question_id, question, attempt) that are new attempts; rows
    without an id cannot be told apart and are dropped."""
    keyed = asked.filter(F.col("question_id").isNotNull()).groupBy("question_id")
    mode = "None" if remember_ms is None else "ProcessingTime"
    return keyed.transformWithStateInPandas(OncePerAttempt(remember_ms), RETRY_SCHEMA, "Append", mode)


def answer_stream(spark: SparkSession, source_dir: str, index_root: str, out_dir: str,
                  checkpoint: str, settings: Settings = DEFAULT, files_per_batch: int = 1,
                  available_now: bool = True, docs_where: Column | None = None, generator=None,
                  attempts: int = ATTEMPTS, remember_ms: int | None = REMEMBER_MS):
    """Start the stream; returns the StreamingQuery.  ``docs_where`` limits the documents
    that answers may use; ``generator`` is a factory as for ``generate_with``.  With
    ``available_now`` a run takes what is there; ``drain`` repeats it for the retries."""
    retries = f"{out_dir}/retries"
    empty = spark.createDataFrame([], RETRY_SCHEMA)
    if not files.exists(spark, retries):
        empty.write.mode("ignore").parquet(f"{retries}/batch_id=-1")

    asked = spark.readStream.schema(QUESTION_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
    asked = asked.withColumn("attempt", F.lit(1))
    again = spark.readStream.schema(RETRY_SCHEMA + ", batch_id long").parquet(retries).drop("batch_id")
    stream = once_each(asked.unionByName(again), None if available_now else remember_ms)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        with job_scratch(spark):
            batch = cut_lineage(batch, "stream-questions")
            if batch.isEmpty():  # only repeats, or a batch that moves timers on
                return
            at = ST.snapshot(spark, index_root)
            docs = ST.open_docs(spark, index_root, at)
            if docs_where is not None:
                docs = docs.filter(docs_where)
            checked = RT.validate_questions(batch)
            rejected = checked.filter(~F.col("is_valid")).select("question_id", "question", "reason")
            index = ST.open_index(spark, index_root, at, settings)
            every = PL.answer_with(index, docs, batch.drop("attempt"), settings, generator=generator)
            every = cut_lineage(every.join(batch.select("question_id", "attempt"), "question_id").withColumn("snapshot", F.lit(at.number)), "stream-batch")
            failed = every.filter(F.col("error").isNotNull())
            last = F.col("attempt") >= attempts
            again = failed.filter(~last).select("question_id", "question", (F.col("attempt") + 1).alias("attempt"))
            again.write.mode("overwrite").parquet(f"{retries}/batch_id={batch_id}")
            lost = failed.filter(last).select("question_id", "question", F.col("error").alias("reason"))
            rejected.unionByName(lost).write.mode("overwrite").parquet(f"{out_dir}/rejected/batch_id={batch_id}")
            every.filter(F.col("error").isNull()).drop("error").write.mode("overwrite").parquet(f"{out_dir}/answers/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(per_batch).outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)  # a query takes the settings of its start
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE[0])
        else:
            spark.conf.set(STATE_STORE[0], before)


def drain(spark: SparkSession, source_dir: str, index_root: str, out_dir: str, checkpoint: str,
          attempts: int = ATTEMPTS, **kw) -> None:
    """Run the stream until all questions and their retries are done: a retry is written for
    the run after its own."""
    for _ in range(attempts):
        answer_stream(spark, source_dir, index_root, out_dir, checkpoint, attempts=attempts, **kw).awaitTermination()


def run_question_stream(spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT,
                        n_files: int = 2, repeats: bool = False, generator=None, attempts: int = 1) -> str:
    """End to end on the driver tables: conversation questions are landed as files and
    streamed in micro-batches; ``repeats`` sends a third of them again in every file.
    Returns the folder of the sinks (``answers``, ``rejected``)."""
    base = scratch_path(spark, "question-stream")
    ST.ingest(spark, sf_dir, f"{base}/index", settings)
    questions = S.catalogue_questions(spark, sf_dir)
    questions.repartition(n_files, "question_id").write.mode("overwrite").parquet(f"{base}/incoming")
    if repeats:
        again = questions.filter(F.pmod(F.xxhash64("question_id"), F.lit(3)) == 0)
        again.repartition(n_files, "question").write.mode("append").parquet(f"{base}/incoming")
    drain(spark, f"{base}/incoming", f"{base}/index", f"{base}/out", f"{base}/checkpoint", attempts=attempts,
          settings=settings, docs_where=S.served(), generator=generator)
    return f"{base}/out"
