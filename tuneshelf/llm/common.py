"""Small helpers shared by the training-data operators (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  A text without multi-byte characters takes the fast path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (any letter case)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def maybe_broadcast(written: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint for a *written* table whose counted rows are within ``max_rows`` (the
    caller's rows have a fixed width); beyond it the planner keeps a shuffled join, and AQE
    splits its skewed keys.  Counting a Parquet table reads footers only."""
    return F.broadcast(written) if written.count() <= max_rows else written


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, max_rows: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows that ``gone`` (doc_id, text_key = xxhash64 of the text) names;
    a null id or text matches a null one.  All columns stay as they were."""
    a, b = fresh(docs, "gone_id"), fresh(docs, "gone_key")
    gone = cut_lineage(gone.select(F.col("doc_id").alias(a), F.col("text_key").alias(b)).distinct(), "gone-rows")
    same = F.col(id_col).eqNullSafe(F.col(a)) & (F.xxhash64(text_col) == F.col(b))
    return docs.join(maybe_broadcast(gone, max_rows), same, "left_anti")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by contraction: (node, component), component = smallest node.

    Each round every node hooks to its smallest neighbour (a partial aggregate), edges
    and labels are renamed to the parents, loops and repeats go.  The smallest node of a
    component never hooks away, so it names the component.  Rounds are logarithmic; every
    table is written to the shared folder, nothing is collected but one row count.
    Edges with a null end and loops are ignored; nodes without edges are not returned.
    """
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut_lineage(e.distinct(), "cc-edges")
    labels = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    labels = labels.withColumn("component", F.col("node"))
    while not e.isEmpty():
        both = e.select(F.col("b").alias("child"), F.col("a").alias("parent"))
        # a < b, so only the larger end can hook: parent = smallest neighbour below it
        parents = cut_lineage(both.groupBy("child").agg(F.min("parent").alias("parent")), "cc-parents")
        pa = parents.select(F.col("child").alias("a"), F.col("parent").alias("pa"))
        pb = parents.select(F.col("child").alias("b"), F.col("parent").alias("pb"))
        moved = (e.join(pa, "a", "left").join(pb, "b", "left")
                 .select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
                 .where(F.col("x") != F.col("y"))
                 .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        e = cut_lineage(moved.distinct(), "cc-edges")
        up = parents.select(F.col("child").alias("component"), F.col("parent"))
        labels = cut_lineage(labels.join(up, "component", "left")
                             .select("node", F.coalesce("parent", "component").alias("component")), "cc-labels")
    return labels


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, so that a task's Python worker holds few whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
