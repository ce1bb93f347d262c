"""Hard-negative mining by slot-decomposed selection.

An anchor's positives are its highest-scoring rows of the same label.  Each positive opens a
window of wanted negative scores, ``low`` to ``high`` per cent of its own score; the windows of
one anchor overlap.  Their upper limits, sorted downwards, cut the scores into disjoint slots:
slot j lies below limit j and above limit j + 1.  One pass over the rows keeps the best ``k``
rows of other labels in each slot; these are merged from the last slot up to the window's own
(all slots from j on lie below limit j), cut at ``k`` and at the window's lower limit.  So every
window is answered from at most ``positives x k`` rows an anchor, however the windows overlap.

Anchors are a stated set against all rows: both are cut into blocks, a cell of an anchor block
and a row block is scored with one matrix product, and a cell gives at most ``n_positives`` or
``n_positives x k`` rows an anchor, which a window with a limit inside the tasks merges.

Scores are integer inner products: in doubles where every partial sum is surely below 2^53,
else in Python's integers, exact either way.

Defined cases: rows with a null id, label or vector, or a null component, take no part; of rows
that repeat an id the one with the smallest (label, vector) counts; only vectors of one length
are scored with each other (an empty vector scores 0 with empty ones); ties go to the smaller
id; an anchor without positives, a positive without negatives give no row; an empty table
gives an empty result.  A score beyond a long is an error.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.sizing import cpu_partitions
from ..session import cut_lineage

ANCHOR_BLOCK, ROW_BLOCK = 4096, 32_768  # of a cell; scores are made for SLICE anchors at a time
SLICE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score
EXACT = 1 << 53


def finite(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def quantise(v: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as a double."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table[name].combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(table.num_rows, -1) if len(flat) else np.zeros((table.num_rows, 0), np.int64)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b, exact."""
    if a.size and b.size:
        most = max(abs(int(a.min())), abs(int(a.max()))) * max(abs(int(b.min())), abs(int(b.max()))) * a.shape[1]
        if most >= EXACT:
            return (a.astype(object) @ b.astype(object).T).astype(np.int64)
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)


def _best(scores: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """The first m places of ``at`` by score downwards, then place (rows are sorted by id)."""
    if len(at) > m:
        own = scores[at]
        at = at[own >= np.partition(own, len(own) - m)[len(own) - m]]
    return at[np.lexsort((at, -scores[at]))][:m]


def _positives_cell(m: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by("vec_id")
            ids, labels, v = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows, "vec")
            a_ids, a_labels, a = anchors["a_id"].to_numpy(), anchors["a_label"].to_numpy(), _matrix(anchors, "a_vec")
            for label in np.unique(a_labels):
                mine, same = np.nonzero(a_labels == label)[0], np.nonzero(labels == label)[0]
                for start in range(0, len(mine), SLICE):
                    part = mine[start: start + SLICE]
                    scores = _product(a[part], v[same])
                    for row, i in enumerate(part):
                        best = _best(scores[row], np.nonzero(ids[same] != a_ids[i])[0], m)
                        out[0].append(np.full(len(best), a_ids[i]))
                        out[1].append(ids[same][best])
                        out[2].append(scores[row][best])
        return pa.table({n: pa.array(np.concatenate(x) if x else [], pa.int64()) for n, x in zip(("a_id", "vec_id", "score"), out, strict=True)})
    return run


def slots_of(scores: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The slot of each score: the last of the limits (downwards) that is not below it, or -1."""
    return len(limits) - np.searchsorted(limits[::-1], scores, side="left") - 1


def _negatives_cell(k: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by("vec_id")
            ids, labels, v = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows, "vec")
            a_ids, a_labels, a = anchors["a_id"].to_numpy(), anchors["a_label"].to_numpy(), _matrix(anchors, "a_vec")
            positives = anchors["positive_scores"].to_pylist()
            for start in range(0, len(a_ids), SLICE):
                part = _product(a[start: start + SLICE], v)
                for i, scores in enumerate(part, start):
                    upper = np.array([high * p // 100 for p in positives[i]])
                    lower = np.array([-(-low * p // 100) for p in positives[i]])
                    able = np.nonzero((scores <= upper[0]) & (scores >= lower.min()) & (labels != a_labels[i]))[0]
                    slot = slots_of(scores[able], upper)
                    # slot j serves the windows up to j; window j has the lowest lower limit of them
                    fits = scores[able] >= lower[slot]
                    able, slot = able[fits], slot[fits]
                    for j in np.unique(slot):
                        best = _best(scores, able[slot == j], k)
                        out[0].append(np.full(len(best), a_ids[i]))
                        out[1].append(np.full(len(best), j))
                        out[2].append(ids[best])
                        out[3].append(scores[best])
        return pa.table({n: pa.array(np.concatenate(x) if x else [], pa.int64()) for n, x in zip(("a_id", "slot", "vec_id", "score"), out, strict=True)})
    return run


def _cells(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int):
    """Both sides keyed by (dim, anchor block, row block)."""
    a_blocks = max(1, math.ceil(n_anchors / ANCHOR_BLOCK))
    r_blocks = max(1, math.ceil(n_rows / ROW_BLOCK), min(cpu_partitions(rows), n_rows // 1024))
    key = ["dim", "a_block", "r_block"]
    left = anchors.withColumn("a_block", F.pmod(F.xxhash64("a_id"), F.lit(a_blocks))).withColumn(
        "r_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r_blocks - 1).cast("long"))))
    right = rows.withColumn("r_block", F.pmod(F.xxhash64("vec_id"), F.lit(r_blocks))).withColumn(
        "a_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a_blocks - 1).cast("long"))))
    return left.groupBy(*key).cogroup(right.groupBy(*key))


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "vec",
         n_positives: int = POSITIVES, k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vec_col`` holds integers (see ``quantise``); ``is_anchor`` is a condition on ``vec_id``,
    ``label`` and ``vec``.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                         F.col(vec_col).cast("array<long>").alias("vec"))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull()))
    own = own.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec", F.size("r.vec").alias("dim"))
    rows = cut_lineage(own, "mine-rows")
    anchors = rows.where(is_anchor).select(F.col("vec_id").alias("a_id"), F.col("label").alias("a_label"), F.col("vec").alias("a_vec"), "dim")
    n_anchors, n_rows = anchors.count(), rows.count()

    near = _cells(anchors, rows, n_anchors, n_rows).applyInArrow(_positives_cell(n_positives), "a_id long, vec_id long, score long")
    best = F.row_number().over(W.partitionBy("a_id").orderBy(F.desc("score"), "vec_id"))
    near = near.withColumn("place", best).where(F.col("place") <= n_positives)
    near = near.groupBy("a_id").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("positives"))
    asked = cut_lineage(anchors.join(near, "a_id").withColumn("positive_scores", F.transform("positives", lambda p: p["score"])), "mine-anchors")

    held = _cells(asked.drop("positives"), rows, n_anchors, n_rows).applyInArrow(
        _negatives_cell(k, low, high), "a_id long, slot long, vec_id long, score long")
    first = F.row_number().over(W.partitionBy("a_id", "slot").orderBy(F.desc("score"), "vec_id"))
    held = held.withColumn("place", first).where(F.col("place") <= k)
    # at most n_positives x k rows an anchor: score downwards, ties by id
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "score", "slot")))
    held = held.groupBy("a_id").agg(ordered.alias("held"))

    def wide(c: Column) -> Column:  # a hundred times a long may be none
        return c.cast("decimal(20,0)")

    out = asked.select("a_id", "positives").join(held, "a_id").select("a_id", "held", F.explode("positives").alias("p"))
    below = F.filter("held", lambda h: h["slot"] >= F.col("p.place") - 1)  # the slots under the window's upper limit
    below = F.filter(F.slice(below, 1, k), lambda h: wide(h["score"]) * 100 >= wide(F.col("p.score")) * low)
    out = out.select(F.col("a_id").alias("anchor_id"), F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"),
                     F.posexplode(below).alias("at", "n"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"),
                      "positive_score", F.col("n.score").alias("negative_score"))


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""
