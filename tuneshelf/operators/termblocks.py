"""Exact hybrid top-k over term blocks with score bounds.

Layout.  Documents are cut into blocks of about ``term_block`` documents by their heaviest term,
so that a term's large weights gather in few blocks.  The blocks of a frequent heaviest term are a
group, cut by popularity: more documents make its blocks finer, and a question still needs the most
popular ones only.  A row of ``rows`` has a term's postings inside one block (numbers of documents
and weights), their largest weight and the block's largest popularity; bounds read the last two
columns only.

A question's score in a block is at most ``w_cosine * sum(question weight * largest weight) +
w_popularity * largest popularity / 100``.

1. Bounds of all groups that have one of a question's terms (a row for each, not for each
   document or block).
2. Each question is scored in the best block of its best group; its k-th score so far (with the
   documents of highest popularity) is a floor that the answer cannot fall below.
3. Only groups whose bound reaches the floor are looked into, and only their blocks whose bound
   reaches it are scored as well.

For a few (question, block) cells (``bound_cells``) all are scored at once, with the same result.

A cell scores a bounded number of questions against one block with array sums and keeps each
question's k best, so no (question, document) pair becomes a row.  Blocks that nobody asks for
are not shipped, those that many ask for go to several cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..options import DEFAULT, Settings
from ..session import cut_lineage, job_scratch, scratch_path
from .sizing import broadcast_if_small, cpu_partitions, spread_by

SLACK = 1e-9  # a bound is summed in another order than a score
TIERS = 32  # steps of popularity that the blocks of a frequent term are cut at


@dataclass
class TermBlocks:
    #: block, grp, term, docs, weights, top, max_pop; a row with a null term has the block's ids and
    #: pops.  A group of one block has its number; layouts stored without groups have such ones only
    rows: DataFrame

    @property
    def tops(self) -> DataFrame:
        """block, grp, term, top, max_pop: a few bytes for each (block, term); the lists are not read."""
        grp = "grp" if "grp" in self.rows.columns else F.col("block").alias("grp")
        return self.rows.filter("term is not null").select("block", grp, "term", "top", "max_pop")


def build_blocks(postings: DataFrame, settings: Settings = DEFAULT) -> TermBlocks:
    """Block layout of (doc_id, term, weight, popularity) postings."""
    spark = postings.sparkSession
    path = scratch_path(spark, "block-rows")
    with job_scratch(spark):  # tables on the way hold all postings once more
        _block_rows(postings, settings).write.parquet(path)
    return TermBlocks(spark.read.parquet(path))


def _block_rows(postings: DataFrame, settings: Settings) -> DataFrame:
    spark = postings.sparkSession
    postings = cut_lineage(postings.select("doc_id", "term", "weight", "popularity"), "block-postings")
    docs = postings.groupBy("doc_id").agg(F.max(F.struct("weight", "term"))["term"].alias("head"), F.max("popularity").alias("popularity"))
    docs = cut_lineage(docs, "block-heads")
    # a row per vocabulary term at most is planned with here
    plan, block, filled, large = [], 0, 0, []
    for row in docs.groupBy("head").agg(F.count(F.lit(1)).alias("n")).orderBy("head").collect():
        cuts = -(-row["n"] // settings.term_block)
        if filled and filled + row["n"] > settings.term_block:
            block, filled = block + 1, 0
        plan.append((row["head"], block, cuts, row["n"]))
        filled += row["n"]
        if cuts > 1:  # a frequent head fills its blocks alone
            large.append((row["head"],))
            block, filled = block + cuts, 0
    plan = F.broadcast(spark.createDataFrame(plan, "head string, grp long, cuts long, n long"))
    docs = docs.join(plan, "head").withColumn("tier", F.lit(0))
    if large:  # its blocks follow its tiers of popularity; a tier of equal ones is cut by hash
        edges = docs.select(F.percentile_approx("popularity", [i / TIERS for i in range(1, TIERS)], 10_000).alias("e")).collect()[0]["e"]
        docs = docs.withColumn("tier", sum((F.col("popularity") >= e).cast("int") for e in sorted(set(edges))))
    # TIERS rows at most for each frequent head, of which each has more than term_block documents
    tiers = docs.join(F.broadcast(spark.createDataFrame(large, "head string")), "head", "left_semi").groupBy("head", "tier").agg(F.count(F.lit(1)).alias("own"))
    above = F.sum("own").over(Window.partitionBy("head").orderBy(F.col("tier").desc())) - F.col("own")
    tiers = tiers.select("head", "tier", "own", above.alias("above"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    cut = F.floor((F.col("above") + share * F.col("own")) * F.col("cuts") / F.col("n"))
    placed = docs.join(F.broadcast(tiers), ["head", "tier"], "left").withColumn("block", F.col("grp") + F.coalesce(F.least(cut, F.col("cuts") - 1), F.lit(0)))
    number = F.row_number().over(Window.partitionBy("block").orderBy("doc_id")) - 1  # about term_block rows each
    placed = cut_lineage(placed.select("doc_id", "popularity", "block", "grp", number.alias("at")), "block-docs")

    own = F.array_sort(F.collect_list(F.struct("at", "weight")))
    lists = postings.select("doc_id", "term", "weight").join(placed.select("doc_id", "block", "at"), "doc_id").groupBy("block", "term").agg(own.alias("p"))
    listed = F.array_sort(F.collect_list(F.struct("at", "doc_id", "popularity")))
    head = placed.groupBy("block", "grp").agg(listed.alias("p"), F.max("popularity").alias("max_pop"))
    none = {"docs": "array<int>", "weights": "array<double>", "ids": f"array<{dict(placed.dtypes)['doc_id']}>", "pops": "array<double>", "term": "string", "top": "double"}
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in none.items()}
    rows = lists.join(placed.groupBy("block", "grp").agg(F.max("popularity").alias("max_pop")), "block").select(
        "block", "grp", "term", F.col("p.at").alias("docs"), F.col("p.weight").alias("weights"), empty["ids"], empty["pops"], F.array_max("p.weight").alias("top"), "max_pop")
    head = head.select("block", "grp", empty["term"], empty["docs"], empty["weights"], F.col("p.doc_id").alias("ids"), F.col("p.popularity").alias("pops"), empty["top"], "max_pop")
    return rows.unionByName(head)


def _spans(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = table[name].combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return values, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _score_cell(k: int, w_cosine: float, w_popularity: float, q_type: pa.DataType, d_type: pa.DataType):
    names = ["qid", "doc_id", "cosine", "popularity", "score"]

    def run(asks: pa.Table, block: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        if asks.num_rows and block.num_rows:
            docs, starts = _spans(block, "docs")
            weights, _ = _spans(block, "weights")
            terms = block["term"].to_pylist()
            at = terms.index(None)
            ids, pops = block["ids"].slice(at, 1).combine_chunks().flatten(), block["pops"].slice(at, 1).combine_chunks().flatten()
            pops = pops.to_numpy(zero_copy_only=False)
            popular = w_popularity * (pops / 100.0)
            number = {t: i for i, t in enumerate(terms) if t is not None}
            wide = {}  # terms of an eighth of the documents: whole rows are added faster than listed places
            for i in number.values():
                if (starts[i + 1] - starts[i]) * 8 > len(pops):
                    wide[i] = np.zeros(len(pops))
                    wide[i][docs[starts[i]: starts[i + 1]]] = weights[starts[i]: starts[i + 1]]
            acc, part = np.zeros(len(pops)), np.zeros(len(pops))
            q_terms, q_starts = _spans(asks, "terms")
            q_weights, _ = _spans(asks, "qweights")
            # a question's terms as rows of the block (-1: the block has none of it)
            own, of = np.unique(q_terms, return_inverse=True) if len(q_terms) else (np.zeros(0, object), np.zeros(0, np.int64))
            rows = np.array([number.get(t, -1) for t in own], np.int64)[of]
            floors = asks["floor"].to_numpy().astype(np.float64)
            for i, qid in enumerate(asks["qid"].to_pylist()):
                acc[:] = 0
                for r, w in zip(rows[q_starts[i]: q_starts[i + 1]].tolist(), q_weights[q_starts[i]: q_starts[i + 1]].tolist(), strict=True):
                    if r in wide:
                        np.multiply(wide[r], w, out=part)
                        np.add(acc, part, out=acc)
                    elif r >= 0:
                        a, b = starts[r], starts[r + 1]
                        acc[docs[a:b]] += w * weights[a:b]  # a document stands once in a term's list
                if np.isnan(floors[i]):
                    hit = np.nonzero(acc)[0]
                    score = w_cosine * acc[hit] + popular[hit]
                else:
                    np.multiply(acc, w_cosine, out=part)
                    np.add(part, popular, out=part)
                    hit = np.nonzero((part >= floors[i] - SLACK) & (acc != 0))[0]
                    score = part[hit]
                key = np.floor(score * 1e10 + 0.5)
                if len(hit) > k:
                    on = key >= np.partition(key, len(key) - k)[len(key) - k]
                    hit, score, key = hit[on], score[on], key[on]
                best = np.lexsort((hit, -key))[:k]  # documents of a block are numbered by id
                if not len(best):
                    continue
                out[0].extend([qid] * len(best))
                out[1].append(ids.take(pa.array(hit[best])))
                out[2].append(acc[hit[best]])
                out[3].append(pops[hit[best]])
                out[4].append(score[best])
        columns = [pa.array(out[0], q_type), pa.concat_arrays(out[1]) if out[1] else pa.array([], d_type),
                   *(pa.array(np.concatenate(x) if x else [], pa.float64()) for x in out[2:])]
        return pa.table(columns, names=names)
    return run


def _score(asks: DataFrame, vectors: DataFrame, blocks: TermBlocks, k: int, settings: Settings, n_questions: int) -> DataFrame:
    """(qid, doc_id, cosine, popularity, score): the k best of each asked block."""
    from pyspark.sql.pandas.types import to_arrow_type

    left, right = asks.join(vectors, "qid"), blocks.rows.select("block", "term", "docs", "weights", "ids", "pops")
    # a block is copied to each of its cells: as many questions to one as documents in a block
    size = max(settings.question_part, settings.term_block)
    if n_questions <= size:  # a block's questions fit one cell
        right = right.join(asks.select("block").distinct(), "block", "left_semi").withColumn("part", F.lit(0).cast("long"))
        left = left.withColumn("part", F.lit(0).cast("long"))
    else:
        parts = cut_lineage(asks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("parts")), "block-parts")
        left = left.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")))
        right = right.join(parts, "block").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    # a cell is small in bytes and long in time: tasks are not merged by their bytes
    n = cpu_partitions(left)
    left = left.select("block", "part", "qid", "terms", "qweights", "floor").repartition(n, "block", "part")
    right = right.select("block", "part", "term", "docs", "weights", "ids", "pops").repartition(n, "block", "part")
    q_field, d_field = left.schema["qid"].dataType, right.schema["ids"].dataType.elementType
    cell = _score_cell(k, settings.w_cosine, settings.w_popularity, to_arrow_type(q_field), to_arrow_type(d_field))
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(
        cell, f"qid {q_field.simpleString()}, doc_id {d_field.simpleString()}, cosine double, popularity double, score double")


def best_of(cands: DataFrame, k: int) -> DataFrame:
    """The k best distinct documents of each qid, numbered by ``rank``."""
    one = cands.groupBy("qid", "doc_id").agg(F.max(F.struct("score", "cosine", "popularity")).alias("b"))
    one = one.select("qid", "doc_id", "b.cosine", "b.popularity", "b.score")
    order = Window.partitionBy("qid").orderBy(R.round_half_up("score", 10).desc(), "doc_id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bounded_topk(blocks: TermBlocks, qvec: DataFrame, popular: DataFrame, k: int, settings: Settings = DEFAULT,
                 stats: dict | None = None) -> DataFrame:
    """Top k of each question.  ``qvec``: qid, term, qweight; ``popular``: candidates (qid,
    doc_id, cosine, popularity, score) that hold the best documents without a common term.
    ``stats`` receives the number of (question, block) cells there are and the number scored."""
    qvec = cut_lineage(qvec, "question-terms")
    vectors = qvec.groupBy("qid").agg(F.collect_list(F.struct("term", "qweight")).alias("v"))  # at most the vocabulary
    vectors = vectors.select("qid", F.col("v.term").alias("terms"), F.col("v.qweight").alias("qweights"))
    reach = F.lit(settings.w_cosine) * F.least(F.sum(F.col("qweight") * F.col("top")), F.lit(1.0)) + F.lit(settings.w_popularity) * (F.max("max_pop") / 100.0)
    tops = blocks.tops

    def bounds_of(tops: DataFrame, at: str) -> DataFrame:
        """(qid, at, bound); a row per (question, term, at) is added up where the questions are: only the tops travel."""
        tops = broadcast_if_small(tops.select(at, "term", "top", "max_pop"), settings.broadcast_max_rows)
        return spread_by(qvec, "qid").join(tops, "term").groupBy("qid", at).agg(reach.alias("bound"))

    n_questions, n_blocks = qvec.select("qid").distinct().count(), blocks.rows.filter("term is null").count()
    if n_questions * n_blocks <= settings.bound_cells:  # a floor costs more than it saves
        every = cut_lineage(bounds_of(tops, "block").select("qid", "block", F.lit(None).cast("double").alias("floor")), "block-asks")
        return best_of(_score(every, vectors, blocks, k, settings, n_questions).unionByName(popular), k)
    single = blocks.tops.select("grp").distinct().count() == blocks.tops.select("block").distinct().count()
    groups = cut_lineage(tops.groupBy("grp", "term").agg(F.max("top").alias("top"), F.max("max_pop").alias("max_pop")), "group-tops")
    bounds = cut_lineage(bounds_of(groups, "grp"), "group-bounds")

    def inside(asked: DataFrame) -> DataFrame:
        """(qid, block, bound) of the blocks of (qid, grp, bound)."""
        if single:
            return asked.select("qid", F.col("grp").alias("block"), "bound")
        own = spread_by(asked.select("qid", "grp"), "qid").join(spread_by(qvec, "qid"), "qid")
        return own.join(broadcast_if_small(tops, settings.broadcast_max_rows), ["grp", "term"]).groupBy("qid", "block").agg(reach.alias("bound"))

    best = bounds.groupBy("qid").agg(F.max_by(F.struct("grp", "bound"), F.struct("bound", "grp")).alias("b")).select("qid", "b.grp", "b.bound")
    first = inside(best).groupBy("qid").agg(F.max_by("block", F.struct("bound", F.negative("block"))).alias("block"))
    first = cut_lineage(first, "block-first")
    asks = first.withColumn("floor", F.lit(None).cast("double"))
    seen = cut_lineage(_score(asks, vectors, blocks, k, settings, n_questions).unionByName(popular), "block-seen")
    floors = best_of(seen, k).where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
    floors = cut_lineage(first.withColumnRenamed("block", "done").join(floors, "qid", "left"), "block-floors")
    reached = F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK)
    rest = inside(bounds.join(floors, "qid").where(reached).select("qid", "grp", "bound"))
    rest = cut_lineage(rest.join(floors, "qid").where(reached & (F.col("block") != F.col("done"))).select("qid", "block", "floor"), "block-rest")
    if stats is not None:
        stats |= {"cells": bounds_of(tops, "block").count(), "scored": first.count() + rest.count()}
    return best_of(seen.unionByName(_score(rest, vectors, blocks, k, settings, n_questions)), k)
