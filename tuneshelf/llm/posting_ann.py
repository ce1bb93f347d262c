"""Approximate nearest neighbours by balanced posting lists.

A bounded sample is clustered into balanced lists; a neighbour graph over the centroids sits
in every task's memory.  Every vector is written to the list of its nearest centroid, and a
boundary vector to a few more.  A query searches the graph and takes the lists whose centroid
is no farther than ``ratio`` times its nearest one (and more, until they surely hold k + 1
vectors); the ratio is fitted on the sample so that these lists hold the wanted share of true
neighbours.  Candidates are compared exactly, in
double precision.

Lists are packed into blocks of bounded size (a larger list is split), queries that meet a
block into groups of bounded size; a block keeps each query's nearest, so no pair becomes a
row.  Of equal vectors only the k + 1 smallest ids can be answers, and only those go on;
equal queries are searched once.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do those of another length than the most frequent one (the shorter if equal),
nor null ids; rows that repeat an id and vector count once, an id with several vectors is
searched and found by each; fewer than k candidates give as many; no queries give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage
from .centroid_graph import CentroidGraph, balanced_centroids, square
from .common import small_batches

SAMPLE_ROWS, SAMPLE_FLOATS = 20_000, 4_000_000  # of the vectors that the lists are fitted on
LIST_ROWS, MAX_LISTS = 64, 16_384  # wanted size of a list; lists whose centroids tasks hold
CLOSURE, REPLICAS = 1.15, 4  # a boundary vector's lists
FIT_QUERIES, FIT_SHARE = 256, 0.98  # sampled queries, and their true neighbours that lists must hold
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fit_ratio(graph: CentroidGraph, x: np.ndarray, k: int, closure: float, replicas: int,
              queries: int = FIT_QUERIES, share: float = FIT_SHARE) -> float:
    """The distance ratio within which a query's lists hold ``share`` of its true neighbours
    in the sample.  A denser table has nearer neighbours, which lie in nearer lists."""
    q = x[:: max(1, len(x) // queries)][:queries].astype(np.float64)
    held = graph.replicas(x, closure, replicas)
    need = []
    to_c = np.sqrt(square(q, graph.c.astype(np.float64)))
    first = np.maximum(to_c.min(1), 1e-12)
    for i in range(len(q)):
        d = ((x - q[i]) ** 2).sum(1)
        for j in np.argsort(d, kind="stable")[1: k + 1]:
            need.append(to_c[i, held[j]].min() / first[i])
    return float(np.quantile(need, share)) * 1.0001 if need else 1.0


def _assign_task(shared, dim: int, closure: float, replicas: int):
    def run(batches):
        graph = shared.value
        for batch in batches:
            lists = graph.replicas(_matrix(batch.column(1), dim), closure, replicas) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))],
                                             ["vec_id", "vec", "lists"])
    return run


def _probe_task(shared, dim: int, ratio: float, sizes: np.ndarray, enough: int):
    def run(batches):
        graph = shared.value
        for batch in batches:
            lists = graph.within(_matrix(batch.column(1), dim), ratio, sizes, enough) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))],
                                             ["q", "vec", "lists"])
    return run


def _compare(dim: int, keep: int, id_type: pa.DataType):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["q", "vec_id", "score"]
        if not vectors.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (id_type, id_type, pa.float64()), strict=True)})
        v = _matrix(vectors["vec"], dim).astype(np.float64)
        ids, held = vectors["vec_id"].to_numpy(), vectors["list"].to_numpy()
        order = np.argsort(held, kind="stable")
        v, ids, held = v[order], ids[order], held[order]
        starts = {int(x): (int(a), int(b)) for x, a, b in zip(*_runs(held), strict=True)}
        q, out = _matrix(queries["vec"], dim).astype(np.float64), ([], [], [])
        for i, (name, lists) in enumerate(zip(queries["q"].to_pylist(), queries["lists"].to_pylist(), strict=True)):
            rows = np.concatenate([np.arange(*starts[x]) for x in lists if x in starts] or [np.zeros(0, np.int64)])
            if not len(rows):
                continue
            diff = v[rows] - q[i]
            d = np.sqrt((diff * diff).sum(1))
            best = np.lexsort((ids[rows], d))
            best = best[: keep * REPLICAS]  # a vector may stand in several of the lists: its rows are neighbours here
            again = (ids[rows][best][1:] == ids[rows][best][:-1]) & (d[best][1:] == d[best][:-1])
            best = best[np.concatenate([[True], ~again])][:keep]
            out[0].extend([name] * len(best))
            out[1].append(ids[rows][best])
            out[2].append(d[best])
        return pa.table({"q": pa.array(out[0], id_type), "vec_id": pa.array(np.concatenate(out[1]) if out[1] else [], id_type),
                         "score": pa.array(np.concatenate(out[2]) if out[2] else [], pa.float64())})
    return run


def _runs(held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.nonzero(np.diff(held))[0] + 1])
    return held[at], at, np.concatenate([at[1:], [len(held)]])


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            share: float = FIT_SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows but itself.

    ``is_query`` is a condition on the columns ``vec_id`` and ``vec``; ids are integers.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    base = base.where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    lengths = base.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0]["dim"]
    rows = cut_lineage(base.where(F.size("vec") == dim).distinct(), "ann-rows")
    asked = cut_lineage(rows.where(is_query), "ann-queries")
    place = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    few = cut_lineage(rows.withColumn("place", place).where(F.col("place") <= k + 1), "ann-vectors")

    # fit on a bounded sample of distinct vectors
    single = few.where("place = 1")
    total = single.count()
    take = max(1, min(SAMPLE_ROWS, SAMPLE_FLOATS // dim))
    sample = single.orderBy(F.xxhash64("vec_id"), "vec_id").limit(take).select("vec").toArrow()
    x = _matrix(sample["vec"], dim).astype(np.float32)
    lists = max(1, min(MAX_LISTS, -(-total // LIST_ROWS), -(-len(x) // 8)))
    graph = CentroidGraph(balanced_centroids(x, lists))
    ratio = fit_ratio(graph, x, k, CLOSURE, REPLICAS, share=share)
    shared = spark.sparkContext.broadcast(graph)  # at most MAX_LISTS centroids

    kind = base.schema["vec"].dataType.simpleString()
    index = few.select("vec_id", "vec").mapInArrow(_assign_task(shared, dim, CLOSURE, REPLICAS), f"vec_id long, vec {kind}, lists array<long>")
    index = cut_lineage(index.select("vec_id", "vec", F.explode("lists").alias("list")), "ann-index")
    # one small row per list (at most MAX_LISTS of them) is planned with here
    held = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}
    sizes = np.array([held.get(i, 0) for i in range(len(graph))])
    reps = cut_lineage(asked.groupBy("vec").agg(F.min("vec_id").alias("q")), "ann-distinct-queries")
    # a vector stands in at most REPLICAS lists, so these hold k + 1 different ones if there are as many
    probes = reps.select("q", "vec").mapInArrow(_probe_task(shared, dim, ratio, sizes, (k + 1) * REPLICAS),
                                                f"q long, vec {kind}, lists array<long>")
    probes = cut_lineage(probes, "ann-probes")
    blocks, block, filled = [], 0, 0
    for name in sorted(held):
        n = held[name]
        if filled and filled + n > BLOCK_ROWS:
            block, filled = block + 1, 0
        cuts = -(-n // BLOCK_ROWS)
        blocks.append((name, block, cuts))
        filled += n
        if cuts > 1:  # a split list fills its blocks alone
            block, filled = block + cuts, 0
    plan = F.broadcast(spark.createDataFrame(blocks, "list long, block long, cuts long"))
    index = index.join(plan, "list").withColumn("block", F.col("block") + F.pmod(F.xxhash64("vec_id"), F.col("cuts")))
    asks = probes.select("q", "vec", F.explode("lists").alias("list")).join(plan, "list")
    asks = asks.withColumn("block", F.explode(F.expr("sequence(block, block + cuts - 1)")))
    asks = cut_lineage(asks.groupBy("q", "vec", "block").agg(F.collect_set("list").alias("lists")), "ann-asks")
    # a row per block that is asked: the planner broadcasts it as long as it is small
    shares = asks.groupBy("block").agg(F.ceil(F.count("*") / F.lit(BLOCK_QUERIES)).alias("parts"))
    shares = cut_lineage(shares, "ann-parts")
    index = index.join(shares, "block").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    asks = asks.join(shares, "block").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")))
    found = index.select("block", "part", "list", "vec_id", "vec").groupBy("block", "part").cogroup(
        asks.select("block", "part", "q", "vec", "lists").groupBy("block", "part")).applyInArrow(
        _compare(dim, k + 1, pa.int64()), "q long, vec_id long, score double")
    found = cut_lineage(found.distinct(), "ann-found")

    # a query's own row is left out only now: equal queries were searched together
    best = F.row_number().over(W.partitionBy("q").orderBy("score", "vec_id"))
    found = found.withColumn("place", best).where(F.col("place") <= k + 1).drop("place")
    found = cut_lineage(found, "ann-best")
    mine = asked.join(reps, "vec").select(F.col("vec_id").alias("query_id"), "q")
    out = mine.join(found, "q").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
