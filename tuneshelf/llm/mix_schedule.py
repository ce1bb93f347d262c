"""Low-discrepancy source schedule: mix sources to target weights (built-in functions only).

Slot i of the schedule gets the point frac(i / golden ratio), computed exactly as a 31-bit
integer.  The point falls into one source's share of the unit interval; the k-th slot of a
source takes the k-th equal-token block of that source's shuffled word stream, and the next
pass begins when a stream ends.  A source keeps its first slots up to its target, the last
block is cut at the target, and the few slots that the point set leaves it short of (its
discrepancy, logarithmic in the slots) follow at the end.  Every rank and running total is
computed in two levels (per range, then within it), so a source with most rows is spread.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its
own, last in order; a null id is an id like others; rows that repeat take their own place in
the stream; an empty table gives an empty mix.  Other columns of the input are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)  # by the source's place in code-point order, repeating
SHARE = 1.5  # words of the mix for each word of the input
MAX_PASSES = 2  # no source is taken more often
BLOCK = 1024  # words of a block
GOLDEN = 1327217885  # 2^31 / golden ratio, odd: a full period
PERIOD = 1 << 31
CELL = 1 << 19  # the unit interval in 4,096 cells, for an equi-join of points with shares
RANGE = 1 << 16  # slots ranked together
SALT_HEX = 3  # documents of a source are ordered within 4,096 parts of it


class Mix(NamedTuple):
    sources: DataFrame  # source, sid, weight, source_size, target, words, blocks, slots
    schedule: DataFrame  # slot, sid, nth, block, pass, w_from, w_to
    taken: DataFrame  # doc_id, size, source_size, target, taken


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size and the key that shuffles a source's documents."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES,
                   block: int = BLOCK) -> DataFrame:
    """One row per source.  Water-filling in closed form: with sources ordered by
    limit / weight, a source is cut at its limit exactly when what the earlier ones leave,
    shared by weight among it and the later ones, reaches that limit."""
    # from here on one row per source; the windows below order these rows, not documents
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_passes))
    order = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(
        F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("level", left / rest).withColumn("cut", F.col("level") >= F.col("cap") / F.col("weight"))
    # the level at the first source that is not cut holds for all of those
    first = F.min(F.when(~F.col("cut"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "sid", "level"))).over(whole)
    per = per.withColumn("target", F.when(F.col("cut"), F.col("cap")).otherwise(first["level"] * F.col("weight")))
    words = F.floor(F.col("target")).cast("long")
    z, n = F.col("source_size"), F.col("blocks")
    per = per.withColumn("words", words).withColumn("blocks", F.ceil(z / F.lit(block)).cast("long"))
    passes = F.when(z > 0, F.floor(F.col("words") / z)).otherwise(0).cast("long")
    slots = passes * n + F.ceil((F.col("words") - passes * z) / F.lit(block)).cast("long")
    return per.select("source", "sid", "weight", "source_size", "target", "words", "blocks", slots.alias("slots"))


def slot_schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots in order with the block each one takes."""
    spark = sources.sparkSession
    total = int(sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0])
    before = F.coalesce(F.sum("slots").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    scale = F.lit(float(PERIOD) / max(total, 1))
    shares = sources.select("sid", "slots", "words", "blocks", "source_size",
                            F.floor(before * scale).alias("lo"), F.floor((before + F.col("slots")) * scale).alias("hi"))
    shares = cut_lineage(shares, "mix-shares")
    cells = cut_lineage(shares.where("hi > lo").select(
        "sid", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {CELL}"), F.expr(f"(hi - 1) div {CELL}"))).alias("cell")), "mix-cells")
    point = F.expr(f"((id % {PERIOD}L) * {GOLDEN}L) % {PERIOD}L")
    slots = spark.range(total).select(F.col("id").alias("slot"), point.alias("point"))
    slots = slots.withColumn("cell", F.expr(f"point div {CELL}")).join(cells, "cell")
    slots = slots.where("point >= lo and point < hi").select("sid", "slot", F.expr(f"slot div {RANGE}").alias("part"))
    slots = cut_lineage(slots, "mix-slots")
    counts = slots.groupBy("sid", "part").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = cut_lineage(counts.select("sid", "part", "n", base.alias("base")), "mix-parts")
    nth = F.col("base") + F.row_number().over(W.partitionBy("sid", "part").orderBy("slot")) - 1
    ranked = slots.join(counts.drop("n"), ["sid", "part"]).select("sid", "slot", nth.alias("nth"))
    have = counts.groupBy("sid").agg(F.sum("n").alias("have"))
    closing = (shares.join(have, "sid", "left").withColumn("have", F.coalesce("have", F.lit(0)))
               .where("slots > have").select("sid", F.explode(F.expr("sequence(have, slots - 1)")).alias("nth"))
               .select("sid", (F.lit(total) + F.col("nth")).alias("slot"), "nth"))
    every = ranked.unionByName(closing).join(shares.select("sid", "slots", "words", "blocks", "source_size"), "sid")
    every = every.where("nth < slots").withColumn("block", F.expr("nth % blocks")).withColumn("pass", F.expr("nth div blocks"))
    return every.select("slot", "sid", "nth", "block", "pass", (F.col("block") * block).alias("w_from"),
                        F.least((F.col("block") + 1) * block, "source_size",
                                F.col("words") - F.col("pass") * F.col("source_size")).alias("w_to"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES, block: int = BLOCK) -> Mix:
    """Mix all documents: targets per source, the slot schedule, and the words taken per document."""
    sizes = cut_lineage(word_sizes(docs, id_col, text_col, source_col), "mix-sizes")
    sources = cut_lineage(source_targets(sizes, weights, share, max_passes, block), "mix-sources")
    schedule = cut_lineage(slot_schedule(sources, block), "mix-schedule")

    sizes = sizes.withColumn("salt", F.substring("key", 1, SALT_HEX))
    parts = sizes.groupBy("source", "salt").agg(F.sum("size").alias("n"))
    base = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("source").alias("p_source"), F.col("salt").alias("p_salt"), base.alias("base"))
    parts = cut_lineage(parts.join(sources, F.col("p_source").eqNullSafe(sources["source"])).select(
        "p_source", "p_salt", "base", "sid", "source_size", "target"), "mix-parts")
    within = W.partitionBy("source", "salt").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    at = F.coalesce(F.sum("size").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.withColumn("at", at).join(
        parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("salt") == F.col("p_salt")))
    placed = placed.select("doc_id", "sid", "size", "source_size", "target", (F.col("base") + F.col("at")).alias("at"))
    placed = cut_lineage(placed, "mix-placed")

    # (sid, at) names a row of size > 0; its words fall into one or more blocks of the stream
    pieces = placed.where("size > 0").select(
        "doc_id", "sid", "size", "source_size", "target", "at",
        F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
    joined = pieces.join(schedule.select("sid", "block", "w_from", "w_to"), ["sid", "block"], "left")
    overlap = F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), F.col("w_to")) - F.greatest("at", "w_from"))
    taken = joined.groupBy("sid", "at", "doc_id", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.when(F.col("w_to").isNotNull(), overlap)), F.lit(0)).cast("long").alias("taken"))
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return Mix(sources, schedule, taken.select(*cols).unionByName(none.select(*cols)))


#: The same mix in closed form: passes x size plus what the last, partial pass covers.
TAKEN_SQL = r"""
sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM {docs}),
per AS (
  SELECT source, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM sizes GROUP BY source),
caps AS (
  SELECT source, sid, z, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((sid - 1) % 3 + 1)::INT] AS w, z * 2.0::DOUBLE AS cap FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(z) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM caps),
targets AS (
  SELECT source, z, CASE WHEN lvl >= cap / w THEN cap
                         ELSE w * first_value(lvl) OVER (ORDER BY lvl >= cap / w, cap / w, sid) END AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.z, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id NULLS LAST, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, z AS source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE
         (floor(target)::BIGINT // z) * size
         + greatest(0, least(a + size, floor(target)::BIGINT - (floor(target)::BIGINT // z) * z) - a) END)::BIGINT AS taken
FROM placed
"""

ORACLE = "WITH " + TAKEN_SQL.format(docs="documents")
