"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

1. Each text gets its set of word shingles and a fast similarity sketch of ``BANDS * ROWS``
   coordinates (one pass in Arrow batches; written once).
2. Texts with equal sets are one class; only its smallest id goes on (groups of exact
   copies are one row however large they are).
3. Classes that agree in a band are candidates.  Nothing expands a bucket into all its
   pairs: each bucket compares its members with one centre; links join components; buckets
   whose members are all in one component are settled.  In the others, a member too few of
   whose shingles occur in other components to reach the threshold with any of them is
   settled too (an exact bound).  The rest get another centre, and at last the members of
   *different* components are joined on what sets them apart from the bucket's first centre:
   none of the pairs in question can link without common differences, and an exact prefix
   filter on the rarest ones finds all that can.  So no candidate link between components is
   lost, and a group of copies is not expanded into its pairs.
4. A candidate is confirmed on the full shingle sets (the sketches only drop pairs whose
   agreement is over seven standard deviations below the threshold).

A pair at the threshold misses all bands with probability (1 - s^ROWS)^BANDS, 3e-6 at 0.8.

Defined cases: a text without words has an empty set and no link; a row with a null id
takes no part and is kept, its component null; rows that repeat an id are linked by it, each
row with its own set; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import components, fresh, maybe_broadcast, small_batches

SHINGLE = 5
THRESHOLD = 80  # per cent of the union
ROWS, BANDS = 4, 24
ROUNDS = 2  # centres tried for each unsettled bucket before its components are joined on differences
AGREE = 0.5  # least share of equal coordinates of a pair that is compared in full
BROADCAST_IDS = 1_000_000  # ids of candidate texts, 8 bytes each


def _sketch_task(k: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np

        from .shingles import STEP, groups, mix64, shingle_sets, sketches

        t = rows * bands
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in groups(texts):
                elements, sizes = shingle_sets(texts[part], k)
                s = sketches(elements, sizes, t)
                keys = np.tile(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(sizes), 1))
                for r in range(rows):
                    keys = mix64(keys * STEP + s.reshape(len(sizes), bands, rows)[:, :, r])
                ends = np.cumsum(sizes)
                digest = [hashlib.blake2b(elements[e - n: e].tobytes(), digest_size=16).digest() if n else None
                          for n, e in zip(sizes, ends, strict=True)]
                has = sizes > 0
                offsets = pa.array(np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32))
                offsets_t = pa.array(np.concatenate([[0], np.cumsum(has * t)]).astype(np.int32))
                marks = (s[has] & np.uint64(0x7FFF)).astype(np.int16).ravel()
                yield pa.RecordBatch.from_arrays([
                    ids[part.start: part.stop], pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys[has].ravel().view(np.int64))),
                    pa.ListArray.from_arrays(offsets_t, pa.array(marks)),
                ], ["doc_id", "n_shingles", "set_key", "bands", "marks"])
    return run


def _sets_task(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from .shingles import groups, shingle_sets

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in groups(texts):
                elements, sizes = shingle_sets(texts[part], k)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids[part.start: part.stop], pa.ListArray.from_arrays(offsets, pa.array(elements.view(np.int64)))],
                    ["doc", "elements"])
    return run


def sketch(docs: DataFrame, k: int = SHINGLE, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, set_key, bands (one key each), marks (15 bits of each coordinate)."""
    small_batches(docs.sparkSession, 500)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _sketch_task(k, rows, bands),
        f"doc_id {id_type}, n_shingles long, set_key binary, bands array<long>, marks array<short>")


def _verify(pairs: DataFrame, marks: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.  Sizes and sketches go first."""
    for side in ("a", "b"):
        pairs = pairs.join(marks.select(F.col("doc").alias(side), F.col("n").alias(f"n_{side}"), F.col("marks").alias(f"m_{side}")), side)
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    equal = F.size(F.filter(F.zip_with("m_a", "m_b", lambda x, y: x == y), lambda e: e))
    likely = pairs.where(100 * small >= threshold * large).where(equal >= AGREE * F.size("m_a")).select("a", "b").distinct()
    likely = cut_lineage(likely, "near-likely")
    for side in ("a", "b"):
        likely = likely.join(sets.select(F.col("doc").alias(side), F.col("elements").alias(f"e_{side}")), side)
    both = F.size(F.array_intersect("e_a", "e_b"))
    total = F.size("e_a") + F.size("e_b")
    return likely.where(100 * both >= threshold * (total - both)).select("a", "b")


def _mixed(members: DataFrame) -> DataFrame:
    """The members of buckets that still hold several components."""
    bands = members.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band")
    return members.join(cut_lineage(bands, "near-mixed"), "band").select(*members.columns)


def _unsettled(members: DataFrame, labels: DataFrame, sets: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame | None]:
    """band, doc, label, n, covered of the members that may yet link to another component; and
    doc, common: their covered shingles.

    Exact: of a document's n shingles only the ``covered`` ones, which other components have
    at all, can be common with a document of another component.  Two sets of n and m shingles
    reach the threshold t only if t / (1 + t) of n + m are common, and m is at least the
    smallest size in the bucket.  A member that cannot get there is out, and with it whatever
    pairs it would have made.
    """
    labelled = members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("component", "doc"))
    left = cut_lineage(_mixed(labelled.select("band", "doc", "label")), "near-open")
    if left.isEmpty():
        return left, None
    docs = left.select("doc", "label").distinct()
    own = cut_lineage(docs.join(sets, "doc"), "near-open-sets")
    each = own.select("doc", "label", F.explode("elements").alias("e"))
    shared = each.groupBy("e").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("e")
    covered = each.join(cut_lineage(shared, "near-shared"), "e").groupBy("doc").agg(F.count("*").alias("covered"), F.collect_list("e").alias("common"))  # at most its sets
    sizes = own.groupBy("doc").agg(F.min(F.size("elements")).alias("n"))
    able = cut_lineage(covered.join(sizes, "doc").where(100 * F.col("covered") >= threshold * F.col("n")), "near-able")
    left = cut_lineage(left.join(able.drop("common"), "doc"), "near-open")
    least = cut_lineage(left.groupBy("band").agg(F.min("n").alias("least")), "near-least")
    reach = F.col("covered") * (100 + threshold) >= threshold * (F.col("n") + F.col("least"))
    return cut_lineage(_mixed(left.join(least, "band").where(reach)), "near-open"), able.select("doc", "common")


def _differences(open_members: DataFrame, covered: DataFrame, centres: DataFrame, labels: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """doc, centre: all pairs of members of open buckets that may yet link two components.

    Let c be the bucket's centre, any one of its members: the nearer it is to the others, the
    fewer rows.  Let D(x) be the elements that x has and c lacks, or the other way round.  Two sets differ in
    ``|D(x)| + |D(y)| - 2 |D(x) & D(y)|`` elements, so they reach the threshold t (per cent) only if

        ``2 (100 + t) |D(x) & D(y)| >= v(x) + v(y)``,  ``v(x) = (100 + t) |D(x)| - (100 - t) |x|``.

    If v(x) + v(y) <= 0, then x and y both link with c; members that do are returned with c (x, c).
    All other pairs need common differences.  Only elements that differ in members of several components count; those of x that no other
    component has at all (not ``covered``) never become rows.  Ordered by rarity, two
    members with k common ones meet in the first ``s - k + 1`` of their s; the least k that a
    member needs with any other is known from the smallest v of its bucket's members.  Where
    they first meet, each must have as many elements left as the two need in common.
    """
    t, two = threshold, 2 * (100 + threshold)
    group = open_members.join(centres, "band").select("centre", "doc", "label").distinct()
    own = labels.select(F.col("node").alias("centre"), F.col("component").alias("c_label"))
    group = group.join(own, "centre", "left").withColumn("outside", F.col("label") != F.coalesce("c_label", "centre"))
    group = group.join(sets, "doc").join(covered, "doc").join(sets.select(F.col("doc").alias("centre"), F.col("elements").alias("c_elements")), "centre")

    def marked(elements, new: bool):
        return F.transform(elements, lambda e: F.struct(F.lit(new).alias("new"), e.alias("e")))

    group = group.withColumn("more", F.array_except("elements", "c_elements")).withColumn("less", F.array_except("c_elements", "elements"))
    group = group.withColumn("v", (100 + t) * (F.size("more") + F.size("less")) - (100 - t) * F.size("elements"))
    group = group.withColumn("apart", F.concat(marked(F.array_intersect("more", "common"), True), marked("less", False)))
    near = (100 + t) * (F.size("more") + F.size("less")) <= (100 - t) * (F.size("elements") + F.size("c_elements"))
    group = cut_lineage(group.select("centre", "doc", "label", "outside", "v", "apart", near.alias("near")), "near-differences")
    direct = group.where("near and outside").select("doc", "centre")
    group = group.drop("near").where("doc <> centre")
    least = group.groupBy("centre").agg(F.min("v").alias("least"), F.min(F.when(F.col("outside"), F.col("v"))).alias("least_outside"))
    # a member of the centre's own component can only link with one outside it
    partner = F.when(F.col("outside"), F.col("least")).otherwise(F.col("least_outside"))
    k = F.greatest(F.ceil((F.col("v") + partner) / F.lit(two)), F.lit(1)).cast("int")
    group = group.join(cut_lineage(least, "near-least"), "centre").withColumn("k", k).where(F.col("k") <= F.size("apart"))
    group = cut_lineage(group.drop("least", "least_outside"), "near-apart")

    each = group.select("centre", "doc", "label", "outside", "v", "k", F.explode("apart").alias("d")).select("*", "d.*").drop("d")
    common = each.groupBy("centre", "new", "e").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("df")).where("lo < hi")
    common = cut_lineage(common.drop("lo", "hi"), "near-common")
    ranked = each.join(common, ["centre", "new", "e"]).groupBy("centre", "doc", "label", "outside", "v", "k").agg(
        F.array_sort(F.collect_list(F.struct("df", "new", "e"))).alias("d"))  # at most a set's elements
    ranked = ranked.withColumn("s", F.size("d")).where("k <= s")
    first = ranked.select("centre", "doc", "label", "outside", "v", "s", F.posexplode(F.slice("d", F.lit(1), F.col("s") - F.col("k") + 1)).alias("i", "d"))
    # at the first element that two members share, all their common ones are still to come
    first = first.select("centre", "doc", "label", "outside", "v", (F.col("s") - F.col("i")).alias("left"), "d.new", "d.e")
    first = cut_lineage(first, "near-first")

    other = first.select("centre", "new", "e", *[F.col(c).alias(f"{c}_m") for c in ("doc", "label", "outside", "v", "left")])
    may = (F.col("label") != F.col("label_m")) & (~F.col("outside_m") | (F.col("doc") < F.col("doc_m"))) & (
        two * F.least("left", "left_m") >= F.col("v") + F.col("v_m"))
    pairs = first.where("outside").join(other, ["centre", "new", "e"]).where(may)
    return pairs.select("doc", F.col("doc_m").alias("centre")).unionByName(direct)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                    threshold: int = THRESHOLD, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document row."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    every = cut_lineage(sketch(texts, k, rows, bands), "near-sketches")
    able = every.where("doc_id is not null and n_shingles > 0")

    # classes of equal sets; rows that repeat an id tie their classes together
    classes = cut_lineage(able.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")), "near-classes")
    many = classes.where("rep < top").select("set_key", "rep")
    first = F.col("doc_id") == F.col("rep")
    reps = able.join(classes.select(F.col("set_key").alias("c_key"), "rep"),
                     first & (F.col("set_key") == F.col("c_key")), "left_semi").dropDuplicates(["doc_id", "set_key"])
    reps = cut_lineage(reps.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "bands", "marks"), "near-reps")
    marks = reps.select("doc", "n", "marks")
    # an id with several texts ties their classes together
    texts_of = able.groupBy("doc_id").agg(F.min("set_key").alias("k_lo"), F.max("set_key").alias("k_hi")).where("k_lo < k_hi")
    ties = (able.join(texts_of.select("doc_id"), "doc_id").join(classes, "set_key")
            .where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct())

    keyed = reps.select("doc", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("band")
    shared = cut_lineage(shared, "near-buckets")
    members = cut_lineage(keyed.join(shared, "band"), "near-members")

    ids = cut_lineage(members.select("doc").distinct(), "near-candidates")
    wanted = texts.join(maybe_broadcast(ids, BROADCAST_IDS), F.col("doc_id") == F.col("doc"), "left_semi")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    sets = wanted.select("doc_id", "text").mapInArrow(_sets_task(k), f"doc {id_type}, elements array<long>")
    sets = cut_lineage(sets, "near-sets")

    spark = docs.sparkSession
    pair_schema = f"a {id_type}, b {id_type}"
    tested = spark.createDataFrame([], pair_schema)
    links = cut_lineage(ties, "near-ties")
    labels = None
    for i in range(ROUNDS + 1):
        open_members, covered = (members.withColumn("label", F.col("doc")), None) if labels is None else _unsettled(members, labels, sets, threshold)
        if i and open_members.isEmpty():
            break
        # round 0 takes the smallest id, so that most buckets of a group share their centre; then
        # comes the member with the fewest shingles of its own, which is nearest to an original; at
        # last ties go to the smallest id, as a member's differences are listed for each centre
        tie = F.xxhash64("doc", F.lit(i)) if i < ROUNDS else F.col("doc")
        rank = F.col("doc") if i == 0 else F.struct(F.col("n") - F.col("covered"), tie.alias("tie"))
        centres = open_members.groupBy("band").agg(F.min(F.struct(rank.alias("r"), "doc", "label")).alias("c"))
        centres = cut_lineage(centres.select("band", F.col("c.doc").alias("centre"), F.col("c.label").alias("own")), "near-centres")
        if i < ROUNDS:
            pairs = open_members.join(centres, "band").where("label <> own").select("doc", "centre")
        else:
            pairs = _differences(open_members, covered, centres.select("band", "centre"), labels, sets, threshold)
        pairs = pairs.select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct()
        pairs = cut_lineage(pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs")
        tested = pairs if i == 0 else cut_lineage(tested.unionByName(pairs), "near-tested")
        found = cut_lineage(_verify(pairs, marks, sets, threshold), "near-links")
        links = cut_lineage(links.unionByName(found), "near-all-links")
        labels = components(links)

    out = every.join(many.withColumnRenamed("rep", "c_rep"), "set_key", "left")
    out = out.withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("c_rep", "doc_id")))
    out = out.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = out.withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """One document of each group stays (the smallest id); all columns as they were."""
    gone = fresh(docs, "gone_id")
    found = near_duplicates(docs, id_col=id_col, **kw).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    found = cut_lineage(found, "near-gone")
    return docs.join(maybe_broadcast(found, BROADCAST_IDS), F.col(id_col) == F.col(gone), "left_anti")
