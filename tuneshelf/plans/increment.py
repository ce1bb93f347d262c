"""Incremental ingest: change sets instead of rebuilds.

A live catalogue is a list of segments, one for each change set, published like snapshots (one
manifest names the segments; see ``store``).  A segment holds what its change set brought:

* ``rows``    the put catalogue rows, with their document id
* ``log``     (doc_id, deleted): a document is alive in the last segment whose log has it
* ``counts``  (doc_id, term, tf, popularity) of the put documents
* ``delta``   (term, df, cf): what the change set adds to the corpus statistics, which is the
  counts of its documents less those of the versions that they replace
* ``rollup``  the artists that lost or gained a row, rolled up anew (gone if none is left)

A change set reads its own documents' earlier counts and its artists' rows, tokenises its own
texts and writes only that; statistics are the sum of the deltas, and idf, vocabulary and weights
follow from them.  ``compact`` merges the segments into one.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import documents as D
from ..operators import textindex as T
from ..operators.sizing import broadcast_if_small
from ..options import DEFAULT, Settings
from ..session import cut_lineage
from . import store as ST

PARTS = ["rows", "log", "counts", "delta", "rollup"]


def _segments(spark: SparkSession, root: str) -> tuple[int, dict]:
    if not ST.is_built(spark, root):
        return 0, {"segments": [], "n_docs": 0}
    s = ST.snapshot(spark, root)
    return s.number, s.manifest


def _read(spark: SparkSession, root: str, manifest: dict, part: str) -> DataFrame | None:
    """All segments of a part, each row with its segment's place in the list (``seq``)."""
    each = [spark.read.parquet(f"{root}/versions/{v}/{part}").withColumn("seq", F.lit(i)) for i, v in enumerate(manifest["segments"])]
    return reduce(DataFrame.unionByName, each) if each else None


def _alive(log: DataFrame) -> DataFrame:
    """(doc_id, seq): the segment that has the document's present version."""
    last = log.groupBy("doc_id").agg(F.max(F.struct("seq", "deleted")).alias("l"))
    return last.filter(~F.col("l.deleted")).select("doc_id", "l.seq")


def _corpus(rows: DataFrame, settings: Settings) -> DataFrame:
    pop = F.coalesce(R.nan_to_null(F.col("track_popularity").cast("double")), F.lit(0.0))
    return rows.select("doc_id", T.search_text(rows, settings.null_text).alias("text"), pop.alias("popularity"))


def _statistics(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select("term", F.lit(sign).cast("long").alias("df"), (F.col("tf") * sign).alias("cf"))


def apply_changes(spark: SparkSession, root: str, changes: DataFrame, settings: Settings = DEFAULT) -> int:
    """Publish a change set; returns the snapshot's number.

    ``changes`` has the columns of the catalogue and ``deleted`` (null: false): rows are put
    (added or replaced, by their track id) or deleted.  Of rows that repeat an id the first
    (smallest ordinal) counts.  Deleting what is not there changes nothing.
    """
    number, manifest = _segments(spark, root)
    at = f"{root}/versions/{(version := uuid.uuid4().hex[:16])}"
    changes = changes.withColumn("doc_id", D.track_doc_id(changes, settings.null_text)).withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    changes = cut_lineage(D.keep_first(changes, ["doc_id"], ["ordinal"]), "changes")
    put = changes.filter("not deleted").drop("deleted")
    ST.write_part(put, f"{at}/rows")
    ST.write_part(changes.select("doc_id", "deleted"), f"{at}/log")
    ST.write_part(T.term_counts(_corpus(put, settings), "doc_id", "text", keep=["popularity"]), f"{at}/counts")
    own = _statistics(spark.read.parquet(f"{at}/counts"), 1)

    artists, n_before = put.select("track_artist"), 0
    if manifest["segments"]:
        alive = _alive(_read(spark, root, manifest, "log"))
        before = cut_lineage(alive.join(broadcast_if_small(changes.select("doc_id"), settings.broadcast_max_rows), "doc_id", "left_semi"), "replaced")
        n_before = before.count()
        few = broadcast_if_small(before, settings.broadcast_max_rows)
        own = own.unionByName(_statistics(_read(spark, root, manifest, "counts").join(few, ["doc_id", "seq"], "left_semi"), -1))
        artists = artists.unionByName(_read(spark, root, manifest, "rows").join(few, ["doc_id", "seq"], "left_semi").select("track_artist"))
    delta = own.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df <> 0 or cf <> 0")
    ST.write_part(delta, f"{at}/delta")

    after = manifest | {"version": version, "segments": [*manifest["segments"], version], "n_docs": manifest["n_docs"] + put.count() - n_before}
    touched = cut_lineage(artists.filter("track_artist is not null").distinct(), "touched-artists")
    some = live_rows(spark, root, after).join(broadcast_if_small(touched, settings.broadcast_max_rows), "track_artist", "left_semi")
    rolled = touched.join(D.artist_rollup(some), "track_artist", "left")
    ST.write_part(rolled, f"{at}/rollup")
    return ST.publish(spark, root, after, after=number)


def live_rows(spark: SparkSession, root: str, manifest: dict | None = None) -> DataFrame:
    """The present catalogue rows."""
    manifest = manifest or _segments(spark, root)[1]
    alive = _alive(_read(spark, root, manifest, "log"))
    return _read(spark, root, manifest, "rows").join(alive, ["doc_id", "seq"]).drop("seq", "doc_id")


def live_rollup(spark: SparkSession, root: str) -> DataFrame:
    """The present artists: each one's last rollup, unless it has no rows any more."""
    rollup = _read(spark, root, _segments(spark, root)[1], "rollup")
    names = [c for c in rollup.columns if c != "seq"]
    last = rollup.groupBy("track_artist").agg(F.max(F.struct("seq", *names)).alias("l"))
    return last.filter(F.col("l.n_tracks").isNotNull()).select("l.*").drop("seq")


def live_index(spark: SparkSession, root: str, settings: Settings = DEFAULT) -> T.TextIndex:
    """The text index of the present documents, from the summed statistics."""
    manifest = _segments(spark, root)[1]
    n_docs = F.lit(manifest["n_docs"])
    stats = _read(spark, root, manifest, "delta").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")
    vocab = cut_lineage(T.capped_vocabulary(stats, n_docs, settings.vocab_size), "live-vocabulary")
    alive = cut_lineage(_alive(_read(spark, root, manifest, "log")), "live-documents")
    counts = _read(spark, root, manifest, "counts").join(alive, ["doc_id", "seq"]).drop("seq")
    postings = T.unit_weights(counts, vocab, "doc_id").select("doc_id", "term", "weight", "popularity")
    docs = _corpus(_read(spark, root, manifest, "rows").join(alive, ["doc_id", "seq"]), settings).select("doc_id", "popularity")
    return T.TextIndex(vocab=vocab, postings=postings, docs=docs, n_docs=n_docs, settings=settings)


def compact(spark: SparkSession, root: str) -> int:
    """Merge all segments into one; a document that is gone leaves nothing behind."""
    number, manifest = _segments(spark, root)
    at = f"{root}/versions/{(version := uuid.uuid4().hex[:16])}"
    alive = cut_lineage(_alive(_read(spark, root, manifest, "log")), "alive")
    ST.write_part(alive.select("doc_id", F.lit(False).alias("deleted")), f"{at}/log")
    for part in ("rows", "counts"):
        ST.write_part(_read(spark, root, manifest, part).join(alive, ["doc_id", "seq"]).drop("seq"), f"{at}/{part}")
    stats = _read(spark, root, manifest, "delta").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    ST.write_part(stats.filter("df > 0"), f"{at}/delta")
    ST.write_part(live_rollup(spark, root), f"{at}/rollup")
    return ST.publish(spark, root, manifest | {"version": version, "segments": [version]}, after=number)
