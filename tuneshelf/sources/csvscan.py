"""CSV catalogue scans.

``read_catalog_csv``: header CSV, every column read as text, header names
normalised (lower, strip, spaces to ``_``), the reserved column renamed (fixed values),
the NA strings become null, numeric features parsed with ``try_cast``.

``read_songs_strict``: the scorer's song file; every one of the five float columns must
parse in every row that is read, whichever columns are selected; other columns stay text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import rules as R
from .tables import FEATURES

SONG_FLOATS = ["energy", "tempo_bpm", "valence", "danceability", "acousticness"]
SONG_TEXT = ["id", "title", "artist", "genre", "mood"]
_FILE = "__file"


def normalise_header(name: str) -> str:
    return name.lower().strip().replace(" ", "_")


def _csv(spark: SparkSession):
    return (spark.read.option("header", True).option("multiLine", True)
            .option("escape", '"').option("inferSchema", False))


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark).csv(path)
    source = raw.select("*", F.col("_metadata.file_path").alias(_FILE))
    df = source.toDF(*[normalise_header(c) for c in raw.columns], _FILE)
    if fixed.RESERVED_COLUMN in df.columns:
        df = df.withColumnRenamed(fixed.RESERVED_COLUMN, fixed.RESERVED_COLUMN_RENAMED)
    na = F.array(*[F.lit(s) for s in fixed.NA_STRINGS])
    cleaned = [F.when(~F.array_contains(na, F.col(c)), F.col(c)).alias(c) for c in df.columns if c != _FILE]
    df = df.select(*cleaned, _FILE)
    if "ordinal" in df.columns:
        df = df.withColumn("ordinal", F.col("ordinal").try_cast("long"))
    else:
        df = _with_file_order(df, "ordinal")
    for c in FEATURES:
        if c in df.columns:
            df = df.withColumn(c, R.to_double(c))
    return df.drop(_FILE)


def _with_file_order(df: DataFrame, name: str) -> DataFrame:
    """Number the rows of many files by (file path, place in the file), from 0.

    A multi-line file is one split and its rows come in order, but splits are dealt by size:
    only the place within a file is taken from the read.  Offsets are one row per file.
    """
    df = df.withColumn("__at", F.monotonically_increasing_id())
    per_file = df.groupBy(_FILE).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(_FILE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_file.select(_FILE, before.alias("__before"))
    place = F.row_number().over(Window.partitionBy(_FILE).orderBy("__at")) - 1
    return (df.withColumn("__place", place).join(offsets, _FILE)
            .withColumn(name, F.col("__before") + F.col("__place")).drop("__at", "__place", "__before"))


def write_catalog_csv(catalog: DataFrame, path: str) -> None:
    """Write with display-style headers (``Track Name``) to exercise normalisation."""
    display = [" ".join(p.capitalize() for p in c.split("_")) for c in catalog.columns]
    catalog.toDF(*display).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_songs_csv(songs: DataFrame, path: str) -> None:
    out = songs.select(F.col("song_id").cast("string").alias("id"), "title", "artist",
                       F.coalesce("genre", F.lit("")).alias("genre"), "mood", *SONG_FLOATS)
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_songs_strict(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in SONG_TEXT + SONG_FLOATS)
    df = (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
          .option("multiLine", True).option("escape", '"')
          .option("nullValue", "\u0000").option("emptyValue", "")
          .csv(path))
    parsed = F.struct(*[R.strict_double(c).alias(c) for c in SONG_FLOATS])
    # a filter reads all five columns, so a projection of others cannot prune the check
    df = df.withColumn("__floats", parsed).filter(
        F.forall(F.array(*[F.col(f"__floats.{c}") for c in SONG_FLOATS]), lambda x: x.isNotNull()))
    # a plain csv reader yields '' for an empty text field, never a missing value
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in SONG_TEXT], *[F.col(f"__floats.{c}").alias(c) for c in SONG_FLOATS])
