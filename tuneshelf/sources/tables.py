"""Driver tables and the roles they play.

The test tables are TPC-H-like; the catalogue, text corpus, questions and
profiles are derived from them with Spark so that every job grows with the data.
The same role definitions are written as SQL in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# feature columns the catalogue may carry; absent ones are added as nulls
FEATURES = ["track_popularity", "energy", "danceability", "valence", "tempo", "loudness",
            "acousticness", "instrumentalness", "liveness", "speechiness"]
TEXT_COLUMNS = ["track_id", "track_name", "track_artist", "track_album_name",
                "track_album_release_date", "playlist_genre", "playlist_subgenre"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_columns(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Add absent optional columns as typed nulls so later expressions are total."""
    missing = [F.lit(None).cast(t).alias(c) for c, t in defaults.items() if c not in df.columns]
    return df.select("*", *missing) if missing else df


def _avg_from_decimal_sum(total: str, n: str) -> F.Column:
    # summed as decimal(18,6): the order of addition cannot move a digit
    return F.when(F.col(n) > 0, F.col(total).cast("double") / F.col(n))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows: one per part, features from its lineitems.

    lineitem is aggregated by part key first (partial + final hash aggregate), so
    only one row per part crosses the join; the join is keyed on the part key.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    lines = (table(spark, sf_dir, "lineitem")
             .groupBy("l_partkey")
             .agg(F.count(F.lit(1)).alias("n_lines"),
                  F.sum(F.col("l_discount").cast("decimal(18,6)")).alias("s_disc"),
                  F.sum(F.col("l_tax").cast("decimal(18,6)")).alias("s_tax"),
                  F.sum(F.col("l_quantity").cast("decimal(18,6)")).alias("s_qty"),
                  F.min("l_shipdate").alias("first_ship")))
    j = part.join(lines, part.p_partkey == lines.l_partkey, "left")
    key = F.col("p_partkey")
    n = F.coalesce(F.col("n_lines"), F.lit(0))
    cat = j.select(
        key.alias("ordinal"),
        F.concat(F.lit("p"), key.cast("string")).alias("track_id"),
        F.col("p_name").alias("track_name"),
        F.col("p_brand").alias("track_artist"),
        F.concat(F.col("p_type"), F.lit(" "), F.col("p_size").cast("string")).alias("track_album_name"),
        F.date_format("first_ship", "yyyy-MM-dd").alias("track_album_release_date"),
        F.when(key % 23 != 0, F.col("p_type")).alias("playlist_genre"),
        F.substring_index("p_name", " ", 1).alias("playlist_subgenre"),
        F.least(F.lit(100), n * 2).cast("double").alias("track_popularity"),
        F.when(key % 17 != 0, _avg_from_decimal_sum("s_disc", "n_lines") * 10).alias("energy"),
        (F.col("p_size") / F.lit(50.0)).alias("danceability"),
        F.when(key % 19 != 0, _avg_from_decimal_sum("s_tax", "n_lines") / F.lit(0.08)).alias("valence"),
        (_avg_from_decimal_sum("s_qty", "n_lines") * 4).alias("tempo"),
        F.when(key % 29 != 0, (key % 120) / F.lit(-8.0) - 2).alias("loudness"),
        F.when(key % 31 != 0, (key * 13 % 101) / F.lit(100.0)).alias("acousticness"),
        ((key * 7 % 101) / F.lit(100.0)).alias("instrumentalness"),
        ((key * 5 % 101) / F.lit(100.0)).alias("liveness"),
        F.when(key % 13 != 0, (key * 3 % 101) / F.lit(100.0)).alias("speechiness"),
    )
    # some items come twice; the later row must lose against the earlier one.  A row is doubled
    # after the join, so that the lines are read and aggregated once.
    names = cat.columns
    copies = F.when(F.col("ordinal") % 37 == 4, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    cat = cat.withColumn("copy", F.explode(copies)).withColumns({
        "ordinal": F.col("ordinal") + F.col("copy") * F.lit(1_000_000_000).cast("long"),
        "track_name": F.concat("track_name", F.when(F.col("copy") == 1, " again").otherwise(""))})
    return ensure_columns(cat.select(*names), {c: "double" for c in FEATURES})


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a retrieval corpus: popularity = 100 x quality label (missing 0)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (docs.join(labels, "doc_id", "left")
            .select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source",
                    (F.coalesce(F.col("quality"), F.lit(0)) * 100).cast("double").alias("popularity")))


def sample_questions(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, q) for i, q in enumerate(fixed.SAMPLE_QUESTIONS)]
    return spark.createDataFrame(rows, "question_id long, question string")


def conversation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn of ``conversations`` is a question."""
    conv = table(spark, sf_dir, "conversations")
    return (conv.filter(F.col("role") == "user")
            .select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
                    .alias("question_id"), F.col("text").alias("question")))


def catalogue_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn with the name of an item, a third of them with a routing word, and a
    few blank ones (white space that is not ASCII)."""
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n = part.select(F.count(F.lit(1))).scalar()
    conv = conv.withColumn("item", (F.col("conv_id") * 7 + F.col("turn") * 3) % n)
    text = F.concat_ws(" ", "text", "p_name", F.when(F.col("conv_id") % 3 == 0, F.lit("top")))
    return conv.join(part, F.col("item") == F.col("p_partkey"), "left").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.when(F.col("conv_id") % 29 == 3, F.lit("\u3000\u00a0 ")).otherwise(text).alias("question"))


def served() -> "F.Column":
    """Condition on the documents that lookups find: a few items have no document."""
    return F.coalesce(F.col("ordinal") % 31 != 5, F.lit(True))


def builtin_profiles(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, label, g, v, e) for i, (label, g, v, e) in enumerate(fixed.BUILTIN_PROFILES)]
    return spark.createDataFrame(rows, "profile_id long, label string, genre string, valence double, energy double")
