"""Catalogue rows to documents: keep-first dedup, track blurbs and metadata,
artist rollup and blurbs, and the union of both document kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import rules as R
from ..functions.template import render
from ..options import DEFAULT, Settings

ROLLUP_FEATURES = ["energy", "danceability", "valence", "tempo",
                   "acousticness", "instrumentalness", "speechiness"]
BLURB_NUMBERS = ["danceability", "tempo", "loudness", "acousticness", "instrumentalness",
                 "liveness", "speechiness", "valence", "track_popularity"]


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one that sorts first by ``order``.

    ``min(struct(order..., rest...))`` is an ordinary aggregate, so it combines
    map-side: a key holding a third of all rows never lands whole in one task
    (a ``row_number`` window would).  ``dropDuplicates`` keeps an arbitrary row.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*[F.col(c) for c in order + rest])).alias("__first")
    return (df.groupBy(*keys).agg(packed)
            .select(*keys, *[F.col(f"__first.{c}").alias(c) for c in order + rest])
            .select(*df.columns))


def dedup_tracks(catalog: DataFrame) -> DataFrame:
    """Distinct by ``track_id`` keeping the earliest row (all null ids form one group)."""
    if "track_id" not in catalog.columns:
        return catalog
    return keep_first(catalog, ["track_id"], ["ordinal"])


def _text(df: DataFrame, name: str, default: str, null_text: str) -> Column:
    """A present column prints its value (``nan`` when missing); an absent one its default."""
    return R.cell_text(name, null_text) if name in df.columns else F.lit(default)


def _cut(df: DataFrame, name: str, n: int, null_text: str) -> Column:
    return F.substring(_text(df, name, "", null_text), 1, n)


def track_doc_id(df: DataFrame, null_text: str = fixed.MISSING_CELL) -> Column:
    if "track_id" in df.columns:
        return R.cell_text("track_id", null_text)
    return F.concat(F.lit(fixed.TRACK_DOC_PREFIX), F.col("ordinal").cast("string"))


def track_blurb(df: DataFrame, null_text: str = fixed.MISSING_CELL) -> Column:
    fields = {c: _text(df, c, d, null_text) for c, d in fixed.TRACK_BLURB_DEFAULTS.items()}
    fields.update({c: R.safe_display(c) for c in BLURB_NUMBERS})
    fields["energy_desc"] = R.energy_bucket("energy")
    fields["mood"] = R.track_mood("valence")
    return render(fixed.TRACK_BLURB, **fields)


def track_documents(catalog: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Track documents: id, blurb and the flat metadata projection."""
    nt = settings.null_text
    return catalog.select(
        track_doc_id(catalog, nt).alias("doc_id"),
        F.lit("track").alias("doc_type"),
        track_blurb(catalog, nt).alias("blurb"),
        _cut(catalog, "track_name", 100, nt).alias("track_name"),
        _cut(catalog, "track_artist", 100, nt).alias("track_artist"),
        _cut(catalog, "track_album_name", 100, nt).alias("track_album_name"),
        _cut(catalog, "playlist_genre", 50, nt).alias("playlist_genre"),
        _cut(catalog, "playlist_subgenre", 50, nt).alias("playlist_subgenre"),
        *[R.meta_number(c).alias(c) for c in
          ["track_popularity", "energy", "danceability", "valence", "tempo"]],
        # carried as real values (never stored upstream, though documented)
        R.safe("loudness").alias("loudness"),
        R.safe("acousticness").alias("acousticness"),
        F.col("ordinal"),
    )


def _first_seen_list(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct non-null values per key in first-seen order, joined by ", ".

    Two steps: (key, value) -> min ordinal, then a per-key sorted list whose size
    is bounded by the number of distinct values, not by rows.
    """
    firsts = (df.filter(F.col(value).isNotNull())
              .groupBy(key, value).agg(F.min("ordinal").alias("first")))
    return (firsts.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("first", value))).alias("__l"))
            .select(key, F.array_join(F.transform("__l", lambda x: x[value]), ", ").alias(value)))


def artist_rollup(catalog: DataFrame) -> DataFrame:
    """Per artist: track count, 3-decimal feature averages, mood, genre lists."""
    base = catalog.filter(F.col("track_artist").isNotNull())
    aggs = [F.count(F.lit(1)).alias("n_tracks")]
    for c in ROLLUP_FEATURES:
        v = R.nan_to_null(F.col(c).cast("double"))
        aggs.append(F.sum(v.cast("decimal(18,6)")).alias(f"__s_{c}"))
        aggs.append(F.count(v).alias(f"__n_{c}"))
    stats = base.groupBy("track_artist").agg(*aggs)
    avgs = [R.round_half_up(F.when(F.col(f"__n_{c}") > 0,
                                   F.col(f"__s_{c}").cast("double") / F.col(f"__n_{c}")), 3)
            .alias(f"{c}_avg") for c in ROLLUP_FEATURES]
    stats = stats.select("track_artist", "n_tracks", *avgs)
    genres = _first_seen_list(base, "track_artist", "playlist_genre")
    subgenres = _first_seen_list(base, "track_artist", "playlist_subgenre")
    return (stats.join(genres, "track_artist", "left").join(subgenres, "track_artist", "left")
            .select("track_artist", "n_tracks", *[f"{c}_avg" for c in ROLLUP_FEATURES],
                    R.artist_mood("valence_avg").alias("mood"),
                    F.coalesce("playlist_genre", F.lit("")).alias("genres"),
                    F.coalesce("playlist_subgenre", F.lit("")).alias("subgenres")))


def _stat_text(c: str) -> Column:
    # all values missing: the average is NaN and prints "nan"
    return F.coalesce(R.number_text(c), F.lit("nan"))


def artist_documents(rollup: DataFrame) -> DataFrame:
    blurb = render(fixed.ARTIST_BLURB,
                   artist=F.col("track_artist"),
                   n_tracks=F.col("n_tracks").cast("string"),
                   genres=F.col("genres"), subgenres=F.col("subgenres"),
                   energy=_stat_text("energy_avg"), danceability=_stat_text("danceability_avg"),
                   valence=_stat_text("valence_avg"), mood=F.col("mood"),
                   tempo=_stat_text("tempo_avg"))
    return rollup.select(
        F.concat(F.lit(fixed.ARTIST_DOC_PREFIX), F.col("track_artist")).alias("doc_id"),
        F.lit("artist").alias("doc_type"),
        blurb.alias("blurb"),
        F.col("track_artist").alias("artist"),
    )


def all_documents(tracks: DataFrame, artists: DataFrame) -> DataFrame:
    """Track ++ artist documents with unique ids.

    Ids are whole (only displayed texts are cut), so tracks of different ids and artists
    of different names never meet; a track whose id looks like an artist's keeps it.
    """
    both = (tracks.unionByName(artists, allowMissingColumns=True)
            .withColumn("__kind", (F.col("doc_type") == "artist").cast("int")))
    return keep_first(both, ["doc_id"], ["__kind", "ordinal", "artist"]).drop("__kind")


def build_documents(catalog: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Catalogue -> dedup -> track docs ++ artist docs."""
    unique = dedup_tracks(catalog)
    return all_documents(track_documents(unique, settings), artist_documents(artist_rollup(unique)))
