"""Taste profiles x songs: additive score, reasons, explanations and top-k.

Score = [genre equal] + [mood equal] + 2 * (1 - |energy - target|).

Top-k never pairs every profile with every song.  For a fixed profile the score
of a song depends only on (genre match, mood match, energy), so within a class of songs
that match alike the best are the ones nearest in energy.  Four classes cover every song:

  A  key (genre, mood)  - songs matching both
  B  key genre          - songs matching the genre (any mood)
  C  key mood           - songs matching the mood (any genre)
  D  key ''             - every song

Each class is one list of its energies in order, with the k lowest ordinals of each (two
cursors, one down and one up from the target, read at most k steps each: behind them no
unseen song can enter).  So a profile meets at most 8 x k candidates, whatever the
catalogue size.  Energies have two decimals (the metadata value), which bounds a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import rules as R
from ..functions.template import render
from ..session import cut_lineage
from .retrieve import rank_key, top_n
from .sizing import row_count_at_most

_SEP = "\u0001"


def songs_from_catalog(catalog: DataFrame) -> DataFrame:
    """Song rows for the scorer: mood is the track mood bucket, energy the metadata value."""
    return catalog.select(
        F.col("ordinal").alias("song_id"),
        F.col("track_name").alias("title"),
        F.col("track_artist").alias("artist"),
        F.col("playlist_genre").alias("genre"),
        R.track_mood("valence").alias("mood"),
        R.meta_number("energy").alias("energy"),
        R.meta_number("tempo").alias("tempo_bpm"),
        R.meta_number("valence").alias("valence"),
        R.meta_number("danceability").alias("danceability"),
        F.coalesce(R.safe("acousticness"), F.lit(0.0)).alias("acousticness"),
    )


def _dec_avg(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(18,6)")).cast("double") / F.count(F.col(c))


def taste_profiles(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, songs: DataFrame) -> DataFrame:
    """One profile per customer from purchase history.

    favourite genre: most bought (ties: smallest name); target energy and valence:
    2-decimal averages over bought lines; mood: the track mood bucket of that valence.
    Customers with no purchases get the dict-form defaults ('' / '' / 0.5).
    """
    bought = (lineitem.select("l_orderkey", "l_partkey")
              .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
              .join(songs.select("song_id", "genre", "energy", "valence"),
                    F.col("l_partkey") == F.col("song_id"))
              .select(F.col("o_custkey").alias("profile_id"), "genre", "energy", "valence"))
    fav = (bought.filter(F.col("genre").isNotNull())
           .groupBy("profile_id", "genre").agg(F.count(F.lit(1)).alias("n"))
           .groupBy("profile_id").agg(F.min(F.struct((-F.col("n")).alias("neg_n"), "genre")).alias("b"))
           .select("profile_id", F.col("b.genre").alias("favorite_genre")))
    feats = (bought.groupBy("profile_id")
             .agg(R.round_half_up(_dec_avg("energy"), 2).alias("target_energy"),
                  R.round_half_up(_dec_avg("valence"), 2).alias("target_valence")))
    cust = customer.select(F.col("c_custkey").alias("profile_id"), (F.col("c_acctbal") > 0).alias("likes_acoustic"))
    d = fixed.PROFILE_DEFAULTS
    return (cust.join(feats, "profile_id", "left").join(fav, "profile_id", "left")
            .select("profile_id",
                    F.coalesce("favorite_genre", F.lit(d["genre"])).alias("favorite_genre"),
                    F.when(F.col("target_valence").isNull(), F.lit(d["mood"]))
                     .otherwise(R.track_mood("target_valence")).alias("favorite_mood"),
                    F.coalesce("target_energy", F.lit(d["energy"])).alias("target_energy"),
                    F.coalesce("target_valence", F.lit(d["energy"])).alias("target_valence"),
                    "likes_acoustic"))


def builtin_as_profiles(builtin: DataFrame) -> DataFrame:
    """Built-in batch profiles in scorer form (no mood given: default '')."""
    return builtin.select("profile_id", F.col("genre").alias("favorite_genre"),
                          F.lit(fixed.PROFILE_DEFAULTS["mood"]).alias("favorite_mood"),
                          F.col("energy").alias("target_energy"),
                          F.col("valence").alias("target_valence"),
                          F.lit(False).alias("likes_acoustic"))


def genre_match(genre: str | Column = "genre") -> Column:
    return F.coalesce(R.col(genre) == F.col("favorite_genre"), F.lit(False))


def mood_match(mood: str | Column = "mood") -> Column:
    return F.coalesce(R.col(mood) == F.col("favorite_mood"), F.lit(False))


def energy_part(energy: str | Column = "energy") -> Column:
    return F.lit(2.0) * (F.lit(1.0) - F.abs(R.col(energy) - F.col("target_energy")))


def score(genre: str | Column = "genre", mood: str | Column = "mood", energy: str | Column = "energy") -> Column:
    return (F.when(genre_match(genre), 1.0).otherwise(0.0) + F.when(mood_match(mood), 1.0).otherwise(0.0)
            + energy_part(energy))


def reasons() -> Column:
    """Dict-form reasons: +1.0 genre/mood texts and the doubled energy similarity."""
    energy = render(fixed.REASON_ENERGY, sim=R.fixed_decimals(energy_part(), 2),
                    song_energy=R.number_text("energy"), target_energy=R.number_text("target_energy"))
    items = F.array(
        F.when(genre_match(), render(fixed.REASON_GENRE, genre=F.col("genre"))),
        F.when(mood_match(), render(fixed.REASON_MOOD, mood=F.col("mood"))),
        energy)
    return F.filter(items, lambda x: x.isNotNull())


def explanation() -> Column:
    """Profile-form explanation (genre says +2.0, energy similarity not doubled)."""
    sim = F.lit(1.0) - F.abs(F.col("energy") - F.col("target_energy"))
    return F.concat_ws(
        "; ",
        F.when(genre_match(), render(fixed.EXPLAIN_GENRE, genre=F.col("genre"))),
        F.when(mood_match(), render(fixed.EXPLAIN_MOOD, mood=F.col("mood"))),
        render(fixed.EXPLAIN_ENERGY, sim=R.fixed_decimals(sim, 2),
               song_energy=R.number_text("energy"), target_energy=R.number_text("target_energy")))


def _set_keys(genre: Column, mood: Column) -> Column:
    return F.array(
        F.struct(F.lit("A").alias("set"), F.concat(genre, F.lit(_SEP), mood).alias("key")),
        F.struct(F.lit("B").alias("set"), genre.alias("key")),
        F.struct(F.lit("C").alias("set"), mood.alias("key")),
        F.struct(F.lit("D").alias("set"), F.lit("").alias("key")))


def representatives(songs: DataFrame, k: int) -> DataFrame:
    """k lowest-ordinal songs per (set, key, energy)."""
    keyed = (songs.select("*", F.explode(_set_keys(F.col("genre"), F.col("mood"))).alias("sk"))
             .select("*", F.col("sk.set").alias("set"), F.col("sk.key").alias("key")).drop("sk")
             .filter(F.col("key").isNotNull()))
    w = Window.partitionBy("set", "key", "energy").orderBy("song_id")
    return keyed.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def energy_lists(songs: DataFrame, k: int) -> DataFrame:
    """(set, key, steps): a class's distinct energies in order, each with its k lowest ordinals."""
    reps = representatives(songs.filter(F.col("energy").isNotNull()).select("song_id", "genre", "mood", "energy"), k)
    steps = reps.groupBy("set", "key", "energy").agg(F.array_sort(F.collect_list(F.struct("song_id", "genre", "mood"))).alias("songs"))
    return steps.groupBy("set", "key").agg(F.array_sort(F.collect_list(F.struct("energy", "songs"))).alias("steps"))


def _nearest(steps: Column, target: Column, k: int) -> Column:
    """The first k songs of a list below the target, downwards, and the first k from it upwards."""
    below = F.size(F.filter(steps, lambda s: s["energy"] < target))

    def first(part: Column) -> Column:
        return F.slice(F.flatten(F.transform(part, lambda s: F.transform(
            s["songs"], lambda x: F.struct(x["song_id"].alias("song_id"), x["genre"].alias("genre"), x["mood"].alias("mood"), s["energy"].alias("energy"))))), 1, k)

    down = F.reverse(F.slice(steps, F.greatest(below - k + 1, F.lit(1)), F.least(below, F.lit(k))))
    return F.concat(first(down), first(F.slice(steps, below + 1, F.lit(k))))


def profile_topk(profiles: DataFrame, songs: DataFrame, k: int, max_broadcast_lists: int = 2_000) -> DataFrame:
    """(profile_id, rank, song columns, score) with ties kept in catalogue order.

    The list of all songs has one key, which a keyed join would send to one task: it is one row
    of bounded size and is broadcast.  The other lists (one for each genre, mood and pair) are
    broadcast up to ``max_broadcast_lists`` of them; past that the join is keyed (AQE
    splits skewed keys).  The songs' other columns are joined to the winners only.  A song
    without energy has no score and is not listed.

    A profile meets its lists as one row and keeps an array of its k best: only winners become
    rows, and no task sorts candidates.  Profiles that repeat an id share k winners, which their
    candidates' rows decide.
    """
    lists = cut_lineage(energy_lists(songs, k), "energy-lists")
    small = row_count_at_most(lists.filter("set <> 'D'"), max_broadcast_lists)
    mine = [f"__{n}" for n in ("copies", "cands", "key", "near")]
    met = cut_lineage(profiles.select("*", F.count(F.lit(1)).over(Window.partitionBy("profile_id")).alias(mine[0])), "profiles")
    met = met.select("*", F.array().cast("array<struct<song_id:{song_id},genre:{genre},mood:{mood},energy:{energy}>>".format(**dict(songs.dtypes))).alias(mine[1]))
    for i, name in enumerate("ABCD"):
        own = lists.filter(F.col("set") == name).select(F.col("key").alias(mine[2]), "steps")
        own = F.broadcast(own) if small or name == "D" else own
        key = _set_keys(F.col("favorite_genre"), F.col("favorite_mood"))[i]["key"]
        # a constant key would be taken out of the join, and leave a cross product
        met = met.withColumn("__own", F.substring(F.coalesce("favorite_genre", F.lit("")), 1, 0) if name == "D" else key)
        met = met.join(own, F.col("__own") == F.col(mine[2]), "left").drop("__own", mine[2])
        near = F.when(F.col("steps").isNotNull(), _nearest(F.col("steps"), F.col("target_energy"), k))
        met = met.withColumn(mine[3], near).drop("steps").withColumn(mine[1], F.concat(mine[1], F.coalesce(mine[3], F.slice(mine[1], 1, 0)))).drop(mine[3])

    def placed(x: Column) -> Column:
        """A candidate with its place in the order first."""
        s = score(x["genre"], x["mood"], x["energy"])
        return F.struct((-rank_key(s)).alias("key"), x["song_id"].alias("song_id"), x["genre"].alias("genre"), x["mood"].alias("mood"), x["energy"].alias("energy"), s.alias("score"))

    columns = [*profiles.columns, "song_id", "genre", "mood", "energy", "score"]
    # a song can come through up to four sets
    one = met.filter(F.col(mine[0]) == 1).withColumn(mine[1], F.slice(F.array_sort(F.array_distinct(F.transform(mine[1], placed))), 1, k))
    # an inner explode would infer a filter on the array's size, and rank twice
    one = one.select("*", F.posexplode_outer(mine[1]).alias("rank", "song")).filter(F.col("song").isNotNull()).select("*", "song.*").select(*columns, (F.col("rank") + 1).alias("rank"))
    # repeated ids: the top 4k rows hold every distinct winner of one profile
    rows = met.filter(F.col(mine[0]) > 1).select("*", F.explode(mine[1]).alias("song")).select("*", "song.*").withColumn("score", score()).select(*columns)
    distinct = top_n(rows, "profile_id", 4 * k, tie="song_id").drop("rank").dropDuplicates(["profile_id", "song_id"])
    best = one.unionByName(top_n(distinct, "profile_id", k, tie="song_id"))
    return best.join(songs.drop("genre", "mood", "energy"), "song_id")
