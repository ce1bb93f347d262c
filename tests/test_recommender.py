"""The reference's two scorer tests, on DataFrames, plus the exact scores."""

from tuneshelf.operators import profiles as P

SONGS = [
    (1, "Test Pop Track", "Test Artist", "pop", "happy", 0.8, 120.0, 0.9, 0.8, 0.2),
    (2, "Chill Lofi Loop", "Test Artist", "lofi", "chill", 0.4, 80.0, 0.6, 0.5, 0.9),
]
SONG_SCHEMA = ("song_id long, title string, artist string, genre string, mood string, energy double, "
               "tempo_bpm double, valence double, danceability double, acousticness double")
PROFILE_SCHEMA = ("profile_id long, favorite_genre string, favorite_mood string, target_energy double, "
                  "likes_acoustic boolean")


def frames(spark):
    songs = spark.createDataFrame(SONGS, SONG_SCHEMA)
    prof = spark.createDataFrame([(1, "pop", "happy", 0.8, False)], PROFILE_SCHEMA)
    return prof, songs


def test_recommend_returns_songs_sorted_by_score(spark):
    prof, songs = frames(spark)
    top = P.profile_topk(prof, songs, 2).orderBy("rank").collect()
    assert len(top) == 2
    assert top[0]["genre"] == "pop" and top[0]["mood"] == "happy"
    assert abs(top[0]["score"] - 4.0) < 1e-12
    assert abs(top[1]["score"] - 1.2) < 1e-9


def pair(spark, song_index):
    """One (profile, song) row, built directly (the scorer columns side by side)."""
    s = SONGS[song_index]
    return spark.createDataFrame([("pop", "happy", 0.8, s[3], s[4], s[5])],
                                 "favorite_genre string, favorite_mood string, target_energy double, "
                                 "genre string, mood string, energy double")


def test_explain_recommendation_returns_non_empty_string(spark):
    row = pair(spark, 0).select(P.explanation().alias("e")).collect()[0]
    assert row["e"].strip() != ""
    assert row["e"] == ("genre match (pop, +2.0); mood match (happy, +1.0); "
                        "energy similarity 1.00 (song=0.8, target=0.8)")


def test_reasons_use_doubled_energy(spark):
    row = pair(spark, 1).select(P.reasons().alias("r")).collect()[0]
    assert row["r"] == ["energy similarity 1.20 (song=0.4, target=0.8)"]


def test_topk_ties_keep_catalogue_order(spark):
    songs = spark.createDataFrame([(i, "t", "a", "pop", "happy", 0.5, 1.0, 1.0, 1.0, 0.0) for i in range(10, 0, -1)],
                                  SONG_SCHEMA)
    prof = spark.createDataFrame([(1, "pop", "happy", 0.5, False)], PROFILE_SCHEMA)
    top = P.profile_topk(prof, songs, 3).orderBy("rank").collect()
    assert [r["song_id"] for r in top] == [1, 2, 3]
