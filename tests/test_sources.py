"""CSV scans: header normalisation, NA strings, reserved rename, strict floats."""

import os
import tempfile

import pytest

from tuneshelf.functions import fixed
from tuneshelf.sources import csvscan as C


def write(text):
    d = tempfile.mkdtemp(prefix="tuneshelf-csv-")
    with open(os.path.join(d, "part.csv"), "w") as f:
        f.write(text)
    return d


def test_catalog_csv(spark):
    path = write('Track ID, Track Name ,energy,Type\n'
                 'a,"x, ""quoted""\nline",0.704,audio\n'
                 'a,dup,N/A,audio\n'
                 ',,nan,audio\n')
    df = C.read_catalog_csv(spark, path)
    assert set(["track_id", "track_name", "energy", fixed.RESERVED_COLUMN_RENAMED, "ordinal"]) <= set(df.columns)
    rows = df.orderBy("ordinal").collect()
    assert rows[0]["track_name"] == 'x, "quoted"\nline'
    assert rows[0]["energy"] == 0.704
    assert rows[1]["energy"] is None and rows[2]["energy"] is None and rows[2]["track_id"] is None


def test_strict_songs_fail_on_bad_float(spark):
    path = write("id,title,artist,genre,mood,energy,tempo_bpm,valence,danceability,acousticness\n"
                 "1,a,b,pop,happy,abc,1,1,1,1\n")
    with pytest.raises(Exception):  # FAILFAST surfaces as a Java-side SparkException
        C.read_songs_strict(spark, path).collect()


SONG_HEADER = "id,title,artist,genre,mood,energy,tempo_bpm,valence,danceability,acousticness\n"


@pytest.mark.parametrize("bad", ["abc", "", " ", "1.5d", "0x1p3"])
def test_strict_songs_fail_whichever_columns_are_read(spark, bad):
    path = write(SONG_HEADER + f"1,a,b,pop,happy,0.5,120,{bad},1,1\n")
    with pytest.raises(Exception):
        C.read_songs_strict(spark, path).select("id").collect()


def test_strict_songs_standard_quoting(spark):
    path = write(SONG_HEADER + '1,"a ""b"" c","two\nlines",pop,happy,0.5,120,0.9,0.8,0.2\n')
    r = C.read_songs_strict(spark, path).collect()
    assert len(r) == 1 and r[0]["title"] == 'a "b" c' and r[0]["artist"] == "two\nlines"


def test_rows_are_numbered_in_file_order(spark):
    d = tempfile.mkdtemp(prefix="tuneshelf-csv-")
    expected = []
    for name, n in (("part-0", 5), ("part-1", 400), ("part-2", 40)):
        with open(os.path.join(d, name + ".csv"), "w") as f:
            f.write("Track ID,energy\n" + "".join(f"{name}-{i},0.5\n" for i in range(n)))
        expected += [f"{name}-{i}" for i in range(n)]
    rows = C.read_catalog_csv(spark, d).orderBy("ordinal").collect()
    assert [r["track_id"] for r in rows] == expected and [r["ordinal"] for r in rows] == list(range(445))


def test_strict_songs_keep_text(spark):
    path = write("id,title,artist,genre,mood,energy,tempo_bpm,valence,danceability,acousticness\n"
                 "1,a,b,,happy,0.5,120,0.9,0.8,0.2\n")
    r = C.read_songs_strict(spark, path).collect()[0]
    assert r["id"] == "1" and r["genre"] == "" and r["energy"] == 0.5
