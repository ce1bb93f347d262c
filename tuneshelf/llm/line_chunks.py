"""Line dedup by content-defined chunks (built-in functions only).

A text is cut into lines: at line breaks and after sentence marks, so that a passage is
found wherever it stands in a paragraph.  A rolling hash over the hashes of two adjacent
lines chooses the chunk boundaries; they depend on content alone, so inserted or lost lines
shift nothing behind them.  Chunk hashes that occur in several documents are candidates;
the document with the smallest id keeps its chunk, and every other occurrence is compared
with it byte for byte.  Runs of adjacent repeated chunks go when they have at least
``MIN_LINES`` lines and ``MIN_CHARS`` characters, so that short stock lines stay.

That rule is the one of the SQL.  It leaves a shared line in place whose chunk is glued to a line
of its own document, and a passage of one long sentence.  With ``whole`` every line is a
chunk, so that a run reaches to the last shared line on either side, and a run also goes when
it has ``LONG_WORDS`` words or ``LONG_CHARS`` characters, whatever its lines.  Passages that
begin and end inside lines stay in either mode.

Of all chunks only 64-bit hashes and lengths are shuffled, and runs are first formed of those.
The texts move twice, joined by document: once for the bytes of the runs that would go, once for
the cut.

Defined cases: a null or empty text has no lines and stays; rows with a null id take no part
and stay; rows that repeat an id are one document, whose repeated lines stay; a text that
loses all its lines becomes empty (``drop_empty`` drops it); an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage
from .common import fresh

#: A line with its closing marks and the blanks after them; all lines joined are the text.
LINE = r"[^.!?\n]*[.!?\n]+ *|[^.!?\n]+"
BOUNDARY = "e"  # a boundary where the rolling hash's first hex digit is below: 14 of 16
MARK = "\x1e"  # two marks end a chunk while an array is split
EVERY = "g"  # above all hex digits: every line ends a chunk
MIN_LINES, MIN_CHARS = 2, 150  # of a run that goes (some 25 words)
LONG_WORDS, LONG_CHARS = 50, 400  # either alone lets a run go too; characters for scripts without blanks


def lines_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def trimmed(lines: Column | str) -> Column:
    return F.transform(lines, lambda x: F.trim(x, F.lit(" \n")))


def with_chunks(df: DataFrame, text: str = "text", boundary: str = BOUNDARY) -> DataFrame:
    """Adds arrays with one entry per chunk: ``chunk`` (its trimmed lines, joined by line breaks;
    one empty entry more at the end) and ``ends`` (the number of lines up to its end).  Every
    step is one pass over an array; no lambda looks into another array, which would be read
    again for each entry."""
    df = df.withColumn("lines", trimmed(lines_of(F.col(text))))
    df = df.withColumn("line_hash", F.transform("lines", lambda x: F.md5(x)))
    before = F.concat(F.array(F.lit("")), F.slice("line_hash", F.lit(1), F.greatest(F.size("line_hash") - 1, F.lit(0))))
    df = df.withColumn("is_end", F.zip_with(before, "line_hash", lambda a, b: F.substring(F.md5(F.concat(a, b)), 1, 1) < boundary))
    last = F.concat(F.slice("is_end", F.lit(1), F.greatest(F.size("is_end") - 1, F.lit(0))), F.array(F.lit(True)))
    df = df.withColumn("is_end", F.when(F.size("is_end") > 0, last))
    # a mark inside a line is doubled with a line break: no text has two in a row then
    marked = F.zip_with("lines", "is_end", lambda x, end: F.concat(F.replace(x, F.lit(MARK), F.lit(MARK + "\n")), F.when(end, F.lit(MARK * 2)).otherwise(F.lit("\n"))))
    ends = F.filter(F.transform("is_end", lambda end, i: F.when(end, i + 1)), lambda i: i.isNotNull())
    df = df.withColumn("chunk", F.split(F.array_join(marked, ""), MARK * 2)).withColumn("ends", ends)
    return df.drop("lines", "line_hash", "is_end")


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, whole: bool = False) -> DataFrame:
    """doc_id, text_key, chunks (last, n): the lines to remove from each text, a chunk's n lines
    up to its last one."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text <> ''")
    base = base.withColumn("text_key", F.xxhash64("text"))
    boundary = EVERY if whole else BOUNDARY

    def goes(rows: DataFrame) -> DataFrame:
        """The rows of runs of adjacent chunks that are long enough to go."""
        place = F.row_number().over(W.partitionBy("doc_id", "text_key").orderBy("k"))
        rows = rows.withColumn("run", F.col("k") - place)  # equal within a run of adjacent chunks
        run = W.partitionBy("doc_id", "text_key", "run")
        chars = F.sum("chars").over(run)
        long = (F.sum("n").over(run) >= min_lines) & (chars >= min_chars)
        if whole:
            long |= (F.sum("words").over(run) >= LONG_WORDS) | (chars >= LONG_CHARS)
        return rows.withColumn("goes", long).where("goes").drop("goes", "run")

    hashed = with_chunks(base, boundary=boundary)
    n_words = (lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))) if whole else (lambda c: F.lit(0))
    about = F.transform("chunk", lambda c: F.struct(F.xxhash64(c).alias("h"), F.length(c).alias("chars"), n_words(c).alias("words")))
    hashed = hashed.select("doc_id", "text_key", F.slice(about, F.lit(1), F.size("ends")).alias("about"), "ends")
    hashed = cut_lineage(hashed, "chunk-hashes")
    rows = hashed.select("doc_id", "text_key", F.posexplode(F.arrays_zip("about", "ends", F.concat(F.array(F.lit(0)), F.col("ends")).alias("before"))).alias("k", "c"))
    rows = rows.where("c.ends is not null").select(
        "doc_id", "text_key", "k", "c.about.h", "c.about.chars", "c.about.words", F.col("c.ends").alias("last"), (F.col("c.ends") - F.col("c.before")).alias("n"))

    repeated = rows.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    repeated = cut_lineage(repeated, "chunk-repeated")
    found = cut_lineage(rows.join(repeated, "h"), "chunk-candidates")
    # bytes are fetched only for runs that go if their hashes are right, and of those who keep their chunks
    wanted = cut_lineage(goes(found.where("doc_id > lo")).select("doc_id", "text_key", "k", "h", "lo", "last", "n"), "chunk-wanted")
    keepers = found.where("doc_id = lo").select("doc_id", "text_key", "k", "h", "lo", "last", "n").join(wanted.select("h").distinct(), "h", "left_semi")
    per_doc = wanted.unionByName(keepers).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("k", "h", "lo", "last", "n")).alias("found"))

    # the boundaries are known by now: only lines are cut again
    some = base.join(per_doc, ["doc_id", "text_key"]).withColumn("lines", trimmed(lines_of(F.col("text"))))
    some = some.select("doc_id", "text_key", "lines", F.explode("found").alias("f")).select("doc_id", "text_key", "lines", "f.*")
    texts = some.withColumn("chunk", F.array_join(F.slice("lines", F.col("last") - F.col("n") + 1, F.col("n")), "\n")).drop("lines")
    texts = cut_lineage(texts, "chunk-texts")
    kept = texts.where("doc_id = lo").select("h", F.col("chunk").alias("kept")).distinct()
    kept = cut_lineage(kept, "chunk-kept")
    same = texts.where("doc_id > lo").join(kept, "h").where("chunk = kept")
    same = same.select("doc_id", "text_key", "k", "last", "n", F.length("chunk").alias("chars"), n_words(F.col("chunk")).alias("words")).distinct()
    return goes(same).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("last", "n")).alias("chunks"))


def lost_lines(chunks: Column) -> Column:
    """For each line up to the last lost one, whether it is lost; ``chunks`` (last, n) in order."""
    before = F.concat(F.array(F.lit(0)), F.transform(chunks, lambda c: c["last"]))
    parts = F.zip_with(F.slice(before, F.lit(1), F.size(chunks)), chunks, lambda end, c: F.concat(
        F.array_repeat(F.lit(False), c["last"] - c["n"] - end), F.array_repeat(F.lit(True), c["n"])))
    return F.flatten(parts)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_empty: bool = True,
                report: str | None = None, whole: bool = False, **kw) -> DataFrame:
    """The documents with repeated chunks cut out of their texts, all columns as they were.
    ``report`` names an extra column: the number of chunks removed."""
    gone = repeated_chunks(docs, id_col, text_col, whole=whole, **kw)
    gone = cut_lineage(gone.select("doc_id", "text_key", F.size("chunks").cast("long").alias("n"), lost_lines(F.array_sort("chunks")).alias("lost")), "chunk-gone")
    names = {n: fresh(docs, f"chunk_{n}") for n in ("id", "key", "n", "lost")}
    gone = gone.select(F.col("doc_id").alias(names["id"]), F.col("text_key").alias(names["key"]), F.col("n").alias(names["n"]), F.col("lost").alias(names["lost"]))
    same = (F.col(id_col) == F.col(names["id"])) & (F.xxhash64(text_col) == F.col(names["key"]))
    # one plan at every size: the flags grow with the documents, so they are never broadcast
    out = docs.join(gone.hint("merge"), same, "left")

    cols = docs.columns
    sub = out.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(cols)], F.col(names["n"]).alias("n"), F.col(names["lost"]).alias("lost"))
    at = cols.index(text_col)
    text, hit = F.col(f"in_{at}"), F.col("n").isNotNull()
    # the lambda looks into a column that is read, not computed: one look for each line
    kept = F.filter(lines_of(F.when(hit, text)), lambda x, i: ~F.coalesce(F.get("lost", i), F.lit(False)))
    cut = F.when(hit, F.array_join(kept, "")).otherwise(text)
    if drop_empty:
        # a filter on the text would be pushed down and cut every text twice; one on an exploded row is not
        body = F.filter(F.array(F.struct(cut.alias("text"))), lambda x: ~hit | (F.trim(x["text"], F.lit(" \n")) != ""))
        sub = sub.select("*", F.explode_outer(body).alias("body")).where(F.col("body").isNotNull())
        cut = F.col("body.text")
    keep = [cut.alias(c) if i == at else F.col(f"in_{i}").alias(c) for i, c in enumerate(cols)]
    if report:
        keep.append(F.coalesce("n", F.lit(0)).cast("long").alias(report))
    return sub.select(*keep)


ORACLE = r"""
WITH u AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i, len(l) AS total
           FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+ *|[^.!?\n]+') AS l FROM documents WHERE text <> '')),
t AS (SELECT *, trim(line, ' ' || chr(10)) AS t FROM u),
r AS (SELECT *, md5(coalesce(lag(md5(t)) OVER (PARTITION BY doc_id ORDER BY i), '') || md5(t)) AS roll FROM t),
b AS (SELECT *, CASE WHEN substr(roll, 1, 1) < 'e' OR i = total THEN 1 ELSE 0 END AS cut FROM r),
k AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b),
c AS (SELECT doc_id, k, string_agg(t, chr(10) ORDER BY i) AS chunk, count(*) AS n FROM k GROUP BY doc_id, k),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY chunk) AS lo FROM c),
s AS (SELECT doc_id, k, n, length(chunk) AS chars, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM f WHERE doc_id > lo),
g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, run) AS rn, sum(chars) OVER (PARTITION BY doc_id, run) AS rc FROM s),
gone AS (SELECT doc_id, k FROM g WHERE rn >= 2 AND rc >= 150),
body AS (SELECT k.doc_id, coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE gone.k IS NULL), '') AS text
         FROM k LEFT JOIN gone ON k.doc_id = gone.doc_id AND k.k = gone.k GROUP BY k.doc_id),
cnt AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(cnt.n_removed, 0)::BIGINT AS n_removed, CASE WHEN cnt.doc_id IS NULL THEN d.text ELSE body.text END AS text
FROM documents d LEFT JOIN cnt ON d.doc_id = cnt.doc_id LEFT JOIN body ON d.doc_id = body.doc_id
"""
