"""Benchmark decontamination with a broadcast hash set of test n-grams (built-in functions only).

Words of both sides are normalised alike.  A document's windows get 64-bit hashes built by
doubling (pairs, fours, eights, then ten), so no window text is made; the hashes are probed
in a broadcast hash table of the benchmark's distinct windows inside the scan, and a hit is
verified word by word before it counts.  Only hits and one row per document are shuffled.

A benchmark with more windows than ``BLOCK_WINDOWS`` is probed block by block, each block a
broadcast of bounded size and a scan of the documents; the result is the same.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has
no windows; items that repeat an id are one item, a null id is the item ``null``; documents
that repeat an id are judged row by row; empty tables give empty or clean results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ascii_lower, without_rows

NGRAM = 10
#: Everything below 0x80 but digits and small letters separates words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_WINDOWS = 1_000_000  # windows in one broadcast, some 200 bytes each


def words_of(text: Column) -> Column:
    split = F.array_remove(F.split(ascii_lower(text), GAP), "")
    return F.coalesce(split, F.array().cast("array<string>"))


def _count(words: str, n: int) -> Column:
    return F.greatest(F.size(words) - F.lit(n - 1), F.lit(0))


def _join(a: str, b: str, shift: int, words: str, n: int) -> Column:
    """Hashes of n-word windows from those that begin at a word and those ``shift`` words on."""
    size = _count(words, n)
    return F.zip_with(F.slice(F.col(a), F.lit(1), size), F.slice(F.col(b), F.lit(shift + 1), size),
                      lambda x, y: F.xxhash64(x, y))


def window_hashes(df: DataFrame, words: str, lengths: list[int]) -> DataFrame:
    """Adds an array column ``_h<n>`` of window hashes for each length n."""
    df = df.withColumn("_p1", F.transform(words, lambda w: F.xxhash64(w)))
    power = 1
    while power * 2 <= max(lengths):
        df = df.withColumn(f"_p{power * 2}", _join(f"_p{power}", f"_p{power}", power, words, power * 2))
        power *= 2
    powers = [p for p in (8, 4, 2, 1) if p <= power]
    for n in lengths:
        have, acc = 0, None
        for p in powers:
            if have + p > n:
                continue
            if acc is None:
                acc = f"_p{p}"
            else:
                df = df.withColumn(f"_h{n}_{have + p}", _join(acc, f"_p{p}", have, words, have + p))
                acc = f"_h{n}_{have + p}"
            have += p
        df = df.withColumn(f"_h{n}", F.slice(F.col(acc), F.lit(1), _count(words, n)))
    return df


def benchmark_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = NGRAM) -> DataFrame:
    """One row per distinct window: its length, hash, words and the items that hold it."""
    items = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"),
                         words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    items = window_hashes(items, "words", list(range(1, n + 1)))
    parts = []
    for k in range(1, n + 1):
        own = F.size("words") >= n if k == n else F.size("words") == k
        rows = items.where(own).select("item", "words", F.posexplode(f"_h{k}").alias("pos", "h"))
        parts.append(rows.select("item", F.lit(k).alias("len"), "h", F.slice("words", F.col("pos") + 1, F.lit(k)).alias("w_words")))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("len", "h", "w_words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def find_hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", item_text: str = "text", n: int = NGRAM,
              block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document row: doc_id, text_key, n_words, spans (sorted first word and end), items."""
    windows = cut_lineage(benchmark_windows(bench, item_col, item_text, n), "bench-windows")
    total = windows.count()
    lengths = [r[0] for r in windows.select("len").distinct().orderBy("len").collect()] or [n]  # at most n values
    blocks = max(1, -(-total // block_windows))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                       F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    if blocks > 1:  # several scans must agree on the row numbers
        base = cut_lineage(base, "decontam-rows")
    base = base.select("row", "doc_id", "text_key", words_of(F.col("text")).alias("words"))
    base = window_hashes(base, "words", lengths)
    base = base.select("row", "doc_id", "text_key", "words", F.size("words").cast("long").alias("n_words"),
                       F.concat(*[F.col(f"_h{k}") for k in lengths]).alias("hashes"))
    # the place of a hash in the joined array less this offset is the window's first word
    offset, offsets = F.lit(0), F.lit(0)
    for k in lengths:
        offsets = F.when(F.col("len") == k, offset).otherwise(offsets)
        offset = offset + F.greatest(F.col("n_words").cast("int") - (k - 1), F.lit(0))
    found = []
    for b in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod("h", F.lit(blocks)) == b)
        probed = base.select("row", "doc_id", "text_key", "n_words", "words", F.posexplode_outer("hashes").alias("j", "h"))
        probed = probed.join(F.broadcast(part), "h", "left").withColumn("first", F.col("j") - offsets)
        real = F.col("len").isNotNull() & (F.slice(F.col("words"), F.greatest(F.col("first") + 1, F.lit(1)), F.coalesce("len", F.lit(0))) == F.col("w_words"))
        carrier = F.lit(b == 0) & (F.col("j").isNull() | (F.col("j") == 0))  # one row of every document goes on
        probed = probed.withColumn("real", F.coalesce(real, F.lit(False))).where(F.col("real") | carrier)
        found.append(probed.select("row", "doc_id", "text_key", "n_words",
                                   F.when(F.col("real"), F.struct("first", (F.col("first") + F.col("len")).alias("end"))).alias("span"),
                                   F.when(F.col("real"), F.col("items")).alias("items")))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.max("n_words").alias("n_words"),
                                    F.sort_array(F.collect_set("span")).alias("spans"),
                                    F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def covered(spans: str = "spans") -> Column:
    """Words inside the union of sorted spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate(spans, zero, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["first"], acc["to"]))).alias("n"),
        F.greatest(acc["to"], s["end"]).alias("to")))["n"].cast("long")


def contamination(docs: DataFrame, bench: DataFrame, **kw) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, and text_key (names the row)."""
    hits = find_hits(docs, bench, **kw)
    n_hit = covered()
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans", "text_key")


def remove_documents(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents without any benchmark window, all columns as they were."""
    hit = contamination(docs, bench, id_col=id_col, text_col=text_col, **kw).where("contaminated")
    return without_rows(docs, hit, id_col, text_col)


def remove_spans(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """doc_id and the text without the words inside benchmark windows, words joined by a
    space (clean texts stay as they are)."""
    hit = contamination(docs, bench, id_col=id_col, text_col=text_col, **kw).where("contaminated")
    hit = cut_lineage(hit.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "spans").distinct(), "contaminated")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_key"))
    kept = F.filter(words_of(F.col("text")), lambda w, i: ~F.exists("spans", lambda s: (i >= s["first"]) & (i < s["end"])))
    return base.join(hit, same, "left").select(
        "doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(kept, " ")).alias("text"))


_GAP_SQL = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS_SQL = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_GAP_SQL}'), lambda x: x <> '')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS_SQL} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS k
        FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, s.n, i, array_to_string(list_slice(w, i, i + s.n - 1), ' ') AS k
       FROM d, sizes s, unnest(range(1, len(w) - s.n + 2)) AS t(i)),
hit AS (SELECT doc_id, dw.i, win.n, item FROM dw JOIN win ON dw.n = win.n AND dw.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(hit.i, hit.i + hit.n)) AS t(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
