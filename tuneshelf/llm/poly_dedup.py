"""Exact duplicates by composable polynomial fingerprints.

A text's fingerprint is the polynomial of its normalised bytes (A-Z lower-cased, UTF-8) at two
bases modulo 2^61 - 1.  Fingerprints of pieces combine by a shift with the length that follows:
``H(a + b) = H(a) * base^len(b) + H(b)``, so pieces may be cut anywhere and hashed anywhere.

1. A text of up to ``LARGE`` bytes is hashed in place, ``CHUNK`` bytes at a time.  A larger one
   is cut into ``SPREAD``-byte rows, which are dealt out, hashed in parallel, shifted by the
   length behind them and summed by an ordinary aggregate.  Both ways give the same number.
2. Texts with equal fingerprints and lengths are compared: only their ``PIECE``-byte pieces
   stream through an aggregate on (fingerprint, piece number, bytes).  Equal pieces collapse
   inside each task before anything is shuffled, however large a group of copies is, and no
   task holds more than pieces.  Where a place has two different pieces the fingerprints lied:
   such a group is parted by the texts' SHA-256.
3. The row with the largest id of each class of equal texts stays.

Defined cases: a null text counts as empty, and empty texts are equal; a null id is below all
others and stays only if its class has no other; rows that repeat an id and a text are all
called kept, and ``drop_copies`` leaves one of them; an empty table gives an empty result;
texts of any length are read whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import cpu_partitions
from ..session import cut_lineage
from .common import ascii_lower, fresh, maybe_broadcast

MODULUS = (1 << 61) - 1
BASES = (1_000_003_999_979_101_231, 777_767_777_999_983_117)  # any two numbers below the modulus
CHUNK = 1 << 14  # bytes that one product of a vector and a table of powers hashes
PIECE = 1 << 16  # bytes that are compared at once
LARGE, SPREAD = 1 << 23, 1 << 20  # texts above LARGE bytes are hashed in rows of SPREAD bytes
BROADCAST_GROUPS = 200_000  # rows of three to six numbers
KEY = ["h1", "h2", "n_bytes"]
_LIMB = 21  # bits: a byte times a limb, summed over a chunk, is exact in a double
_powers: dict[tuple[int, ...], np.ndarray] = {}


def _table(bases: tuple[int, ...], modulus: int) -> np.ndarray:
    """(CHUNK, 3 per base): powers from base^(CHUNK-1) down to 1, in limbs of 21 bits."""
    key = (*bases, modulus)
    if key not in _powers:
        out = np.zeros((CHUNK, 3 * len(bases)))
        for b, base in enumerate(bases):
            power = 1
            for i in range(CHUNK - 1, -1, -1):
                out[i, 3 * b: 3 * b + 3] = [power >> (_LIMB * j) & ((1 << _LIMB) - 1) for j in range(3)]
                power = power * base % modulus
        _powers[key] = out
    return _powers[key]


def polynomial(data: bytes, bases: tuple[int, ...] = BASES, modulus: int = MODULUS) -> list[int]:
    """The polynomial of the bytes at each base, combined over chunks."""
    table, values = _table(bases, modulus), [0] * len(bases)
    raw = np.frombuffer(data, np.uint8)
    for start in range(0, len(raw), CHUNK):
        part = raw[start: start + CHUNK].astype(np.float64)
        sums = part @ table[CHUNK - len(part):]
        for b, base in enumerate(bases):
            own = sum(int(s) << (_LIMB * j) for j, s in enumerate(sums[3 * b: 3 * b + 3]))
            values[b] = combine(values[b], own, len(part), base, modulus)
    return values


def combine(left: int, right: int, right_bytes: int, base: int, modulus: int = MODULUS) -> int:
    """The fingerprint of a text from those of its two parts."""
    return (left * pow(base, right_bytes, modulus) + right) % modulus


def _normal(text: bytes | None) -> bytes:
    return text.lower() if text else b""  # on bytes: A-Z only


def _print_task(bases: tuple[int, ...], modulus: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_normal(t) for t in batch.column(2).to_pylist()]
            prints = [polynomial(t, bases, modulus) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                ["doc_id", "scan_key", *KEY, "text_sha256"])
    return run


def _spread_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SPREAD bytes of each text, with the number of bytes behind each."""
    for batch in batches:
        for i, text in enumerate(batch.column(2)):
            data = _normal(text.as_py())
            digest = hashlib.sha256(data).hexdigest()
            for start in range(0, len(data), SPREAD):
                part = data[start: start + SPREAD]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[i: i + 1], batch.column(1)[i: i + 1], pa.array([digest]), pa.array([len(data)], pa.int64()),
                    pa.array([len(data) - start - len(part)], pa.int64()), pa.array([part], pa.binary())],
                    ["doc_id", "scan_key", "text_sha256", "n_bytes", "behind", "part"])


def _shifted_task(bases: tuple[int, ...], modulus: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            behind, parts = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            prints = [[h * pow(base, n, modulus) % modulus for h, base in zip(polynomial(p, bases, modulus), bases, strict=True)]
                      for p, n in zip(parts, behind, strict=True)]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(i) for i in range(5)), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64())],
                ["doc_id", "scan_key", "text_sha256", "n_bytes", "behind", "h1", "h2"])
    return run


def _piece_task(bases: tuple[int, ...], modulus: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                data = _normal(text.as_py())
                h1, h2 = polynomial(data, bases, modulus)
                for first in range(0, len(data), 64 * piece):  # a batch is some MB at most
                    parts = [data[i: i + piece] for i in range(first, min(len(data), first + 64 * piece), piece)]
                    n = len(parts)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([h1] * n, pa.int64()), pa.array([h2] * n, pa.int64()), pa.array([len(data)] * n, pa.int64()),
                        pa.array(range(first // piece, first // piece + n), pa.int64()), pa.array(parts, pa.binary())], [*KEY, "place", "piece"])
    return run


def scan_key(text: Column) -> Column:
    """A cheap key that the second scan finds candidate texts by (no more than a filter)."""
    return F.xxhash64(ascii_lower(F.coalesce(text, F.lit(""))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE,
                 bases: tuple[int, ...] = BASES, modulus: int = MODULUS) -> DataFrame:
    """doc_id, scan_key, h1, h2, n_bytes, text_sha256: one row per document row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), scan_key(F.col(text_col)).alias("scan_key"), F.col(text_col).cast("binary").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    head = f"doc_id {kind}, scan_key long"
    small = rows.where(size <= large).mapInArrow(_print_task(bases, modulus), f"{head}, h1 long, h2 long, n_bytes long, text_sha256 string")

    parts = rows.where(size > large).mapInArrow(_spread_task, f"{head}, text_sha256 string, n_bytes long, behind long, part binary")
    parts = parts.repartition(cpu_partitions(docs), "text_sha256", "behind")
    parts = parts.mapInArrow(_shifted_task(bases, modulus), f"{head}, text_sha256 string, n_bytes long, behind long, h1 long, h2 long")
    row = ["doc_id", "scan_key", "text_sha256", "n_bytes"]
    once = parts.groupBy(*row, "behind").agg(F.max("h1").alias("h1"), F.max("h2").alias("h2"), F.count("*").alias("copies"))
    wide = once.groupBy(*row).agg(*[(F.sum(F.col(h).cast("decimal(38,0)")) % F.lit(modulus)).cast("long").alias(h) for h in ("h1", "h2")],
                                  F.max("copies").alias("copies"))
    wide = wide.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return small.unionByName(wide.select(*small.columns))


def different(docs: DataFrame, keys: DataFrame, text_col: str = "text", piece: int = PIECE,
              bases: tuple[int, ...] = BASES, modulus: int = MODULUS) -> DataFrame:
    """The fingerprints whose texts are not all equal.  ``keys`` (scan_key): the texts to compare."""
    at = fresh(docs, "scan_key")
    keys = maybe_broadcast(keys.withColumnRenamed("scan_key", at), BROADCAST_GROUPS)
    texts = docs.select(F.col(text_col)).withColumn("k", scan_key(F.col(text_col))).join(keys, F.col("k") == F.col(at), "left_semi")
    pieces = texts.select(F.col(text_col).cast("binary")).mapInArrow(
        _piece_task(bases, modulus, piece), "h1 long, h2 long, n_bytes long, place long, piece binary")
    kinds = pieces.groupBy(*KEY, "place", "piece").agg(F.lit(1).alias("one")).groupBy(*KEY, "place").agg(F.count("*").alias("n"))
    return kinds.where("n > 1").select(*KEY).distinct()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE, piece: int = PIECE,
                     bases: tuple[int, ...] = BASES, modulus: int = MODULUS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document row."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col, large, bases, modulus), "poly-prints")
    shared = prints.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1 and n_bytes > 0").select(*KEY)
    shared = maybe_broadcast(cut_lineage(shared, "poly-shared"), BROADCAST_GROUPS)
    keys = cut_lineage(prints.join(shared, KEY, "left_semi").select("scan_key").distinct(), "poly-keys")
    wrong = cut_lineage(different(docs, keys, text_col, piece, bases, modulus), "poly-different")

    # where the comparison found a difference, the text's SHA-256 is part of the class
    marked = prints.join(maybe_broadcast(wrong.withColumn("lied", F.lit(True)), BROADCAST_GROUPS), KEY, "left")
    marked = marked.withColumn("part", F.when(F.col("lied"), F.col("text_sha256")).otherwise(F.lit("")))
    groups = marked.groupBy(*KEY, "part").agg(F.max("doc_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    groups = maybe_broadcast(cut_lineage(groups, "poly-groups"), BROADCAST_GROUPS)
    out = marked.join(groups, [*KEY, "part"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                      F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One document row of each class of equal texts, all columns as they were."""
    found = cut_lineage(exact_duplicates(docs, id_col, text_col, **kw), "poly-found")
    names = [fresh(docs, "poly_id"), fresh(docs, "poly_sha")]
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)

    def rows(condition: str) -> DataFrame:
        own = found.where(condition).groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"))
        return cut_lineage(own.select(F.col("doc_id").alias(names[0]), F.col("text_sha256").alias(names[1]), "n"), "poly-rows")

    def named(by: DataFrame):
        return F.col(id_col).eqNullSafe(F.col(names[0])) & (sha == F.col(names[1]))

    gone = rows("not kept").drop("n")
    out = docs.join(maybe_broadcast(gone, BROADCAST_GROUPS), named(gone), "left_anti")
    again = rows("kept and group_size > 1").where("n > 1").drop("n")
    if again.isEmpty():
        return out
    again = maybe_broadcast(again, BROADCAST_GROUPS)
    repeated = out.join(again, named(again), "left_semi").withColumn(names[1], sha)
    return out.join(again, named(again), "left_anti").unionByName(repeated.dropDuplicates([id_col, names[1]]).drop(names[1]))


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""
