"""Size checks before broadcasting a data-dependent side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, StructType, TimestampType

from ..options import DEFAULT

ROW_BYTES = 40  # of a row without its columns: null bits, its length, its place in the hash table


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than max_rows + 1."""
    return df.limit(max_rows + 1).count() <= max_rows


def row_bytes(schema: StructType) -> int:
    """Bytes that a row takes in a broadcast table: eight a column, its entry of the hash table,
    and twenty for the content of each string or list."""
    return ROW_BYTES + sum(8 if isinstance(f.dataType, (NumericType, BooleanType, DateType, TimestampType)) else 28 for f in schema)


def most_rows(df: DataFrame, max_rows: int, max_bytes: int = DEFAULT.broadcast_max_bytes) -> int:
    """The rows of ``df`` that may be broadcast: the driver holds them several times over while it
    builds the table, so not the rows alone are bounded but their bytes too."""
    return min(max_rows, max_bytes // row_bytes(df.schema))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only behind a checked bound of rows and bytes; otherwise leave the join to
    the planner (sort-merge with AQE skew splitting)."""
    most = most_rows(df, max_rows)
    strings = [F.octet_length(f.name) for f in df.schema if isinstance(f.dataType, StringType)]
    size = F.sum(sum((F.coalesce(s, F.lit(0)) for s in strings), F.lit(0)).cast("long"))
    rows, chars = df.limit(most + 1).agg(F.count(F.lit(1)), size).collect()[0]
    held = rows * (row_bytes(df.schema) - 20 * len(strings)) + (chars or 0)
    return F.broadcast(df) if rows <= most and held <= DEFAULT.broadcast_max_bytes else df


def broadcast_if_bounded(df: DataFrame, bound_rows: int, max_rows: int) -> DataFrame:
    """Broadcast when a proven upper bound on ``df``'s rows (computed from cheap inputs, e.g.
    questions x k) is within ``max_rows`` and the bytes of so many rows; ``df`` itself is not run."""
    return F.broadcast(df) if bound_rows <= most_rows(df, max_rows) else df


def term_rows_bound(texts: DataFrame, text_col: str) -> int:
    """Upper bound on (id, term) rows a text column can produce.

    Tokens are maximal runs of at least two characters, so a text of length L has
    at most (L + 1) / 3 tokens and at most twice that many 1- and 2-gram terms.
    Reads only string lengths (no tokenising).
    """
    total = texts.select(F.sum(F.coalesce(F.length(text_col), F.lit(0)) + 1).alias("n")).collect()[0]["n"]
    return 0 if total is None else int(2 * (total + 2) // 3)


def cpu_partitions(df: DataFrame) -> int:
    """Partition count for CPU-heavy per-row work (regex tokenising, hashing).

    The session's shuffle partitions (set for the data's size), and at least one per core
    (``defaultParallelism`` grows with the cluster).  The count is explicit, so AQE does
    not coalesce this small-in-bytes but CPU-heavy stage into a single task.
    """
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_by(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition on ``key`` into ``cpu_partitions`` partitions."""
    return df.repartition(cpu_partitions(df), key)
