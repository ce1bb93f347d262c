"""Document / question embedders.

Default: a deterministic hashed bag of words: column expressions tokenise and hash, numpy
adds up in batches (no model weights).  Each token goes to bucket
``md5(token)[:8] mod dim`` with sign from the next bit, and the vector keeps
integer counts; cosine normalises, so every engine computes it exactly.

Hook: ``embed_with(df, make_embedder)`` runs any batch embedder through ``mapInPandas``
(the factory is called once per task, which loads the model; batches of ``EMBED_BATCH`` rows).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import tokens
from .sizing import spread_by


def hashed_embedding(df: DataFrame, dim: int = 64, id_col: str = "doc_id", text_col: str = "text",
                     out_col: str = "embedding") -> DataFrame:
    """(id, embedding array<double>) for every row of ``df``, zero vector if no tokens.

    The frame is hash-partitioned on the id once; Spark tokenises and hashes, and a task adds
    up the signs of its batches' tokens in one array.  Rows of one id share their sum.
    """
    base = spread_by(df.select(id_col, text_col), id_col)

    def number(tok):
        return F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long")

    codes = F.when(F.col(id_col).isNotNull(), F.transform(tokens(text_col), number))  # no id: the zero vector
    rows = (base.select(id_col, codes.alias("codes")).groupBy(id_col)
            .agg(F.count(F.lit(1)).alias("n"), F.flatten(F.collect_list("codes")).alias("codes")))
    vecs = rows.mapInArrow(_add_signs(dim), f"{id_col} {df.schema[id_col].dataType.simpleString()}, n long, v array<double>")
    return vecs.select(id_col, F.explode(F.array_repeat("v", F.col("n").cast("int"))).alias(out_col))


def _add_signs(dim: int):
    """(id, n, codes) -> (id, n, vector)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            code = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            v = np.bincount(row * dim + code % dim, np.where(code // dim % 2 == 0, 1.0, -1.0), len(sizes) * dim).astype(np.float64)  # of no tokens it counts in integers
            offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(v))], ["id", "n", "v"])
    return run


Embedder = Callable[[list[str]], list[list[float]]]


def embed_with(df: DataFrame, make_embedder: Callable[[], Embedder],
               id_col: str = "doc_id", text_col: str = "text", out_col: str = "embedding",
               batch: int = fixed.EMBED_BATCH) -> DataFrame:
    """Run a batch embedder (texts -> vectors) on executors through Arrow."""
    id_type = dict(df.dtypes)[id_col]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed_fn = make_embedder()
        for pdf in it:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start:start + batch]
                vecs = list(embed_fn(part[text_col].fillna("").tolist()))
                if len(vecs) != len(part):  # without a vector of its own a text would get another's
                    raise ValueError(f"the embedder returned {len(vecs)} vectors for {len(part)} texts")
                yield pd.DataFrame({id_col: pd.Series(part[id_col].to_numpy(), dtype=object),
                                    out_col: pd.Series(list(vecs), dtype=object)})

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {id_type}, {out_col} array<double>")


def python_hashed_embedder(dim: int = 64) -> Callable[[], Embedder]:
    """A factory of the same hashed bag of words in Python, for ``embed_with`` (checks the
    hook; needs the ``regex`` package on the executors)."""

    def make() -> Embedder:
        import regex

        return functools.partial(_python_hashed, regex.compile(fixed.TOKEN_PATTERN), dim)

    return make


def _python_hashed(pat, dim: int, texts: list[str]) -> list[list[float]]:
    out = []
    for t in texts:
        v = [0.0] * dim
        for tok in pat.findall(t.lower()):
            h = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16)
            v[h % dim] += 1.0 if (h // dim) % 2 == 0 else -1.0
        out.append(v)
    return out
