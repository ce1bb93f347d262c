"""Approximate cosine top-k from trained product codes, with exact re-ranking.

Training, on a bounded sample: coarse centroids of the unit vectors, then one codebook for each
pair of components of the residuals; the codebooks are trained side by side, one task each.
A document becomes its coarse cell, a byte a component pair, and the norm of what the code
leaves out (``left``).

A question's cosine with a document is estimated from the decoded vector.  The estimate's error
is the inner product of a unit vector with a remainder of length ``left``, whose direction the
question knows nothing of: its standard deviation is ``left / sqrt(dim)``.  Within ``Z`` of
these a document has a lower and an upper estimate; all documents whose upper one reaches the
question's k-th best lower one are compared exactly.  So the candidates adapt to how dense a
table is, and no parameter depends on its number of rows.

Candidates are compared where they are found: a cell of questions and documents has the codes
and the vectors, and returns each question's k best.  No (question, candidate) pair becomes a row.
Cells are as many as the cores need, and larger tables have more of ``code_block / 2`` rows a side:
what is copied is a question to each part of the documents and a document to each part of the
questions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import DEFAULT, Settings
from ..session import cut_lineage
from .retrieve import top_n
from .vectorblocks import matrix, unit

SAMPLE, COARSE, CODES, SUB = 20_000, 64, 256, 2  # training rows; centroids; codes of SUB components
Z = 4.0  # standard deviations
CHUNK = 4096
ASKS = 2048  # questions of one product


def k_means(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from k distinct rows; an empty cluster keeps its centroid."""
    x = x.astype(np.float32)
    first = np.unique(x, axis=0)
    c = first[np.random.default_rng(seed).permutation(len(first))[:k]]
    for _ in range(rounds):
        own = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.stack([np.bincount(own, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for start in range(0, len(x), CHUNK):
        part = x[start: start + CHUNK]
        out[start: start + CHUNK] = ((c * c).sum(1)[None, :] - 2 * part @ c.T).argmin(1)
    return out


def _codebook_task(key, table):
    x = np.asarray(table["x"].combine_chunks().flatten()).reshape(table.num_rows, -1)
    c = k_means(x, CODES, 12)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "codes": pa.array([c.ravel().astype(np.float32).tolist()], pa.list_(pa.float32()))})


class Codes:
    """Coarse centroids and codebooks; a few hundred kilobytes, whatever the table."""

    def __init__(self, coarse: np.ndarray, books: list[np.ndarray]) -> None:
        self.coarse, self.books = coarse, books

    @property
    def dim(self) -> int:
        return self.coarse.shape[1]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes and remainders' norms of unit (or zero) vectors."""
        cells = nearest(x, self.coarse)
        rest = x - self.coarse[cells]
        codes = np.stack([nearest(rest[:, i * SUB: (i + 1) * SUB], b) for i, b in enumerate(self.books)], 1).astype(np.uint8)
        return cells, codes, np.sqrt(((x - self.decode(cells, codes)) ** 2).sum(1))

    def decode(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = self.coarse[cells].astype(np.float32)
        for i, b in enumerate(self.books):
            out[:, i * SUB: (i + 1) * SUB] += b[codes[:, i]]
        return out


def train(docs: DataFrame, sample: int = SAMPLE) -> Codes | None:
    """Codes from at most ``sample`` documents (did, vec), chosen by hash; None without any."""
    spark = docs.sparkSession
    few = docs.select("did", "vec").orderBy(F.xxhash64("did"), "did").limit(sample).select("vec").toArrow()
    if not few.num_rows:
        return None
    x = unit(matrix(few["vec"], few.num_rows))
    coarse = k_means(x, COARSE, 10)
    rest = (x - coarse[nearest(x, coarse)]).astype(np.float32)
    dim, parts = x.shape[1], range(0, x.shape[1], SUB)
    # each pair of components is a training set of its own: one task trains one codebook
    flat = np.concatenate([rest[:, i: i + SUB].ravel() for i in parts])
    sizes = np.concatenate([np.full(len(x), min(SUB, dim - i)) for i in parts])
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    rows = pa.table({"part": pa.array(np.repeat(np.arange(len(parts)), len(x)), pa.int32()), "x": pa.ListArray.from_arrays(offsets, pa.array(flat))})
    books = spark.createDataFrame(rows).repartition(len(parts), "part").groupBy("part").applyInArrow(_codebook_task, "part int, codes array<float>")
    found = {r["part"]: np.array(r["codes"], np.float32) for r in books.collect()}
    return Codes(coarse, [found[i].reshape(-1, min(SUB, dim - i * SUB)) for i in range(len(parts))])


def _encode_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for batch in batches:
            if batch.num_rows:
                cells, own, left = codes.encode(unit(matrix(batch.column(1), batch.num_rows)).astype(np.float32))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells.astype(np.int32)), pa.array([r.tobytes() for r in own], pa.binary()),
                                                  pa.array(left.astype(np.float32))], ["did", "vec", "cell", "code", "left"])
    return run


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, summed left to right as ``functions.vectors.cosine`` does."""
    dots, a, b = np.zeros(len(q)), np.zeros(len(q)), np.zeros(len(q))
    for i in range(q.shape[1]):
        dots += q[:, i] * x[:, i]
        a += q[:, i] * q[:, i]
        b += x[:, i] * x[:, i]
    den = np.sqrt(a) * np.sqrt(b)
    return np.where(den > 0, dots / np.where(den > 0, den, 1.0), 0.0)


def _same(ids: pa.Array) -> tuple[np.ndarray, list[np.ndarray]] | None:
    """Each row's number among the distinct ids and the rows of each; None if no id repeats."""
    own = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    if not len(own) or own.max() + 1 == len(own):
        return None
    order = np.argsort(own, kind="stable")
    return own, np.split(order, np.cumsum(np.bincount(own))[:-1])


def _pairs(row: int, at: np.ndarray, same_q, same_d) -> tuple[np.ndarray, np.ndarray]:
    """The rows compared for a question's candidates: an id stands for all rows that have it."""
    if same_d is not None and len(at):
        at = np.concatenate([same_d[1][same_d[0][j]] for j in at])
    rows = same_q[1][same_q[0][row]] if same_q is not None else np.array([row])
    return np.repeat(rows, len(at)), np.tile(at, len(rows))


def _candidates(q: np.ndarray, codes: Codes, cells: np.ndarray, raw: np.ndarray, spread: np.ndarray, k: int) -> list[np.ndarray]:
    """For each question the places of the documents whose upper estimate reaches its k-th best lower one."""
    floor = np.full(len(q), -np.inf, np.float32)
    held: list[list] = [[] for _ in range(len(q))]  # lower, upper estimates and places
    for start in range(0, len(raw), CHUNK):
        x = codes.decode(cells[start: start + CHUNK], raw[start: start + CHUNK])
        est, wide = q @ x.T, spread[start: start + CHUNK].astype(np.float32)
        if start == 0 and len(x) > k:
            floor = np.partition(est - wide[None, :], len(x) - k, axis=1)[:, len(x) - k]
        rows, cols = np.nonzero(est + wide[None, :] >= floor[:, None])
        ends = np.searchsorted(rows, np.arange(len(q) + 1))
        for i in range(len(q)):
            at = cols[ends[i]: ends[i + 1]]
            if not len(at):
                continue
            lower, upper = est[i, at] - wide[at], est[i, at] + wide[at]
            if held[i]:
                lower, upper, at = (np.concatenate([held[i][0], lower]), np.concatenate([held[i][1], upper]), np.concatenate([held[i][2], at + start]))
            else:
                at = at + start
            if len(lower) > k:
                floor[i] = max(floor[i], np.partition(lower, len(lower) - k)[len(lower) - k])
                on = upper >= floor[i]
                lower, upper, at = lower[on], upper[on], at[on]
            held[i] = [lower, upper, at]
    return [h[2] if h else np.zeros(0, np.int64) for h in held]


def _best_cell(shared, k: int, q_type: pa.DataType, d_type: pa.DataType):
    def run(asks: pa.Table, docs: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if asks.num_rows and docs.num_rows:
            codes = shared.value
            docs = docs.sort_by("did")  # equal keys: the smaller id
            vectors, questions = matrix(docs["vec"], docs.num_rows), matrix(asks["vec"], asks.num_rows)
            raw = np.frombuffer(b"".join(docs["code"].to_pylist()), np.uint8).reshape(docs.num_rows, -1)
            cells = docs["cell"].to_numpy()
            spread = (Z / math.sqrt(codes.dim)) * docs["left"].to_numpy() + 1e-6  # and the rounding of the estimate
            ids, names = docs["did"].combine_chunks(), asks["qid"].combine_chunks()
            same_q, same_d = _same(names), _same(ids)
            for start in range(0, len(questions), ASKS):
                q = questions[start: start + ASKS]
                places = _candidates(unit(q).astype(np.float32), codes, cells, raw, spread, k)
                for i, at in enumerate(places):
                    asked, at = _pairs(start + i, at, same_q, same_d)
                    score = _exact(questions[asked], vectors[at])
                    best = np.lexsort((at, -np.floor(score * 1e10 + 0.5)))[:k]
                    out[0].append(np.full(len(best), start + i))
                    out[1].append(at[best])
                    out[2].append(score[best])
                    out[3].append(np.where(np.arange(len(best)) == 0, len(at), 0))  # a question's candidates, once
        asked, found, scores, compared = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, float, np.int64), strict=True))
        return pa.table([names.take(pa.array(asked)) if len(asked) else pa.array([], q_type), ids.take(pa.array(found)) if len(found) else pa.array([], d_type),
                         pa.array(scores, pa.float64()), pa.array(compared, pa.int64())], names=["qid", "did", "score", "compared"])
    return run


def grid(n_questions: int, n_docs: int, cores: int, settings: Settings = DEFAULT) -> tuple[int, int]:
    """Parts of the questions and of the documents: about three cells a core, parts of 1024 rows
    at least and of half a ``code_block`` at most, so that few copies are made."""
    side = math.ceil(math.sqrt(3 * cores))
    most = max(1, settings.code_block // 2)
    bq, bd = (max(1, math.ceil(n / most), min(side, n // 1024)) for n in (n_questions, n_docs))
    return bq, bd


def pq_topk(questions: DataFrame, docs: DataFrame, k: int, settings: Settings = DEFAULT, q_id: str = "question_id", q_vec: str = "embedding",
            d_id: str = "doc_id", d_vec: str = "embedding", stats: dict | None = None) -> DataFrame:
    """(q_id, rank, d_id, score): the k nearest documents by cosine, nearly always all of them;
    scores are exact.  ``stats`` receives the number of documents compared exactly."""
    from pyspark.sql.pandas.types import to_arrow_type

    def own(df: DataFrame, name: str):
        """Vectors of floats or doubles are copied as they are; tasks compute in double."""
        return F.col(name) if dict(df.dtypes)[name] in ("array<float>", "array<double>") else F.col(name).cast("array<double>")

    spark = docs.sparkSession
    ds = docs.select(F.col(d_id).alias("did"), own(docs, d_vec).alias("vec"))
    qs = questions.select(F.col(q_id).alias("qid"), own(questions, q_vec).alias("vec"))
    codes = train(ds)
    schema = f"{q_id} {dict(qs.dtypes)['qid']}, rank int, {d_id} {dict(ds.dtypes)['did']}, score double"
    if codes is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(codes)  # fixed size
    coded = ds.mapInArrow(_encode_task(shared), f"did {dict(ds.dtypes)['did']}, vec {dict(ds.dtypes)['vec']}, cell int, code binary, left float")
    coded = cut_lineage(coded.where("did is not null"), "pq-codes")
    qs = qs.where("qid is not null")
    bq, bd = grid(qs.count(), coded.count(), spark.sparkContext.defaultParallelism, settings)
    left = qs.select(F.pmod(F.xxhash64("qid"), F.lit(bq)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bd - 1).cast("long"))).alias("db"), "qid", "vec")
    right = coded.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bq - 1).cast("long"))).alias("qb"), F.pmod(F.xxhash64("did"), F.lit(bd)).alias("db"),
                         "did", "vec", "cell", "code", "left")
    q_type, d_type = (to_arrow_type(df.schema[c].dataType) for df, c in ((qs, "qid"), (ds, "did")))
    found = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInArrow(
        _best_cell(shared, k, q_type, d_type), f"qid {dict(qs.dtypes)['qid']}, did {dict(ds.dtypes)['did']}, score double, compared long")
    if stats is not None:
        found = cut_lineage(found, "pq-found")
        stats["compared"] = found.agg(F.sum("compared")).first()[0] or 0
    best = top_n(found.select("qid", "did", "score"), "qid", k, tie="did")
    return best.select(F.col("qid").alias(q_id), "rank", F.col("did").alias(d_id), "score")
