"""Toxicity from class-conditional Kneser-Ney models.

Toxic and ordinary texts have word-pair models of their own: a word's probability after the word
before it, across all word edges, so that a rude expression of ordinary words has evidence.
The class model of a pair backs off to the class model of the word, whose counts are Kneser-Ney's
continuation counts (after how many different words it stands).  That one predicts the word piece
by piece (its first 3, 5, 7 bytes, then the whole word), so a rude stem is known behind other
endings, and each piece's class counts back off to shared ones: how often all documents,
labelled or not, go on from the same beginning in the same way.

A token's evidence is the difference of its toxic and ordinary log-likelihood.  A document has
the length-normalised mean of its tokens and its strongest ones, with and without the word before;
a logistic fit on labelled documents that the counts have not seen turns these into a
probability.

Where neither class has seen a continuation, both go on with the same shared probability, which
cancels.  So evidence is non-zero only for what the labelled sample holds, and a task needs only
that: the sample's words, pieces and pairs, joined to the shared counts of all documents.  The
shared counts themselves (a row for each distinct word of the corpus) stay a table.

Labels: rows with crc32(doc_id as text) mod 4 = 2 are held out; 0 and 1 give the class
counts, 3 the logistic fit.  The labelled documents are a hash sample of about
``MAX_LABEL_BYTES`` of text and ``MAX_LABELS`` rows at most, which bounds what the driver and the
tasks hold (a pair, 12 bytes, for each token of the sample at most).

Defined cases: a null or wordless text has no evidence and scores like an average text of
no length; conflicting labels of one id count as toxic; without both classes in the fit the
score is the share of toxic labels (0 without labels); a null id is never labelled and not
held out; rows that repeat are scored alike; an empty table gives an empty result; a text of any
length is read whole, by one task; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import maybe_broadcast, small_batches, without_rows
from .shingles import groups

PIECES = (3, 5, 7)  # bytes of a word's beginnings
END = b"\x00"  # closes a whole word: no word holds it
DISCOUNT = 0.75
MAX_LABELS, MAX_LABEL_BYTES = 200_000, 10 << 20
THRESHOLD = 0.3
CACHE_WORDS = 200_000  # words that a task keeps counts or evidence of
GROUP_CHARS = 500_000  # of texts that a task scores at once (a longer text is one group)
FEATURES = ("top1", "top3", "mean", "word_top1", "word_top3", "word_mean", "log_words")
# letters stay, A-Z are lower, other ASCII separates words
_TABLE = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def label_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", max_labels: int = MAX_LABELS,
                 max_bytes: int = MAX_LABEL_BYTES) -> DataFrame:
    """doc_id, toxic, part (0 and 1: counts, 3: fit) of a hash sample of the labelled documents."""
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).where("doc_id is not null and toxic is not null")
    own = own.withColumn("part", remainder(F.col("doc_id"))).where("part <> 2")
    own = own.groupBy("doc_id", "part").agg((F.max("toxic") > 0).alias("toxic"))
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    own = cut_lineage(own.join(sizes, "doc_id").groupBy("doc_id", "part", "toxic").agg(F.sum("size").alias("size")), "tox-labels")
    n, size = own.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = min(1.0, max_labels / max(n, 1), max_bytes / max(size, 1))
    if share < 1:
        own = cut_lineage(own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))), "tox-labels")
    return own.drop("size")


# ------------------------------------------------------------------- counts ---

def _word_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of all texts and how often they stand there."""
    from collections import Counter

    counts: Counter = Counter()

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(words_of(text))
        if len(counts) > CACHE_WORDS:
            yield flush()
            counts.clear()
    if counts:
        yield flush()


def _pair_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word pairs of the labelled texts by class; a text's first word stands after an empty one."""
    from collections import Counter

    counts = [Counter(), Counter()]

    def flush():
        every = list(set().union(*counts))
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in every], pa.binary()), pa.array([w for _, w in every], pa.binary()),
                                           *(pa.array([c[p] for p in every], pa.int64()) for c in counts)], ["h", "w", "n_t", "n_o"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            counts[0 if toxic else 1].update(zip([b"", *words[:-1]], words, strict=True) if words else ())
        if len(counts[0]) + len(counts[1]) > CACHE_WORDS:
            yield flush()
            counts = [Counter(), Counter()]
    if counts[0] or counts[1]:
        yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n_all: every distinct word of all documents, written."""
    small_batches(docs.sparkSession, 500)
    words = docs.select("text").mapInArrow(_word_task, "word binary, n long")
    return cut_lineage(words.groupBy("word").agg(F.sum("n").alias("n_all")), "tox-words")


def pair_counts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """h, w, n_t, n_o of the sampled documents that give counts, written."""
    train = F.broadcast(sample.where("part < 2").select(F.col("doc_id").alias("t_id"), "toxic"))  # at most MAX_LABELS rows
    texts = docs.join(train, F.col("doc_id") == F.col("t_id")).select("text", "toxic")
    pairs = texts.mapInArrow(_pair_task, "h binary, w binary, n_t long, n_o long")
    return cut_lineage(pairs.groupBy("h", "w").agg(F.sum("n_t").alias("n_t"), F.sum("n_o").alias("n_o")), "tox-pairs")


def _beginnings(word: str, whole: bool = True) -> Column:
    """The nodes on the way to a word with the one before each: its beginnings, then the word."""
    n, steps, before = F.octet_length(word), [], F.lit(b"")
    for i, size in enumerate(PIECES):
        node = F.substring(word, 1, size)
        steps.append(F.when(n > (PIECES[i - 1] if i else 0), F.struct(node.alias("node"), before.alias("parent"))))
        before = node
    if whole:  # the last beginning is the word itself or its first bytes
        steps.append(F.struct(F.concat(F.col(word), F.lit(END)).alias("node"), before.alias("parent")))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def nodes(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, parent and, as child and as context, its counts in both classes and in all documents.

    ``c_t``, ``c_o``: continuation counts; ``m_t``, ``m_o`` and ``k_t``, ``k_o``: the sum and
    the number of its children's; ``all``, ``p_all``: the shared counts of node and parent.
    """
    heard = pairs.groupBy("w").agg(F.sum((F.col("n_t") > 0).cast("long")).alias("c_t"), F.sum((F.col("n_o") > 0).cast("long")).alias("c_o"))
    own = heard.select(F.explode(_beginnings("w")).alias("s"), "c_t", "c_o").groupBy("s.node", "s.parent").agg(
        F.sum("c_t").alias("c_t"), F.sum("c_o").alias("c_o"))
    own = cut_lineage(own, "tox-nodes")
    children = own.groupBy(F.col("parent").alias("node")).agg(
        F.sum("c_t").alias("m_t"), F.sum("c_o").alias("m_o"),
        F.sum((F.col("c_t") > 0).cast("long")).alias("k_t"), F.sum((F.col("c_o") > 0).cast("long")).alias("k_o"))
    root = words.agg(F.lit(b"").alias("node"), F.sum("n_all").alias("all"))
    shared = words.select(F.explode(_beginnings("word")).alias("s"), "n_all").groupBy("s.node").agg(F.sum("n_all").alias("all")).unionByName(root)
    known = own.select("node").unionByName(children.select("node")).distinct()
    shared = cut_lineage(shared.join(known, "node", "left_semi"), "tox-shared")
    context = cut_lineage(children.join(shared, "node"), "tox-contexts")
    inner = context.select("node", "m_t", "m_o", "k_t", "k_o")
    out = own.join(shared, "node").join(context.select(
        F.col("node").alias("parent"), F.col("all").alias("p_all"), *[F.col(c).alias(f"p_{c}") for c in ("m_t", "m_o", "k_t", "k_o")]), "parent")
    return cut_lineage(out.join(inner, "node", "left"), "tox-model"), context


def smoothed(count: Column, total: Column, kinds: Column, lower: Column) -> Column:
    """Interpolated Kneser-Ney: discounted count, and the discounts shared out by ``lower``."""
    own = (F.greatest(count - F.lit(DISCOUNT), F.lit(0.0)) + F.lit(DISCOUNT) * kinds * lower) / total
    return F.when(total > 0, own).otherwise(lower)


def _lead(total_t: Column, kinds_t: Column, total_o: Column, kinds_o: Column) -> Column:
    """Log ratio of the two classes' mass for what neither has seen after a context."""
    mass = [F.when(n > 0, F.log(F.lit(DISCOUNT) * k / n)).otherwise(F.lit(0.0)) for n, k in ((total_t, kinds_t), (total_o, kinds_o))]
    return mass[0] - mass[1]


def _logs(tree: DataFrame) -> DataFrame:
    """node, log_t, log_o: sums of the steps on the way to each node."""
    lower = F.col("all") / F.col("p_all")
    steps = tree.select("node", *[F.log(smoothed(F.col(f"c_{c}"), F.col(f"p_m_{c}"), F.col(f"p_k_{c}"), lower)).alias(f"log_{c}") for c in "to"])
    whole = F.endswith("node", F.lit(END))
    inside = tree.select("node", F.when(whole, F.substring("node", F.lit(1), F.octet_length("node") - 1)).otherwise(F.col("node")).alias("word"), whole.alias("whole"))
    way = inside.select("node", F.explode(F.transform(_beginnings("word", whole=False), lambda s: s["node"])).alias("step"))
    way = way.unionByName(inside.where("whole").select("node", F.col("node").alias("step")))
    way = way.join(steps.withColumnRenamed("node", "step"), "step")
    # summed as decimals: the order of addition cannot move a digit
    return way.groupBy("node").agg(*[F.sum(F.col(c).cast("decimal(18,15)")).cast("double").alias(c) for c in ("log_t", "log_o")])


def tables(words: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """The evidence of what the labelled sample holds, written.

    ``words``: word, key, uni (its log ratio), back (what it gives to an unseen word after it);
    ``pieces``: node, uni (log ratio up to it and for unseen words behind it);
    ``pairs``: key, delta (what a seen pair adds to ``back`` and ``uni``).
    """
    tree, context = nodes(words, pairs)
    logs = cut_lineage(_logs(tree), "tox-logs")
    whole = F.endswith("node", F.lit(END))
    own = logs.where(whole).select(F.substring("node", F.lit(1), F.octet_length("node") - 1).alias("w"), "log_t", "log_o")
    before = pairs.groupBy("h").agg(F.sum("n_t").alias("t"), F.sum("n_o").alias("o"), F.sum((F.col("n_t") > 0).cast("long")).alias("k_t"),
                                    F.sum((F.col("n_o") > 0).cast("long")).alias("k_o"))
    before = cut_lineage(before.withColumn("back", _lead(F.col("t"), F.col("k_t"), F.col("o"), F.col("k_o"))), "tox-before")
    vocabulary = own.join(before.select(F.col("h").alias("w"), "back"), "w", "full").select(
        F.col("w").alias("word"), F.xxhash64("w").alias("key"), F.coalesce(F.col("log_t") - F.col("log_o"), F.lit(0.0)).alias("uni"),
        F.coalesce("back", F.lit(0.0)).alias("back"))
    # behind a beginning that a class knows, an unseen word goes on with what the discounts left
    ahead = context.select("node", _lead(F.col("m_t"), F.col("k_t"), F.col("m_o"), F.col("k_o")).alias("ahead"))
    pieces = ahead.join(logs, "node", "left").select("node", (F.coalesce(F.col("log_t") - F.col("log_o"), F.lit(0.0)) + F.col("ahead")).alias("uni"))
    full = pairs.join(own, "w").join(before, "h")
    p = [smoothed(F.col(f"n_{c}"), F.col(c), F.col(f"k_{c}"), F.exp(f"log_{c}")) for c in "to"]
    delta = F.log(p[0]) - F.log(p[1]) - (F.col("back") + F.col("log_t") - F.col("log_o"))
    key = F.shiftleft(F.xxhash64("h"), 1).bitwiseXOR(F.xxhash64("w"))
    return {"words": cut_lineage(vocabulary, "tox-vocabulary"), "pieces": cut_lineage(pieces, "tox-pieces"),
            "pairs": cut_lineage(full.select(key.alias("key"), delta.alias("delta")), "tox-deltas")}


class Model:
    """What tasks look evidence up in.  Its size follows from the labelled sample's bound."""

    def __init__(self, words: list[bytes], keys: np.ndarray, uni: np.ndarray, back: np.ndarray, pieces: dict[bytes, float],
                 pair_keys: np.ndarray, deltas: np.ndarray) -> None:
        order = np.argsort(pair_keys, kind="stable")
        self.words, self.keys, self.uni, self.back, self.pieces = words, keys, uni, back, pieces
        self.pair_keys, self.deltas = pair_keys[order], deltas[order]
        self.place: dict[bytes, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"place": {}}

    def unseen(self, word: bytes) -> float:
        """Evidence of a word that no class has: its longest known beginning decides."""
        for i, size in reversed(list(enumerate(PIECES))):
            if len(word) > (PIECES[i - 1] if i else 0) and word[:size] in self.pieces:
                return self.pieces[word[:size]]
        return self.pieces.get(b"", 0.0)

    def evidence(self, docs: list[list[bytes]], cache: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray]:
        """Of each token of all documents in turn: its evidence after the word before it, and alone."""
        place = self.place
        if not place and self.words:
            place.update(zip(self.words, range(len(self.words)), strict=True))
        flat = [w for d in docs for w in d]
        at = np.fromiter((place.get(w, -1) for w in flat), np.int64, len(flat))
        alone = np.zeros(len(flat))
        known = at >= 0
        alone[known] = self.uni[at[known]]
        for i in np.nonzero(~known)[0]:
            w = flat[i]
            value = cache.get(w)
            if value is None:
                value = cache[w] = self.unseen(w)
            alone[i] = value
        before = np.concatenate([[-1], at[:-1]]) if len(at) else at
        starts = np.cumsum([0, *map(len, docs)])[:-1]
        before[starts[[len(d) > 0 for d in docs]]] = place.get(b"", -1)
        full = alone.copy()
        heard = before >= 0
        full[heard] += self.back[before[heard]]
        both = np.nonzero(known & heard)[0]
        if len(both) and len(self.pair_keys):
            keys = (self.keys[before[both]] << np.int64(1)) ^ self.keys[at[both]]
            spot = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            seen = self.pair_keys[spot] == keys
            full[both[seen]] += self.deltas[spot[seen]]
        return full, alone


def collect_model(parts: dict[str, DataFrame]) -> Model:
    """The written tables of the sample's words, pieces and pairs, to be broadcast."""
    words, pieces, pairs = (parts[p].toArrow() for p in ("words", "pieces", "pairs"))
    return Model(words["word"].to_pylist(), words["key"].to_numpy(), words["uni"].to_numpy().astype(np.float32), words["back"].to_numpy().astype(np.float32),
                 dict(zip(pieces["node"].to_pylist(), pieces["uni"].to_pylist(), strict=True)),
                 pairs["key"].to_numpy(), pairs["delta"].to_numpy().astype(np.float32))


# ------------------------------------------------------------------ scoring ---

def _top(e: np.ndarray) -> tuple[float, float]:
    best = np.sort(np.partition(e, len(e) - 3)[-3:] if len(e) > 3 else e)
    return best[-1], best.sum() / 3


def _feature_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in groups(texts, GROUP_CHARS):
                docs = [words_of(t) for t in texts[part]]
                if len(cache) > CACHE_WORDS:
                    cache = {}
                full, alone = model.evidence(docs, cache)
                out, start = np.zeros((len(docs), len(FEATURES))), 0
                for i, words in enumerate(docs):
                    n = len(words)
                    if n:
                        a, b = full[start: start + n], alone[start: start + n]
                        out[i] = *_top(a), a.mean(), *_top(b), b.mean(), np.log1p(n)
                    start += n
                own = [batch.column(c)[part.start: part.stop] for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c) for c in out.T)], ["doc_id", "text_key", *FEATURES])
    return run


def features(docs: DataFrame, model: Model) -> DataFrame:
    small_batches(docs.sparkSession, 200)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sample
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        _feature_task(shared), f"doc_id {kind}, text_key long, " + ", ".join(f"{f} double" for f in FEATURES))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic fit (Newton steps on standardised columns)."""
    mu, sd = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mu) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    pen = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + pen, z.T @ (p - y) + pen @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] * mu / sd).sum())


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          threshold: float = THRESHOLD, max_labels: int = MAX_LABELS, max_bytes: int = MAX_LABEL_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted and text_key (names the row): one row per document row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = label_sample(docs, labels, label_col=label_col, max_labels=max_labels, max_bytes=max_bytes)
    model = collect_model(tables(word_counts(docs), pair_counts(docs, sample)))
    found = cut_lineage(features(docs, model), "tox-features")
    fit = sample.where("part = 3").select(F.col("doc_id").alias("f_id"), "toxic")
    rows = found.join(maybe_broadcast(fit, max_labels), F.col("doc_id") == F.col("f_id")).select("toxic", *FEATURES).toPandas()
    rows = rows.sort_values(["toxic", *FEATURES], ignore_index=True)  # one order of addition in the fit
    share = sample.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    if rows["toxic"].nunique() < 2:
        value = F.lit(float(share))
    else:
        w, b = fit_logistic(rows[list(FEATURES)].to_numpy(), rows["toxic"].to_numpy().astype(float))
        z = F.lit(b)
        for name, weight in zip(FEATURES, w, strict=True):
            z = z + F.col(name) * float(weight)
        value = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
    found = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.cast("double").alias("score"), "text_key")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents that are not predicted toxic, all columns as they were."""
    found = score(docs, labels, id_col=id_col, text_col=text_col, **kw)
    return without_rows(docs, found.where("predicted = 1"), id_col, text_col)
