"""Names in answers: which catalogue names a text says, and which of them were not retrieved.

Names and texts go through one tokeniser.  The names are a phrase dictionary keyed by their
whole token sequence; a text gives, at every token, one phrase for each length that a name has
(the lengths are a handful, read from the dictionary), and an equi-join finds the names that
it says.  A phrase is compared whole, so a hit needs no second look, and a frequent first word
costs nothing: only true mentions become rows.  A mention inside a longer mention does not
count ("ring" in "gold ring"), which one window over the mentions of a text decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..options import DEFAULT, Settings
from ..session import cut_lineage
from .sizing import broadcast_if_small, cpu_partitions

MAX_LENGTHS = 64  # distinct name lengths in tokens; longer lists of lengths are an error


def phrase_dictionary(names: DataFrame, name_col: str = "name") -> DataFrame:
    """(phrase, n_tokens): distinct token sequences of the names, joined by spaces."""
    toks = names.select(tokens(name_col).alias("t")).filter(F.size("t") > 0)
    return toks.select(F.array_join("t", " ").alias("phrase"), F.size("t").alias("n_tokens")).distinct()


def mentions(texts: DataFrame, dictionary: DataFrame, id_col: str = "question_id", text_col: str = "raw_answer",
             settings: Settings = DEFAULT) -> DataFrame:
    """(id, phrase, pos, n_tokens): maximal mentions of the dictionary's phrases, ``pos`` from 1.

    A null text says nothing; rows that repeat an id are separate texts only if their texts
    differ.
    """
    dictionary = cut_lineage(dictionary, "phrases")
    lengths = sorted(r[0] for r in dictionary.select("n_tokens").distinct().limit(MAX_LENGTHS + 1).collect())
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"names of more than {MAX_LENGTHS} different lengths")
    base = texts.select(id_col, text_col).distinct().repartition(cpu_partitions(texts), id_col)
    toks = base.select(id_col, F.xxhash64(text_col).alias("text_key"), F.posexplode_outer(tokens(text_col)).alias("at", "tok"))
    toks = toks.filter(F.col("tok").isNotNull())
    # a token with the ones behind it: one sort of the text's tokens, however long it is
    order = Window.partitionBy(id_col, "text_key").orderBy("at")
    longest = max(lengths, default=1)
    toks = toks.select("*", *[F.lead("tok", i).over(order).alias(f"tok{i}") for i in range(1, longest)])

    def phrase(n: int):
        parts = ["tok", *[f"tok{i}" for i in range(1, n)]]
        return F.when(F.col(parts[-1]).isNotNull(), F.struct(F.concat_ws(" ", *parts).alias("phrase"), F.lit(n).alias("n_tokens")))

    said = F.array(*[phrase(n) for n in lengths]) if lengths else F.array().cast("array<struct<phrase:string,n_tokens:int>>")
    rows = toks.select(id_col, "text_key", (F.col("at") + 1).alias("pos"), F.explode(said).alias("s")).filter(F.col("s").isNotNull())
    rows = rows.select(id_col, "text_key", "pos", "s.phrase", "s.n_tokens")
    found = rows.join(broadcast_if_small(dictionary, settings.broadcast_max_rows // 10), ["phrase", "n_tokens"])
    # inside a longer one: a mention that begins no later (longer first) reaches at least as far
    before = Window.partitionBy(id_col, "text_key").orderBy("pos", F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("n_tokens")
    found = found.withColumn("reach", F.max(end).over(before)).filter(F.col("reach").isNull() | (F.col("reach") < end))
    return found.select(id_col, "phrase", "pos", "n_tokens")


def names_not_retrieved(answers: DataFrame, hit_docs: DataFrame, names: DataFrame, id_col: str = "question_id",
                        text_col: str = "raw_answer", name_col: str = "track_name", settings: Settings = DEFAULT) -> DataFrame:
    """(id, phrase, n_said): catalogue names that an answer says although none of its
    retrieved entries has that name."""
    said = mentions(answers, phrase_dictionary(names, name_col), id_col, text_col, settings)
    said = said.groupBy(id_col, "phrase").agg(F.count(F.lit(1)).alias("n_said"))
    own = hit_docs.select(id_col, F.array_join(tokens(name_col), " ").alias("phrase")).distinct()
    return said.join(own, [id_col, "phrase"], "left_anti").select(id_col, "phrase", "n_said")
