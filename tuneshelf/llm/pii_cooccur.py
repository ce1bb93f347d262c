"""Personal data and the terms that give it away, by corpus co-occurrence.

Patterns find the protected entities (mail and network addresses, card and phone numbers).
The corpus then tells how strongly a term near an entity reveals it: with c(t) occurrences
of a term, c(e) words near an entity, c(t, e) occurrences of the term near it, and N words,

    disclosure(t, e) = PMI(t, e) / information(e)
                     = log2(c(t, e) N / (c(t) c(e))) / log2(N / c(e)),

1 for a term that is never seen elsewhere, about 0 for an unrelated one.  A term near a
mention whose disclosure exceeds ``DISCLOSES`` is generalised to its first letters when those
disclose no more than that, and removed else.  Disclosure is bounded from below: the share
c(t, e) / c(t) is taken at the lower end of its Wilson interval (``Z`` deviations), so that few
occurrences weigh less, and none are dropped.  An entity is the literal one, the person or the
host (network) of an address, and the whole kind; a term goes if it discloses any of them.

Counts cover all words of all distinct texts: copies of a text share one text's weight.  Pairs
and words are added up in the tasks before they are shuffled.  Only the keys of repeated
texts are broadcast, if counted few; else that join is shuffled.

Defined cases: a null or empty text has no spans; rows that repeat are treated alike and count
once; a null id is an id like others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
WINDOW = 6  # words on each side of a mention
Z = 1.96  # standard deviations below the observed share of a term's occurrences near an entity
DISCLOSES = 0.8
PREFIX = 3  # letters of a generalised term
CACHE_WORDS = 400_000
SALTS = 64  # parts of a kind's or host's terms: they are many rows of one entity
BROADCAST_TEXTS = 1_000_000  # keys of repeated texts, 16 bytes each

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the at signs: linear in the text however long its words are."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            last = host.end()
            yield start, last
            at = text.find("@", last)
        else:
            # no match begins in this run, and none can cross its at sign
            last = at + 1
            at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers; a longer chain is cut into fours from its left."""
    for chain in _DOTTED.finditer(text):
        at, parts = chain.start(), chain.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i: i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 3 or (len(p.lstrip("0")) == 3 and p.lstrip("0") <= "255") for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m.group())) <= 15:
                yield m.span()


FINDERS = (emails, addresses, cards, phones)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    if not text:
        return []
    return [(kind, a, b) for kind, find in zip(KINDS, FINDERS, strict=True) for a, b in find(text)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _merged(spans: list[tuple[str, int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def near_terms(text: str, spans: list[tuple[str, int, int]], window: int = WINDOW) -> Iterator[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the words within ``window`` words of each mention.
    Words inside a mention are no terms; an entity is its kind and its text without blanks."""
    taken = _merged(spans)
    for kind, a, b in spans:
        entity = kind + ":" + "".join(text[a:b].split()).lower()
        for right in (False, True):
            for x, y in _words_beside(text, a, b, right, window):
                if not any(p < y and x < q for p, q in taken):
                    yield entity, text[x:y].lower(), x, y


def _words_beside(text: str, a: int, b: int, right: bool, window: int) -> list[tuple[int, int]]:
    """The nearest words on one side; the stretch looked at grows until it holds enough."""
    reach = 16 * window
    while True:
        lo, hi = (b, min(len(text), b + reach)) if right else (max(0, a - reach), a)
        found = [(m.start(), m.end()) for m in _WORD.finditer(text, lo, hi)]
        # a word cut by the stretch's far end is not whole yet
        if right and found and hi < len(text) and found[-1][1] == hi:
            found.pop()
        if not right and found and lo > 0 and found[0][0] == lo:
            found.pop(0)
        whole = hi == len(text) if right else lo == 0
        if whole or len(found) >= window:
            return found[:window] if right else found[-window:]
        reach *= 2


def _find_task(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_type = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            spans = [base_spans(t) for t in batch.column(2).to_pylist()]
            texts = batch.column(2)
            near = [[dict(zip(("entity", "term", "a", "b"), x, strict=True)) for x in near_terms(texts[i].as_py(), s, window)] if s else []
                    for i, s in enumerate(spans)]
            lists = [joined(s) for s in spans]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(3),
                *(pa.array([sum(x[0] == k for x in s) for s in spans], pa.int64()) for k in KINDS),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lists]), pa.array(lists, pa.string()), pa.array(near, near_type),
            ], ["row", "doc_id", "text_key", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "near"])
    return run


def find(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Base spans of every row, and the words near them."""
    small_batches(docs.sparkSession, 500)
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        _find_task(window), f"row long, doc_id {kind}, text_key long, {counts}, base_sha256 string, base string, "
                            "near array<struct<entity:string,term:string,a:long,b:long>>")


def _word_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    counts: Counter = Counter()

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.float64())], ["term", "n"])

    for batch in batches:
        for text, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text and copies == 1:
                counts.update(_WORD.findall(text.lower()))
            elif text:
                for term, n in Counter(_WORD.findall(text.lower())).items():
                    counts[term] += n / copies
        if len(counts) > CACHE_WORDS:
            yield flush()
            counts.clear()
    if counts:
        yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """term, n: occurrences of every word of all distinct texts, added up per task first."""
    keyed = docs.select("text", F.xxhash64("text").alias("text_key"))
    copies = keyed.groupBy(F.col("text_key").alias("copy_key")).agg(F.count("*").alias("copies")).where("copies > 1")
    copies = cut_lineage(copies, "pii-copies")
    if copies.count() <= BROADCAST_TEXTS:
        copies = F.broadcast(copies)
    weighed = keyed.join(copies, F.col("text_key") == F.col("copy_key"), "left").select("text", F.coalesce("copies", F.lit(1)).alias("copies"))
    small_batches(docs.sparkSession, 500)
    # each copy adds its part; rounding takes off what the order of adding leaves
    return weighed.mapInArrow(_word_task, "term string, n double").groupBy("term").agg(F.round(F.sum("n"), 6).alias("n"))


def with_levels(near: DataFrame) -> DataFrame:
    """``entity`` replaced by each of its levels, one row per level: the literal entity, the person
    and the host of a mail address, the network of a network address, the kind."""
    kind, value = F.substring_index("entity", ":", 1), F.expr("substr(entity, instr(entity, ':') + 1)")
    levels = F.array(
        F.col("entity"),
        F.when(kind == "email", F.concat(F.lit("email person:"), F.substring_index(value, "@", 1))),
        F.when(kind == "email", F.concat(F.lit("email host:"), F.substring_index(value, "@", -1))),
        F.when(kind == "ip", F.concat(F.lit("ip net:"), F.substring_index(value, ".", 3))),
        F.concat(kind, F.lit(" kind:")))
    return near.withColumn("entity", F.explode(F.array_compact(levels)))


def disclosing_terms(near: DataFrame, words: DataFrame, z: float = Z, limit: float = DISCLOSES) -> DataFrame:
    """entity, term, disclosure, general: pairs above the limit; ``general`` is the term's
    first letters if those do not disclose the entity, else null (the term is removed).

    ``near`` has one row per occurrence of a term near an entity.
    """
    pairs = cut_lineage(near.groupBy("entity", "term").agg(F.count("*").alias("both")), "pii-pairs")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wide_level = F.col("entity").rlike("^(email host|ip net|[a-z]+ kind):")
    salt = F.when(wide_level, F.pmod(F.xxhash64("term"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    salted = pairs.withColumn("salt", salt)
    around = salted.groupBy("entity", "salt").agg(F.sum("both").alias("c_e")).groupBy("entity").agg(F.sum("c_e").alias("c_e"))
    around = cut_lineage(around, "pii-entities")
    salts = F.when(wide_level, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    around = around.withColumn("salt", F.explode(salts))

    def disclosure(share):
        n = F.lit(float(max(total, 1)))
        return F.log2(share * n / F.col("c_e")) / F.log2(n / F.col("c_e"))

    def low(both: str, c_t: str):
        """Lower end of the Wilson interval of c(t, e) / c(t)."""
        n = F.greatest(F.col(c_t), F.col(both).cast("double"))
        p, zz = F.col(both) / n, z * z
        return (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)

    # a term near several mentions counts for each, so c(t) is at least c(t, e)
    scored = salted.join(words.withColumnRenamed("n", "c_t"), "term").join(around, ["entity", "salt"]).where(F.col("c_e") < F.lit(total))
    scored = scored.withColumn("disclosure", disclosure(low("both", "c_t"))).where(F.col("disclosure") > limit)
    scored = cut_lineage(scored.select("entity", "term", "c_e", "disclosure", F.substring("term", 1, PREFIX).alias("prefix")), "pii-disclosing")
    short = words.groupBy(F.substring("term", 1, PREFIX).alias("prefix")).agg(F.sum("n").alias("c_p"))
    together = pairs.groupBy("entity", F.substring("term", 1, PREFIX).alias("prefix")).agg(F.sum("both").alias("both_p"))
    wide = scored.join(together, ["entity", "prefix"]).join(short, "prefix")
    # what stays in the text is judged by the plain share, which is never below the bound
    wide = wide.withColumn("general_d", disclosure(F.col("both_p") / F.greatest(F.col("c_p"), F.col("both_p").cast("double"))))
    vague = (F.col("general_d") <= limit) & (F.length("prefix") < F.length("term"))
    return wide.select("entity", "term", "disclosure", F.when(vague, F.concat("prefix", F.lit("*"))).alias("general"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
             z: float = Z, limit: float = DISCLOSES) -> DataFrame:
    """doc_id, n_<kind>, base_sha256, spans, terms (a, b, general) of every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = cut_lineage(find(docs, window), "pii-found")
    near = found.where(F.size("near") > 0).select("row", "text_key", F.explode("near").alias("x")).select("row", "text_key", "x.*")
    near = with_levels(near)
    words = cut_lineage(word_counts(docs), "pii-words")
    # a place counts once in a text's copies, and once beside several mentions of a host or kind
    counted = near.select("text_key", "entity", "term", "a", "b").distinct()
    told = cut_lineage(disclosing_terms(counted, words, z, limit), "pii-told")
    hits = near.join(told, ["entity", "term"]).groupBy("row", "a", "b").agg(
        F.when(~F.bool_or(F.col("general").isNull()), F.max("general")).alias("general"))  # removed if any level asks for it
    terms = hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("a", "b", "general"))).alias("terms"))
    terms = cut_lineage(terms.withColumnRenamed("row", "t_row"), "pii-terms")
    out = found.drop("near", "text_key").join(terms, F.col("row") == F.col("t_row"), "left")
    listed = F.transform("terms", lambda t: F.concat_ws(":", F.when(t["general"].isNull(), "remove").otherwise("generalise"), t["a"], t["b"]))
    # further kinds stand after the base ones, in alphabetical order
    listed = F.coalesce(listed, F.array().cast("array<string>"))
    more = F.concat(F.filter(listed, lambda x: x.startswith("generalise")), F.filter(listed, lambda x: x.startswith("remove")))
    spans = F.array_join(F.concat(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.array("base")), more), ",")
    return out.select("row", "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"), "terms")


def _mask_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, terms in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if text is None:
                out.append(None)
                continue
            cuts = [(a, b, f"[{k.upper()}]") for k, a, b in base_spans(text)]
            cuts += [(t["a"], t["b"], t["general"] or "[TERM]") for t in terms or []]
            parts, at = [], 0
            for a, b, mask in sorted(cuts):
                if a >= at:
                    parts += [text[at:a], mask]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """doc_id and the sanitised text: entities masked by kind, disclosing terms generalised
    or masked.  Ids must be unique (the spans are joined to the texts by id)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    terms = sanitise(docs, **kw).select(F.col("doc_id").alias("t_id"), "terms").where("terms is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = docs.join(terms, F.col("doc_id") == F.col("t_id"), "left").select("doc_id", "text", "terms")
    return both.mapInArrow(_mask_task, f"doc_id {kind}, text string")
