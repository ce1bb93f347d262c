"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a path of elements with their
classes.  Nodes get an importance from two entropies (logarithms to the base of the host's
page number m): a leaf's content counts by how far each of its texts is from standing on all
pages, 1 - log n / log m for a text on n of the m pages; an element's presentation by the
entropy of the child sequences that the pages use.  An element's composite importance joins
its own presentation with its leaves' content, the former weighing 1 - DECAY^(number of
presentations).  Branches of low importance are cut from every page of the host.

Markup is a prior.  Script, hidden parts and controls are no text.  Parts that ``nav``, ``footer``,
``aside``, ``menu`` or a site's ``header`` name go.  A form, or a part with a telling word in its
class, id or role, goes unless the host's pages show that it holds the main text: its importance
times its share of the host's important text is ``MARKED`` or more.  No word on or around an
article or main part counts against it, but readers' comments are none of it, whatever elements
they use; inside it only a whole class name counts, and not on running text.  Only on hosts with too few pages to learn from, an
article or main part stands for the whole page; elsewhere the tree decides.

Only hashes of paths and texts are shuffled.  Their counts are added up in the tasks first,
so a host with most pages is a few rows for each node.  The tree's cut branches, one row per
host, come back to the pages as a broadcast when counted few, else as a join.

Defined cases: null html is empty, its text is empty; a null url belongs to a host of its
own without learned branches; a page whose text would vanish by learned branches alone
keeps what its markup allows, and one whose text would vanish by telling words keeps that; rows that repeat count as pages; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import small_batches

DECAY = 0.9
THRESHOLD = 0.3  # importance below which a branch is cut
MARKED = 0.5  # importance times share of the host's text from which a part with a telling word stays
MIN_PAGES = 5  # a host and a branch are learned from so many pages
BROADCAST_NODES = 1_000_000  # cut branches in all, 8 bytes each


def host_col(url: str = "url"):
    return F.lower(F.regexp_extract(F.col(url), "://([^/?#]*)", 1))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _node_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page its distinct leaves (branch, text hash, mark, length) and presentations (node, style hash)."""
    from .html_blocks import read

    leaf = pa.list_(pa.struct([("branch", pa.list_(pa.int64())), ("text", pa.int64()), ("mark", pa.int64()), ("chars", pa.int64())]))
    look = pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64())]))
    for batch in batches:
        leaves, looks = [], []
        for page in batch.column(1).to_pylist():
            styles: list = []
            blocks = read(page, styles)
            # what elements name as boilerplate is cut anyway; the tree learns about the rest
            seen = {(x.branch, _hash(x.text), x.mark, len(x.text)) for x in blocks if not x.unseen and not x.firm and x.branch}
            leaves.append([{"branch": list(b), "text": t, "mark": m, "chars": n} for b, t, m, n in seen])
            looks.append([{"node": p, "style": s} for p, s in set(styles) if s])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaves, leaf), pa.array(looks, look)], ["host", "leaves", "looks"])


def _parsed(pages: DataFrame, url_col: str, html_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pages' trees, the hosts with pages enough to learn from, and how often each text of a leaf stands."""
    small_batches(pages.sparkSession, 500)
    base = pages.select(host_col(url_col).alias("host"), F.col(html_col).alias("html")).where("host <> ''")
    parsed = base.mapInArrow(_node_task, "host string, leaves array<struct<branch:array<long>,text:long,mark:long,chars:long>>, "
                                         "looks array<struct<node:long,style:long>>")
    parsed = cut_lineage(parsed, "tree-pages")
    size = cut_lineage(parsed.groupBy("host").agg(F.count("*").alias("m")).where(F.col("m") >= MIN_PAGES), "tree-hosts")
    leaves = parsed.select("host", F.explode("leaves").alias("x")).select("host", "x.*")
    leaves = leaves.withColumn("leaf", F.element_at("branch", -1))
    # the branch is a function of the leaf's hash, so any of them will do
    texts = leaves.groupBy("host", "leaf", "mark", "text").agg(F.count("*").alias("n"), F.first("branch").alias("branch"), F.max("chars").alias("chars"))
    texts = texts.join(size, "host").withColumn("weight", F.col("n") * (1 - F.log("n") / F.log("m")))
    return parsed, size, cut_lineage(texts, "tree-texts")


def _importance(parsed: DataFrame, size: DataFrame, texts: DataFrame) -> DataFrame:
    content = texts.where("mark = 0").groupBy("host", "leaf").agg(F.first("branch").alias("branch"), F.sum("weight").alias("weight"), F.sum("n").alias("n"))
    content = content.select("host", F.explode("branch").alias("node"), "weight", "n").groupBy("host", "node").agg(
        (F.sum("weight") / F.sum("n")).alias("content"), F.sum("n").alias("n_texts"))

    looks = parsed.select("host", F.explode("looks").alias("x")).select("host", "x.node", "x.style")
    styles = looks.groupBy("host", "node", "style").agg(F.count("*").alias("n"))
    total = styles.groupBy("host", "node").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    # entropy of the child sequences: log N - sum(n log n) / N, to the base m
    shown = total.join(size, "host").withColumn("shown", (F.log("n") - F.col("nlogn") / F.col("n")) / F.log("m"))

    nodes = content.join(shown.select("host", "node", "shown", "kinds", F.col("n").alias("n_shown")), ["host", "node"], "left")
    nodes = nodes.join(size, "host")
    keep = F.pow(F.lit(DECAY), F.coalesce("kinds", F.lit(0)))
    value = F.when(F.col("shown").isNull(), F.col("content")).otherwise((1 - keep) * F.col("shown") + keep * F.col("content"))
    return nodes.select("host", "node", "m", F.coalesce("n_shown", "n_texts").alias("n_pages"), value.alias("importance"))


def importance(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, node, n_pages, importance of the nodes of every host's style tree."""
    return _importance(*_parsed(pages, url_col, html_col))


def cut_branches(pages: DataFrame, url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """host, nodes, marks: the branches to cut and the marked parts to keep, one row for every
    host that was learned.  A cut branch's texts stand on more than m^(1 - threshold) of the
    host's m pages on average, which bounds their number; fewer than 1 / MARKED parts stay."""
    parsed, size, texts = _parsed(pages, url_col, html_col)
    nodes = _importance(parsed, size, texts)
    low = (F.col("importance") < threshold) & (F.col("n_pages") >= MIN_PAGES)
    cut = nodes.where(low).groupBy("host").agg(F.collect_set("node").alias("nodes"))
    part = texts.groupBy("host", "mark").agg(F.sum(F.col("weight") * F.col("chars")).alias("own"), F.sum(F.col("n") * F.col("chars")).alias("shown"))
    part = cut_lineage(part, "tree-marks")
    whole = part.groupBy("host").agg(F.sum("own").alias("all"))
    good = part.where("mark <> 0 and own > 0").join(whole, "host").where(F.col("own") / F.col("shown") * F.col("own") / F.col("all") >= MARKED)
    good = good.groupBy("host").agg(F.collect_set("mark").alias("marks"))
    none = F.array().cast("array<long>")
    out = size.select("host").join(cut, "host", "left").join(good, "host", "left")
    return out.select("host", F.coalesce("nodes", none).alias("nodes"), F.coalesce("marks", none).alias("marks"))


def main_text(page: str | None, cut: set[int] | frozenset[int] | None = None, marks: frozenset[int] = frozenset()) -> str:
    """The main text of one page, given its host's cut branches (null if none were learned)
    and the marked parts that its host's pages show to be main text."""
    from .html_blocks import read

    blocks = [b for b in read(page) if not b.unseen and not b.firm]
    blocks = [b for b in blocks if not b.mark or b.mark in marks] or blocks
    if cut is None:
        kept = [b for b in blocks if b.main]
    else:
        kept = [b for b in blocks if not cut.intersection(b.branch)] or [b for b in blocks if b.main]
    return " ".join(b.text for b in kept or blocks)


def _text_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page, None if cut is None else frozenset(cut), frozenset(marks or ())) for page, cut, marks in
                 zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text, n_chars: one row per page row."""
    small_batches(pages.sparkSession, 500)
    cut = cut_lineage(cut_branches(pages, url_col, html_col, threshold), "tree-cut")
    cut = cut.withColumnRenamed("host", "cut_host")
    if (cut.agg(F.sum(F.size("nodes") + F.size("marks") + 8)).first()[0] or 0) <= BROADCAST_NODES:
        cut = F.broadcast(cut)
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    both = base.join(cut, host_col("url") == F.col("cut_host"), "left").select("page_id", "url", "html", "nodes", "marks")
    kind = base.schema["page_id"].dataType.simpleString()
    return both.mapInArrow(_text_task, f"page_id {kind}, url string, text string, n_chars long")
