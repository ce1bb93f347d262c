"""Prefix trie of conversations by vertical bitmaps.

A node is a distinct sequence of first turns; its members are the conversations that start
with it.  Conversations are dealt to shards of consecutive ids.  A shard gives its members bit
numbers in id order and indexes every (position, turn) to the bitset of members that have that
turn there.  Depth first, a node's bitset is intersected with the postings of its members' next
turns: each non-empty intersection is a child, its popcount the child's members, and the members
that end at the node are an end list of ascending ids.

The shards' nodes are merged by path (a chained 128-bit digest of the turns): popcounts are
summed, the smallest member and the child count are taken, end lists are hashed in shard
order, streamed.  Sums over subtrees count each node once, in the shard of its smallest
member, which also has all its ancestors: there they are added up in reverse depth-first order
with one sum per depth, and the shards' sums are added by path.  So a node that all
conversations share is one row a shard, and no task meets all members of a node; only the bytes
of one node's end list go through one task, as a SHA-256 of them must, without being held.

Defined cases: rows with a null conversation id take no part; turns are ordered by turn (null
first), then by the digest of role and text; null roles and texts are empty; rows that repeat a
turn are turns of their own; a conversation without turns ends at the root; an empty table has
no nodes.  Texts of any length are read whole, as a digest and a length.  A conversation is held
by one task as some 100 bytes a turn.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.sizing import cpu_partitions
from ..session import cut_lineage

SHARD_MEMBERS, SHARD_TURNS = 1024, 50_000  # a shard is closed when it has as many
BATCH = 5000  # nodes in an Arrow batch
ROOT = bytes(16)
LOCAL = ("shard long, seq long, path binary, parent binary, depth long, conv_id long, n_convs long, chars long, ends string")


def turn_keys(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, turn_key (digest of role and text), chars (code points of the text)."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), key.alias("turn_key"), F.length(text).cast("long").alias("chars"))


def numbered(keys: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn_key, chars."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_key")
    return keys.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "turn_key", "chars")


class Shard:
    """Vertical bitmaps of some conversations and the nodes that they give, depth first."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.turns: list[list[int]] = []  # numbers of turn keys
        self.keys: dict[bytes, int] = {}
        self.chars: list[int] = []
        self.n_turns = 0

    def add(self, conv_id: int, turn_key: bytes | None, chars: int) -> None:
        """The next turn of the conversation, in order of ids; no key: it only exists."""
        if not self.ids or self.ids[-1] != conv_id:
            self.ids.append(conv_id)
            self.turns.append([])
        if turn_key is not None:
            number = self.keys.setdefault(turn_key, len(self.keys))
            if number == len(self.chars):
                self.chars.append(chars)
            self.turns[-1].append(number)
            self.n_turns += 1

    def full(self, members: int, turns: int) -> bool:
        return len(self.ids) >= members or self.n_turns >= turns

    def nodes(self) -> Iterator[tuple]:
        """Rows of LOCAL, parents before children."""
        postings: dict[tuple[int, int], int] = {}
        ending: dict[int, int] = {}
        for i, own in enumerate(self.turns):
            bit = 1 << i
            ending[len(own)] = ending.get(len(own), 0) | bit
            for at in enumerate(own):
                postings[at] = postings.get(at, 0) | bit
        names = list(self.keys)
        stack = [((1 << len(self.ids)) - 1, 0, ROOT, None, 0)]
        seq = 0
        while stack:
            members, depth, path, parent, chars = stack.pop()
            here = members & ending.get(depth, 0)
            yield (self.ids[0], seq, path, parent, depth, self.ids[(members & -members).bit_length() - 1], members.bit_count(), chars,
                   ",".join(str(self.ids[i]) for i in _bits(here)) if here else None)
            seq += 1
            rest, children = members ^ here, []
            while rest:
                turn = self.turns[(rest & -rest).bit_length() - 1][depth]
                child = members & postings[depth, turn]
                rest &= ~child
                children.append((child, depth + 1, hashlib.blake2b(path + names[turn], digest_size=16).digest(), path, self.chars[turn]))
            stack.extend(reversed(children))


def _bits(members: int) -> Iterator[int]:
    while members:
        low = members & -members
        yield low.bit_length() - 1
        members ^= low


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _shard_task(members: int, turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("path", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()),
                            ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("chars", pa.int64()), ("ends", pa.string())])

        def rows() -> Iterator[tuple]:
            shard = Shard()
            for batch in batches:
                for conv, key, chars in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if shard.ids and conv != shard.ids[-1] and shard.full(members, turns):
                        yield from shard.nodes()
                        shard = Shard()
                    shard.add(conv, key, chars)
            if shard.ids:
                yield from shard.nodes()
        yield from _batches(rows(), schema)
    return run


def _subtree_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each subtree; rows of a shard come in reverse depth-first order."""
    schema = pa.schema([("path", pa.binary()), ("n_leaves", pa.int64()), ("saved", pa.int64())])

    def rows() -> Iterator[tuple]:
        current, waiting = None, {}
        for batch in batches:
            for shard, path, depth, leaf, saved in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if shard != current:
                    current, waiting = shard, {}
                below = waiting.pop(depth + 1, (0, 0))  # of this node's children: all came before it
                total = (leaf + below[0], saved + below[1])
                level = waiting.get(depth, (0, 0))
                waiting[depth] = (level[0] + total[0], level[1] + total[1])
                if any(total):
                    yield path, *total
    yield from _batches(rows(), schema)


def _hash_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each path's end lists; rows come by path, then shard."""
    schema = pa.schema([("path", pa.binary()), ("ends_sha256", pa.string())])

    def rows() -> Iterator[tuple]:
        current, digest = None, None
        for batch in batches:
            for path, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != current:
                    if current is not None:
                        yield current, digest.hexdigest()
                    current, digest = path, hashlib.sha256(ends.encode())
                else:
                    digest.update(b"," + ends.encode())
        if current is not None:
            yield current, digest.hexdigest()
    yield from _batches(rows(), schema)


def trie(turns: DataFrame, shard_members: int = SHARD_MEMBERS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node.

    ``turns`` has conv_id, pos, turn_key, chars (see ``numbered``); a row with a null key stands
    for a conversation only, so that one without turns is a member of the root.
    """
    parts = cpu_partitions(turns)
    dealt = turns.repartitionByRange(parts, "conv_id").sortWithinPartitions("conv_id", "pos")
    local = dealt.select("conv_id", "turn_key", "chars").mapInArrow(_shard_task(shard_members, shard_turns), LOCAL)
    local = cut_lineage(local, "trie-shards")

    nodes = cut_lineage(local.groupBy("path").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.max("chars").alias("chars")), "trie-nodes")
    children = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children.withColumnRenamed("parent", "path"), "path", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = cut_lineage(nodes, "trie-children")

    # a node counts in the shard of its smallest member
    known = nodes.select("path", F.col("conv_id").alias("owner"), F.col("n_convs").alias("n"), F.col("chars").alias("c"), "n_children")
    own = F.col("conv_id") == F.col("owner")
    placed = local.select("shard", "seq", "path", "depth", "conv_id").join(known, "path").select(
        "shard", "path", "depth", F.when(own & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("leaf"),
        F.when(own, (F.col("n") - 1) * F.col("c")).otherwise(0).cast("long").alias("saved"), "seq")
    placed = placed.repartition(parts, "shard").sortWithinPartitions("shard", F.desc("seq"))
    sums = placed.mapInArrow(_subtree_task, "path binary, n_leaves long, saved long")
    sums = sums.groupBy("path").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    ends = local.where("ends is not null").select("path", "ends", "shard").repartition(parts, "path").sortWithinPartitions("path", "shard")
    ends = ends.mapInArrow(_hash_task, "path binary, ends_sha256 string")

    parents = nodes.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "path").join(ends, "path", "left").join(parents, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


# ----------------------------------------------------------- shared beginnings ---

HEAD = 5  # no more than so many turns are taken over


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of conversation c - c % 100, then its own
    turns after its first h; h = crc32(decimal c) % 6.  Rows as for ``trie``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    rows = cut_lineage(turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", h), "trie-turns")
    heads = rows.where((F.col("conv_id") == F.col("base")) & (F.col("pos") < HEAD)).groupBy("base").agg(
        F.array_sort(F.collect_list(F.struct("pos", "turn_key", "chars"))).alias("head"))  # at most HEAD turns
    heads = cut_lineage(heads, "trie-heads")
    taken = F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0)))
    own = rows.where("pos >= h").join(heads.select("base", F.size("head").alias("n_head")), "base", "left")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("n_head", F.lit(0)))).alias("pos"), "turn_key", "chars")
    convs = rows.groupBy("conv_id", "base", "h").agg(F.count("*").alias("n")).join(heads, "base", "left").withColumn("taken", taken)
    first = convs.where("taken > 0").select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("taken"))).alias("t"))
    first = first.select("conv_id", "t.pos", "t.turn_key", "t.chars")
    exists = convs.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("long").alias("chars"))
    return own.unionByName(first).unionByName(exists)


ORACLE = """
WITH k AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                    md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
                  md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
                  length(coalesce(text, '')) AS chars
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
             xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                 lambda acc, x: list_reduce(list_concat([xor(acc, x)], [0, 0, 0, 0, 0, 0, 0, 0]),
                     lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)), 4294967295) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM k)),
r AS (SELECT c.conv_id, list(struct_pack(t := k.t, chars := k.chars) ORDER BY CASE WHEN k.conv_id = c.conv_id AND k.pos >= c.h THEN 1 ELSE 0 END, k.pos)
                 FILTER (WHERE k.conv_id = c.conv_id AND k.pos >= c.h OR k.conv_id = c.base AND k.pos < c.h) AS l
      FROM c LEFT JOIN k ON k.conv_id = c.conv_id OR k.conv_id = c.base GROUP BY c.conv_id),
m AS (SELECT conv_id, coalesce(l, []) AS l, unnest(range(0, coalesce(len(l), 0) + 1)) AS depth FROM r),
p AS (SELECT conv_id, depth, md5(list_transform(l[1:depth], lambda x: x.t)::VARCHAR) AS path,
             CASE WHEN depth > 0 THEN md5(list_transform(l[1:depth - 1], lambda x: x.t)::VARCHAR) END AS parent,
             coalesce(l[depth].chars, 0) AS chars, depth = len(l) AS ends FROM m),
n AS (SELECT path, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
      FROM p GROUP BY path, depth),
d AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.parent = n.path AND x.depth = n.depth + 1) AS n_children,
             (SELECT x.conv_id FROM n x WHERE x.path = n.parent AND x.depth = n.depth - 1) AS parent_conv_id FROM n),
s AS (SELECT a.path, a.depth, sum(CASE WHEN d.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((d.n_convs - 1) * d.chars) AS saved_tokens
      FROM d JOIN p a ON a.conv_id = d.conv_id AND a.depth <= d.depth GROUP BY a.path, a.depth)
SELECT d.conv_id, d.depth, d.parent_conv_id, d.n_convs, d.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, d.ends_sha256
FROM d JOIN s ON d.path = s.path AND d.depth = s.depth
"""
