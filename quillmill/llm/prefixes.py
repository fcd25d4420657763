"""Conversation prefix trie: what conversations share from their first turn on.

Turns become 120-bit digests and conversations are numbered and summed along their turns by
key ranges, so that no conversation is one task's. A node of the trie is named by its depth
and two running sums of its turns' hashes; equal conversations are one sequence from there on.
Where one sequence alone goes on, its turns are a tail, whose figures follow from the sums.

The rest, nodes that two or more different sequences pass, is dealt in shards: sequences
ordered by their first turns, a range of them in each shard. A shard writes its part of the
trie as balanced parentheses, a tail being one pair. Blocks with the least excess in them,
and a tree of minima above the blocks, find where a node closes; between its two parentheses
lie its subtree's leaf pairs and, as differences of cumulative arrays, what it saves.
A node that several shards pass (the spines along their borders) counts in the shard of its
smallest conversation only, and its parts are added up over the shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.tables import batches_mapped, stored
from quillmill.plans.ids import ROW_BITS, with_dense_ids

WORD = r"[^\x20\x09-\x0D]+"
GROUP = 20  # conversations that may begin like the first of them
MOST = 4  # turns taken from there are fewer than this
ORDERED = 4  # first turns by which sequences are dealt to shards
SHARD_ROWS = 200_000  # nodes on the way of a shard's sequences, about
BLOCK = 64  # parentheses whose least excess is kept as one number
ID_BITS = 12  # ids that differ in their last so many bits are joined to one string first


# --- turns ----------------------------------------------------------------------------
def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, words): digest and number of words of each turn.

    A null role or text is an empty one. Rows without a conv_id belong to no conversation and
    are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        "turn",
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("a"),
        F.conv(F.substring(digest, 16, 15), 16, 10).cast("bigint").alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, p, a, b, words): turns with their place in the conversation, from 0.

    By turn, null first; turns of one number by their digest. Rows are numbered in ranges of
    (conv_id, turn), so a conversation of any length is cut over tasks.
    """
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("a").asc(), F.col("b").asc()]
    placed = with_dense_ids(turns_of(conversations), order, "_at")
    first = placed.groupBy("conv_id").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_turns"))
    return placed.join(first, "conv_id").select(
        "conv_id", (F.col("_at") - F.col("_first")).alias("p"), "a", "b", "words", "_turns"
    )


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, a, b, words) of the rebuilt conversations, and (conv_id) of all of them.

    The first ``h`` turns come from the conversation whose id is the next lower multiple of
    ``GROUP``, own turns follow from the ``h``-th on.
    """
    turns = stored(numbered_turns(conversations), "numbered")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    h = F.crc32(F.col("conv_id").cast("string")) % MOST
    ids = turns.where("p = 0").select("conv_id", base.alias("_base"), h.alias("_h"))
    # at most MOST - 1 turns of every GROUP-th conversation, each met by at most GROUP ids
    heads = turns.where((F.col("p") < MOST - 1) & (F.col("conv_id") % GROUP == 0)).select(
        F.col("conv_id").alias("_base"), "p", "a", "b", "words", "_turns"
    )
    begun = ids.join(heads, "_base").where(F.col("p") < F.col("_h"))
    have = ids.join(heads.where("p = 0").select("_base", "_turns"), "_base", "left").select(
        "conv_id", F.least("_h", F.coalesce("_turns", F.lit(0))).alias("_begun")
    )
    own = turns.withColumn("_h", h).where(F.col("p") >= F.col("_h")).join(have, "conv_id")
    rows = begun.select("conv_id", (F.col("p") + 1).alias("depth"), "a", "b", "words").unionByName(
        own.select("conv_id", (F.col("p") - F.col("_h") + F.col("_begun") + 1).alias("depth"), "a", "b", "words")
    )
    return rows, ids.select("conv_id")


# --- running sums ---------------------------------------------------------------------
def running(rows: DataFrame) -> DataFrame:
    """``rows`` with ``x``, ``y`` (hashes of a turn at its place), ``k1``, ``k2`` (these over the
    turns so far, by exclusive or) and ``upto`` (the words so far).

    Sums run within ranges of (conv_id, depth); what the earlier ranges hold of a conversation
    is one row per range, so a long conversation is summed by many tasks.
    """
    spread = rows.select("*", F.xxhash64("depth", "a", "b").alias("x"), F.xxhash64("b", "a", "depth").alias("y"))
    ranged = spread.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    part = F.shiftright(F.monotonically_increasing_id(), ROW_BITS)
    placed = stored(ranged.withColumn("_part", part), "ranges")
    sums = {"k1": F.bit_xor("x"), "k2": F.bit_xor("y"), "upto": F.sum("words")}
    within = Window.partitionBy("_part", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[value.over(within).alias(name) for name, value in sums.items()])
    # only the first conversation of a range can have begun before, as the last of earlier ranges
    borders = placed.groupBy("_part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"))
    ends = (
        placed.join(F.broadcast(borders.select("_part", F.col("last").alias("conv_id"))), ["_part", "conv_id"])
        .groupBy("_part", "conv_id")
        .agg(*[value.alias(name) for name, value in sums.items()])
        .withColumn("asks", F.lit(False))
    )
    nothing = [F.lit(0).cast("bigint").alias(name) for name in sums]
    asked = borders.select("_part", F.col("first").alias("conv_id"), *nothing, F.lit(True).alias("asks"))
    before = Window.partitionBy("conv_id").orderBy("_part", F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    carried = (
        ends.unionByName(asked)
        .select(
            "_part", "conv_id", "asks", F.bit_xor("k1").over(before).alias("c1"),
            F.bit_xor("k2").over(before).alias("c2"), F.sum("upto").over(before).alias("c3"),
        )
        .where("asks")
        .drop("asks")
    )
    met = local.join(F.broadcast(carried), ["_part", "conv_id"], "left")  # a row per range
    zero = F.lit(0).cast("bigint")
    return met.withColumns({
        "k1": F.col("k1").bitwiseXOR(F.coalesce("c1", zero)),
        "k2": F.col("k2").bitwiseXOR(F.coalesce("c2", zero)),
        "upto": F.col("upto") + F.coalesce("c3", zero),
    }).drop("_part", "c1", "c2", "c3")


# --- balanced parentheses -------------------------------------------------------------
class Parentheses:
    """A tree as balanced parentheses, with the least excess of each block and a tree above."""

    def __init__(self, opened: np.ndarray, size: int):
        bits = np.zeros(size, bool)
        bits[opened] = True
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1))
        blocks = -(-size // BLOCK)
        filled = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        filled[:size] = self.excess
        self.filled = filled.reshape(blocks, BLOCK)
        leaves = 1 << max(0, (blocks - 1).bit_length())
        self.leaves = leaves
        self.least = np.full(2 * leaves, np.iinfo(np.int64).max)
        self.least[leaves : leaves + blocks] = self.filled.min(axis=1)
        for node in range(leaves.bit_length() - 1, 0, -1):  # a level at a time, lowest first
            low, high = 1 << (node - 1), 1 << node
            self.least[low:high] = np.minimum(self.least[2 * low : 2 * high : 2], self.least[2 * low + 1 : 2 * high : 2])

    def close(self, opened: np.ndarray) -> np.ndarray:
        """Where each opening parenthesis is closed: the first place behind with one less excess."""
        out = np.empty(len(opened), np.int64)
        for begin in range(0, len(opened), 1 << 14):  # so many rows of blocks are in memory at once
            at = opened[begin : begin + (1 << 14)]
            out[begin : begin + len(at)] = self._close(at, self.excess[at] - 1)
        return out

    def _close(self, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        block = at // BLOCK
        inside = (self.filled[block] <= wanted[:, None]) & (np.arange(BLOCK) > (at % BLOCK)[:, None])
        here = inside.any(axis=1)
        # climb to the first block further right that falls as low, then descend to it
        node = block + self.leaves
        climbing = ~here
        while climbing.any():
            right = (node & 1 == 0) & (self.least[np.minimum(node + 1, len(self.least) - 1)] <= wanted)
            done = climbing & right
            node = np.where(done, node + 1, np.where(climbing, node >> 1, node))
            climbing &= ~done
        while True:
            above = ~here & (node < self.leaves)
            if not above.any():
                break
            left = self.least[np.where(above, 2 * node, 1)] <= wanted
            node = np.where(above, 2 * node + ~left, node)
        block = np.where(here, block, node - self.leaves)
        first = np.where(here, inside.argmax(axis=1), (self.filled[block] <= wanted[:, None]).argmax(axis=1))
        return block * BLOCK + first


def preorder(parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The place of each node before its children's; node 0 is the root, siblings by their numbers."""
    size = np.ones(len(parent), np.int64)
    by_depth = np.argsort(depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[by_depth], prepend=-1, append=depth.max() + 1))
    levels = [by_depth[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for level in reversed(levels[1:]):
        np.add.at(size, parent[level], size[level])
    place = np.zeros(len(parent), np.int64)
    for level in levels[1:]:
        level = level[np.argsort(parent[level], kind="stable")]
        before = np.cumsum(size[level]) - size[level]
        new = np.concatenate(([True], np.diff(parent[level]) > 0))
        place[level] = place[parent[level]] + 1 + before - np.maximum.accumulate(np.where(new, before, 0))
    return place


def shard_sums(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Per node of a shard (depth, k1, k2): the tails below it and what it and all below it save.

    ``rows`` are the ways of the shard's sequences from the root on, node by node.
    """
    keys = np.stack([rows["depth"], rows["k1"], rows["k2"]], axis=1)
    nodes, first, node = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    node = node.reshape(-1)
    parent = np.zeros(len(nodes), np.int64)
    parent[node[1:]] = np.where(rows["depth"][1:] > 0, node[:-1], 0)
    depth = nodes[:, 0]
    place = preorder(parent, depth)
    opened = 2 * place - depth  # before a node stand all earlier nodes, closed but for those above it
    tree = Parentheses(opened, 2 * len(nodes))
    closed = tree.close(opened)
    saved, tails = np.zeros(2 * len(nodes) + 1, np.int64), np.zeros(2 * len(nodes) + 1, np.int64)
    np.add.at(saved, opened[node] + 1, rows["saves"])
    tail = rows["tail"][first]
    pairs = tree.bits[opened] & ~tree.bits[np.minimum(opened + 1, 2 * len(nodes) - 1)]
    tails[opened + 1] = tail & pairs
    saved, tails = np.cumsum(saved), np.cumsum(tails)
    wide = ~tail  # a tail's own figures follow without the tree
    return {
        "depth": depth[wide], "k1": nodes[wide, 1], "k2": nodes[wide, 2],
        "n_leaves": (tails[closed + 1] - tails[opened])[wide],
        "saved": (saved[closed + 1] - saved[opened])[wide],
    }


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)  # a shard's rows, whose number is set
    table = pa.Table.from_batches(held) if held else None
    if table is not None and table.num_rows:
        rows = {name: table.column(name).to_numpy() for name in table.column_names}
        found = shard_sums(rows)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found.values()], names=list(found))


# --- digests of ids -------------------------------------------------------------------
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the id strings of each (depth, k1, k2), which come in order; one group is open at a time."""
    key, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        columns = [batch.column(name).to_pylist() for name in ("depth", "k1", "k2", "ids")]
        for depth, k1, k2, ids in zip(*columns, strict=True):
            if (depth, k1, k2) != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (depth, k1, k2), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield _digest_batch(done)
    if key is not None:
        yield _digest_batch([(*key, digest.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"depth": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays(
        [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds)
    )


def end_digests(conversations: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the ids that end at each node, ascending, joined by commas.

    Ids that share all but their last bits are joined first, so a node where any number of
    conversations end is read as few strings, one at a time.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    blocks = conversations.withColumn("_block", F.shiftright("conv_id", ID_BITS)).groupBy("depth", "k1", "k2", "_block")
    ordered = blocks.agg(ids.alias("ids")).repartition("depth", "k1", "k2")
    ordered = ordered.sortWithinPartitions("depth", "k1", "k2", "_block").drop("_block")
    return batches_mapped(ordered, _digests, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


# --- the trie -------------------------------------------------------------------------
NODE = ["depth", "k1", "k2"]


def trie_nodes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations: ``ids`` (conv_id), each once, with their ``turns``
    (conv_id, depth from 1 without gaps, a, b, words); an id may have none.

    A node is a different sequence of first turns. Returns conv_id (the smallest that starts so),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    sums = stored(running(turns), "sums")
    zero = F.lit(0).cast("bigint")
    totals = sums.groupBy("conv_id").agg(
        F.max("depth").alias("depth"), F.bit_xor("x").alias("k1"), F.bit_xor("y").alias("k2"), F.sum("words").alias("all")
    )
    whole = stored(
        ids.join(totals, "conv_id", "left").select(
            "conv_id", *[F.coalesce(c, zero).alias(c) for c in (*NODE, "all")]
        ), "conversations",
    )
    sequences = whole.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"), F.max("all").alias("all")
    ).select("conv_id", "copies", "all", F.col("depth").alias("turns"))
    sequences = stored(sequences, "sequences")
    ways = stored(sums.join(sequences, "conv_id"), "ways")
    above = (F.col("depth") - 1).alias("_depth"), F.col("k1").bitwiseXOR(F.col("x")).alias("_k1"), F.col("k2").bitwiseXOR(F.col("y")).alias("_k2")
    told = ways.select("*", *above)
    same = F.struct("a", "b", "_k1", "_k2")
    grouped = told.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("copies").alias("n_convs"),
        F.count(F.lit(1)).alias("ways"),
        F.max("words").alias("words"),
        F.max(F.col("all") - F.col("upto") + F.col("words")).alias("rest"),  # words from here on, of one way
        F.min(same).alias("least"),
        F.max(same).alias("most"),
    )
    clash = F.raise_error(F.lit("two different prefixes have one name"))
    named = grouped.select(
        *NODE, "conv_id", "n_convs", "ways", F.when(F.col("least") == F.col("most"), F.col("words")).otherwise(clash).alias("words"),
        "rest", (F.col("depth") - 1).alias("_depth"), "least._k1", "least._k2",
    )
    nowhere = F.lit(None).cast("bigint")
    root = sequences.agg(
        F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_convs"), F.count(F.lit(1)).alias("ways"),
        F.max("all").alias("rest"),
    ).where("ways > 0").select(
        *[zero.alias(c) for c in NODE], "conv_id", "n_convs", "ways", zero.alias("words"), "rest",
        *[nowhere.alias(c) for c in ("_depth", "_k1", "_k2")],
    )
    nodes = stored(named.unionByName(root), "nodes")
    up = nodes.select(
        *[F.col(c).alias(f"_{c}") for c in NODE], F.col("conv_id").alias("parent_conv_id"), F.col("ways").alias("parent_ways")
    )
    children = nodes.where("depth > 0").groupBy("_depth", "_k1", "_k2").agg(F.count(F.lit(1)).alias("n_children"))
    children = children.select(*[F.col(f"_{c}").alias(c) for c in NODE], "n_children")
    linked = stored(nodes.join(up, ["_depth", "_k1", "_k2"], "left").drop("_depth", "_k1", "_k2"), "linked")
    below = shard_figures(ways, sequences, linked)
    # one way goes on alone from here: one leaf, and each turn saves for each copy but one
    alone = F.col("ways") == 1
    full = linked.join(children, NODE, "left").join(below, NODE, "left").join(end_digests(whole), NODE, "left")
    return full.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        F.when(alone, F.lit(1).cast("bigint")).otherwise(F.col("n_leaves")).alias("n_leaves"),
        F.when(alone, (F.col("n_convs") - 1) * F.col("rest")).otherwise(F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def shard_figures(ways: DataFrame, sequences: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, k1, k2, n_leaves, saved) of the nodes that several sequences pass, added up over the shards.

    Of a sequence go to its shard the nodes it shares and the first of its own, which stands for
    its tail. A node saves in the shard that holds its smallest conversation; the same
    number elsewhere is 0, and every shard that holds a node holds what it adds below it.
    """
    zero = F.lit(0).cast("bigint")
    kept = nodes.where((F.col("ways") > 1) | (F.coalesce("parent_ways", zero) > 1)).select(
        *NODE, "n_convs", "ways", "words", "rest", F.col("conv_id").alias("_owner")
    )
    # the root is on every way
    steps = ways.select("conv_id", *NODE).unionByName(sequences.select("conv_id", *[zero.alias(c) for c in NODE]))
    tail = F.col("ways") == 1
    saves = (F.col("n_convs") - 1) * F.when(tail, F.col("rest")).otherwise(F.col("words"))
    met = steps.join(kept, NODE).select(
        "conv_id", *NODE, F.when(F.col("_owner") == F.col("conv_id"), saves).otherwise(zero).alias("saves"), tail.alias("tail")
    )
    met = stored(met, "steps")
    marks = [F.max(F.when(F.col("depth") == i, F.col("k1"))).alias(f"_m{i}") for i in range(1, ORDERED + 1)]
    order = [f"_m{i}" for i in range(1, ORDERED + 1)] + ["conv_id"]
    placed = met.join(met.groupBy("conv_id").agg(*marks), "conv_id")
    shards = max(1, -(-met.count() // SHARD_ROWS))
    dealt = placed.repartitionByRange(shards, *order).sortWithinPartitions(*order, "depth")
    found = batches_mapped(
        dealt.select(*NODE, "saves", "tail"), _shard,
        "depth bigint, k1 bigint, k2 bigint, n_leaves bigint, saved bigint",
    )
    return found.groupBy(*NODE).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are; see ``trie_nodes``.

    Turns go by number, null first, ties by content; repeated rows are repeated turns. A null role
    or text is empty. Rows without conv_id are left out; further columns are not read. An empty
    table has no node.
    """
    turns = stored(numbered_turns(conversations), "numbered")
    ids = turns.where("p = 0").select("conv_id")
    return trie_nodes(turns.select("conv_id", (F.col("p") + 1).alias("depth"), "a", "b", "words"), ids)


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The same for the rebuilt conversations, which share first turns within their group."""
    return trie_nodes(*rebuilt_turns(conversations))


# the CRC-32 of a decimal id, byte by byte and bit by bit
CRC_SQL = """xor(4294967295::ubigint, list_reduce(
    list_prepend(4294967295::ubigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: ascii(x)::ubigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::ubigint[]),
      lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)))"""
SQL = rf"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, digest) - 1 as p, digest, words
  from (select conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest,
      len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as words
    from conversations where conv_id is not null)),
ids as (select conv_id, conv_id - conv_id % {GROUP} as base, {CRC_SQL} % {MOST} as h from (select distinct conv_id from turns)),
rebuilt as (
  select i.conv_id, 0 as own, t.p, digest, words from ids i join turns t on t.conv_id = i.base and t.p < i.h
  union all select i.conv_id, 1, t.p, digest, words from ids i join turns t on t.conv_id = i.conv_id and t.p >= i.h),
ways as (
  select conv_id, row_number() over w as depth, list(digest) over w as path, words
  from rebuilt window w as (partition by conv_id order by own, p)
  union all select conv_id, 0, [], 0 from ids),
nodes as materialized (
  select path, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words
  from ways group by path),
children as (select path[:depth - 1] as path, count(*) as n_children from nodes where depth > 0 group by all),
below as (select distinct a.path, b.path as lower from ways a join ways b on a.conv_id = b.conv_id and a.depth <= b.depth),
sums as (
  select b.path, count(*) filter (c.path is null) as n_leaves, sum((n.n_convs - 1) * n.words) as saved_tokens
  from below b join nodes n on n.path = b.lower left join children c on c.path = b.lower group by b.path),
ends as (
  select path, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids
  from (select conv_id, arg_max(path, depth) as path from ways group by conv_id) group by path)
select n.conv_id, n.depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves,
  cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from nodes n left join nodes u on n.depth > 0 and u.path = n.path[:n.depth - 1]
join sums s on s.path = n.path left join children c on c.path = n.path left join ends e on e.path = n.path"""
