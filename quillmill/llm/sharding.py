"""Sharding by balanced label propagation: linked documents gather, sizes stay even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.tables import stored
from quillmill.plans.ids import with_dense_ids

SHARDS = 8
ROUNDS = 8


def unit(*columns: str) -> Column:
    """A number from 0 to 1 that looks random but depends on the columns only."""
    return (F.xxhash64(*columns) / F.lit(float(1 << 64)) + 0.5).cast("double")


def shard_loads(df: DataFrame, shards: int, condition: Column | None = None) -> list[int]:
    """Rows per shard; a row per shard comes to the driver."""
    rows = (df if condition is None else df.where(condition)).groupBy("shard").count().collect()
    found = {r["shard"]: r["count"] for r in rows}
    return [found.get(k, 0) for k in range(shards)]


def pick(values: list, index: Column) -> Column:
    """The value of a short list at a position that a column gives."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def propagate(members: DataFrame, capacity: list[int], rounds: int) -> DataFrame:
    """``members`` (hub, node, shard) after the rounds, with ``votes``: neighbours in the own shard.

    A hub links its nodes with each other. Each round counts the nodes of every hub per
    shard and hands the counts back to the nodes by a join; every node asks for the shard in
    which most of its hub is, of those with room for the rest of the hub, or for some of it
    if none has; the hub's nodes agree on ties. A
    shard grants requests up to its room: what its capacity leaves beside the linked nodes
    it has, as nodes without links can give way. Hubs that a shard can hold come first, and if
    there is no room for all, by a hash; hubs larger than a shard get what is left, their
    nodes by a hash, and pass over shards with under a twentieth of their capacity left. The
    rounds end when nothing moves. Counts are combined before the shuffle, so a hub may hold any share of
    the nodes; only numbers per shard come to the driver.
    """
    shards = len(capacity)
    members = stored(members, "members-0")
    for i in range(rounds):
        room = [max(c - n, 0) for c, n in zip(capacity, shard_loads(members, shards), strict=True)]
        counts = members.groupBy("hub").agg(
            *[F.sum((F.col("shard") == k).cast("bigint")).alias(f"_{k}") for k in range(shards)]
        )
        turn = F.pmod(F.xxhash64("hub"), F.lit(shards))  # whom a tie favours
        ranked = F.array_sort(
            F.array(
                *[
                    F.struct((-F.col(f"_{k}")).alias("n"), F.pmod(F.lit(k) - turn, F.lit(shards)).alias("t"), F.lit(k).alias("k"))
                    for k in range(shards)
                ]
            )
        )
        total = sum((F.col(f"_{k}") for k in range(shards)), F.lit(0))
        hubs = counts.select(
            "hub",
            total.alias("_size"),
            F.array(*[F.col(f"_{k}") for k in range(shards)]).alias("_counts"),
            F.transform(ranked, lambda x: x["k"]).alias("_order"),
        )
        # written first, so that only a scan stands on this side of the join and hot hubs can be split
        asked = members.join(stored(hubs, f"hubs-{i}"), "hub")
        # the best shard that takes the whole hub, else the best that is the own one or has room
        whole = F.filter("_order", lambda k: pick(room, k) >= F.col("_size") - F.element_at("_counts", k + 1))
        open_to = F.filter("_order", lambda k: (k == F.col("shard")) | (pick(room, k) > min(capacity) // 20))
        want = F.coalesce(F.get(whole, F.lit(0)), F.element_at(open_to, 1)).cast("int")
        asked = asked.withColumn("_want", want).drop("_order", "_counts")
        asked = stored(asked, f"asked-{i}")
        moving = F.col("_want") != F.col("shard")
        large = F.col("_size") > min(capacity)
        wishes = asked.where(moving).groupBy("_want", large.alias("large")).count().collect()
        if not wishes:
            members = asked
            break
        demand = {(r["_want"], r["large"]): r["count"] for r in wishes}
        small_first = [(min(r, demand.get((k, False), 0)), r) for k, r in enumerate(room)]
        whole_hubs = [n / max(1, demand.get((k, False), 0)) for k, (n, _) in enumerate(small_first)]
        parts = [min(1.0, (r - n) / max(1, demand.get((k, True), 0))) for k, (n, r) in enumerate(small_first)]
        granted = F.when(large, unit("node", "hub", "_round") < pick(parts, F.col("_want"))).otherwise(
            unit("hub", "_round") < pick(whole_hubs, F.col("_want"))
        )
        asked = asked.withColumn("_round", F.lit(i))
        shard = F.when(moving & granted, F.col("_want")).otherwise(F.col("shard"))
        members = stored(asked.select("hub", "node", shard.alias("shard")), f"members-{i + 1}")
    counts = members.groupBy("hub", "shard").agg((F.count(F.lit(1)) - 1).alias("votes"))
    return members.select("hub", "node", "shard").join(stored(counts, "votes"), ["hub", "shard"])


def balanced_shards(docs: DataFrame, hub: str, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with ``shard`` from 0 and ``slot`` from 0 without gaps in each shard.

    Documents that share a value of ``hub`` are linked; a null links with nothing. Row
    counts of the shards differ by one at most. Documents start at random and the linked
    ones move by ``propagate``. Then each shard keeps, up to its capacity, its documents in
    the order of votes, so those without links leave first, and a hub's documents stand
    together; what is over fills the shards that are short. Ranks come from range
    partitions, not from one sort per shard.
    """
    docs = docs.drop("node", "shard", "slot")
    placed = with_dense_ids(docs, [F.col(hub), *[F.col(c) for c in docs.columns if c != hub]], "node")
    placed = stored(placed, "nodes")
    total = placed.count()
    capacity = [total // shards + (k < total % shards) for k in range(shards)]
    start = F.least(F.floor(unit("node") * shards), F.lit(shards - 1)).cast("int")
    linked = placed.where(F.col(hub).isNotNull()).groupBy(hub).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = placed.join(stored(linked.select(hub), "linked"), hub).select(F.col(hub).alias("hub"), "node", start.alias("shard"))
    moved = propagate(members, capacity, rounds)
    state = placed.select("node", start.alias("_start")).join(moved, "node", "left").select(
        "node", F.coalesce("shard", "_start").alias("shard"), F.coalesce("votes", F.lit(0)).alias("votes"), "hub"
    )
    order = [F.col("shard"), F.col("votes").desc(), F.col("hub").asc_nulls_last(), F.col("node")]
    ranked = stored(with_dense_ids(state, order, "rank"), "ranked")
    loads = shard_loads(ranked, shards)
    before = [sum(loads[:k]) for k in range(shards)]
    rank = F.col("rank") - pick(before, F.col("shard"))
    ranked = ranked.select("node", "shard", rank.alias("slot"), "votes", "hub")
    cap = pick(capacity, F.col("shard"))
    kept = ranked.where(F.col("slot") < cap).select("node", "shard", "slot")
    over = ranked.where(F.col("slot") >= cap)
    over = with_dense_ids(over, [F.col("votes").desc(), F.col("hub").asc_nulls_last(), F.col("node")], "turn")
    # the free slots, shard by shard, in the order of turns
    short = [max(c - n, 0) for c, n in zip(capacity, loads, strict=True)]
    until = [sum(short[: k + 1]) for k in range(shards)]
    target = F.size(F.filter(F.array(*[F.lit(u) for u in until]), lambda u: u <= F.col("turn")))
    at = F.col("turn") - pick([u - s for u, s in zip(until, short, strict=True)], target)
    filled = over.select(
        "node", target.alias("shard"), (at + pick([min(c, n) for c, n in zip(capacity, loads, strict=True)], target)).alias("slot")
    )
    return placed.join(kept.union(filled), "node").drop("node")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``.

    Size is the text's UTF-8 bytes plus 1. The law is ``rows``: shard counts differ by one
    at most. Documents of equal texts are linked; a null text is an empty one. Repeated rows
    are rows of their own. ``grown_shard`` belongs to another law and is null.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("_text"),
    )
    return balanced_shards(narrow, "_text", shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
