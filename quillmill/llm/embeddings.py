"""Near duplicates among vectors: whole-number products of int8 tiles with bounds on their error."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.plans.components import components, local_roots
from quillmill.llm.tables import batches_mapped, stored
from quillmill.plans.ids import with_dense_ids
from quillmill.plans.shipping import ship

THRESHOLD = 0.9
BLOCK = 8192
LEAST_BLOCKS = 6
TILE = 512
LEVELS = 127
EXACT = 1024  # components whose products sum up to less than 2^24 in size
ROUNDING = 2.0**-20  # more than single precision can lose in scaling a product
CODED = ["codes", "scale", "error", "length"]
LINKS = "first int, second int, node bigint, links bigint, root bigint, open boolean"


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, error) of unit vectors in rows.

    A vector is scale * codes plus a remainder of length at most ``error``, taken in double
    precision and rounded up.
    """
    scale = np.abs(vectors).max(axis=1) / LEVELS
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(vectors - scale[:, None] * codes, axis=1)
    return codes, scale, error * (1 + 1e-9) + 1e-12


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that neither large nor small components overflow."""
    vectors = vectors / np.abs(vectors).max(axis=1)[:, None]
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


class Side:
    """The quantised vectors of a block, with what bounds their products; full vectors where they were fetched."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, codes: np.ndarray, scale: np.ndarray,
                 error: np.ndarray, length: np.ndarray, vectors: np.ndarray | None = None):
        self.nodes, self.copies, self.vectors = nodes, copies, vectors
        self.scale, self.error, self.length = scale, error, length
        self.codes = codes.astype(np.float32)


def code_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All products of codes from -127 to 127 in rows, exact.

    Single precision holds every whole number up to 2^24, so the sums over ``EXACT`` components
    have no rounding, in whatever order they are taken; longer vectors are summed in parts.
    """
    total = left[:, :EXACT] @ right[:, :EXACT].T
    for start in range(EXACT, left.shape[1], EXACT):
        part = left[:, start : start + EXACT] @ right[:, start : start + EXACT].T
        total = total.astype(np.float64) + part
    return total


def tile_pairs(a: Side, b: Side, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sure) of all pairs of two sides that may reach the threshold, tile by tile.

    With u = u' + e and v = v' + f, where u' and v' are the quantised vectors and u, v have
    length 1, u.v = u'.v' + u'.f + e.v, so the cosine is within |u'| |f| + |e| of u'.v', which
    is the product of the codes times both scales. A tile is first held against the bound with
    the largest |f| of the side, then each pair that is left against its own: ``sure`` pairs
    reach the threshold whatever the errors are, the others are open.
    """
    least = ((threshold - ROUNDING - a.error - a.length * b.error.max()) / a.scale).astype(np.float32)[:, None]
    scale = b.scale.astype(np.float32)
    for start in range(0, len(a.nodes), TILE):
        exact = code_products(a.codes[start : start + TILE], b.codes)
        i, j = np.nonzero(exact * scale >= least[start : start + TILE])
        product = exact[i, j].astype(np.float64)
        i += start
        product *= a.scale[i] * b.scale[j]
        allowance = a.length[i] * b.error[j] + a.error[i]
        possible = product + allowance >= threshold - 1e-9
        sure = product - allowance >= threshold + 1e-9
        yield i[possible], j[possible], sure[possible]


def reaching(a: Side, b: Side, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold by their full vectors, in double precision."""
    found = np.zeros(len(i), bool)
    for part in range(0, len(i), 1 << 16):
        at = slice(part, part + (1 << 16))
        found[at] = np.einsum("ij,ij->i", a.vectors[i[at]], b.vectors[j[at]]) >= threshold
    return found


def block_links(a: Side, b: Side, same: bool, threshold: float) -> tuple[np.ndarray, ...]:
    """(node, vectors linked to it, smallest node it is joined to, is open) for a pair of blocks.

    Without full vectors the links are those that are sure, and nodes with open pairs are named
    as well; with full vectors the links are those of the open pairs.
    """
    count = len(a.nodes) + (0 if same else len(b.nodes))
    nodes = a.nodes if same else np.concatenate([a.nodes, b.nodes])
    order = np.argsort(nodes)
    rank = np.empty_like(order)
    rank[order] = np.arange(count)
    shift = 0 if same else len(a.nodes)
    linked, root, is_open = np.zeros(count), np.arange(count), np.zeros(count, bool)
    for i, j, sure in tile_pairs(a, b, threshold):
        if same:
            i, j, sure = (x[i != j] for x in (i, j, sure))
        if a.vectors is None:
            is_open[i[~sure]] = is_open[j[~sure] + shift] = True
            i, j = i[sure], j[sure]
        else:
            i, j = i[~sure], j[~sure]
            found = reaching(a, b, i, j, threshold)
            i, j = i[found], j[found]
        if not len(i):
            continue
        linked += np.bincount(i, b.copies[j], count)
        if not same:
            linked += np.bincount(j + shift, a.copies[i], count)
        away = np.flatnonzero(root != np.arange(count))  # what earlier tiles have joined
        root = local_roots(count, np.concatenate([rank[i], away]), np.concatenate([rank[j + shift], root[away]]))
    at, still = np.flatnonzero(linked), np.flatnonzero(is_open)
    return (
        np.concatenate([nodes[at], nodes[still]]),
        np.concatenate([linked[at].astype(np.int64), np.zeros(len(still), np.int64)]),
        np.concatenate([nodes[order[root[rank[at]]]], nodes[still]]),
        np.arange(len(at) + len(still)) >= len(at),
    )


def vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quantise vectors: (node, copies, block, size, vector, codes, scale, error, length)."""
    for batch in batches:
        for rows, vectors in by_size(batch.column("embedding")):
            units = unit_rows(vectors)
            codes, scale, error = quantised(units)
            length = np.linalg.norm(scale[:, None] * codes, axis=1) * (1 + 1e-9)
            kept = [batch.column(c).take(pa.array(rows)) for c in ("node", "copies", "block")]
            packed = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (units, codes)]
            size = pa.array(np.full(len(rows), vectors.shape[1], np.int32))
            yield pa.RecordBatch.from_arrays(
                [*kept, size, *packed, pa.array(scale), pa.array(error), pa.array(length)],
                ["node", "copies", "block", "size", "vector", *CODED],
            )


def by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the lists of each length."""
    sizes = column.value_lengths().to_numpy()
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy().astype(np.float64).reshape(-1, size)


def side(table: pa.Table) -> Side:
    size = table["size"][0].as_py()

    def matrix(column: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(table[column].to_pylist()), kind).reshape(-1, size)

    numbers = (table[c].to_numpy() for c in ("scale", "error", "length"))
    vectors = matrix("vector", np.float64) if "vector" in table.column_names else None
    return Side(table["node"].to_numpy(), table["copies"].to_numpy(), matrix("codes", np.int8), *numbers, vectors)


def compare_blocks(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        first, second = table["first"][0].as_py(), table["second"][0].as_py()
        found = [(*[np.empty(0, np.int64)] * 3, np.empty(0, bool))]
        sizes = table["size"].to_numpy()
        for size in np.unique(sizes):  # vectors of different lengths have no cosine
            rows = table.filter(pa.array(sizes == size))
            blocks = rows["block"].to_numpy()
            sides = [rows.filter(pa.array(blocks == b)) for b in sorted({first, second})]
            if all(x.num_rows for x in sides):
                sides = [side(x) for x in sides]
                found.append(block_links(sides[0], sides[-1], first == second, threshold))
        columns = dict(zip(["node", "links", "root", "open"], map(np.concatenate, zip(*found, strict=True)), strict=True))
        pair = {"first": np.full(len(columns["node"]), first, np.int32), "second": np.full(len(columns["node"]), second, np.int32)}
        return pa.table(pair | columns)

    return compare


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, ...).

    Vectors link whose cosine in double precision is ``threshold`` or more. Equal vectors
    are compared once, with the number of their copies, so a group of copies costs no more
    than one vector. The different vectors are numbered in the order of their smallest ids
    and cut into blocks of ``block``; each pair of blocks is one group of work, to which codes
    and bounds travel, in which tiles are multiplied in whole numbers and which only counts,
    stars and the nodes of open pairs leave, not pairs. Open pairs are computed again in double
    precision, with the full vectors of their nodes alone. Every vector meets every other once,
    as the method has it: work grows with the square of the different vectors, divided over
    the block pairs.

    Vectors that are null, empty or zero, or hold null, infinite or undefined components,
    link with nothing, nor do vectors of different lengths. A row without an id links with
    nothing. Rows may repeat; each counts as a vector. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(finite & F.col("vec_id").isNotNull(), F.col("embedding")).alias("embedding"))
    usable = rows.where("embedding is not null")
    different = usable.groupBy("embedding").agg(F.min("vec_id").alias("label"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(with_dense_ids(different, [F.col("label"), F.xxhash64("embedding")], "node"), "vectors")
    total = nodes.count()
    blocks = max(LEAST_BLOCKS, math.ceil(total / block))
    per_block = max(1, math.ceil(total / blocks))
    kinds = "node bigint, copies bigint, block int, size int, vector binary, codes binary, scale double, error double, length double"
    placed = nodes.select("node", "copies", "embedding", F.floor(F.col("node") / per_block).cast("int").alias("block"))
    coded = stored(batches_mapped(placed, vector_rows, kinds), "codes")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other")
    paired = coded.select("node", "copies", "block", "size", *CODED, other).withColumn(
        "first", F.least("block", "_other")
    ).withColumn("second", F.greatest("block", "_other")).drop("_other")
    ship(spark)
    met = stored(paired.groupBy("first", "second").applyInArrow(compare_blocks(threshold), LINKS), "vector-links")
    # of pairs that the errors leave open, only the nodes are named; their full vectors come by a join
    fetched = met.where("open").select("first", "second", "node").join(coded, "node")
    again = stored(fetched.groupBy("first", "second").applyInArrow(compare_blocks(threshold), LINKS), "open-links")
    found = met.where(~F.col("open")).union(again)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = roots.join(nodes.select(F.col("node").alias("root"), F.col("label").alias("component_id")), "root")
    known = (
        nodes.join(links, "node", "left")
        .join(roots.drop("root"), "node", "left")
        .select(
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "label").alias("component_id"),
        )
    )
    # a vector with many copies is on the left only, where adaptive execution can split it
    return rows.join(known, "embedding", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").cast("bigint").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
