"""SimHash fingerprints and their links, found at the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.plans.components import components, local_roots
from quillmill.llm.tables import batches_mapped, shielded, stored

SHINGLE = 3
SEED = 42
THRESHOLD = 3
CELL = 4096
CODED = 31
HALF = 32
ROW_BYTES = 32  # of a row number in a table sent to every task
SENT_BYTES = 32 << 20


def fingerprint(text: str, shingle: int = SHINGLE, hashed=partial(xxhash.xxh64_intdigest, seed=SEED)) -> int:
    """The 64-bit fingerprint of a whole text, unsigned; a text without words has 0.

    A bit is set if it is set in over half the hashes of the text's word shingles, repeats
    included. A text with fewer words than a shingle takes is one shingle.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    runs = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[b" ".join(words)]]
    hashes = np.array([hashed(b" ".join(run)) for run in zip(*runs, strict=False)], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.uint32) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: bool = False) -> DataFrame:
    """``docs`` with ``fingerprint`` as a signed 64-bit number, in place of the text or, if asked, beside it."""
    dropped = ("fingerprint", "component_id") if text else ("text", "fingerprint", "component_id")
    kept = [c for c in docs.columns if c not in dropped]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "fingerprint bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t or "", shingle) for t in batch.column("text").to_pylist()]
            signed = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), signed], [*kept, "fingerprint"])

    return batches_mapped(docs.select(*kept, *(() if text else ("text",))), run, schema)


def decoded(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest anchor, syndrome) of 32-bit words.

    Anchors are the code words of the perfect Hamming code over the low 31 bits, with the
    top bit free. Every word is an anchor or differs from exactly one in a single bit, so
    the covering radius is 1. The syndrome is the number of that bit, from 1, or 0.
    """
    syndrome = np.zeros(len(words), np.uint64)
    for i in range(CODED):
        syndrome ^= (words >> np.uint64(i) & np.uint64(1)) * np.uint64(i + 1)
    return words ^ single_bit(syndrome), syndrome


def single_bit(place: np.ndarray) -> np.ndarray:
    """The word with the one bit numbered ``place`` from 1; 0 has none."""
    return np.where(place > 0, np.uint64(1) << (np.maximum(place, np.uint64(1)) - np.uint64(1)), np.uint64(0))


def anchor_rows(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, whether it is the nearest one) for all fingerprints.

    Two fingerprints that differ in 3 bits differ in at most 1 bit in one of their halves.
    In each half a fingerprint goes to every anchor within covering radius plus that
    threshold, 1 + 1 bits: if x and y differ in at most one bit there, y is at x's nearest
    anchor. These are at most 17 anchors a half.
    """
    index, anchors, nearest = [], [], []
    every = np.arange(len(prints))
    for side in range(2):
        words = prints >> np.uint64(HALF * side) & np.uint64(0xFFFFFFFF)
        own, syndrome = decoded(words)
        tag = np.uint64(side) << np.uint64(HALF)
        found = [(every, own, True), (every, own ^ np.uint64(1 << CODED), False)]
        for i in range(CODED):
            # one bit away from the word, the nearest anchor differs in bit i and in this one
            other = syndrome ^ np.uint64(i + 1)
            once = other > i + 1  # the pair of bits is met from either side
            one = words[once] ^ np.uint64(1 << i) ^ single_bit(other[once])
            found.append((every[once], one, False))
        for at, anchor, home in found:
            index.append(at)
            anchors.append(anchor | tag)
            nearest.append(np.full(len(at), home))
    return np.concatenate(index), np.concatenate(anchors).view(np.int64), np.concatenate(nearest)


def links_of_cells(cells: np.ndarray, prints: np.ndarray, nodes: np.ndarray, home: np.ndarray, bits: int):
    """(node, smaller node) stars of the links inside each cell; rows are sorted by cell.

    In a cell every fingerprint that has its nearest anchor there is compared with all.
    Cells of a few rows are compared all at once, row by row to the next, larger ones in
    blocks. Only stars leave a cell, not its pairs.
    """
    edges = np.flatnonzero(np.diff(cells)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(cells)]])
    sizes = ends - starts
    a, b = [], []
    small = np.repeat(sizes <= 16, sizes)
    for step in range(1, 16):
        at = np.flatnonzero(small[:-step] & (cells[step:] == cells[:-step])) if len(cells) > step else np.empty(0, int)
        if not len(at):
            break
        at = at[home[at] | home[at + step]]
        near = apart(prints[at], prints[at + step]) <= bits
        a.append(nodes[at[near]])
        b.append(nodes[at[near] + step])
    for s, e in zip(starts[sizes > 16], ends[sizes > 16], strict=True):
        own = np.flatnonzero(home[s:e])
        x, y = [], []
        rows = max(1, 256 // prints.shape[1])
        for block in range(0, len(own), rows):
            part = own[block : block + rows]
            i, j = np.nonzero(apart(prints[s + part][:, None], prints[None, s:e]) <= bits)
            x.append(part[i])
            y.append(j)
            if sum(map(len, x)) > 1 << 20:  # many links: keep their stars only
                x, y = stars(e - s, x, y)
        x, y = stars(e - s, x, y)
        group = nodes[s:e]
        order = np.argsort(group, kind="stable")  # the smallest node of a star is its root
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        root = local_roots(e - s, rank[x[0]], rank[y[0]])
        a.append(group)
        b.append(group[order[root[rank]]])
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    return a[a != b], b[a != b]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits fingerprints differ; their words are the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.uint16)


def stars(count: int, x: list, y: list) -> tuple[list, list]:
    """Links that reach the same from each other as (x, y) do, one per row at most."""
    if not x:
        return [np.empty(0, int)], [np.empty(0, int)]
    root = local_roots(count, np.concatenate(x), np.concatenate(y))
    away = np.flatnonzero(root != np.arange(count))
    return [away], [root[away]]


def near_links(prints: DataFrame, bits: int = THRESHOLD, cell: int = CELL) -> DataFrame:
    """(a, b): links that join what can be reached by fingerprints ``bits`` (3) or fewer bits apart.

    ``prints`` has a row (fingerprint, node) per different fingerprint.
    """
    if bits > THRESHOLD:
        raise ValueError("the anchors cover at most 3 differing bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fingerprint").to_numpy().view(np.uint64)
            nodes = batch.column("node").to_numpy()
            at, anchors, home = anchor_rows(prints)
            columns = [anchors, nodes[at], home, prints[at].view(np.int64)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["anchor", "node", "home", "w0"])

    rows = batches_mapped(
        prints.select("fingerprint", "node"), spread, "anchor bigint, node bigint, home boolean, w0 bigint"
    )
    return cell_links(rows, ["w0"], bits, cell)


def cell_links(rows: DataFrame, words: list[str], bits: int, cell: int = CELL) -> DataFrame:
    """(a, b): links between the nodes of ``rows`` (anchor, node, home, words) that meet at an anchor.

    At every anchor those at ``home`` there are compared with all. A cell of more than
    ``cell`` rows is cut into that many slices of the rows at home and of all rows, and each
    pair of slices is a cell of its own, so no task holds more than a slice pair at a time
    and nothing is left out.
    """
    placed = cut_cells(rows, words, cell)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["cell", *words, "node", "home"]
        for cells, *prints, nodes, home in whole_cells(batches, columns):
            yield link_batch(*links_of_cells(cells, np.column_stack(prints).view(np.uint64), nodes, home, bits))

    return batches_mapped(placed, compare, "a bigint, b bigint").distinct()


def cut_cells(rows: DataFrame, words: list[str], cell: int) -> DataFrame:
    """(cell, node, home, words) of ``rows``, each cell whole in one task, large ones as pairs of slices."""
    hot = stored(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell), "hot-anchors")
    slices = F.coalesce(F.ceil(F.col("n") / cell), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("node"), slices).cast("int")
    every = F.sequence(F.lit(0), F.col("_slices") - 1)
    rows = rows.join(hot, "anchor", "left").withColumn("_slices", slices).withColumn("_own", own)
    # slice pair (i, j) has the rows at home of slice i and all of slice j
    nearest = rows.where("home").select("*", F.explode(every).alias("_j")).withColumn("_i", F.col("_own"))
    others = rows.where("not home or _slices > 1").select("*", F.explode(every).alias("_i")).withColumn(
        "_j", F.col("_own")
    ).withColumn("home", F.lit(False))
    columns = ["anchor", "_i", "_j", "node", "home", *words]
    pairs = nearest.select(*columns).union(others.select(*columns))
    # one number per cell; only cells of cut anchors have a slice above 0
    cells = pairs.withColumn(
        "cell", F.when((F.col("_i") == 0) & (F.col("_j") == 0), F.col("anchor")).otherwise(
            F.xxhash64("anchor", "_i", "_j"))
    ).select("cell", "node", "home", *words)
    return cells.repartition("cell").sortWithinPartitions("cell")


def whole_cells(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches as arrays, cut where the first one changes."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if rest is not None:
            new = [np.concatenate(x) for x in zip(rest, new, strict=True)]
        if not len(new[0]):
            continue
        cut = np.searchsorted(new[0], new[0][-1])  # the last cell may go on in the next batch
        rest = [x[cut:] for x in new]
        if cut:
            yield [x[:cut] for x in new]
    if rest is not None and len(rest[0]):
        yield rest


def link_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the text, with fingerprint and component_id.

    component_id is the smallest doc_id reachable by links. Documents of one fingerprint are
    one node, so a group of copies, however large, is compared once. A null text has no
    words, a null id is no component's smallest; documents all of whose partners have null
    ids have a null component. An empty table gives an empty table.
    """
    marked = stored(with_fingerprints(docs, shingle), "fingerprints")
    nodes = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").cast("bigint").alias("node")), "nodes")
    roots = components(near_links(nodes.where("node is not null"), bits))
    # hot fingerprints are on the left only, where adaptive execution can split them
    roots = nodes.join(roots, "node", "left").select("fingerprint", F.coalesce("root", "node").alias("component_id"))
    return marked.join(roots, "fingerprint", "left")


def hexadecimal(fingerprint) -> F.Column:
    """A fingerprint as 16 lower-case digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs``."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", hexadecimal("fingerprint").alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = THRESHOLD) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; columns unchanged.

    Groups are what links of ``bits`` or fewer differing bits reach, of fingerprints over
    ``shingle`` words; rows are judged by their text alone, so ids may repeat. Of a group without
    any id, and of rows of one id, one stays. A null text has no words and the fingerprint zero.
    The table is fingerprinted once and written with row numbers; what follows moves numbers,
    and texts only where more rows go than are named to every task (``SENT_BYTES``).
    """
    rows, back = shielded(docs, {"fingerprint", "component_id", "_row"})
    printed = with_fingerprints(rows, shingle, text=True).withColumn("_row", F.monotonically_increasing_id())
    marked = stored(printed, "fingerprinted")
    # the smallest id of each fingerprint first: copies of one text are many
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    nodes = stored(
        marked.groupBy("fingerprint").agg(first).withColumn("node", F.col("fingerprint")), "fingerprint-nodes"
    )
    roots = components(near_links(nodes, bits))
    grouped = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    gone = stored(marked.select("_row").join(grouped.select("first._row"), "_row", "left_anti"), "gone")
    few = gone.count() * ROW_BYTES <= SENT_BYTES
    kept = marked.join(F.broadcast(gone) if few else gone, "_row", "left_anti")
    return kept.select(*rows.columns).withColumnsRenamed(back)
