"""Repeated passages by suffixes: difference-cover samples settle the long ties, buckets the rest.

Suffixes matter to a depth of ``LENGTH`` bytes only. A difference cover of period v gives,
for any two positions, a shift below v that brings both onto sample positions. So two equal
windows of ``LENGTH`` bytes hold a pair of samples whose next LENGTH - v + 1 bytes are equal.
Ranks of samples, here 64-bit names that are equal for equal strings, are worked out once
and decide the long repeats: inside a repeat some sample window of full length occurs at
least every v bytes. What is left are the windows at the edges of repeats and short repeats;
those, and the windows that could be equal to them, are sorted.

Every sort goes bucket by bucket: names are dealt out by their first bits, a bucket is
sorted alone, and the memory it takes is set by the number of buckets. Texts never move;
they lie in packs in a bucketed table, beside which the answers are joined.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Generator, Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.tables import batches_mapped, stored
from quillmill.plans.shipping import ship
from quillmill.plans.storage import new_path

LENGTH = 200
COVER_PRIME = 11
PACK_BYTES = 2 << 20
BUCKET_BYTES = 2 << 20
ROUNDS = 4
# odd numbers with well spread bits: the base of the names, and two to mix them
BASE, MIX, MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def difference_cover(q: int = COVER_PRIME) -> tuple[int, np.ndarray]:
    """(period, cover) for a prime q: q + 1 residues whose differences are all residues.

    The period is q*q + q + 1. The cover are the powers of a root of a cubic over the field
    of q elements that need no square of the root (Singer's construction).
    """
    period = q * q + q + 1
    for a, b, c in product(range(q), range(q), range(1, q)):
        cover, power = [], (1, 0, 0)
        for i in range(period):
            if power[2] == 0:
                cover.append(i)
            x, y, z = power
            power = (c * z % q, (x + b * z) % q, (y + a * z) % q)
        if len({(i - j) % period for i in cover for j in cover}) == period and len(cover) == q + 1:
            return period, np.array(cover)
    raise ValueError(f"{q} is not a prime")


class Names:
    """Names of the substrings of a pack: equal for equal strings of equal length.

    A polynomial over random byte values, from prefix sums, mixed so that the first bits
    are spread. Unequal strings share a name with a chance of about 2**-64 a pair.
    """

    def __init__(self, data: np.ndarray):
        values = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
        with np.errstate(over="ignore"):
            powers = np.full(len(data) + 1, BASE)
            powers[0] = 1
            self.inverse = np.full(len(data) + 1, np.uint64(pow(int(BASE), -1, 1 << 64)))
            self.inverse[0] = 1
            np.multiply.accumulate(powers, out=powers)
            np.multiply.accumulate(self.inverse, out=self.inverse)
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values[data] * powers[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        name = (self.sums[starts + length] - self.sums[starts]) * self.inverse[starts] + np.uint64(length)
        name ^= name >> np.uint64(32)
        name *= MIX
        name ^= name >> np.uint64(29)
        name *= MIX2
        return name ^ name >> np.uint64(32)


class Ask(NamedTuple):
    """Names to be looked up among those of all packs. With ``counted`` the answer is whether a
    name occurs twice or more, else whether any of its occurrences has a flag."""

    names: np.ndarray
    flags: np.ndarray
    counted: bool


def marked(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` positions lie in any of the ranges."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def covered_bytes(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> Generator[Ask, np.ndarray, np.ndarray]:
    """Which bytes of a pack lie in a string of ``length`` bytes that also starts elsewhere.

    ``sizes`` are the lengths of the documents that follow each other in ``data``; no string
    crosses their ends. Asks what it must know of other packs, ``ROUNDS`` times.
    """
    period, cover = COVER
    sample_length = length - period + 1
    names, n = Names(data), len(data)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    kept = sizes >= sample_length
    every = (np.arange(0, n, period)[:, None] + cover[None, :]).ravel()
    every = every[every < n]
    at = np.searchsorted(ends, every, "right")
    every, at = every[kept[at] & (every + sample_length <= ends[at])], at[kept[at] & (every + sample_length <= ends[at])]
    none = np.zeros(0, bool)

    # 1: samples whose string occurs elsewhere; windows that repeat hold one in their first bytes
    again = yield Ask(names.of(every, sample_length), none, True)
    samples, begin, end = every[again], begins[at[again]], ends[at[again]]
    # 2: the same at full depth: what these windows cover is settled
    full = samples + length <= end
    again = yield Ask(names.of(samples[full], length), none, True)
    covered = marked(n, samples[full][again], samples[full][again] + length)
    # windows of each sample: those that start at it or less than a period before, inside the document
    low = np.maximum(begin, samples - period + 1)
    high = np.maximum(low, np.minimum(samples, end - length) + 1)
    open_before = np.concatenate([[0], np.cumsum(~covered)])
    unsettled = marked(n, low, high)
    starts = np.flatnonzero(unsettled)
    unsettled[starts] = open_before[starts + length] > open_before[starts]
    # 3: samples that share their string with one in an unsettled window
    count = np.concatenate([[0], np.cumsum(unsettled)])
    wanted = yield Ask(names.of(samples, sample_length), count[high] > count[low], False)
    # 4: all windows of those samples, sorted
    windows = np.flatnonzero(marked(n, low[wanted], high[wanted]))
    again = yield Ask(names.of(windows, length), none, True)
    return covered | marked(n, windows[again], windows[again] + length)


COVER = difference_cover()


class Sorted(NamedTuple):
    """What is asked, sorted: different names, for each whether it is flagged, and which name each position has."""

    names: np.ndarray
    flags: np.ndarray
    place: np.ndarray


def in_order(ask: Ask) -> Sorted:
    names, place, count = np.unique(ask.names, return_inverse=True, return_counts=True)
    if ask.counted:
        return Sorted(names, count > 1, place)
    flags = np.zeros(len(names), bool)
    flags[place[ask.flags]] = True
    return Sorted(names, flags, place)


def packed_names(names: np.ndarray) -> bytes:
    """Sorted names as steps, in the fewest bytes that hold the largest step, byte by byte."""
    steps = np.diff(names, prepend=np.uint64(0))
    first, steps[0] = steps[0], 0
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = steps.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + first.tobytes() + planes.T.tobytes()


def unpacked_names(blob: bytes) -> np.ndarray:
    width, first = blob[0], np.frombuffer(blob, np.uint64, 1, 1)
    planes = np.frombuffer(blob, np.uint8, -1, 9).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    steps = steps.view(np.uint64).ravel()
    steps[0] = first[0]
    return np.cumsum(steps, dtype=np.uint64)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpacked_bits(blob: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=count).astype(bool)


def answered(pack: dict, bucket_bits: int, rounds: int):
    """Replay a pack through the answers so far: (what it asks next, sorted) or (None, covered bytes)."""
    data, sizes = np.frombuffer(pack["text"], np.uint8), np.frombuffer(pack["sizes"], np.int64)
    process = covered_bytes(data, sizes)
    ask = next(process)
    answers: dict[int, dict[int, bytes]] = {}
    for a in pack["answers"] or []:
        answers.setdefault(a["round"], {})[a["bucket"]] = a["bits"]
    for i in range(rounds):
        asked = in_order(ask)
        found = answers.get(i, {})
        flags = [
            unpacked_bits(found[bucket], high - low) for bucket, low, high in buckets(asked.names, bucket_bits)
        ]
        known = np.concatenate([np.zeros(0, bool), *flags])
        try:
            ask = process.send(known[asked.place])
        except StopIteration as end:
            return None, end.value
    return in_order(ask), None


def buckets(names: np.ndarray, bucket_bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets that sorted names fall into."""
    tops = (names >> np.uint64(64 - bucket_bits)).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(tops)) + 1, [len(tops)]]).tolist()
    return [(int(tops[a]), a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def sort_bucket(counted: bool):
    """Answers for all names of a bucket: a row (pack, bucket, names, flags) gives (pack, bucket, bits)."""

    def run(table: pa.Table) -> pa.Table:
        names = [unpacked_names(b) for b in table["names"].to_pylist()]
        sizes = np.array([len(x) for x in names])
        flags = np.concatenate([unpacked_bits(b, n) for b, n in zip(table["flags"].to_pylist(), sizes, strict=True)])
        names = np.concatenate(names)
        order = np.argsort(names, kind="stable")
        group = np.concatenate([[0], np.cumsum(np.diff(names[order]) != 0)])
        yes = np.bincount(group, flags[order]) > 0
        if counted:
            yes |= np.bincount(group) > 1
        found = np.empty(len(names), bool)
        found[order] = yes[group]
        rows = [bits(x) for x in np.split(found, np.cumsum(sizes)[:-1])]
        return pa.table({"pack": table["pack"], "bucket": table["bucket"], "bits": pa.array(rows, pa.binary())})

    return run


def packed(docs: DataFrame, total: int) -> DataFrame:
    """``docs`` as packs of about ``PACK_BYTES``: (pack, sizes, text, others), bucketed by pack.

    ``text`` are the UTF-8 texts one after the other, ``others`` the remaining columns as an
    Arrow stream. A longer text is a pack of its own. Bucketed by pack, the table needs no
    shuffle to be joined with answers.
    """
    others = [c for c in docs.columns if c != "text"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            sizes = np.array([len(t or b"") for t in texts], np.int64)
            rest = batch.select(others)
            start = 0
            while start < len(texts):
                size, stop = sizes[start], start + 1
                while stop < len(texts) and size + sizes[stop] <= PACK_BYTES:
                    size, stop = size + sizes[stop], stop + 1
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as stream:
                    stream.write_batch(rest.slice(start, stop - start))
                yield pa.RecordBatch.from_pydict(
                    {
                        "pack": pa.array([task << 32 | number], pa.int64()),
                        "sizes": pa.array([sizes[start:stop].tobytes()], pa.binary()),
                        "text": pa.array([b"".join(t or b"" for t in texts[start:stop])], pa.binary()),
                        "others": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                    }
                )
                start, number = stop, number + 1

    spark = docs.sparkSession
    packs = batches_mapped(docs.select(*others, "text"), pack, "pack bigint, sizes binary, text binary, others binary")
    name = f"packs_{uuid.uuid4().hex}"
    parts = max(1, math.ceil(total / (2 * PACK_BYTES)))
    writer = packs.write.option("path", new_path(spark, "packs")).option("compression", "zstd")
    writer.bucketBy(parts, "pack").saveAsTable(name)
    return spark.table(name)


def without_repeats(docs: DataFrame, schema: str, finish, length: int = LENGTH) -> DataFrame:
    """Rows of ``schema`` that ``finish(others, data, sizes, covered)`` makes of every pack of ``docs``.

    ``docs`` has a text and any other columns, handed on as an Arrow batch; ``covered`` says
    which bytes of the pack lie in a repeat. Nulls count as empty texts; texts shorter than
    a window stay whole; rows may repeat, and then cover each other.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    packs = packed(docs, size)
    period, cover = COVER
    # sample names are most of what is sorted; eight bytes each
    bucket_bits = max(4, math.ceil(math.log2(max(1, 8 * size * len(cover) / period / BUCKET_BYTES))))
    answers: list[DataFrame] = []

    def with_answers(rounds: int) -> DataFrame:
        if not rounds:
            return packs.withColumn("answers", F.lit(None).cast(ANSWERS))
        given = answers[0]
        for a in answers[1:]:
            given = given.unionByName(a)
        given = given.groupBy("pack").agg(F.collect_list(F.struct("round", "bucket", "bits")).alias("answers"))
        return packs.join(given.hint("shuffle_hash"), "pack", "left")

    def asking(rounds: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    pack = batch.slice(i, 1).to_pylist()[0]
                    asked, _ = answered(pack, bucket_bits, rounds)
                    parts = buckets(asked.names, bucket_bits)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "pack": pa.array([pack["pack"]] * len(parts), pa.int64()),
                            "bucket": pa.array([b for b, _, _ in parts], pa.int64()),
                            "names": pa.array([packed_names(asked.names[x:y]) for _, x, y in parts], pa.binary()),
                            "flags": pa.array([bits(asked.flags[x:y]) for _, x, y in parts], pa.binary()),
                        }
                    )

        return run

    for i in range(ROUNDS):
        asked = with_answers(i).select("pack", "sizes", "text", "answers").mapInArrow(
            asking(i), "pack bigint, bucket bigint, names binary, flags binary"
        )
        found = asked.groupBy("bucket").applyInArrow(
            sort_bucket(counted=i != 2), "pack bigint, bucket bigint, bits binary"
        )
        answers.append(stored(found.withColumn("round", F.lit(i)), f"answers-{i}"))

    def ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pack = batch.slice(i, 1).to_pylist()[0]
                _, covered = answered(pack, bucket_bits, ROUNDS)
                data, sizes = np.frombuffer(pack["text"], np.uint8), np.frombuffer(pack["sizes"], np.int64)
                others = pa.ipc.open_stream(pack["others"]).read_all().combine_chunks().to_batches()[0]
                yield finish(others, data, sizes, covered)

    return with_answers(ROUNDS).mapInArrow(ending, schema)


ANSWERS = "array<struct<round: int, bucket: bigint, bits: binary>>"


def measured(others: pa.RecordBatch, data: np.ndarray, sizes: np.ndarray, covered: np.ndarray) -> pa.RecordBatch:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the documents of a pack."""
    ends = np.cumsum(sizes)
    removed, spans, digests = [], [], []
    for start, end in zip(ends - sizes, ends, strict=True):
        own = covered[start:end]
        removed.append(int(own.sum()))
        spans.append(int(np.count_nonzero(own[1:] & ~own[:-1])) + int(own[:1].sum()))
        digests.append(hashlib.sha256(data[start:end][~own].tobytes()).hexdigest())
    return pa.RecordBatch.from_arrays(
        [others.column("doc_id"), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def measure_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return without_repeats(docs.select("doc_id", "text"), schema, measured)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated passage cut out of the texts; other columns unchanged.

    ``n_chars``, when there, follows the text. Bytes left over from a character that is only
    partly in a passage go with it. A document that is all repeats keeps its row, with an
    empty text; a null text stays null only as an empty one does: it becomes empty.
    """
    columns = docs.columns
    others = [c for c in columns if c != "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [*others, "text"])

    def cut(rest: pa.RecordBatch, data: np.ndarray, sizes: np.ndarray, covered: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(sizes)
        texts = [
            data[a:b][~covered[a:b]].tobytes().decode(errors="ignore") for a, b in zip(ends - sizes, ends, strict=True)
        ]
        arrays = [
            pa.array([len(t) for t in texts], rest.schema.field(c).type) if c == "n_chars" else rest.column(c) for c in others
        ]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string())], [*others, "text"])

    return without_repeats(docs, schema, cut).select(*columns)
