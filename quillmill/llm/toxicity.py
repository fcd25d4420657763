"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max index."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.bpe import Memory
from quillmill.llm.tables import batches_mapped, shielded, stored

LABELLED = 20_000  # telling terms are learnt from about so many labelled rows, picked by a hash of their ids
INDEXED = 2_048  # about so many of these are the examples that texts are compared with
TERMS = 64  # so many terms at most are taken in each round, those that tell most first
TELLING = 0.7  # their part of a vector's squared length
CHANCE = 0.5  # terms that may pass by chance among those of equal or more documents
STEMS = (4, 5)
NEIGHBOURS = 25
NEAR = 0.05
BLOCK = 128
CUT = 0.3
EVIDENCE = 3
TEXTS = 50_000
WORD = re.compile(r"\w+")


def term_counts(text: str) -> Counter:
    """How often each term stands in a text: its words in lower case, and as ``stem*`` the
    first letters of longer ones."""
    words = Counter(WORD.findall(text.lower()))
    stems: Counter = Counter()
    for word, n in words.items():
        for size in STEMS:
            if len(word) > size:
                stems[word[:size] + "*"] += n
    return words + stems


class Vector(NamedTuple):
    """A sparse vector: numbers of terms, rising, and their weights."""

    terms: np.ndarray
    weights: np.ndarray


class Example(NamedTuple):
    """Examples of one vector: how many, how many toxic, and one's id."""

    vector: Vector
    count: int
    toxic: int
    doc_id: int


class Nearest(NamedTuple):
    """What a search finds: rows of the index and their cosines, the nearest first, and how many
    blocks it opened."""

    rows: np.ndarray
    cosines: np.ndarray
    opened: int


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all places in ranges of given starts and sizes, range after range."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


class Index:
    """An inverted index over examples in blocks, with the largest weight of each term per block.

    Examples are sorted by their terms, so that a block holds examples alike. Postings lie by
    term, then by block; an entry stands for the postings of one term in one block. A search
    bounds every block's cosines by the sum of its entries' largest weights, opens the blocks
    in the order of these bounds, some more each time, and stops at those that cannot reach
    the nearest found so far; what it returns is exact. All examples as near as the last of
    the ``NEIGHBOURS`` nearest are returned, so that ties have no order.
    """

    def __init__(self, examples: list[Example]):
        examples = sorted(examples, key=lambda e: (e.vector.terms.tolist(), e.vector.weights.tolist(), e.doc_id))
        self.counts = np.array([e.count for e in examples], np.float64)
        self.toxic = np.array([e.toxic for e in examples], np.float64)
        self.ids = np.array([e.doc_id for e in examples], np.int64)
        self.blocks = -(-len(examples) // BLOCK)
        sizes = np.array([len(e.vector.terms) for e in examples], np.int64)
        terms = np.concatenate([np.empty(0, np.int64), *(e.vector.terms for e in examples)])
        weights = np.concatenate([np.empty(0), *(e.vector.weights for e in examples)])
        order = np.argsort(terms, kind="stable")
        self.row = np.repeat(np.arange(len(examples)), sizes)[order]
        self.weight, terms = weights[order], terms[order]
        keys = terms * max(self.blocks, 1) + self.row // BLOCK
        self.start = np.flatnonzero(np.diff(keys, prepend=-1))
        self.size = np.diff(self.start, append=len(keys))
        self.block = self.row[self.start] // BLOCK
        self.largest = np.maximum.reduceat(self.weight, self.start) if len(keys) else np.empty(0)
        self.of_term = np.searchsorted(terms[self.start], np.arange(terms[-1] + 2 if len(terms) else 1))

    def vector(self, row: int) -> Vector:
        """The vector of one row, put together from its postings."""
        at = np.flatnonzero(self.row == row)
        entry = np.searchsorted(self.start, at, "right") - 1
        return Vector(np.searchsorted(self.of_term, entry, "right") - 1, self.weight[at])

    def search(self, vector: Vector, leave_out: int | None = None) -> Nearest:
        """The examples nearest to a vector of length 1; one copy of row ``leave_out`` does not count."""
        known = vector.terms < len(self.of_term) - 1
        terms = vector.terms[known]
        sizes = self.of_term[terms + 1] - self.of_term[terms]
        entries = spans(self.of_term[terms], sizes)
        weights, block = np.repeat(vector.weights[known], sizes), self.block[entries]
        bounds = np.bincount(block, weights * self.largest[entries], self.blocks)
        counts = self.counts
        if leave_out is not None:
            counts = counts.copy()
            counts[leave_out] -= 1
        rows, cosines, least, opened, more = np.empty(0, int), np.empty(0), -1.0, 0, 2
        order = np.argsort(-bounds, kind="stable")
        while opened < self.blocks:
            group = order[opened : opened + more]
            group = group[bounds[group] >= least - 1e-9]
            if not len(group):
                break
            opened, more = opened + len(group), 8 * more
            is_open = np.zeros(self.blocks, bool)
            is_open[group] = True
            mine = np.flatnonzero(is_open[block])
            found = entries[mine]
            sizes = self.size[found]
            posts = spans(self.start[found], sizes)
            score = np.bincount(self.row[posts], np.repeat(weights[mine], sizes) * self.weight[posts], len(counts))
            at = np.flatnonzero(np.repeat(is_open, BLOCK)[: len(counts)] & (score >= least - 1e-9) & (counts > 0))
            rows, cosines = np.concatenate([rows, at]), np.concatenate([cosines, score[at]])
            nearest = np.lexsort((rows, -cosines))
            rows, cosines = rows[nearest], cosines[nearest]
            last = np.searchsorted(np.cumsum(counts[rows]), NEIGHBOURS)
            if last < len(rows):
                least = cosines[last]
                keep = cosines >= least - 1e-9
                rows, cosines = rows[keep], cosines[keep]
        return Nearest(rows, cosines, opened)

    def vote(self, found: Nearest, leave_out: int | None = None) -> float:
        """Toxic share of the nearest, each weighing the inverse square of its distance.

        Of the examples as near as the last of the ``NEIGHBOURS`` nearest, which may be many,
        each counts in part, so that all together make up that number.
        """
        counts, toxic = self.counts[found.rows], self.toxic[found.rows]
        if leave_out is not None:  # a copy of the mean label is left out
            own = found.rows == leave_out
            toxic = toxic - own * toxic / counts
            counts = counts - own
        if not counts.sum():
            return 0.0
        last = found.cosines <= found.cosines[-1] + 1e-9
        part = np.where(last, min(1.0, (NEIGHBOURS - counts[~last].sum()) / max(counts[last].sum(), 1)), 1.0)
        weights = part / (NEAR + np.maximum(0.0, 1 - found.cosines)) ** 2
        return float(weights @ toxic / (weights @ counts))


def rising(votes: np.ndarray, toxic: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(votes, shares): the toxic share as a rising function of the vote, by pooling neighbours.

    The points are the pools' mean votes. One document at the overall share is added to each
    pool, so that a small pool is not taken for certain.
    """
    order = np.argsort(votes, kind="stable")
    base = toxic.sum() / counts.sum()
    pools: list[list[float]] = []
    for i in order:
        pools.append([votes[i] * counts[i], toxic[i], counts[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    return np.array([v / n for v, _, n in pools]), np.array([(t + base) / (n + 1) for _, t, n in pools])


class Space:
    """The terms texts are compared by: all words of the examples, and the telling terms.

    Term 0 stands in every text; the telling terms follow, words or stems, then the other words.
    """

    def __init__(self, telling: list[str], words: list[str], idf: np.ndarray | None = None):
        self.telling = len(telling)
        numbers = {t: i for i, t in enumerate(telling, 1)}
        others = (w for w in words if w not in numbers)
        self.stems = {t[:-1]: i for t, i in numbers.items() if t.endswith("*")}
        self.words = {t: i for t, i in numbers.items() if not t.endswith("*")}
        self.words |= {w: i for i, w in enumerate(others, 1 + self.telling)}
        self.several = {w: (i, *stems) for w, i in self.words.items() if (stems := self.stems_of(w))}
        self.idf = idf

    def stems_of(self, word: str) -> tuple[int, ...]:
        """The telling stems of a word."""
        return tuple(self.stems[word[:n]] for n in STEMS if len(word) > n and word[:n] in self.stems)

    def listed(self, text: str) -> dict[int, int]:
        """Counts of the terms of the space in a text."""
        found: dict[int, int] = {}
        words, several = self.words, self.several
        for word, n in Counter(WORD.findall(text.lower())).items():
            at = words.get(word)
            if at is not None and word not in several:
                found[at] = n
                continue
            for at in self.stems_of(word) if at is None else several[word]:
                found[at] = found.get(at, 0) + n
        return found

    def vector(self, listed: dict[int, int]) -> Vector:
        """TF-IDF weights of length 1.

        Term 0 and the telling terms together make up ``TELLING`` of the squared length, the
        other words the rest; where a text has no other words, the former make up all.
        """
        terms = np.fromiter(listed, np.int64, len(listed))
        counts = np.fromiter(listed.values(), np.float64, len(listed))
        order = np.argsort(terms)
        terms = np.concatenate([[0], terms[order]])
        weights = (1 + np.log(np.concatenate([[1.0], counts[order]]))) * self.idf[terms]
        cut = np.searchsorted(terms, self.telling, "right")
        share = TELLING if cut < len(terms) else 1.0
        weights[:cut] *= math.sqrt(share / (weights[:cut] ** 2).sum())
        if cut < len(terms):
            weights[cut:] *= math.sqrt((1 - share) / (weights[cut:] ** 2).sum())
        return Vector(terms, weights)


class Judge:
    """All that scores a text: the space of its terms, the index, and the calibration."""

    def __init__(self, space: Space, samples: Iterable[tuple[int, dict[int, int], int]]):
        self.space = space
        groups: dict[bytes, tuple[Vector, list[tuple[int, int]]]] = {}
        for doc_id, listed, toxic in samples:
            vector = space.vector(listed)
            key = vector.terms.tobytes() + vector.weights.tobytes()
            groups.setdefault(key, (vector, []))[1].append((doc_id, toxic))
        self.index = Index(
            [Example(v, len(g), sum(t for _, t in g), min(i for i, _ in g)) for v, g in groups.values()]
        )
        self.levels = self.shares = np.zeros(1)
        if self.index.counts.sum() > 1:
            rows = range(len(self.index.counts))
            votes = np.array([self.index.vote(self.index.search(self.index.vector(i), i), i) for i in rows])
            self.levels, self.shares = rising(votes, self.index.toxic, self.index.counts)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    @cached_property
    def known(self) -> Memory:
        """Scores of texts met before, by digest."""
        return Memory(lambda key: None, TEXTS)

    def judged(self, listed: dict[int, int]) -> tuple[float, list[dict]]:
        """(score, evidence) of term counts: the calibrated vote and the nearest examples."""
        index = self.index
        if not len(index.counts):
            return 0.0, []
        found = index.search(self.space.vector(listed))
        evidence = [
            {"doc_id": int(index.ids[r]), "cosine": float(min(c, 1.0)), "examples": int(index.counts[r]), "toxic": int(index.toxic[r])}
            for r, c in zip(found.rows[:EVIDENCE], found.cosines, strict=False)
        ]
        return float(np.interp(index.vote(found), self.levels, self.shares)), evidence

    def score(self, text: str) -> tuple[float, list[dict]]:
        key = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for new in self.known.unmet([key]):
            self.known.put(new, self.judged(self.space.listed(text)))
        return self.known[key]


def held_out(doc_id: str = "doc_id") -> Column:
    """The quarter of ids whose labels are never learnt from; a missing id is in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sampled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, text, toxic) of the examples: different texts of about ``limit`` labelled rows.

    The rows are those with the lowest hashes of their ids, by a bound from their number. Of
    equal texts one stands for all, with the highest label, so copies are no evidence.
    """
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, limit / max(1, usable.count()))
    spread = F.xxhash64("doc_id") / F.lit(float(1 << 64)) + 0.5
    picked = usable.where(spread < share) if share < 1 else usable
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id")
    return rows.groupBy(F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s")).agg(
        F.min("doc_id").alias("doc_id"), F.first("text").alias("text"), F.max("toxic").alias("toxic")
    ).drop("h", "s")


def telling_terms(examples: DataFrame, limit: int = TERMS) -> list[str]:
    """Terms that stand in toxic examples more often than chance would have it.

    The chance of a term's count of toxic documents is bounded by its divergence from the
    overall share; the bound times the number of terms in as many documents must not exceed
    ``CHANCE``. Terms are taken in rounds, ``limit`` at most in each, until a round finds none;
    toxic examples that hold a term taken before are explained and count no more, so that the
    other words of a group of near copies are not taken as well. Each round explains an
    example more, so the rounds end. Terms are counted per task before they are combined;
    only those taken come to the driver. The other words of the examples stay in the
    comparison, with a smaller weight.
    """
    taken: list[str] = []
    while new := telling_round(examples, frozenset(taken), limit):
        taken += new
    return taken


def telling_round(examples: DataFrame, taken: frozenset[str], limit: int) -> list[str]:
    """The terms that one round takes; the pseudo-term "" counts examples."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, toxic = Counter({"": 0}), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                terms = term_counts(text).keys()
                if label and not taken.isdisjoint(terms):
                    continue
                every.update(terms)
                every[""] += 1
                if label:
                    toxic.update(terms)
                    toxic[""] += 1
        columns = [pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([toxic[t] for t in every], pa.int64())], ["term", "n", "toxic"]
        )

    counted = batches_mapped(examples.select("text", "toxic"), count, "term string, n bigint, toxic bigint")
    counted = stored(counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")), "terms")
    totals = counted.where("term = ''").first()
    if totals is None or not 0 < totals["toxic"] < totals["n"]:
        return []
    base = totals["toxic"] / totals["n"]
    counted = counted.where("term != ''")
    sizes = counted.groupBy("n").agg(F.count(F.lit(1)).alias("terms")).orderBy(F.desc("n")).collect()
    allowed, more = [], 0  # by number of documents, of which there are at most as many as examples
    for row in sizes:
        more += row["terms"]
        allowed.append((row["n"], math.log(more / CHANCE)))
    if not allowed:
        return []
    share = F.col("toxic") / F.col("n")
    miss = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    evidence = F.col("n") * (share * F.log(share / base) + miss)
    needed = examples.sparkSession.createDataFrame(allowed, "n bigint, needed double")
    telling = (
        counted.where(share > base)
        .join(F.broadcast(needed), "n")
        .withColumn("evidence", evidence)
        .where(F.col("evidence") >= F.col("needed"))
    )
    return [r["term"] for r in telling.orderBy(F.desc("evidence"), "term").limit(limit).select("term").collect()]


def words_of(examples: DataFrame) -> list[str]:
    """All different words of the examples, in order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: set[str] = set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words.update(WORD.findall(text.lower()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], ["word"])

    return sorted(batches_mapped(examples.select("text"), read, "word string").distinct().toArrow()["word"].to_pylist())


def learnt(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, indexed: int = INDEXED) -> Judge:
    """A judge from the labelled rows among ``docs`` that are not held out.

    Telling terms are learnt from about ``limit`` rows, of which about ``indexed``, picked by
    another hash of their ids, are indexed with all their words. Documents that hold a term
    are counted over all of ``docs``. What comes to the driver is bounded by the parameters:
    the different words of the indexed texts, their counts, and the texts' counts of them.
    """
    spark = docs.sparkSession
    examples = stored(sampled(docs, labels, limit), "examples")
    telling = telling_terms(examples)
    spread = F.xxhash64(F.lit("indexed"), "doc_id") / F.lit(float(1 << 64)) + 0.5
    examples = examples.where(spread < min(1.0, indexed / max(1, examples.count())))
    words = words_of(examples)
    shared = spark.sparkContext.broadcast(Space(telling, words))

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(shared.value.listed(text or "").keys())
                found[0] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["term", "n"]
        )

    counts = batches_mapped(docs.select("text"), holding, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counts = counts.toArrow()
    number = np.zeros(1 + len(telling) + len(words), np.int64)
    number[counts["term"].to_numpy()] = counts["n"].to_numpy()
    names = {i: w for w, i in shared.value.words.items() if i > len(telling)}
    order = sorted(names, key=lambda i: (-number[i], names[i]))  # the commonest first, so that like texts lie together
    number = number[[*range(1 + len(telling)), *order]]
    space = Space(telling, [names[i] for i in order], 1 + np.log((1 + number[0]) / (1 + number)))
    ready = spark.sparkContext.broadcast(space)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ready.value.listed(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("toxic"),
                    pa.array([list(f) for f in found], pa.list_(pa.int32())),
                    pa.array([list(f.values()) for f in found], pa.list_(pa.int64())),
                ],
                ["doc_id", "toxic", "terms", "counts"],
            )

    rows = batches_mapped(examples, counted, "doc_id bigint, toxic int, terms array<int>, counts array<bigint>")
    rows = rows.toArrow().sort_by("doc_id")
    samples = (
        (r["doc_id"], dict(zip(r["terms"], r["counts"], strict=True)), r["toxic"])
        for batch in rows.to_batches(max_chunksize=256)
        for r in batch.to_pylist()
    )
    return Judge(space, samples)


SCORED = "score double, evidence array<struct<doc_id: bigint, cosine: double, examples: int, toxic: int>>"


def score_toxicity(docs: DataFrame, labels: DataFrame, with_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) with held_out, score, predicted and evidence.

    The text is left out unless asked for; other columns stay, but for those named like a
    new one. No shuffle: the judge, of a bounded size, is broadcast, and each text is scored
    where it is read, from its words alone. ``evidence`` are the nearest examples: the id of
    one, the cosine, how many examples have this vector and how many of them are toxic.
    A null text counts as an empty one, which is compared by the absence of telling terms alone.
    A text equal to an indexed example finds it at cosine 1. Rows of equal text get equal scores,
    and each is returned; very long texts are read whole. Without labels to learn from every
    score is 0; an empty table gives no rows.
    """
    judge = docs.sparkSession.sparkContext.broadcast(learnt(docs, labels))
    new = ["score", "evidence", "held_out", "predicted"] + ([] if with_text else ["text"])
    kept = [c for c in docs.columns if c not in new]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), SCORED])
    evidence = pa.list_(
        pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("examples", pa.int32()), ("toxic", pa.int32())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge.value.score(t or "") for t in batch.column("text").to_pylist()]
            scores = [pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], evidence)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *scores], [*kept, "score", "evidence"])

    read = docs.select(*kept) if with_text else docs.select(*kept, "text")
    scored = batches_mapped(read, run, schema)
    return scored.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    scored = score_toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic; columns unchanged."""
    rows, back = shielded(docs, {"score", "evidence", "held_out", "predicted"})
    scored = score_toxicity(rows, labels, with_text=True)
    return scored.where("predicted = 0").select(*rows.columns).withColumnsRenamed(back)
