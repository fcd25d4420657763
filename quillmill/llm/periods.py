"""Periodic runs of words, and texts with each run cut to its first period.

A run is a stretch of words with smallest period q, at least three periods and 24 words
long, that no neighbouring word extends. A run's words recur q words on, so its blocks of
``BLOCK`` words do; words outside such recurring blocks are left aside first, which loses no
run. What remains is searched by internal pattern matching: blocks of each dyadic length B
ask for their occurrences in the window next to them, by range successor in a wavelet tree
over the suffix array. Occurrences in so short a window form an arithmetic progression;
of three or more only the ends of the region they fill can be a period away from the ends of
the region around the block, so a block has at most two candidate periods. Candidates are
extended by fingerprints, and every run found is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.binding import bind
from quillmill.llm.tables import batches_mapped

BLOCK = 8  # words; the shortest block asked for
LEAST = 24  # words; the shortest run
REPEATS = 3  # periods; the least a run has
CHUNK_BYTES = 8 << 20  # texts taken apart at once; one longer text is a chunk of its own
PRIMES = (2_147_483_647, 2_147_483_629)  # below 2^31, so that products fit 64 bits


# --- suffix array and wavelet tree ----------------------------------------------------
def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array of ``symbols``, and its blocks (length, places, low, high), by prefix doubling.

    Blocks of ``BLOCK``, twice, four times as many symbols are taken at the multiples of their
    length; order[low:high] are the occurrences of each. A block that occurs once is left out.
    Suffixes that stand alone are not sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    head = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    blocks, width = [], 1
    while width < n:
        placed = rank[order]
        tied = np.flatnonzero((np.append(placed[1:], -1) == placed) | (np.insert(placed[:-1], 0, -1) == placed))
        if not len(tied):
            break
        at = order[tied]
        after = at + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, placed[tied]))
        at, first, second = at[by], placed[tied][by], second[by]
        order[tied] = at
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        starts = np.flatnonzero(new)
        rank[at] = np.repeat(tied[starts], np.diff(np.append(starts, len(at))))
        width *= 2
        if width >= BLOCK:
            places = np.arange(0, n - width + 1, width)
            low = rank[places]
            size = np.bincount(rank, minlength=n)[low]
            again = size > 1
            blocks.append((width, places[again], low[again], (low + size)[again]))
    return order, blocks


class WaveletTree:
    """Range queries over a permutation: how many values below a bound, and the k-th smallest.

    One bit vector per bit of a value, highest first, each level partitioned stably by it
    (zeros in front); ranks by counts per 64 bits. All queries take and return arrays.
    """

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits = max(1, int(self.n - 1).bit_length()) if self.n else 1
        self.words, self.counts, self.zeros = [], [], []
        for shift in range(self.bits - 1, -1, -1):
            bit = (values >> shift) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))))
            self.zeros.append(int(self.n - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def ones(self, level: int, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & below)

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of values[low:high] are less than ``bound``."""
        low, high = low.copy(), high.copy()
        found = np.where(bound >= self.n, high - low, 0)
        for level in range(self.bits):
            one = (bound >> (self.bits - 1 - level)) & 1 == 1
            l1, h1 = self.ones(level, low), self.ones(level, high)
            found += np.where(one & (bound < self.n), (high - h1) - (low - l1), 0)
            low = np.where(one, self.zeros[level] + l1, low - l1)
            high = np.where(one, self.zeros[level] + h1, high - h1)
        return found

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of values[low:high]."""
        low, high, k = low.copy(), high.copy(), k.copy()
        value = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            l1, h1 = self.ones(level, low), self.ones(level, high)
            zeros = (high - h1) - (low - l1)
            one = k >= zeros
            k = np.where(one, k - zeros, k)
            value = (value << 1) | one
            low = np.where(one, self.zeros[level] + l1, low - l1)
            high = np.where(one, self.zeros[level] + h1, high - h1)
        return value


class Extender:
    """How far a shift by q goes on matching from a place, to either side, by two fingerprints."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.powers, self.sums = [], []
        for base, prime in zip((1_000_003, 998_244_353), PRIMES, strict=True):
            powers = np.ones(self.n + 1, np.int64)
            done, step = 1, base % prime
            while done <= self.n:  # powers[done:2 * done] = powers[:done] * base ** done
                span = min(done, self.n + 1 - done)
                powers[done : done + span] = powers[:span] * step % prime
                done, step = done * 2, step * step % prime
            spread = (symbols.astype(np.int64) * 2_654_435_761 + 97) % prime
            sums = np.concatenate(([0], np.cumsum(spread * powers[:-1] % prime)))
            self.powers.append(powers)
            self.sums.append(sums)

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether symbols[a:a+length] and symbols[b:b+length] agree; a <= b."""
        same = np.ones(len(a), bool)
        for prime, powers, sums in zip(PRIMES, self.powers, self.sums, strict=True):
            left = (sums[a + length] - sums[a]) % prime
            right = (sums[b + length] - sums[b]) % prime
            same &= left * powers[b - a] % prime == right
        return same

    def right(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Most L with symbols[at:at+L] == symbols[at+q:at+q+L]."""
        return self._most(self.n - at - q, lambda length: self.equal(at, at + q, length))

    def left(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Most L with symbols[at-L:at] == symbols[at+q-L:at+q]."""
        return self._most(at.copy(), lambda length: self.equal(at - length, at + q - length, length))

    @staticmethod
    def _most(limit: np.ndarray, agrees) -> np.ndarray:
        low, high = np.zeros_like(limit), limit  # low agrees, above high nothing does
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fine = agrees(middle)
            low, high = np.where(fine, middle, low), np.where(fine, high, middle - 1)
        return low


# --- runs -----------------------------------------------------------------------------
def recurring(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words lie in a stretch of ``LEAST - BLOCK + 1`` or more starts of recurring blocks.

    In a run every block start has an equal one q words before or behind. Blocks are told
    apart by 64-bit hashes; equal hashes of different blocks only leave more to search.
    """
    n = len(words)
    if n < LEAST:
        return np.zeros(n, bool)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    starts = n - BLOCK + 1
    blocks = doc[:starts].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    for k in range(BLOCK):
        blocks = (blocks ^ mixed[k : k + starts]) * np.uint64(0xD6E8FEB86659FD93)
        blocks ^= blocks >> np.uint64(31)
    order = np.argsort(blocks)
    ordered = blocks[order]
    twin = np.concatenate(([False], ordered[1:] == ordered[:-1]))
    twin |= np.concatenate((twin[1:], [False]))
    again = np.zeros(starts, bool)
    again[order] = twin
    again &= doc[:starts] == doc[BLOCK - 1 :]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], again.astype(np.int8), [0]))))
    kept = np.zeros(n, bool)
    for begin, end in zip(edges[::2], edges[1::2], strict=True):
        if end - begin >= LEAST - BLOCK + 1:
            kept[begin : end + BLOCK - 1] = True
    return kept


def candidates(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, Extender]:
    """(at, q): a block at ``at`` recurs at ``at + q``; of every run one such pair is among them."""
    order, blocks = suffix_array(symbols)
    tree, extend = WaveletTree(order), Extender(symbols)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for width, at, low, high in blocks:
        if width == BLOCK:  # periods below a block's length: its nearest occurrence
            before = tree.below(low, high, at + 1)
            some = before < tree.below(low, high, at + BLOCK)
            near = tree.smallest(low[some], high[some], before[some])
            found.append((at[some], near - at[some]))
        found += progressions(tree, extend, at, low, high, width)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), extend
    return np.concatenate([a for a, _ in found]), np.concatenate([q for _, q in found]), extend


def progressions(tree, extend, at, low, high, width) -> list[tuple[np.ndarray, np.ndarray]]:
    """Candidate periods from ``width`` to below twice that, for the blocks at ``at``."""
    before = tree.below(low, high, at + width)
    count = tree.below(low, high, at + 2 * width) - before
    some = count > 0
    at, low, high, before, count = (x[some] for x in (at, low, high, before, count))
    first = tree.smallest(low, high, before)
    few, two = count <= 2, count == 2
    found = [(at[few], first[few] - at[few])]
    second = tree.smallest(low[two], high[two], before[two] + 1)
    found.append((at[two], second - at[two]))
    many = count > 2
    at, first, low, high, before = (x[many] for x in (at, first, low, high, before))
    if len(at):
        step = tree.smallest(low, high, before + 1) - first
        # the regions with period ``step`` around the block and around its occurrences
        own_end, own_start = extend.right(at, step) + at, at - extend.left(at, step)
        end, start = extend.right(first, step) + first, first - extend.left(first, step)
        found.append((at, end - own_end))
        found.append((at, start - own_start))
    return found


def runs_of(symbols: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in ``symbols``, by start and period."""
    n = len(symbols)
    if n < LEAST:
        return []
    at, q, extend = candidates(symbols)
    fits = (q > 0) & (at + q < n)
    at, q = at[fits], q[fits]
    start = at - extend.left(at, q)
    end = at + q + extend.right(at, q)
    long = end - start >= np.maximum(LEAST, REPEATS * q)
    spans = np.unique(np.stack([start[long], end[long], q[long]], axis=1), axis=0)
    best: dict[tuple[int, int], int] = {}
    for s, e, p in spans.tolist():
        whole = np.array_equal(symbols[s : e - p], symbols[s + p : e])  # else fingerprints agreed by chance
        for span in [(s, e)] if whole else stretches(symbols, s, e, p):
            best[span] = min(best.get(span, p), p)
    return sorted((s, e, p) for (s, e), p in best.items())


def stretches(symbols: np.ndarray, start: int, end: int, q: int) -> list[tuple[int, int]]:
    """The stretches of period q within [start, end), compared symbol by symbol."""
    same = symbols[start : end - q] == symbols[start + q : end]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
    spans = [(start + a, start + b + q) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    return [(a, b) for a, b in spans if b - a >= max(LEAST, REPEATS * q)]


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start and period."""
    sizes = np.array([len(words) for words in texts])
    first = np.concatenate(([0], np.cumsum(sizes)))
    flat = [word for words in texts for word in words]
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.flatnonzero(recurring(np.fromiter(map(hash, flat), np.int64, len(flat)), doc))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(place):
        return found
    ids: dict[bytes, int] = {}
    words = np.array([ids.setdefault(flat[i], len(ids)) for i in place.tolist()])
    of = doc[place]
    segment = np.cumsum(np.concatenate(([True], (np.diff(place) > 1) | (np.diff(of) > 0))))
    # words of different segments are different symbols, so that nothing matches across
    _, symbols = np.unique(segment * len(ids) + words, return_inverse=True)
    for start, end, period in runs_of(symbols):
        found[of[start]].append((int(place[start] - first[of[start]]), end - start, period))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, without those that some run holds behind its first period."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


# --- tables ---------------------------------------------------------------------------
def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary())
        size, begin = 0, 0
        for i in range(batch.num_rows):
            size += len(texts[i].as_py() or b"")
            if size >= CHUNK_BYTES or i == batch.num_rows - 1:
                yield _searched(batch.slice(begin, i + 1 - begin), texts.slice(begin, i + 1 - begin))
                size, begin = 0, i + 1


def _searched(batch: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
    words = [(text or b"").split() for text in texts.to_pylist()]
    runs = runs_of_texts(words)
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
    listed = [[{"start": s, "length": n, "period": p} for s, n, p in each] for each in runs]
    columns = [
        *batch.columns[:-1],
        pa.array([len(w) for w in words], pa.int64()),
        pa.array(listed, kind),
        pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string()),
    ]
    names = [*batch.schema.names[:-1], "n_words", "runs", "collapsed"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_words, runs, collapsed): the runs of each text, and the text with one period of each.

    Words are what stands between ASCII white space. ``runs`` holds (start, length, period) by
    start and period, counted in words; ``collapsed`` has the words that no run holds behind its
    first period, joined by blanks. Each row is searched on its own, so nothing is shuffled and
    repeated rows or ids give repeated results. A null or empty text has no words, no runs and
    an empty ``collapsed``; an empty table gives an empty one. Other columns are left out. A text is
    in memory with its words, some 20 times its size; texts are gathered up to ``CHUNK_BYTES``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"`{id_col}` {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return batches_mapped(docs.select(id_col, text_col), _search, shape)


def looped(doc_id: Column, text: Column) -> Column:
    """The text of every tenth document by a hash with its last words replaced by a loop over some of them.

    With h the CRC of the id in decimal and g = h // 10, of n words those from a = g % n on
    repeat the first 1 + (n - a) // (3 + g % 8) of them. Other texts, those without words or
    without an id, stay as they are.
    """

    def loop(x: Column) -> Column:
        words, g = x["words"], x["g"]
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")

        def turned(places: Column) -> Column:
            return F.array_join(
                F.transform(words, lambda w, i: F.when(i < places["a"], w).otherwise(
                    F.get(words, places["a"] + (i - places["a"]) % places["p"])
                )), " "
            )

        return F.when(n > 0, bind(F.struct(a.alias("a"), p.alias("p")), turned))

    h = F.crc32(doc_id.cast("string"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    edited = bind(F.struct(words.alias("words"), F.floor(h / 10).alias("g")), loop)
    return F.when(h % 10 == 0, F.coalesce(edited, text)).otherwise(text)


def measure_runs(docs: DataFrame) -> DataFrame:
    """Per document the number of its runs, the one with most periods, and digests of runs and of the rest."""
    texts = docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(texts)

    def denser(best: Column, run: Column) -> Column:
        more = best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
        return F.when(more, run).otherwise(best)

    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", F.aggregate("runs", nothing, denser))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
