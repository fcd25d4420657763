"""Word graphs of a batch of texts: links, ranks and the best phrases, as whole-array steps.

A text is a list of (term, pos), read by a native expression; Spark hands the lists over in
Arrow batches. A batch is taken a slice at a time: some thousand words, whole texts, at least
one. Terms are numbered in the order of the alphabet, and phrases of them by their numbers
word by word; no letter of a term sorts before the blank, so that is the order of the phrases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 15  # words
FACTORS = np.array([0x9E3779B97F4A7C17, 0xC2B2AE3D27D4EB4F], np.uint64)  # odd numbers that mix the digests of words
PHRASE = pa.struct([("phrase", pa.string()), ("score", pa.float64())])


class Texts(NamedTuple):
    """Words in text order: number of the text, place, number of the term; ``terms`` by number."""

    count: int
    doc: np.ndarray
    pos: np.ndarray
    code: np.ndarray
    terms: pa.Array


class Grams(NamedTuple):
    """``at`` has a row per n and a column per word: number of the n-gram that starts there, or -1.

    Per gram: its text, n, first word and number of occurrences. Numbers go by text, then alphabet.
    """

    at: np.ndarray
    doc: np.ndarray
    n: np.ndarray
    first: np.ndarray
    times: np.ndarray


def numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each string in the order of the alphabet, and the different strings in it."""
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return number[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(pa.array(order))


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(sizes: np.ndarray) -> Iterator[slice]:
    """Neighbouring texts of ``sizes`` with some ``SLICE`` words together, and one text more at most."""
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE)) + 1).tolist(), len(sizes)]
    return (slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def read(words: pa.Array) -> Texts:
    flat = words.flatten()
    code, terms = numbered(flat.field("term"))
    doc = np.repeat(np.arange(len(words)), lengths(words))
    return Texts(len(words), doc, flat.field("pos").to_numpy(zero_copy_only=False).astype(np.int64), code, terms)


def grams(texts: Texts, sizes: tuple[int, ...]) -> Grams:
    """All runs of n neighbouring words, n among ``sizes``."""
    words = len(texts.doc)
    starts = []
    for n in sizes:
        i = np.arange(max(words - n + 1, 0))
        last = i + n - 1
        starts.append(i[(texts.doc[i] == texts.doc[last]) & (texts.pos[last] - texts.pos[i] == n - 1)])
    start = np.concatenate(starts)
    n = np.repeat(sizes, [len(s) for s in starts])
    number = texts.doc[start]
    first = np.arange(0)
    for k in range(max(sizes)):
        code = np.where(k < n, texts.code[np.minimum(start + k, words - 1)] + 1, 0) if words else start
        _, first, number = np.unique(number * (len(texts.terms) + 1) + code, return_index=True, return_inverse=True)
    at = np.full((len(sizes), words), -1, np.int64)
    at[np.repeat(np.arange(len(sizes)), [len(s) for s in starts]), start] = number
    return Grams(at, texts.doc[start[first]], n[first], start[first], np.bincount(number, minlength=len(first)))


def links(texts: Texts, at: np.ndarray, window_size: int, weight: Callable | None) -> tuple[np.ndarray, ...]:
    """(a, b, weight): different terms closer than ``window_size``, each two once per meeting.

    Without a ``weight`` of the distance two terms are linked once, by 1.
    """
    found = []
    for k in range(1, window_size):
        i = np.arange(max(len(texts.doc) - k, 0))
        far = texts.pos[i + k] - texts.pos[i]
        i = i[(texts.doc[i] == texts.doc[i + k]) & (far < window_size)]
        far = texts.pos[i + k] - texts.pos[i]
        for x in at:
            for y in at:
                a, b = x[i], y[i + k]
                both = (a >= 0) & (b >= 0) & (a != b)
                found.append((a[both], b[both], far[both]))
    a, b, far = (np.concatenate([f[c] for f in found] or [np.arange(0)]) for c in range(3))
    if weight is not None:
        return a, b, weight(far)
    most = int(at.max(initial=0)) + 1
    pair = np.unique(np.minimum(a, b) * most + np.maximum(a, b))
    return pair // most, pair % most, np.ones(len(pair))


def ranks(
    doc: np.ndarray, base: np.ndarray, edges: tuple[np.ndarray, ...], rounds: int, damping: float
) -> np.ndarray:
    """Ranks of terms, ``doc`` being the text of each and ``edges`` their links, taken both ways.

    rank = (1 - damping) * base + damping * sum over links of weight / strength * rank,
    all terms at once, a fixed number of rounds, starting from the base. Base weights are
    scaled to sum to the number of terms of the text.
    """
    a, b, weight = edges
    count = len(doc)
    total = np.bincount(doc, base)
    base = base * np.divide(np.bincount(doc), total, out=np.zeros(len(total)), where=total != 0)[doc]
    strength = np.bincount(a, weight, count) + np.bincount(b, weight, count)
    share = np.divide(damping, strength, out=np.zeros(count), where=strength > 0)
    rank = base
    for _ in range(rounds):
        given = rank * share
        rank = base * (1 - damping) + np.bincount(a, weight * given[b], count) + np.bincount(b, weight * given[a], count)
    return rank


def best(doc: np.ndarray, score: np.ndarray, order: np.ndarray, n: int, digits: int) -> np.ndarray:
    """The n best of each text, by rounded score, then by ``order``; as positions, text by text."""
    sorted_ = np.lexsort((order, -np.floor(score * 10.0**digits + 0.5), doc))
    of = doc[sorted_]
    return sorted_[np.arange(len(of)) - np.searchsorted(of, of) < n]


def lists(count: int, doc: np.ndarray, **fields) -> pa.Array:
    """A list of structs per text, from values that lie text by text."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=count))]).astype(np.int32)
    columns = [pa.array(value) if isinstance(value, np.ndarray) else value for value in fields.values()]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, list(fields)))


def joined(texts: Texts, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The runs of ``size`` words from ``start`` on, with blanks between."""
    ends = np.concatenate([[0], np.cumsum(size)])
    word = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    terms = texts.terms.take(pa.array(texts.code[word]))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), terms), " ")


def best_runs(texts: Texts, rank: np.ndarray, kept: np.ndarray, mean: bool, n: int, digits: int) -> pa.Array:
    """Lists of (phrase, score): the best maximal runs of neighbouring ``kept`` words, equal ones once.

    The score is the sum of the words' ranks, or their mean.
    """
    word = np.flatnonzero(kept)
    doc, pos = texts.doc[word], texts.pos[word]
    starts = np.ones(len(word), bool)
    starts[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    run = np.cumsum(starts) - 1
    size = np.bincount(run)
    score = np.bincount(run, rank[word])
    score = score / size if mean else score
    start, doc = word[starts], doc[starts]
    phrase, names = numbered(joined(texts, start, size))
    by_phrase = np.lexsort((-score, phrase, doc))
    d, p = doc[by_phrase], phrase[by_phrase]
    once = np.ones(len(d), bool)
    once[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1])
    one = by_phrase[once]
    found = one[best(doc[one], score[one], phrase[one], n, digits)]
    return lists(texts.count, doc[found], phrase=names.take(pa.array(phrase[found])), score=score[found])


def textrank(
    texts: Texts, window_size: int, position_bias: bool, binary: bool, rounds: int, damping: float
) -> tuple[Grams, np.ndarray]:
    """The different words and their TextRank scores; early words have base weights 1/(pos + 1) with a bias."""
    single = grams(texts, (1,))
    number, count = single.at[0], len(single.doc)
    base = np.bincount(number, 1 / (texts.pos + 1), count) if position_bias else np.ones(count)
    edges = links(texts, single.at, window_size, None if binary else lambda far: np.ones(len(far)))
    return single, ranks(single.doc, base, edges, rounds, damping)


def sgrank(
    texts: Texts, sizes: tuple[int, ...], topn: int, window_size: int, rounds: int, damping: float, digits: int
) -> pa.Array:
    """Lists of (phrase, score) by SGRank without idf."""
    found = grams(texts, sizes)
    base = found.times * found.n / np.log2(texts.pos[found.first] + 2)
    edges = links(texts, found.at, window_size, lambda far: np.log2(1 + window_size / far))
    score = ranks(found.doc, base, edges, rounds, damping)
    top = best(found.doc, score, np.arange(len(score)), topn, digits)
    return lists(texts.count, found.doc[top], phrase=joined(texts, found.first[top], found.n[top]), score=score[top])


def read_joined(lines: pa.Array) -> Texts:
    """As ``read``, from words joined by blanks; a word left out is empty there and keeps its place."""
    parts = pc.split_pattern(lines, " ")
    flat, sizes = parts.flatten(), lengths(parts)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = pc.not_equal(flat, "")
    code, terms = numbered(flat.filter(kept))
    held = kept.to_numpy(zero_copy_only=False)
    return Texts(len(lines), np.repeat(np.arange(len(lines)), sizes)[held], pos[held], code, terms)


def row_slices(texts: Texts, per_row: np.ndarray) -> Iterator[tuple[np.ndarray, Texts]]:
    """Slices of neighbouring rows: the number of texts of each, and these texts; those of one row stay together."""
    of_text = np.repeat(np.arange(len(per_row)), per_row)
    ends = np.append(0, np.cumsum(per_row))
    for part in slices(np.bincount(of_text[texts.doc], minlength=len(per_row))):
        first, last = ends[part.start], ends[part.stop]
        a, b = np.searchsorted(texts.doc, (first, last))
        own = Texts(int(last - first), texts.doc[a:b] - first, texts.pos[a:b], texts.code[a:b], texts.terms)
        yield per_row[part], own


def digests(terms: pa.Array) -> np.ndarray:
    """128 bits of each term, as two numbers."""
    found = b"".join(blake2b(term, digest_size=16).digest() for term in terms.cast(pa.binary()).to_pylist())
    return np.frombuffer(found, "<u8").reshape(-1, 2)


def gram_digests(texts: Texts, found: Grams, of_term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """80 bits of each n-gram, from the digests of its words in order: 64, by which it is dealt, and 16 more."""
    high, low = np.zeros(len(found.n), np.uint64), np.zeros(len(found.n), np.uint64)
    for k in range(int(found.n.max(initial=0))):
        here = np.flatnonzero(found.n > k)
        word = of_term[texts.code[found.first[here] + k]]
        high[here] = (high[here] ^ (high[here] >> np.uint64(32))) * FACTORS[0] + word[:, 0]
        low[here] = (low[here] ^ (low[here] >> np.uint64(32))) * FACTORS[1] + word[:, 1]
    return high, (low >> np.uint64(48)).astype(np.uint16)


def numbered_digests(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each different digest, in their order, and the number of every one's digest."""
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of one length, byte by byte of equal weight, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpacked(held: bytes, size: int, *types: type) -> list[np.ndarray]:
    widths = [np.dtype(t).itemsize for t in types]
    flat = np.frombuffer(pa.decompress(held, size * sum(widths), codec="zstd", asbytes=True), np.uint8)
    ends = np.cumsum(widths) * size
    planes = [flat[end - w * size : end].reshape(w, size) for end, w in zip(ends, widths)]
    return [np.ascontiguousarray(p.T).view(t).reshape(-1) for p, t in zip(planes, types)]


def gram_counts(texts: Texts, per_row: np.ndarray, sizes: tuple[int, ...], parts: int) -> dict[str, list]:
    """How many texts hold each n-gram: a row per part of the digests, with their differences in order."""
    of_term = digests(texts.terms)
    found = [gram_digests(t, grams(t, sizes), of_term) for _, t in row_slices(texts, per_row)]
    high, low = (np.concatenate([f[c] for f in found] or [np.empty(0, (np.uint64, np.uint16)[c])]) for c in (0, 1))
    first, number = numbered_digests(high, low)
    high, low, times = high[first], low[first], np.bincount(number, minlength=len(first)).astype(np.uint64)
    part = ((high >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    rows = [slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
    return {
        "part": [int(part[r.start]) for r in rows],
        "size": [r.stop - r.start for r in rows],
        "held": [packed(np.diff(high[r], prepend=np.uint64(0)), low[r], times[r]) for r in rows],
    }


def total_counts(sizes: list[int], held: list[bytes]) -> list[bytes]:
    """The counts of all rows of one part added up, and given back to each row in its order."""
    rows = [unpacked(h, size, np.uint64, np.uint16, np.uint64) for size, h in zip(sizes, held)]
    high, low, times = (np.concatenate([r[c] for r in rows]) for c in range(3)) if rows else ([],) * 3
    high = np.concatenate([np.cumsum(r[0], dtype=np.uint64) for r in rows]) if rows else high
    first, number = numbered_digests(high, low)
    total = np.zeros(len(first), np.uint64)
    np.add.at(total, number, times)
    ends = np.cumsum([0, *sizes])
    return [packed(total[number[a:b]]) for a, b in zip(ends, ends[1:])]


def sgrank_idf(
    texts: Texts, per_row: np.ndarray, counts: np.ndarray, count: int, sizes: tuple[int, ...], topn: int, window_size: int,
    rounds: int, damping: float, digits: int,
) -> pa.Array:
    """Lists of (phrase, score) by SGRank with idf, a list per row; ``per_row`` is the number of texts of each.

    ``counts`` says how many texts hold each different n-gram, in the order of their digests,
    and ``count`` how many documents there are. A row has one text, or those of an id that repeats;
    their terms stand side by side.
    """
    of_term = digests(texts.terms)
    parts = [(t, own, grams(t, sizes)) for own, t in row_slices(texts, per_row)]
    found = [gram_digests(t, g, of_term) for t, _, g in parts]
    high, low = (np.concatenate([f[c] for f in found] or [np.empty(0, (np.uint64, np.uint16)[c])]) for c in (0, 1))
    first, number = numbered_digests(high, low)
    if len(first) != len(counts):
        raise ValueError(f"{len(counts)} counts for {len(first)} different n-grams")
    idf = (np.log((1.0 + count) / (1.0 + counts)) + 1)[number]
    ends = np.cumsum([0, *(len(f[0]) for f in found)])
    lists_ = [
        _sgrank_idf(t, own, g, idf[a:b], sizes, topn, window_size, rounds, damping, digits)
        for (t, own, g), a, b in zip(parts, ends, ends[1:])
    ]
    return pa.concat_arrays(lists_) if lists_ else pa.array([], pa.list_(PHRASE))


def _sgrank_idf(
    texts: Texts, per_row: np.ndarray, found: Grams, idf: np.ndarray, sizes: tuple[int, ...], topn: int,
    window_size: int, rounds: int, damping: float, digits: int,
) -> pa.Array:
    """With at most len(sizes) terms of one text at one position, those in the window are among the next few places."""
    doc = np.repeat(np.arange(len(per_row)), per_row)[found.doc]
    base = found.times * found.n / np.log2(texts.pos[found.first] + 2) * idf
    gram = np.zeros(len(doc), np.int64)
    for k in range(max(sizes)):
        code = np.where(k < found.n, texts.code[np.minimum(found.first + k, len(texts.code) - 1)] + 1, 0) if len(doc) else gram
        gram = np.unique(gram * (len(texts.terms) + 1) + code, return_inverse=True)[1]
    _, word = np.nonzero(found.at >= 0)
    term, pos = found.at[found.at >= 0], texts.pos[word]
    # of one position the heavier first: which places are among the next few goes by it, where ids repeat
    number = np.empty(len(doc), np.int64)
    number[np.lexsort((base, gram, -np.floor(base * 10.0**digits + 0.5), doc))] = np.arange(len(doc))
    order = np.lexsort((number[term], pos, doc[term]))
    term, pos = term[order], pos[order]
    of, met = doc[term], []
    for k in range(1, window_size * len(sizes)):
        i = np.arange(max(len(pos) - k, 0))
        far = pos[i + k] - pos[i]
        near = (of[i] == of[i + k]) & (far >= 1) & (far < window_size) & (term[i] != term[i + k])
        met.append((term[i][near], term[i + k][near], np.log2(1 + window_size / far[near])))
    edges = tuple(np.concatenate([m[c] for m in met]) for c in range(3))
    score = ranks(doc, base, edges, rounds, damping)
    top = best(doc, score, gram, topn, digits)
    return lists(len(per_row), doc[top], phrase=joined(texts, found.first[top], found.n[top]), score=score[top])


def by_slices(of_slice: Callable[..., pa.Array], rows: pa.Array) -> pa.Array:
    """``of_slice`` over a batch of lists of words, a slice at a time."""
    found = [of_slice(rows[part]) for part in slices(lengths(rows))]
    return pa.concat_arrays(found or [of_slice(rows)])
