"""Key phrases: TextRank, SGRank and ranked keywords, and grouping of their variants.

The word graph of a text never reaches beyond the text: words are read by native expressions,
and the graphs of a few texts at a time are ranked in Arrow batches (``wordgraphs``), without
a shuffle. Only the inverse document frequency of SGRank, whose n-grams are counted over all
chunks of texts, and the groups of variants go from text to text.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmill.functions.arrays import indexes
from quillmill.functions.binding import bind
from quillmill.functions.tokens import tokenize_words
from quillmill.operators import wordgraphs as G
from quillmill.operators.lexicon import lemma_of_word
from quillmill.plans.components import components
from quillmill.plans.shipping import ship
from quillmill.plans.storage import cut_lineage

# Function words that are never part of a phrase (fixed values).
STOP_WORDS = """
a about above after again against all also am an and any are as at be because been before being
below between both but by can cannot could did do does doing down during each few for from further
had has have having he her here hers herself him himself his how if in into is it its itself just
me more most my myself no nor not now of off on once only or other our ours ourselves out over own
same she should so some such than that the their theirs them themselves then there these they this
those through to too under until up very was we were what when where which while who whom why will
with would you your yours yourself yourselves
""".split()

CHUNK_BYTES = 16 << 20  # of texts whose n-grams are counted together
ROUNDS = 10
DAMPING = 0.85
SCORE_DIGITS = 8  # scores are compared after rounding, so that equal ones tie on every engine


def _rounded(score: Column) -> Column:
    return F.round(score, SCORE_DIGITS)


# --- words and graph of one text ----------------------------------------------------
def normal_words(text_col: Column | str, normalize: str | None) -> Column:
    tokens = tokenize_words(text_col)
    if normalize == "lemma":
        return F.transform(tokens, lemma_of_word)
    if normalize is not None:
        raise ValueError(f"unknown normalize {normalize!r}: use None or 'lemma'")
    return tokens


def is_content(term: Column) -> Column:
    return ~term.isin(STOP_WORDS) & term.rlike(r"\p{L}")


def content_words(text_col: Column | str, normalize: str | None) -> Column:
    """Array of (term, pos) of the words that may be part of a phrase; pos counts all words."""
    placed = F.transform(
        normal_words(text_col, normalize), lambda term, pos: F.struct(term.alias("term"), pos.alias("pos"))
    )
    return F.filter(placed, lambda word: is_content(word["term"]))


def joined_words(text_col: Column | str, normalize: str | None) -> Column:
    """The words of ``content_words`` joined by blanks; any other word is empty there, so places are kept."""
    tokens = normal_words(text_col, normalize)
    return F.array_join(F.transform(tokens, lambda term: F.when(is_content(term), term).otherwise("")), " ")


def over_lists(of_slice: Callable, rows: Column, kind: str) -> Column:
    """``of_slice`` over lists, by Arrow batches; gives an array of ``kind``, empty for a missing list."""
    ship(SparkSession.active())

    def of_batch(batch: pa.Array) -> pa.Array:
        return G.by_slices(of_slice, batch)

    return F.arrow_udf(of_batch, f"array<{kind}>")(rows)


PHRASES = "struct<phrase: string, score: double>"


# --- TextRank -----------------------------------------------------------------------
def textrank_words(
    text_col: str,
    window_size: int = 2,
    position_bias: bool = False,
    normalize: str | None = None,
    binary: bool = True,
    rounds: int = ROUNDS,
    damping: float = DAMPING,
) -> Column:
    """Array of (pos, term, rank): the TextRank score of every content word, in text order.

    Words closer than ``window_size`` are linked; ``binary`` links count once, else as often
    as they occur. ``position_bias`` favours early words: base weight 1/(pos + 1), summed.
    """

    def ranked(words: pa.Array) -> pa.Array:
        texts = G.read(words)
        single, rank = G.textrank(texts, window_size, position_bias, binary, rounds, damping)
        terms = texts.terms.take(pa.array(texts.code))
        return G.lists(texts.count, texts.doc, pos=texts.pos.astype(np.int32), term=terms, rank=rank[single.at[0]])

    return over_lists(ranked, content_words(text_col, normalize), "struct<pos: int, term: string, rank: double>")


def phrase_rows(docs: DataFrame, phrases: Column, id_col: str) -> DataFrame:
    """(doc, phrase, score, rank) from an array of the best phrases, best first."""
    return docs.select(id_col, F.posexplode(phrases).alias("place", "p")).select(
        id_col,
        F.col("p.phrase").alias("phrase"),
        F.col("p.score").alias("score"),
        (F.col("place") + 1).alias("rank"),
    )


def textrank_phrases(
    text_col: str,
    topn: int,
    window_size: int = 2,
    position_bias: bool = False,
    normalize: str | None = None,
    binary: bool = True,
    rounds: int = ROUNDS,
    damping: float = DAMPING,
) -> Column:
    """Array of the best phrases, as ``keyphrases_textrank`` has them."""

    def phrases(words: pa.Array) -> pa.Array:
        texts = G.read(words)
        single, rank = G.textrank(texts, window_size, position_bias, binary, rounds, damping)
        every = np.ones(len(texts.doc), bool)
        return G.best_runs(texts, rank[single.at[0]], every, False, topn, SCORE_DIGITS)

    return over_lists(phrases, content_words(text_col, normalize), PHRASES)


def keyphrases_textrank(
    docs: DataFrame, topn: int = 5, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """(doc, phrase, score, rank): runs of content words by the sum of their TextRank scores."""
    return phrase_rows(docs, textrank_phrases(text_col, topn, **options), id_col)


def keywords_ranked(
    docs: DataFrame,
    words: int = 5,
    lemmatize: bool = False,
    window_size: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc, phrase, score, rank): the best single words, those next to each other merged.

    The score of a merged keyword is the mean of its words.
    """
    best = ranked_keywords(text_col, words, "lemma" if lemmatize else None, window_size)
    return phrase_rows(docs, best, id_col)


def ranked_keywords(text_col: str, words: int, normalize: str | None, window_size: int = 2) -> Column:
    """Array of the best keywords, as ``keywords_ranked`` has them."""

    def keywords(content: pa.Array) -> pa.Array:
        texts = G.read(content)
        single, rank = G.textrank(texts, window_size, False, False, ROUNDS, DAMPING)
        chosen = np.zeros(len(rank), bool)
        chosen[G.best(single.doc, rank, np.arange(len(rank)), words, SCORE_DIGITS)] = True
        number = single.at[0]
        return G.best_runs(texts, rank[number], chosen[number], True, words, SCORE_DIGITS)

    return over_lists(keywords, content_words(text_col, normalize), PHRASES)


# --- SGRank -------------------------------------------------------------------------
def sgrank_phrases(
    text_col: str,
    topn: int,
    window_size: int,
    ngrams: tuple[int, ...],
    normalize: str | None,
    rounds: int = ROUNDS,
    damping: float = DAMPING,
) -> Column:
    """Array of the best phrases, as ``keyphrases_sgrank`` without idf has them."""

    def phrases(words: pa.Array) -> pa.Array:
        return G.sgrank(G.read(words), ngrams, topn, window_size, rounds, damping, SCORE_DIGITS)

    return over_lists(phrases, content_words(text_col, normalize), PHRASES)


def keyphrases_sgrank(
    docs: DataFrame,
    topn: int = 5,
    window_size: int = 3,
    ngrams: tuple[int, ...] | int = (1, 2, 3),
    normalize: str | None = None,
    use_idf: bool = False,
    rounds: int = ROUNDS,
    damping: float = DAMPING,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc, phrase, score, rank) by SGRank.

    n-grams are weighted by tf * length (* idf over ``docs``) and by how early they first
    occur; all n-grams of a document then form a graph in which terms closer than
    ``window_size`` are linked by log2(1 + window_size/distance), and are ranked with their
    weight as base. Without ``use_idf`` a document needs nothing but itself.
    """
    ngrams = (ngrams,) if isinstance(ngrams, int) else tuple(ngrams)
    if not use_idf:
        best = sgrank_phrases(text_col, topn, window_size, ngrams, normalize, rounds, damping)
        return phrase_rows(docs, best, id_col)

    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.count_distinct(id_col).alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    n_docs = size["n"]
    # a given number of partitions, not coalesced by bytes, as much is done to a text behind the shuffle
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((size["bytes"] or 0) / CHUNK_BYTES))
    # Texts are dealt once, to chunks of whole ids, and read there twice: for their n-grams' counts, which
    # a chunk adds up before they go out, and for their ranks, when the totals are back.
    dealt = docs.select(
        F.pmod(F.xxhash64(id_col), F.lit(chunks)).cast("int").alias("_chunk"), id_col,
        joined_words(text_col, normalize).alias("_words"),
    ).repartition(chunks, "_chunk")
    rows = dealt.groupBy("_chunk", id_col).agg(F.collect_list("_words").alias("_words"))

    def read(table: pa.Table) -> tuple[G.Texts, np.ndarray]:
        words = table["_words"].combine_chunks()
        return G.read_joined(words.flatten()), G.lengths(words)

    def counted(table: pa.Table) -> pa.Table:
        found = G.gram_counts(*read(table), ngrams, chunks)
        chunk = table["_chunk"].slice(0, 1).combine_chunks().take(pa.array([0] * len(found["part"]), pa.int64()))
        return pa.table({"_chunk": chunk, "part": pa.array(found["part"], pa.int32()), "size": pa.array(found["size"], pa.int32()), "held": pa.array(found["held"], pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        held = G.total_counts(table["size"].to_pylist(), table["held"].to_pylist())
        return table.set_column(3, "held", pa.array(held, pa.binary()))

    def ranked(texts: pa.Table, totals: pa.Table) -> pa.Table:
        totals = totals.sort_by("part")
        counts = [G.unpacked(h, n, np.uint64)[0] for h, n in zip(totals["held"].to_pylist(), totals["size"].to_pylist())]
        counts = np.concatenate([np.empty(0, np.uint64), *counts])
        best = G.sgrank_idf(*read(texts), counts, n_docs, ngrams, topn, window_size, rounds, damping, SCORE_DIGITS)
        return texts.select([id_col]).append_column("_best", best)

    parts = "_chunk int, part int, size int, held binary"
    totals = rows.groupBy("_chunk").applyInArrow(counted, parts).groupBy("part").applyInArrow(summed, parts)
    best_of = StructType([rows.schema[id_col], *StructType.fromDDL(f"_best array<{PHRASES}>").fields])
    found = rows.groupBy("_chunk").cogroup(totals.groupBy("_chunk")).applyInArrow(ranked, best_of)
    return phrase_rows(found, F.col("_best"), id_col)


# --- both, per document -------------------------------------------------------------
def topn_per_document(
    phrases: DataFrame, n: int, id_col: str = "doc_id", term_col: str = "phrase", score_col: str = "score"
) -> DataFrame:
    """The n best phrases of each document of a (doc, phrase, score) table, with their rank."""
    best = Window.partitionBy(id_col).orderBy(F.desc(_rounded(F.col(score_col))), term_col)
    return phrases.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def extract_keyphrases(
    docs: DataFrame,
    topn: int = 5,
    text_col: str = "text",
    normalize: str | None = "lemma",
    window_size: int = 3,
    ngrams: tuple[int, ...] = (1, 2, 3),
) -> DataFrame:
    """All columns and ``keyphrases`` (the TextRank and the SGRank list) and ``keywords`` (ranked)."""
    sgrank = sgrank_phrases(text_col, topn, window_size, ngrams, normalize)

    def names(phrases: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.coalesce(F.transform(phrases, lambda p: p["phrase"]), none)

    return docs.withColumn(
        "keyphrases",
        F.struct(
            names(textrank_phrases(text_col, topn, normalize=normalize)).alias("textrank"),
            names(sgrank).alias("sgrank"),
        ),
    ).withColumn("keywords", names(ranked_keywords(text_col, topn, normalize)))


# --- variants -----------------------------------------------------------------------
def squashed(term: Column) -> Column:
    """Lower case, letters and digits only, plural ``s`` gone: equal for spelling variants."""
    plain = F.regexp_replace(F.lower(term), r"[^\p{L}\p{N}]", "")
    return F.regexp_replace(plain, "(?<=[^s])s$", "")


def _preference(term_col: str, score_col: str | None) -> Column:
    """What makes a term the one chosen: its score, else few words and letters; then the alphabet."""
    words = F.size(F.split(term_col, " "))
    first = words if score_col is None else -_rounded(F.col(score_col))
    second = F.length(term_col) if score_col is None else words
    return F.struct(first.cast("double").alias("a"), second.alias("b"), F.col(term_col).alias("chosen"))


def variants_in_row(terms: Column) -> Column:
    """Array of (term, variant_of) from an array of preferences, best first.

    Terms are linked that are spelt alike or one of which holds the other as whole words.
    Labels spread within the row, for as many rounds as it has terms, which no chain outlasts.
    """

    def alike(a: Column, b: Column) -> Column:
        def within(x: Column, y: Column) -> Column:
            return F.contains(F.concat(F.lit(" "), x, F.lit(" ")), F.concat(F.lit(" "), y, F.lit(" ")))

        return (a["form"] == b["form"]) | within(a["term"], b["term"]) | within(b["term"], a["term"])

    def grouped(items: Column) -> Column:
        every = indexes(items)
        neighbours = F.transform(items, lambda a: F.filter(every, lambda j: alike(a, F.get(items, j))))

        def labelled(links_: Column) -> Column:
            def one_round(labels: Column, _round: Column) -> Column:
                return F.transform(links_, lambda near: F.array_min(F.transform(near, lambda j: F.get(labels, j))))

            labels = F.aggregate(every, every, one_round)
            return bind(
                labels,
                lambda labels: F.zip_with(
                    items,
                    labels,
                    lambda item, label: F.struct(
                        item["term"].alias("term"), F.get(items, label)["term"].alias("variant_of")
                    ),
                ),
            )

        return bind(neighbours, labelled)

    named = F.transform(
        terms, lambda t: F.struct(t["chosen"].alias("term"), squashed(t["chosen"]).alias("form"))
    )
    return bind(named, grouped)


def group_term_variants(
    terms: DataFrame, group_col: str = "doc_id", score_col: str | None = None
) -> DataFrame:
    """(group, term, variant_of): one chosen term for each set of linked variants.

    A group is what one text gave: its terms are gathered in a row and grouped there. For
    the terms of a whole corpus there is ``corpus_variants``. The chosen term has the best
    score, else the fewest words and letters, then comes first in the alphabet.
    """
    best = terms.groupBy(group_col, "term").agg(F.min(_preference("term", score_col)).alias("label"))
    rows = best.groupBy(group_col).agg(F.sort_array(F.collect_list("label")).alias("labels"))
    return rows.select(group_col, F.inline(variants_in_row(F.col("labels"))))


def corpus_variants(terms: DataFrame, score_col: str | None = None) -> DataFrame:
    """(term, variant_of) over the terms of a corpus, without gathering them in one place.

    Each term emits the runs of words inside it, and those that are terms are links; terms
    spelt alike link to the first of them. The sets are connected components, found in a
    number of rounds that grows with the logarithm of the longest chain.
    """
    nodes = cut_lineage(terms.groupBy("term").agg(F.min(_preference("term", score_col)).alias("label")))
    words = F.split("term", " ")

    def runs(words: Column) -> Column:
        sizes = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(
            F.array().cast("array<int>")
        )
        return F.array_distinct(
            F.flatten(
                F.transform(
                    sizes,
                    lambda size: F.transform(
                        F.sequence(F.lit(1), F.size(words) - size + 1),
                        lambda start: F.array_join(F.slice(words, start, size), " "),
                    ),
                )
            )
        )

    inside = nodes.select(F.col("term").alias("a"), F.explode(bind(words, runs)).alias("b"))
    contained = inside.join(nodes.select(F.col("term").alias("b")), "b").select("a", "b")
    forms = nodes.select("term", squashed(F.col("term")).alias("form"))
    first = forms.groupBy("form").agg(F.min("term").alias("b"))
    spelt = forms.join(first, "form").select(F.col("term").alias("a"), "b")
    roots = components(contained.union(spelt).where(F.col("a") != F.col("b")))
    rooted = nodes.join(roots.withColumnRenamed("node", "term"), "term", "left").select(
        "term", "label", F.coalesce("root", "term").alias("root")
    )
    chosen = rooted.groupBy("root").agg(F.min("label")["chosen"].alias("variant_of"))
    return rooted.join(chosen, "root").select("term", "variant_of")
