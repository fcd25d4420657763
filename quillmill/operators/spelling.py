"""Spelling as a job on the distinct words of a corpus.

A listed word is cut into k + 1 segments. k edits leave one of them whole, so a word at most k
edits away holds a segment, near the place where it stands in the listed word. Words meet in
an equi-join on (length, number of the segment, segment) and are then measured up to k edits.
A word has a fixed number of keys whatever its length.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions import patterns as P
from quillmill.functions.tokens import split_words
from quillmill.operators.lexicon import join_words
from quillmill.plans.joins import salted_join
from quillmill.plans.storage import cut_lineage, new_path
from quillmill.plans.wordmaps import joined_by_place, texts_by_id, word_map, words_by_id

MAX_EDITS = 2


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment ``i`` (from 0) of ``edits`` + 1 about equal ones."""
    sizes = [F.floor((length + j) / (edits + 1)).cast("int") for j in range(i + 1)]
    start = F.lit(1)
    for size in sizes[:-1]:
        start = start + size
    return start, sizes[-1]


def _key(length: Column, i: int, piece: Column) -> Column:
    return F.xxhash64(length, F.lit(i), piece)


def _letters(word: Column) -> Column:
    return F.array_distinct(F.filter(F.split(word, ""), lambda c: c != ""))


LETTER = -1  # in place of a segment's number, where a word is too short for segments


def listed_keys(word: Column, edits: int) -> Column:
    """Keys of a listed word: its segments, or its letters if it has no more of them than edits."""
    length = F.length(word)
    cut = [_segment(length, i, edits) for i in range(edits + 1)]
    segments = F.array(*[_key(length, i, F.substring(word, start, size)) for i, (start, size) in enumerate(cut)])
    letters = F.transform(_letters(word), lambda c: _key(F.length(word), LETTER, c))
    return F.when(length > edits, segments).otherwise(letters)


def asked_keys(word: Column, edits: int) -> Column:
    """Keys under which a listed word at most ``edits`` edits away has at least one of its own.

    For each length of a listed word, the strings that stand where a segment of it may: as far off
    as the edits before the segment move it, and from the end as those behind it do.
    """
    size_of_word = F.length(word)
    keys = []
    for more in range(-edits, edits + 1):
        length = size_of_word + more
        for i in range(edits + 1):
            start, size = _segment(length, i, edits)
            for moved in range(max(-i, -more - (edits - i)), min(i, -more + (edits - i)) + 1):
                place = start + moved
                fits = (length > edits) & (place >= 1) & (place + size - 1 <= size_of_word)
                keys.append(F.when(fits, _key(length, i, F.substring(word, place, size))))
    segments = F.filter(F.array(*keys), lambda key: key.isNotNull())
    lengths = F.filter(F.array(*[F.lit(n) for n in range(1, edits + 1)]), lambda n: F.length(word) <= n + edits)
    letters = F.flatten(F.transform(lengths, lambda n: F.transform(_letters(word), lambda c: _key(n, LETTER, c))))
    return F.array_distinct(F.concat(segments, letters))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of the words between blanks."""
    return docs.select(F.explode(split_words(text_col)).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")
    )


def unknown_words(counts: DataFrame, dictionary: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(word): words with a letter that neither the dictionary nor the keep-list has."""
    unknown = counts.select("word").where(F.col("word").rlike(r"\p{L}"))
    if keep:
        unknown = unknown.where(~F.col("word").isin(keep))
    return unknown.join(dictionary.select("word"), "word", "left_anti")


def near_pairs(unknown: DataFrame, dictionary: DataFrame, edits: int) -> DataFrame:
    """(word, suggestion, freq) of words at most ``edits`` edits apart, some more than once.

    Two words without a common letter are as far apart as the longer is long. Of the listed words
    with no more letters than edits, the most frequent and the first by the alphabet of each
    length stand for all that have no letter of an equally short word; they are few, and travel
    with the asked words.
    """
    partitions = int(unknown.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = unknown.repartition(partitions, "word")  # a word grows into many keys
    keyed = asked.select("word", F.explode(asked_keys(F.col("word"), edits)).alias("_key"))
    listed = dictionary.select(
        F.col("word").alias("suggestion"), "freq", F.explode(listed_keys(F.col("word"), edits)).alias("_key")
    )
    whole = dictionary.where(F.length("word") <= edits)
    either = whole.groupBy(F.length("word").alias("n")).agg(
        F.min(F.struct((-F.col("freq")).alias("rarity"), "word", "freq")).alias("a"),
        F.min(F.struct("word", "freq")).alias("b"),
    )
    entry = lambda c: F.struct(F.col(f"{c}.word").alias("suggestion"), F.col(f"{c}.freq").alias("freq"))
    stand_ins = either.agg(F.flatten(F.collect_list(F.array(entry("a"), entry("b")))).alias("s")).scalar()
    short = asked.where(F.length("word") <= edits).select("word", F.explode(stand_ins).alias("s"))
    met = keyed.join(listed, "_key").select("word", "suggestion", "freq")
    return met.unionByName(short.select("word", "s.suggestion", "s.freq")).where(
        F.levenshtein("word", "suggestion", edits) >= 0
    )


def _most_frequent(pairs: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("freq")).alias("rarity"), F.col("suggestion").alias("correction")))
    return pairs.groupBy("word").agg(best.alias("best")).select("word", "best.correction")


def corrections_by_frequency(unknown: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, correction) by (distance up to 2, frequency, alphabet).

    Only words without a listed word one edit away go on to two edits.
    """
    found = cut_lineage(_most_frequent(near_pairs(unknown, dictionary, 1)))  # read for the rest as well
    rest = unknown.join(found, "word", "left_anti")
    return found.unionByName(_most_frequent(near_pairs(rest, dictionary, MAX_EDITS)))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(words: pd.Series, others: pd.Series) -> pd.Series:
    """Share of matching runs of letters between two words."""
    ratios = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(words, others, strict=True)]
    return pd.Series(ratios, dtype="float64")


def corrections_by_similarity(unknown: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, correction): the suggestion with the highest ratio, then by alphabet."""
    pairs = near_pairs(unknown, dictionary, MAX_EDITS).select("word", "suggestion").distinct()
    rated = pairs.withColumn("ratio", sequence_ratio("word", "suggestion"))
    best = F.min(F.struct((-F.col("ratio")).alias("loss"), F.col("suggestion").alias("correction")))
    return rated.groupBy("word").agg(best.alias("best")).select("word", "best.correction")


METHODS = {"frequency": corrections_by_frequency, "similarity": corrections_by_similarity}


def corrections(
    counts: DataFrame, dictionary: DataFrame, method: str = "frequency", keep: list[str] | None = None
) -> DataFrame:
    """(word, correction) of the words in ``counts`` that have one, written out."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: use 'frequency' or 'similarity'")
    unknown = cut_lineage(unknown_words(counts, dictionary, keep))
    return cut_lineage(METHODS[method](unknown, dictionary))


def spelled_words(corrected: DataFrame) -> Callable[[Column], Column] | None:
    """Words to corrected words, by a (word, correction) table that is broadcast; None if it is too large."""
    found = word_map(corrected, "word", "correction")
    if found is None:
        return None
    return lambda words: F.zip_with(words, found(words), lambda word, other: F.coalesce(other, word))


def correct_by_join(
    docs: DataFrame, corrected: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, corrected) by a (word, correction) table of any size."""
    words = docs.select(id_col, F.posexplode_outer(split_words(text_col)).alias("pos", "word"))
    mapped = salted_join(words, corrected, "word", [id_col, "pos"], counts, "left")
    return join_words(mapped, id_col, F.coalesce("correction", "word"), "corrected")


def correct_spelling(
    docs: DataFrame,
    dictionary: DataFrame,
    method: str = "frequency",
    keep: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    counts: DataFrame | None = None,
) -> DataFrame:
    """(doc, corrected): every unknown word replaced by its correction, if it has one.

    ``dictionary`` is (word, freq). ``keep`` lists words, such as names, that stay. A missing
    text reads as ``NULL``. The texts are written once, as they are read for the words and for
    the result; if the corrections are small, which is measured, they are made inside the rows.
    ``counts`` is a written (word, n) table of the texts' words, if the caller has one.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: use 'frequency' or 'similarity'")
    spark = docs.sparkSession
    docs = docs.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(P.NULL_TOKEN)))
    path = new_path(spark, "texts")
    texts_by_id(docs, id_col, text_col).write.parquet(path)
    texts = spark.read.parquet(path)
    plain = texts.select(id_col, F.explode("_texts").alias(text_col))
    if counts is None:
        counts = cut_lineage(word_counts(plain, text_col))
    listed = cut_lineage(dictionary.select("word", "freq"))
    corrected = corrections(counts, listed, method, keep)
    spell = spelled_words(corrected)
    if spell is None:
        return correct_by_join(plain, corrected, counts, id_col, text_col)
    text = joined_by_place(spell(F.col("_words")), split_words)
    return words_by_id(texts, split_words).select(id_col, text.alias("corrected"))


def correct_spelling_frequency(docs: DataFrame, dictionary: DataFrame, **options) -> DataFrame:
    return correct_spelling(docs, dictionary, "frequency", **options)


def correct_spelling_similarity(docs: DataFrame, dictionary: DataFrame, **options) -> DataFrame:
    return correct_spelling(docs, dictionary, "similarity", **options)
