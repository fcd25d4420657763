"""Word vectors as a table (word, vector): look-ups, sentence vectors, nearest words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators.features import explode_tokens
from quillmill.plans.joins import lookup_join
from quillmill.plans.shipping import ship
from quillmill.plans.storage import cut_lineage, new_path

TABLE_BYTES = 64 << 20  # of vectors that are broadcast; more are met by joins
STEP = 1 << 14  # words whose vectors are laid out together


def vector_lookup(vectors: DataFrame, word: str, strict: bool = False) -> DataFrame:
    """The row of one word; ``strict`` makes an unknown word an error."""
    row = vectors.where(F.col("word") == word)
    if not strict:
        return row
    found = row.agg(F.first("word").alias("word"), F.first("vector").alias("vector"))
    checked = F.when(
        F.col("word").isNull(), F.raise_error(F.lit(f"no vector for {word!r}")).cast("string")
    ).otherwise(F.col("word"))
    return found.select(checked.alias("word"), "vector")


def vectors_for_text(
    docs: DataFrame,
    vectors: DataFrame,
    tokens: Column | None = None,
    unknown: str = "null",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc, pos, term, vector) for every token; tokens are cut at single blanks by default.

    ``unknown``: ``null`` keeps tokens without a vector, ``drop`` leaves them out,
    ``error`` fails on the first. Vectors that are small, which is measured, are broadcast: all of
    them, or those of words that occur. More are hashed, so the tokens are sorted in neither case.
    """
    if unknown not in ("null", "drop", "error"):
        raise ValueError("unknown must be 'null', 'drop' or 'error'")
    words = explode_tokens(docs, F.split(text_col, " ") if tokens is None else tokens, id_col)
    one_each = vectors.groupBy(F.col("word").alias("term")).agg(F.min("vector").alias("vector"))
    table = cut_lineage(one_each)
    if not _is_small(table):
        table = cut_lineage(table.join(words.select("term").distinct(), "term", "left_semi"))
    table = F.broadcast(table) if _is_small(table) else table.hint("shuffle_hash")
    how = "inner" if unknown == "drop" else "left"
    joined = lookup_join(words, table, "term", how)
    vector = F.col("vector")
    if unknown == "error":
        message = F.concat(F.lit("no vector for "), F.col("term"))
        vector = F.when(vector.isNull(), F.raise_error(message).cast("array<float>")).otherwise(vector)
    return joined.select(id_col, "pos", "term", vector.alias("vector"))


def _is_small(table: DataFrame) -> bool:
    """Whether the vectors of a written (term, vector) table may be broadcast."""
    cells = F.coalesce(F.size("vector"), F.lit(0))
    return (table.agg(F.sum(F.octet_length("term") + 8 * cells)).first()[0] or 0) <= TABLE_BYTES


def token_vector_or_zero(token_vectors: DataFrame, dim: int) -> DataFrame:
    """Zeros in place of the vector of an unknown token."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return token_vectors.withColumn("vector", F.coalesce("vector", zeros))


def mean_vector(
    docs: DataFrame, vectors: DataFrame, tokens: Column, dim: int, id_col: str = "doc_id"
) -> DataFrame:
    """(doc, vector): the mean over all tokens of a text, unknown tokens counting as zeros.

    Only vectors of words that occur are needed. If they are small, which is measured, they are
    broadcast and every text is summed where it lies, so that a text and not each of its words
    goes through a shuffle with a vector.
    """
    # read for the words that occur and for the sums; as a table, whose columns are written compressed
    path = new_path(docs.sparkSession, "tokens")
    docs.select(id_col, tokens.alias("_tokens")).write.parquet(path)
    texts = docs.sparkSession.read.parquet(path)
    occurring = texts.select(F.explode("_tokens").alias("word")).distinct()
    needed = cut_lineage(vectors.select("word", "vector").where("vector is not null").join(occurring, "word", "left_semi"))
    size = needed.agg(F.sum(F.octet_length("word") + 8 * dim)).first()[0] or 0
    if size > TABLE_BYTES:
        return _mean_by_joins(texts, needed, F.col("_tokens"), dim, id_col)
    ship(docs.sparkSession)
    held = needed.toArrow()
    words = held["word"].combine_chunks().dictionary_encode()
    table = np.zeros((len(words.dictionary) + 1, dim))  # the last row is that of unknown words
    rows = pc.list_flatten(held["vector"]).to_numpy().astype(float).reshape(-1, dim)
    np.add.at(table, words.indices.to_numpy(zero_copy_only=False), rows)  # a word listed twice counts twice
    kept = docs.sparkSession.sparkContext.broadcast((words.dictionary, table))

    def total(tokens: pa.Array) -> pa.Array:
        names, table = kept.value
        coded = tokens.flatten().dictionary_encode()
        row = pc.fill_null(pc.index_in(coded.dictionary, names), len(names)).to_numpy(zero_copy_only=False)
        row = np.append(row, len(names))[pc.fill_null(coded.indices, len(row)).to_numpy(zero_copy_only=False)]
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        sums = np.zeros((len(sizes), dim))
        of, known = np.repeat(np.arange(len(sizes)), sizes), row < len(names)
        of, row = of[known], row[known]
        for at in range(0, len(row), STEP):
            part = of[at : at + STEP]
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            sums[part[starts]] += np.add.reduceat(table[row[at : at + STEP]], starts)
        ends = np.arange(len(sizes) + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sums.ravel()))

    summed = texts.where(F.size("_tokens") > 0).select(
        id_col, F.size("_tokens").alias("size"), F.arrow_udf(total, "array<double>")("_tokens").alias("total")
    )
    grouped = summed.groupBy(id_col).agg(F.sum("size").alias("size"), F.collect_list("total").alias("totals"))
    added = F.aggregate(
        F.slice("totals", F.lit(2), F.size("totals")),
        F.get("totals", F.lit(0)),
        lambda a, b: F.zip_with(a, b, lambda x, y: x + y),
    )
    return grouped.select(id_col, F.transform(added, lambda x: x / F.col("size")).alias("vector"))


def _mean_by_joins(docs: DataFrame, vectors: DataFrame, tokens: Column, dim: int, id_col: str) -> DataFrame:
    """``mean_vector`` for vectors of any size.

    Tokens are counted per text first, so each (text, word) pair meets its vector once;
    unknown ones carry no vector and only count. Sums are combined before the shuffle.
    """
    counted = docs.select(id_col, F.explode(tokens).alias("term")).groupBy(id_col, "term").agg(
        F.count(F.lit(1)).alias("count")
    )
    bag = cut_lineage(counted)  # read for the vectors and for the sizes
    table = vectors.select(F.col("word").alias("term"), "vector")
    known = lookup_join(bag, table, "term").select(
        id_col, array_to_vector("vector").alias("vector"), F.col("count").cast("double").alias("count")
    )
    weighted_sum = Summarizer.metrics("sum").summary(F.col("vector"), F.col("count"))
    sums = known.groupBy(id_col).agg(weighted_sum.alias("s")).select(
        id_col, vector_to_array("s.sum").alias("total")
    )
    sizes = bag.groupBy(id_col).agg(F.sum("count").alias("size"))
    total = F.coalesce("total", F.array_repeat(F.lit(0.0), dim))
    mean = F.transform(total, lambda x: x / F.col("size"))
    return sizes.join(sums, id_col, "left").select(id_col, mean.alias("vector"))


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def similarities(vectors: DataFrame, words: list[str]) -> DataFrame:
    """(query, word, similarity): cosine of every word to each of a few asked words.

    One pass over the table; the asked vectors, as many as the caller wrote, are looked up by
    one subquery and travel as one array.
    """
    length = F.sqrt(_dot(F.col("vector"), F.col("vector")))
    entry = F.struct(F.col("word").alias("query"), "vector", length.alias("norm"))
    listed = vectors.where(F.col("word").isin(words)).agg(F.collect_list(entry).alias("asked"))
    table = vectors.withColumn("norm", length).withColumn("_asked", listed.scalar())
    asked = F.explode("_asked")
    cosine = F.try_divide(
        _dot(F.col("vector"), F.col("asked.vector")), F.col("norm") * F.col("asked.norm")
    )
    return (
        table.select("word", "vector", "norm", asked.alias("asked"))
        .where(F.col("word") != F.col("asked.query"))
        .select(F.col("asked.query").alias("query"), "word", cosine.alias("similarity"))
    )


def most_similar(vectors: DataFrame, word: str, n: int = 10) -> DataFrame:
    """The n words nearest to one word, best first."""
    return (
        similarities(vectors, [word])
        .select("word", "similarity")
        .orderBy(F.desc("similarity"), "word")
        .limit(n)
    )


def topn_similar(vectors: DataFrame, words: list[str], n: int = 10) -> DataFrame:
    """The n nearest words of each of several words, with their rank."""
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "word")
    return similarities(vectors, words).withColumn("rank", F.row_number().over(best)).where(
        F.col("rank") <= n
    )
