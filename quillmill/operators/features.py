"""Vocabularies, bags of words, TF-IDF and one-hot tables.

Documents are rows (doc_id, text); matrices are long tables (doc_id, term, value), which
grow with the text and not with documents times vocabulary. Dense forms exist for a
vocabulary given by the caller.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import quick_preprocess
from quillmill.functions.tokens import ngrams, split_words, tokenize_words
from quillmill.plans.ids import with_dense_ids
from quillmill.plans.joins import lookup_join, salted_join
from quillmill.plans.storage import cut_lineage


def explode_tokens(docs: DataFrame, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """Rows (doc, pos, term), positions from 0."""
    return docs.select(id_col, F.posexplode(tokens).alias("pos", "term"))


def bag_of_words(
    docs: DataFrame, n: int = 1, binary: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, term, count) of words or n-grams; ``binary`` gives 1 for each term present.

    Texts are dealt by id and taken apart behind the shuffle, which so carries a text and not each
    of its terms with the id; the counts need no other.
    """
    # a given number of partitions, not coalesced by bytes, as a text grows into many terms
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(id_col, F.col(text_col).alias("_text")).repartition(partitions, id_col)
    terms = texts.select(id_col, F.explode(ngrams(tokenize_words("_text"), n)).alias("term"))
    if binary:
        return terms.distinct().withColumn("count", F.lit(1).cast("bigint"))
    return terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("count"))


def vocab_alphabetical(bag: DataFrame) -> DataFrame:
    """(term, term_id), ids from 0 in the order of the terms."""
    return with_dense_ids(bag.select("term").distinct(), [F.col("term")], "term_id")


def vocab_sorted_by_id(vocab: DataFrame) -> DataFrame:
    return vocab.orderBy("term_id")


INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _place(words: DataFrame, id_col: str) -> Column:
    """What orders words by id, a missing one first, then by position.

    One number for ids that are whole numbers: its least one is found by hashing, where that of
    pairs needs all words sorted.
    """
    if dict(words.dtypes)[id_col] not in INTEGERS:
        return F.struct(id_col, "pos")
    number = F.coalesce(F.col(id_col).cast("decimal(20,0)"), F.lit(Decimal(-(2**63) - 1)).cast("decimal(20,0)"))
    return number * F.lit(Decimal(2**31)).cast("decimal(10,0)") + F.col("pos")


def build_vocab_first_seen(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_empty: bool = True
) -> DataFrame:
    """(term, term_id), ids from 1 in the order in which the words first appear.

    Words are cut at single blanks after the quick clean-up, so that a blank at either
    end of a text gives an empty word; ``keep_empty=False`` leaves it out.
    """
    words = explode_tokens(docs, F.split(quick_preprocess(text_col), " "), id_col)
    if not keep_empty:
        words = words.where(F.col("term") != "")
    first = words.groupBy("term").agg(F.min(_place(words, id_col)).alias("first"))
    return with_dense_ids(first, [F.col("first")], "term_id", start=1).select("term", "term_id")


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, n): rows per term."""
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def bow_transform(
    docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 1,
    binary: bool = False,
) -> DataFrame:
    """Counts of the known terms of new texts, by term id; unknown terms are left out."""
    bag = bag_of_words(docs, n, binary, id_col, text_col)
    joined = lookup_join(bag, vocab.select("term", "term_id"), "term")
    return joined.select(id_col, "term_id", "term", "count")


def document_frequency(bag: DataFrame) -> DataFrame:
    """(term, df): in how many documents a term occurs; ``bag`` has one row for each."""
    return bag.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf_smooth(bag: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1; ``n_docs`` is one row (n_docs)."""
    idf = F.log((1 + n_docs.scalar()) / (1 + F.col("df"))) + 1
    return document_frequency(bag).withColumn("idf", idf)


def count_docs(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.agg(F.count_distinct(id_col).alias("n_docs"))


def tf_idf(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 1, use_idf: bool = True
) -> DataFrame:
    """(doc, term, tf_idf), each document scaled to length 1.

    Words meet their idf once; the length of a document is a sum over its rows where they are
    brought together, so the join is not made a second time for it. A missing id has no rows.
    """
    # read for the counts and for the result, and far cheaper read than counted
    bag = bag_of_words(docs, n, id_col=id_col, text_col=text_col)
    if use_idf:
        bag = cut_lineage(bag)
        # a row per term, read twice by the join: cheaper written once than counted twice
        idf = cut_lineage(idf_smooth(bag, count_docs(docs, id_col)))
        counts = idf.select("term", F.col("df").alias("n"))
        weighted = salted_join(bag, idf.select("term", "idf"), "term", [id_col], counts)
        weighted = weighted.withColumn("weight", F.col("count") * F.col("idf"))
    else:
        weighted = bag.withColumn("weight", F.col("count").cast("double"))
    weight = F.col("weight")
    norm = F.sqrt(F.sum(weight * weight).over(Window.partitionBy(id_col)))
    known = weighted.where(F.col(id_col).isNotNull())
    return known.select(id_col, "term", (weight / norm).alias("tf_idf"))


def matrix_shape(docs: DataFrame, bag: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row (docs, terms); documents without a known term count as well."""
    terms = bag.agg(F.count_distinct("term").alias("terms"))
    return docs.agg(F.count_distinct(id_col).alias("docs")).withColumn("terms", terms.scalar())


def vocab_size(bag: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("term") if approximate else F.count_distinct("term")
    return bag.agg(count.alias("vocab_size"))


def fitted_values(df: DataFrame, column: str, limit: int = 1000) -> list[str]:
    """The different values of a column that are not null, sorted by code point.

    They are to become columns, so more than ``limit`` of them are an error, not cut off; no
    more than one beyond the limit comes to the driver.
    """
    found = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column!r} has more than {limit} values, too many for a column each")
    return sorted(row[0] for row in found)


def dense_matrix(
    docs: DataFrame, matrix: DataFrame, vocab: list[str] | None, value_col: str, id_col: str = "doc_id"
) -> DataFrame:
    """A row per document and a column per term; 0 if absent.

    The terms are those of ``vocab``, or without one all that ``matrix`` holds.
    """
    vocab = fitted_values(matrix, "term") if vocab is None else vocab
    wide = matrix.groupBy(id_col).pivot("term", vocab).agg(F.first(value_col))
    return docs.select(id_col).join(wide, id_col, "left").na.fill(0)


def dense_rows(docs: DataFrame, matrix: DataFrame, vocab: DataFrame, value_col: str, id_col: str = "doc_id") -> DataFrame:
    """(doc, values): a row per document with one value per term of ``vocab``, in the order of its ids.

    ``vocab`` is (term, term_id), ids from 0; a vocabulary of any size gives an array of that
    length, not a column per term. Each document's own entries are gathered first, then laid
    into zeros, so only the row that is asked for is dense.
    """
    size = vocab.agg(F.count(F.lit(1)).cast("int").alias("size"))
    known = lookup_join(matrix.select(id_col, "term", value_col), vocab.select("term", "term_id"), "term")
    entries = known.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("term_id").cast("int"), F.col(value_col).cast("double")))).alias("_own")
    )
    rows = docs.select(id_col).join(entries, id_col, "left").withColumn("_size", size.scalar())
    none = F.create_map().cast("map<int,double>")
    ids = F.when(F.col("_size") > 0, F.sequence(F.lit(0), F.col("_size") - 1)).otherwise(F.array().cast("array<int>"))
    held = F.coalesce("_own", none)
    return rows.select(id_col, F.transform(ids, lambda i: F.coalesce(F.try_element_at(held, i), F.lit(0.0))).alias("values"))


def one_hot_tokens(
    docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, pos, term, term_id): the place of the 1 for every token, null if unknown.

    Where the vocabulary is too large for a broadcast it is hashed, as there are far more tokens to sort.
    """
    words = explode_tokens(docs, split_words(quick_preprocess(text_col)), id_col)
    joined = lookup_join(words, vocab.select("term", "term_id").hint("shuffle_hash"), "term", "left")
    return joined.select(id_col, "pos", "term", "term_id")


def one_hot_dense(text: Column, vocab: list[str]) -> Column:
    """Per token a list of 0 and 1 over a given, bounded vocabulary."""
    words = F.array(*[F.lit(word) for word in vocab])
    return F.transform(
        split_words(text), lambda token: F.transform(words, lambda word: (word == token).cast("int"))
    )


def label_encode(df: DataFrame, column: str, key: list[str]) -> DataFrame:
    """``key`` columns, the value and its id from 0 in the order of the values."""
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ids = with_dense_ids(values, [F.col(column)], "label_id")
    coded = salted_join(
        df.select(*key, column), ids.select(column, "label_id"), column, key, ids.select(column, "n"), "left"
    )
    return coded.select(*key, column, "label_id")


def one_hot_categories(df: DataFrame, column: str, values: list[str] | None, key: list[str]) -> DataFrame:
    """A 0/1 column for each of the given values, or without them for all the column holds, in sorted order.

    A null, and a value that is not among those given, has a 0 in every column.
    """
    values = fitted_values(df, column) if values is None else values
    flags = [F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(v) for v in sorted(values)]
    return df.select(*key, *flags)
