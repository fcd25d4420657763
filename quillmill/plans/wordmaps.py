"""Word tables read inside the rows of texts, so that no word of a text goes through a shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.plans.shipping import ship

TABLE_BYTES = 128 << 20  # of a word table that is broadcast; a larger one is met by a join


def word_map(table: DataFrame, key: str, value: str) -> Callable[[Column], Column] | None:
    """The values of an array of words, null where a word is not listed; None if ``table`` is too large.

    ``table`` has each key once and is written out, as it is measured first.
    """
    rows = table.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("value"))
    entry = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 16
    size = rows.agg(F.sum(entry)).first()[0] or 0
    if size > TABLE_BYTES:
        return None
    ship(table.sparkSession)
    held = rows.toArrow().combine_chunks()
    columns = [held[name].combine_chunks() if held.num_rows else pa.array([], pa.string()) for name in ("key", "value")]
    kept = table.sparkSession.sparkContext.broadcast(columns)

    def find(lists: pa.Array) -> pa.Array:
        keys, values = kept.value
        coded = lists.flatten().dictionary_encode()
        # each different word of the batch is looked up once
        found = values.take(pc.index_in(coded.dictionary, keys)).take(coded.indices)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), found.cast(pa.string()))

    return F.arrow_udf(find, "array<string>")


def texts_by_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, _texts): the texts of each id, as ids may repeat; a text is shuffled, not each of its words."""
    # a given number of partitions, not coalesced by bytes, as much is done to a text behind the shuffle
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(id_col, F.col(text_col).alias("_text")).repartition(partitions, id_col)
    return texts.groupBy(id_col).agg(F.collect_list("_text").alias("_texts"))


def words_by_id(texts: DataFrame, split: Callable[[Column], Column]) -> DataFrame:
    """``texts_by_id`` with ``_words``, the words of all texts of an id one text behind the other."""
    return texts.withColumn("_words", F.flatten(F.transform("_texts", split)))


def joined_by_place(words: Column, split: Callable[[Column], Column]) -> Column:
    """The words that came of ``_words`` joined by blanks; of an id with several texts by place in its text, then word."""
    number = F.transform("_texts", lambda text: F.transform(split(text), lambda _, i: i))
    placed = F.zip_with(F.flatten(number), words, lambda pos, word: F.struct(pos.alias("pos"), word.alias("word")))
    merged = F.transform(F.sort_array(placed), lambda entry: entry["word"])
    return F.array_join(F.when(F.size("_texts") > 1, merged).otherwise(words), " ")
