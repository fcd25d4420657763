"""Tags of words by their context: a hidden Markov model fitted on an annotated table.

Counting is grouping in Spark; the model is a table with a row per word and two small lists per
tag. Scores are whole thousandths of a natural logarithm, so the best path does not depend on
the order in which numbers are added. Sentences are decoded where they lie, all those of a batch
in step.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmill.functions.arrays import group_sorted
from quillmill.functions.tokens import tokenize_words
from quillmill.operators.features import fitted_values
from quillmill.plans.joins import lookup_join
from quillmill.plans.shipping import ship
from quillmill.plans.storage import written

# where a sentence ends
SENTENCE_END = r"[.!?\n]+"
MAX_TAGS = 64
LETTER = 32  # a tag number and this is the code of a letter
SLICE = 1 << 17  # words of lines that are decoded together
CHUNK_BYTES = 8 << 20  # of texts whose words meet the word table together


class TagModel(NamedTuple):
    """``words`` is (form, scores), one score per tag in the order of ``tags``; the rest is per tag."""

    tags: list[str]
    words: DataFrame
    unknown: list[int]
    first: list[int]
    following: list[list[int]]


def _score(count: Column, total: Column) -> Column:
    return F.round(F.log(count / total) * 1000).cast("bigint")


def _thousandths(count: int, total: int) -> int:
    return round(float(np.log(count / total)) * 1000)


def fit_tagger(annotated: DataFrame, sentence: list[str]) -> TagModel:
    """The model of a table of annotated words: the ``sentence`` columns, pos, form, tag.

    Every count has one added to it. The word table may have any size; tags are a fixed set of at
    most 64, more are an error. Words without a form or a tag are left out of the counts of forms,
    and a sentence goes on behind them. An annotated table without words is an error.
    """
    rows = annotated.where(F.col("form").isNotNull() & F.col("tag").isNotNull())
    counts = rows.groupBy("form", "tag").agg(F.count(F.lit(1)).alias("n"))
    found = written(counts.groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("n")), "forms")
    counts = found.select(F.explode("n").alias("tag", "n"))
    tags = fitted_values(counts, "tag", MAX_TAGS)
    if not tags:
        raise ValueError("no annotated words")
    n_forms = found.count()
    per_tag = {r["tag"]: r["n"] for r in counts.groupBy("tag").agg(F.sum("n").alias("n")).collect()}
    totals = [per_tag[tag] + n_forms for tag in tags]
    scores = [
        _score(F.coalesce(F.try_element_at("n", F.lit(tag)), F.lit(0)) + 1, F.lit(total))
        for tag, total in zip(tags, totals, strict=True)
    ]
    return TagModel(
        tags, found.select("form", F.array(*scores).alias("scores")),
        [_thousandths(1, total) for total in totals], *_transitions(rows, sentence, tags),
    )


def neighbours(rows: pa.Table, keys: list[str], whole: bool) -> np.ndarray:
    """Whether each row but the first has the sentence of the row before and, if places are ``whole``, the next place."""
    same = np.full(max(len(rows) - 1, 0), whole)
    try:
        for key in keys:
            column = rows[key].combine_chunks()
            one, other = column[:-1], column[1:]
            both = pc.or_(pc.fill_null(pc.equal(one, other), False), pc.and_(one.is_null(), other.is_null()))
            same &= both.to_numpy(zero_copy_only=False)
        if whole:
            pos = rows["pos"].combine_chunks().cast(pa.int64())
            far = pc.subtract(pos[1:], pos[:-1])  # wraps around
            same &= pc.fill_null(pc.equal(far, 1), False).to_numpy(zero_copy_only=False)
    except pa.ArrowNotImplementedError:  # keys that cannot be compared here
        same[:] = False
    return same


def _tags_in_order(rows: DataFrame, sentence: list[str], number: Column) -> DataFrame:
    """``tags``: the tag numbers of each sentence by place, then number.

    Only runs are shuffled: the first place and a letter per tag of words that follow each other here
    as in their sentence.
    """
    ship(rows.sparkSession)
    place = rows.schema["pos"].dataType
    whole = place.typeName() in ("byte", "short", "integer", "long")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            start = np.flatnonzero(np.append(True, ~neighbours(table, sentence, whole)))[: len(table)]
            letters = (table["tag"].to_numpy() + LETTER).astype(np.uint8)
            ends = np.append(start, len(letters)).astype(np.int32)
            tags = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(letters.tobytes()))
            yield from table.drop_columns(["tag"]).take(pa.array(start)).append_column("tags", tags).to_batches()

    marked = rows.select(*sentence, "pos", number.alias("tag"))
    kinds = StructType([marked.schema[c] for c in [*sentence, "pos"]]).add("tags", "string")
    lines = marked.mapInArrow(runs, kinds).repartition(*sentence).groupBy(*sentence)

    def apart(run: Column) -> Column:
        def word(letter: Column, i: Column) -> Column:
            pos = (run["pos"] + i).cast(place) if whole else run["pos"]
            return F.struct(pos.alias("pos"), (F.ascii(letter) - LETTER).cast("tinyint").alias("tag"))

        return F.transform(F.split(run["tags"], ""), word)

    placed = F.sort_array(F.flatten(F.transform("runs", apart)))
    return lines.agg(F.collect_list(F.struct("pos", "tags")).alias("runs")).select(F.transform(placed, lambda w: w["tag"]).alias("tags"))


def _transitions(rows: DataFrame, sentence: list[str], tags: list[str]) -> tuple[list[int], list[list[int]]]:
    """Scores of each tag at the start of a sentence, and of each behind each.

    The words of a sentence are gathered in order: a sentence is a row anyway when it is decoded.
    """
    number = F.array_position(F.array(*[F.lit(tag) for tag in tags]), F.col("tag")).cast("tinyint")
    lines = _tags_in_order(rows, sentence, number)
    before = F.concat(F.array(F.lit(None).cast("tinyint")), F.slice("tags", F.lit(1), F.size("tags") - 1))
    pairs = lines.select(F.inline(F.arrays_zip(before.alias("a"), F.col("tags").alias("b"))))
    # at most one row per pair of tags
    name = {None: None} | dict(enumerate(tags, 1))
    n = {(name[r["a"]], name[r["b"]]): r["n"] for r in pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}

    def row(a: str | None) -> list[int]:
        total = sum(n.get((a, b), 0) for b in tags) + len(tags)
        return [_thousandths(n.get((a, b), 0) + 1, total) for b in tags]

    return row(None), [row(a) for a in tags]


def best_paths(scores: np.ndarray, sizes: np.ndarray, first: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The tag numbers of the best path through each sentence; of equal ones the smaller number from the end on.

    ``scores`` has a row per word and a column per tag; ``sizes`` are the lengths of the
    sentences that follow each other in it. Step i is taken in all sentences of over i words at
    once, the longest first.
    """
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    starts, sizes = starts[order], sizes[order]
    came_from = np.zeros(scores.shape, np.int8)
    path = np.zeros(len(scores), np.int64)
    if not len(order):
        return path
    sums = first + scores[starts]
    ends = np.zeros(len(order), np.int64)
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) + 1), "left")
    for i in range(1, int(sizes[0]) + 1):
        more = int(active[i])
        ends[more : len(sums)] = sums[more:].argmax(1)
        if not more:
            break
        at = starts[:more] + i
        ways = sums[:more, :, None] + following
        came_from[at] = ways.argmax(1)
        sums = ways.max(1) + scores[at]
    path[starts + sizes - 1] = ends
    for i in range(int(sizes[0]) - 1, 0, -1):
        at = starts[: int(active[i])] + i
        path[at - 1] = came_from[at, path[at]]
    return path


def looked_up(known: pa.Array, forms: pa.Array, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scores of the different forms, from a list of (form, scores), and the number of each form among them."""
    coded = forms.dictionary_encode(null_encoding="encode")
    table = known.field("scores").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(unknown))
    table = np.concatenate([table, unknown[None]])
    place = pc.fill_null(pc.index_in(coded.dictionary, known.field("form")), len(known)).to_numpy(zero_copy_only=False)
    return table[place], coded.indices.to_numpy(zero_copy_only=False)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


def decoded(
    docs: DataFrame, model: TagModel, id_col: str, text_col: str, words: Callable[[Column], Column], whole_ids: bool
) -> DataFrame:
    """(doc, sentences, tags): for each text of a row the words of its sentences, and a tag for each in one list.

    With ``whole_ids`` all texts of an id are one row, else a row has the one text it had.
    Texts are dealt once, to chunks by id and text, or by id. Only a chunk's different
    words meet the word table; their scores come back to the chunk as one list, and no word is
    shuffled once it has its tag.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    # a given number of partitions, not coalesced by bytes, as much is done to a text behind the shuffle
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(partitions, math.ceil((size["bytes"] or 0) / CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64(id_col) if whole_ids else F.xxhash64(id_col, text_col), F.lit(chunks)).cast("int")
    entry = F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    dealt = docs.select(chunk.alias("_chunk"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(partitions, "_chunk")
    texts = dealt.select("_chunk", "id", F.array("text").alias("texts"))
    if whole_ids:
        texts = dealt.groupBy("_chunk", "id").agg(F.collect_list("text").alias("texts"))
    # a chunk is a row; where very many rows are alike it is several
    most = 4 * math.ceil((size["n"] + 1) / partitions)
    part = F.floor(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) / most)
    rows = texts.withColumn("_part", part).groupBy("_chunk", "_part").agg(F.collect_list(F.struct("id", "texts")).alias("_docs"))
    none = F.array().cast("array<array<string>>")

    def lines_of(text: Column) -> Column:
        return F.coalesce(F.transform(F.split(text, SENTENCE_END), words), none)

    sentences = F.transform("_docs", lambda d: F.transform(d["texts"], lines_of))
    forms = rows.select("_chunk", F.explode(F.array_distinct(F.flatten(F.flatten(F.flatten(sentences))))).alias("form")).distinct()
    scored = lookup_join(forms, model.words, "form").groupBy("_chunk").agg(
        F.collect_list(F.struct("form", "scores")).alias("known")
    )
    read = rows.select("_chunk", F.transform("_docs", lambda d: d["id"]).alias("_ids"), sentences.alias("sentences"))
    met = read.join(scored, "_chunk", "left")
    tags, first, following = model.tags, np.array(model.first), np.array(model.following)
    unknown = np.array(model.unknown)

    def paths(texts: pa.Array, known: pa.Array) -> pa.Array:
        lines = texts.flatten()
        table, code = looked_up(known, lines.flatten(), unknown)
        sizes, per_text = _lengths(lines), _lengths(texts)
        lines_to, words_to = np.append(0, np.cumsum(per_text)), np.append(0, np.cumsum(sizes))
        # lines are taken some thousand words at a time
        cuts = [0, *(np.flatnonzero(np.diff(words_to[1:] // SLICE)) + 1).tolist(), len(sizes)]
        path = [best_paths(table[code[words_to[a] : words_to[b]]], sizes[a:b], first, following) for a, b in itertools.pairwise(cuts)]
        named = pa.DictionaryArray.from_arrays(pa.array(np.concatenate(path), pa.int32()), pa.array(tags, pa.string()))
        return _lists(np.diff(words_to[lines_to]), named.cast(pa.string()))

    def decode(chunks: pa.Array, known: pa.Array) -> pa.Array:
        nothing = known.type.value_type
        each = [paths(chunk.values.flatten(), k.values if k.is_valid else pa.array([], nothing)) for chunk, k in zip(chunks, known, strict=True)]
        by_text = pa.concat_arrays(each or [pa.array([], pa.list_(pa.string()))])
        return _lists(_lengths(chunks), _lists(_lengths(chunks.flatten()), by_text))

    found = met.withColumn("tags", F.arrow_udf(decode, "array<array<array<string>>>")("sentences", "known"))
    return found.select(F.inline(F.arrays_zip(F.col("_ids").alias(id_col), F.col("sentences"), F.col("tags"))))


def placed_tags(sentences: Column, tags: Column) -> Column:
    """Array of (sentence, pos, form, tag), in the order of the text."""
    words = F.flatten(
        F.transform(
            sentences,
            lambda line, s: F.transform(
                line, lambda form, pos: F.struct(s.alias("sentence"), pos.alias("pos"), form.alias("form"))
            ),
        )
    )
    return F.zip_with(
        words,
        tags,
        lambda word, tag: F.struct(word["sentence"].alias("sentence"), word["pos"].alias("pos"), word["form"].alias("form"), tag.alias("tag")),
    )


def tag_words(
    docs: DataFrame, model: TagModel, id_col: str = "doc_id", text_col: str = "text",
    words: Callable[[Column], Column] = tokenize_words,
) -> DataFrame:
    """(doc, sentence, pos, form, tag) of every word, by the best path through its sentence.

    Each row of ``docs`` is tagged on its own, also where ids repeat or are null. A missing or
    empty text has no words. Words the model does not know have the scores of a word seen never.
    """
    found = decoded(docs, model, id_col, text_col, words, False)
    return found.select(id_col, F.inline(placed_tags(F.get("sentences", F.lit(0)), F.get("tags", F.lit(0)))))


def nouns_in_context(
    docs: DataFrame, model: TagModel, id_col: str = "doc_id", text_col: str = "text",
    words: Callable[[Column], Column] = tokenize_words,
) -> DataFrame:
    """(doc, nouns): map word to NOUN or PROPN for each different id, by its last such place in the text.

    A missing id has no nouns.
    """
    named = docs.withColumn(text_col, F.when(F.col(id_col).isNotNull(), F.col(text_col)))
    found = decoded(named, model, id_col, text_col, words, True)

    def nouns_of(sentences: Column, tags: Column) -> Column:
        nouns = F.filter(placed_tags(sentences, tags), lambda w: w["tag"].isin("NOUN", "PROPN"))
        return F.transform(
            nouns, lambda w: F.struct(w["form"].alias("form"), w["sentence"].alias("sentence"), w["pos"].alias("pos"), w["tag"].alias("tag"))
        )

    nouns = group_sorted(F.flatten(F.zip_with("sentences", "tags", nouns_of)), "form")
    pairs = F.transform(nouns, lambda group: F.struct(F.element_at(group, -1)["form"], F.element_at(group, -1)["tag"]))
    return found.select(id_col, F.map_from_entries(pairs).alias("nouns"))
