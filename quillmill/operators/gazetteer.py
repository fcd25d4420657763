"""A gazetteer as an automaton over words: a trie of its phrases with failure links.

States are the beginnings of phrases. The automaton is kept as two tables that joins make
from the phrases: transitions (state, word, next), where what a state has no step for is taken
from the longest end of it that has one, and outputs (state, n, phrase, label), the
phrases that end where the state is reached. A text is then read once, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.tokens import split_words
from quillmill.plans.shipping import ship
from quillmill.plans.storage import cut_lineage

TABLE_BYTES = 64 << 20  # of the automaton's tables; a larger gazetteer is met by joins
ENTRY_BYTES = 200  # of an entry in memory besides its letters
HIT = "start:int,n:int,phrase:string,label:string,start_char:int,end_char:int"


def listed_phrases(gazetteer: DataFrame) -> DataFrame:
    """(phrase, label, words): each phrase once, with its first label; only those that are words joined by blanks."""
    labels = gazetteer.groupBy("phrase").agg(F.min("label").alias("label"))
    cut = labels.withColumn("words", split_words("phrase"))
    return cut.where((F.size("words") > 0) & (F.array_join("words", " ") == F.col("phrase")))


def automaton_tables(phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transitions (state, word, next) and outputs (state, n, phrase, label).

    A state is named by the words that lead to it, joined by blanks; the start is the empty name.
    Transitions back to the start are left out, and those of the start are followed where
    a state has none for a word.
    """
    lengths = F.sequence(F.lit(1), F.size("words"))
    begun = phrases.select(F.explode(F.transform(lengths, lambda k: F.slice("words", 1, k))).alias("w")).distinct()
    named = begun.select("w", F.array_join("w", " ").alias("state"))
    edges = named.select(
        F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " ").alias("end"),
        F.element_at("w", -1).alias("word"),
        F.col("state").alias("next"),
    )
    # all ends of a state that are states themselves, the state included
    cuts = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.slice("w", i, F.size("w")))
    ends = named.select("state", F.explode(cuts).alias("e")).select(
        "state", F.array_join("e", " ").alias("end"), F.size("e").alias("n")
    )
    ends = ends.join(named.select(F.col("state").alias("end")), "end")
    steps = ends.join(edges, "end").groupBy("state", "word").agg(F.max_by("next", "n").alias("next"))
    start = edges.where("end = ''").select(F.col("end").alias("state"), "word", "next")
    outputs = ends.join(phrases.select(F.col("phrase").alias("end"), "label"), "end").select(
        "state", "n", F.col("end").alias("phrase"), "label"
    )
    return start.unionByName(steps), outputs


class Automaton:
    """The tables as dictionaries, with numbers for states; 0 is the start."""

    def __init__(self, transitions: list, outputs: list):
        numbers = {"": 0}
        for row in transitions:
            numbers.setdefault(row["next"], len(numbers))
        self.steps: list[dict[str, int]] = [{} for _ in numbers]
        for row in transitions:
            self.steps[numbers[row["state"]]][row["word"]] = numbers[row["next"]]
        self.ends: list[list[tuple[int, str, str]]] = [[] for _ in numbers]
        for row in outputs:
            self.ends[numbers[row["state"]]].append((row["n"], row["phrase"], row["label"]))

    def hits(self, words: list[str]) -> list[tuple[int, int, str, str]]:
        """(start, n, phrase, label) of all phrases in ``words``, by where they end."""
        found, state, steps, ends = [], 0, self.steps, self.ends
        start = steps[0]
        for i, word in enumerate(words):
            after = steps[state].get(word) if state else None
            state = start.get(word, 0) if after is None else after
            if ends[state]:
                found += [(i + 1 - n, n, phrase, label) for n, phrase, label in ends[state]]
        return found


def longest_of(hits: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The hits that stay, in order: the longest first, of equally long ones the first, each if it
    overlaps none that stays already."""
    taken: set[int] = set()
    kept = []
    for hit in sorted(hits, key=lambda h: (-h[1], h[0])):
        start, n = hit[:2]
        # those taken are no shorter, so one that overlaps holds an end of this one
        if start not in taken and start + n - 1 not in taken:
            taken.update(range(start, start + n))
            kept.append(hit)
    return sorted(kept)


def placed(text: str, words: list[str], hits: list[tuple[int, int, str, str]]) -> list[dict]:
    """The hits with the character offsets of their first and behind their last word."""
    starts, at = [], 0
    for word in words:
        at = text.index(word, at)
        starts.append(at)
        at += len(word)
    return [
        {"start": s, "n": n, "phrase": phrase, "label": label, "start_char": starts[s],
         "end_char": starts[s + n - 1] + len(words[s + n - 1])}
        for s, n, phrase, label in hits
    ]


def small_automaton(spark: SparkSession, gazetteer: DataFrame) -> Broadcast[Automaton] | None:
    """The automaton of a gazetteer, broadcast; None if its tables are too large, which is measured first."""
    transitions, outputs = automaton_tables(cut_lineage(listed_phrases(gazetteer)))
    letters = lambda *names: sum((F.octet_length(n) for n in names), F.lit(ENTRY_BYTES))
    sizes = transitions.select(letters("state", "word", "next").alias("b")).union(
        outputs.select(letters("state", "phrase", "label").alias("b"))
    )
    if (sizes.agg(F.sum("b")).first()[0] or 0) > TABLE_BYTES:
        return None
    return spark.sparkContext.broadcast(Automaton(transitions.collect(), outputs.collect()))


def with_hits(docs: DataFrame, gazetteer: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """(doc, hits) for each row, with the phrases found in its text; None if the gazetteer is too large.

    The size of the tables is measured before they are brought together and broadcast. Rows are
    read where they lie, so nothing is shuffled and ids may repeat.
    """
    spark = docs.sparkSession
    automaton = small_automaton(spark, gazetteer)
    if automaton is None:
        return None
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([
            ("start", pa.int32()), ("n", pa.int32()), ("phrase", pa.string()), ("label", pa.string()),
            ("start_char", pa.int32()), ("end_char", pa.int32()),
        ]))
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                words = (text or "").split()
                hits = automaton.value.hits(words)
                found.append(placed(text, words, longest_of(hits)) if hits else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[id_col, "hits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(read, f"`{id_col}` {kind}, hits array<struct<{HIT}>>")
