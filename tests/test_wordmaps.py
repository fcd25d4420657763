"""Small word tables are read inside the rows: no word goes through a shuffle, and large ones give the same rows."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_shuffles import plan_of

from quillmill.operators import features as FE
from quillmill.operators import lexicon as L
from quillmill.operators import spelling as S
from quillmill.operators import vectors as V
from quillmill.plans import wordmaps as W
from quillmill.plans.posts import enrich_posts

TEXTS = [(1, "teh red fux runs"), (1, "b  teh"), (2, None), (3, ""), (4, "foxes 12 went zzzzzz"), (None, "teh fox"), (None, "a teh")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame([("the", 9), ("red", 3), ("fox", 5), ("run", 2)], "word string, freq bigint")


def shuffled_by(df):
    return re.findall(r"Exchange (?:hash|range)partitioning\(([^)]*)\)", plan_of(df))


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("method", ["frequency", "similarity"])
def test_corrections_are_made_inside_the_rows(texts, listed, method, monkeypatch):
    near = S.correct_spelling(texts, listed, method)
    assert shuffled_by(near) == []
    found = rows(near)
    monkeypatch.setattr(W, "TABLE_BYTES", 0)
    assert found == rows(S.correct_spelling(texts, listed, method))
    corrected = dict(found.keys())
    # the words of an id with two texts stand by place, then word, as they did
    assert corrected[4] == "fox 12 went zzzzzz" and corrected[3] == "" and corrected[1].startswith("b the red the fox")


def test_counts_of_the_caller_are_used(texts, listed):
    words = texts.where("text is not null")
    counts = S.word_counts(words).where("word <> 'teh'")
    left = dict(map(tuple, S.correct_spelling(words.where("doc_id = 1"), listed, counts=counts).collect()))
    assert "teh" in left[1] and "fox" in left[1]


def test_posts_are_enriched_without_a_join(texts, listed, monkeypatch):
    posts = texts.withColumnRenamed("text", "clean_tweet_text")
    near = enrich_posts(posts, listed)
    assert "Exchange" not in plan_of(near) and "Join" not in plan_of(near)
    found = rows(near)
    monkeypatch.setattr(W, "TABLE_BYTES", 0)
    assert found == rows(enrich_posts(posts, listed).select(*near.columns))
    assert sum(found.values()) == len(TEXTS)


def test_lemmas_are_read_inside_the_rows(spark, texts, monkeypatch):
    lexicon = spark.createDataFrame(
        [("went", "go"), ("red", "-PRON-"), ("fux", None), ("runs", "run"), ("runs", "ran"), (None, "x")], "form string, lemma string"
    )
    near = L.lemmatize(texts, lexicon)
    assert [by.split("#")[0] for by in shuffled_by(near)] == ["doc_id"]
    found = rows(near)
    assert dict(found.keys())[4].split()[2] == "go"
    assert dict(found.keys())[1].split()[-1] == "ran"
    monkeypatch.setattr(W, "TABLE_BYTES", 0)
    assert found == rows(L.lemmatize(texts, lexicon))


@pytest.mark.parametrize("unknown", ["null", "drop"])
def test_tokens_are_not_sorted_for_their_vectors(spark, texts, unknown, monkeypatch):
    vectors = spark.createDataFrame(
        [("fox", [1.0, 2.0]), ("fox", [0.5, 9.0]), ("teh", None), ("far", [3.0, 3.0]), (None, [1.0, 1.0])],
        "word string, vector array<float>",
    )
    split = F.split(F.coalesce("text", F.lit("")), " ")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = V.vectors_for_text(texts, vectors, split, unknown)
        assert shuffled_by(near) == []
        found = Counter((r.doc_id, r.pos, r.term, str(r.vector)) for r in near.collect())
        monkeypatch.setattr(V, "TABLE_BYTES", 0)
        far = V.vectors_for_text(texts, vectors, split, unknown)
        assert "SortMergeJoin" not in plan_of(far) and "ShuffledHashJoin" in plan_of(far)
        assert found == Counter((r.doc_id, r.pos, r.term, str(r.vector)) for r in far.collect())
        assert found[None, 1, "fox", "[0.5, 9.0]"] == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_places_are_found_without_sorting_the_words(spark):
    rows = [(5, "b a b"), (-3, "c d"), (5, "d e a f"), (None, "g c"), (2**63 - 1, "z b"), (-(2**63), "y")]
    places, aggregates = {}, {}
    for kind in ("bigint", "string"):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        vocab = FE.build_vocab_first_seen(docs)
        places[kind] = {r.term: r.term_id for r in vocab.collect()}
        first = FE.explode_tokens(docs, F.split("text", " ")).withColumnRenamed("term", "t")
        aggregates[kind] = plan_of(first.groupBy("t").agg(F.min(FE._place(first, "doc_id"))))
    assert "SortAggregate" in aggregates["string"] and "SortAggregate" not in aggregates["bigint"]
    order = sorted(places["bigint"], key=places["bigint"].get)
    # a missing id first; b and d stand first in the texts of id 5, but d was seen in that of -3
    assert order == ["g", "c", "y", "d", "b", *sorted("ae", key=order.index), "f", "z"]
    assert sorted(places["bigint"].values()) == list(range(1, len(order) + 1)) and order[-1] == "z"


def test_vocabularies_are_hashed(spark, texts):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan_of(FE.one_hot_tokens(texts, FE.build_vocab_first_seen(texts)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
