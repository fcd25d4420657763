"""What goes through a shuffle: texts and grams, not a row with a vector, a tag or places for each word."""

import io
import re
from contextlib import redirect_stdout

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.functions.tokens import split_words
from quillmill.operators import features as FE
from quillmill.operators import keyphrases as K
from quillmill.operators import tagging as TG
from quillmill.operators import vectors as V
from quillmill.operators import wordgraphs as G


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, "red fox red dog"), (1, "red cat"), (2, None), (3, ""), (4, "blue blue. old fox"), (None, "red fox")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_bags_are_dealt_by_id_only(texts):
    bag = FE.bag_of_words(texts, n=2)
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(bag))
    assert len(dealt) == 1 and "term" not in dealt[0]
    assert {(r.doc_id, r.term): r["count"] for r in bag.collect()}[1, "red fox"] == 1


def test_lengths_need_no_second_join(texts):
    squares = FE.tf_idf(texts).groupBy("doc_id").agg(F.sum(F.col("tf_idf") * F.col("tf_idf")).alias("s")).collect()
    assert {r.doc_id: round(r.s, 9) for r in squares} == {1: 1.0, 4: 1.0}
    assert "Window" in plan_of(FE.tf_idf(texts))


def test_texts_are_summed_where_they_lie(spark, texts, monkeypatch):
    vectors = spark.createDataFrame(
        [("red", [1.0, 2.0]), ("red", [10.0, 0.0]), ("fox", [0.5, 0.25]), ("far", [9.0, 9.0]), (None, [1.0, 1.0])],
        "word string, vector array<float>",
    )
    words = split_words(F.regexp_replace("text", "[.]", ""))
    near = V.mean_vector(texts.where("doc_id is not null"), vectors, words, 2)
    assert "Join" not in plan_of(near)
    found = {r.doc_id: r.vector for r in near.collect()}
    assert found == {1: pytest.approx([33.5 / 6, 6.25 / 6]), 4: pytest.approx([0.125, 0.0625])}
    monkeypatch.setattr(V, "TABLE_BYTES", 0)
    far = {r.doc_id: r.vector for r in V.mean_vector(texts.where("doc_id is not null"), vectors, words, 2).collect()}
    assert far == {k: pytest.approx(v) for k, v in found.items()}


def test_tagged_words_are_not_shuffled(spark, texts):
    annotated = spark.createDataFrame(
        [(0, 0, "red", "ADJ"), (0, 1, "fox", "NOUN"), (1, 0, "red", "ADJ"), (1, 1, "dog", "NOUN")],
        "s int, pos int, form string, tag string",
    )
    found = TG.tag_words(texts, TG.fit_tagger(annotated, ["s"]))
    plan = plan_of(found)
    assert -1 < plan.find("ArrowEvalPython") < plan.find("Exchange")
    assert {(r.sentence, r.pos, r.form) for r in found.where("doc_id = 4").collect()} == {
        (0, 0, "blue"), (0, 1, "blue"), (1, 0, "old"), (1, 1, "fox"),
    }


def test_words_of_a_chunk_meet_the_word_table_once(spark, texts, monkeypatch):
    annotated = spark.createDataFrame(
        [(0, 0, "red", "ADJ"), (0, 1, "fox", "NOUN"), (1, 0, "red", "ADJ"), (1, 1, "dog", "NOUN")],
        "s int, pos int, form string, tag string",
    )
    model = TG.fit_tagger(annotated, ["s"])
    many = texts.unionByName(spark.range(300).selectExpr("7 as doc_id", "'red dog. red fox' as text"))
    for ask in (TG.tag_words, TG.nouns_in_context):
        found = ask(many, model)
        assert set(re.findall(r"Exchange hashpartitioning\((\w+)", plan_of(found))) - {"form"} == {"_chunk"}
        rows = sorted(found.collect(), key=str)
        with monkeypatch.context() as small:
            small.setattr(TG, "CHUNK_BYTES", 1)
            assert sorted(ask(many, model).collect(), key=str) == rows
    assert TG.tag_words(many, model).where("doc_id = 7").groupBy("tag").count().count() == 2
    nouns = {r.doc_id: r.nouns for r in found.collect()}
    assert nouns[7] == {"dog": "NOUN", "fox": "NOUN"} and nouns[None] == nouns[2] == nouns[3] == {}


def test_only_runs_of_tags_are_shuffled(spark):
    places = [(1, i) for i in range(40)] + [(1, 7), (2, 300), (2, 299), (2, None), (None, 0), (None, 1), (3, 2**31 - 1), (3, -5), (3, 5)]
    words = [(s, p, i % 3 + 1) for i, (s, p) in enumerate(places)]
    rows = spark.createDataFrame(words, "s int, pos int, tag int").coalesce(1)
    expected = {}
    for s, p, t in words:
        expected.setdefault(s, []).append((p is not None, p, t))
    expected = sorted([t for _, _, t in sorted(own, key=lambda w: (w[0], w[1] or 0, w[2]))] for own in expected.values())
    for kind in ("int", "bigint", "double", "string"):
        padded = F.format_string("%011d", F.col("pos").cast("bigint") + 5)
        place = F.when(F.col("pos").isNotNull(), padded) if kind == "string" else F.col("pos").cast(kind)
        cast = rows.withColumn("pos", place)
        found = TG._tags_in_order(cast, ["s"], F.col("tag").cast("tinyint"))
        assert "MapInArrow" in plan_of(found)
        assert sorted(r.tags for r in found.collect()) == expected
    table = rows.toArrow()
    assert TG.neighbours(table, ["s"], True).sum() == 39 + 1  # runs of 40 and of two words, else single ones
    assert not TG.neighbours(table, ["s"], False).any()


def test_grams_meet_their_counts_without_places(texts, monkeypatch):
    found = K.keyphrases_sgrank(texts, topn=50, use_idf=True)
    assert "positions" not in plan_of(found)
    assert {r.phrase for r in found.where("doc_id = 4").collect()} >= {"blue blue", "fox", "old"}
    # grams of a single text have the idf of one document, whether they are listed or not
    alone = K.keyphrases_sgrank(texts.where("doc_id = 4"), use_idf=True).collect()
    plain = K.keyphrases_sgrank(texts.where("doc_id = 4"), use_idf=False).collect()
    assert [(r.phrase, round(r.score, 9)) for r in alone] == [(r.phrase, round(r.score, 9)) for r in plain]


def test_grams_are_counted_in_chunks_of_texts(texts, monkeypatch):
    found = K.keyphrases_sgrank(texts, topn=50, use_idf=True)
    dealt = set(re.findall(r"Exchange hashpartitioning\((\w+)", plan_of(found)))
    assert dealt == {"_chunk", "part"} and "MergeJoin" not in plan_of(found)
    rows = sorted(found.collect(), key=str)
    monkeypatch.setattr(K, "CHUNK_BYTES", 1)
    apart = K.keyphrases_sgrank(texts, topn=50, use_idf=True)
    assert len(set(re.findall(r"_chunk#\d+, (\d+)\), REPARTITION", plan_of(apart)))) == 1
    assert sorted(apart.collect(), key=str) == rows


def test_chunks_agree_on_counts():
    lists = [["red fox red  dog", "red cat"], [], ["red fox", "", "  "], ["old red fox", "red fox red fox"]]
    chunks = [G.read_joined(pa.array(lines, pa.string())) for lines in lists]
    per_row = [np.ones(len(lines), np.int64) for lines in lists]
    sent = [G.gram_counts(t, n, (1, 2, 3), 4) for t, n in zip(chunks, per_row)]
    assert sent[1] == {"part": [], "size": [], "held": []}
    back = {}
    for part in range(4):
        rows = [(c, i) for c, s in enumerate(sent) for i, p in enumerate(s["part"]) if p == part]
        held = G.total_counts([sent[c]["size"][i] for c, i in rows], [sent[c]["held"][i] for c, i in rows])
        back |= dict(zip(rows, held))
    for c, (texts, lines) in enumerate(zip(chunks, lists)):
        total = [G.unpacked(back[c, i], n, np.uint64)[0] for i, n in enumerate(sent[c]["size"])]
        found = G.grams(texts, (1, 2, 3))
        names = G.joined(texts, found.first, found.n).to_pylist()
        first, number = G.numbered_digests(*G.gram_digests(texts, found, G.digests(texts.terms)))
        assert len(first) == len(set(names)) == sum(map(len, total))
        held = {name: int(np.concatenate(total)[k]) for name, k in zip(names, number)}
        every = [f" {line} " for lines in lists for line in lines]
        assert held == {name: sum(f" {name} " in line for line in every) for name in set(names)}
