"""Tags by context, saved vectorizers, sketches, variants, other scripts and word tables from SQL, on small tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.functions.scripts import spell_in_latin
from quillmill.functions.tokens import split_words
from quillmill.operators import lexicon as L
from quillmill.operators import sketches as SK
from quillmill.operators import tagging as TG
from quillmill.operators.sqllookups import register_lookups
from quillmill.operators.vectorizers import TextVectorizer, TextVectorizerModel, model_path
from quillmill.plans.storage import new_path
from quillmill.sources import variants as VA

# --- tags ---------------------------------------------------------------------------
SENTENCES = [
    [("the", "DET"), ("run", "NOUN"), ("ends", "VERB")],
    [("dogs", "NOUN"), ("run", "VERB"), ("home", "ADV")],
    [("dogs", "NOUN"), ("run", "VERB")],
    [("the", "DET"), ("dogs", "NOUN"), ("run", "VERB")],
    [("the", "DET"), ("run", "NOUN")],
    [("anna", "PROPN"), ("ends", "VERB"), ("the", "DET"), ("run", "NOUN")],
]


def annotated(spark, sentences=SENTENCES):
    rows = [(s, p, form, tag) for s, words in enumerate(sentences) for p, (form, tag) in enumerate(words)]
    return spark.createDataFrame(rows, "s int, pos int, form string, tag string")


def test_one_form_has_different_tags_by_context(spark):
    model = TG.fit_tagger(annotated(spark), ["s"])
    docs = spark.createDataFrame([(1, "the run ends"), (2, "dogs run. the run")], "doc_id int, text string")
    found = {(r.doc_id, r.sentence, r.pos): r.tag for r in TG.tag_words(docs, model).collect()}
    assert found[1, 0, 1] == "NOUN"
    assert found[2, 0, 1] == "VERB"
    assert found[2, 1, 1] == "NOUN"
    nouns = {r.doc_id: r.nouns for r in TG.nouns_in_context(docs, model).collect()}
    assert nouns == {1: {"run": "NOUN"}, 2: {"dogs": "NOUN", "run": "NOUN"}}


def test_model_scores_are_smoothed_counts(spark):
    model = TG.fit_tagger(annotated(spark), ["s"])
    assert model.tags == ["ADV", "DET", "NOUN", "PROPN", "VERB"]
    words = {r.form: r.scores for r in model.words.collect()}
    # NOUN stands at 6 words, there are 6 forms; "run" is one 3 times
    assert words["run"][2] == round(1000 * math.log(4 / 12))
    assert model.unknown[2] == round(1000 * math.log(1 / 12))
    assert model.first[1] == round(1000 * math.log(4 / 11))
    assert model.following[1][2] == round(1000 * math.log(5 / 9))


def test_paths_against_all_paths():
    """Whole numbers from a small range give many equal paths; the score must be the best one."""
    rng = np.random.default_rng(5)
    first, following = rng.integers(-9, 0, 3), rng.integers(-9, 0, (3, 3))
    sizes = np.array([4, 0, 1, 6, 2, 0, 6])
    scores = rng.integers(-9, 0, (sizes.sum(), 3))
    path = TG.best_paths(scores, sizes, first, following)
    at = 0
    for size in sizes:
        own, tags = scores[at : at + size], path[at : at + size]
        at += size

        def total(way):
            moves = sum(following[a, b] for a, b in itertools.pairwise(way))
            return first[way[0]] + moves + sum(own[i, t] for i, t in enumerate(way))

        if size:
            assert total(tags) == max(total(way) for way in itertools.product(range(3), repeat=size))


def test_tags_of_odd_rows(spark):
    model = TG.fit_tagger(annotated(spark), ["s"])
    long = " ".join(["dogs run"] * 30_000)
    rows = [(1, None), (2, ""), (3, " ... "), (4, "zzz"), (5, long), (6, "dogs run"), (6, "dogs run"), (None, "the run")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = TG.tag_words(docs, model, words=split_words)
    counts = {r.doc_id: r["count"] for r in found.groupBy("doc_id").count().collect()}
    assert counts == {4: 1, 5: 60_000, 6: 4, None: 2}
    nouns = {r.doc_id: r.nouns for r in TG.nouns_in_context(docs.where("doc_id < 5"), model).collect()}
    assert set(nouns) == {1, 2, 3, 4} and nouns[1] == nouns[2] == nouns[3] == {}
    assert TG.tag_words(docs.limit(0), model).collect() == []
    with pytest.raises(ValueError, match="no annotated"):
        TG.fit_tagger(annotated(spark).limit(0), ["s"])


# --- vectorizers --------------------------------------------------------------------
TEXTS = [(1, "red ball red"), (2, "blue ball"), (3, None), (4, ""), (4, "Red unknown"), (None, "blue blue")]


def entries(rows, name="features"):
    return [dict(zip(r[name].indices.tolist(), r[name].values.tolist(), strict=True)) for r in rows]


def test_vectorizer_is_fitted_saved_loaded_and_applied(spark):
    train = spark.createDataFrame([("red ball",), ("blue ball",), ("ball",)], "text string")
    path = model_path(spark)
    TextVectorizer().fit(train).save(path)
    model = TextVectorizerModel.load(spark, path)
    assert [(r.term, r.term_id) for r in model.vocab.orderBy("term_id").collect()] == [("ball", 0), ("blue", 1), ("red", 2)]
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string").withColumns(
        {"features": F.lit("old"), "_row": F.lit(7), "term": F.lit("x")}
    )
    found = model.transform(docs)
    assert set(found.columns) == {"doc_id", "text", "features", "_row", "term"}
    rows = found.collect()
    assert all(r.features.size == 3 and r["_row"] == 7 and r.term == "x" for r in rows)
    by_text = {r.text: e for r, e in zip(rows, entries(rows), strict=True)}
    assert by_text == {"red ball red": {0: 1.0, 2: 2.0}, "blue ball": {0: 1.0, 1: 1.0}, None: {}, "": {}, "Red unknown": {2: 1.0}, "blue blue": {1: 2.0}}


def test_vectorizer_settings(spark):
    train = spark.createDataFrame([(1, "red ball"), (2, "blue ball"), (3, "ball")], "id int, words string")
    model = TextVectorizer("words", "v", binary=True, use_idf=True, unit_length=True).fit(train)
    row = model.transform(spark.createDataFrame([("red ball red",)], "words string")).collect()
    red, ball = math.log(4 / 2) + 1, math.log(4 / 4) + 1
    norm = math.hypot(red, ball)
    assert entries(row, "v")[0] == pytest.approx({0: ball / norm, 2: red / norm})
    assert [r.term for r in TextVectorizer("words", min_df=2).fit(train).vocab.collect()] == ["ball"]
    assert [r.term for r in TextVectorizer("words", n=2).fit(train).vocab.orderBy("term_id").collect()] == ["blue ball", "red ball"]
    empty = TextVectorizer("words").fit(train.limit(0))
    assert entries(empty.transform(train).collect()) == [{}, {}, {}]


# --- sketches -----------------------------------------------------------------------
def test_merged_sketch_is_that_of_all_terms(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 3).alias("source"), F.concat(F.lit("t"), (F.col("id") % 40_000).cast("string")).alias("term")
    )
    kept = SK.vocab_sketches(rows, ["source"])
    merged = SK.sketched_sizes(SK.merge_sketches(kept, [])).first()["vocab_size"]
    whole = SK.sketched_sizes(SK.vocab_sketches(rows, [])).first()["vocab_size"]
    assert abs(merged - 40_000) <= 4 * SK.relative_error() * 40_000
    assert abs(whole - merged) <= 4 * SK.relative_error() * 40_000
    assert SK.sketched_sizes(SK.vocab_sketches(rows.limit(0), ["source"])).collect() == []


# --- variants -----------------------------------------------------------------------
LINES = ['{"id": 1, "a": {"b": "x"}}', '{"id": "2", "a": 5}', "", "[1, 2]", '{"id":', "null", '{"id": null, "new": true}']


def test_variants_of_unlike_lines(spark):
    path = new_path(spark, "lines")
    spark.createDataFrame([(line,) for line in LINES], "value string").write.text(path)
    records = VA.scan_variants(spark, path)
    fields = {"id": ("$.id", "int"), "b": ("$.a.b", "string")}
    found = VA.typed_fields(records, fields, keep_corrupt=True).collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [(1, "x", None), (2, None, None), (None, None, None)]
        + [(None, None, line) for line in ("[1, 2]", '{"id":', "null")], key=str,
    )
    assert VA.typed_fields(records, fields).count() == 3
    report = VA.drift_report(records, {"id": "BIGINT", "gone": "STRING"}).collect()
    assert {tuple(r) for r in report} == {
        ("id", "BIGINT", 1, "declared"), ("id", "STRING", 1, "other kind"), ("id", "VOID", 1, "declared"),
        ("a", "OBJECT", 1, "undeclared"), ("a", "BIGINT", 1, "undeclared"), ("new", "BOOLEAN", 1, "undeclared"),
        ("gone", None, 0, "missing"),
    }


# --- other scripts ------------------------------------------------------------------
SPELT = [
    ("Привет, мир! Щука ёлка", "Privet, mir! Shchuka iolka"), ("Ελλάδα και ἀρχή Ψυχή", "Ellada kai arkhe Psukhe"),
    ("ひらがな カタカナ きゃ", "hiragana katakana kiya"), ("한국어 가각힣", "hangugeo gagaghih"), ("plain é 漢 😀Ж", "plain é 漢 😀Zh"),
    ("", ""), (None, "NULL"),
]


def test_other_scripts_are_spelt_in_latin(spark):
    long = "Щи да каша 한국 " * 20_000
    rows = [*SPELT, (long, "Shchi da kasha hangug " * 20_000)]
    docs = spark.createDataFrame(rows, "text string, spelt string")
    for row in docs.select("spelt", spell_in_latin("text").alias("found")).collect():
        assert row.found == row.spelt
    kept = docs.where("text is null").select(spell_in_latin("text", None).alias("x")).collect()
    assert kept[0].x is None


# --- word tables from SQL -----------------------------------------------------------
def test_lookups_from_sql_are_those_of_the_operators(spark):
    gazetteer = spark.createDataFrame(
        [("new york", "GPE"), ("york", "LOC"), ("york city hall", "FAC"), ("anna", "PERSON")], "phrase string, label string"
    )
    tags = spark.createDataFrame([("anna", "PROPN"), ("dog", "NOUN"), ("the", "DET")], "form string, pos string")
    rows = [(1, "the dog of new york city hall anna dog"), (2, "new york york"), (3, None), (4, ""), (4, "dog"), (5, "dog anna " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    register_lookups(spark, gazetteer, tags)
    docs.createOrReplaceTempView("lookup_docs")
    found = spark.sql("select doc_id, get_ner_spacy_udf(text) as e, get_noun_spacy_udf(text) as n from lookup_docs").collect()

    def sorted_maps(rows):
        return sorted((r[0], sorted(r[1].items())) for r in rows)

    assert sorted_maps((r.doc_id, r.e) for r in found) == sorted_maps(L.extract_entities(docs, gazetteer).collect())
    alone = docs.where("doc_id <> 4")
    assert sorted_maps((r.doc_id, r.n) for r in found if r.doc_id != 4) == sorted_maps(L.extract_nouns(alone, tags).collect())
    assert [r.n for r in spark.sql("select get_noun_spacy_udf(text) as n from lookup_docs where false").collect()] == []
