"""Operators on small fixtures: known values, brute force, hot keys, and plan shapes."""

import difflib
import random
import io
import re
from collections import Counter
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from quillmill.functions.tokens import ngrams, split_words, tokenize_words
from quillmill.operators import features as FE
from quillmill.operators import keyphrases as K
from quillmill.operators import lexicon as L
from quillmill.operators import spelling as S
from quillmill.operators import tables as R
from quillmill.operators import vectors as V
from quillmill.plans.ids import with_dense_ids
from quillmill.plans.joins import lookup_join, salted_join
from quillmill.plans.storage import new_path
from quillmill.sources import readers, writers

DOGS = ["Dog bites man.", "Man bites dog.", "Dog eats meat.", "Man eats food all the time."]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, start=1)), "doc_id bigint, text string")


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_tf_idf_known_values(spark):
    found = {(r.doc_id, r.term): round(r.tf_idf, 6) for r in FE.tf_idf(docs(spark, DOGS)).collect()}
    assert found[1, "bites"] == 0.657829 and found[1, "dog"] == found[1, "man"] == 0.532570
    assert found[3, "dog"] == 0.448100 and found[3, "eats"] == 0.553492 and found[3, "meat"] == 0.702035
    assert found[4, "eats"] == 0.351570 and found[4, "man"] == 0.284626
    assert all(found[4, w] == 0.445922 for w in ("all", "food", "the", "time")) and len(found) == 15


def test_bow_transform_ignores_unknown_words(spark):
    vocab = FE.vocab_alphabetical(FE.bag_of_words(docs(spark, DOGS)))
    assert [(r.term, r.term_id) for r in FE.vocab_sorted_by_id(vocab).collect()] == [
        (w, i) for i, w in enumerate(["all", "bites", "dog", "eats", "food", "man", "meat", "the", "time"])
    ]
    new = docs(spark, ["dog and dog are friends and so with man and not with cat"])
    assert {(r.term_id, r["count"]) for r in FE.bow_transform(new, vocab).collect()} == {(2, 2), (5, 1)}


def test_one_hot(spark):
    texts = docs(spark, ["i love dog", " dog. cat"])
    vocab = FE.build_vocab_first_seen(texts)
    ids = {r.term: r.term_id for r in vocab.collect()}
    assert ids == {"i": 1, "love": 2, "dog": 3, "": 4, "cat": 5}
    rows = FE.one_hot_tokens(docs(spark, ["i love bird"]), vocab).orderBy("pos").collect()
    assert [r.term_id for r in rows] == [1, 2, None]
    dense = texts.select(FE.one_hot_dense(F.col("text"), ["i", "love", "dog"]).alias("x")).first().x
    assert dense == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]


def test_dense_rows_of_3000_terms(spark):
    texts = docs(spark, [" ".join(f"t{i:04d}" for i in range(0, 3000, 2)), "t0001 t0001 zz", "", "yy"])
    bag = FE.bag_of_words(texts)
    vocab = FE.vocab_alphabetical(FE.bag_of_words(docs(spark, [" ".join(f"t{i:04d}" for i in range(3000))])))
    rows = {r.doc_id: r["values"] for r in FE.dense_rows(texts, bag, vocab, "count").collect()}
    assert rows[1] == [1.0, 0.0] * 1500 and len(rows[2]) == 3000
    assert rows[2][1] == 2.0 and sum(rows[2]) == 2.0 and sum(rows[3]) == sum(rows[4]) == 0


def test_ngrams(spark):
    row = docs(spark, ["a bb cc dd"]).select(
        ngrams(tokenize_words("text"), 2).alias("two"), ngrams(tokenize_words("text"), 4).alias("none")
    ).first()
    assert row.two == ["bb cc", "cc dd"] and row.none == []


def test_dense_ids_follow_the_order(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), F.pmod(F.col("id") * 7919, F.lit(5000))).alias("k"))
    rows = with_dense_ids(df, [F.col("k")], "n", start=1).collect()
    assert [r.k for r in sorted(rows, key=lambda r: r.n)] == sorted(r.k for r in rows)
    assert sorted(r.n for r in rows) == list(range(1, 5001))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_keeps_every_row_of_a_hot_key(spark, how):
    """Half of the rows have one key, some have none, and the lookup lists a key twice."""
    facts = spark.range(4000).select(
        "id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key")
    )
    lookup = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("k5", 4), ("zz", 5)], "key string, v int")
    counts = facts.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    salted = salted_join(facts, lookup, "key", ["id"], counts, how)
    plain = facts.join(lookup, "key", how)
    assert Counter(map(tuple, salted.select("id", "key", "v").collect())) == Counter(
        map(tuple, plain.select("id", "key", "v").collect())
    )
    small = lookup_join(facts, lookup, "key", how).select("id", "key", "v")
    assert Counter(map(tuple, small.collect())) == Counter(map(tuple, plain.select("id", "key", "v").collect()))


def test_category_join_multiplies_and_fills(spark):
    mails = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, domain string")
    listed = spark.createDataFrame([("a", "y"), ("a", None), ("c", "y")], "domain_names string, required string")
    rows = {tuple(r) for r in R.left_join_category(mails, listed).select("id", "domain", "required").collect()}
    assert rows == {("1", "a", "y"), ("1", "a", "n"), ("2", "b", "na"), ("3", "na", "na")}


# --- spelling -----------------------------------------------------------------------
def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


LISTED = {"text": 9, "sample": 5, "some": 20, "same": 8, "with": 30, "errors": 4, "this": 40, "is": 50, "a": 60,
          "an": 7, "test": 9, "word": 3}
WRITTEN = "this is sme sample txt with erors tst x wrds httpstcofoxcgaacj tets aa smoe 12 qqqq".split()


def spell(spark, method, **options):
    listed = spark.createDataFrame(list(LISTED.items()), "word string, freq bigint")
    texts = docs(spark, [" ".join(WRITTEN), ""])
    rows = S.correct_spelling(texts, listed, method, **options).orderBy("doc_id").collect()
    assert rows[1].corrected == ""
    return rows[0].corrected.split()


def brute_force(method, keep=()):
    result = []
    for word in WRITTEN:
        near = [w for w in LISTED if edit_distance(word, w) <= 2]
        if word in LISTED or word in keep or not re.search("[a-z]", word) or not near:
            result.append(word)
        elif method == "frequency":
            result.append(min(near, key=lambda w: (edit_distance(word, w), -LISTED[w], w)))
        else:
            result.append(min(near, key=lambda w: (-difflib.SequenceMatcher(None, word, w).ratio(), w)))
    return result


@pytest.mark.parametrize("method", ["frequency", "similarity"])
def test_spelling_equals_brute_force(spark, method):
    assert spell(spark, method) == brute_force(method)
    assert spell(spark, method, keep=["tst"]) == brute_force(method, ["tst"])


@pytest.mark.parametrize("edits", [1, 2])
def test_near_words_equal_brute_force(spark, edits):
    source = random.Random(edits)
    word = lambda: "".join(source.choice("abcdé") for _ in range(source.choice([1, 1, 2, 2, 3, 4, 5, 6, 7, 9, 12])))
    listed = {word() for _ in range(300)} | {"a" * 5000, "a" * 2500 + "b" + "a" * 2498}
    asked = {word() for _ in range(300)} | {"a" * 4999, "x", "xy"}
    freq = {w: source.randrange(1, 50) for w in listed}
    dictionary = spark.createDataFrame(list(freq.items()), "word string, freq bigint")
    pairs = S.near_pairs(spark.createDataFrame([(w,) for w in asked], "word string"), dictionary, edits).collect()
    found = {(r.word, r.suggestion) for r in pairs}
    near = {(w, x) for w in asked for x in listed if abs(len(w) - len(x)) <= edits and (
        edit_distance(w, x) if len(w) < 100 else 1) <= edits}
    assert found <= near
    # only short words without a common letter are left to those that stand for them
    assert all(max(len(w), len(x)) <= edits and not set(w) & set(x) for w, x in near - found)
    for w in asked:
        mine, all_near = [x for a, x in found if a == w], [x for a, x in near if a == w]
        order = lambda x: (edit_distance(w, x), -freq[x], x) if len(w) < 100 else x
        apart = [x for x in all_near if not set(w) & set(x)]
        assert not all_near or min(mine, key=order) == min(all_near, key=order)
        # these have no letters in common, so they count only where no other word is near
        assert len(apart) < len(all_near) or not apart or min(apart) in mine


# --- lexicon ------------------------------------------------------------------------
def test_lemmas_of_both_forms_agree(spark):
    texts = docs(spark, ["children went to cities she was eating boxes", "", "classes bus this flies"])
    listed = spark.createDataFrame(list(L.IRREGULAR_LEMMAS.items()), "form string, lemma string")
    by_join = {r.doc_id: r.lemma for r in L.lemmatize(texts, listed).collect()}
    by_row = {r.doc_id: r.lemma for r in texts.select("doc_id", L.lemma_text(F.col("text")).alias("lemma")).collect()}
    assert by_join == by_row
    assert by_row[1] == "child go to city she was eat box" and by_row[3] == "class bus this fly"


def test_listed_twice(spark):
    listed = spark.createDataFrame([("cats", "feline"), ("cats", "cat")], "form string, lemma string")
    assert L.lemmatize(docs(spark, ["cats run"]), listed).first().lemma == "cat run"
    vectors = spark.createDataFrame([("a", [1.0]), ("a", [2.0])], "word string, vector array<float>")
    assert [r.vector for r in V.vectors_for_text(docs(spark, ["a a"]), vectors).collect()] == [[1.0], [1.0]]


def test_overlapping_and_long_entities(spark):
    listed = spark.createDataFrame(
        [("a b", "X"), ("b c", "X"), ("c d", "X"), ("p q r s t u", "LONG"), ("r s", "X"), ("u v", "X")],
        "phrase string, label string",
    )
    texts = docs(spark, ["a b c d", "  p  q r s t u v", "u v p"])
    found = [(r.doc_id, r.text, r.start_char, r.end_char) for r in L.entity_spans(texts, listed).collect()]
    assert sorted(found) == [(1, "a b", 0, 3), (1, "c d", 4, 7), (2, "p q r s t u", 2, 14), (3, "u v", 0, 3)]


def test_texts_are_read_once(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    vocab = spark.createDataFrame([("the", 0)], "term string, term_id int")
    vectors = spark.createDataFrame([("the", [1.0])], "word string, vector array<float>")
    for found in (FE.bow_transform(texts, vocab), V.vectors_for_text(texts, vectors)):
        assert plan_of(found).count("documents.parquet") == 1
    listed = spark.createDataFrame([("of the", "X")], "phrase string, label string")
    tags = spark.createDataFrame([("the", "NOUN")], "form string, pos string")
    for found in (V.mean_vector(texts, vectors, split_words("text"), 1), L.annotate_posts(texts, listed, tags)):
        assert plan_of(found).count("documents.parquet") == 0  # written before, once


def test_entities(spark):
    listed = spark.createDataFrame(
        [("new york", "GPE"), ("york", "GPE"), ("new york times", "ORG"), ("china", "GPE"), ("times get", "X")],
        "phrase string, label string",
    )
    texts = docs(spark, ["what the new york times get out of china", "new york  york"])
    spans = {tuple(r) for r in L.entity_spans(texts, listed).collect()}
    assert spans == {
        (1, "new york times", 9, 23, "ORG"), (1, "china", 35, 40, "GPE"),
        (2, "new york", 0, 8, "GPE"), (2, "york", 10, 14, "GPE"),
    }
    maps = {r.doc_id: r.entities for r in L.extract_entities(docs(spark, ["china york", "none"]), listed).collect()}
    assert maps == {1: {"china": "GPE", "york": "GPE"}, 2: {}}


def test_token_pattern(spark):
    rules = {"HelloWorld": [[{"LOWER": "hello"}, {"IS_PUNCT": True}, {"LOWER": "world"}],
                            [{"LOWER": "hello"}, {"LOWER": "world"}]]}
    rows = L.match_token_pattern(docs(spark, ["Hello, world! Hello world!", "hello"]), rules).collect()
    assert {(r.start, r.end, r.text) for r in rows} == {(0, 3, "Hello, world"), (4, 6, "Hello world")}


def test_triples(spark):
    tokens = spark.createDataFrame(
        [(1, 0, "dog", "nsubj"), (1, 1, "bites", "ROOT"), (1, 2, "man", "dobj"), (1, 3, "leg", "dobj"),
         (2, 0, "man", "nsubjpass"), (2, 1, "bitten", "ROOT"), (2, 2, "dog", "pobj")],
        "doc_id bigint, pos int, text string, dep string",
    )
    rows = {r.doc_id: (r.x, r.v, r.y) for r in L.subject_object_triples(tokens).collect()}
    assert rows[1] == ({"nsubj": "dog"}, {"ROOT": "bites"}, {"dobj": "leg"})
    assert rows[2] == ({"pobj": "dog"}, {"ROOT": "bitten"}, {"nsubjpass": "man"})


# --- key phrases --------------------------------------------------------------------
def test_textrank_equals_plain_rounds(spark):
    text = "virus spread fast while virus tests spread slow and tests of fast virus labs"
    rows = docs(spark, [text]).select(F.explode(K.textrank_words("text")).alias("w")).select("w.*").collect()
    kept = [(i, w) for i, w in enumerate(re.findall(r"\w\w+", text)) if w not in K.STOP_WORDS]
    linked = {(a, b) for i, a in kept for j, b in kept if abs(i - j) == 1 and a != b}
    terms = {w for _, w in kept}
    degree = Counter(a for a, _ in linked)
    rank = dict.fromkeys(terms, 1.0)
    for _ in range(K.ROUNDS):
        rank = {t: 0.15 + 0.85 * sum(rank[a] / degree[a] for a, b in linked if b == t) for t in terms}
    assert {(r.pos, r.term, round(r.rank, 9)) for r in rows} == {(i, w, round(rank[w], 9)) for i, w in kept}


def test_key_phrases_need_no_shuffle(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for found in (K.keyphrases_textrank(texts), K.keyphrases_sgrank(texts), K.extract_keyphrases(texts)):
        assert "Exchange" not in plan_of(found)


def test_empty_texts_have_no_phrases(spark):
    texts = docs(spark, ["", "the of and", "virus"])
    assert [tuple(r)[:2] for r in K.keyphrases_textrank(texts).collect()] == [(3, "virus")]
    lists = {r.doc_id: r.keyphrases for r in K.extract_keyphrases(texts).collect()}
    assert lists[1].textrank == lists[2].sgrank == [] and lists[3].textrank == ["virus"]


def test_term_variants(spark):
    terms = spark.createDataFrame(
        [(1, "chinese virus", 3.0), (1, "virus", 2.0), (1, "Virus", 1.0), (1, "lab", 1.0), (2, "virus", 1.0),
         (1, "travel-ban", 5.0), (1, "travel bans", 4.0), (1, "chinese virus spread", 1.0)],
        "doc_id bigint, term string, score double",
    )
    found = {(r.doc_id, r.term): r.variant_of for r in K.group_term_variants(terms, score_col="score").collect()}
    assert found[1, "virus"] == found[1, "Virus"] == found[1, "chinese virus spread"] == "chinese virus"
    assert found[1, "lab"] == "lab" and found[2, "virus"] == "virus"
    assert found[1, "travel bans"] == "travel-ban"


def test_long_chains_of_variants(spark):
    """200 terms, each spelt like a part of the next, and one that stands alone."""
    chain = [" ".join(f"w{j}" for j in range(i, i + 2)) for i in range(100)] + [f"w{i}" for i in range(100)]
    terms = spark.createDataFrame([(1, t, 1.0) for t in chain] + [(1, "alone", 9.0)], "doc_id int, term string, score double")
    found = {r.term: r.variant_of for r in K.group_term_variants(terms).collect()}
    assert len(found) == 201 and {found[t] for t in chain} == {"w0"} and found["alone"] == "alone"
    found = {r.term: r.variant_of for r in K.corpus_variants(terms.select("term")).collect()}
    assert len(found) == 201 and {found[t] for t in chain} == {"w0"} and found["alone"] == "alone"


def test_every_term_takes_part(spark):
    """A term behind the hundred heaviest can be the best in the end."""
    text = " ".join(f"filler{i:03d}" for i in range(150)) + " late phrase"
    found = K.keyphrases_sgrank(docs(spark, [text]), topn=2000).collect()
    assert {"late", "late phrase"} <= {r.phrase for r in found}


def test_columns_are_fitted(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "Z"), (5, "a")], "id int, kind string")
    hot = FE.one_hot_categories(rows, "kind", None, ["id"]).orderBy("id")
    assert hot.columns == ["id", "Z", "a", "b"]
    assert [tuple(r) for r in hot.collect()] == [(1, 0, 0, 1), (2, 0, 1, 0), (3, 0, 0, 0), (4, 1, 0, 0), (5, 0, 1, 0)]
    assert FE.one_hot_categories(rows.limit(0), "kind", None, ["id"]).columns == ["id"]
    with pytest.raises(ValueError, match="more than 2 values"):
        FE.fitted_values(rows, "kind", 2)
    texts = docs(spark, ["bb aa bb", "", "cc"])
    dense = FE.dense_matrix(texts, FE.bag_of_words(texts), None, "count").orderBy("doc_id")
    assert dense.columns[1:] == ["aa", "bb", "cc"]
    assert [tuple(r)[1:] for r in dense.collect()] == [(1, 2, 0), (0, 0, 0), (0, 0, 1)]


# --- vectors and sources ------------------------------------------------------------
def test_vectors(spark):
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 2.0]), ("zero", [0.0, 0.0])],
        "word string, vector array<float>",
    )
    assert [r.word for r in V.most_similar(vectors, "a", 2).collect()] == ["b", "c"]
    texts = docs(spark, ["a b x"])
    filled = V.token_vector_or_zero(V.vectors_for_text(texts, vectors), 2).orderBy("pos").collect()
    assert [r.vector for r in filled] == [[1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    mean = V.mean_vector(docs(spark, ["a a b x"]), vectors, split_words("text"), 2).first().vector
    assert mean == [0.75, 0.25]
    with pytest.raises(Exception, match="no vector for"):
        V.vectors_for_text(texts, vectors, unknown="error").collect()
    with pytest.raises(Exception, match="no vector for"):
        V.vector_lookup(vectors, "x", strict=True).collect()


def test_sinks_fail_when_the_target_exists(spark):
    path = new_path(spark, "test-sink")
    df = docs(spark, ['a, "b"\nc', None])
    writers.sink_csv(df, path)
    with pytest.raises(Exception, match="(?i)already exists"):
        writers.sink_csv(df, path)
    lines = new_path(spark, "test-vectors")
    spark.createDataFrame([("2 3",), ("w 1.5 -2 3e-1",), ("v 0 0 1",)], "value string").coalesce(1).write.text(lines)
    found = {r.word: r.vector for r in readers.scan_vectors(spark, lines, form="text").collect()}
    assert found["w"] == pytest.approx([1.5, -2.0, 0.3]) and found["v"] == [0.0, 0.0, 1.0]


def test_filters_and_columns_reach_the_scan(spark):
    from catalog import QUERIES

    plan = plan_of(QUERIES["filter_equals"](spark, "/root/testdata/sf0.001"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    plan = plan_of(QUERIES["project_columns"](spark, "/root/testdata/sf0.001"))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan
