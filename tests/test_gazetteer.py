"""The phrase automaton against trying every listed phrase at every word."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import gazetteer as G
from quillmill.operators import lexicon as L


def slow(text, listed):
    words = (text or "").split()
    at, starts = 0, []
    for w in words:
        at = text.index(w, at)
        starts.append(at)
        at += len(w)
    hits = []
    for i in range(len(words)):
        for phrase, label in listed.items():
            n = len(phrase.split(" "))
            if words[i : i + n] == phrase.split(" "):
                hits.append((i, n, phrase, label))
    taken, kept = set(), []
    for i, n, phrase, label in sorted(hits, key=lambda h: (-h[1], h[0])):
        if not taken & set(range(i, i + n)):
            taken |= set(range(i, i + n))
            kept.append((i, n, phrase, label, starts[i], starts[i + n - 1] + len(words[i + n - 1])))
    return sorted(kept)


@pytest.fixture(scope="module")
def made():
    source = random.Random(6)
    pairs = [(" ".join(source.choice("abc") for _ in range(source.randrange(1, 7))), source.choice("XYZ")) for _ in range(60)]
    pairs += [(" ".join(["a"] * 40), "LONG"), ("é ü", "X"), ("a  b", "never"), (" a", "never"), ("", "never"), (None, "never")]
    pairs += [("b c", "ZZ"), ("b c", "AA")]
    texts = ["  ".join(source.choice(["a", "b", "c", "d", "é", "ü"]) for _ in range(source.randrange(0, 90))) for _ in range(80)]
    texts += [None, "", " \t\n", "a " * 3000, "\xa0a b\x1cc", "a b"]
    return pairs, texts


def test_hits_are_those_of_trying_all(spark, made):
    pairs, texts = made
    listed = {}
    for phrase, label in pairs:
        if phrase and phrase == " ".join(phrase.split()):
            listed[phrase] = min(label, listed.get(phrase, label))
    table = spark.createDataFrame([(label, phrase, 1) for phrase, label in pairs], "label string, phrase string, n int")
    # ids repeat and are missing; each row is read on its own
    docs = spark.createDataFrame([(i % 50 or None, t) for i, t in enumerate(texts)], "key int, body string")
    expected = sorted(str((i % 50 or None, slow(t, listed))) for i, t in enumerate(texts))
    for find in (L.entity_hits, L.joined_hits):
        got = find(docs, table, "key", "body").collect()
        assert sorted(str((r.key, [tuple(h) for h in r.hits])) for r in got) == expected


def test_large_gazetteers_are_joined(spark, monkeypatch):
    monkeypatch.setattr(G, "TABLE_BYTES", 100)
    table = spark.createDataFrame([("of the", "X"), ("the", "Y")], "phrase string, label string")
    docs = spark.createDataFrame([(1, "of the the"), (2, "no")], "doc_id int, text string")
    assert G.with_hits(docs, table, "doc_id", "text") is None
    found = {r.doc_id: r.entities for r in L.extract_entities(docs, table).collect()}
    assert found == {1: {"of the": "X", "the": "Y"}, 2: {}}


def test_no_phrases(spark):
    table = spark.createDataFrame([], "phrase string, label string")
    docs = spark.createDataFrame([(1, "of the")], "doc_id int, text string")
    assert L.entity_spans(docs, table).count() == 0
    assert L.extract_entities(docs.limit(0), table).count() == 0


def test_failure_links(spark):
    table = spark.createDataFrame([("a b c", "X"), ("b d", "Y"), ("c", "Z")], "phrase string, label string")
    steps, outputs = G.automaton_tables(G.listed_phrases(table))
    found = {(r.state, r.word): r.next for r in steps.collect()}
    assert found[("a b", "c")] == "a b c" and found[("a b", "d")] == "b d" and ("a b c", "d") not in found
    assert {(r.state, r.phrase) for r in outputs.select("state", F.col("phrase")).collect()} == {
        ("a b c", "a b c"), ("a b c", "c"), ("b d", "b d"), ("c", "c")
    }
