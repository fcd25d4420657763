"""Word graphs of many texts at once, against plain loops over one text."""

import math
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillmill.operators import keyphrases as K
from quillmill.operators import wordgraphs as G


def drawn(words: int, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice([f"w{draw.randrange(400)}", f"word{draw.randrange(9)}", "the"]) for _ in range(words))


def sgrank(text: str, window: int) -> dict[str, float]:
    kept = [(i, w) for i, w in enumerate(text.split()) if w not in K.STOP_WORDS]
    at = defaultdict(list)
    for n in (1, 2, 3):
        for i in range(len(kept) - n + 1):
            if kept[i + n - 1][0] - kept[i][0] == n - 1:
                at[" ".join(w for _, w in kept[i : i + n])].append(kept[i][0])
    base = {g: len(p) * len(g.split()) / math.log2(min(p) + 2) for g, p in at.items()}
    scale = len(base) / (sum(base.values()) or 1)
    places = sorted((p, g) for g, found in at.items() for p in found)
    links = defaultdict(float)
    for p, a in places:
        for q, b in places:
            if a != b and 1 <= abs(p - q) < window:
                links[a, b] += math.log2(1 + window / abs(p - q))
    strength = defaultdict(float)
    for (a, _), weight in links.items():
        strength[a] += weight
    rank = {g: x * scale for g, x in base.items()}
    for _ in range(K.ROUNDS):
        new = {g: (1 - K.DAMPING) * x * scale for g, x in base.items()}
        for (a, b), weight in links.items():
            new[a] += K.DAMPING * weight / strength[b] * rank[b]
        rank = new
    return rank


def test_texts_of_one_slice_do_not_meet(spark, monkeypatch):
    texts = [drawn(n, n) for n in (0, 1, 90, 3, 60)] + [None, "the the", "solo"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    words = df.select(K.content_words("text", None).alias("w")).toArrow()["w"].combine_chunks()
    found = df.select("doc_id", K.sgrank_phrases("text", 10_000, 4, (1, 2, 3), None).alias("p")).collect()
    for row in found:
        expected = sgrank(texts[row.doc_id], 4) if texts[row.doc_id] else {}
        assert {p.phrase: p.score for p in row.p} == pytest.approx(expected, abs=1e-9)
        ordered = [(-round(p.score, K.SCORE_DIGITS), p.phrase) for p in row.p]
        assert ordered == sorted(ordered)
    whole = G.by_slices(lambda part: G.sgrank(G.read(part), (1, 2), 5, 3, 10, 0.85, 8), words)
    monkeypatch.setattr(G, "SLICE", 7)
    assert len(list(G.slices(G.lengths(words)))) > 3
    assert G.by_slices(lambda part: G.sgrank(G.read(part), (1, 2), 5, 3, 10, 0.85, 8), words) == whole


def test_long_texts_are_ranked_at_once(spark):
    K.extract_keyphrases(spark.createDataFrame([(0, "warm up")], "doc_id int, text string")).collect()
    df = spark.createDataFrame([(i, drawn(10_000, i)) for i in range(12)], "doc_id int, text string").coalesce(1)
    start = time.time()
    rows = K.extract_keyphrases(df, normalize=None).select("doc_id", F.size("keyphrases.sgrank").alias("n")).collect()
    assert [r.n for r in rows] == [5] * 12
    assert time.time() - start < 10  # about 17 s by array expressions, under 1 s by arrays of numbers
