"""Hostile pages take time by their length; toxicity against a brute-force search over texts."""

import math
import time
from collections import Counter

import numpy as np

from quillmill.llm import extraction, toxicity


def test_hostile_pages_are_read_in_time_by_their_length():
    pages = [
        '<a href="' * 100_000,
        "<b " * 300_000,
        "<a<a" * 250_000,
        "<div>" * 50_000 + "</p>" * 100_000,
        "<li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000,
        '<a ">" ' * 140_000 + '"',
        "<!-- " * 200_000,
        "<script>" * 120_000,
        '<a "' * 250_000 + "'>",
    ]
    start = time.time()
    for page in pages:
        extraction.parsed(page)
    assert time.time() - start < 30


def test_tags_end_outside_quotes_or_at_the_first_mark():
    def text(page):
        return "".join(t for _, _, t in extraction.parsed(page).runs)

    assert text('<a title="x > y">link</a> more') == "link more"
    assert text("<b title='>open</b> it's") == "open it's"
    assert text('<a ">one</a> <a ">">two</a>') == '">two'
    assert text('<p>1 < 2 and <b is text <!x gone') == "1 < 2 and <b is text "
    assert text('<class="x"<!x gone') == '<class="x"'
    page = extraction.parsed("<ul><li>a<ul><li>b<li>c</ul><li>d</ul></p>e")
    assert [(page.tag[n], t) for n, _, t in page.runs] == [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d"), ("html", "e")]


def test_toxicity_finds_what_brute_force_over_texts_finds(spark):
    dice = np.random.default_rng(5)
    rows, marks = [], []
    for i in range(400):
        words = [f"w{dice.zipf(1.4) % 500}" for _ in range(30)]
        if i % 10 == 0:
            words[3] = ["vile", "foul"][i // 10 % 2] if i % 20 else f"o{i}"
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 10 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    judge = toxicity.learnt(docs, spark.createDataFrame(marks, "doc_id bigint, toxic int"))
    known = set(judge.index.ids.tolist())
    names = {i: w for w, i in judge.space.words.items()}
    total = Counter(w for _, t in rows for w in set(t.split()))

    def slow(text):
        counts = Counter(w for w in text.split() if w in judge.space.words)
        parts = [{"": 1.0}, {}]
        for w, n in counts.items():
            weight = (1 + math.log(n)) * (1 + math.log(401 / (1 + total[w])))
            parts[judge.space.words[w] > judge.space.telling][w] = weight
        for part, share in zip(parts, (toxicity.TELLING, 1 - toxicity.TELLING), strict=True):
            length = math.sqrt(sum(x * x for x in part.values())) or 1
            part.update({w: x / length * math.sqrt(share if parts[1] else 1.0) for w, x in part.items()})
        return parts[0] | parts[1]

    assert not judge.space.stems and len(names) > 100
    vectors = {i: slow(t) for i, t in rows if i in known}
    opened = 0
    for i, text in rows[::7]:
        mine = slow(text)
        cosines = sorted((sum(x * v.get(w, 0) for w, x in mine.items()) for v in vectors.values()), reverse=True)
        found = judge.index.search(judge.space.vector(judge.space.listed(text)))
        opened += found.opened / judge.index.blocks
        assert np.allclose(found.cosines[: toxicity.NEIGHBOURS], cosines[: toxicity.NEIGHBOURS])
        if i in known:  # an indexed text finds itself, telling term or not
            assert judge.score(text)[1][0]["cosine"] > 1 - 1e-9
    assert opened <= len(rows[::7])
