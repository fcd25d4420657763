"""Vectors, pages and the pipeline."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillmill.llm import embeddings, extraction


def slow_vectors(rows, threshold=0.9):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    vectors = [np.array(v, float) / np.linalg.norm(v) if i is not None and usable(v) else None for i, v in rows]
    n = len(rows)
    linked = [
        [
            b for b in range(n)
            if b != a and vectors[a] is not None and vectors[b] is not None
            and len(vectors[a]) == len(vectors[b]) and vectors[a] @ vectors[b] >= threshold
        ]
        for a in range(n)
    ]
    root = [i for i, _ in rows]
    for _ in range(n):
        root = [min([root[a], *(root[b] for b in linked[a])]) if linked[a] else root[a] for a in range(n)]
    return sorted(((rows[a][0], len(linked[a]), root[a]) for a in range(n)), key=str)


def test_near_vectors(spark):
    dice = np.random.default_rng(4)
    base = dice.normal(size=(40, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in v + dice.normal(size=16) * s]) for i, (v, s) in enumerate(zip(base, np.linspace(0, 0.9, 40)))]
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(200, rows[3][1])]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [float("inf")] + [1.0] * 15),
             (305, [None] + [1.0] * 15), (306, [1.0] * 4), (307, [2.0] * 4), (None, rows[3][1]), (308, [x * 1e30 for x in rows[5][1]])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("n_links", F.lit("old"))
    for block in (8192, 20):
        found = embeddings.near_vectors(table, block=block).collect()
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=str) == slow_vectors(rows)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found if r["vec_id"] is not None)
    assert embeddings.near_vectors(table.limit(0)).count() == 0


def test_bounds_hold():
    dice = np.random.default_rng(6)
    units = embeddings.unit_rows(dice.normal(size=(300, 24)))
    codes, scale, error = embeddings.quantised(units)
    left = np.linalg.norm(units - codes * scale[:, None], axis=1)
    assert (left <= error).all() and (error < 0.05).all()


def test_code_products_are_exact():
    dice = np.random.default_rng(7)
    for size in (3, 1024, 2500):
        left, right = dice.integers(-127, 128, (20, size)), dice.integers(-127, 128, (30, size))
        left[0], right[0], right[1] = 127, 127, -127
        found = embeddings.code_products(left.astype(np.float32), right.astype(np.float32))
        assert (found.astype(np.int64) == left @ right.T).all()


def test_open_pairs_are_settled(spark):
    """Cosines crowd at the threshold, closer to it than codes can tell, in vectors longer than one exact sum."""
    dice = np.random.default_rng(8)
    size = 1100
    base = embeddings.unit_rows(dice.normal(size=(1, size)))[0]
    side = embeddings.unit_rows(dice.normal(size=(30, size)))
    side = embeddings.unit_rows(side - (side @ base)[:, None] * base)
    cosines = 0.9 + np.linspace(-2e-3, 2e-3, 30)
    vectors = [base, *(c * base + math.sqrt(1 - c * c) * v for c, v in zip(cosines, side, strict=True))]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    codes, scale, error = embeddings.quantised(np.array(vectors))
    length = np.linalg.norm(codes * scale[:, None], axis=1) * (1 + 1e-9)
    one = embeddings.Side(np.arange(31), np.ones(31, int), codes, scale, error, length)
    assert sum(int((~sure).sum()) for _, _, sure in embeddings.tile_pairs(one, one, 0.9)) > 10
    found = embeddings.near_vectors(table, block=10).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=str) == slow_vectors(rows)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li></ul></nav><!-- ad --><div class="ad">Buy now, cheap.</div>
<article><h1>{title}</h1><p><b>{title}<br>{first}<p>{second}</p></article><footer>&copy; site {n}</footer></body></html>"""


def pages_table(spark):
    dice = random.Random(1)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "si", "tu", "vo", "xe")]
    rows, truth = [], {}
    for i in range(120):
        title = " ".join(dice.choices(words, k=dice.randint(1, 8))).capitalize()
        first = " ".join(dice.choices(words, k=dice.randint(3, 60))) + "."
        second = " ".join(dice.choices(words, k=dice.randint(20, 120))) + " &amp; &eacute;."
        rows.append((i, f"http://x/{i}", PAGE.format(title=title, first=first, second=second, n=i)))
        truth[i] = f"{title}\n\n{title} {first}\n\n{second.replace('&amp;', '&').replace('&eacute;', 'é')}"
    return rows, truth


def test_main_text(spark):
    rows, truth = pages_table(spark)
    odd = [(900, None, None), (901, "u", ""), (902, "u", "<p"), (903, "u", "<div>" * 3000), (904, "u", "<a href=\"" * 500),
           (905, "u", "</p></div>text"), (5, rows[5][1], rows[5][2])]
    table = spark.createDataFrame(rows + odd, "page_id bigint, url string, html string").withColumn("text", F.lit("old"))
    found = extraction.extract_text(table).collect()
    assert len(found) == len(rows) + len(odd)
    exact = sum(r["text"] == truth[r["page_id"]] for r in found if r["page_id"] in truth)
    assert exact >= 0.98 * len(truth)
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert {r["text"] for r in found if r["page_id"] in (900, 901)} == {""}
    assert extraction.extract_text(table.limit(0)).count() == 0


def test_other_layouts_of_held_out_pages(spark):
    rows, _ = pages_table(spark)
    model = extraction.fitted(spark.createDataFrame(rows[:80], "page_id bigint, url string, html string"))
    dice = random.Random(77)
    exact = 0
    for _, _, html in rows[80:]:
        page = extraction.relaid(*extraction.example(html), dice)
        marked = extraction.parsed(page)
        wanted = extraction.kept_text(marked, [bool(x) for x in marked.label])
        exact += model.texts([page.replace(" data-main=1", "").replace(" data-cut=1", "")])[0] == wanted
    assert exact >= 0.8 * len(rows[80:])


def whole_text(html):
    return extraction.kept_text(page := extraction.parsed(html), [True] * len(page.tag))


def test_text_behind_raw_elements_and_the_head():
    body = "<p>one</p><p>two</p>"
    for front in ["<script>for(i=0;i<n;i++){}</script>", "<style>a<b</style>", '<script>x="<!--";</SCRIPT >', "<title>a<b</title>",
                  "<script>if(a<b)c='\"'</script>", "<noscript><img alt=x></noscript>"]:
        assert whole_text(f"<html><head>{front}</head><body>{body}</body></html>") == "one\n\ntwo", front
        assert whole_text(f"<html><body>{front}{body}{front}") == "one\n\ntwo", front
        assert whole_text(f"<html><head><meta charset=utf-8>{front}<body>{body}") == "one\n\ntwo", front
        assert whole_text(f"<head>{front}{body}") == "one\n\ntwo", front
    assert whole_text("<body><svg><title>x<p>y</p></svg><p>one") == "one"


def test_pages_that_mark_no_article(spark):
    for tag, after in (("article", "ARTICLE"), ("article", "main"), ("article", "div")):
        rows = [(i, u, h.replace(f"<{tag}", f"<{after}").replace(f"</{tag}", f"</{after}")) for i, u, h in pages_table(spark)[0]]
        table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
        found = extraction.extract_text(table.where("html != ''")).collect()
        assert sum(1 for r in found if r["n_chars"]) >= 0.9 * len(found), after


def test_the_sample_is_of_different_pages(spark):
    rows = [(i, f"<article>{max(0, i - 500)}</article>") for i in range(600)]
    table = spark.createDataFrame(rows, "page_id bigint, html string")
    found = extraction.picked(table, 50)
    assert len(set(found)) == len(found) == 50 and found == extraction.picked(table.repartition(7), 50)


def test_decoding_never_goes_back_inside():
    page = extraction.parsed("<div><div><p>a</p></div></div><div><p>b</p></div>")
    dice = np.random.default_rng(9)
    for _ in range(200):
        kept = extraction.decoded(page, dice.normal(size=len(page.tag)) * 3)
        for i in range(1, len(kept)):
            p = page.parent[i]
            if p and kept[page.parent[p]] and not kept[p]:
                assert not kept[i]


def test_pipeline_stages(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and {"doc_id", "ids", "starts", "ends", "decoded"} <= set(out.columns)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
