"""Every operator on documents with nulls, ties, repeats, long and empty texts, and empty tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from quillmill.llm import merkle, mixing, pieces, sharding, simhash, suffixes, tokens, toxicity


def texts(rows):
    return [(r[0], r[1] or "") for r in rows]


def collected(df):
    return [tuple(r) for r in df.collect()]


# --- token counts ---------------------------------------------------------------------
def test_token_counts(docs, wide, empty, rows):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter(
        (i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False)), n > 2048) for i, t in texts(rows)
    )
    assert Counter(collected(tokens.count_tokens(docs))) == expected
    assert Counter(collected(tokens.count_tokens(wide))) == expected
    assert tokens.count_tokens(empty).count() == 0


def test_token_rules_agree_with_the_library():
    rules = tokens.Rules(tokens.vocabulary_text(public_tokenizers.path("word_bpe_49k.json")))
    library = rules.library
    for text in ["Don't IT'S we'll 12 ...!!", "naïve CAFÉ ΑΣ Σ İx ſ's ½²³", "<|endoftext|> a <|startoftext|>",
                 "é \x1c\x85 a　b 你好 🙂 ​ _", "x" * 300, "thonenntxyz " * 50, "a\x00b"]:
        assert rules.count(text) == len(library.encode(text, add_special_tokens=False)), text


# --- pieces ---------------------------------------------------------------------------
def test_piece_digests(docs, empty, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def digest(text):
        ids = library.encode(text, add_eos=True)
        line = " ".join(map(str, ids))
        return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (line, library.decode(ids)))

    expected = Counter((i, *digest(t)) for i, t in texts(rows))
    assert Counter(collected(pieces.encode_pieces(docs, digest=True))) == expected
    assert pieces.encode_pieces(empty, digest=True).count() == 0


def test_pieces_point_into_the_source(wide, rows):
    model = pieces.Pieces(pieces.model_bytes(public_tokenizers.path("piece_bpe_32k.model")))
    for row in pieces.encode_pieces(wide).collect():
        text = next(r[1] for r in rows if r[0] == row["doc_id"]) or ""
        source = text.encode()
        assert row["decoded"] == text
        assert row["ends"][-1] == len(source) and row["starts"][0] == 0
        joined = b"".join(source[a:b] for a, b in zip(row["starts"], row["ends"]))
        assert joined == source  # every byte belongs to one piece
        for i, a, b in zip(row["ids"][:-1], row["starts"], row["ends"]):
            if i not in model.byte_of and a:
                assert model.surface[i].replace("▁", " ").encode() == source[a:b]
        assert row["score"] == "old score" and isinstance(row["ids"], list)


def test_pieces_agree_with_the_library():
    model = pieces.Pieces(pieces.model_bytes(public_tokenizers.path("piece_bpe_32k.model")))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    dice = np.random.default_rng(3)
    parts = ["a", " ", "  ", "▁", "\n", "é", "你", "🙂", "\x00", "</s>", "<0x41>", "Hello", "12", "ﬁ", "​"]
    for _ in range(300):
        text = "".join(dice.choice(parts, dice.integers(1, 30)))
        found = model.encode(text)
        assert found.ids.tolist() == library.encode(text)
        assert model.decode(found.ids.tolist()) == library.decode(library.encode(text))
    for _ in range(300):
        ids = dice.integers(0, 400, 8).tolist()
        assert model.decode(ids) == library.decode(ids)


def test_character_map_takes_the_longest_prefix():
    # a trie with the entries "a" -> "x" and "ab" -> "yz", as the model format lays it out
    units = np.zeros(1024, np.uint32)

    def offset(value):
        return np.uint32(value << 10)

    root, a, b = 256, 512, 768  # child bases
    units[0] = offset(root)
    at_a = root ^ ord("a")
    units[at_a] = offset(at_a ^ a) | np.uint32(ord("a")) | np.uint32(1 << 8)
    units[a] = np.uint32(0x80000000)  # value: replacement at byte 0
    at_b = a ^ ord("b")
    units[at_b] = offset(at_b ^ b) | np.uint32(ord("b")) | np.uint32(1 << 8)
    units[b] = np.uint32(0x80000000 | 2)
    blob = len(units.tobytes()).to_bytes(4, "little") + units.tobytes() + b"x\0yz\0"
    table = pieces.CharacterMap(blob)
    assert table.longest(b"abc", 0) == (2, b"yz")
    assert table.longest(b"acb", 0) == (1, b"x")
    assert table.longest(b"ba", 0) is None


# --- SimHash --------------------------------------------------------------------------
def slow_fingerprint(text, shingle=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    counts = [0] * 64
    for run in runs:
        h = xxhash.xxh64_intdigest(run, 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(runs))


def slow_components(prints, linked):
    ids = list(prints)
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if linked(prints[a], prints[b]) and root[a] != root[b]:
                    low = min(root[a], root[b])
                    root[a] = root[b] = low
                    changed = True
    return root


def test_simhash(docs, wide, empty, rows):
    found = collected(simhash.fingerprint_documents(docs))
    assert len(found) == len(rows)
    for doc_id, fingerprint, component in found:
        text = next(r[1] for r in rows if r[0] == doc_id) or ""
        assert fingerprint == f"{slow_fingerprint(text):016x}"
        assert component == ({7: 1, 4: 3, 5: 3}.get(doc_id, doc_id))
    assert Counter(collected(simhash.fingerprint_documents(wide))) == Counter(found)
    assert simhash.fingerprint_documents(empty).count() == 0


def test_anchors_find_all_links(spark):
    dice = np.random.default_rng(5)
    prints = [int(x) for x in dice.integers(0, 1 << 63, 60, np.uint64)]
    for x in list(prints):
        for count in (1, 2, 3, 4):
            flips = dice.choice(64, count, replace=False)
            y = x
            for f in flips:
                y ^= 1 << int(f)
            prints.append(y)
    prints = {i: x for i, x in enumerate(dict.fromkeys(prints))}
    table = spark.createDataFrame(
        [(i, x - (1 << 64) if x >> 63 else x) for i, x in prints.items()], "node bigint, fingerprint bigint"
    )
    expected = slow_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    for cell in (4096, 3):  # uncut, and with nearly all cells cut into slices
        links = collected(simhash.near_links(table, cell=cell))
        root = slow_components({i: i for i in prints}, lambda a, b: (a, b) in links_of(links))
        assert root == expected


def links_of(links):
    return {(a, b) for a, b in links} | {(b, a) for a, b in links}


def slow_kept(rows):
    """(id, text) of the rows that stay, comparing all texts with all."""
    texts = sorted({r[1] or "" for r in rows})
    prints = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    root = slow_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    groups = {}
    for row in rows:
        groups.setdefault(root[texts.index(row[1] or "")], []).append(row)
    return [min((r[0] is None, r[0] or 0) for r in group) for group in groups.values()]


def test_one_of_each_group_of_near_copies_stays(spark, docs, wide, empty, rows):
    base = [f"word{i * 37 % 977}" for i in range(600)]
    made = [(1, " ".join(base)), (4, " ".join(base).upper()), (9, ""), (None, "  "), (2, "x y z"), (2, "other words stand here")]
    for i in range(40):
        near = base.copy()
        near[i * 13] = "changed"
        made.append((100 + i if i % 5 else None, " ".join(near)))
    made += [(None, "only one without an id"), (None, "only one without an id")]
    table = spark.createDataFrame(made, "doc_id bigint, text string")
    kept = [(r.doc_id is None, r.doc_id or 0) for r in simhash.without_near_duplicates(table).collect()]
    assert sorted(kept) == sorted(slow_kept(made)) and len(kept) < len(made) - 10
    left = simhash.without_near_duplicates(wide)
    assert left.columns == wide.columns
    kept = [(r.doc_id is None, r.doc_id or 0) for r in left.collect()]
    assert sorted(kept) == sorted(slow_kept([r[:2] for r in rows]))
    assert simhash.without_near_duplicates(empty).count() == 0


def test_many_rows_that_go_are_joined(spark, monkeypatch):
    table = spark.createDataFrame([(i, f"text {i % 3} of three") for i in range(30)], "doc_id bigint, text string")
    expected = sorted(r.doc_id for r in simhash.without_near_duplicates(table).collect())
    monkeypatch.setattr(simhash, "SENT_BYTES", 0)
    assert sorted(r.doc_id for r in simhash.without_near_duplicates(table).collect()) == expected


# --- repeats --------------------------------------------------------------------------
def slow_repeats(rows, length=200):
    data = [t.encode() for _, t in texts(rows)]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(texts(rows), data):
        covered = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(d)) if covered[i] and not (i and covered[i - 1]))
        kept = bytes(b for b, c in zip(d, covered) if not c)
        out.append((doc_id, len(d), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeats(spark, docs, wide, empty, rows):
    assert Counter(collected(suffixes.measure_repeats(docs))) == slow_repeats(rows)
    assert suffixes.measure_repeats(empty).count() == 0
    assert suffixes.cut_repeats(empty).count() == 0
    cut = suffixes.cut_repeats(wide)
    assert cut.columns == wide.columns
    by_id = {r["doc_id"]: r for r in cut.collect()}
    assert by_id[1]["text"] == by_id[7]["text"] == "" and by_id[1]["n_chars"] == 0
    assert by_id[2]["text"] == rows[1][1] and by_id[2]["score"] == "old score"


def test_repeats_at_every_length_and_place(spark, monkeypatch):
    dice = np.random.default_rng(8)

    def noise(n):
        return "".join(map(chr, dice.integers(97, 123, n)))

    passages = [noise(n) for n in (199, 200, 201, 260, 333, 500)]
    rows = []
    for i, p in enumerate(passages):
        for k in range(3):
            rows.append((10 * i + k, noise(int(dice.integers(0, 300))) + p + "é" + noise(int(dice.integers(0, 300)))))
    rows += [(90, "a" * 1000), (91, "ab" * 150), (92, passages[5][100:320] + passages[3][:230])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(collected(suffixes.measure_repeats(table))) == slow_repeats(rows)


def test_difference_cover():
    period, cover = suffixes.difference_cover(11)
    assert (period, len(cover)) == (133, 12)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


# --- mixing ---------------------------------------------------------------------------
def test_mix(docs, wide, empty, rows):
    found = mixing.mix_documents(docs).collect()
    size = {i: len(t.split()) for i, t in texts(rows)}
    assert len(found) == len(rows)
    assert all(r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] for r in found)
    by_source = {}
    for r in found:
        by_source.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (_, target), taken in by_source.items():
        assert abs(sum(taken) - target) <= 0.5
    assert abs(sum(t for _, t in by_source) - 1.5 * sum(size[r[0]] for r in rows)) < 1e-6
    assert Counter(collected(mixing.mix_documents(wide))) == Counter(tuple(r) for r in found)
    assert mixing.mix_documents(empty).count() == 0


def test_mixed_texts_hold_the_words_taken(docs, wide, empty):
    planned = mixing.mix_documents(docs).groupBy().sum("taken").first()[0]
    texts_ = mixing.mixed_texts(wide)
    assert texts_.columns == wide.columns
    assert sum(len((r["text"] or "").split()) for r in texts_.collect()) == planned
    assert {r["size"] for r in texts_.collect()} == {"old size"}
    assert mixing.mixed_texts(empty).count() == 0


def test_targets_share_out_what_caps_leave(spark):
    table = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 10)], "source string, size bigint")
    found = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    # weights 5, 2, 1, 5: a and the null source stop at 20, b and c share the rest two to one
    assert found["a"] == found[None] == 20
    assert abs(found["b"] - 2990 * 2 / 3) < 1e-9 and abs(found["c"] - 2990 / 3) < 1e-9
    assert abs(sum(found.values()) - 1.5 * 2020) < 1e-9


def test_mix_equals_its_sql_twin(spark):
    import duckdb

    from quillmill.llm.queries import QUERIES, SQL

    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    columns = "doc_id, size, source_size, target, taken"
    expected = connection.execute(f"select {columns} from ({SQL['op8_source_mix']})").fetchall()
    found = QUERIES["op8_source_mix"](spark, folder).select(*columns.split(", "))
    assert Counter(collected(found)) == Counter(expected)


# --- shards ---------------------------------------------------------------------------
def test_shards(spark, docs, wide, empty, rows):
    found = sharding.shard_documents(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        text = next(t for i, t in texts(rows) if i == r["doc_id"])
        assert (r["size"], r["text_crc32"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
    check_shards(found)
    check_shards(sharding.shard_documents(wide).collect())
    assert sharding.shard_documents(empty).count() == 0


def check_shards(found, shards=8):
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_keep_groups_together(spark):
    rows = [(i, f"text {i}") for i in range(300)] + [(1000 + i, f"copy {i % 40}") for i in range(200)]
    rows += [(5000 + i, "hot") for i in range(260)]  # a third of all: more than two shards hold
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    check_shards(found)
    text = dict(rows)
    places = {}
    for r in found:
        places.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert sum(len(places[f"copy {i}"]) for i in range(40)) <= 44
    assert len(places["hot"]) <= 5


# --- fingerprints ---------------------------------------------------------------------
def test_merkle(docs, wide, empty, rows):
    found = merkle.fingerprint_documents(docs).collect()
    assert len(found) == len(rows)
    ordered = sorted(((r[0] is not None, r[0] or 0), r[1] or "") for r in rows)
    expected = Counter()
    for k, ((_, doc_id), text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        expected[len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r["n_chars"], r["edited_sha256"]) for r in found) == expected
    prints = {}
    for r in found:
        prints.setdefault(next(t for i, t in texts(rows) if i == r["doc_id"]), set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(p) == 1 for p in prints.values()) and len({min(p) for p in prints.values()}) == len(prints)
    assert 0.3 < next(r["near_edited"] for r in found if r["doc_id"] == 2) < 0.6
    assert merkle.fingerprint_documents(wide).count() == len(rows)
    assert merkle.fingerprint_documents(empty).count() == 0


def test_merkle_locates_edits(spark):
    from pyspark.sql import functions as F

    a = "one two three\nfour five six\n\nseven eight\nnine ten\n"
    b = "one two three\nfour five six\n\nseven eight\nnine TEN\n"
    pair = spark.createDataFrame([(a, b)], "a string, b string").select(
        merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b")
    )
    row = pair.select(
        merkle.edits(F.col("a"), F.col("b")).alias("edits"),
        merkle.likeness(merkle.blocks(F.col("a")), merkle.blocks(F.col("b"))).alias("near"),
        (merkle.blocks(F.col("a")) == merkle.fingerprint_blocks(merkle.fingerprint(F.col("a")))).alias("same"),
    ).first()
    assert [tuple(e) for e in row["edits"]] == [(1, 1)]
    assert row["near"] == 0.8 and row["same"]  # the empty line is a block as well


# --- toxicity -------------------------------------------------------------------------
def labelled(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 8 == 0
        words = [f"n{(i * 13 + k * k) % 300}" for k in range(40)]
        if bad:
            words[5] = ["vile", "nasty", "rotten"][i // 8 % 3]
            words[20] = f"scummy{i % 5}"
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    rows += [(9000, None, None), (9001, "", "x"), (9002, "vile " * 20_000, "x"), (None, "nasty scummy9", None), (3, rows[3][1], "x")]
    labels += [(None, 1), (7, None), (8, 1), (8, 1), (99_999, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    found = toxicity.score_documents(docs, labels).collect()
    assert len(found) == docs.count()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    for r in found:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        if r["doc_id"] in truth:
            assert r["predicted"] == truth[r["doc_id"]]
    by_id = {r["doc_id"]: r["predicted"] for r in found}
    assert by_id[9000] == by_id[9001] == 0 and by_id[9002] == by_id[None] == 1
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(1 for r in found if not r["predicted"])


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark)
    assert {r["score"] for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_search_is_exact():
    dice = np.random.default_rng(2)
    examples = []
    for i in range(500):
        terms = dice.choice(30, dice.integers(1, 6), replace=False)
        weights = dice.random(len(terms)) + 0.1
        weights /= np.linalg.norm(weights)
        order = np.argsort(terms)
        examples.append(toxicity.Example(toxicity.Vector(terms[order], weights[order]), int(dice.integers(1, 3)), 0, i))
    index = toxicity.Index(examples)
    dense = {e.doc_id: np.bincount(e.vector.terms, e.vector.weights, 30) for e in examples}
    for example in examples[::7]:
        cosines = np.array([dense[example.doc_id] @ dense[i] for i in index.ids.tolist()])
        order = np.sort(np.repeat(cosines, index.counts.astype(int)))[::-1]
        least = order[toxicity.NEIGHBOURS - 1]
        found = index.search(example.vector)
        assert set(found.rows.tolist()) == set(np.flatnonzero(cosines >= least - 1e-9).tolist())
