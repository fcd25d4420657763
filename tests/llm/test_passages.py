"""Benchmark passages, periodic runs and the prefix trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import decontamination, periods, prefixes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RUN_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- benchmark passages ---------------------------------------------------------------
def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def passages(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    rows = []
    for doc_id, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids |= windows[tuple(w[i : i + n])] - {None}
        listed = sorted(str(i) for i in ids)
        rows.append((doc_id, len(w), len(hit), len(ids), sha(",".join(listed)), bool(hit)))
    return sorted(rows, key=str)


def made_texts():
    source = random.Random(4)
    names = [f"{a}{b}" for a in "abcdefgh" for b in ("É", "1", "x")]
    items = [("b2", "ABC é-ß. 77"), ("b10", "one"), ("b3", None), ("b4", " ., "), (None, "lone words here"), ("b2", "ABC é-ß. 77")]
    items += [(f"i{k}", " ".join(source.choice(names[:6]) for _ in range(source.randrange(8, 16)))) for k in range(8)]
    texts = [None, "", "...", "x abc, É ß 77 y", "abc é ß 77", "ONE", "One one two", "lone words here and there"]
    for _ in range(60):
        parts = [" ".join(source.choice(names) for _ in range(source.randrange(0, 30)))]
        parts += [source.choice(items)[1] or "" for _ in range(source.randrange(0, 3))]
        source.shuffle(parts)
        texts.append("; ".join(parts))
    texts.append(" ".join(names[i % 24] for i in range(30_000)) + " " + items[-1][1])
    docs = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    return docs + docs[10:12], items


def test_passages_are_those_of_brute_force(spark, monkeypatch):
    docs, items = made_texts()
    table = spark.createDataFrame([(d, t, "old") for d, t in docs], "doc_id bigint, text string, spans string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, items int")
    expected = passages(docs, items)
    assert sorted(map(tuple, decontamination.measure_passages(table, bench).collect()), key=str) == expected
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 2000)  # several blocks
    assert sorted(map(tuple, decontamination.measure_passages(table, bench).collect()), key=str) == expected


def test_windows_of_other_lengths(spark):
    docs, items = made_texts()
    table = spark.createDataFrame(docs[:40], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for size in (1, 3, 7, 13):
        found = decontamination.find_passages(table, bench, ["doc_id"], size)
        got = found.select("doc.doc_id", decontamination.words_hit(F.col("spans")).alias("n"), F.size("items")).collect()
        assert sorted(map(tuple, got), key=str) == sorted([(r[0], r[2], r[3]) for r in passages(docs[:40], items, size)], key=str)
    with pytest.raises(ValueError):
        decontamination.find_passages(table, bench, ["doc_id"], 16)


def test_passages_are_cut(spark):
    bench = spark.createDataFrame([("q", "What is the Answer")], "item_id string, text string")
    rows = [(1, "Say: what -- IS the answer? 42.", "a"), (2, "clean", "b"), (3, None, "c"), (4, "what is the answer", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, doc string")
    cut = {r.doc_id: (r.text, r.doc) for r in decontamination.decontaminate(docs, bench).collect()}
    assert cut == {1: ("Say? 42.", "a"), 2: ("clean", "b"), 3: (None, "c"), 4: ("", None)}
    kept = decontamination.decontaminate(docs, bench, "documents")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, bench, "pages")


def test_no_items_or_no_documents(spark, docs, empty):
    bench = spark.createDataFrame([("q", "What is the Answer")], "item_id string, text string")
    assert decontamination.measure_passages(empty, bench).count() == 0
    none = decontamination.measure_passages(docs, bench.limit(0))
    assert none.count() == docs.count() and none.where("contaminated or n_items > 0").count() == 0


# --- periodic runs --------------------------------------------------------------------
def slow_runs(w):
    best = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] == w[i + q]:
                j = i
                while j + q < len(w) and w[j] == w[j + q]:
                    j += 1
                if j - i + q >= max(24, 3 * q):
                    best.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def looping(source):
    out = []
    while len(out) < source.randrange(1, 400):
        base = [source.choice("abcd"[: source.randrange(1, 5)]) for _ in range(source.randrange(1, 40))]
        unit = [source.choice("ab") for _ in range(source.randrange(1, 5))]
        base = source.choice([base, (unit * 30)[: len(base)] + base[:3]])
        out += (base * source.randrange(1, 7))[source.randrange(0, 3) :]
    return out


def slow_measure(doc_id, text):
    w = RUN_WORD.findall(text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs, best, drop = slow_runs(w), None, set()
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
        drop.update(range(s + q, s + length))
    top = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *top, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_runs_are_those_of_brute_force():
    source = random.Random(7)
    x, y = "a", "ab"
    while len(y) < 900:
        x, y = y, y + x
    texts = [looping(source) for _ in range(150)] + [[], ["a"], ["a"] * 23, ["a"] * 24, list(y), ["a", "b"] * 600]
    texts += [[str(i % 300) for i in range(1000)]]
    got = periods.runs_of_texts([[w.encode() for w in t] for t in texts])
    assert got == [slow_runs(t) for t in texts]


def test_false_fingerprints_are_compared_out(monkeypatch):
    source = random.Random(8)
    texts = [looping(source) for _ in range(30)]
    # a fingerprint that takes any two words for equal where the first ones are
    monkeypatch.setattr(periods.Extender, "equal", lambda self, a, b, length: np.ones(len(a), bool))
    for text in texts:
        symbols = np.array([ord(w) for w in text])
        for start, end, q in periods.runs_of(symbols):
            assert text[start : end - q] == text[start + q : end]


def test_range_successor():
    source = np.random.default_rng(3)
    for n in (1, 2, 65, 700):
        values = source.permutation(n)
        tree = periods.WaveletTree(values)
        low = source.integers(0, n, 300)
        high = low + 1 + source.integers(0, n, 300) % (n - low)
        bound = source.integers(0, n + 3, 300)
        k = source.integers(0, n, 300) % (high - low)
        assert tree.below(low, high, bound).tolist() == [(values[a:b] < x).sum() for a, b, x in zip(low, high, bound)]
        assert tree.smallest(low, high, k).tolist() == [np.sort(values[a:b])[i] for a, b, i in zip(low, high, k)]


def test_runs_of_documents(spark, docs, wide, empty):
    source = random.Random(9)
    rows = [(i, source.choice([" ", "\n", "\t\x0b"]).join(looping(source))) for i in range(120)]
    rows += [(500, " ".join(f"é{i % 50}" for i in range(25_000))), (None, "a " * 30), (501, None), (501, None), (502, " \n")]
    rows += [(503, "a\x1cb " * 30), (504, "\xa0 " * 40)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = sorted((slow_measure(*row) for row in rows if row[0] != 500), key=str)
    got = [tuple(r) for r in periods.measure_runs(table).collect()]
    assert sorted([r for r in got if r[0] != 500], key=str) == expected
    [long] = [r for r in got if r[0] == 500]
    assert long[1] >= 1
    assert periods.measure_runs(empty).count() == 0
    assert sorted(map(str, periods.measure_runs(wide).collect())) == sorted(map(str, periods.measure_runs(docs).collect()))


def test_found_runs_and_the_rest_of_a_text(spark):
    table = spark.createDataFrame([(1, "x " + "a b c " * 10 + "y"), (2, "p q")], "key int, body string")
    found = {r.key: r for r in periods.find_runs(table, "key", "body").collect()}
    assert [tuple(x) for x in found[1].runs] == [(1, 30, 3)] and found[1].collapsed == "x a b c y" and found[1].n_words == 32
    assert found[2].runs == [] and found[2].collapsed == "p q"


# --- prefix trie ----------------------------------------------------------------------
def slow_trie(rows, rebuilt=True):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = sha(f"{len(role)}:{role}{text}")
            turns[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4 if rebuilt else 0
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, s in whole.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        n = len(RUN_WORD.findall(p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * n + sum(saved[k] for k in children[p])
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
         sha(",".join(map(str, sorted(ends[p])))))
        for p, m in members.items()
    )


def nodes_of(df):
    return sorted(tuple(-1 if x is None else x for x in row) for row in df.collect())


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, depth int, k1 string"


def test_trie_is_that_of_brute_force(spark, monkeypatch):
    source = random.Random(11)
    rows = []
    for c in range(400):
        if c % 40 != 20:  # some first conversations of a group are absent
            copy = source.randrange(3)
            for i in range(source.randrange(1, 7)):
                text = source.choice(["x", "y z", "", None]) if copy else f"same {i}"
                rows.append((c * 5000 if c % 3 else c, source.choice([None, i, i, i]), source.choice(["u", "a", None]), text))
    rows += rows[:20] + [(None, 1, "u", "lost")]
    rows += [(9_000_000 + c, i, "u", f"long {i % 5}") for c in (0, 1, 2) for i in range(1500 - 3 * (c // 2))]
    table = spark.createDataFrame([(*r, 7, "old") for r in rows], CONVERSATIONS)
    monkeypatch.setattr(prefixes, "SHARD_ROWS", 300)
    assert nodes_of(prefixes.rebuilt_trie(table)) == slow_trie(rows)
    assert nodes_of(prefixes.prefix_trie(table)) == slow_trie(rows, False)


@pytest.mark.parametrize("rows", [
    [(3, 0, "u", "a b")],
    [(3, 0, "u", "a b"), (3, 1, "u", "c")],
    [(c, i, "u", f"t{i}") for c in (1, 2, 3) for i in range(3)],
    [(c, i, "u", f"t{i}") for c in (1, 2, 3) for i in range(c)],
    [(c, None, None, None) for c in (21, 22, 23, 24, 25, 26)],
])
def test_small_tries(spark, rows):
    table = spark.createDataFrame([(*r, 7, "old") for r in rows], CONVERSATIONS)
    assert nodes_of(prefixes.rebuilt_trie(table)) == slow_trie(rows)
    assert nodes_of(prefixes.prefix_trie(table)) == slow_trie(rows, False)


def test_no_conversations(spark):
    assert prefixes.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_closing_parentheses():
    source = random.Random(2)
    for n in (1, 2, 40, 3000):
        parent = [0] + [source.choice([i - 1, source.randrange(i)]) for i in range(1, n)]
        depth = np.zeros(n, np.int64)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        place = prefixes.preorder(np.array(parent), depth)
        opened = 2 * place - depth
        closed = prefixes.Parentheses(opened, 2 * n).close(opened)
        size = np.ones(n, np.int64)
        for i in range(n - 1, 0, -1):
            size[parent[i]] += size[i]
        assert (closed - opened + 1 == 2 * size).all() and sorted(place.tolist()) == list(range(n))
