"""Benchmark decontamination: passages of test items in texts, found, measured and removed.

Column expressions and joins only. Texts are lower-cased (A-Z) and cut into words of letters
and digits. A window is ``SIZE`` consecutive words of an item, or all words of a shorter one;
every different window stands once in a table with the items it comes from. That table is
broadcast as a hash table; texts are read once, their windows are hashed in the row and met
with it where they are read, and a hit is compared word by word. Only hits, and one short row
for each text, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.binding import bind
from quillmill.plans.storage import cut_lineage

SIZE = 10  # words of a window
SIZE_LIMIT = 15  # words of the longest window that can be asked for
BROADCAST_BYTES = 48 << 20  # of the window table at once; a larger one is met in as many blocks as it takes
ENTRY_BYTES = 96  # of a window besides its words and of each item it comes from
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # what stands between words, in a text of any case


def words_of(text: Column) -> Column:
    """The lower-case words of a text; of a missing one none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(rf"[^{MARK}]+"), F.lit(0))


def window_hashes(words: Column, lengths: list[int]) -> Column:
    """Hashes of all windows of each length in turn, by doubling: 2, 4 and 8 words from halves.

    The windows of one length stand in the order of their first words; there are as many as
    fit. A hash depends on the words of a window alone.
    """

    def joined(a: Column, b: Column, ahead: int) -> Column:
        fitting = F.slice(a, F.lit(1), F.greatest(F.size(b) - ahead, F.lit(0)))
        return F.transform(fitting, lambda x, i: F.xxhash64(x, F.get(b, i + ahead)))

    def of(length: int, halves: dict[int, Column]) -> Column:
        done, ahead = None, 0
        for power in sorted(halves, reverse=True):
            if length & power:
                done = halves[power] if done is None else joined(done, halves[power], ahead)
                ahead += power
        return done

    def grown(halves: dict[int, Column]) -> Column:
        top = max(halves)
        if 2 * top <= max(lengths):
            return bind(joined(halves[top], halves[top], top), lambda next: grown(halves | {2 * top: next}))
        return F.concat(*[of(n, halves) for n in lengths])

    return bind(F.transform(words, lambda w: F.xxhash64(w)), lambda single: grown({1: single}))


def item_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, win): the windows of each item as arrays of words."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    cut = F.when(F.size("w") >= size, F.transform(starts, lambda i: F.slice("w", i, size))).when(
        F.size("w") > 0, F.array("w")
    )
    return words.select("item_id", F.explode(cut).alias("win"))


def window_table(windows: DataFrame) -> DataFrame:
    """(hash, win, items): each different window once, with the ids of its items."""
    pairs = windows.distinct().groupBy("win").agg(F.collect_set("item_id").alias("items"))
    # the hash of the window as a text's are: all its words make one window
    lengths = range(1, SIZE_LIMIT + 1)
    hashed = F.coalesce(*[F.when(F.size("win") == n, F.get(window_hashes(F.col("win"), [n]), F.lit(0))) for n in lengths])
    return pairs.select(hashed.alias("hash"), "win", "items")


def find_passages(docs: DataFrame, benchmark: DataFrame, carried: list[str], size: int = SIZE) -> DataFrame:
    """(doc, n_words, spans, items): where the windows of ``benchmark`` occur in each text of ``docs``.

    ``doc`` is a struct of the ``carried`` columns. ``spans`` holds (start, stop) in words of every
    occurrence, ``items`` the ids of the items with an occurring window, without order. One row
    per row of ``docs``; rows and ids may repeat or be null. A null text has no words. An item
    without words has no window; one without an id marks words, but is not listed. Without
    items, or without documents, nothing is found.

    The window table is measured first. Up to ``BROADCAST_BYTES`` texts are read once; beyond,
    they are numbered in a written table and met with the windows in blocks of that size.
    """
    if not 1 <= size <= SIZE_LIMIT:
        raise ValueError(f"size must be 1 to {SIZE_LIMIT}")
    windows = item_windows(benchmark, size)
    letters = F.aggregate("win", F.lit(0), lambda n, w: n + F.octet_length(w) + 16)
    # three numbers per length of window come to the driver
    measured = windows.groupBy(F.size("win").alias("n")).agg(F.sum(letters + ENTRY_BYTES).alias("bytes")).collect()
    lengths = sorted(row["n"] for row in measured) or [size]
    blocks = 1 + sum(row["bytes"] for row in measured) // BROADCAST_BYTES
    table = window_table(windows)
    numbered = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.struct(*carried).alias("doc"), F.col("text").alias("_text")
    )
    if blocks > 1:
        numbered, table = cut_lineage(numbered), cut_lineage(table)
    hits = None
    for block in range(blocks):
        part = table.where(F.pmod("hash", F.lit(blocks)) == block) if blocks > 1 else table
        found = _hits(numbered, part, lengths, first=block == 0)
        hits = found if hits is None else hits.union(found)
    whole = hits.groupBy("_row").agg(
        F.first("doc", ignorenulls=True).alias("doc"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_list("span")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    return whole.drop("_row")


def _hits(numbered: DataFrame, table: DataFrame, lengths: list[int], first: bool) -> DataFrame:
    """A row (_row, doc, n_words) for each text if ``first``, and (_row, span, items) for each occurrence."""
    cut = numbered.select("_row", "doc", words_of(F.col("_text")).alias("words"))
    # the entry in front stands for the text itself; it has no hash and meets no window
    itself = F.array(F.lit(None).cast("bigint"))
    placed = cut.select(
        "_row", "doc", "words", F.posexplode(F.concat(itself, window_hashes(F.col("words"), lengths))).alias("_i", "hash")
    )
    met = placed.join(F.broadcast(table), "hash", "left")
    n, size = F.size("words"), F.size("win")
    before = F.lit(1)
    for length in lengths:
        before = before + F.when(size > length, F.greatest(n - length + 1, F.lit(0))).otherwise(0)
    start = F.col("_i") - before
    same = F.slice("words", start + 1, F.greatest(size, F.lit(0))) == F.col("win")
    top = F.col("_i") == 0
    return met.where((top & first) | F.coalesce(F.when(~top & F.col("win").isNotNull(), same), F.lit(False))).select(
        "_row",
        F.when(top, F.col("doc")).alias("doc"),
        F.when(top, n.cast("bigint")).alias("n_words"),
        F.when(~top, F.struct(start.alias("start"), (start + size).alias("stop"))).alias("span"),
        F.when(~top, F.col("items")).alias("items"),
    )


def words_hit(spans: Column) -> Column:
    """How many words sorted spans cover."""
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto"))
    return F.aggregate(
        spans,
        start,
        lambda s, x: F.struct(
            (s["hit"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["upto"], x["start"]))).alias("hit"),
            F.greatest(s["upto"], x["stop"]).alias("upto"),
        ),
    )["hit"]


def merged(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap made one."""

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (x["start"] <= last["stop"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.slice(spans, F.lit(1), F.lit(0)), add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", size: int = SIZE) -> DataFrame:
    """``docs`` (text and any other columns) without the passages of ``benchmark``.

    ``mode='spans'`` cuts every word inside an occurrence, with the marks in front of it, and keeps
    the rest of the text as it is; ``mode='documents'`` drops each row with an occurrence. Rows
    without one stay untouched, a null text too. The texts move once, to meet their hits.
    """
    if mode not in ("spans", "documents"):
        raise ValueError(f"unknown mode {mode!r}: use 'spans' or 'documents'")
    found = find_passages(docs, benchmark, docs.columns, size)
    if mode == "documents":
        return found.where(F.size("spans") == 0).select("doc.*")
    pieces = F.regexp_extract_all("doc.text", F.lit(rf"[{MARK}]*+[^{MARK}]++|[{MARK}]++"), F.lit(0))
    gaps = bind(merged(F.col("spans")), lambda spans: _left(pieces, spans))
    text = F.when(F.size("spans") > 0, gaps).otherwise(F.col("doc.text"))
    return found.select(*[text.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def _left(pieces: Column, spans: Column) -> Column:
    """The pieces outside of separate sorted spans, joined."""

    def cut(pieces: Column) -> Column:
        def gap(span: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(spans, i - 1)["stop"]).otherwise(0)
            return F.array_join(F.slice(pieces, before + 1, span["start"] - before), "")

        last = F.get(spans, F.size(spans) - 1)["stop"]
        rest = F.array_join(F.slice(pieces, last + 1, F.size(pieces)), "")
        return F.concat(F.array_join(F.transform(spans, gap), ""), rest)

    return bind(pieces, cut)


def measure_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document its words, how many an occurring window covers, and which items those come from."""
    found = find_passages(docs, benchmark, ["doc_id"])
    hit = words_hit(F.col("spans")).cast("bigint")
    return found.select("doc.doc_id", "n_words", hit.alias("n_hit"), "items").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = rf"""
with docs as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
items as (
  select cast(item_id as varchar) as item_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
cut as (
  select item_id, unnest(case when len(w) >= {SIZE}
    then list_transform(range(1, len(w) - {SIZE - 2}), lambda i: array_to_string(w[i:i + {SIZE - 1}], ' '))
    else [array_to_string(w, ' ')] end) as win, least(len(w), {SIZE}) as n
  from items where len(w) > 0),
places as (
  select r, w, n, unnest(range(1, len(w) - n + 2)) as i
  from docs, (select distinct n from cut) where len(w) >= n),
hits as (
  select p.r, p.i, p.n, c.item_id
  from places p join cut c on c.n = p.n and c.win = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
covered as (
  select r, count(*) as n_hit from (select distinct r, unnest(range(i, i + n)) as k from hits) group by r),
listed as (
  select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct r, item_id from hits where item_id is not null) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (r) left join listed using (r)"""
