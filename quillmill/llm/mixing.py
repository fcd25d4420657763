"""Mixing sources to target weights by distributed prefix sums over hash-random keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.tables import shielded, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
RANGE_DIGITS = 3
MIX_NAMES = set("size source_size target taken _key _range _sum _source _of _start _before _words".split())


def word_count(text: Column) -> Column:
    """How many runs of other characters than ASCII blanks ``text`` has; a null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS
) -> DataFrame:
    """(source, source_size, target) of a table (source, size), one row per source.

    Sources in code point order, null last, take the weights in turn and divide ``share``
    of all sizes by weight. No target exceeds ``epochs`` times its source's size; what is
    over goes to the others by weight. With the sources ordered by the level at which they
    fill up, those filled are the first few, so prefix sums give the level of the rest. One
    row per source meets in one place, never a row per document.
    """
    one_row = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    # filled up in this order; ties by name
    rising = Window.orderBy("_fills", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    filled = (
        totals.withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size").cast("double") * epochs)
        .withColumn("_fills", F.col("_cap") / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(one_row).cast("double") * share)
        .withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn(
            "_open",
            F.sum("_weight").over(one_row) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)),
        )
        .withColumn("_level", F.col("_left") / F.col("_open"))
        .withColumn("_rank", F.row_number().over(rising))
    )
    first_open = F.min_by(
        F.when(F.col("_fills") > F.col("_level"), F.col("_level")),
        F.when(F.col("_fills") > F.col("_level"), F.col("_rank")),
    ).over(one_row)
    target = F.least(F.col("_cap"), F.coalesce(first_open * F.col("_weight"), F.col("_cap")))
    return filled.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    range_digits: int = RANGE_DIGITS,
) -> DataFrame:
    """``docs`` (doc_id, source, size, any others) with source_size, target and taken.

    Each row gets a key that looks random but depends on its id only. Within a source the
    rows stand in key order, cut into key ranges by the first hexadecimal digits; sums per
    range give each range's start, and a running sum within the range the rest, so that no
    source, however large, is sorted in one task. A source's budget is its rounded target;
    every full pass takes each row whole, the last pass up to the budget, where one row may
    be cut. Rows with no size, and rows that are equal in all columns, are kept; equal rows
    may share their turns in any order, which leaves the table the same.

    Nulls: a null source is a source of its own, a null id hashes as an empty one, a null
    size counts as 0. Columns named like a new one are replaced. An empty table gives an
    empty table.
    """
    docs = docs.drop(*(MIX_NAMES - {"size"}))
    spread = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = (
        docs.withColumn("size", F.coalesce(F.col("size").cast("bigint"), F.lit(0).cast("bigint")))
        .withColumn("_key", spread)
        .withColumn("_range", F.substring("_key", 1, range_digits))
    )
    targets = source_targets(keyed.select("source", "size"), weights, share, epochs)
    ranges = keyed.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    before_range = (
        Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    ranges = ranges.withColumn("_start", F.coalesce(F.sum("_sum").over(before_range), F.lit(0)))
    starts = (
        ranges.alias("r")
        .join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        .select(F.col("r.source").alias("_source"), F.col("_range").alias("_of"), "_start", "source_size", "target")
    )
    running = (
        Window.partitionBy("source", "_range")
        .orderBy("_key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - passes * F.col("source_size")
    placed = (
        keyed.withColumn("_before", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .join(
            starts,
            F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_of")),
            "left",
        )
    )
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start") - F.col("_before")))
    return placed.withColumn("taken", (passes * F.col("size") + last).cast("bigint")).drop(
        "_key", "_range", "_source", "_of", "_start", "_before"
    )


def mixed_texts(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix has them: a row for each pass over a document, columns unchanged.

    A document that the last pass cuts gives the words up to the cut; ``n_chars``, when
    there, follows the text. Documents that the mix leaves out are gone; of the documents
    without words, which cost nothing, each stays once.
    """
    rows, back = shielded(docs, MIX_NAMES)
    columns = rows.columns
    planned = mix(rows.withColumn("size", word_count(F.col("text"))))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    turns = F.concat(
        F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>"))
    )
    rows = planned.select(*columns, F.explode(turns).alias("_words"))
    before = F.regexp_extract(F.col("text"), r"^[\x20\x09-\x0D]*", 0)
    pieces = F.regexp_extract_all(F.col("text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.concat(before, F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.col("_words"), F.lit(1))), ""))
    rows = rows.withColumn("text", F.when(F.col("_words") == 0, F.col("text")).otherwise(cut))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn(
            "n_chars", F.when(F.col("_words") == 0, F.col("n_chars")).otherwise(F.length("text").cast(kind))
        )
    return rows.select(*columns).withColumnsRenamed(back)


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``."""
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(coalesce(cast(doc_id as varchar), '')) as k
  from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, ([5.0, 2.0, 1.0])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w
  from totals),
filled as (
  select *, 2.0::double * source_size as cap, 2.0::double * source_size / w as fills,
    (sum(source_size) over ())::double * 1.5::double as budget
  from weighed),
levels as (
  select *, (budget - coalesce(sum(cap) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as level,
    row_number() over (order by fills, source nulls last) as r
  from filled
  window before as (order by fills, source nulls last rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size,
    least(cap, coalesce(arg_min(level, r) filter (fills > level) over () * w, cap)) as target
  from levels),
placed as (
  select s.*, t.source_size, t.target, floor(t.target + 0.5)::bigint as budget,
    coalesce(sum(size) over (partition by s.source order by k, doc_id, size
      rows between unbounded preceding and 1 preceding), 0) as before
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (case when source_size > 0 then budget // source_size else 0 end * size
   + greatest(0, least(size, budget - case when source_size > 0 then budget // source_size else 0 end * source_size
     - before)))::bigint as taken
from placed
"""
