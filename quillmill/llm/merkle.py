"""Document fingerprints: a Merkle tree over sections, paragraphs and blocks of words.

Column expressions only. A text is cut into sections behind blank lines, sections into
paragraphs behind line ends, and paragraphs into blocks of a few words, each cut keeping its
blanks, so the blocks in order are the text. A block has the hash of its text, every node
above the hash of the list of its children's hashes, and the root the digest of its
sections' hashes: equal texts have equal roots, and texts that differ do so along the
branches that lead to the edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

BLOCK_WORDS = 6
WORD_LENGTH = 32  # a longer run without blanks counts as several words
BLOCKS_PER_PARTITION = 8


def parts(text: Column, border: str) -> Column:
    """``text`` cut at the matches of ``border``, which take no characters; no part is empty."""
    return F.filter(F.split(text, border), lambda x: x != "")


def tree(text: Column, block_words: int = BLOCK_WORDS) -> Column:
    """The tree of a text as nested arrays: sections (hash, paragraphs (hash, blocks)).

    A null text is an empty one, whose tree has no sections.
    """
    block = F.lit(rf"(?:[^ ]{{1,{WORD_LENGTH}}}+ *+){{1,{block_words}}}+| +")

    def paragraph(line: Column) -> Column:
        hashes = F.transform(F.regexp_extract_all(line, block, F.lit(0)), lambda b: F.xxhash64(b))
        return F.transform(F.array(hashes), lambda h: F.struct(F.xxhash64(h).alias("hash"), h.alias("blocks")))[0]

    def section(text: Column) -> Column:
        lines = F.transform(parts(text, r"(?<=\n)"), paragraph)
        return F.transform(
            F.array(lines),
            lambda x: F.struct(F.xxhash64(F.transform(x, lambda p: p["hash"])).alias("hash"), x.alias("paragraphs")),
        )[0]

    return F.transform(parts(F.coalesce(text, F.lit("")), r"(?<=\n\n)(?!\n)"), section)


def digits(hashed: Column, width: int) -> Column:
    """The last ``width`` hexadecimal digits of a hash."""
    return F.lower(F.substring(F.lpad(F.hex(hashed), 16, "0"), 17 - width, width))


def root(sections: Column) -> Column:
    """32 digits that are equal for equal trees."""
    return F.md5(F.array_join(F.transform(sections, lambda s: digits(s["hash"], 16)), ""))


def fingerprint(sections: Column) -> Column:
    """A tree as a string: the root, then /section:paragraph=blocks;paragraph=blocks and so on.

    Hashes of sections and paragraphs have 16 digits, blocks the last 8 of theirs.
    """

    def paragraph(p: Column) -> Column:
        blocks = F.array_join(F.transform(p["blocks"], lambda b: digits(b, 8)), "")
        return F.concat(digits(p["hash"], 16), F.lit("="), blocks)

    def section(s: Column) -> Column:
        lines = F.array_join(F.transform(s["paragraphs"], paragraph), ";")
        return F.concat(F.lit("/"), digits(s["hash"], 16), F.lit(":"), lines)

    return F.concat(root(sections), F.array_join(F.transform(sections, section), ""))


def blocks(sections: Column) -> Column:
    """The different blocks of a tree, as the numbers that the fingerprint shows."""
    lines = F.flatten(F.transform(sections, lambda s: F.transform(s["paragraphs"], lambda p: p["blocks"])))
    return F.array_distinct(F.transform(F.flatten(lines), lambda b: F.shiftright(F.shiftleft(b, 32), 32)))


def fingerprint_blocks(fingerprint: Column) -> Column:
    """The same, read from a fingerprint."""
    lines = F.regexp_extract_all(fingerprint, F.lit("=([0-9a-f]*)"), F.lit(1))
    found = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(".{8}"), F.lit(0))))
    whole = F.transform(found, lambda x: F.conv(x, 16, 10).cast("bigint"))
    return F.array_distinct(F.transform(whole, lambda b: F.shiftright(F.shiftleft(b, 32), 32)))


def likeness(a: Column, b: Column) -> Column:
    """Shared blocks of two block lists against their mean number: 0 none, 1 the same blocks.

    Texts without any block are alike.
    """
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def edits(a: Column, b: Column) -> Column:
    """Where tree ``a`` holds what tree ``b`` does not: (section, paragraph), counted from 0.

    Only sections whose hash the other tree lacks are searched, and in them the paragraphs
    whose hash it lacks anywhere.
    """
    sections = F.transform(b, lambda s: s["hash"])
    lines = F.flatten(F.transform(b, lambda s: F.transform(s["paragraphs"], lambda p: p["hash"])))

    def changed(s: Column, i: Column) -> Column:
        places = F.transform(
            s["paragraphs"],
            lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), F.array_contains(lines, p["hash"]).alias("k")),
        )
        left = F.filter(places, lambda x: ~x["k"])
        found = F.transform(left, lambda x: F.struct(x["section"], x["paragraph"]))
        return F.when(F.array_contains(sections, s["hash"]), F.slice(found, 1, 0)).otherwise(found)

    return F.flatten(F.transform(a, changed))


def in_ranges(docs: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """``docs`` (doc_id, text, ...) in ranges of ids, and the window in which ``lead`` is the next row.

    The next row is the one with the next doc_id (nulls first; rows of one id by the hash of
    their texts), after the last the first. Ids are cut into ranges of about equal numbers of
    rows; each range is one window, and ends in a copy of the first row of the next range,
    so texts move once. These copies have ``_copy`` set. The borders are approximate quantiles, which only size the ranges.
    """
    spark = docs.sparkSession
    wanted = BLOCKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / wanted for i in range(1, wanted)]
    ids = docs.select(F.col("doc_id").cast("double").alias("doc_id"))
    borders = sorted(set(ids.approxQuantile("doc_id", steps, 0.25 / wanted)))
    place = F.coalesce(
        F.size(F.filter(F.array(*[F.lit(float(x)) for x in borders]), lambda x: x <= F.col("doc_id"))), F.lit(0)
    ) if borders else F.lit(0)
    placed = docs.withColumn("_hash", F.xxhash64("text")).withColumn("_range", place)
    # one row per range meets on the driver; their number is set above
    first = placed.groupBy("_range").agg(F.min(F.struct("doc_id", "_hash")).alias("first")).orderBy("_range").collect()
    kind = docs.schema["doc_id"].dataType.simpleString()
    before = [
        (first[i - 1]["_range"], row["first"]["doc_id"], row["first"]["_hash"]) for i, row in enumerate(first)
    ]
    heads = spark.createDataFrame(before, f"_of int, _id {kind}, _first bigint")
    copies = (
        placed.join(
            F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_first"))
        )
        .dropDuplicates(["_of"])
        .withColumn("_range", F.col("_of"))
        .drop("_of", "_id", "_first")
    )
    rows = placed.withColumn("_copy", F.lit(False)).unionByName(copies.withColumn("_copy", F.lit(True)))
    rows = rows.repartition("_range")
    order = Window.partitionBy("_range").orderBy("_copy", F.col("doc_id").asc_nulls_first(), "_hash")
    return rows, order


def fingerprint_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    The edited form has, in place of the last half of the text's code points (rounded
    down), as many from the start of the next document, or all it has. A null text is an
    empty one. Rows may repeat. An empty table gives an empty table.
    """
    rows, order = in_ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumn("_tree", tree(F.col("text"), block_words)).withColumn("_blocks", blocks(F.col("_tree")))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("_tree"))).drop("_tree")
    paired = rows.select(
        "*", F.lead("text").over(order).alias("_next"), F.lead("_blocks").over(order).alias("_next_blocks")
    ).where("not _copy")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = paired.withColumn("n_chars", F.length("text").cast("bigint")).withColumn(
        "_edited",
        F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("_next"), F.lit(1), half)),
    )
    grown = edited.withColumn("_edited_tree", tree(F.col("_edited"), block_words))
    return grown.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        "fingerprint",
        fingerprint(F.col("_edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("_blocks"), blocks(F.col("_edited_tree"))).alias("near_edited"),
        likeness(F.col("_blocks"), F.col("_next_blocks")).alias("near_next"),
    )
