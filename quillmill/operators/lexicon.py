"""Lemmas, entities, nouns, token patterns and triples, as joins on word tables.

Texts are taken as cleaned: words between blanks. A lexicon is joined; whether it is broadcast
goes by its size as the session has it. Phrases of a gazetteer are found by an automaton that
is broadcast if its measured size allows, else by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import patterns as P
from quillmill.functions.arrays import indexes
from quillmill.functions.binding import bind
from quillmill.functions.tokens import split_words
from quillmill.operators.features import explode_tokens
from quillmill.operators.gazetteer import HIT, listed_phrases, with_hits
from quillmill.plans.joins import lookup_join
from quillmill.plans.storage import cut_lineage
from quillmill.plans.wordmaps import joined_by_place, texts_by_id, word_map, words_by_id

# --- lemmas -------------------------------------------------------------------------
# Irregular forms (fixed values).
IRREGULAR_LEMMAS = {
    "became": "become", "began": "begin", "bought": "buy", "brought": "bring", "came": "come",
    "children": "child", "did": "do", "does": "do", "done": "do", "feet": "foot", "fell": "fall",
    "felt": "feel", "flew": "fly", "flown": "fly", "found": "find", "gave": "give", "given": "give",
    "goes": "go", "gone": "go", "got": "get", "grew": "grow", "had": "have", "has": "have",
    "held": "hold", "kept": "keep", "knew": "know", "known": "know", "left": "leave", "lost": "lose",
    "made": "make", "men": "man", "met": "meet", "mice": "mouse", "paid": "pay", "people": "person",
    "ran": "run", "said": "say", "sat": "sit", "saw": "see", "seen": "see", "sent": "send",
    "shown": "show", "sold": "sell", "spoke": "speak", "stood": "stand", "taken": "take",
    "taught": "teach", "teeth": "tooth", "thought": "think", "threw": "throw", "thrown": "throw",
    "told": "tell", "took": "take", "went": "go", "women": "woman", "won": "win", "wore": "wear",
    "written": "write", "wrote": "write",
}
# Words that stand as they are: forms of "be", pronouns and short function words (fixed values).
KEPT_FORMS = [
    "am", "are", "as", "be", "been", "being", "during", "he", "her", "hers", "herself",
    "him", "himself", "his", "is", "it", "its", "itself", "me", "mine", "my", "myself", "nothing",
    "our", "ours", "ourselves", "she", "something", "their", "theirs", "them", "themselves", "they",
    "this", "thus", "us", "was", "we", "were", "yes", "you", "your", "yours", "yourself",
]
# Endings of regular forms: (ending, replacement, shortest word), first match wins (fixed values).
LEMMA_ENDINGS = [
    ("sses", "ss", 5), ("ies", "y", 5), ("ches", "ch", 5), ("shes", "sh", 5), ("xes", "x", 5),
    ("ss", "ss", 2), ("us", "us", 2), ("is", "is", 2), ("s", "", 4),
    ("ying", "y", 6), ("ing", "", 6), ("ied", "y", 5), ("ed", "", 5),
]
KEEP_SURFACE = ["be", "-PRON-"]


def regular_lemma(word: Column) -> Column:
    """The word without its regular ending."""
    result = None
    for ending, replacement, shortest in LEMMA_ENDINGS:
        stem = F.left(word, F.length(word) - len(ending))
        fits = F.endswith(word, F.lit(ending)) & (F.length(word) >= shortest)
        value = F.concat(stem, F.lit(replacement))
        result = F.when(fits, value) if result is None else result.when(fits, value)
    return result.otherwise(word)


def choose_lemma(word: Column, listed: Column) -> Column:
    """The listed lemma, else the regular one; pronouns and forms of "be" keep their form."""
    return (
        F.when(listed.isin(KEEP_SURFACE), word)
        .when(listed.isNotNull(), listed)
        .when(word.isin(KEPT_FORMS), word)
        .otherwise(regular_lemma(word))
    )


def lemma_of_word(word: Column) -> Column:
    """Lemma by the built-in lists; no join."""
    table = F.create_map(*[F.lit(x) for pair in IRREGULAR_LEMMAS.items() for x in pair])
    listed = F.when(word.isin(list(IRREGULAR_LEMMAS)), F.element_at(table, word))
    return choose_lemma(word, listed)


def lemma_text(text: Column, null_token: str | None = P.NULL_TOKEN) -> Column:
    """Lemmas of a cleaned text joined by blanks, by the built-in lists, without a shuffle.

    A missing text reads as ``null_token``; with None it stays missing.
    """
    text = text if null_token is None else F.coalesce(text, F.lit(null_token))
    return F.array_join(F.transform(split_words(text), lemma_of_word), " ")


def join_words(words: DataFrame, id_col: str, word: Column, name: str) -> DataFrame:
    """(doc, text): the words of each document in order, joined by blanks."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", word.alias("word"))))
    text = F.array_join(F.transform(ordered, lambda entry: entry["word"]), " ")
    return words.groupBy(id_col).agg(text.alias(name))


def lemmatize(
    docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, lemma) by a (form, lemma) table; what it does not list follows the endings.

    A form listed twice has its first lemma by the alphabet; a missing text reads as ``NULL``.
    A small table, which is measured, is read inside the rows; a larger one is joined.
    """
    docs = docs.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(P.NULL_TOKEN)))
    one_each = cut_lineage(lexicon.groupBy("form").agg(F.min("lemma").alias("lemma")))
    find = word_map(one_each, "form", "lemma")
    if find is not None:
        texts = words_by_id(texts_by_id(docs, id_col, text_col), split_words)
        lemmas = F.zip_with("_words", find("_words"), choose_lemma)
        return texts.select(id_col, joined_by_place(lemmas, split_words).alias("lemma"))
    words = docs.select(id_col, F.posexplode_outer(split_words(text_col)).alias("pos", "form"))
    listed = lookup_join(words, one_each, "form", "left")
    return join_words(listed, id_col, choose_lemma(F.col("form"), F.col("lemma")), "lemma")


# --- entities and nouns -------------------------------------------------------------
def placed_words(text_col: str) -> Column:
    """Array of (word, start): the words of a text with their character offsets.

    A word is taken with the blanks behind it, so that the lengths add up to offsets.
    """
    before = F.length(F.regexp_extract(text_col, rf"^[{P.SPACE}]*", 0))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(rf"[^{P.SPACE}]+[{P.SPACE}]*"), F.lit(0))

    def placed(pieces: Column) -> Column:
        none = F.array().cast("array<int>")
        starts = F.aggregate(
            pieces,
            F.struct(before.alias("at"), none.alias("starts")),
            lambda s, piece: F.struct(
                (s["at"] + F.length(piece)).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")
            ),
        )["starts"]
        words = F.transform(pieces, lambda piece: F.regexp_replace(piece, rf"[{P.SPACE}]+$", ""))
        return F.zip_with(words, starts, lambda w, s: F.struct(w.alias("word"), s.alias("start")))

    return bind(pieces, placed)


def phrase_candidates(docs: DataFrame, id_col: str, text_col: str, sizes: DataFrame) -> DataFrame:
    """(doc, start, n, phrase, start_char, end_char): runs of words as long as some listed phrase.

    ``sizes`` is one row with the array of those lengths.
    """
    base = docs.select(id_col, placed_words(text_col).alias("words")).withColumn("sizes", sizes.scalar())

    def runs(words: Column, start: Column) -> Column:
        fitting = F.filter("sizes", lambda n: start + n <= F.size(words))

        def run(n: Column) -> Column:
            last = F.get(words, start + n - 1)
            phrase = F.array_join(F.transform(F.slice(words, start + 1, n), lambda w: w["word"]), " ")
            return F.struct(
                start.alias("start"),
                n.alias("n"),
                phrase.alias("phrase"),
                F.get(words, start)["start"].alias("start_char"),
                (last["start"] + F.length(last["word"])).alias("end_char"),
            )

        return F.transform(fitting, run)

    per_start = bind(
        F.col("words"),
        lambda words: F.transform(indexes(words), lambda start: runs(words, start)),
    )
    return base.select(id_col, F.inline(F.flatten(per_start)))


def longest_first(hits: Column) -> Column:
    """The hits that stay: the longest first, of equally long ones the first, each if it
    overlaps none that stays already."""
    ordered = F.transform(
        F.array_sort(F.transform(hits, lambda h: F.struct((-h["n"]).alias("key"), h["start"].alias("at"), h.alias("hit")))),
        lambda entry: entry["hit"],
    )

    def free(kept: Column, hit: Column) -> Column:
        return ~F.exists(
            kept, lambda k: (k["start"] < hit["start"] + hit["n"]) & (hit["start"] < k["start"] + k["n"])
        )

    return F.aggregate(
        ordered,
        F.slice(hits, 1, 0),
        lambda kept, hit: F.when(free(kept, hit), F.concat(kept, F.array(hit))).otherwise(kept),
    )


def joined_hits(docs: DataFrame, gazetteer: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, hits) of each row, by a join of its runs of words to a gazetteer of any size."""
    labels = listed_phrases(gazetteer).select("phrase", "label")
    sizes = labels.agg(F.collect_set(F.size(split_words("phrase"))).alias("sizes"))
    rows = cut_lineage(docs.select(id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    candidates = phrase_candidates(rows, "_row", text_col, sizes)
    found = lookup_join(candidates, labels, "phrase")
    hit = F.struct("start", "n", "phrase", "label", "start_char", "end_char")
    hits = found.groupBy("_row").agg(F.collect_list(hit).alias("hits"))
    kept = hits.select("_row", F.array_sort(longest_first(F.col("hits"))).alias("hits"))
    none = F.array().cast(f"array<struct<{HIT}>>")
    return rows.join(kept, "_row", "left").select(id_col, F.coalesce("hits", none).alias("hits"))


def entity_hits(
    docs: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, hits) of each row: listed phrases of any length as (start, n, phrase, label, start_char, end_char).

    Phrases are taken the longest first, of equally long ones the first, and one that overlaps
    a phrase taken before is left out. Hits stand in the order of the text. A missing text has none.
    """
    found = with_hits(docs, gazetteer, id_col, text_col)
    return joined_hits(docs, gazetteer, id_col, text_col) if found is None else found


def find_entities(
    docs: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (doc, start, n, phrase, label, start_char, end_char) of the phrases that ``entity_hits`` finds."""
    return entity_hits(docs, gazetteer, id_col, text_col).select(id_col, F.inline("hits"))


def entity_spans(
    docs: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, text, start_char, end_char, label) of each entity."""
    return find_entities(docs, gazetteer, id_col, text_col).select(
        id_col, F.col("phrase").alias("text"), "start_char", "end_char", "label"
    )


def entity_set(
    docs: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Distinct (doc, phrase, label)."""
    return find_entities(docs, gazetteer, id_col, text_col).select(id_col, "phrase", "label").distinct()


def _as_map(rows: DataFrame, docs: DataFrame, id_col: str, key: str, value: str, name: str) -> DataFrame:
    """One map per document, also for documents without rows; the last position wins."""
    last = rows.groupBy(id_col, key).agg(F.max_by(value, "start").alias(value))
    maps = last.groupBy(id_col).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(name)
    )
    empty = F.create_map().cast("map<string,string>")
    return docs.select(id_col).join(maps, id_col, "left").withColumn(name, F.coalesce(name, empty))


def extract_entities(
    docs: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, entities): map phrase to label, for each row."""
    pairs = F.array_distinct(F.transform("hits", lambda h: F.struct(h["phrase"], h["label"])))
    hits = entity_hits(docs, gazetteer, id_col, text_col)
    return hits.select(id_col, F.map_from_entries(F.sort_array(pairs)).alias("entities"))


def noun_forms(tags: DataFrame) -> DataFrame:
    """(form, tag): each form that a (form, pos) table lists as NOUN or PROPN; if as both, NOUN."""
    return tags.where(F.col("pos").isin("NOUN", "PROPN")).groupBy("form").agg(F.min("pos").alias("tag"))


def extract_nouns(
    docs: DataFrame, tags: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, nouns): map word to NOUN or PROPN, by a (form, pos) table."""
    nouns = noun_forms(tags)
    words = explode_tokens(docs, split_words(text_col), id_col).select(
        id_col, F.col("pos").alias("start"), F.col("term").alias("form")
    )
    rows = lookup_join(words, nouns, "form")
    return _as_map(rows, docs, id_col, "form", "tag", "nouns")


def annotate_posts(
    docs: DataFrame, gazetteer: DataFrame, tags: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All columns, and the entity and noun maps.

    The texts are written once, with a row number of their own, as they may be costly to
    make and ids may repeat; the maps are joined back on that number.
    """
    numbered = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))
    texts = numbered.select("_row", text_col)
    entities = extract_entities(texts, gazetteer, "_row", text_col)
    nouns = extract_nouns(texts, tags, "_row", text_col)
    return numbered.join(entities, "_row", "left").join(nouns, "_row", "left").drop("_row")


# --- token patterns -----------------------------------------------------------------
TokenRule = dict[str, str | bool]


def _token_matches(token: Column, rule: TokenRule) -> Column:
    checks = []
    for name, wanted in rule.items():
        if name == "LOWER":
            checks.append(F.lower(token) == wanted)
        elif name == "IS_PUNCT":
            check = token.rlike(r"^\p{P}$")
            checks.append(check if wanted else ~check)
        else:
            raise ValueError(f"unknown token rule {name!r}: use LOWER or IS_PUNCT")
    result = F.lit(True)
    for check in checks:
        result = result & check
    return result


def match_token_pattern(
    docs: DataFrame,
    patterns: dict[str, list[list[TokenRule]]],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc, name, start, end, text) of every run of tokens that fits a named pattern.

    ``start`` and ``end`` count tokens, words and marks alike; found within each row.
    """
    spaced = F.regexp_extract_all(
        F.col(text_col), F.lit(rf"(?:{P.TOKEN_OR_MARK})[{P.SPACE}]*"), F.lit(0)
    )
    trailing = rf"[{P.SPACE}]+$"
    rows = docs.select(id_col, spaced.alias("spaced")).withColumn(
        "tokens", F.transform("spaced", lambda token: F.regexp_replace(token, trailing, ""))
    )
    hits = [
        _pattern_spans(name, rules, trailing)
        for name, alternatives in patterns.items()
        for rules in alternatives
    ]
    return rows.select(id_col, F.inline(F.concat(*hits)))


def _pattern_spans(name: str, rules: list[TokenRule], trailing: str) -> Column:
    """Array of (name, start, end, text) over the columns ``tokens`` and ``spaced``."""
    size = len(rules)

    def fits(start: Column) -> Column:
        result = F.lit(True)
        for k, rule in enumerate(rules):
            result = result & _token_matches(F.get("tokens", start + k), rule)
        return result

    def span(start: Column) -> Column:
        text = F.array_join(F.slice("spaced", start + 1, size), "")
        return F.struct(
            F.lit(name).alias("name"),
            start.alias("start"),
            (start + size).alias("end"),
            F.regexp_replace(text, trailing, "").alias("text"),
        )

    starts = F.when(
        F.size("tokens") >= size, F.sequence(F.lit(0), F.size("tokens") - size)
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(starts, fits), span)


# --- triples ------------------------------------------------------------------------
def subject_object_triples(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc, x, v, y) from annotated tokens (doc, pos, text, dep): label to last such token.

    A document is passive when a label has ``subjpass`` from its second character on; then
    x are the objects and y the passive subjects, else x the subjects and y the objects.
    """
    last = tokens.groupBy(id_col, "dep").agg(F.max_by("text", "pos").alias("text"))
    flagged = last.select(
        id_col,
        F.struct("dep", "text").alias("entry"),
        (F.instr("dep", "subjpass") == 2).alias("is_passive_subject"),
    )
    grouped = flagged.groupBy(id_col).agg(
        F.max("is_passive_subject").alias("passive"),
        F.sort_array(F.collect_list("entry")).alias("entries"),
    )

    def ending(suffix: str) -> Column:
        return F.filter("entries", lambda e: F.endswith(e["dep"], F.lit(suffix)))

    passive_subjects = F.filter("entries", lambda e: F.instr(e["dep"], "subjpass") == 2)
    return grouped.select(
        id_col,
        F.map_from_entries(F.when(F.col("passive"), ending("obj")).otherwise(ending("subj"))).alias("x"),
        F.map_from_entries(ending("ROOT")).alias("v"),
        F.map_from_entries(F.when(F.col("passive"), passive_subjects).otherwise(ending("obj"))).alias("y"),
    )
