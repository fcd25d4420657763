"""Text cleaning as native column expressions.

Every function reads a missing text as the literal ``NULL`` by default, as the
cleaning rules ask for; ``null_token=None`` keeps SQL NULL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions import patterns as P
from quillmill.functions.binding import bind

ColumnLike = Column | str


def _head(text: ColumnLike, null_token: str | None) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    column = column.cast("string")
    return column if null_token is None else F.coalesce(column, F.lit(null_token))


def _only_where(column: Column, needed, change) -> Column:
    """``change(text)`` for texts that need it; a cheap test spares all others the work."""
    return bind(column, lambda text: F.when(needed(text), change(text)).otherwise(text))


def _has(*marks: str):
    def test(text: Column) -> Column:
        found = F.contains(text, F.lit(marks[0]))
        for mark in marks[1:]:
            found = found | F.contains(text, F.lit(mark))
        return found

    return test


def _not_ascii(text: Column) -> Column:
    return F.length(text) != F.octet_length(text)


def remove_html(text: ColumnLike, null_token=P.NULL_TOKEN) -> Column:
    """Text nodes of a page, each stripped, joined by a blank.

    Comments, scripts and styles are left out, and markup may be broken: an opened tag that never
    ends stays as text, as does a comment or script without an end. Every step is one pass over
    the page, so its time grows with the page's length whatever the page holds.
    """

    def text_nodes(page: Column) -> Column:
        nodes = F.transform(F.split(_without_tags(page), P.TEXT_BREAK), _strip)
        return F.array_join(F.filter(nodes, lambda node: node != ""), " ")

    return bind(
        _head(text, null_token),
        lambda page: F.when(_has("<", "&", P.TEXT_BREAK)(page), text_nodes(page)).otherwise(_strip(page)),
    )


def _held(page: Column, start: str, end: str) -> Column:
    """The page with the starts of hidden text that no end follows held back.

    A start counts if its tag ends before the last end mark; one behind is searched to the end of the
    page in vain, each time anew.
    """

    def hold(page: Column) -> Column:
        # what lies before the last end mark, and in it before the last end of a tag
        before = F.regexp_extract(page, rf"(?is)^(.*){end}", 1)
        if end != "-->":
            before = F.regexp_extract(before, "(?s)^(.*)>", 1)
        rest = lambda k: F.regexp_replace(F.substring(page, k + 1, F.length(page)), rf"(?i)<(?={start})", P.HTML_HELD)
        return bind(F.length(before), lambda k: F.concat(F.left(page, k), rest(k)))

    return _only_where(page, lambda page: page.rlike(rf"(?i)<{start}"), hold)


def _without_tags(page: Column) -> Column:
    """The page with markup turned into separators and character references read."""

    def unhide(page: Column) -> Column:
        for start, end in P.HTML_HIDDEN_KINDS:
            page = _held(page, start, end)
        return F.regexp_replace(page, P.HTML_HIDDEN, P.TEXT_BREAK)

    def cut(page: Column) -> Column:
        # one search tells pages without hidden text, which most are
        page = _only_where(page, lambda page: page.rlike(P.HTML_HIDDEN_START), unhide)
        page = F.replace(page, F.lit(P.HTML_HELD), F.lit("<"))
        marked = F.regexp_replace(F.replace(page, F.lit(">"), F.lit(">" + P.TEXT_BREAK)), P.HTML_TAG, "$1$2")
        return F.replace(marked, F.lit(">" + P.TEXT_BREAK), F.lit(">"))

    return _only_where(_only_where(page, _has("<"), cut), _has("&"), read_references)


def read_references(text: Column) -> Column:
    """Decimal, hexadecimal and named character references as their characters, in one pass.

    A name that the standard does not have stays as it is; a number that is no character
    becomes the replacement character.
    """
    names = F.create_map(*[F.lit(x) for pair in P.HTML_NAMES.items() for x in pair])

    def character(code: Column) -> Column:
        known = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        fits = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(fits, known).otherwise(F.lit(P.UNREADABLE))

    def read(piece: Column) -> Column:
        def known(name: Column) -> Column:
            number = F.when(
                F.lower(F.left(name, F.lit(2))) == "#x", F.conv(F.substring(name, 3, 9), 16, 10)
            ).otherwise(F.substring(name, 2, 9)).cast("bigint")
            found = F.when(F.startswith(name, F.lit("#")), bind(number, character)).otherwise(
                F.try_element_at(names, name)
            )
            rest = F.substring(piece, F.length(name) + 2, F.length(piece))
            return F.coalesce(F.when(name != "", F.concat(found, rest)), F.concat(F.lit("&"), piece))

        return bind(F.regexp_extract(piece, P.HTML_REFERENCE, 1), known)

    pieces = F.split(text, "&", -1)
    return bind(
        pieces,
        lambda p: F.concat(
            F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), read), "")
        ),
    )


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(P.SPACES))


def remove_accented_chars(
    text: ColumnLike, null_token=P.NULL_TOKEN, mode: str = "latin"
) -> Column:
    """Letters with accents to plain ASCII letters.

    ``mode='latin'`` covers the Latin blocks natively; ``mode='unicode'`` also
    decomposes every other script's letters in Arrow batches.
    """
    column = _head(text, null_token)
    if mode == "unicode":
        column = _decompose_udf(column)
    elif mode != "latin":
        raise ValueError(f"unknown mode {mode!r}: use 'latin' or 'unicode'")

    def plain(text: Column) -> Column:
        text = F.translate(text, P.ACCENTS_FROM, P.ACCENTS_TO)
        for letter, spelling in P.LETTER_SPELLINGS.items():
            text = F.replace(text, F.lit(letter), F.lit(spelling))
        return text

    def words(text: Column) -> Column:
        return F.array_join(F.transform(F.split(text, " "), lambda word: F.when(_not_ascii(word), plain(word)).otherwise(word)), " ")

    # letters are spelled one by one, so only the words that hold such a letter are read
    return _only_where(column, _not_ascii, words)


@F.pandas_udf(T.StringType())
def _decompose_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.str.normalize("NFKD")


def remove_tabs(text: ColumnLike, null_token=P.NULL_TOKEN) -> Column:
    """Tab, carriage return and line feed to a blank."""
    return _only_where(
        _head(text, null_token), _has("\t", "\r", "\n"), lambda text: F.regexp_replace(text, "[\t\r\n]", " ")
    )


def remove_blanks(text: ColumnLike, null_token=P.NULL_TOKEN) -> Column:
    """Runs of blanks to one blank."""
    return F.regexp_replace(_head(text, null_token), " {2,}", " ")


def remove_digits(text: ColumnLike, null_token=P.NULL_TOKEN) -> Column:
    """Drop digits, and the mark inside decimals, dates and times."""
    return F.regexp_replace(_head(text, null_token), P.DIGITS, "")


def remove_all_punctuation(text: ColumnLike, null_token=P.NULL_TOKEN) -> Column:
    """Drop the 32 ASCII punctuation marks."""
    return F.regexp_replace(_head(text, null_token), P.PUNCTUATION_RUN, "")


def remove_special_characters(
    text: ColumnLike, remove_digits: bool = False, strict: bool = False, null_token=P.NULL_TOKEN
) -> Column:
    """Keep letters, digits and white space.

    The default keeps the six marks between ``Z`` and ``a`` as well, as the original
    rule does; ``strict=True`` drops them.
    """
    if strict:
        pattern = P.NOT_LETTER_STRICT if remove_digits else P.NOT_LETTER_DIGIT_STRICT
    else:
        pattern = P.NOT_LETTER if remove_digits else P.NOT_LETTER_DIGIT
    return F.regexp_replace(_head(text, null_token), pattern, "")


def ascii_to_string(text: ColumnLike, null_token=P.NULL_TOKEN) -> Column:
    """Drop everything outside ASCII, and question marks with it."""
    return bind(
        _head(text, null_token),
        lambda text: F.when(_not_ascii(text), F.regexp_replace(text, P.NOT_ASCII_OR_QUESTION, ""))
        .otherwise(F.replace(text, F.lit("?"), F.lit(""))),
    )


def to_lower(text: ColumnLike, null_token=P.NULL_TOKEN) -> Column:
    return F.lower(_head(text, null_token))


def remove_url(text: ColumnLike, null_token=P.NULL_TOKEN) -> Column:
    """Drop scheme://host/path; a host without a scheme stays."""
    return _only_where(
        _head(text, null_token), _has("://"), lambda text: F.regexp_replace(text, P.URL_ONCE, "")
    )


def remove_email_address(text: ColumnLike, null_token=P.NULL_TOKEN) -> Column:
    """Drop addresses; the pattern knows lower case only."""
    return _only_where(
        _head(text, null_token), _has("@"), lambda text: F.regexp_replace(text, P.EMAIL_ONCE, "")
    )


def get_email_address(text: ColumnLike, null_token=P.NULL_TOKEN) -> Column:
    """All addresses, in order, as an array."""
    return F.regexp_extract_all(_head(text, null_token), F.lit(P.EMAIL_ONCE), F.lit(1))


def _words_starting_with(text: ColumnLike, mark: str, null_token) -> Column:
    words = F.split(_head(text, null_token), rf"[{P.SPACE}]+")
    return F.filter(words, lambda word: F.startswith(word, F.lit(mark)))


def get_hashtag(text: ColumnLike, null_token=P.NULL_TOKEN) -> Column:
    """Words that start with ``#``, in order, as an array."""
    return _words_starting_with(text, "#", null_token)


def get_mention(text: ColumnLike, null_token=P.NULL_TOKEN) -> Column:
    """Words that start with ``@``, in order, as an array."""
    return _words_starting_with(text, "@", null_token)


def contraction_rules() -> list[tuple[str, str]]:
    """(pattern, replacement) pairs in the order they apply."""
    rules = []
    for short, long in P.CONTRACTION_WORDS:
        body = re.escape(short).replace("'", "['’]")
        rules.append((rf"(?i)(?<![{P.WORD}'’]){body}(?![{P.WORD}])", long))
    for ending, long in P.CONTRACTION_ENDINGS:
        body = ending.replace("'", "['’]")
        rules.append((rf"(?i)(?<=\p{{L}}){body}(?![{P.WORD}])", long))
    return rules


def expand_contractions(text: ColumnLike, null_token=P.NULL_TOKEN) -> Column:
    """``don't`` to ``do not`` and so on; texts without an apostrophe pass untouched."""

    apostrophe = _has("'", "’")

    def expand(word: Column) -> Column:
        expanded = word
        for pattern, replacement in contraction_rules():
            expanded = F.regexp_replace(expanded, pattern, replacement)
        return F.when(apostrophe(word), expanded).otherwise(word)

    # no rule looks across a blank, so only the words that have an apostrophe are searched
    return _only_where(
        _head(text, null_token),
        apostrophe,
        lambda text: F.array_join(F.transform(F.split(text, " "), expand), " "),
    )


def clean_text(text: ColumnLike, null_token=P.NULL_TOKEN) -> Column:
    """The whole cleaning chain for a post, as one expression."""
    column = _head(text, null_token)
    column = remove_url(column, None)
    column = remove_html(column, None)
    column = remove_accented_chars(column, None)
    column = remove_tabs(column, None)
    column = ascii_to_string(column, None)
    column = remove_email_address(column, None)
    column = to_lower(column, None)
    column = expand_contractions(column, None)
    column = remove_all_punctuation(column, None)
    column = remove_tabs(column, None)
    return remove_blanks(column, None)


def clean_text_ie(text: ColumnLike, null_token=P.NULL_TOKEN) -> Column:
    """The short chain used ahead of key phrases."""
    column = _head(text, null_token)
    column = remove_url(column, None)
    column = remove_all_punctuation(column, None)
    column = remove_accented_chars(column, None)
    column = to_lower(column, None)
    return remove_tabs(column, None)


def quick_preprocess(text: ColumnLike, null_token=P.NULL_TOKEN) -> Column:
    """Lower case, full stops and written ``\\n`` to blanks, blanks squeezed."""
    column = F.lower(_head(text, null_token))
    column = F.replace(column, F.lit("."), F.lit(" "))
    column = F.replace(column, F.lit("\\n"), F.lit(" "))
    return F.regexp_replace(column, " +", " ")


def to_reference_string(values: ColumnLike) -> Column:
    """An array as the text ``[a, b]``."""
    column = F.col(values) if isinstance(values, str) else values
    return F.concat(F.lit("["), F.array_join(column, ", "), F.lit("]"))
