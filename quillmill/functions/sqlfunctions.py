"""The text functions under SQL names, as temporary SQL functions.

Their bodies are native expressions, so a query that calls them from SQL gets the same
plan as the column functions, without Python workers. A missing text reads as ``NULL``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillmill.functions import patterns as P
from quillmill.functions.text import contraction_rules
from quillmill.operators.lexicon import IRREGULAR_LEMMAS, KEPT_FORMS, LEMMA_ENDINGS


def literal(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replace_all(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {literal(pattern)}, {literal(by)})"


def _chain(x: str, pairs, call) -> str:
    for old, new in pairs:
        x = call(x, old, new)
    return x


def _plain_replace(x: str, old: str, new: str) -> str:
    return f"replace({x}, {literal(old)}, {literal(new)})"


def _words_with(mark: str) -> str:
    split = f"split(x, {literal(f'[{P.SPACE}]+')})"
    return f"filter({split}, word -> startswith(word, {literal(mark)}))"


def _bound(value: str, name: str, body: str) -> str:
    """``body`` over ``name``, which stands for a value computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _has(x: str, *marks: str) -> str:
    return " or ".join(f"contains({x}, {literal(mark)})" for mark in marks)


def _only_where(needed: str, changed: str, x: str = "x") -> str:
    """``changed`` for texts that need it; a cheap test spares all others the work."""
    return f"case when {needed} then {changed} else {x} end"


def _not_ascii(x: str) -> str:
    return f"length({x}) <> octet_length({x})"


def _each_word(changed: str) -> str:
    return f"array_join(transform(split(x, ' '), word -> {changed}), ' ')"


def _references(x: str) -> str:
    names = "map(" + ", ".join(f"{literal(a)}, {literal(b)}" for a, b in P.HTML_NAMES.items()) + ")"
    known = "decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32')"
    fits = f"code between 1 and {0xD7FF} or code between {0xE000} and {0x10FFFF}"
    number = (
        "cast(case when lower(left(name, 2)) = '#x' then conv(substring(name, 3), 16, 10) "
        "else substring(name, 2) end as bigint)"
    )
    character = _bound(number, "code", f"case when {fits} then {known} else {literal(P.UNREADABLE)} end")
    found = f"case when startswith(name, '#') then {character} else try_element_at({names}, name) end"
    read = f"coalesce(case when name <> '' then concat({found}, substring(piece, length(name) + 2)) end, concat('&', piece))"
    piece = _bound(f"regexp_extract(piece, {literal(P.HTML_REFERENCE)}, 1)", "name", read)
    joined = f"concat(p[0], array_join(transform(slice(p, 2, size(p)), piece -> {piece}), ''))"
    return _bound(f"split({x}, '&', -1)", "p", joined)


def _held(start: str, end: str, x: str) -> str:
    """``x`` with the starts of hidden text that no end follows held back, as ``remove_html`` does."""
    before = f"regexp_extract(page, {literal(rf'(?is)^(.*){end}')}, 1)"
    if end != "-->":
        before = f"regexp_extract({before}, {literal('(?s)^(.*)>')}, 1)"
    rest = f"regexp_replace(substring(page, k + 1), {literal(rf'(?i)<(?={start})')}, {literal(P.HTML_HELD)})"
    hold = _bound(f"length({before})", "k", f"concat(left(page, k), {rest})")
    return _bound(x, "page", f"case when rlike(page, {literal(rf'(?i)<{start}')}) then {hold} else page end")


def _html() -> str:
    page = "whole"
    for start, end in P.HTML_HIDDEN_KINDS:
        page = _held(start, end, page)
    unhidden = _only_where(f"rlike(whole, {literal(P.HTML_HIDDEN_START)})", _replace_all(page, P.HTML_HIDDEN, P.TEXT_BREAK), "whole")
    page = _plain_replace(_bound("x", "whole", unhidden), P.HTML_HELD, "<")
    marked = _replace_all(_plain_replace(page, ">", ">" + P.TEXT_BREAK), P.HTML_TAG, "$1$2")
    cut = _only_where(_has("x", "<"), _plain_replace(marked, ">" + P.TEXT_BREAK, ">"))
    text = _bound(cut, "cut", _only_where(_has("cut", "&"), _references("cut"), "cut"))
    trimmed = f"btrim(node, {literal(P.SPACES)})"
    nodes = f"transform(split({text}, {literal(P.TEXT_BREAK)}), node -> {trimmed})"
    joined = f"array_join(filter({nodes}, node -> node <> ''), ' ')"
    return _only_where(_has("x", "<", "&", P.TEXT_BREAK), joined, f"btrim(x, {literal(P.SPACES)})")


def _contractions() -> str:
    expanded = _chain("word", contraction_rules(), _replace_all)
    word = _only_where(_has("word", "'", "’"), expanded, "word")
    # no rule looks across a blank, so only the words that have an apostrophe are searched
    return _only_where(_has("x", "'", "’"), _each_word(word))


def _lemma() -> str:
    listed = " ".join(f"when {literal(form)} then {literal(lemma)}" for form, lemma in IRREGULAR_LEMMAS.items())
    kept = ", ".join(literal(word) for word in KEPT_FORMS)
    endings = " ".join(
        f"when endswith(word, {literal(ending)}) and length(word) >= {shortest} "
        f"then concat(left(word, length(word) - {len(ending)}), {literal(by)})"
        for ending, by, shortest in LEMMA_ENDINGS
    )
    regular = f"case when word in ({kept}) then word {endings} else word end"
    words = f"filter(split(x, {literal(f'[{P.SPACE}]+')}), word -> word <> '')"
    return f"array_join(transform({words}, word -> case word {listed} else {regular} end), ' ')"


def function_bodies() -> dict[str, tuple[str, str]]:
    """name -> (result type, expression over ``x``)."""
    accents = f"translate(word, {literal(P.ACCENTS_FROM)}, {literal(P.ACCENTS_TO)})"
    plain = _chain(accents, P.LETTER_SPELLINGS.items(), _plain_replace)
    strings = {
        "remove_html_udf": _html(),
        "remove_accented_chars_udf": _only_where(
            _not_ascii("x"), _each_word(_only_where(_not_ascii("word"), plain, "word"))
        ),
        "remove_tabs_udf": _only_where(_has("x", "\t", "\r", "\n"), _replace_all("x", "[\t\r\n]", " ")),
        "remove_blanks_udf": _replace_all("x", " {2,}", " "),
        "remove_digits_udf": _replace_all("x", P.DIGITS),
        "remove_all_punctuation_udf": _replace_all("x", P.PUNCTUATION_RUN),
        "remove_special_characters_udf": _replace_all("x", P.NOT_LETTER_DIGIT),
        "ascii_to_string_udf": _only_where(_not_ascii("x"), _replace_all("x", P.NOT_ASCII_OR_QUESTION), "replace(x, '?', '')"),
        "to_lower_udf": "lower(x)",
        "remove_url_udf": _only_where(_has("x", "://"), _replace_all("x", P.URL_ONCE)),
        "remove_email_address_udf": _only_where(_has("x", "@"), _replace_all("x", P.EMAIL_ONCE)),
        "expand_contractions_udf": _contractions(),
        "get_base_word_udf": _lemma(),
    }
    lists = {
        "get_email_address_udf": f"regexp_extract_all(x, {literal(P.EMAIL_ONCE)}, 1)",
        "get_hashtag_udf": _words_with("#"),
        "get_mention_udf": _words_with("@"),
    }
    return {name: ("string", body) for name, body in strings.items()} | {
        name: ("array<string>", body) for name, body in lists.items()
    }


# The cleaning chain, first step first.
CHAIN = [
    "remove_url_udf", "remove_html_udf", "remove_accented_chars_udf", "remove_tabs_udf", "ascii_to_string_udf",
    "remove_email_address_udf", "to_lower_udf", "expand_contractions_udf", "remove_all_punctuation_udf",
    "remove_tabs_udf", "remove_blanks_udf",
]


def register_functions(spark: SparkSession) -> list[str]:
    """Create all functions in the session; returns their names."""

    def create(name: str, parameter: str, result: str, body: str) -> str:
        spark.sql(
            f"create or replace temporary function {name}(t {parameter}) returns {result} return {body}"
        )
        return name

    names = []
    for name, (result, body) in function_bodies().items():
        # the text is named once, so that the body reads a value and not an expression
        bound = f"element_at(transform(array(coalesce(t, {literal(P.NULL_TOKEN)})), x -> {body}), 1)"
        names.append(create(name, "string", result, bound))
    chained = "t"
    for step in CHAIN:
        chained = f"{step}({chained})"
    names.append(create("clean_text_udf", "string", "string", chained))
    joined = "concat('[', array_join(t, ', '), ']')"
    names.append(create("to_reference_string_udf", "array<string>", "string", joined))
    return names
