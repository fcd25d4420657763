"""Text and mail column functions on the derived posts, pages and mails."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    DATED_SQL, MAILS_SQL, POSTS_SQL, STRIPPED_SQL, UTC_SQL, dealt, mails, posts, query, quoted, table,
)
from quillmill.functions import mail as M
from quillmill.functions import patterns as P
from quillmill.functions import text as X
from quillmill.functions.sqlfunctions import register_functions
from quillmill.functions.tokens import tokenize_words


# The tag pattern without possessive marks, which the other engine does not know.
OPENED_SQL = r"""<[!/?]?[a-zA-Z](?:[^"'>]|"[^"]*"|'[^']*')*"""
TAG_SQL = rf"{OPENED_SQL}>({P.TEXT_BREAK})|({OPENED_SQL})"
NAMES_SQL = "MAP {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in P.HTML_NAMES.items()) + "}"


# --- SQL of each function, for the twins --------------------------------------------
def replace_all(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"


def sql_html(x: str) -> str:
    x = replace_all(x, P.HTML_HIDDEN, P.TEXT_BREAK)
    x = f"replace({x}, '>', {quoted('>' + P.TEXT_BREAK)})"
    x = f"replace({replace_all(x, TAG_SQL, chr(92) + '1' + chr(92) + '2')}, {quoted('>' + P.TEXT_BREAK)}, '>')"
    # each reference, with a mark on either side, becomes a piece of its own
    parts = f"string_split(regexp_replace({x}, '&(#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]*);', '\x02\\1\x03', 'g'), '\x02')"
    name = "split_part(p, '\x03', 1)"
    number = f"case when lower(left({name}, 2)) = '#x' then ('0x' || substr({name}, 3))::bigint else try_cast(substr({name}, 2) as bigint) end"
    unit = f"case when {number} between 1 and 55295 or {number} between 57344 and 1114111 then chr(({number})::int) else '\ufffd' end"
    read = f"case when {name}[1] = '#' then {unit} else coalesce(({NAMES_SQL})[{name}], '&' || {name} || ';') end"
    piece = f"case when contains(p, '\x03') then ({read}) || split_part(p, '\x03', 2) else p end"
    x = f"array_to_string(list_transform({parts}, lambda p: {piece}), '')"
    trimmed = replace_all("node", rf"^[{P.SPACE}]+|[{P.SPACE}]+$")
    nodes = f"list_transform(string_split({x}, {quoted(P.TEXT_BREAK)}), lambda node: {trimmed})"
    return f"array_to_string(list_filter({nodes}, lambda node: node <> ''), ' ')"


def sql_accents(x: str) -> str:
    x = f"translate({x}, {quoted(P.ACCENTS_FROM)}, {quoted(P.ACCENTS_TO)})"
    for letter, spelling in P.LETTER_SPELLINGS.items():
        x = f"replace({x}, {quoted(letter)}, {quoted(spelling)})"
    return x


def sql_tabs(x: str) -> str:
    return f"translate({x}, chr(9) || chr(13) || chr(10), '   ')"


def sql_punctuation(x: str) -> str:
    return f"translate({x}, {quoted(P.PUNCTUATION)}, '')"


def sql_contractions(x: str) -> str:
    for ending, long in P.CONTRACTION_ENDINGS:
        x = replace_all(x, rf"(?i)(\p{{L}}){ending}([^{P.WORD}]|$)", rf"\1{long}\2")
    return x


def sql_words(x: str, mark: str) -> str:
    words = f"regexp_split_to_array({x}, {quoted(f'[{P.SPACE}]+')})"
    return f"list_filter({words}, lambda w: starts_with(w, '{mark}'))"


def sql_clean(x: str) -> str:
    x = sql_html(replace_all(x, P.URL))
    x = replace_all(sql_tabs(sql_accents(x)), P.NOT_ASCII_OR_QUESTION)
    x = sql_contractions(f"lower({replace_all(x, P.EMAIL)})")
    return replace_all(sql_tabs(sql_punctuation(x)), " +", " ")


def sql_clean_ie(x: str) -> str:
    return sql_tabs(f"lower({sql_accents(sql_punctuation(replace_all(x, P.URL)))})")


def sql_quick(x: str) -> str:
    x = f"replace(replace(lower({x}), '.', ' '), {quoted(chr(92) + 'n')}, ' ')"
    return replace_all(x, " +", " ")


TEXT = "coalesce(text, 'NULL')"
SQL_FUNCTIONS = {
    "remove_html": sql_html(TEXT),
    "remove_accented_chars": sql_accents(TEXT),
    "remove_tabs": sql_tabs(TEXT),
    "remove_blanks": replace_all(TEXT, " +", " "),
    "remove_digits": replace_all(TEXT, P.DIGITS),
    "remove_all_punctuation": sql_punctuation(TEXT),
    "remove_special_characters": replace_all(TEXT, P.NOT_LETTER_DIGIT),
    "ascii_to_string": replace_all(TEXT, P.NOT_ASCII_OR_QUESTION),
    "to_lower": f"lower({TEXT})",
    "remove_url": replace_all(TEXT, P.URL),
    "remove_email_address": replace_all(TEXT, P.EMAIL),
    "get_email_address": f"regexp_extract_all({TEXT}, {quoted(P.EMAIL)}, 1)",
    "get_hashtag": sql_words(TEXT, "#"),
    "get_mention": sql_words(TEXT, "@"),
    "expand_contractions": sql_contractions(TEXT),
    "clean_text": sql_clean(TEXT),
    "clean_text_ie": sql_clean_ie(TEXT),
    "quick_preprocess": sql_quick(TEXT),
}
LIST_FUNCTIONS = ("get_email_address", "get_hashtag", "get_mention")


def _register(name: str, expression: str) -> None:
    as_list = name in LIST_FUNCTIONS
    if as_list:
        expression = f"'[' || array_to_string({expression}, ', ') || ']'"

    @query(name, f"with {POSTS_SQL} select id, {expression} as result from posts")
    def plan(spark, sf_dir):
        result = getattr(X, name)("text")
        if as_list:
            result = X.to_reference_string(result)
        return posts(spark, sf_dir).select("id", result.alias("result"))


for _name, _expression in SQL_FUNCTIONS.items():
    _register(_name, _expression)


@query(
    "remove_html_pages",
    f"select page_id, {sql_html('html')} as result, {replace_all('url', P.URL)} as url_left from pages",
)
def remove_html_pages(spark, sf_dir):
    return dealt(table(spark, sf_dir, "pages")).select(
        "page_id", X.remove_html("html").alias("result"), X.remove_url("url").alias("url_left")
    )


@query("batch_text_function", f"select page_id, {sql_html('html')} as result from pages")
def batch_text_function(spark, sf_dir):
    """A text function called by its SQL name over a whole table; no function runs in Python workers any more."""
    register_functions(spark)
    return dealt(table(spark, sf_dir, "pages")).selectExpr("page_id", "remove_html_udf(html) as result")


TOKENS_SQL = f"regexp_extract_all(lower(text), {quoted(P.TOKEN)})"


@query(
    "tokenize_words",
    f"select doc_id, unnest({TOKENS_SQL}) as term, generate_subscripts({TOKENS_SQL}, 1) - 1 as pos from documents",
)
def tokenize(spark, sf_dir):
    docs = dealt(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.posexplode(tokenize_words("text")).alias("pos", "term")).select(
        "doc_id", "term", F.col("pos").cast("bigint").alias("pos")
    )


# --- mail fields --------------------------------------------------------------------
UTC_TEXT = f"strftime({UTC_SQL}, '%Y-%m-%d %H:%M:%S')"


@query("strip_gmt_suffix", f"with {MAILS_SQL} select event_id, {STRIPPED_SQL} as result from mails")
def strip_gmt_suffix(spark, sf_dir):
    return mails(spark, sf_dir).select("event_id", M.strip_gmt_suffix("Date").alias("result"))


def _utc():
    return M.parse_mail_date(M.strip_gmt_suffix("Date"))


@query("parse_mail_date", f"with {MAILS_SQL} select event_id, {UTC_TEXT} as utc from mails")
def parse_mail_date(spark, sf_dir):
    utc = F.date_format(_utc(), "yyyy-MM-dd HH:mm:ss")
    return mails(spark, sf_dir).select("event_id", utc.alias("utc"))


def _dated(name, column, expression):
    @query(name, f"with {MAILS_SQL}, {DATED_SQL} select event_id, {column} as result from dated")
    def plan(spark, sf_dir):
        return mails(spark, sf_dir).select("event_id", expression().alias("result"))


_dated(
    "to_india_time",
    "strftime(datetime_ist, '%Y-%m-%d %H:%M:%S')",
    lambda: F.date_format(M.to_india_time(_utc()), "yyyy-MM-dd HH:mm:ss"),
)
_dated("date_part_string", "only_date", lambda: M.date_part_string(M.to_india_time(_utc())))
_dated("time_part_string", "only_time", lambda: M.time_part_string(M.to_india_time(_utc())))
_dated("mail_domain", "domain", lambda: M.mail_domain("From"))
