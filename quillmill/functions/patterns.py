"""Fixed values shared by the column functions, their SQL form and the tests.

The character classes are spelled out instead of using ``\\w``, ``\\d`` and ``\\s``:
Java reads those as ASCII only, while the text rules are Unicode ones.
"""

from __future__ import annotations

import re
import string
import unicodedata
from html.entities import name2codepoint

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
DIGIT = r"\p{Nd}"
# The same white space, spelled out for trimming.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Words of two or more characters, as the usual count vectorisers cut them.
TOKEN = rf"[{WORD}]{{2,}}"
# Words and single marks, for token patterns.
TOKEN_OR_MARK = rf"[{WORD}]+|[^{WORD}{SPACE}]"

# --- fixed values: patterns and marks that decide the cleaned text -----------------
URL = (
    rf"(http|https|ftp|ssh|sftp|www)://([{WORD}-]+(?:(?:\.[{WORD}-]+)+))"
    rf"([{WORD}.,@?^=%&:/~+#-]*[{WORD}@?^=%&/~+#-])?"
)
# The same addresses with runs that are never given back: what may follow the host is optional,
# so no shorter host makes a match, and a host of any number of dots needs no stack frame for each.
# The look ahead turns away most letters before any scheme is tried.
URL_ONCE = (
    rf"(?=[fhsw])(http|https|ftp|ssh|sftp|www)://([{WORD}-]++(?:\.[{WORD}-]++)++)"
    rf"([{WORD}.,@?^=%&:/~+#-]*[{WORD}@?^=%&/~+#-])?"
)
EMAIL = r"([a-z0-9+._-]+@[a-z0-9+._-]+\.[a-z0-9+_-]+)"
# The same addresses, found in one pass: a run of letters is tried from its start only, or
# from where the last address ended.
EMAIL_ONCE = r"(?:\G|(?<![a-z0-9+._-]))([a-z0-9+._-]++@[a-z0-9+._-]+\.[a-z0-9+_-]+)"
DIGITS = rf"{DIGIT}[./:-]{DIGIT}|{DIGIT}"
PUNCTUATION = string.punctuation
PUNCTUATION_RUN = f"[{re.escape(PUNCTUATION)}]+"
NOT_LETTER_DIGIT = rf"[^a-zA-z0-9{SPACE}]"
NOT_LETTER = rf"[^a-zA-z{SPACE}]"
NOT_LETTER_DIGIT_STRICT = rf"[^a-zA-Z0-9{SPACE}]"
NOT_LETTER_STRICT = rf"[^a-zA-Z{SPACE}]"
NOT_ASCII_OR_QUESTION = r"[^\x00-\x7F]|\?"
NULL_TOKEN = "NULL"

# --- HTML ---------------------------------------------------------------------------
# Everything that is no text node turns into one separator character.
TEXT_BREAK = "\x01"
HTML_HIDDEN = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
)
# An opened tag, up to the mark that ends it or a quote that nothing closes. Possessive runs: a
# long tag is read without a stack frame per character.
HTML_OPENED = r"""<[!/?]?[a-zA-Z](?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""
# With a break behind every ``>`` of the page: a tag leaves that break, and what is opened
# but never ended stays as text and is not searched again.
HTML_TAG = rf"{HTML_OPENED}>({TEXT_BREAK})|({HTML_OPENED})"
# A start of hidden text that no end follows is kept from being tried, by a mark that no text holds.
HTML_HELD = "\uffff"
# (start of hidden text, its first character left out; its end) of each kind.
HTML_HIDDEN_KINDS = [("!--", "-->"), (r"script\b", r"</script\s*>"), (r"style\b", r"</style\s*>")]
HTML_HIDDEN_START = "(?i)<(?:" + "|".join(start for start, _ in HTML_HIDDEN_KINDS) + ")"
# A reference at the start of what follows an ampersand: decimal, hexadecimal or named.
HTML_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# The names of the markup standard, with their characters.
HTML_NAMES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}
UNREADABLE = "\ufffd"

# --- accents ------------------------------------------------------------------------
# Letters that have no single base letter (fixed values).
LETTER_SPELLINGS = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th",
    "…": "...", "«": "<<", "»": ">>", "€": "EUR", "©": "(c)", "®": "(r)",
}
# Letters and typographic marks with a single ASCII form (fixed values).
SINGLE_SPELLINGS = {
    "ø": "o", "Ø": "O", "ð": "d", "Ð": "D", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L",
    "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T", "‘": "'", "’": "'", "‚": ",",
    "“": '"', "”": '"', "–": "-", "—": "-", "‐": "-", " ": " ", "·": "*",
}


def accent_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: Latin letters to their base letter.

    Derived from Unicode decomposition; combining marks come last and have no
    counterpart, so ``translate`` drops them.
    """
    source, target = [], []
    latin = [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]
    for code in latin:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            source.append(chr(code))
            target.append(base)
    for letter, plain in SINGLE_SPELLINGS.items():
        source.append(letter)
        target.append(plain)
    marks = [chr(code) for code in range(0x0300, 0x0370)]
    return "".join(source + marks), "".join(target)


ACCENTS_FROM, ACCENTS_TO = accent_table()

# --- contractions -------------------------------------------------------------------
# Whole words first, then endings, in this order (fixed values, public English list).
CONTRACTION_WORDS = [
    ("won't", "will not"), ("can't", "cannot"), ("shan't", "shall not"), ("ain't", "are not"),
    ("let's", "let us"), ("y'all", "you all"), ("o'clock", "of the clock"), ("ma'am", "madam"),
    ("'cause", "because"), ("'tis", "it is"), ("'twas", "it was"),
    ("it's", "it is"), ("he's", "he is"), ("she's", "she is"), ("that's", "that is"),
    ("this's", "this is"), ("there's", "there is"), ("here's", "here is"),
    ("what's", "what is"), ("where's", "where is"), ("when's", "when is"),
    ("who's", "who is"), ("why's", "why is"), ("how's", "how is"), ("one's", "one is"),
    ("everyone's", "everyone is"), ("someone's", "someone is"), ("something's", "something is"),
]
CONTRACTION_ENDINGS = [
    ("'ve", " have"), ("n't", " not"), ("'re", " are"), ("'ll", " will"),
    ("'d", " would"), ("'m", " am"),
]
