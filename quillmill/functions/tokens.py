"""Tokens and n-grams as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions import patterns as P
from quillmill.functions.arrays import indexes
from quillmill.functions.binding import bind

ColumnLike = Column | str


def _col(column: ColumnLike) -> Column:
    return F.col(column) if isinstance(column, str) else column


def tokenize_words(text: ColumnLike) -> Column:
    """Lower-case words of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(P.TOKEN), F.lit(0))


def tokenize_marks(text: ColumnLike) -> Column:
    """Words and single punctuation marks, case kept."""
    return F.regexp_extract_all(_col(text), F.lit(P.TOKEN_OR_MARK), F.lit(0))


def split_words(text: ColumnLike) -> Column:
    """Words between white space; no empty ones."""
    words = F.split(_col(text), rf"[{P.SPACE}]+")
    return F.filter(words, lambda word: word != "")


def ngrams(tokens: ColumnLike, n: int) -> Column:
    """n neighbouring tokens joined by a blank; empty for shorter texts."""
    if n == 1:
        return _col(tokens)

    def grams(tokens: Column) -> Column:
        starts = F.filter(indexes(tokens), lambda i: i + n <= F.size(tokens))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))

    return bind(_col(tokens), grams)
