"""Date and address fields of e-mail, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.binding import bind

ColumnLike = Column | str

# Date shapes met in mail headers once the weekday is gone, with the pattern
# that reads them. A shape is tested first: a failed parse costs far more than a match.
_DAY, _TIME, _ZONE = r"\d{1,2} [A-Z][a-z]{2} \d{4}", r"\d{1,2}:\d{2}:\d{2}", r"[+-]\d{4}"
MAIL_DATE_SHAPES = [
    (rf"^{_DAY} {_TIME} {_ZONE}$", "d MMM yyyy H:mm:ss Z"),
    (rf"^{_DAY} {_TIME} [A-Z]+$", "d MMM yyyy H:mm:ss z"),
    (rf"^{_DAY} {_TIME}$", "d MMM yyyy H:mm:ss"),
    (rf"^{_DAY} \d{{1,2}}:\d{{2}} {_ZONE}$", "d MMM yyyy H:mm Z"),
    (rf"^[A-Z][a-z]{{2}} \d{{1,2}} {_TIME} \d{{4}} [A-Z]+$", "MMM d H:mm:ss yyyy z"),
    (rf"^[A-Z][a-z]{{2}} \d{{1,2}} {_TIME} \d{{4}} {_ZONE}$", "MMM d H:mm:ss yyyy Z"),
    (rf"^[A-Z][a-z]{{2}} \d{{1,2}} {_TIME} \d{{4}}$", "MMM d H:mm:ss yyyy"),
    (rf"^\d{{4}}-\d{{2}}-\d{{2}} {_TIME}[+-]\d{{2}}:\d{{2}}$", "yyyy-MM-dd H:mm:ssXXX"),
    (rf"^\d{{4}}-\d{{2}}-\d{{2}} {_TIME}$", "yyyy-MM-dd H:mm:ss"),
]
STRICT_SHAPE = rf"^[A-Z][a-z]{{2}}, +\d{{1,2}} [A-Z][a-z]{{2}} +\d{{4}} {_TIME} {_ZONE}$"


def _col(column: ColumnLike) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip_gmt_suffix(text: ColumnLike, variant: str = "default") -> Column:
    """Drop the remarks after a mail date.

    ``default``: ``(GMT...)`` goes, ``o'clock GMT...`` becomes ``GMT``;
    ``drop_clock``: both go, the second with its blank; ``india``: only ``(GMT+05:30)``.
    """
    column = _col(text)
    if variant == "india":
        return F.replace(column, F.lit("(GMT+05:30)"), F.lit(""))
    column = F.regexp_replace(column, r"\(GMT.*\)", "")
    if variant == "default":
        return F.regexp_replace(column, r"o'clock GMT.*", "GMT")
    if variant == "drop_clock":
        return F.regexp_replace(column, r" o'clock GMT.*", "")
    raise ValueError(f"unknown variant {variant!r}")


def parse_mail_date(text: ColumnLike, strict: bool = False, errors: str = "coerce") -> Column:
    """Mail date to a UTC timestamp (the session zone must be UTC).

    ``strict`` takes the one shape ``Tue, 15 Feb 2011 16:03:04 +0530`` only. What cannot
    be read is null, or an error with ``errors='raise'``.
    """
    column = _col(text)
    plain = F.regexp_replace(column, r"^\s*(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+", "")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    # a remark in brackets repeats the zone; years of two digits are those from 1950 to 2049
    plain = F.regexp_replace(plain, r" ?\([A-Za-z][^()]*\)$", "")
    for years, century in (("[0-4]", "20"), ("[5-9]", "19")):
        plain = F.regexp_replace(plain, rf"^(\d{{1,2}} [A-Z][a-z]{{2}}) ({years}\d) (?=\d{{1,2}}:)", f"$1 {century}$2 ")
    def read(date: Column) -> Column:
        stamp = F.lit(None).cast("timestamp")
        for shape, pattern in reversed(MAIL_DATE_SHAPES):
            parsed = F.try_to_timestamp(date, F.lit(pattern))
            stamp = F.when(date.rlike(shape), parsed).otherwise(stamp)
        return stamp

    stamp = bind(plain, read)
    if strict:
        stamp = F.when(column.rlike(STRICT_SHAPE), stamp)
    if errors == "coerce":
        return stamp
    if errors == "raise":
        message = F.concat(F.lit("not a mail date: "), column)
        unread = stamp.isNull() & column.isNotNull()
        return F.when(unread, F.raise_error(message).cast("timestamp")).otherwise(stamp)
    raise ValueError(f"unknown errors {errors!r}: use 'coerce' or 'raise'")


def to_india_time(stamp: ColumnLike) -> Column:
    return F.from_utc_timestamp(_col(stamp), "Asia/Kolkata")


def date_part_string(stamp: ColumnLike) -> Column:
    return F.date_format(_col(stamp), "yyyy-MM-dd")


def time_part_string(stamp: ColumnLike) -> Column:
    return F.date_format(_col(stamp), "HH:mm:ss")


def mail_domain(address: ColumnLike) -> Column:
    """What follows the last ``@``; the whole value if there is none."""
    return F.element_at(F.split(_col(address), "@"), -1)
