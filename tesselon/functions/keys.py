"""Normal forms of keys and times as they land in interaction tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The characters that count as white space around a key (Unicode White_Space and the four ASCII separators).
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Epoch values below this are seconds, others milliseconds.
SECONDS_BELOW = 100_000_000_000


def _plain_ends(col: Column) -> Column:
    """True if the first and the last character are printable ASCII, which most keys' are; a check much cheaper than trimming."""
    return F.left(col, F.lit(1)).between("!", "~") & F.right(col, F.lit(1)).between("!", "~")


def clean_key(col: Column | str) -> Column:
    """Without white space at the ends, in upper case; null stays null and a blank key becomes the empty string."""
    col = F.col(col) if isinstance(col, str) else col
    return F.upper(F.when(_plain_ends(col), col).otherwise(F.btrim(col, F.lit(WHITE_SPACE))))


def not_blank(col: Column | str) -> Column:
    """True if ``clean_key`` isn't the empty string, without making it; null for null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.left(col, F.lit(1)).between("!", "~") | (F.btrim(col, F.lit(WHITE_SPACE)) != "")


def epoch_millis(col: Column | str) -> Column:
    """Milliseconds from a column that holds milliseconds and, below ``SECONDS_BELOW``, seconds."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col < SECONDS_BELOW, col * 1000).otherwise(col)


def utc_month(millis: Column) -> Column:
    """The month in UTC as a number such as 202103, whatever the session's time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(millis / F.lit(86_400_000)).cast("int"))
    return (F.year(day) * 100 + F.month(day)).cast("bigint")


def distinct_names(*names: str) -> None:
    """Raises if a result would have two columns of one name."""
    lowered = [n.lower() for n in names]
    twice = sorted({n for n in lowered if lowered.count(n) > 1})
    if twice:
        raise ValueError(f"column names occur twice in the result: {twice}")
