"""Text expressions. All stay inside the JVM except :func:`english_terms`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that the reference's trim() and \s recognise.
WHITE_SPACE = (
    "\t\n\u000b\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WHITE_SPACE_CLASS = (
    r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
TOKEN_PATTERN = r"([\p{L}\p{N}]+)"


def trim_all(col: Column) -> Column:
    """Trim every kind of white space; Spark's own default strips U+0020 only."""
    return F.trim(col, F.lit(WHITE_SPACE))


def clean_text(col: Column) -> Column:
    """CRLF to LF, tab to space, runs of spaces to one, three or more LF to two, trim: in this order."""
    text = F.replace(col, F.lit("\r\n"), F.lit("\n"))
    text = F.replace(text, F.lit("\t"), F.lit(" "))
    text = F.regexp_replace(text, " {2,}", " ")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return trim_all(text)


def tokens(col: Column) -> Column:
    """Lower-cased runs of letters and digits, in order of appearance."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), 1)


def or_default(col: Column, default: Column) -> Column:
    """The first value unless it is NULL or empty."""
    return F.coalesce(F.nullif(col, F.lit("")), default)


def section_label(heading: Column, page_title: Column) -> Column:
    return or_default(heading, page_title)


def one_line(col: Column) -> Column:
    """What an embedder sees: newlines become spaces, ends are trimmed."""
    return trim_all(F.replace(col, F.lit("\n"), F.lit(" ")))
