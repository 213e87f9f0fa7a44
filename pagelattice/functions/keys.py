"""Column expressions that reduce the many spellings of a reference to one comparable key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A blank in any script; Java's ``\\s`` is ASCII only.
BLANK = r"[\p{Z}\t\n\x0B\f\r\x{85}]"
#: The same, one by one.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
QUOTES = "\"'`“”„‘’‚«»‹›"


def strip_blanks(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    """True for null and for text without a visible character."""
    return c.isNull() | (strip_blanks(c) == "")


def joined_key(c: Column) -> Column:
    """Lower case, with any run of blanks, underscores and hyphens as one hyphen."""
    return F.regexp_replace(F.lower(c), r"[\p{Z}\t\n\x0B\f\r\x{85}_-]+", "-")


def page_key(c: Column) -> Column:
    """Key of a page name: no outer blanks, link brackets, alias, anchor, folders or ``.md``; case and separators unified."""
    c = strip_blanks(c)
    c = F.regexp_replace(c, r"^!?\[+|\]+$", "")
    c = F.substring_index(F.substring_index(c, "|", 1), "#", 1)
    c = F.substring_index(F.substring_index(strip_blanks(c), "/", -1), "\\", -1)
    c = F.regexp_replace(c, r"(?i)\.md$", "")
    return joined_key(strip_blanks(c))


def file_key(c: Column) -> Column:
    """Key of a file name: the last path segment without outer blanks and quotation marks, in lower case."""
    edge = f"(?:{BLANK}|[{QUOTES}])+"
    c = F.regexp_replace(c, f"^{edge}|{edge}$", "")
    c = F.regexp_replace(c, r"(?s)^.*[/\\]", "")
    return F.lower(F.regexp_replace(c, f"^{edge}|{edge}$", ""))


def tag_key(c: Column) -> Column:
    """Key of a tag: no outer blanks or leading ``#``; case and separators unified."""
    c = F.regexp_replace(strip_blanks(c), "^#+", "")
    return joined_key(strip_blanks(c))
