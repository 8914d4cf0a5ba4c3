"""Identifier normalisation as Column expressions (JVM side, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind: the Unicode property, the information separators, and invisible fillers.
BLANKS = r"(?U)[\s\x1c-\x1f\x{200b}\x{feff}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only strings (white space of any kind)."""
    c = _col(c)
    return c.isNull() | ~c.rlike(r"(?U)[^\s\x1c-\x1f\x{200b}\x{feff}]")


def doi_key(c: Column | str) -> Column:
    """A comparable DOI, or null where the text holds none.

    Percent escapes and ``&amp;`` are decoded, case is folded, whatever stands
    before ``10.`` (resolver, label, quotes) is dropped, inner white space is
    removed and trailing punctuation is stripped.
    """
    c = _col(c)
    plain = F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)
    plain = F.lower(F.regexp_replace(F.regexp_replace(plain, "(?i)&amp;", "&"), BLANKS, ""))
    found = F.regexp_extract(plain, r"(10\.[0-9]{4,9}(?:\.[0-9]+)*/.+)$", 1)
    bare = F.regexp_replace(found, r"""[.,;:!?'"”’»>\])}<(\[{|/\\]+$""", "")
    # a closing bracket that an opening one inside the suffix asks for stays
    opened = F.length(bare) - F.length(F.regexp_replace(bare, r"\(", ""))
    closed = F.length(bare) - F.length(F.regexp_replace(bare, r"\)", ""))
    bare = F.when((opened == closed + 1) & found.startswith(F.concat(bare, F.lit(")"))), F.concat(bare, F.lit(")"))).otherwise(bare)
    return F.when(bare.rlike(r"^10\.[0-9.]+/."), bare)


def instant_micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a written time; no offset means UTC; null if unreadable."""
    c = F.trim(_col(c))
    zoned = F.when(c.rlike(r"(?i)(z|utc|gmt|[+-][0-9]{2}:?[0-9]{2})$") & c.contains(":"), c).otherwise(F.concat(c, F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))
