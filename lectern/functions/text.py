"""Text expressions of the search and index operators; Columns in, Columns out, all JVM side unless said."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FOLD_FROM = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿĀāĂăĄąĆćČčĎďĐđĒēĖėĘęĚěĞğĪīĮįİıŁłŃńŇňŌōŐőŘřŚśŞşŠšŤťŪūŮůŰűŹźŻżŽž"
_FOLD_TO = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyyAaAaAaCcCcDdDdEeEeEeEeGgIiIiIiLlNnNnOoOoRrSsSsSsTtUuUuUuZzZzZz"
_DASHES = "‐‑‒–—―−"


def fold(c: Column) -> Column:
    """Case and the usual Latin accents folded, dashes unified: what searches compare.

    Native ``translate``; a text in another script keeps its letters, in lower case.
    """
    plain = F.translate(c, _FOLD_FROM + _DASHES, _FOLD_TO + "-" * len(_DASHES))
    for a, b in (("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.lower(plain)


def _ascii(text: str | None) -> str | None:
    if text is None:
        return None
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).translate(str.maketrans({c: "-" for c in _DASHES} | {"ß": "ss", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "æ": "ae", "Æ": "AE"}))


@F.pandas_udf(T.StringType())
def ascii_fold(texts: pd.Series) -> pd.Series:
    """Accents of any script removed (compatibility decomposition); Arrow batches."""
    return texts.map(_ascii)


def strip_outer(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_tags(c: Column, squeeze: bool = False) -> Column:
    """Mark-up removed; with ``squeeze`` runs of white space become one blank."""
    plain = F.regexp_replace(c, "<[^>]*>", "")
    return collapse(plain) if squeeze else plain


def html_to_text(c: Column) -> Column:
    """Block elements to paragraphs, breaks and list items to lines, other mark-up dropped, blank runs collapsed."""
    blocks = F.regexp_replace(c, r"(?i)</(p|div|h[1-6]|blockquote|ul|ol|table|tr)\s*>", "\n\n")
    lines = F.regexp_replace(blocks, r"(?i)<br\s*/?>|</li\s*>", "\n")
    plain = F.regexp_replace(lines, "<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    plain = F.regexp_replace(plain, r"[ \t]+\n", "\n")
    return strip_outer(F.regexp_replace(plain, r"\n{3,}", "\n\n"))


def first_line(c: Column, most: int = 80) -> Column:
    """The first line that is not blank, cut with an ellipsis; null if there is none."""
    line = F.trim(F.try_element_at(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""), F.lit(1)))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def title_key(c: Column) -> Column:
    """Titles that differ in case, punctuation, spacing or a leading article share this."""
    plain = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}_\s]", "")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    for article in ("a ", "an ", "the "):
        plain = F.when(plain.startswith(article), F.substring(plain, len(article) + 1, (1 << 31) - 1)).otherwise(plain)
    return plain


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def record_hash(*columns: Column) -> Column:
    """A hash over columns in a fixed order; nulls differ from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def publication_year(c: Column) -> Column:
    """The first year 1000-2199 that is not part of a longer number; null if none."""
    year = F.regexp_extract(c, r"(?<![0-9])(1[0-9]{3}|2[01][0-9]{2})(?![0-9])", 1)
    return F.when(year != "", year.cast("int"))


def iso_part(c: Column) -> Column:
    """The ``YYYY-MM-DD`` part of a two-part date (zero month or day allowed), else the text itself."""
    iso = F.regexp_extract(c, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:\s|$)", 1)
    return F.when(iso != "", iso).otherwise(c)


def display_part(c: Column) -> Column:
    """The display part of a two-part date, else the text itself."""
    rest = F.regexp_extract(c, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\s+(.+)$", 1)
    return F.when(rest != "", rest).otherwise(c)


def number_or_null(c: Column) -> Column:
    """A number as a person writes one (grouping underscores allowed), else null: no type suffixes, no blanks inside."""
    s = F.trim(c)
    ok = s.rlike(r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$")
    return F.when(ok, F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))


def isbn13(c: Column) -> Column:
    """A valid ISBN as thirteen digits, else null."""
    s = F.upper(F.regexp_replace(c, r"(?i)isbn(?:-1[03])?:?|[\s-]", ""))
    digits = F.split(s, "")

    def weighted(first: int, size: int, weight) -> Column:
        terms = [F.coalesce(F.get(digits, F.lit(i)).try_cast("int"), F.when(F.get(digits, F.lit(i)) == "X", 10), F.lit(0)) * weight(i) for i in range(first, size)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total

    ten = s.rlike("^[0-9]{9}[0-9X]$") & (weighted(0, 10, lambda i: 10 - i) % 11 == 0)
    thirteen = s.rlike("^97[89][0-9]{10}$") & (weighted(0, 13, lambda i: 1 if i % 2 == 0 else 3) % 10 == 0)
    # 978 + nine digits + check digit; 9 * 1 + 7 * 3 + 8 * 1 = 38
    check = (10 - (F.lit(38) + weighted(0, 9, lambda i: 3 if i % 2 == 0 else 1)) % 10) % 10
    return F.when(thirteen, s).when(ten, F.concat(F.lit("978"), F.substring(s, 1, 9), check.cast("string")))


def arxiv_id(c: Column) -> Column:
    """An arXiv identifier (either scheme, version kept) from an id, label or address, else null."""
    new = F.regexp_extract(c, r"(?i)(?:^|arxiv[:./]|/abs/|/pdf/|\s)([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)(?![0-9])", 1)
    old = F.regexp_extract(c, r"(?i)(?:^|arxiv:|/abs/|/pdf/|\s)([a-z-]+(?:\.[a-z]{2})?/[0-9]{7}(?:v[0-9]+)?)(?![0-9])", 1)
    return F.when(new != "", new).when(old != "", old)


def extra_value(extra: Column, *keys: str) -> Column:
    """The value of the first ``Key: value`` line whose key, case aside, is one of ``keys``; null if none."""
    names = "|".join(re.escape(k) for k in keys)
    v = F.regexp_extract(extra, rf"(?im)^[ \t]*(?:{names})[ \t]*:[ \t]*(.*?)[ \t]*$", 1)
    return F.when(v != "", v)


# Words that mark an organisation.
CORPORATE = (
    "inc", "inc.", "llc", "ltd", "ltd.", "corp", "corp.", "gmbh", "ag ", "plc", "co.", "co ", "s.a.", "s.a", "university", "universität", "universite",
    "universidad", "institute", "institut", "academy", "laboratory", "labs", "consortium", "foundation", "association", "society", "organization",
    "organisation", "committee", "council", "group", "team", "college", "museum", "department", "ministry", "agency", "library", "archive", "observatory", "commission",
)


def corporate(c: Column) -> Column:
    """Whether a name looks like that of an organisation."""
    padded = F.lower(F.concat(F.lit(" "), c, F.lit(" ")))
    return F.coalesce(F.exists(F.array(*map(F.lit, CORPORATE)), lambda m: F.contains(padded, F.concat(F.lit(" "), m))), F.lit(False))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def normalize_line_breaks(c: Column) -> Column:
    """Words broken over lines joined, ligatures, quotes and dashes unified, blanks collapsed."""
    s = F.regexp_replace(c, r"([\p{L}])[-\x{ad}]\r?\n\s*(\p{Ll})", "$1$2")
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return collapse(F.translate(s, "‘’“”" + _DASHES, "''\"\"" + "-" * len(_DASHES)))


def search_variants(query: str) -> list[str]:
    """Spellings under which a query is searched: as it is, without accents, dashes and blanks exchanged, umlauts spelled out."""
    plain = _ascii(query) or ""
    out = {query, plain}
    for s in (query, plain):
        for d in "-" + _DASHES:
            out.add(s.replace(d, " "))
        out.add(s.replace(" ", "-"))
    spelled = query
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss")):
        spelled = spelled.replace(a, b)
    out.add(spelled)
    return sorted(v for v in out if v.strip())
