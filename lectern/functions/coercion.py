"""Values as people and programs hand them over, brought to one shape: lists, tags, names, addresses, dates, durations."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours of annotations.
COLOURS = {
    "#ffd400": "Yellow", "#ff6666": "Red", "#5fb236": "Green", "#2ea8e5": "Blue", "#a28ae5": "Purple", "#e56eee": "Magenta", "#f19837": "Orange", "#aaaaaa": "Gray",
}
# Names of months, by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def clean_list(values: Column) -> Column:
    """Entries trimmed, blank ones dropped, each once, in order; empty for null."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))


def split_keywords(raw: Column) -> Column:
    """Keywords of one string: at semicolons if it has any, else at commas."""
    return clean_list(F.when(F.contains(raw, F.lit(";")), F.split(raw, ";")).otherwise(F.split(raw, ",")))


def split_name(name: Column) -> Column:
    """struct(first, last): ``Last, First`` as it says; else the last word is the last name."""
    name = F.trim(F.regexp_replace(name, r"\s+", " "))
    comma = F.instr(name, ",")
    tail = F.regexp_extract(name, r"(\S+)$", 1)
    first = F.when(comma > 0, F.trim(F.regexp_extract(name, ",(.*)$", 1))).otherwise(F.trim(F.regexp_replace(name, r"\s*\S+$", "")))
    last = F.when(comma > 0, F.trim(F.regexp_extract(name, "^([^,]*),", 1))).otherwise(tail)
    return F.struct(first.alias("first"), last.alias("last"))


def looks_like_url(value: Column) -> Column:
    """Whether a value can be the address of a page: no white space, scheme http or https or none, a host with a dot or localhost."""
    v = F.trim(value)
    host = F.regexp_extract(v, r"(?i)^(?:https?://)?(?:[^/?#@]*@)?([^/?#:@]+)(?::\d+)?(?:[/?#].*)?$", 1)
    other = v.rlike(r"(?i)^[a-z][a-z0-9+.-]*://") & ~v.rlike("(?i)^https?://")
    return F.coalesce(~v.rlike(r"\s") & ~other & (host.rlike(r"[^.]\.[^.]") | (F.lower(host) == "localhost")), F.lit(False))


def as_iso_date(raw: Column) -> Column:
    """``YYYY[-MM[-DD]]`` of a date as citation formats write it: ISO, slashes, month names before or behind the day; null without a year."""
    raw = F.lower(F.trim(raw))
    year = F.regexp_extract(raw, r"(?:^|[^0-9])([12][0-9]{3})(?:[^0-9]|$)", 1)
    numeric = F.regexp_extract(raw, r"^[12][0-9]{3}[-/.](\d{1,2})(?:[^0-9]|$)", 1)
    name = F.regexp_extract(raw, f"({'|'.join(MONTHS)})", 1)
    named = F.array_position(F.array(*map(F.lit, MONTHS)), name)
    month = F.when(numeric != "", numeric.cast("int")).when(name != "", named.cast("int"))
    day = F.regexp_extract(raw, r"^[12][0-9]{3}[-/.]\d{1,2}[-/.](\d{1,2})(?:[^0-9]|$)", 1)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    ok_month = F.when(month.between(1, 12), month)
    ok_day = F.when(ok_month.isNotNull() & (day != "") & day.cast("int").between(1, 31), day.cast("int"))
    return F.when(year != "", F.concat_ws("-", year, two(ok_month), two(ok_day)))


def colour_name(colour: Column) -> Column:
    """The name of a hex colour, case aside; empty for any other."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])[F.lower(colour)], F.lit(""))


def duration_text(seconds: Column) -> Column:
    """Seconds as ``1h 02m``, ``3m 04s`` or ``5s``; null below zero."""
    s = F.round(seconds).cast("bigint")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), two(F.floor(s % 3600 / 60)), F.lit("m"))
    minutes = F.concat(F.floor(s / 60).cast("string"), F.lit("m "), two(s % 60), F.lit("s"))
    return F.when(s >= 3600, hours).when(s >= 60, minutes).when(s >= 0, F.concat(s.cast("string"), F.lit("s")))


def space_free(text: Column) -> Column:
    """What matching compares where blanks can't be trusted: line breaks mended, no white space, lower case."""
    from lectern.functions.text import normalize_line_breaks

    return F.lower(F.regexp_replace(normalize_line_breaks(text), r"\s+", ""))


def plain_quotes(text: Column) -> Column:
    """White space collapsed, typographic quotation marks as ASCII ones."""
    return F.trim(F.regexp_replace(F.translate(text, "‘’‚‛“”„‟", "''''\"\"\"\""), r"\s+", " "))


def add_citekey(entry: Column, key: Column) -> Column:
    """A BibTeX entry with its citation key filled in where the first line has none; any other entry as it is."""
    filled = F.concat(F.regexp_extract(entry, r"^(\s*@\w+\s*\{)\s*,?[ \t]*\n?", 1), key, F.lit(",\n"), F.regexp_replace(entry, r"^\s*@\w+\s*\{\s*,?[ \t]*\n?", ""))
    empty = entry.rlike(r"^\s*@\w+\s*\{\s*(,|\n|$)")
    return F.when(empty & (F.coalesce(key, F.lit("")) != ""), filled).otherwise(entry)


def as_list(value: object) -> list[str]:
    """A parameter that may be a list, a JSON list, a comma-separated or a single value, as a list of strings."""
    if value is None:
        return []
    if isinstance(value, str):
        text = value.strip()
        if text.startswith("["):
            try:
                return as_list(json.loads(text))
            except json.JSONDecodeError:
                pass
        return [p.strip() for p in text.split(",") if p.strip()]
    if isinstance(value, Iterable) and not isinstance(value, dict):
        return [str(v).strip() for v in value if v is not None and str(v).strip()]
    raise TypeError(f"no list: {value!r}")


def as_tags(value: object) -> list[str]:
    """A tag filter in any of its shapes (a string, a list, tag objects, JSON of these) as a list of tags; commas belong to tags."""
    if value is None:
        return []
    if isinstance(value, str):
        text = value.strip()
        if text[:1] in "[{" and text:
            try:
                return as_tags(json.loads(text))
            except json.JSONDecodeError:
                pass
        return [text] if text else []
    if isinstance(value, dict):
        return as_tags(value.get("tag"))
    if isinstance(value, Iterable):
        return list(dict.fromkeys(t for v in value for t in as_tags(v)))
    raise TypeError(f"no tags: {value!r}")
