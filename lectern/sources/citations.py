"""BibTeX, CSL JSON and HTML metadata as sources; BibTeX as a sink."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# BibTeX entry type <-> item type.
ITEM_TYPES = {
    "article": "journalArticle", "book": "book", "booklet": "book", "inbook": "bookSection", "incollection": "bookSection", "suppbook": "bookSection",
    "suppcollection": "bookSection", "inproceedings": "conferencePaper", "conference": "conferencePaper", "proceedings": "book", "phdthesis": "thesis",
    "mastersthesis": "thesis", "thesis": "thesis", "techreport": "report", "report": "report", "manual": "document", "misc": "document",
    "unpublished": "manuscript", "patent": "patent", "online": "webpage", "electronic": "webpage", "webpage": "webpage", "software": "computerProgram",
    "dataset": "document", "artwork": "artwork", "audio": "audioRecording", "video": "videoRecording", "letter": "letter", "standard": "document",
    "periodical": "journalArticle", "collection": "book",
}
# CSL type -> item type.
CSL_TYPES = {
    "article-journal": "journalArticle", "article-magazine": "magazineArticle", "article-newspaper": "newspaperArticle", "article": "preprint",
    "book": "book", "chapter": "bookSection", "paper-conference": "conferencePaper", "thesis": "thesis", "report": "report", "webpage": "webpage",
    "post-weblog": "blogPost", "post": "forumPost", "patent": "patent", "manuscript": "manuscript", "dataset": "dataset",
    "entry-encyclopedia": "encyclopediaArticle", "entry-dictionary": "dictionaryEntry", "speech": "presentation", "interview": "interview",
    "personal_communication": "letter", "broadcast": "radioBroadcast", "motion_picture": "film", "song": "audioRecording", "map": "map",
    "legal_case": "case", "legislation": "statute", "bill": "bill", "software": "computerProgram", "figure": "artwork", "graphic": "artwork",
    "pamphlet": "document", "review": "journalArticle", "review-book": "journalArticle", "treaty": "document", "journal-article": "journalArticle",
    "proceedings-article": "conferencePaper", "book-chapter": "bookSection", "book-part": "bookSection", "book-section": "bookSection",
    "reference-entry": "dictionaryEntry", "monograph": "book", "edited-book": "book", "reference-book": "book", "book-set": "book", "book-series": "book",
    "book-track": "bookSection", "proceedings": "book", "proceedings-series": "book", "report-component": "report", "report-series": "report",
    "dissertation": "thesis", "posted-content": "preprint", "journal-issue": "journalArticle", "journal-volume": "journalArticle",
    "journal": "journalArticle", "database": "dataset", "standard": "standard", "component": "document", "grant": "document",
    "peer-review": "document", "other": "document",
}
_ENTRY = re.compile(r"@\s*(\w+)\s*[{(]\s*([^,\s{}()]*)\s*,", re.IGNORECASE)
_FIELD = re.compile(r"\s*([\w-]+)\s*=\s*")


def _value(text: str, at: int) -> tuple[str, int]:
    """A braced, quoted or bare value and the position behind it; values joined by # are concatenated."""
    parts = []
    while at < len(text):
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            break
        opener, start, depth = text[at], at + 1, 0
        if opener == "{" or opener == '"':
            end = start
            while end < len(text):
                c = text[end]
                if c == "\\":
                    end += 1
                elif opener == '"' and c == '"' and not depth:
                    break
                elif c == "{":
                    depth += 1
                elif c == "}":
                    if not depth and opener == "{":
                        break
                    depth -= 1
                end += 1
            parts.append(text[start:end])
            at = end + 1
        else:
            m = re.compile(r"[^\s,#}]+").match(text, at)
            if not m:
                break
            parts.append(m.group())
            at = m.end()
        m = re.compile(r"\s*#").match(text, at)
        if not m:
            break
        at = m.end()
    return "".join(parts), at


def parse_bibtex(text: str | None) -> list[dict]:
    """Entries of a BibTeX text: type, key and fields (lower-case names, outer braces and white space cleaned)."""
    out = []
    for m in _ENTRY.finditer(text or ""):
        kind = m.group(1).lower()
        if kind in ("comment", "string", "preamble"):
            continue
        fields, at = {}, m.end()
        while (f := _FIELD.match(text, at)) is not None:
            value, at = _value(text, f.end())
            fields[f.group(1).lower()] = re.sub(r"\s+", " ", value.replace("{", "").replace("}", "")).strip() if f.group(1).lower() != "author" else re.sub(r"\s+", " ", value).strip()
            comma = re.compile(r"\s*,").match(text, at)
            if not comma:
                break
            at = comma.end()
        out.append({"entry_type": kind, "cite_key": m.group(2), "fields": fields})
    return out


def split_authors(raw: str | None) -> list[tuple[str, str]]:
    """(first, last) of authors joined by ``and`` outside braces; a braced name is one organisation."""
    names, depth, part = [], 0, ""
    for word in re.split(r"(\s+)", (raw or "").strip()):
        if word.lower() == "and" and not depth:
            names.append(part)
            part = ""
            continue
        depth += word.count("{") - word.count("}")
        part += word
    names.append(part)
    out = []
    for name in (n.strip() for n in names):
        bare = name.replace("{", "").replace("}", "").strip()
        if not bare:
            continue
        if name.startswith("{") and name.endswith("}"):
            out.append(("", bare))
        elif "," in bare:
            last, _, first = bare.partition(",")
            out.append((first.strip(), last.strip()))
        else:
            first, _, last = bare.rpartition(" ")
            out.append((first.strip(), last.strip()))
    return out


ENTRY_DDL = "source_id bigint, entry_type string, item_type string, cite_key string, title string, year string, doi string, container string, creators array<struct<first_name:string,last_name:string>>, extra map<string,string>"


def read_bibtex(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """One row per entry of the BibTeX texts of a table; fields without a column of their own go to ``extra``."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, t in zip(batch["i"], batch["t"], strict=True):
                for e in parse_bibtex(t):
                    f = dict(e["fields"])
                    names = [{"first_name": a, "last_name": b} for a, b in split_authors(f.pop("author", None))]
                    date = f.pop("year", None) or (f.get("date") or "")[:4] or None
                    container = f.pop("journal", None) or f.pop("booktitle", None)
                    rows.append((i, e["entry_type"], ITEM_TYPES.get(e["entry_type"], "document"), e["cite_key"], f.pop("title", None), date, f.pop("doi", None), container, names, f))
            yield pd.DataFrame(rows, columns=["source_id", "entry_type", "item_type", "cite_key", "title", "year", "doi", "container", "creators", "extra"])

    return df.select(F.col(id_column).cast("bigint").alias("i"), F.col(text).alias("t")).mapInPandas(of, ENTRY_DDL)


def bibtex_of(item_type: Column, cite_key: Column, title: Column, creators: Column, year: Column, doi: Column, container: Column | None = None) -> Column:
    """A BibTeX entry as one expression; ``creators`` is an array of ``Last, First``; empty fields are left out."""
    kind = F.lit("misc")
    for k, v in ITEM_TYPES.items():
        if k in ("article", "book", "incollection", "inproceedings", "phdthesis", "techreport", "unpublished", "online"):
            kind = F.when(item_type == v, F.lit(k)).otherwise(kind)
    field = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")))
    body = F.array(field("title", title), field("author", F.array_join(creators, " and ")), field("year", year.cast("string")), field("doi", doi), field("journal", container) if container is not None else F.lit(None))
    return F.concat(F.lit("@"), kind, F.lit("{"), cite_key, F.lit(",\n"), F.array_join(F.filter(body, lambda x: x.isNotNull()), ",\n"), F.lit("\n}"))


def read_csl(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """One row per CSL JSON object (or element of an array) of the texts of a table."""
    many = F.when(F.trim(text).startswith("["), F.col(text)).otherwise(F.concat(F.lit("["), F.col(text), F.lit("]")))
    rows = df.select(F.col(id_column).alias("source_id"), F.explode(F.from_json(many, "array<struct<id:string,type:string,title:string,DOI:string,`container-title`:string,author:array<struct<family:string,given:string,literal:string>>,issued:struct<`date-parts`:array<array<int>>,literal:string,raw:string>>>")).alias("c"))
    kind = F.lit("document")
    for k, v in CSL_TYPES.items():
        kind = F.when(F.col("c.type") == k, F.lit(v)).otherwise(kind)
    parts = F.element_at("c.issued.date-parts", 1)
    date = F.coalesce("c.issued.literal", F.array_join(F.transform(parts, lambda p: F.lpad(p.cast("string"), F.when(p > 31, 4).otherwise(2), F.lit("0"))), "-"), "c.issued.raw")
    names = F.transform("c.author", lambda a: F.coalesce(a["literal"], F.concat_ws(", ", a["family"], a["given"])))
    return rows.select("source_id", F.col("c.id").alias("csl_id"), kind.alias("item_type"), F.col("c.title").alias("title"), F.col("c.DOI").alias("doi"), F.col("c.container-title").alias("container"), names.alias("creators"), date.alias("date"))


class _Meta(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: dict[str, list[str]] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "meta":
            a = dict(attrs)
            name, content = (a.get("name") or a.get("property") or "").strip().lower(), (a.get("content") or "").strip()
            if name and content:
                self.found.setdefault(name, []).append(content)


def meta_tags(html: str | None) -> dict[str, list[str]]:
    """name -> contents of the meta elements of a page."""
    p = _Meta()
    p.feed(html or "")
    return p.found


def embedded_metadata(df: DataFrame, id_column: str, html: str) -> DataFrame:
    """(id, title, authors, date, doi) of pages: Highwire tags first, then Dublin Core, then those of social networks."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, t in zip(batch["i"], batch["t"], strict=True):
                m = meta_tags(t)
                pick = lambda *names: next((m[n][0] for n in names if n in m), None)  # noqa: E731, B023
                authors = list(dict.fromkeys(m.get("citation_author") or m.get("dc.creator") or []))
                doi = re.search(r"10\.\d{4,9}/\S+", pick("citation_doi", "dc.identifier") or "")
                rows.append((i, pick("citation_title", "dc.title", "og:title", "twitter:title"), authors, pick("citation_publication_date", "citation_date", "dc.date"), doi.group().rstrip(".,;)") if doi else None))
            yield pd.DataFrame(rows, columns=["source_id", "title", "authors", "date", "doi"])

    return df.select(F.col(id_column).cast("bigint").alias("i"), F.col(html).alias("t")).mapInPandas(of, "source_id bigint, title string, authors array<string>, date string, doi string")
