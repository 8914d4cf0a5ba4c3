"""Cutting oversized texts at natural boundaries, with exact overlap.

A text longer than its limit (code points, outer white space not counted) is cut
by a recursive hierarchy of separators: sections (pages, wide gaps, breaks before a
heading), paragraphs, sentences, words, characters. Pieces are packed greedily: each takes
as much as the limit allows and ends at the last boundary of the highest level
that leaves it at least half full; only where a level has none there does the next
finer one decide, and only where no level has one a less full piece. Every piece but the first begins ``overlap`` characters before
the end of the one before.

Defined results
---------------
* null, empty and blank texts give no piece; a text within the limit gives one;
* pieces cover the stripped text without a gap; their offsets count from the
  start of the raw text; a piece is never longer than ``max_chars``;
* a cut never separates a base character from a combining mark unless nothing
  else is in reach;
* an overlap of ``max_chars`` or more is reduced to ``max_chars - 1``; a limit
  below one is an error; a field without a limit is not cut;
* of several preparations of one record the latest counts (``prepared_at``, then
  ``batch_id``, then position); repeated rows give the record once.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators from coarse to fine; a cut falls at the end of a match.
LEVELS = tuple(
    re.compile(p)
    for p in (
        # pages, sections, the break before a line that is a heading
        r"\f+\s*|(?:\r?\n[^\S\r\n]*){3,}|(?:\r?\n[^\S\r\n]*){2,}(?=(?:\d+(?:\.\d+)*\.?[^\S\r\n]+)?[^\W\d_a-z][^\r\n.!?]{0,60}\r?\n)",
        r"(?:\r?\n[^\S\r\n]*){2,}",  # paragraphs
        r"[.!?…。！？][\"'”’»)\]]*\s+",  # sentences
        r"\s+",  # words
    )
)
#: Part of the room that a piece must fill before a coarse boundary is preferred to a finer one further on.
FILL = 0.5
SPANS = T.StructType([
    T.StructField("offset", T.IntegerType()),
    T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("ends", T.ArrayType(T.IntegerType())),
])


def split_spans(text: str, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """Piece boundaries [start, end) in ``text``, which is stripped of outer white space first."""
    if max_chars < 1:
        raise ValueError("max_chars must be at least 1")
    overlap = max(0, min(overlap, max_chars - 1))
    first = len(text) - len(text.lstrip())
    last = len(text.rstrip())
    if first >= last:
        return []
    if last - first <= max_chars:
        return [(first, last)]
    cuts: list[list[int] | None] = [None] * len(LEVELS)
    spans, start = [], first
    while last - start > max_chars:
        lo, hi = start + overlap, start + max_chars
        end = 0
        for least in (lo + int((hi - lo) * FILL), lo):
            for k, pattern in enumerate(LEVELS):
                if cuts[k] is None:  # a finer level is scanned only once a coarser one fails
                    cuts[k] = [m.end() for m in pattern.finditer(text, first, last)]
                at = bisect_right(cuts[k], hi) - 1
                if at >= 0 and cuts[k][at] > least:
                    end = cuts[k][at]
                    break
            if end:
                break
        if not end:
            end = hi
            while end > lo + 1 and unicodedata.combining(text[end]):
                end -= 1
            if end <= lo + 1 and unicodedata.combining(text[end]):
                end = hi
        spans.append((start, end))
        start = end - overlap
    spans.append((start, last))
    return spans


@F.pandas_udf(SPANS)
def split_spans_udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, limits, overlaps in batches:
        rows = []
        for text, limit, overlap in zip(texts, limits, overlaps, strict=True):
            spans = split_spans(text, int(limit), int(overlap)) if text is not None else []
            rows.append((spans[0][0] if spans else 0, [s for s, _ in spans], [e for _, e in spans]))
        yield pd.DataFrame(rows, columns=["offset", "starts", "ends"])


def field_limit(limits: DataFrame, field: str) -> tuple[int, int] | None:
    """(max_chars, overlap_chars) of a field; the strictest where it is listed twice, None where it isn't."""
    row = (
        limits.where((F.col("field_name") == field) & F.col("max_chars").isNotNull())
        .agg(F.min("max_chars").alias("m"), F.min(F.coalesce("overlap_chars", F.lit(0))).alias("o"))
        .first()
    )
    return None if row["m"] is None else (row["m"], row["o"])


def oversized_records(items: DataFrame, batches: DataFrame, limits: DataFrame) -> DataFrame:
    """(field_name, record_key, text, max_chars, overlap_chars) of the texts whose raw length exceeds the limit.

    The raw length is checked inside the scan; short texts never leave it.
    """
    parts = []
    if (limit := field_limit(limits, "fulltext")) is not None:
        parts.append(
            items.where(F.length("fulltext") > limit[0])
            .select(F.lit("fulltext").alias("field_name"), F.col("item_key").alias("record_key"), F.col("fulltext").alias("text"),
                    F.lit(limit[0]).alias("max_chars"), F.lit(limit[1]).alias("overlap_chars"))
        )
    if (limit := field_limit(limits, "documents")) is not None:
        entries = batches.select(
            "batch_id", "prepared_at", F.posexplode(F.arrays_zip("ids", "documents")).alias("pos", "entry")
        ).select("batch_id", "prepared_at", "pos", F.col("entry.ids").alias("record_key"), F.col("entry.documents").alias("text"))
        newest = F.struct(F.col("prepared_at").isNotNull(), "prepared_at", F.coalesce("batch_id", F.lit(-1)), "pos")
        latest = (
            entries.where("record_key is not null")
            .groupBy("record_key")
            .agg(F.max_by(F.when(F.length("text") > limit[0], F.col("text")), newest).alias("text"))
            .where("text is not null")
        )
        parts.append(
            latest.select(F.lit("documents").alias("field_name"), "record_key", "text",
                          F.lit(limit[0]).alias("max_chars"), F.lit(limit[1]).alias("overlap_chars"))
        )
    if not parts:
        return items.sparkSession.createDataFrame([], "field_name string, record_key string, text string, max_chars int, overlap_chars int")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def split_records(records: DataFrame) -> DataFrame:
    """The records that fall into two or more pieces, with the boundaries of all pieces."""
    cut = records.withColumn("spans", split_spans_udf("text", "max_chars", "overlap_chars"))
    return cut.where(F.size("spans.starts") > 1)


def pieces(records: DataFrame) -> DataFrame:
    """(field_name, record_key, piece_no, n_pieces, start_char, end_char, piece): the ordered pieces, one row each."""
    spans = F.zip_with("spans.starts", "spans.ends", lambda a, b: F.struct(a.alias("start_char"), b.alias("end_char")))
    rows = split_records(records).select("field_name", "record_key", "text", F.size("spans.starts").alias("n_pieces"), F.posexplode(spans).alias("piece_no", "span"))
    return rows.select(
        "field_name", "record_key", (F.col("piece_no") + 1).alias("piece_no"), "n_pieces", "span.start_char", "span.end_char",
        F.col("text").substr(F.col("span.start_char") + 1, F.col("span.end_char") - F.col("span.start_char")).alias("piece"),
    )
