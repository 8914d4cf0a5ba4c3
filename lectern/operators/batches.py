"""Embedding batches that come back from a service: parsing, checks against what is there now, import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RESULT = "struct<custom_id:string,error:string,response:struct<status_code:int,body:struct<data:array<struct<embedding:array<double>>>>>>"


def parse_results(lines: DataFrame, line: str = "value") -> DataFrame:
    """(custom_id, embedding, failure, status_code) of result lines; blank lines are left out. ``failure`` is null where there is a vector."""
    rows = lines.where(F.trim(line) != "").select(F.from_json(line, _RESULT).alias("r"), F.get_json_object(line, "$.error").alias("error"))
    vector = F.get(F.col("r.response.body.data"), F.lit(0))["embedding"]
    code = F.col("r.response.status_code")
    failure = F.when(F.col("r.custom_id").isNull(), "no id").when(F.coalesce("error", F.lit("")) != "", F.col("error")).when(F.coalesce(code, F.lit(0)) != 200, F.concat(F.lit("status "), F.coalesce(code.cast("string"), F.lit("none")))).when(vector.isNull(), "no embedding")
    return rows.select(F.col("r.custom_id").alias("custom_id"), F.when(failure.isNull(), vector).alias("embedding"), failure.alias("failure"), code.alias("status_code"))


def stamp(records: DataFrame, marker: str, hash_column: str = "digest") -> DataFrame:
    """Every record marked for rebuilding."""
    return records.withColumn(hash_column, F.lit(marker))


def pending(records: DataFrame, marker: str, parent: str, hash_column: str = "digest") -> DataFrame:
    """The parents that still have a marked record, each once."""
    return records.where(F.col(hash_column) == marker).select(parent).distinct()


def conflicts(current: DataFrame, submitted: DataFrame, key: str) -> DataFrame:
    """(key, state) of submitted records (key, baseline, submitted) whose current hash is neither the one they started from nor the one they bring."""
    both = submitted.join(current.select(key, F.col("digest").alias("_now")), key, "left")
    moved = F.col("_now").isNotNull() & ~F.coalesce((F.col("_now") == F.col("baseline")) | (F.col("_now") == F.col("submitted")), F.lit(False))
    gone = F.col("_now").isNull() & F.col("baseline").isNotNull()
    return both.where(moved | gone).select(key, F.when(gone, "missing").otherwise("changed").alias("state"))


def complete_batches(rows: DataFrame, batch: str, failed: Column) -> DataFrame:
    """The batches in which no row failed: a batch with any failure is skipped whole."""
    return rows.groupBy(batch).agg(F.max(F.coalesce(failed, F.lit(True)).cast("int")).alias("_bad")).where("_bad = 0").select(batch)


def import_batches(rows: DataFrame, batch: str, key: str, failed: Column, order: Column) -> DataFrame:
    """The rows of complete batches, of each key the latest by ``order``."""
    whole = rows.join(complete_batches(rows, batch, failed), batch, "left_semi")
    others = [c for c in whole.columns if c != key]
    return whole.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("x")).select(key, "x.*")


def keep_or_extract(items: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """(key, action) for items (key, signature, digest) against what was indexed: ``keep`` where attachments and content are as
    they were, ``refresh`` where only the content moved, ``extract`` where the attachments did or nothing is there yet."""
    both = items.join(indexed.select(key, F.col("signature").alias("_signature"), F.col("digest").alias("_digest")), key, "left")
    same = F.coalesce("signature", F.lit("")) == F.coalesce("_signature", F.lit(""))
    action = F.when(F.col("_digest").isNull() | ~same, "extract").when(F.col("digest") == F.col("_digest"), "keep").otherwise("refresh")
    return both.select(key, action.alias("action"))
