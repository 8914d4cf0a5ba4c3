"""Maintenance of a passage index: change sets, reuse, upserts, replay, audit.

The index is a table of records (``record_id``, ``parent``, ``text``, metadata).
Every write is a transformation from the old state and a change set to the new one;
each is one shuffle on the record or parent key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_set(source: DataFrame, index: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): insert, delete, update or same, for every key of either side."""
    a = source.select(key, F.col(digest).alias("_new"))
    b = index.select(key, F.col(digest).alias("_old"))
    action = (
        F.when(F.col("_in_b").isNull(), "insert").when(F.col("_in_a").isNull(), "delete").when(F.col("_new").eqNullSafe(F.col("_old")), "same").otherwise("update")
    )
    both = a.withColumn("_in_a", F.lit(1)).join(b.withColumn("_in_b", F.lit(1)), key, "full_outer")
    return both.select(key, action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows not replaced, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def patch(old: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Old rows with the non-null values of ``updates`` in their place; unknown keys change nothing."""
    new = updates.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return old.join(new, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def prune(index: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """Index rows whose parent still exists."""
    return index.join(parents.select(parent).distinct(), parent, "left_semi")


def stale_records(index: DataFrame, expected: DataFrame, parent: str, record: str) -> DataFrame:
    """Records of re-indexed parents that are no longer expected."""
    touched = index.join(expected.select(parent).distinct(), parent, "left_semi")
    return touched.join(expected.select(record).distinct(), record, "left_anti")


def reuse_split(prepared: DataFrame, index: DataFrame, record: str, digest: str) -> DataFrame:
    """Prepared rows with ``reuse``: the vector of the index still fits (equal hash)."""
    old = index.select(record, F.col(digest).alias("_old"))
    return prepared.join(old, record, "left").withColumn("reuse", F.coalesce(F.col("_old") == F.col(digest), F.lit(False))).drop("_old")


def replay_log(log: DataFrame, key: str, seq: Sequence[str], removing: Column, keep: Sequence[str]) -> DataFrame:
    """The live rows after a mutation log: the last operation of each key, unless it removes.

    ``max_by`` combines on the map side, so a hot key costs one row a task.
    """
    order = F.struct(*seq)
    last = log.groupBy(key).agg(F.max_by(F.struct(removing.alias("gone"), *keep), order).alias("x"))
    return last.where("not x.gone").select(key, *[f"x.{c}" for c in keep])


def watermark(expected: DataFrame, present: DataFrame, key: str, version: str) -> DataFrame:
    """(version, missing, may_advance): the watermark advances only if nothing expected is missing."""
    missing = expected.join(present.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("missing"))
    top = expected.agg(F.max(version).alias("version"))
    return top.join(F.broadcast(missing), F.lit(True)).withColumn("may_advance", F.col("missing") == 0)  # one row


def table_difference(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(only_a, only_b, changed, equal) of two states of a table, compared in one full outer join."""
    x = a.select(key, F.struct(*columns).alias("_x"))
    y = b.select(key, F.struct(*columns).alias("_y"))
    both = x.join(y, key, "full_outer")
    return both.agg(
        F.count_if(F.col("_y").isNull()).alias("only_a"), F.count_if(F.col("_x").isNull()).alias("only_b"),
        F.count_if(F.col("_x").isNotNull() & F.col("_y").isNotNull() & (F.col("_x") != F.col("_y"))).alias("changed"),
        F.count_if(F.col("_x") == F.col("_y")).alias("equal"),
    )


def audit(records: DataFrame, items: DataFrame, record: str, parent: str, idx: str, text: str, digest: str) -> DataFrame:
    """(finding, n): what is wrong with an index, one row a check, all checks in a fixed number of passes."""
    per_record = records.groupBy(record).agg(F.count("*").alias("n"))
    flat = records.agg(
        F.count_if(F.trim(F.coalesce(text, F.lit(""))) == "").alias("blank_text"),
        F.count_if(F.col(digest).isNull() | (F.col(digest) != F.sha2(F.coalesce(text, F.lit("")), 256))).alias("wrong_hash"),
    )
    gaps = records.groupBy(parent).agg((F.max(idx) - F.min(idx) + 1 != F.countDistinct(idx)).alias("gap"), (F.min(idx) != 0).alias("no_start"))
    orphans = records.select(parent).distinct().join(items.select(parent).distinct(), parent, "left_anti")
    uncovered = items.select(parent).distinct().join(records.select(parent).distinct(), parent, "left_anti")
    named = [
        per_record.agg(F.count_if(F.col("n") > 1).alias("n")).select(F.lit("duplicate_record").alias("finding"), "n"),
        flat.select(F.explode(F.array(*[F.struct(F.lit(c).alias("finding"), F.col(c).alias("n")) for c in ("blank_text", "wrong_hash")])).alias("x")).select("x.*"),
        gaps.agg(F.count_if("gap").alias("n")).select(F.lit("gap_in_parent").alias("finding"), "n"),
        gaps.agg(F.count_if("no_start").alias("n")).select(F.lit("no_first_record").alias("finding"), "n"),
        orphans.agg(F.count("*").alias("n")).select(F.lit("orphan_parent").alias("finding"), "n"),
        uncovered.agg(F.count("*").alias("n")).select(F.lit("item_without_record").alias("finding"), "n"),
    ]
    return reduce(DataFrame.unionByName, named)


def bounded_batches(records: DataFrame, size: str, most_rows: int, most_bytes: int, order: str, files: int = 64) -> DataFrame:
    """Records with ``batch``: greedy files of at most so many rows and bytes; an oversized row is an error.

    A running sum can't express the greedy reset, so records are dealt by a hash into shares of about
    ``files`` files each, which follow from the volume, and each share is scanned once in order. Files and their
    names depend on the records alone, whatever partitions they come in.
    """
    total = records.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    shares = max(1, -(-max(total["bytes"] // most_bytes, total["rows"] // most_rows) // files))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        share, n, rows, volume = None, 0, 0, 0
        for frame in batches:
            ids = []
            for own, s in zip(frame["_share"], frame[size], strict=True):
                s = 0 if pd.isna(s) else int(s)
                if s > most_bytes:
                    raise ValueError(f"a record of {s} bytes exceeds {most_bytes}")
                if own != share:
                    share, n, rows, volume = own, 0, 0, 0
                if rows and (rows == most_rows or volume + s > most_bytes):
                    n, rows, volume = n + 1, 0, 0
                rows, volume = rows + 1, volume + s
                ids.append(f"{own}-{n}")
            yield frame.drop(columns="_share").assign(batch=ids)

    dealt = records.withColumn("_share", F.pmod(F.xxhash64(order), F.lit(shares)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema) + ", batch string"
    return dealt.repartition(shares, "_share").sortWithinPartitions("_share", order).mapInPandas(of, schema)
