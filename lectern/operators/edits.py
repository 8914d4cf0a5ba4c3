"""Edits of records as transformations: tags, extra lines, memberships, relations, notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edit_tags(tags: Column, add: Sequence[str] = (), remove: Sequence[str] = ()) -> Column:
    """Listed tags removed, then missing ones appended; order kept. A tag in both lists is present after."""
    kept = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: ~t.isin(*remove)) if remove else F.coalesce(tags, F.array().cast("array<string>"))
    return F.array_distinct(F.concat(kept, F.array(*map(F.lit, add)))) if add else kept


def edit_annotation_tags(tags: Column, add: Sequence[str] = (), remove: Sequence[str] = ()) -> Column:
    """Tags added, then listed ones removed, sorted. A tag in both lists is absent after."""
    every = F.array_distinct(F.concat(F.coalesce(tags, F.array().cast("array<string>")), F.array(*map(F.lit, add)).cast("array<string>")))
    return F.array_sort(F.filter(every, lambda t: ~t.isin(*remove)) if remove else every)


def set_extra(extra: Column, key: str, value: str | None) -> Column:
    """The ``Key: value`` lines with one key set (``None``: removed): its first line is replaced in place, later ones dropped, other lines untouched."""
    lines = F.filter(F.split(F.coalesce(extra, F.lit("")), "\r?\n"), lambda x, i: (x != "") | (i > 0))
    is_key = lambda x: F.lower(F.trim(F.split(x, ":", 2)[0])) == key.strip().lower()
    has = lambda x: F.contains(x, F.lit(":")) & is_key(x)
    if value is None:
        return F.array_join(F.filter(lines, lambda x: ~has(x)), "\n")
    line = f"{key}: {value}"
    first = F.array_position(F.transform(lines, lambda x: has(x)), True)
    edited = F.transform(lines, lambda x, i: F.when(i + 1 == first, F.lit(line)).otherwise(F.when(~has(x), x)))
    kept = F.filter(edited, lambda x: x.isNotNull())
    return F.array_join(F.when(first > 0, kept).otherwise(F.concat(kept, F.array(F.lit(line)))), "\n")


def move_members(bridge: DataFrame, changes: DataFrame, add_to: Sequence[int] = (), remove_from: Sequence[int] = ()) -> DataFrame:
    """The bridge after all additions, then all removals, for the items of ``changes``; each membership once."""
    spark = bridge.sparkSession
    items = changes.select("item_id").distinct()
    base = bridge.select("item_id", "collection_id").distinct()
    if add_to:
        targets = spark.createDataFrame([(c,) for c in add_to], "collection_id bigint")
        base = base.unionByName(items.join(F.broadcast(targets), F.lit(True))).distinct()  # the collections named in the call
    if remove_from:
        gone = items.withColumn("_gone", F.lit(True))
        base = base.join(gone, "item_id", "left").where(~(F.coalesce("_gone", F.lit(False)) & F.col("collection_id").isin(*remove_from))).drop("_gone")
    return base


def add_relations(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges in both directions, self-relations left out, each edge once."""
    back = new.select("predicate", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.unionByName(new.select("predicate", "src", "dst")).unionByName(back).where("src != dst").select("predicate", "src", "dst").distinct()


def remove_relations(edges: DataFrame, gone: DataFrame, both: bool = True) -> DataFrame:
    drop = gone.select("predicate", "src", "dst")
    if both:
        drop = drop.unionByName(gone.select("predicate", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.join(drop.distinct(), ["predicate", "src", "dst"], "left_anti")


def relation_targets(relations: Column) -> Column:
    """(library_type, library_id, key) of the addresses of a relation, repeats dropped."""
    part = lambda x, i: F.regexp_extract(x, r"/(users|groups)/([^/]+)/items/([A-Z0-9]+)/?$", i)
    parsed = F.transform(relations, lambda x: F.struct(part(x, 1).alias("library_type"), part(x, 2).alias("library_id"), part(x, 3).alias("key")))
    return F.array_distinct(F.filter(parsed, lambda x: x["key"] != ""))


def append_note(old: Column, text: Column, append: bool) -> Column:
    return F.when(F.lit(append) & (F.coalesce(old, F.lit("")) != ""), F.concat_ws("\n", old, text)).otherwise(text)
