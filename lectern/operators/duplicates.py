"""Duplicate groups, the record to keep, and merge plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_members(items: DataFrame, keys: dict[str, Column], id_column: str = "item_id") -> DataFrame:
    """(method, key, id): every item under each of its non-empty keys, once."""
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), k.alias("key")) for m, k in keys.items()])
    exploded = items.select(id_column, F.explode(pairs).alias("k")).select("k.method", "k.key", id_column)
    return exploded.where(f"key is not null and key != '' and {id_column} is not null").distinct()


def duplicate_groups(items: DataFrame, keys: dict[str, Column], id_column: str = "item_id") -> DataFrame:
    """(method, key, n, first_id, last_id): keys that two or more items share. The members are rows of ``duplicate_members``:
    a key that a third of all items share is a number here, never one large row."""
    grouped = duplicate_members(items, keys, id_column).groupBy("method", "key").agg(F.count("*").alias("n"), F.min(id_column).alias("first_id"), F.max(id_column).alias("last_id"))
    return grouped.where("n >= 2")


def keepers(items: DataFrame, key: Column, n_children: Column, has_abstract: Column, added: Column, id_column: str = "item_id") -> DataFrame:
    """(key, keeper): most children, then with abstract, then added first, then the least id; groups of one type only."""
    rows = items.select(
        key.alias("key"), F.col(id_column), F.col("item_type"),
        F.struct((-n_children).alias("c"), (-has_abstract.cast("int")).alias("h"), F.coalesce(added, F.lit("9999-99-99")).alias("d"), F.col(id_column).alias("i")).alias("rank"),
    ).where("key is not null and key != ''")
    return (
        rows.groupBy("key")
        .agg(F.min_by(id_column, "rank").alias("keeper"), F.count("*").alias("n"), F.min("item_type").alias("lo"), F.max("item_type").alias("hi"))
        .where("n >= 2 and lo = hi")
        .select("key", "keeper", "n")
    )


def merge_fill(items: DataFrame, group: str, keeper: str, fields: Sequence[str], order: Sequence[Column], id_column: str = "item_id") -> DataFrame:
    """Per group the keeper's fields, empty ones filled with the first value among the others."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])

    def filled(f: str) -> Column:
        value = F.when(F.trim(F.col(f)) != "", F.col(f))
        own = F.max(F.when(F.col(id_column) == F.col(keeper), value))
        other = F.min_by(F.when(F.col(id_column) != F.col(keeper), value), F.when((F.col(id_column) != F.col(keeper)) & value.isNotNull(), rank))
        return F.coalesce(own, other).alias(f)

    return items.groupBy(group, keeper).agg(*[filled(f) for f in fields])


def merged_sets(items: DataFrame, group: str, values: Column, out: str) -> DataFrame:
    """Per group the sorted union of a multi-valued field."""
    return items.groupBy(group).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(values)))).alias(out))


def ordered_tag_union(df: DataFrame, tags: Column, out: str = "tags") -> DataFrame:
    """Tags trimmed, blanks dropped, the first spelling of each kept (case aside), in order."""
    clean = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")
    lowered = F.transform(clean, lambda t: F.lower(t))
    kept = F.filter(F.transform(clean, lambda t, i: F.when(F.array_position(lowered, F.lower(t)) == i + 1, t)), lambda t: t.isNotNull())
    return df.withColumn(out, kept)
