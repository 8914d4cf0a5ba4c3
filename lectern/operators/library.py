"""Hydration, child joins, listings and reports over library tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def outside_trash(items: DataFrame, deleted: DataFrame, key: str = "item_id") -> DataFrame:
    """Items not in the trash; an anti-join that can shuffle (not NOT IN, which must broadcast)."""
    return items.join(deleted.select(key).distinct(), key, "left_anti")


def in_scope(items: DataFrame, bridge: DataFrame, scope: DataFrame) -> DataFrame:
    """Items that belong to one of the collections of ``scope``; each once."""
    members = bridge.join(scope.select("collection_id").distinct(), "collection_id", "left_semi")
    return items.join(members.select("item_id"), "item_id", "left_semi")


def creator_name(first: Column, last: Column) -> Column:
    """``Last, First``, or the one part there is."""
    f, n = F.trim(F.coalesce(first, F.lit(""))), F.trim(F.coalesce(last, F.lit("")))
    return F.when((f != "") & (n != ""), F.concat_ws(", ", n, f)).otherwise(F.concat(n, f))


def creators_of_items(item_creators: DataFrame, creators: DataFrame) -> DataFrame:
    """(item_id, creators): names in their order, repeated bridge rows once."""
    named = item_creators.select("item_id", "creator_id", "order_index").distinct().join(
        creators.select("creator_id", creator_name(F.col("first_name"), F.col("last_name")).alias("name")), "creator_id"
    )
    ordered = F.array_sort(F.collect_list(F.struct("order_index", "creator_id", "name")))
    return named.groupBy("item_id").agg(ordered.alias("c")).select("item_id", F.col("c.name").alias("creator_names"))


def collections_of_items(bridge: DataFrame, collections: DataFrame) -> DataFrame:
    """(item_id, collection_names) by collection id; repeated and dangling memberships dropped."""
    named = bridge.select("item_id", "collection_id").distinct().join(collections.select("collection_id", "collection_name"), "collection_id")
    return named.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("collection_id", "collection_name"))).alias("c")).select(
        "item_id", F.col("c.collection_name").alias("collection_names")
    )


def hydrate(items: DataFrame, deleted: DataFrame, item_creators: DataFrame, creators: DataFrame, bridge: DataFrame, collections: DataFrame) -> DataFrame:
    """Items outside the trash with their creators and collections; children are aggregated before the join, so nothing fans out."""
    empty = F.array().cast("array<string>")
    live = outside_trash(items, deleted)
    full = live.join(creators_of_items(item_creators, creators), "item_id", "left").join(collections_of_items(bridge, collections), "item_id", "left")
    return full.withColumns({"creator_names": F.coalesce("creator_names", empty), "collection_names": F.coalesce("collection_names", empty)})


def counted(parents: DataFrame, children: DataFrame, key: str, out: str = "n") -> DataFrame:
    """Parents with the number of their children (0 for none): pre-aggregated, then joined."""
    counts = children.groupBy(key).agg(F.count("*").alias(out))
    return parents.join(counts, key, "left").withColumn(out, F.coalesce(out, F.lit(0).cast("bigint")))


def newest(items: DataFrame, by: str, limit: int, tiebreak: str) -> DataFrame:
    return items.orderBy(F.col(by).desc_nulls_last(), F.col(tiebreak).desc()).limit(limit)


def best_child(children: DataFrame, parent: str, order: Sequence[Column]) -> DataFrame:
    """One child per parent, the first in ``order`` (a window group limit, so only one row a task and parent is shuffled)."""
    w = Window.partitionBy(parent).orderBy(*order)
    return children.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def page_of(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 500) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(limit)


def normalize_limit(limit: int | str | None, default: int, most: int) -> int:
    """Nothing, zero and less mean the default; numbers in text count; never above ``most``."""
    try:
        value = int(limit) if limit is not None else 0
    except (TypeError, ValueError):
        value = 0
    return min(value if value > 0 else default, most)


def coverage(items: DataFrame, has: Column, known: Column, group: str | None = None) -> DataFrame:
    """Scanned, with, missing, unknown and the share with, unknowns left out of it."""
    counts = [
        F.count("*").alias("scanned"), F.count_if(known & has).alias("with_it"), F.count_if(known & ~has).alias("missing"), F.count_if(~known).alias("unknown"),
    ]
    out = items.groupBy(group).agg(*counts) if group else items.agg(*counts)
    decided = F.col("with_it") + F.col("missing")
    return out.withColumn("percent", F.when(decided > 0, F.round(100.0 * F.col("with_it") / decided, 2)).otherwise(F.lit(0.0)))


def inventory(df: DataFrame, values: Column, out: str = "tag") -> DataFrame:
    """Distinct values with their number of rows and first letter."""
    tags = df.select(F.explode(values).alias(out)).where(F.trim(out) != "")
    return tags.groupBy(out).agg(F.count("*").alias("n")).withColumn("letter", F.upper(F.substring(out, 1, 1)))


def ordered_lookup(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows in the caller's order (``pos``), unknown keys dropped."""
    return keys.join(rows, key).orderBy("pos")


def first_seen(df: DataFrame, key: Column, pos: str) -> DataFrame:
    """Rows with the position at which their key was first given; ``repeat`` marks the later ones."""
    first = F.min(pos).over(Window.partitionBy(key))
    return df.withColumn("first_pos", first).withColumn("repeat", F.col(pos) != F.col("first_pos"))


# Endings of files that are text.
TEXT_FILES = ("txt", "md", "markdown", "rst", "csv", "tsv", "json", "xml", "vtt", "srt", "sbv", "log", "html", "htm")


def artifact_kind(title: Column, filename: Column) -> Column:
    """``fulltext``, ``ocr-pdf``, ``pdf`` or ``file`` by the words and the ending of a name; null for anything else."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", title, filename)), "[^a-z0-9]+", " ")), F.lit(" "))
    has = lambda w: F.contains(words, F.lit(f" {w} "))
    pdf = F.lower(filename).endswith(".pdf")
    return (
        F.when(~pdf & (has("fulltext") | has("full") & has("text")), "fulltext").when(pdf & has("ocr"), "ocr-pdf").when(pdf, "pdf")
        .when(F.lower(filename).rlike(rf"\.({'|'.join(TEXT_FILES)})$"), "file")
    )
