"""Collection trees: closures, paths, name and path resolution; safe on cycles and missing parents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import materialize


def _edges(collections: DataFrame) -> DataFrame:
    return collections.select("collection_id", "parent_collection_id", "collection_name").dropDuplicates(["collection_id"])


def ancestors(collections: DataFrame) -> DataFrame:
    """(collection_id, ancestor_id, distance): every collection with itself and all above it, each once, at any depth.

    By doubling: a round joins what is known up to distance d with itself, so a tree of depth n takes about log2(n)
    rounds, each a join on ids; a cycle adds no new pair and ends like a root. The rows are as many as the closure has.
    """
    own = _edges(collections)
    ids = own.select(F.col("collection_id").alias("x"))
    step = own.select(F.col("collection_id").alias("a"), F.col("parent_collection_id").alias("b")).where("b is not null and a != b")
    step = step.join(ids, step["b"] == ids["x"], "left_semi").select("a", "b", F.lit(1).alias("d"))
    known, size, reach = materialize(step), None, 1
    while True:
        n = known.count()
        if n == size:
            break
        size = n
        # pairs at the frontier of the last round reach on; all shorter ones have been composed already
        x = known.where(F.col("d") >= (reach + 1) // 2)
        longer = x.alias("x").join(known.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b", (F.col("x.d") + F.col("y.d")).alias("d"))
        known = materialize(known.unionByName(longer.where("a != b")).groupBy("a", "b").agg(F.min("d").alias("d")))
        reach *= 2
    self_ = own.select(F.col("collection_id").alias("a"), F.col("collection_id").alias("b"), F.lit(0).alias("d"))
    return self_.unionByName(known).select(F.col("a").alias("collection_id"), F.col("b").alias("ancestor_id"), F.col("d").alias("distance"))


def descendants(collections: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, collection_id, depth): every collection below each root, the root itself at depth 0, each once."""
    wanted = roots.select(F.col("collection_id").alias("ancestor_id")).distinct()
    below = ancestors(collections).join(wanted, "ancestor_id", "left_semi")
    return below.select(F.col("ancestor_id").alias("root_id"), "collection_id", F.col("distance").alias("depth"))


def paths(collections: DataFrame) -> DataFrame:
    """(collection_id, path, n_levels): names from the root down; a missing parent or a cycle ends the path."""
    names = _edges(collections).select(F.col("collection_id").alias("ancestor_id"), "collection_name")
    up = ancestors(collections).join(names, "ancestor_id")
    levels = up.groupBy("collection_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("o"), "collection_name"))).alias("x"))
    return levels.select("collection_id", F.array_join(F.transform("x", lambda v: v["collection_name"]), " / ").alias("path"), F.size("x").alias("n_levels"))


def resolve_specs(collections: DataFrame, specs: Sequence[str]) -> DataFrame:
    """(spec, pos, collection_id, n_matches): keys first, else paths whose last segments match, case aside."""
    spark = collections.sparkSession
    wanted = spark.createDataFrame([(i, s) for i, s in enumerate(specs)], "pos int, spec string")
    keyed = wanted.join(collections.select("collection_key", F.col("collection_id").alias("by_key")), F.col("spec") == F.col("collection_key"), "left")
    segments = paths(collections).select("collection_id", F.split(F.lower("path"), r"\s*/\s*").alias("levels"))
    tail = F.split(F.lower(F.trim("spec")), r"\s*/\s*")
    open_ = keyed.where("by_key is null").withColumn("tail", tail)
    hit = open_.join(segments, F.slice("levels", F.greatest(F.lit(1), F.size("levels") - F.size("tail") + 1), F.size("tail")) == F.col("tail"))
    found = keyed.where("by_key is not null").select("pos", "spec", F.col("by_key").alias("collection_id")).unionByName(hit.select("pos", "spec", "collection_id"))
    counts = found.groupBy("pos", "spec").agg(F.min("collection_id").alias("collection_id"), F.count("*").alias("n_matches"))
    return wanted.join(counts, ["pos", "spec"], "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
