"""One surviving record per work: field-wise fusion with currency reasoning.

Entries of one DOI are a group. For each field the surviving value is the one
of the usable entry that is latest. Two things are learned from all rows:

*Stand-ins.* A value that only remarks that nothing is there is told by how it
recurs: it stands in entries of several works, and elsewhere in those works stand
longer values that differ from work to work. A true title of several works has
itself, or a beginning of itself, beside it. Common remarks are given besides.

*Currency.* From timestamped entries the operator learns which shapes of a value
tend to follow which (a heading in capitals is later set in ordinary case, mark-up
is later removed, ...) and turns the significantly one-sided transitions into a
precedence. It decides among entries of equal or missing time; with
``undated="placed"`` it also places undated entries among the dated ones: the
partial order of a group has the dated entries in the order of time and an undated
one after each dated one whose shape precedes its own, and the topologically
latest value survives.

Defined results
---------------
* null, blank and unreadable DOIs form no group; neither does a DOI with one entry;
* a field without a usable value in a group yields no row in ``p5_found`` and a
  null in the merged record;
* equal time and equal shape: the smallest ``item_id`` wins;
* repeated rows of one ``item_id`` count as one entry;
* unknown extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.identifiers import doi_key, instant_micros, is_blank
from lectern.session import materialize

FIELDS = ("title", "abstract")

#: The commonest remarks that stand where a value should (folded), for libraries too small to learn them from; the rest are learned.
STAND_INS = ("untitled", "no title", "title", "no abstract", "no abstract available", "abstract", "n/a", "na", "none", "null", "unknown", "not available", "tba", "tbd")
#: How a cut-off value is marked at its end.
CUT_MARK = r"(?is)(\.\.\.+|…|\[\s*(\.\.\.+|…)\s*\]|[\[(]\s*(truncated|cut|continued|more|abridged|gekürzt|tronqué)\s*[\])]|\b(read|show|see) more)[\s.\x{a0}]*$"
SHAPES = ("markup", "capitals", "lower", "spaced", "stopped", "plain")
#: Endings that make a value a file name.
FILE_NAME = r"(?i)^\S*[^\s.]\.(pdf|docx?|odt|rtf|txt|tex|html?|xml|epub|djvu|pptx?|xlsx?|png|jpe?g|tiff?)$"


def folded(value: Column) -> Column:
    """A value without mark-up, case, outer blanks and runs of blanks: how two values are compared."""
    plain = F.regexp_replace(value, r"<[^<>]{1,200}>", "")
    return F.trim(F.lower(F.regexp_replace(plain, r"(?U)[\s\x1c-\x1f\x{200b}\x{feff}]+", " ")))


def core(value: Column) -> Column:
    """The folded value without outer punctuation."""
    return F.regexp_replace(F.regexp_replace(folded(value), r"(?U)^[^\p{L}\p{N}]+", ""), r"(?U)[^\p{L}\p{N}]+$", "")


def is_stand_in(value: Column, given: Sequence[str] = STAND_INS) -> Column:
    """True where a value by itself says that nothing is there, or labels a file."""
    listed = core(value).isin(*given) if given else F.lit(False)
    return (core(value) == "") | listed | folded(value).rlike(FILE_NAME)


def learn_stand_ins(long: DataFrame, least: int = 3, longest: int = 48, share: float = 0.5) -> DataFrame:
    """(field_name, core): short values that stand in for others in at least ``least`` works.

    ``long`` has (group_item_id, field_name, core). Per work only the longest value matters: a rival is one
    that is longer than the value and doesn't begin with it. The value is a stand-in if it has such a rival in
    ``least`` works and in ``share`` of the works it stands in, and the rivals are at least as many different values.
    """
    fullest = long.groupBy("group_item_id", "field_name").agg(F.max_by("core", F.struct(F.length("core"), "core")).alias("rival"))
    short = long.where(F.length("core") <= longest).select("group_item_id", "field_name", "core").distinct()
    both = short.join(fullest, ["group_item_id", "field_name"])
    beaten = (F.length("rival") > F.length("core")) & ~F.startswith("rival", "core")
    # rivals of one value are counted in two steps, so a common remark is no row-sized set
    each = both.groupBy("field_name", "core", F.when(beaten, F.xxhash64("rival")).alias("rival")).agg(F.count("*").alias("works"))
    counts = each.groupBy("field_name", "core").agg(
        F.sum("works").alias("works"), F.coalesce(F.sum(F.when(F.col("rival").isNotNull(), F.col("works"))), F.lit(0)).alias("beaten"), F.count("rival").alias("rivals")
    )
    return counts.where((F.col("rivals") >= least) & (F.col("rivals") >= share * F.col("works"))).select("field_name", "core")


def shape(value: Column) -> Column:
    """The coarse class of a value over which precedence is learned."""
    return (
        F.when(value.rlike(r"<[^<>]{1,200}>"), "markup")
        .when((F.upper(value) == value) & (F.lower(value) != value), "capitals")
        .when((F.lower(value) == value) & (F.upper(value) != value), "lower")
        .when(value.rlike(r"(?U)^\s|\s$|\s{2,}"), "spaced")
        .when(value.rlike(r"(?U)[.!?]\s*$"), "stopped")
        .otherwise("plain")
    )


def entries(items: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """(doi_key, item_id, micros, field_name, value) of the items outside the trash that have a DOI."""
    base = items.select(
        "item_id", doi_key("doi").alias("doi_key"), instant_micros("date_modified").alias("micros"), *FIELDS
    ).where(F.col("doi_key").isNotNull() & F.col("item_id").isNotNull())
    if deleted is not None:
        base = base.join(deleted.select("item_id").distinct(), "item_id", "left_anti")
    return base


def doi_groups(base: DataFrame) -> DataFrame:
    """(doi_key, group_item_id) for the DOIs that two or more items share."""
    return (
        base.groupBy("doi_key")
        .agg(F.min("item_id").alias("group_item_id"), F.max("item_id").alias("_last"))
        .where("_last > group_item_id")
        .drop("_last")
    )


def usable_values(base: DataFrame, groups: DataFrame, given: Sequence[str] = STAND_INS) -> DataFrame:
    """Entries of grouped works whose value may survive, with the value's shape.

    Whether a value is only the beginning of a fuller one is decided over the
    distinct folded values of a group, sorted: a string is a proper prefix of
    some other exactly when it is one of the next in order. The sort is split by
    the first characters, so that a group of any size spreads over many tasks;
    values shorter than that are looked up among the beginnings of the others.
    """
    members = base.join(groups, "doi_key")
    long = members.select(
        "group_item_id", "item_id", "micros",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS])).alias("x"),
    ).select("group_item_id", "item_id", "micros", "x.*")
    long = long.where(~is_blank("value")).where(~is_stand_in(F.col("value"), given)).withColumn("core", core(F.col("value")))
    long = materialize(long)  # only grouped values that aren't a stand-in by themselves; read three times below
    long = long.join(learn_stand_ins(long), ["field_name", "core"], "left_anti").drop("core").withColumn("marked", F.col("value").rlike(CUT_MARK))
    # a value marked as cut can't survive, but what is there of it may be fuller than another
    long = long.withColumn("stem", F.regexp_replace(folded(F.regexp_replace("value", CUT_MARK, "")), r"(?U)[\s.,;:]+$", ""))
    long = long.where("stem != ''")  # nothing but stops
    long = materialize(long.withColumn("stem_id", F.sha2("stem", 256)))  # only grouped, usable values; read four times below
    head = 24
    distinct = long.groupBy("group_item_id", "field_name", "stem_id").agg(F.first("stem").alias("stem"))
    keys = ["group_item_id", "field_name"]
    order = Window.partitionBy(*keys, F.substring("stem", 1, head)).orderBy("stem")
    cut_long = (
        distinct.where(F.length("stem") >= head)
        .withColumn("next", F.lead("stem").over(order))
        .where(F.col("next").startswith(F.col("stem")))
        .select(*keys, "stem_id")
    )
    short = distinct.where(F.length("stem") < head)
    begins = distinct.where(F.length("stem") > 1).select(
        *keys,
        F.explode(F.sequence(F.lit(1), F.least(F.lit(head - 1), F.length("stem") - 1))).alias("n"),
        "stem",
    ).select(*keys, F.expr("substring(stem, 1, n)").alias("stem"))
    begins = begins.join(short.select(*keys, "stem"), [*keys, "stem"], "left_semi")
    cut_short = begins.distinct().select(*keys, F.sha2("stem", 256).alias("stem_id"))
    kept = long.where("not marked").drop("marked").join(cut_long.unionByName(cut_short), [*keys, "stem_id"], "left_anti")
    return kept.withColumn("shape", shape(F.col("value"))).drop("stem", "stem_id")


def learn_precedence(values: DataFrame, least: int = 5) -> DataFrame:
    """(field_name, shape, rank, after): how late a shape stands in the precedence learned from dated rows, and the shapes that come after it.

    In one group a shape precedes another when both its first and its last
    dated occurrence are earlier. A pair of shapes counts as ordered when it is
    seen in at least ``least`` groups and more than two standard errors more
    often one way than the other. Shapes that would precede themselves over
    others (a cycle) are of one level and none of them precedes another; the rank of
    a shape is its topological level. Counts come from every dated row; only the
    at most 60 counts of shape pairs reach the driver.
    """
    seen = values.where("micros is not null").groupBy("group_item_id", "field_name", "shape").agg(
        F.min("micros").alias("lo"), F.max("micros").alias("hi")
    )
    per_group = seen.groupBy("group_item_id", "field_name").agg(F.collect_list(F.struct("shape", "lo", "hi")).alias("s"))
    pairs = (
        per_group.where(F.size("s") > 1)
        .select("field_name", F.explode("s").alias("a"), "s")
        .select("field_name", "a", F.explode("s").alias("b"))
        .where("a.lo < b.lo and a.hi < b.hi and a.shape != b.shape")
        .groupBy("field_name", F.col("a.shape").alias("x"), F.col("b.shape").alias("y"))
        .count()
    )
    counts = {(r["field_name"], r["x"], r["y"]): r["count"] for r in pairs.collect()}
    rows = []
    for f in FIELDS:
        ordered = {(x, y) for (g, x, y), n in counts.items() if g == f and n + (back := counts.get((f, y, x), 0)) >= least and n - back > 2 * (n + back) ** 0.5}
        rows += [(f, shape_, level, after) for shape_, (level, after) in levels(ordered).items()]
    return values.sparkSession.createDataFrame(rows, "field_name string, shape string, rank int, after array<string>")


def levels(ordered: set[tuple[str, str]]) -> dict[str, tuple[int, list[str]]]:
    """(topological level, the shapes that follow) of each shape under a relation; the members of a cycle don't precede each other."""
    follows = {x: {y for a, y in ordered if a == x} for x in SHAPES}
    for _ in SHAPES:
        for x in SHAPES:
            follows[x] |= {z for y in follows[x] for z in follows[y]}
    strict = {x: {y for y in follows[x] if x not in follows[y]} for x in SHAPES}
    level = dict.fromkeys(SHAPES, 0)
    for _ in SHAPES:
        for x in SHAPES:
            for y in strict[x]:
                level[y] = max(level[y], level[x] + 1)
    return {x: (level[x], sorted(strict[x])) for x in SHAPES}


def survivors(items: DataFrame, deleted: DataFrame | None = None, undated: str = "earliest", given: Sequence[str] = STAND_INS) -> DataFrame:
    """(group_item_id, field_name, item_id, value): the surviving value of every field of every work.

    ``undated``: ``earliest`` puts entries without a time before all others; ``placed`` lets the learned precedence place them.
    """
    base = entries(items, deleted)
    return latest_values(usable_values(base, doi_groups(base), given), undated)


def latest_values(values: DataFrame, undated: str = "earliest") -> DataFrame:
    """The topologically latest of the usable values of each field of each work."""
    precedence = learn_precedence(values)
    ranked = values.join(F.broadcast(precedence), ["field_name", "shape"], "left")  # 12 rows
    entry = F.struct("item_id", "value", "shape")
    order = F.struct(F.coalesce("micros", F.lit(-(2**63))).alias("m"), F.coalesce("rank", F.lit(0)).alias("r"), (-F.col("item_id")).alias("i"))
    keys = ["group_item_id", "field_name"]
    if undated == "earliest":
        best = ranked.groupBy(*keys).agg(F.max_by(entry, order).alias("best"))
    else:
        # of each shape the undated entry that would survive, and the latest dated entry
        per = ranked.groupBy(*keys).agg(
            F.max_by(F.when(F.col("micros").isNotNull(), entry), F.when(F.col("micros").isNotNull(), order)).alias("dated"),
            F.array(*[F.min_by(F.when(_loose(x), entry), F.when(_loose(x), F.col("item_id"))) for x in SHAPES]).alias("loose"),
        )
        levels = precedence.groupBy("field_name").agg(
            F.map_from_entries(F.collect_list(F.struct("shape", "after"))).alias("after"), F.map_from_entries(F.collect_list(F.struct("shape", "rank"))).alias("level")
        )
        per = per.join(F.broadcast(levels), "field_name")  # 2 rows
        # an undated entry stands last if the shape of the latest dated one precedes its own; without a dated one any does
        open_ = F.filter("loose", lambda x: x.isNotNull() & (F.col("dated").isNull() | F.array_contains(F.coalesce(F.col("after")[F.col("dated.shape")], F.array().cast("array<string>")), x["shape"])))
        ordered = F.array_sort(F.transform(open_, lambda x: F.struct((-F.col("level")[x["shape"]]).alias("l"), x["item_id"].alias("i"), x.alias("x"))))
        best = per.select(*keys, F.coalesce(F.get(ordered, F.lit(0))["x"], F.col("dated")).alias("best"))
    return best.select(*keys, "best.item_id", "best.value")


def _loose(shape_: str) -> Column:
    return F.col("micros").isNull() & (F.col("shape") == shape_)


def merged_records(items: DataFrame, deleted: DataFrame | None = None, undated: str = "earliest") -> DataFrame:
    """One row per work: the DOI, its entries' count, the best values and the item each came from."""
    base = materialize(entries(items, deleted))  # read three times below
    size = base.groupBy("doi_key").agg(F.countDistinct("item_id").alias("n_entries"))
    groups = doi_groups(base)
    best = latest_values(usable_values(base, groups), undated)
    wide = best.groupBy("group_item_id").agg(
        *[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in FIELDS],
        *[F.max(F.when(F.col("field_name") == f, F.col("item_id"))).alias(f"{f}_item_id") for f in FIELDS],
    )
    return reduce(lambda x, y: x.join(y[0], y[1], "left"), [(size, "doi_key"), (wide, "group_item_id")], groups)
