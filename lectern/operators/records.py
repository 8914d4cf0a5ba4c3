"""Records of items, children and annotations: searchable text, index metadata, scopes, children, relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.coercion import clean_list, colour_name
from lectern.functions.schema import CHILD_TYPES
from lectern.functions.text import extra_value


# --- projections -----------------------------------------------------------------------------------------------


def searchable_text(parts: Sequence[tuple[str, Column]], cut: dict[str, int] | None = None) -> Column:
    """``Label: value`` blocks of the parts that are neither null nor empty, a blank line apart; ``cut`` bounds parts by label."""
    def block(name: str, value: Column) -> Column:
        most = (cut or {}).get(name)
        shown = F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("..."))).otherwise(value) if most else value
        return F.when(value != "", F.concat(F.lit(f"{name}: "), shown))

    return F.concat_ws("\n\n", *[block(n, v) for n, v in parts])


def index_metadata(items: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row an item: what the index keeps besides the vector; keys of the item's attachments and their signature included."""
    own = attachment_signatures(attachments)
    blank = lambda c: F.coalesce(c, F.lit(""))
    body = F.trim(F.concat_ws("\n\n", F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("abstract"), F.lit(""))))
    return items.join(own, "item_id", "left").select(
        "item_key", F.col("library_id").cast("string").alias("library_id"), blank(F.col("item_type")).alias("item_type"), blank(F.col("title")).alias("title"),
        blank(F.col("date_added")).alias("date_added"), blank(F.col("date_modified")).alias("date_modified"), blank(F.col("creators")).alias("creators"),
        blank(F.col("doi")).alias("doi"), F.sha2(body, 256).alias("content_hash"),
        F.when(F.coalesce(F.length("fulltext"), F.lit(0)) > 0, True).alias("has_fulltext"),
        F.when(F.coalesce(F.length("fulltext"), F.lit(0)) > 0, F.nullif("fulltext_source", F.lit(""))).alias("fulltext_source"),
        "attachment_keys", "attachment_signature", blank(extra_value(F.col("extra"), "citation key", "citationkey")).alias("citation_key"),
    )


def attachment_signatures(attachments: DataFrame) -> DataFrame:
    """(item_id, attachment_keys, attachment_signature): the keys in order and a hash over the facts of each attachment."""
    facts = F.concat_ws("\x1f", "attachment_key", F.coalesce("title", F.lit("")), F.coalesce("pdf_url", F.lit("")))
    rows = attachments.where("parent_item_id is not null").select(F.col("parent_item_id").alias("item_id"), "attachment_key", facts.alias("facts")).distinct()
    grouped = rows.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("attachment_key", "facts"))).alias("x"))
    return grouped.select(
        "item_id", F.array_join(F.transform("x", lambda v: v["attachment_key"]), ",").alias("attachment_keys"),
        F.sha2(F.array_join(F.transform("x", lambda v: v["facts"]), "\x1e"), 256).alias("attachment_signature"),
    )


def page_index(pdf_page: Column, position: Column) -> Column:
    """The page from 0: of a page number of the file, else of the position's JSON; null if that holds no whole number."""
    raw = F.get_json_object(position, "$.pageIndex")
    return F.when(pdf_page.isNotNull(), F.greatest(pdf_page - 1, F.lit(0))).when(raw.rlike(r"^-?\d+$"), raw.cast("int"))


def annotation_records(annotations: DataFrame, parents: DataFrame) -> DataFrame:
    """One flat record an annotation. ``annotations``: annotation_key, parent_key, type, page_label, pdf_page, position, text,
    comment, color, tags, created; ``parents``: parent_key, parent_title."""
    page = page_index(F.col("pdf_page"), F.col("position"))
    rows = annotations.withColumn("page_index", page).join(parents, "parent_key", "left")
    return rows.select(
        "annotation_key", F.col("parent_key").alias("item_key"), "parent_title", "type",
        F.coalesce(F.nullif("page_label", F.lit("")), (F.col("page_index") + 1).cast("string")).alias("page"), "page_index",
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("comment", F.lit("")).alias("comment"), F.nullif("color", F.lit("")).alias("color"),
        F.nullif(colour_name(F.col("color")), F.lit("")).alias("color_category"), clean_list(F.col("tags")).alias("tags"), "created",
    )


def annotation_text(text: Column, comment: Column, tags: Column) -> Column:
    """What an annotation is searched by: its words, the comment and the tags; empty if there is none."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws(" ", blank(text), blank(comment), F.array_join(clean_list(tags), " "))


def position_json(page: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The position of one box on a page as JSON: pageIndex and rects of two corners."""
    return F.to_json(F.struct(page.cast("int").alias("pageIndex"), F.array(F.array(x, y, x + w, y + h)).alias("rects")))


def short_authors(names: Column, most: int = 3) -> Column:
    """The first authors, and ``et al.`` where there are more."""
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(F.size(names) > most, F.lit(" et al.")).otherwise(F.lit("")))


# --- filters and children -----------------------------------------------------------------------------------------


def is_top_level(item_type: Column, parent: Column) -> Column:
    """Items that stand for themselves: no child type, or an attachment without a parent."""
    return F.coalesce(~item_type.isin(*CHILD_TYPES), F.lit(True)) | ((item_type == "attachment") & parent.isNull())


def children_of(keys: DataFrame, children: DataFrame) -> DataFrame:
    """(pos, item_key, attachments, notes, others): the children of each key by kind, the keys in their order, those without any kept.

    Children are joined to the keys before they are counted, so only those asked for are touched.
    """
    of = lambda kind: F.sum((F.col("kind") == kind).cast("long"))
    hit = keys.join(children, "item_key").groupBy("pos", "item_key").agg(
        of("attachment").alias("attachments"), of("note").alias("notes"), F.count("*").alias("n"), F.min("child_key").alias("first_child"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return keys.join(hit, ["pos", "item_key"], "left").select(
        "pos", "item_key", zero(F.col("attachments")).alias("attachments"), zero(F.col("notes")).alias("notes"),
        zero(F.col("n") - F.col("attachments") - F.col("notes")).alias("others"), "first_child",
    )


# --- libraries ----------------------------------------------------------------------------------------------------


def resolve_libraries(wanted: DataFrame, libraries: DataFrame) -> DataFrame:
    """(library_type, external_id, library_id, state) of external ids; plural type names count; more than one match is refused, as ``ambiguous``."""
    kind = F.regexp_replace(F.lower(F.trim("library_type")), "s$", "")
    asked = wanted.withColumn("_kind", kind)
    own = libraries.select(F.col("library_type").alias("_kind"), "external_id", "library_id")
    hit = asked.join(own, ["_kind", "external_id"], "left").groupBy("library_type", "external_id").agg(F.min("library_id").alias("id"), F.countDistinct("library_id").alias("n"))
    return hit.select("library_type", "external_id", F.when(F.col("n") == 1, F.col("id")).alias("library_id"), F.when(F.col("n") == 0, "unknown").when(F.col("n") > 1, "ambiguous").otherwise("found").alias("state"))


def search_scope(libraries: DataFrame, group_id: int | None = None) -> DataFrame:
    """The libraries a search covers: all but feeds; 0 the personal one; else the group of that id."""
    if group_id is None:
        return libraries.where("library_type != 'feed'")
    return libraries.where(F.col("library_type") == "user") if group_id == 0 else libraries.where((F.col("library_type") == "group") & (F.col("external_id") == group_id))


# --- relations and notices -------------------------------------------------------------------------------------------

_TARGET = r"/(users|groups)/(\d+)/items/([A-Za-z0-9]+)$"


def related_items(relations: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, related_id, related_title): targets of relation addresses (item_id, uri) in the item's own library, each once."""
    parts = relations.select("item_id", F.regexp_extract("uri", _TARGET, 1).alias("kind"), F.regexp_extract("uri", _TARGET, 2).alias("lib"), F.regexp_extract("uri", _TARGET, 3).alias("item_key"))
    parts = parts.where("item_key != ''").dropDuplicates(["item_id", "kind", "lib", "item_key"])
    own = items.select("item_id", F.col("library_id").cast("string").alias("lib"))
    targets = items.select("item_key", F.col("library_id").cast("string").alias("lib"), F.col("item_id").alias("related_id"), F.col("title").alias("related_title"))
    return parts.join(own, ["item_id", "lib"], "left_semi").join(targets, ["item_key", "lib"]).where("item_id != related_id").select("item_id", "related_id", "related_title")


def with_notices(items: DataFrame, notices: DataFrame, key: str) -> DataFrame:
    """Items whose key has notices, with their number; the notices are counted before the join."""
    counted = notices.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_notices"))
    return items.join(counted, key)


def in_order(lists: DataFrame, list_id: str, keys: str, works: DataFrame, key: str) -> DataFrame:
    """(list_id, pos, key, ...): the works of each list of keys in the order of the list; unknown keys are left out."""
    return lists.select(list_id, F.posexplode(keys).alias("pos", key)).join(works, key)


# --- documents of other programs, addresses ------------------------------------------------------------------------------


def structured_text(document: Column) -> Column:
    """The plain text of a structured JSON document whose extraction is ok or complete; null otherwise."""
    state = F.lower(F.coalesce(F.get_json_object(document, "$.status"), F.lit("")))
    return F.when(state.isin("ok", "complete"), F.nullif(F.get_json_object(document, "$.structured.plain_text"), F.lit("")))


def without_page_marks(markdown: Column) -> Column:
    """Recognised text whose page comments are blank lines."""
    return F.trim(F.regexp_replace(F.regexp_replace(markdown, r"(?i)<!--\s*page[^>]*-->", "\n\n"), r"\n{3,}", "\n\n"))


def item_address(library_type: Column, library_id: Column, key: Column, base: str = "https://library.example") -> Column:
    """Where an item is shown: under its group, or under the user's own library."""
    return F.when(library_type == "group", F.concat(F.lit(f"{base}/groups/"), library_id.cast("string"), F.lit("/items/"), key)).otherwise(F.concat(F.lit(f"{base}/items/"), key))


def existing_edges(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(src, dst, exists) for the asked edges, whichever way they stand."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("exists", F.lit(True))
    return asked.join(both, ["src", "dst"], "left").select("src", "dst", F.coalesce("exists", F.lit(False)).alias("exists"))
