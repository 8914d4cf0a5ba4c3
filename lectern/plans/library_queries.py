"""Hydration, joins, listings, hierarchy, duplicates and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.identifiers import doi_key
from lectern.functions.text import extra_value, title_key
from lectern.operators import duplicates, edits, hierarchy, library
from lectern.plans.registry import query
from lectern.plans.search_queries import _NAMES_SQL
from lectern.sources.tables import table


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


@query(_NAMES_SQL + """
    , cn AS (SELECT item_id, string_agg(name, '; ' ORDER BY order_index, creator_id) AS creator_list FROM named GROUP BY item_id),
    co AS (SELECT item_id, string_agg(collection_name, '; ' ORDER BY collection_id) AS collection_list
           FROM (SELECT DISTINCT item_id, collection_id FROM collection_items) JOIN collections USING (collection_id) GROUP BY item_id)
    SELECT item_id, item_key, title, coalesce(creator_list, '') AS creator_list, coalesce(collection_list, '') AS collection_list
    FROM zotero_items LEFT JOIN cn USING (item_id) LEFT JOIN co USING (item_id) WHERE item_id NOT IN (SELECT item_id FROM deleted_items)
""")
def hydrate_items(spark: SparkSession, d: str) -> DataFrame:
    full = library.hydrate(*_t(spark, d, "zotero_items", "deleted_items", "item_creators", "creators", "collection_items", "collections"))
    return full.select("item_id", "item_key", "title", F.array_join("creator_names", "; ").alias("creator_list"), F.array_join("collection_names", "; ").alias("collection_list"))


@query("SELECT count(*) AS n FROM zotero_items WHERE item_id NOT IN (SELECT item_id FROM deleted_items)")
def item_count(spark: SparkSession, d: str) -> DataFrame:
    return library.outside_trash(*_t(spark, d, "zotero_items", "deleted_items")).agg(F.count("*").alias("n"))


@query("SELECT item_id, item_key, library_id FROM zotero_items z WHERE NOT EXISTS (SELECT 1 FROM deleted_items x WHERE x.item_id = z.item_id)")
def trash_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return library.outside_trash(*_t(spark, d, "zotero_items", "deleted_items")).select("item_id", "item_key", "library_id")


@query("SELECT item_key FROM zotero_items WHERE library_id = 3")
def item_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "zotero_items").where("library_id = 3").select("item_key")


@query("SELECT item_id, item_key, title, doi FROM zotero_items WHERE item_id = 77")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "zotero_items").where("item_id = 77").select("item_id", "item_key", "title", "doi")


@query("SELECT library_id, count(*) AS items, count(fulltext) AS with_fulltext, count(DISTINCT item_type) AS types FROM zotero_items GROUP BY library_id")
def library_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "zotero_items").groupBy("library_id").agg(F.count("*").alias("items"), F.count("fulltext").alias("with_fulltext"), F.countDistinct("item_type").alias("types"))


@query("SELECT collection_id, collection_name, (SELECT count(*) FROM collection_items i WHERE i.collection_id = c.collection_id) AS n FROM collections c")
def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    collections, bridge = _t(spark, d, "collections", "collection_items")
    return library.counted(collections.select("collection_id", "collection_name"), bridge, "collection_id")


@query("SELECT n_nationkey AS library_id, n_name, (SELECT count(*) FROM zotero_items WHERE library_id = n_nationkey) AS n FROM nation")
def library_counts(spark: SparkSession, d: str) -> DataFrame:
    """The number of items of every library; the names of libraries come from a dimension table."""
    nation, items = _t(spark, d, "nation", "zotero_items")
    return library.counted(nation.select(F.col("n_nationkey").alias("library_id"), "n_name"), items.withColumn("library_id", F.col("library_id").cast("int")), "library_id")


@query("""
    SELECT l_orderkey, l_linenumber, o_custkey, c_name FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey
    WHERE l_quantity > 45
""")
def two_hop_parent(spark: SparkSession, d: str) -> DataFrame:
    """Child to its parent to the parent's parent, as annotation, attachment and paper."""
    lines, orders, customer = _t(spark, d, "lineitem", "orders", "customer")
    hop = lines.where("l_quantity > 45").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return hop.select("l_orderkey", "l_linenumber", "o_custkey", "c_name")


@query("SELECT item_id, item_key, date_added FROM zotero_items ORDER BY date_added DESC NULLS LAST, item_id DESC LIMIT 100")
def recent_items(spark: SparkSession, d: str) -> DataFrame:
    return library.newest(table(spark, d, "zotero_items"), "date_added", 100, "item_id").select("item_id", "item_key", "date_added")


@query("""
    WITH p AS (SELECT DISTINCT item_id, creator_id, order_index FROM item_creators),
         c AS (SELECT item_id, count(*) AS n_creators FROM p GROUP BY item_id),
         m AS (SELECT parent_item_id AS item_id, count(*) AS n_pages, count(*) FILTER (WHERE pdf_url != '') AS n_pdf FROM embedded_metadata GROUP BY 1)
    SELECT item_id, coalesce(n_creators, 0) AS n_creators, coalesce(n_pages, 0) AS n_pages, coalesce(n_pdf, 0) > 0 AS has_pdf
    FROM zotero_items LEFT JOIN c USING (item_id) LEFT JOIN m USING (item_id) ORDER BY item_id LIMIT 500 OFFSET 100
""")
def collection_listing(spark: SparkSession, d: str) -> DataFrame:
    """Items with a summary of their children, one page of the listing."""
    items, pages, bridge = _t(spark, d, "zotero_items", "embedded_metadata", "item_creators")
    n = bridge.select("item_id", "creator_id", "order_index").distinct().groupBy("item_id").agg(F.count("*").alias("n_creators"))
    m = pages.groupBy(F.col("parent_item_id").alias("item_id")).agg(F.count("*").alias("n_pages"), F.count_if(F.col("pdf_url") != "").alias("n_pdf"))
    page = library.page_of(items.select("item_id"), [F.col("item_id")], 100, 500)
    joined = page.join(n, "item_id", "left").join(m, "item_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return joined.select("item_id", zero("n_creators").alias("n_creators"), zero("n_pages").alias("n_pages"), (zero("n_pdf") > 0).alias("has_pdf"))


@query("""
    SELECT parent_item_id, attachment_key FROM embedded_metadata
    QUALIFY row_number() OVER (PARTITION BY parent_item_id ORDER BY (pdf_url = '')::INT, (abstract = '')::INT, attachment_key DESC) = 1
""")
def best_attachment(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "embedded_metadata")
    order = [(F.col("pdf_url") == "").cast("int"), (F.col("abstract") == "").cast("int"), F.col("attachment_key").desc()]
    return library.best_child(pages, "parent_item_id", order).select("parent_item_id", "attachment_key")


@query("""
    SELECT library_id, count(*) AS scanned, count(*) FILTER (WHERE fulltext_source IS NOT NULL AND coalesce(length(fulltext), 0) > 0) AS with_it,
           count(*) FILTER (WHERE fulltext_source IS NOT NULL AND coalesce(length(fulltext), 0) = 0) AS missing, count(*) FILTER (WHERE fulltext_source IS NULL) AS unknown,
           CASE WHEN count(*) FILTER (WHERE fulltext_source IS NOT NULL) > 0
                THEN round(100.0::DOUBLE * count(*) FILTER (WHERE fulltext_source IS NOT NULL AND coalesce(length(fulltext), 0) > 0) / count(*) FILTER (WHERE fulltext_source IS NOT NULL), 2) ELSE 0.0 END AS percent
    FROM zotero_items GROUP BY library_id
""")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return library.coverage(table(spark, d, "zotero_items"), F.coalesce(F.length("fulltext"), F.lit(0)) > 0, F.col("fulltext_source").isNotNull(), "library_id")


@query("""
    SELECT tag, count(*) AS n, upper(tag[1]) AS letter FROM (SELECT trim(unnest(string_split(creators, ';'))) AS tag FROM zotero_items) WHERE tag != '' GROUP BY tag
""")
def tag_inventory(spark: SparkSession, d: str) -> DataFrame:
    return library.inventory(table(spark, d, "zotero_items"), F.transform(F.split("creators", ";"), lambda x: F.trim(x)))


@query("""
    SELECT collection_key, row_number() OVER (PARTITION BY collection_key ORDER BY added_at DESC NULLS LAST, doc_id DESC) AS place, doc_id, item_key
    FROM documents WHERE source = 'annotations' AND item_key IS NOT NULL AND trim(text) != ''
""")
def annotation_digest(spark: SparkSession, d: str) -> DataFrame:
    """Annotations that say something, by collection, newest first: a row each, so a collection of any size sorts and spills."""
    notes = table(spark, d, "documents").where("source = 'annotations' and item_key is not null and trim(text) != ''")
    newest = Window.partitionBy("collection_key").orderBy(F.col("added_at").desc_nulls_last(), F.col("doc_id").desc())
    return notes.select("collection_key", F.row_number().over(newest).cast("bigint").alias("place"), "doc_id", "item_key")


# --- hierarchy -------------------------------------------------------------------------------------------------


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT collection_id, parent_collection_id FROM collections),
    t AS (SELECT collection_id AS root_id, collection_id, 0 AS depth, [collection_id] AS seen FROM e
          UNION ALL SELECT t.root_id, e.collection_id, t.depth + 1, list_append(t.seen, e.collection_id) FROM t JOIN e ON e.parent_collection_id = t.collection_id WHERE NOT list_contains(t.seen, e.collection_id))
    SELECT root_id, collection_id, min(depth) AS depth FROM t GROUP BY root_id, collection_id
""")
def collection_closure(spark: SparkSession, d: str) -> DataFrame:
    collections = table(spark, d, "collections")
    return hierarchy.descendants(collections, collections)


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT collection_id, parent_collection_id, collection_name FROM collections),
    u AS (SELECT collection_id, parent_collection_id AS next_id, [collection_name] AS names, [collection_id] AS seen FROM e
          UNION ALL SELECT u.collection_id, e.parent_collection_id, list_prepend(e.collection_name, u.names), list_append(u.seen, e.collection_id) FROM u JOIN e ON e.collection_id = u.next_id WHERE NOT list_contains(u.seen, e.collection_id))
    SELECT collection_id, array_to_string(arg_max(names, len(names)), ' / ') AS path, max(len(names))::INT AS n_levels FROM u GROUP BY collection_id
""")
def collection_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(table(spark, d, "collections"))


@query("""
    WITH RECURSIVE t AS (SELECT collection_id, [collection_id] AS seen FROM collections WHERE collection_id = 4
        UNION ALL SELECT c.collection_id, list_append(t.seen, c.collection_id) FROM t JOIN collections c ON c.parent_collection_id = t.collection_id WHERE NOT list_contains(t.seen, c.collection_id))
    SELECT DISTINCT z.item_id FROM zotero_items z JOIN collection_items i ON i.item_id = z.item_id WHERE i.collection_id IN (SELECT collection_id FROM t)
""")
def collection_scope(spark: SparkSession, d: str) -> DataFrame:
    items, bridge, collections = _t(spark, d, "zotero_items", "collection_items", "collections")
    scope = hierarchy.descendants(collections, collections.where("collection_id = 4"))
    return library.in_scope(items, bridge, scope).select("item_id")


@query("""
    WITH w AS (SELECT * FROM (VALUES (0, 'VGVM3JVA'), (1, 'rural instruments'), (2, 'no such collection')) v(pos, spec))
    SELECT pos, spec, min(collection_id) AS collection_id, count(collection_id) AS n_matches FROM w
    LEFT JOIN (SELECT DISTINCT collection_id, collection_key, collection_name FROM collections) c ON c.collection_key = spec OR lower(collection_name) = spec GROUP BY pos, spec
""")
def collection_specs(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve_specs(table(spark, d, "collections"), ["VGVM3JVA", "rural instruments", "no such collection"])


# --- duplicates and merges ----------------------------------------------------------------------------------------

_TITLE_KEY_SQL = "regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(title, ' ')), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'), ' '), '^a ', ''), '^an ', ''), '^the ', '')"


@query(f"""
    WITH k AS (SELECT item_id, 'title' AS method, {_TITLE_KEY_SQL} AS key FROM zotero_items
               UNION ALL SELECT item_id, 'doi', lower(trim(doi, ' ')) FROM zotero_items)
    SELECT method, key, count(DISTINCT item_id) AS n, min(item_id) AS first_id, max(item_id) AS last_id FROM k WHERE key IS NOT NULL AND key != '' GROUP BY method, key HAVING count(DISTINCT item_id) >= 2
""")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicate_groups(table(spark, d, "zotero_items"), {"title": title_key(F.col("title")), "doi": F.lower(F.trim("doi"))})


@query(f"""
    WITH k AS (SELECT DISTINCT item_id, {_TITLE_KEY_SQL} AS key FROM zotero_items)
    SELECT key, item_id FROM k WHERE key != '' QUALIFY count(*) OVER (PARTITION BY key) >= 2
""")
def duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    """The items of every group of equal titles, a row each."""
    keys = {"title": title_key(F.col("title"))}
    items = table(spark, d, "zotero_items")
    return duplicates.duplicate_members(items, keys).join(duplicates.duplicate_groups(items, keys), ["method", "key"], "left_semi").select("key", "item_id")


@query(f"""
    WITH c AS (SELECT item_id, count(*) AS n FROM item_creators GROUP BY item_id),
         k AS (SELECT z.item_id, item_type, {_TITLE_KEY_SQL} AS key, coalesce(c.n, 0) AS n, coalesce(trim(abstract, ' ') != '', false) AS h, coalesce(date_added, '9999-99-99') AS a FROM zotero_items z LEFT JOIN c USING (item_id))
    SELECT key, arg_min(item_id, row(-n, -(h::INT), a, item_id)) AS keeper, count(*) AS n FROM k WHERE key IS NOT NULL AND key != '' GROUP BY key HAVING count(*) >= 2 AND min(item_type) = max(item_type)
""")
def duplicate_keepers(spark: SparkSession, d: str) -> DataFrame:
    items, bridge = _t(spark, d, "zotero_items", "item_creators")
    counted = library.counted(items, bridge, "item_id", "n_children")
    return duplicates.keepers(counted, title_key(F.col("title")), F.col("n_children"), F.coalesce(F.trim("abstract") != "", F.lit(False)), F.col("date_added"))


_DOI_SQL = "lower(trim(doi, ' '))"


@query(f"""
    WITH g AS (SELECT {_DOI_SQL} AS k, min(item_id) AS keeper FROM zotero_items WHERE coalesce({_DOI_SQL}, '') != '' GROUP BY 1 HAVING count(*) > 1),
         m AS (SELECT g.k, keeper, item_id, nullif(trim(extra, ' '), '') AS x0, nullif(trim(notes, ' '), '') AS n0, extra, notes FROM zotero_items JOIN g ON {_DOI_SQL} = g.k)
    SELECT k, keeper,
           coalesce(max(extra) FILTER (WHERE item_id = keeper AND x0 IS NOT NULL), arg_min(extra, item_id) FILTER (WHERE item_id != keeper AND x0 IS NOT NULL)) AS extra,
           coalesce(max(notes) FILTER (WHERE item_id = keeper AND n0 IS NOT NULL), arg_min(notes, item_id) FILTER (WHERE item_id != keeper AND n0 IS NOT NULL)) AS notes
    FROM m GROUP BY k, keeper
""")
def merge_fill(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "zotero_items").withColumn("k", F.lower(F.trim("doi"))).where("k != ''")
    groups = items.groupBy("k").agg(F.min("item_id").alias("keeper"), F.count("*").alias("c")).where("c > 1").drop("c")
    return duplicates.merge_fill(items.join(groups, "k"), "k", "keeper", ["extra", "notes"], [F.col("item_id")])


@query(f"""
    WITH g AS (SELECT {_DOI_SQL} AS k FROM zotero_items WHERE coalesce({_DOI_SQL}, '') != '' GROUP BY 1 HAVING count(*) > 1),
         m AS (SELECT DISTINCT g.k, collection_id FROM zotero_items z JOIN g ON {_DOI_SQL} = g.k JOIN collection_items i ON i.item_id = z.item_id)
    SELECT k, string_agg(collection_id::VARCHAR, ',' ORDER BY collection_id) AS collections FROM m GROUP BY k
""")
def merge_collections(spark: SparkSession, d: str) -> DataFrame:
    items, bridge = _t(spark, d, "zotero_items", "collection_items")
    keyed = items.select("item_id", F.lower(F.trim("doi")).alias("k")).where("k != ''")
    shared = keyed.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    sets = keyed.join(shared, "k", "left_semi").join(bridge.select("item_id", "collection_id").distinct(), "item_id").select("k", F.array("collection_id").alias("c"))
    return duplicates.merged_sets(sets, "k", F.col("c"), "s").select("k", F.array_join("s", ",").alias("collections"))


@query("""
    SELECT a.item_id, b.item_id AS library_item_id FROM
      (SELECT parent_item_id AS item_id, lower(doi) AS k FROM embedded_metadata WHERE doi != '') a
      JOIN (SELECT item_id, nullif(regexp_extract(lower(regexp_replace(replace(doi, '%2F', '/'), '\\s', '', 'g')), '(10\\.[0-9]{4,9}/.*?)[.,;:]*$', 1), '') AS k FROM zotero_items) b USING (k)
""")
def existing_by_doi(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose DOI is in the library already, however either writes it."""
    pages, items = _t(spark, d, "embedded_metadata", "zotero_items")
    a = pages.select(F.col("parent_item_id").alias("item_id"), doi_key("doi").alias("k")).where("k is not null")
    b = items.select(F.col("item_id").alias("library_item_id"), doi_key("doi").alias("k")).where("k is not null")
    return a.join(b, "k").select("item_id", "library_item_id")


@query("""
    SELECT item_id, m.attachment_key IS NOT NULL AS enriched, m.publisher FROM zotero_items LEFT JOIN
      (SELECT parent_item_id AS item_id, min(attachment_key) AS attachment_key, arg_min(publisher, attachment_key) AS publisher FROM embedded_metadata GROUP BY 1) m USING (item_id)
""")
def enrich_left(spark: SparkSession, d: str) -> DataFrame:
    items, pages = _t(spark, d, "zotero_items", "embedded_metadata")
    first = pages.groupBy(F.col("parent_item_id").alias("item_id")).agg(F.min("attachment_key").alias("a"), F.min_by("publisher", "attachment_key").alias("publisher"))
    return items.select("item_id").join(first, "item_id", "left").select("item_id", F.col("a").isNotNull().alias("enriched"), "publisher")


@query("""
    WITH w AS (SELECT * FROM (VALUES (0, 40), (1, 7), (2, 999999999), (3, 12)) v(pos, item_id)) SELECT pos, item_id, item_key FROM w JOIN zotero_items USING (item_id)
""")
def ordered_lookup(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.createDataFrame([(0, 40), (1, 7), (2, 999999999), (3, 12)], "pos int, item_id bigint")
    return library.ordered_lookup(keys, table(spark, d, "zotero_items"), "item_id").select("pos", "item_id", "item_key")


@query("SELECT item_id, collection_id, n > 1 AS repeated, n FROM (SELECT item_id, collection_id, count(*) AS n FROM collection_items GROUP BY ALL)")
def repeated_memberships(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "collection_items").groupBy("item_id", "collection_id").agg(F.count("*").alias("n"))
    return rows.select("item_id", "collection_id", (F.col("n") > 1).alias("repeated"), "n")


@query("SELECT item_id, order_index, creator_id, creator_id IN (SELECT creator_id FROM creators) AS known, min(order_index) OVER (PARTITION BY item_id, creator_id) AS first_pos, order_index != min(order_index) OVER (PARTITION BY item_id, creator_id) AS repeat FROM item_creators")
def repeated_input(spark: SparkSession, d: str) -> DataFrame:
    bridge, creators = _t(spark, d, "item_creators", "creators")
    known = bridge.join(creators.select("creator_id").distinct().withColumn("known", F.lit(True)), "creator_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    w = library.first_seen(known, F.struct("item_id", "creator_id"), "order_index")
    return w.select("item_id", "order_index", "creator_id", "known", "first_pos", "repeat")


# --- edits -----------------------------------------------------------------------------------------------------


@query("""
    SELECT item_id, array_to_string(list_concat(list_filter(t, lambda x: x != 'Rural'), CASE WHEN list_contains(t, 'checked') THEN [] ELSE ['checked'] END), ' ') AS tags
    FROM (SELECT item_id, list(tag ORDER BY p) AS t FROM (
            SELECT item_id, split_part(collection_name, ' ', 1) AS tag, min(collection_id) AS p
            FROM (SELECT DISTINCT item_id, collection_id FROM collection_items) JOIN collections USING (collection_id) GROUP BY 1, 2) GROUP BY item_id)
""")
def batch_tag_update(spark: SparkSession, d: str) -> DataFrame:
    names = library.collections_of_items(*_t(spark, d, "collection_items", "collections"))
    tags = F.array_distinct(F.transform("collection_names", lambda n: F.split(n, " ")[0]))
    return names.select("item_id", F.array_join(edits.edit_tags(tags, add=["checked"], remove=["Rural"]), " ").alias("tags"))


@query("""
    SELECT item_id, CASE WHEN contains(extra, 'Shelf: ') THEN regexp_replace(extra, '(?m)^Shelf: .*$', 'Shelf: Z1')
                         WHEN coalesce(extra, '') = '' THEN 'Shelf: Z1' ELSE extra || chr(10) || 'Shelf: Z1' END AS extra FROM zotero_items
""")
def extra_edit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "zotero_items").select("item_id", edits.set_extra(F.col("extra"), "Shelf", "Z1").alias("extra"))


@query("SELECT item_id, trim(regexp_extract(extra, '(?m)^Shelf: *(.*)$', 1)) AS shelf, trim(regexp_extract(extra, '(?m)^PMCID: *(.*)$', 1)) AS pmcid FROM zotero_items WHERE contains(extra, 'Shelf:') AND contains(extra, 'PMCID:')")
def extra_values(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "zotero_items").where(F.contains("extra", F.lit("Shelf:")) & F.contains("extra", F.lit("PMCID:")))
    return items.select("item_id", extra_value(F.col("extra"), "shelf").alias("shelf"), extra_value(F.col("extra"), "pmcid").alias("pmcid"))


@query("""
    SELECT item_id, collection_id FROM (
      SELECT DISTINCT item_id, collection_id FROM collection_items
      UNION SELECT item_id, 5 FROM zotero_items WHERE library_id = 3) WHERE NOT (collection_id = 7 AND item_id IN (SELECT item_id FROM zotero_items WHERE library_id = 3))
""")
def collection_membership(spark: SparkSession, d: str) -> DataFrame:
    bridge, items = _t(spark, d, "collection_items", "zotero_items")
    return edits.move_members(bridge, items.where("library_id = 3"), add_to=[5], remove_from=[7])


@query("""
    SELECT collection_id FROM collections WHERE collection_id NOT IN (
      WITH RECURSIVE t AS (SELECT collection_id, [collection_id] AS seen FROM collections WHERE collection_id = 4
        UNION ALL SELECT c.collection_id, list_append(t.seen, c.collection_id) FROM t JOIN collections c ON c.parent_collection_id = t.collection_id WHERE NOT list_contains(t.seen, c.collection_id))
      SELECT collection_id FROM t)
""")
def delete_collection(spark: SparkSession, d: str) -> DataFrame:
    """The collections left after one and all below it are deleted."""
    collections = table(spark, d, "collections")
    gone = hierarchy.descendants(collections, collections.where("collection_id = 4")).select("collection_id")
    return collections.join(gone, "collection_id", "left_anti").select("collection_id")


@query("""
    WITH e AS (SELECT 'part_of' AS predicate, collection_id AS src, parent_collection_id AS dst FROM collections WHERE parent_collection_id IS NOT NULL)
    SELECT DISTINCT predicate, src, dst FROM (SELECT * FROM e UNION ALL SELECT predicate, dst, src FROM e) WHERE src != dst
""")
def relation_edges(spark: SparkSession, d: str) -> DataFrame:
    tree = table(spark, d, "collections").where("parent_collection_id is not null")
    new = tree.select(F.lit("part_of").alias("predicate"), F.col("collection_id").alias("src"), F.col("parent_collection_id").alias("dst"))
    existing = new.where("src % 2 = 0")  # some of them, and their other direction, stand already
    return edits.add_relations(edits.add_relations(existing.limit(0), existing), new)


@query("""
    WITH e AS (SELECT collection_id AS src, parent_collection_id AS dst FROM collections WHERE parent_collection_id IS NOT NULL),
         b AS (SELECT DISTINCT src, dst FROM (SELECT * FROM e UNION ALL SELECT dst, src FROM e) WHERE src != dst), g AS (SELECT * FROM e WHERE src < 20)
    SELECT 'part_of' AS predicate, src, dst FROM b WHERE NOT EXISTS (SELECT 1 FROM g WHERE (g.src = b.src AND g.dst = b.dst) OR (g.dst = b.src AND g.src = b.dst))
""")
def relation_removal(spark: SparkSession, d: str) -> DataFrame:
    """Edges left after some were removed in both directions."""
    tree = table(spark, d, "collections").where("parent_collection_id is not null")
    new = tree.select(F.lit("part_of").alias("predicate"), F.col("collection_id").alias("src"), F.col("parent_collection_id").alias("dst"))
    return edits.remove_relations(edits.add_relations(new.limit(0), new), new.where("src < 20"))


@query("""
    SELECT item_id, name, title, v FROM (SELECT item_id, title, unnest(['doi', 'extra', 'item_type']) AS name, unnest([doi, extra, item_type]) AS v FROM zotero_items) WHERE v IS NOT NULL
""")
def wide_to_eav(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "zotero_items")
    return items.select("item_id", "title", F.explode(F.create_map(*[x for c in ("doi", "extra", "item_type") for x in (F.lit(c), F.col(c))])).alias("name", "v")).where("v is not null").select("item_id", "name", "title", "v")


@query("SELECT item_id, doi, extra, item_type FROM zotero_items WHERE doi IS NOT NULL OR extra IS NOT NULL OR item_type IS NOT NULL")
def eav_to_wide(spark: SparkSession, d: str) -> DataFrame:
    long = wide_to_eav(spark, d)
    return long.groupBy("item_id").pivot("name", ["doi", "extra", "item_type"]).agg(F.first("v"))


@query("""
    SELECT item_id, collection_id, synced_at FROM collection_items
    QUALIFY row_number() OVER (PARTITION BY item_id, collection_id ORDER BY coalesce(synced_at, added_at) DESC, (synced_at IS NOT NULL) DESC) = 1
""")
def latest_membership(spark: SparkSession, d: str) -> DataFrame:
    """The last synchronised state of each membership."""
    rows = table(spark, d, "collection_items")
    order = F.struct(F.coalesce("synced_at", "added_at"), F.col("synced_at").isNotNull())
    return rows.groupBy("item_id", "collection_id").agg(F.max_by("synced_at", order).alias("synced_at"))


@query("SELECT collection_id, item_id, added_at, rank FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY added_at DESC, item_id DESC, synced_at DESC NULLS LAST)::INT AS rank FROM (SELECT DISTINCT * FROM collection_items)) WHERE rank <= 5")
def newest_per_collection(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("collection_id").orderBy(F.col("added_at").desc(), F.col("item_id").desc(), F.col("synced_at").desc_nulls_last())
    rows = table(spark, d, "collection_items").distinct().withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return rows.select("collection_id", "item_id", "added_at", "rank")
