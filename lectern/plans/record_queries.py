"""Schema, searchable text, annotations, children, scopes, relations, attachments and returned batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import coercion, schema, text
from lectern.functions.identifiers import doi_key
from lectern.operators import batches, library, passages, records, vectors
from lectern.plans.index_queries import _VERSIONS_SQL, _versions
from lectern.plans.registry import query
from lectern.sources.tables import table

_ALIASES_SQL = "aliases(t, g, own) AS (VALUES " + ", ".join(f"('{t}', '{g}', '{own}')" for t, fields in schema.TYPE_FIELDS.items() for g, own in fields.items()) + ")"
_DOI_SQL = "nullif(regexp_extract(lower(regexp_replace(replace(doi, '%2F', '/'), '\\s', '', 'g')), '(10\\.[0-9]{4,9}/.*?)[.,;:]*$', 1), '')"


# --- schema and display ----------------------------------------------------------------------------------------


@query(f"""
    WITH {_ALIASES_SQL}, f(g) AS (VALUES ('title'), ('date'), ('publicationTitle'), ('publisher'), ('number'), ('type'), ('medium'))
    SELECT item_id, f.g AS field, coalesce(own, f.g) AS typed FROM zotero_items CROSS JOIN f LEFT JOIN aliases a ON a.t = item_type AND a.g = f.g
""")
def typed_fields(spark: SparkSession, d: str) -> DataFrame:
    fields = F.array(*map(F.lit, ("title", "date", "publicationTitle", "publisher", "number", "type", "medium")))
    rows = table(spark, d, "zotero_items").select("item_id", "item_type", F.explode(fields).alias("field"))
    return rows.select("item_id", "field", schema.typed_field(F.col("item_type"), F.col("field")).alias("typed"))


@query(f"""
    WITH {_ALIASES_SQL}, f(own) AS (VALUES ('bookTitle'), ('proceedingsTitle'), ('university'), ('reportNumber'), ('institution'), ('title'))
    SELECT item_id, f.own AS field, coalesce(g, f.own) AS generic FROM zotero_items CROSS JOIN f LEFT JOIN aliases a ON a.t = item_type AND a.own = f.own
""")
def generic_fields(spark: SparkSession, d: str) -> DataFrame:
    fields = F.array(*map(F.lit, ("bookTitle", "proceedingsTitle", "university", "reportNumber", "institution", "title")))
    rows = table(spark, d, "zotero_items").select("item_id", "item_type", F.explode(fields).alias("field"))
    return rows.select("item_id", "field", schema.generic_field(F.col("item_type"), F.col("field")).alias("generic"))


@query(f"""
    WITH {_ALIASES_SQL}
    SELECT attachment_key, coalesce(a.own, 'publicationTitle') AS field, nullif(CASE WHEN coalesce(a.own, '') = 'bookTitle' THEN m.book_title ELSE m.publication END, '') AS container
    FROM embedded_metadata m LEFT JOIN zotero_items i ON i.item_id = m.parent_item_id LEFT JOIN aliases a ON a.t = i.item_type AND a.g = 'publicationTitle'
""")
def container_fields(spark: SparkSession, d: str) -> DataFrame:
    """The field that names the container of each attached work, by the type of its item, and its value."""
    items = table(spark, d, "zotero_items").select(F.col("item_id").alias("parent_item_id"), "item_type")
    field = F.coalesce(schema.typed_field(F.col("item_type"), F.lit("publicationTitle")), F.lit("publicationTitle"))
    rows = table(spark, d, "embedded_metadata").join(items, "parent_item_id", "left").withColumn("field", field)
    return rows.select("attachment_key", "field", F.nullif(F.when(F.col("field") == "bookTitle", F.col("book_title")).otherwise(F.col("publication")), F.lit("")).alias("container"))


@query("SELECT item_id, regexp_replace(upper(substr(item_type, 1, 1)) || substr(item_type, 2), '([a-z])([A-Z])', '\\1 \\2', 'g') AS label FROM zotero_items")
def item_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "zotero_items").select("item_id", schema.label(F.col("item_type")).alias("label"))


_RECORDS_SQL = """
    r AS (SELECT item_key AS k, item_type AS item_type, NULL::BIGINT AS parent, title, NULL AS filename, NULL AS note FROM zotero_items
          UNION ALL SELECT attachment_key, 'attachment', parent_item_id, title, regexp_extract(pdf_url, '([^/]+)$', 1), NULL FROM embedded_metadata
          UNION ALL SELECT item_key || '/note', 'note', item_id, NULL, NULL, notes FROM zotero_items WHERE notes IS NOT NULL)
"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Items, the pages attached to them and their notes as one table of records."""
    items, pages = table(spark, d, "zotero_items"), table(spark, d, "embedded_metadata")
    none = lambda t: F.lit(None).cast(t)
    top = items.select(F.col("item_key").alias("k"), "item_type", none("bigint").alias("parent"), "title", none("string").alias("filename"), none("string").alias("note"))
    files = pages.select("attachment_key", F.lit("attachment"), "parent_item_id", "title", F.regexp_extract("pdf_url", "([^/]+)$", 1), none("string"))
    notes = items.where("notes is not null").select(F.concat("item_key", F.lit("/note")), F.lit("note"), "item_id", none("string"), none("string"), "notes")
    return top.union(files).union(notes)


@query("WITH " + _RECORDS_SQL + r"""
    , n AS (SELECT *, trim(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(note, '(?i)</(p|div|h[1-6]|blockquote|ul|ol|table|tr)\s*>', chr(10) || chr(10), 'g'), '(?i)<br\s*/?>|</li\s*>', chr(10), 'g'), '<[^>]*>', '', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), chr(10)), lambda x: trim(x, ' ') != '')[1], ' ') AS line FROM r)
    SELECT k, coalesce(CASE WHEN item_type = 'note' THEN CASE WHEN length(line) > 80 THEN substr(line, 1, 80) || '…' ELSE line END ELSE nullif(trim(title, ' '), '') END, nullif(trim(filename, ' '), ''), 'Untitled') AS shown FROM n
""")
def display_titles(spark: SparkSession, d: str) -> DataFrame:
    """What is shown as the title of every item, attachment and note."""
    return _records(spark, d).select("k", schema.display_title(F.col("item_type"), F.col("title"), F.col("filename"), F.col("note")).alias("shown"))


@query("WITH " + _RECORDS_SQL + "SELECT k FROM r WHERE coalesce(item_type NOT IN ('attachment', 'note', 'annotation'), true) OR (item_type = 'attachment' AND parent IS NULL)")
def top_level(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).where(records.is_top_level(F.col("item_type"), F.col("parent"))).select("k")


# --- searchable text and index metadata --------------------------------------------------------------------------


@query("""
    SELECT item_id, sha256(concat_ws(chr(10) || chr(10), CASE WHEN title != '' THEN 'Title: ' || title END, CASE WHEN creators != '' THEN 'Authors: ' || creators END,
      CASE WHEN abstract != '' THEN 'Abstract: ' || abstract END, CASE WHEN extra != '' THEN 'Extra: ' || extra END, CASE WHEN notes != '' THEN 'Notes: ' || notes END,
      CASE WHEN fulltext != '' THEN 'Content: ' || CASE WHEN length(fulltext) > 50000 THEN substr(fulltext, 1, 50000) || '...' ELSE fulltext END END)) AS digest FROM zotero_items
""")
def searchable_text(spark: SparkSession, d: str) -> DataFrame:
    """The hash of the text a simple search reads: the cut of the content is part of the record's definition."""
    parts = [("Title", F.col("title")), ("Authors", F.col("creators")), ("Abstract", F.col("abstract")), ("Extra", F.col("extra")), ("Notes", F.col("notes")), ("Content", F.col("fulltext"))]
    return table(spark, d, "zotero_items").select("item_id", F.sha2(records.searchable_text(parts, {"Content": 50_000}), 256).alias("digest"))


_SIGNATURE_SQL = """
    f AS (SELECT DISTINCT parent_item_id AS item_id, attachment_key, concat_ws(chr(31), attachment_key, coalesce(title, ''), coalesce(pdf_url, '')) AS facts FROM embedded_metadata WHERE parent_item_id IS NOT NULL),
    g AS (SELECT item_id, string_agg(attachment_key, ',' ORDER BY attachment_key) AS attachment_keys, sha256(string_agg(facts, chr(30) ORDER BY attachment_key, facts)) AS attachment_signature FROM f GROUP BY item_id)
"""


@query("WITH " + _SIGNATURE_SQL + "SELECT * FROM g")
def attachment_signature(spark: SparkSession, d: str) -> DataFrame:
    return records.attachment_signatures(table(spark, d, "embedded_metadata"))


@query("WITH " + _SIGNATURE_SQL + r"""
    SELECT item_key, library_id::VARCHAR AS library_id, coalesce(item_type, '') AS item_type, coalesce(title, '') AS title, coalesce(date_added, '') AS date_added,
      coalesce(date_modified, '') AS date_modified, coalesce(creators, '') AS creators, coalesce(doi, '') AS doi,
      sha256(trim(concat_ws(chr(10) || chr(10), nullif(trim(title, ' '), ''), nullif(trim(abstract, ' '), '')), ' ')) AS content_hash,
      CASE WHEN length(fulltext) > 0 THEN true END AS has_fulltext, CASE WHEN length(fulltext) > 0 THEN nullif(fulltext_source, '') END AS fulltext_source,
      attachment_keys, attachment_signature, trim(coalesce(regexp_extract(extra, '(?im)^[ \t]*(?:citation key|citationkey)[ \t]*:[ \t]*([^\n]*?)[ \t]*$', 1), ''), ' ') AS citation_key
    FROM zotero_items LEFT JOIN g USING (item_id)
""")
def index_metadata(spark: SparkSession, d: str) -> DataFrame:
    return records.index_metadata(table(spark, d, "zotero_items"), table(spark, d, "embedded_metadata"))


@query("""
    WITH i AS (SELECT item_key, sha256(concat_ws(chr(31), coalesce(title, ''), coalesce(abstract, ''))) AS digest, item_id FROM zotero_items),""" + _SIGNATURE_SQL + """
    , old AS (SELECT i.item_key, CASE WHEN item_id IN (SELECT item_id FROM deleted_items) THEN 'other' ELSE digest END AS digest,
                     CASE WHEN item_id IN (SELECT item_id FROM collection_items WHERE synced_at IS NULL) THEN 'moved' ELSE attachment_signature END AS signature
              FROM i LEFT JOIN g USING (item_id) WHERE item_id IN (SELECT item_id FROM collection_items))
    SELECT i.item_key, CASE WHEN old.digest IS NULL OR coalesce(g.attachment_signature, '') != coalesce(old.signature, '') THEN 'extract' WHEN i.digest = old.digest THEN 'keep' ELSE 'refresh' END AS action
    FROM i LEFT JOIN g USING (item_id) LEFT JOIN old ON old.item_key = i.item_key
""")
def fulltext_preserve(spark: SparkSession, d: str) -> DataFrame:
    """What an update does with the extracted text of each item; the index holds the items of collections, some with other content or files."""
    content = F.sha2(F.concat_ws("\x1f", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))), 256)
    items = table(spark, d, "zotero_items").select("item_id", "item_key", content.alias("digest"))
    now = items.join(records.attachment_signatures(table(spark, d, "embedded_metadata")).select("item_id", F.col("attachment_signature").alias("signature")), "item_id", "left")
    bridge = table(spark, d, "collection_items")
    trash = table(spark, d, "deleted_items").select("item_id", F.lit(True).alias("gone")).distinct()
    open_ = bridge.where("synced_at is null").select("item_id", F.lit(True).alias("open")).distinct()
    old = now.join(bridge.select("item_id").distinct(), "item_id", "left_semi").join(trash, "item_id", "left").join(open_, "item_id", "left").select(
        "item_key", F.when(F.col("gone"), "other").otherwise(F.col("digest")).alias("digest"), F.when(F.col("open"), "moved").otherwise(F.col("signature")).alias("signature")
    )
    return batches.keep_or_extract(now.select("item_key", "signature", "digest"), old, "item_key")


# --- annotations -------------------------------------------------------------------------------------------------

_COLOURS = list(coercion.COLOURS)
_ANNOTATIONS_SQL = f"""
    a AS (SELECT d.doc_id::VARCHAR AS annotation_key, d.item_key AS parent_key, d.text, d.lang, d.added_at,
                 (ARRAY[{', '.join(f"'{c}'" for c in _COLOURS)}, '#123456'])[(d.n_chars % 9 + 1)::INT] AS color,
                 CASE WHEN d.n_chars % 3 = 0 THEN '{{"pageIndex": ' || d.n_chars % 50 || '}}' WHEN d.n_chars % 3 = 1 THEN '{{"pageIndex": true}}' END AS position FROM documents d WHERE d.source = 'annotations')
"""


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of the library's documents; place and colour, which the table lacks, follow from the length."""
    docs = table(spark, d, "documents").where("source = 'annotations'")
    position = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit('{"pageIndex": '), (F.col("n_chars") % 50).cast("string"), F.lit("}"))).when(F.col("n_chars") % 3 == 1, F.lit('{"pageIndex": true}'))
    return docs.select(
        F.col("doc_id").cast("string").alias("annotation_key"), F.col("item_key").alias("parent_key"), F.lit("highlight").alias("type"), F.lit(None).cast("string").alias("page_label"),
        F.lit(None).cast("int").alias("pdf_page"), position.alias("position"), "text", F.lit(None).cast("string").alias("comment"),
        F.get(F.array(*map(F.lit, [*_COLOURS, "#123456"])), (F.col("n_chars") % 9).cast("int")).alias("color"), F.array(F.col("lang"), F.lit(" "), F.col("lang")).alias("tags"), F.col("added_at").alias("created"),
    )


@query("WITH " + _ANNOTATIONS_SQL + """
    , p AS (SELECT *, TRY_CAST(CASE WHEN json_type(position, '$.pageIndex') IN ('UBIGINT', 'BIGINT') THEN json_extract_string(position, '$.pageIndex') END AS INT) AS page_index FROM a)
    SELECT annotation_key, parent_key AS item_key, i.title AS parent_title, (page_index + 1)::VARCHAR AS page, page_index, coalesce(p.text, '') AS text, color,
           CASE color """ + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in coercion.COLOURS.items()) + """ END AS color_category, CASE WHEN trim(lang) != '' THEN trim(lang) ELSE '' END AS tag_list, added_at AS created
    FROM p LEFT JOIN zotero_items i ON i.item_key = p.parent_key
""")
def annotation_records(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "zotero_items").select(F.col("item_key").alias("parent_key"), F.col("title").alias("parent_title"))
    rows = records.annotation_records(_annotations(spark, d), parents)
    return rows.select("annotation_key", "item_key", "parent_title", "page", "page_index", "text", "color", "color_category", F.array_join("tags", " ").alias("tag_list"), "created")


@query("WITH " + _ANNOTATIONS_SQL + "SELECT annotation_key, concat_ws(' ', nullif(trim(text, ' '), ''), coalesce(nullif(trim(lang, ' '), ''), '')) AS document FROM a")
def annotation_texts(spark: SparkSession, d: str) -> DataFrame:
    return _annotations(spark, d).select("annotation_key", records.annotation_text(F.col("text"), F.col("comment"), F.col("tags")).alias("document"))


@query("""
    SELECT d.doc_id, d.item_key, i.item_id, i.title FROM documents d JOIN zotero_items i USING (item_key)
    WHERE d.source IN ('annotations', 'notes') AND contains(lower(d.text), 'harbour') AND i.item_id NOT IN (SELECT item_id FROM deleted_items)
""")
def annotation_search(spark: SparkSession, d: str) -> DataFrame:
    """Annotations and notes with a word, with the item they belong to, outside the trash."""
    docs = table(spark, d, "documents").where("source in ('annotations', 'notes')").where(F.contains(F.lower("text"), F.lit("harbour")))
    items = library.outside_trash(table(spark, d, "zotero_items"), table(spark, d, "deleted_items")).select("item_key", "item_id", "title")
    return docs.select("doc_id", "item_key").join(items, "item_key").select("doc_id", "item_key", "item_id", "title")


@query("SELECT doc_id, coalesce(i.item_key, doc_id::VARCHAR) AS paper_key, coalesce(nullif(i.title, ''), 'document ' || doc_id) AS paper_title FROM documents d LEFT JOIN zotero_items i ON i.item_key = d.item_key")
def paper_identity(spark: SparkSession, d: str) -> DataFrame:
    """The work each text belongs to; a text without one stands for itself."""
    items = table(spark, d, "zotero_items").select("item_key", F.col("item_key").alias("own"), "title")
    rows = table(spark, d, "documents").select("doc_id", "item_key").join(items, "item_key", "left")
    name = F.concat(F.lit("document "), F.col("doc_id").cast("string"))
    return rows.select("doc_id", F.coalesce("own", F.col("doc_id").cast("string")).alias("paper_key"), F.coalesce(F.nullif("title", F.lit("")), name).alias("paper_title"))


# --- children ----------------------------------------------------------------------------------------------------

_CHILDREN_SQL = """
    c AS (SELECT i.item_key, 'attachment' AS kind, attachment_key AS child_key FROM embedded_metadata m JOIN zotero_items i ON i.item_id = m.parent_item_id
          UNION ALL SELECT item_key, 'note', item_key || '/note' FROM zotero_items WHERE notes IS NOT NULL
          UNION ALL SELECT item_key, source, 'doc-' || doc_id FROM documents WHERE item_key IS NOT NULL AND source IN ('annotations', 'transcripts'))
"""


def _children(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "zotero_items")
    files = table(spark, d, "embedded_metadata").select(F.col("parent_item_id").alias("item_id"), F.lit("attachment").alias("kind"), F.col("attachment_key").alias("child_key"))
    notes = items.where("notes is not null").select("item_key", F.lit("note"), F.concat("item_key", F.lit("/note")))
    other = table(spark, d, "documents").where("item_key is not null and source in ('annotations', 'transcripts')").select("item_key", "source", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    return files.join(items.select("item_id", "item_key"), "item_id").select("item_key", "kind", "child_key").union(notes).union(other)


@query("WITH " + _CHILDREN_SQL + "SELECT item_key, kind, count(*) AS n, min(child_key) AS first_child, max(child_key) AS last_child FROM c GROUP BY ALL")
def children_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _children(spark, d).groupBy("item_key", "kind").agg(F.count("*").alias("n"), F.min("child_key").alias("first_child"), F.max("child_key").alias("last_child"))


@query("WITH " + _CHILDREN_SQL + """
    , k AS (SELECT batch_id, pos, item_key FROM (SELECT batch_id, unnest(range(len(item_keys))) AS pos, unnest(item_keys) AS item_key FROM prepared_batches)),
    s AS (SELECT item_key, count(*) FILTER (WHERE kind = 'attachment') AS a, count(*) FILTER (WHERE kind = 'note') AS n, count(*) FILTER (WHERE kind NOT IN ('attachment', 'note')) AS o, min(child_key) AS f FROM c GROUP BY item_key)
    SELECT batch_id * 1000000 + pos AS pos, k.item_key, coalesce(a, 0) AS attachments, coalesce(n, 0) AS notes, coalesce(o, 0) AS others, f AS first_child FROM k LEFT JOIN s ON s.item_key = k.item_key
""")
def children_many(spark: SparkSession, d: str) -> DataFrame:
    """The children of the keys of every batch, keys in order, those without children kept."""
    keys = table(spark, d, "prepared_batches").select("batch_id", F.posexplode("item_keys").alias("p", "item_key"))
    return records.children_of(keys.select((F.col("batch_id") * 1000000 + F.col("p")).alias("pos"), "item_key"), _children(spark, d))


# --- libraries -----------------------------------------------------------------------------------------------------

_LIBRARIES_SQL = """
    l AS (SELECT DISTINCT i.library_id, CASE WHEN i.library_id = 1 THEN 'user' WHEN i.library_id >= 38 THEN 'feed' ELSE 'group' END AS library_type, i.library_id + 1000 AS external_id, n.n_name AS name
          FROM zotero_items i LEFT JOIN nation n ON n.n_nationkey = i.library_id)
"""


def _libraries(spark: SparkSession, d: str) -> DataFrame:
    """The libraries that items stand in; number 1 is the personal one, the last three are feeds, names come from a dimension table."""
    own = table(spark, d, "zotero_items").select("library_id").distinct()
    kind = F.when(F.col("library_id") == 1, "user").when(F.col("library_id") >= 38, "feed").otherwise("group")
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("library_id"), F.col("n_name").alias("name"))
    return own.join(names, "library_id", "left").select("library_id", kind.alias("library_type"), (F.col("library_id") + 1000).alias("external_id"), "name")


@query("WITH " + _LIBRARIES_SQL + "SELECT item_id, coalesce(l.name, l.library_type || ' ' || l.external_id) AS label FROM zotero_items JOIN l USING (library_id)")
def library_labels(spark: SparkSession, d: str) -> DataFrame:
    label = F.coalesce("name", F.concat_ws(" ", "library_type", F.col("external_id").cast("string")))
    return table(spark, d, "zotero_items").select("item_id", "library_id").join(_libraries(spark, d).select("library_id", label.alias("label")), "library_id").select("item_id", "label")


@query("WITH " + _LIBRARIES_SQL + """
    , w(library_type, external_id) AS (VALUES ('users', 1001), ('Groups', 1007), ('feed', 1040), ('group', 9999), ('group', 1001))
    SELECT w.library_type, w.external_id, l.library_id, CASE WHEN l.library_id IS NULL THEN 'unknown' ELSE 'found' END AS state
    FROM w LEFT JOIN l ON l.external_id = w.external_id AND l.library_type = regexp_replace(lower(w.library_type), 's$', '')
""")
def library_resolve(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([("users", 1001), ("Groups", 1007), ("feed", 1040), ("group", 9999), ("group", 1001)], "library_type string, external_id bigint")
    return records.resolve_libraries(wanted, _libraries(spark, d))


@query("WITH " + _LIBRARIES_SQL + "SELECT count(*) AS items, count(*) FILTER (WHERE l.library_type = 'user') AS personal FROM zotero_items JOIN l USING (library_id) WHERE l.library_type != 'feed' AND contains(lower(title), 'harbour')")
def scoped_search(spark: SparkSession, d: str) -> DataFrame:
    """A title search over all libraries but feeds."""
    hits = table(spark, d, "zotero_items").where(F.contains(F.lower("title"), F.lit("harbour")))
    both = hits.join(records.search_scope(_libraries(spark, d)).select("library_id", "library_type"), "library_id")
    return both.agg(F.count("*").alias("items"), F.sum((F.col("library_type") == "user").cast("bigint")).alias("personal"))


@query("WITH " + _LIBRARIES_SQL + "SELECT item_id, title, creators, date_added FROM zotero_items JOIN l USING (library_id) WHERE l.library_type = 'feed'")
def feed_items(spark: SparkSession, d: str) -> DataFrame:
    feeds = _libraries(spark, d).where("library_type = 'feed'").select("library_id")
    return table(spark, d, "zotero_items").join(feeds, "library_id", "left_semi").select("item_id", "title", "creators", "date_added")


@query("""
    WITH w(collection_key) AS (SELECT collection_key FROM collections UNION SELECT 'NOSUCHKY')
    SELECT w.collection_key, c.collection_id IS NOT NULL AS known, coalesce(n, 0) AS items FROM w LEFT JOIN collections c USING (collection_key)
    LEFT JOIN (SELECT collection_id, count(DISTINCT item_id) AS n FROM collection_items GROUP BY 1) x ON x.collection_id = c.collection_id
""")
def collection_exists(spark: SparkSession, d: str) -> DataFrame:
    """Whether a key that a search is limited to exists; an unknown one is told apart from an empty one."""
    collections = table(spark, d, "collections").select("collection_key", "collection_id")
    wanted = collections.select("collection_key").union(spark.createDataFrame([("NOSUCHKY",)], "collection_key string")).distinct()
    size = table(spark, d, "collection_items").groupBy("collection_id").agg(F.countDistinct("item_id").alias("items"))
    return wanted.join(collections, "collection_key", "left").join(size, "collection_id", "left").select("collection_key", F.col("collection_id").isNotNull().alias("known"), F.coalesce("items", F.lit(0)).alias("items"))


# --- relations, notices, lists of works --------------------------------------------------------------------------------


@query(f"""
    WITH k AS (SELECT item_id, item_key, library_id, title, {_DOI_SQL} AS dk FROM zotero_items),
    g AS (SELECT *, first_value(item_key) OVER w AS head, first_value(library_id) OVER w AS head_lib FROM k WHERE dk IS NOT NULL WINDOW w AS (PARTITION BY dk ORDER BY item_id))
    SELECT DISTINCT g.item_id, t.item_id AS related_id, t.title AS related_title FROM g JOIN k t ON t.item_key = g.head AND t.library_id = g.head_lib WHERE g.library_id = g.head_lib AND g.item_id != t.item_id
""")
def related_items(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that point from each entry of a work to its first entry, resolved within the library."""
    items = table(spark, d, "zotero_items")
    keyed = items.select("item_id", "item_key", "library_id", doi_key("doi").alias("dk")).where("dk is not null")
    first = keyed.groupBy("dk").agg(F.min_by(F.struct("item_key", "library_id"), "item_id").alias("h"))
    uri = F.concat(F.lit("https://library.example/groups/"), F.col("h.library_id").cast("string"), F.lit("/items/"), F.col("h.item_key"))
    return records.related_items(keyed.join(first, "dk").select("item_id", uri.alias("uri")), items)


@query(f"""
    WITH k AS (SELECT item_id, {_DOI_SQL} AS dk FROM zotero_items), n AS (SELECT dk, count(*) AS n_notices FROM k WHERE item_id IN (SELECT item_id FROM deleted_items) AND dk IS NOT NULL GROUP BY dk)
    SELECT item_id, n_notices FROM k JOIN n USING (dk) WHERE item_id NOT IN (SELECT item_id FROM deleted_items)
""")
def retraction_scan(spark: SparkSession, d: str) -> DataFrame:
    """Items whose DOI has notices; entries in the trash stand for notices."""
    keyed = table(spark, d, "zotero_items").select("item_id", doi_key("doi").alias("dk"))
    trash = table(spark, d, "deleted_items")
    notices = keyed.join(trash, "item_id", "left_semi")
    return records.with_notices(library.outside_trash(keyed, trash), notices, "dk").select("item_id", "n_notices")


@query("""
    SELECT batch_id, pos, item_key, title FROM (SELECT batch_id, unnest(range(len(item_keys))) AS pos, unnest(item_keys) AS item_key FROM prepared_batches) JOIN zotero_items USING (item_key)
""")
def works_in_order(spark: SparkSession, d: str) -> DataFrame:
    works = table(spark, d, "zotero_items").select("item_key", "title")
    return records.in_order(table(spark, d, "prepared_batches"), "batch_id", "item_keys", works, "item_key").select("batch_id", "pos", "item_key", "title")


@query("""
    SELECT attachment_key, array_to_string([trim(concat_ws(' ', nullif(a.first_name, ''), a.last_name)) FOR a IN authors[1:3]], ', ') || CASE WHEN len(authors) > 3 THEN ' et al.' ELSE '' END AS authors,
           nullif(regexp_extract(pub_date, '([0-9]{4})', 1), '') AS year FROM embedded_metadata
""")
def work_summaries(spark: SparkSession, d: str) -> DataFrame:
    names = F.transform("authors", lambda a: F.trim(F.concat_ws(" ", F.nullif(a["first_name"], F.lit("")), a["last_name"])))
    return table(spark, d, "embedded_metadata").select("attachment_key", records.short_authors(names).alias("authors"), F.nullif(F.regexp_extract("pub_date", "([0-9]{4})", 1), F.lit("")).alias("year"))


@query(f"""
    WITH k AS (SELECT item_id, item_key, {_DOI_SQL} AS dk FROM zotero_items WHERE item_id NOT IN (SELECT item_id FROM deleted_items)),
    c AS (SELECT parent_item_id AS item_id, count(*) AS n FROM embedded_metadata GROUP BY 1)
    SELECT dk, min(k.item_id) AS keeper, count(*) AS entries, sum(coalesce(n, 0))::BIGINT AS children,
           sha256(string_agg(item_key || ':' || coalesce(n, 0), '|' ORDER BY item_key)) AS plan_hash FROM k LEFT JOIN c USING (item_id) WHERE dk IS NOT NULL GROUP BY dk HAVING count(*) > 1
""")
def merge_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The sorted plan of every merge as a hash, to which a confirmation is bound."""
    items = library.outside_trash(table(spark, d, "zotero_items"), table(spark, d, "deleted_items"))
    counts = table(spark, d, "embedded_metadata").groupBy(F.col("parent_item_id").alias("item_id")).agg(F.count("*").alias("n"))
    rows = items.select("item_id", "item_key", doi_key("doi").alias("dk")).where("dk is not null").join(counts, "item_id", "left")
    part = F.concat("item_key", F.lit(":"), F.coalesce("n", F.lit(0)).cast("string"))
    return rows.groupBy("dk").agg(
        F.min("item_id").alias("keeper"), F.count("*").alias("entries"), F.sum(F.coalesce("n", F.lit(0))).alias("children"), F.array_sort(F.collect_list(F.struct("item_key", part.alias("p")))).alias("x")
    ).where("entries > 1").select("dk", "keeper", "entries", "children", F.sha2(F.array_join(F.transform("x", lambda v: v["p"]), "|"), 256).alias("plan_hash"))


# --- attachments and extraction ------------------------------------------------------------------------------------------


@query("""
    SELECT item_id, CASE WHEN length(fulltext) > 0 THEN 1 ELSE 0 END AS bucket, coalesce(fulltext_selection_priority, 99) AS priority,
           rank() OVER (PARTITION BY library_id ORDER BY CASE WHEN length(fulltext) > 0 THEN 1 ELSE 0 END, coalesce(fulltext_selection_priority, 99), item_id) AS place FROM zotero_items
""")
def extraction_queue(spark: SparkSession, d: str) -> DataFrame:
    """The order in which the texts of each library are extracted: items of metadata only first, then by the rank of their source."""
    from pyspark.sql.window import Window

    rows = table(spark, d, "zotero_items").select("item_id", "library_id", F.when(F.length("fulltext") > 0, 1).otherwise(0).alias("bucket"), F.coalesce("fulltext_selection_priority", F.lit(99)).alias("priority"))
    return rows.select("item_id", "bucket", "priority", F.rank().over(Window.partitionBy("library_id").orderBy("bucket", "priority", "item_id")).alias("place"))


_LABEL_SQL = "trim(regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(filename, '')), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""
    WITH f AS (SELECT attachment_key, title, regexp_extract(pdf_url, '([^/]+)$', 1) AS filename FROM embedded_metadata), w AS (SELECT *, ' ' || {_LABEL_SQL} || ' ' AS words, lower(filename) AS n FROM f)
    SELECT attachment_key, CASE WHEN NOT n LIKE '%.pdf' AND (words LIKE '% fulltext %' OR words LIKE '% full %' AND words LIKE '% text %') THEN 'fulltext'
      WHEN n LIKE '%.pdf' AND words LIKE '% ocr %' THEN 'ocr-pdf' WHEN n LIKE '%.pdf' THEN 'pdf'
      WHEN regexp_matches(n, '\\.(txt|md|markdown|rst|csv|tsv|json|xml|vtt|srt|sbv|log|html|htm)$') THEN 'file' END AS kind FROM w
""")
def artifact_kinds(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "embedded_metadata").select("attachment_key", "title", F.regexp_extract("pdf_url", "([^/]+)$", 1).alias("filename"))
    return files.select("attachment_key", library.artifact_kind(F.col("title"), F.col("filename")).alias("kind"))


@query("SELECT attachment_key, (regexp_matches(pdf_url, '^(?i:https?://)?[^/?#]*[^./?#]\\.[^./?#][^/?#]*') AND NOT regexp_matches(pdf_url, '\\s')) AS is_url FROM embedded_metadata")
def url_test(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embedded_metadata").select("attachment_key", coercion.looks_like_url(F.col("pdf_url")).alias("is_url"))


# --- strings ---------------------------------------------------------------------------------------------------------


@query("""
    SELECT item_id, [x FOR x IN list_distinct([trim(p, ' ') FOR p IN string_split(creators, ';')]) IF x != ''].len() AS n, trim(string_split(creators, ';')[1], ' ') AS first_part FROM zotero_items WHERE contains(creators, ';')
""")
def keyword_split(spark: SparkSession, d: str) -> DataFrame:
    parts = coercion.split_keywords(F.col("creators"))
    return table(spark, d, "zotero_items").where("contains(creators, ';')").select("item_id", F.size(parts).cast("bigint").alias("n"), F.get(parts, F.lit(0)).alias("first_part"))


@query(r"""
    WITH p AS (SELECT item_id, pos, trim(regexp_replace(part, '\s+', ' ', 'g'), ' ') AS s FROM (SELECT item_id, unnest(range(len(string_split(creators, ';')))) AS pos, unnest(string_split(creators, ';')) AS part FROM zotero_items))
    SELECT item_id, pos, CASE WHEN contains(s, ',') THEN trim(regexp_extract(s, ',(.*)$', 1), ' ') ELSE trim(regexp_replace(s, '\s*\S+$', ''), ' ') END AS first,
           CASE WHEN contains(s, ',') THEN trim(regexp_extract(s, '^([^,]*),', 1), ' ') ELSE regexp_extract(s, '(\S+)$', 1) END AS last FROM p
""")
def name_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "zotero_items").select("item_id", F.posexplode(F.split("creators", ";")).alias("pos", "part"))
    return rows.select("item_id", "pos", coercion.split_name(F.col("part")).alias("n")).select("item_id", "pos", "n.first", "n.last")


@query(r"""
    SELECT attachment_key, CASE WHEN regexp_matches(pub_date, '(^|[^0-9])[12][0-9]{3}([^0-9]|$)') THEN concat_ws('-', regexp_extract(pub_date, '(?:^|[^0-9])([12][0-9]{3})(?:[^0-9]|$)', 1), lpad(m::VARCHAR, 2, '0'),
             CASE WHEN m IS NOT NULL THEN lpad(CASE WHEN TRY_CAST(nullif(regexp_extract(pub_date, '^[12][0-9]{3}[-/.]\d{1,2}[-/.](\d{1,2})(?:[^0-9]|$)', 1), '') AS INT) BETWEEN 1 AND 31 THEN regexp_extract(pub_date, '^[12][0-9]{3}[-/.]\d{1,2}[-/.](\d{1,2})(?:[^0-9]|$)', 1)::INT::VARCHAR END, 2, '0') END) END AS iso
    FROM (SELECT attachment_key, pub_date, CASE WHEN n BETWEEN 1 AND 12 THEN n END AS m FROM (SELECT attachment_key, trim(lower(pub_date), ' ') AS pub_date,
      coalesce(TRY_CAST(nullif(regexp_extract(lower(trim(pub_date, ' ')), '^[12][0-9]{3}[-/.](\d{1,2})(?:[^0-9]|$)', 1), '') AS INT),
               nullif(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], regexp_extract(lower(pub_date), '(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)', 1)), 0)) AS n FROM embedded_metadata))
""")
def citation_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embedded_metadata").select("attachment_key", coercion.as_iso_date(F.col("pub_date")).alias("iso"))


@query(r"SELECT doc_id, trim(regexp_replace(translate(text, '‘’‚‛“”„‟', repeat(chr(39), 4) || repeat(chr(34), 4)), '\s+', ' ', 'g'), ' ') AS plain FROM documents WHERE source = 'passages'")
def plain_quotes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source = 'passages'").select("doc_id", coercion.plain_quotes(F.col("text")).alias("plain"))


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) ELSE text END AS head FROM documents")
def token_truncate(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut to 200 tokens at two characters a token, the rule where no tokenizer is at hand."""
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 2 * 200).alias("head"))


@query("SELECT item_id, CASE WHEN title != '' THEN '@misc{' || item_key || ',' || chr(10) || '  title = {x}}' ELSE '@book{kept, a = {}}' END AS entry FROM zotero_items")
def citekey_inject(spark: SparkSession, d: str) -> DataFrame:
    entry = F.when(F.coalesce("title", F.lit("")) != "", F.lit("@misc{,\n  title = {x}}")).otherwise(F.lit("@book{kept, a = {}}"))
    return table(spark, d, "zotero_items").select("item_id", coercion.add_citekey(entry, F.col("item_key")).alias("entry"))


@query("""
    WITH s AS (SELECT item_id, regexp_replace(lower(fulltext), '[\\s\\v\\x1c-\\x1f\\x85\\x{a0}]+', '', 'g') AS f, regexp_replace(lower(title), '[\\s\\v\\x1c-\\x1f\\x85\\x{a0}]+', '', 'g') AS t FROM zotero_items WHERE fulltext IS NOT NULL AND trim(title, ' ') != '')
    SELECT item_id, contains(f, t) AS found FROM s
""")
def located_titles(spark: SparkSession, d: str) -> DataFrame:
    """Whether each title stands in its full text, white space and case aside."""
    rows = table(spark, d, "zotero_items").where("fulltext is not null and trim(title) != ''")
    return rows.select("item_id", passages.located_of(F.col("fulltext"), F.col("title"))["start"].isNotNull().alias("found"))


# --- returned batches ----------------------------------------------------------------------------------------------------


@query("""
    SELECT vec_id::VARCHAR AS custom_id, CASE WHEN label = 0 THEN 'status 500' WHEN label = 1 THEN 'rate limit' WHEN label = 2 THEN 'no embedding' END AS failure, CASE WHEN label = 0 OR label > 2 THEN CASE WHEN label = 0 THEN 500 ELSE 200 END ELSE 200 END AS status_code,
           CASE WHEN label > 2 THEN len(embedding) END AS dims FROM embeddings
""")
def batch_results(spark: SparkSession, d: str) -> DataFrame:
    """Result lines of an embedding service, some of them failures, read back."""
    rows = table(spark, d, "embeddings")
    data = F.when(F.col("label") > 2, F.array(F.struct("embedding"))).otherwise(F.array().cast("array<struct<embedding:array<float>>>"))
    response = F.struct(F.when(F.col("label") == 0, 500).otherwise(200).alias("status_code"), F.struct(data.alias("data")).alias("body"))
    line = F.to_json(F.struct(F.col("vec_id").cast("string").alias("custom_id"), response.alias("response"), F.when(F.col("label") == 1, "rate limit").alias("error")))
    parsed = batches.parse_results(rows.select(line.alias("value")))
    return parsed.select("custom_id", "failure", "status_code", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("bigint").alias("dims"))


@query(_VERSIONS_SQL + """
    SELECT o.record_id, CASE WHEN n.record_id IS NULL THEN 'missing' ELSE 'changed' END AS state FROM o LEFT JOIN n ON n.record_id = o.record_id
    WHERE n.record_id IS NULL OR n.digest != o.digest
""")
def baseline_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Records that changed since a batch was submitted from them."""
    now, old = _versions(spark, d)
    sent = old.select("record_id", F.col("digest").alias("baseline"), F.sha2("digest", 256).alias("submitted"))
    return batches.conflicts(now, sent, "record_id")


@query("""
    WITH e AS (SELECT batch_id, prepared_at, unnest(range(len(ids))) AS pos, unnest(ids) AS record_id, unnest(documents) AS text FROM prepared_batches),
    bad AS (SELECT DISTINCT batch_id FROM e WHERE text IS NULL OR trim(text, ' ') = '')
    SELECT record_id, batch_id, length(text) AS n_chars FROM e WHERE batch_id NOT IN (SELECT batch_id FROM bad)
    QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY prepared_at DESC, batch_id DESC, pos DESC) = 1
""")
def batch_import(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the batches in which every row came back, the latest of each record; batches with a failed row are left out whole."""
    from lectern.plans.index_queries import _entries

    rows = _entries(spark, d)
    got = batches.import_batches(rows, "batch_id", "record_id", F.trim(F.coalesce("text", F.lit(""))) == "", F.struct("prepared_at", "batch_id", "pos"))
    return got.select("record_id", "batch_id", F.length("text").cast("bigint").alias("n_chars"))


@query(_VERSIONS_SQL + "SELECT DISTINCT item_key FROM (SELECT record_id, item_key, CASE WHEN record_id IN (SELECT record_id FROM o) THEN 'rebuild' ELSE digest END AS digest FROM n) WHERE digest = 'rebuild'")
def pending_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Parents with a record that is still marked, after the records of an older state were marked and others written anew."""
    now, old = _versions(spark, d)
    marked = batches.stamp(now.join(old.select("record_id"), "record_id", "left_semi"), "rebuild")
    fresh = now.join(old.select("record_id"), "record_id", "left_anti")
    return batches.pending(marked.unionByName(fresh), "rebuild", "item_key")


@query("SELECT event_type, count(*) AS done, median(value) AS typical, round(median(value) * 100 / 8, 6) AS eta FROM events GROUP BY event_type")
def eta_median(spark: SparkSession, d: str) -> DataFrame:
    """Seconds for a hundred more of each kind on eight workers, by the median of those done."""
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("done"), F.percentile("value", F.lit(0.5)).alias("typical"))
    return rows.select("event_type", "done", "typical", F.round(F.col("typical") * 100 / 8, 6).alias("eta"))


@query("""
    SELECT collection_id, max(coalesce(synced_at, added_at)) AS last_update, date_diff('day', max(coalesce(synced_at, added_at))::DATE, DATE '2026-01-01') >= 7 AS due FROM collection_items GROUP BY collection_id
""")
def update_due(spark: SparkSession, d: str) -> DataFrame:
    """Collections not updated for a week."""
    last = table(spark, d, "collection_items").groupBy("collection_id").agg(F.max(F.coalesce("synced_at", "added_at")).alias("last_update"))
    return last.select("collection_id", "last_update", (F.datediff(F.lit("2026-01-01").cast("date"), F.col("last_update").cast("date")) >= 7).alias("due"))


# --- further records ---------------------------------------------------------------------------------------------------


@query("""
    SELECT item_id, sha256(trim(regexp_replace(regexp_replace(replace(fulltext, chr(12), '<!-- Page 3 -->'), '(?i)<!--\\s*page[^>]*-->', chr(10) || chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS digest FROM zotero_items WHERE fulltext IS NOT NULL
""")
def ocr_markdown(spark: SparkSession, d: str) -> DataFrame:
    marked = F.replace("fulltext", F.lit("\f"), F.lit("<!-- Page 3 -->"))
    return table(spark, d, "zotero_items").where("fulltext is not null").select("item_id", F.sha2(records.without_page_marks(marked), 256).alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 != 2 AND text != '' THEN sha256(text) END AS digest FROM documents")
def structured_documents(spark: SparkSession, d: str) -> DataFrame:
    """Plain texts read out of structured JSON, of which some are not complete."""
    state = F.when(F.col("doc_id") % 3 == 0, "ok").when(F.col("doc_id") % 3 == 1, "Complete").otherwise("failed")
    doc = F.to_json(F.struct(state.alias("status"), F.struct(F.col("text").alias("plain_text")).alias("structured")))
    return table(spark, d, "documents").select("doc_id", F.sha2(records.structured_text(doc), 256).alias("digest"))


@query("""
    SELECT record_id FROM (SELECT DISTINCT unnest(ids) AS record_id FROM prepared_batches) WHERE split_part(record_id, '#', 1) NOT IN (SELECT item_key FROM zotero_items JOIN deleted_items USING (item_id))
""")
def delete_item_records(spark: SparkSession, d: str) -> DataFrame:
    """The index after all records of trashed items are gone."""
    from lectern.plans.index_queries import _entries

    trash = table(spark, d, "zotero_items").join(table(spark, d, "deleted_items"), "item_id", "left_semi").select("item_key")
    return _entries(spark, d).select("record_id", "item_key").distinct().join(trash, "item_key", "left_anti").select("record_id")


@query("""
    WITH u AS (SELECT parent_item_id AS item_id, min(nullif(title, '')) AS t, min(nullif(doi, '')) AS x FROM embedded_metadata GROUP BY 1)
    SELECT item_id, coalesce(t, title) AS title, coalesce(x, doi) AS doi FROM zotero_items LEFT JOIN u USING (item_id)
""")
def update_item(spark: SparkSession, d: str) -> DataFrame:
    """Items patched with the fields found in their attached pages; a field not found stays."""
    from lectern.operators import indexing

    found = table(spark, d, "embedded_metadata").groupBy(F.col("parent_item_id").alias("item_id")).agg(F.min(F.nullif("title", F.lit(""))).alias("title"), F.min(F.nullif("doi", F.lit(""))).alias("doi"))
    return indexing.patch(table(spark, d, "zotero_items").select("item_id", "title", "doi"), found, "item_id", ["title", "doi"])


@query("SELECT item_id FROM deleted_items UNION SELECT c.item_id FROM collection_items c JOIN zotero_items z USING (item_id) WHERE collection_id = 7")
def delete_item(spark: SparkSession, d: str) -> DataFrame:
    """The trash after the items of a collection went there; items that don't exist can't."""
    going = table(spark, d, "collection_items").where("collection_id = 7").select("item_id").join(table(spark, d, "zotero_items"), "item_id", "left_semi")
    return table(spark, d, "deleted_items").select("item_id").union(going).distinct()


@query("""
    SELECT item_key || '/note' AS note_key, item_key FROM zotero_items WHERE notes IS NOT NULL AND item_id NOT IN (SELECT item_id FROM deleted_items)
    UNION ALL SELECT 'doc-' || doc_id, item_key FROM documents WHERE source = 'notes' AND item_key IS NOT NULL AND trim(text) != ''
""")
def notes_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """The notes after those of trashed items were deleted and new ones created from texts."""
    kept = library.outside_trash(table(spark, d, "zotero_items"), table(spark, d, "deleted_items")).where("notes is not null")
    new = table(spark, d, "documents").where("source = 'notes' and item_key is not null and trim(text) != ''")
    return kept.select(F.concat("item_key", F.lit("/note")).alias("note_key"), "item_key").union(new.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), "item_key"))


@query("SELECT batch_id, count(DISTINCT id) AS ids, min(id) AS first_id, max(id) AS last_id FROM (SELECT batch_id, unnest(ids) AS id FROM prepared_batches) GROUP BY batch_id")
def inventory(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "prepared_batches").select("batch_id", F.explode("ids").alias("id"))
    return rows.groupBy("batch_id").agg(F.countDistinct("id").alias("ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("""
    WITH e AS (SELECT collection_id AS src, parent_collection_id AS dst FROM collections WHERE parent_collection_id IS NOT NULL), b AS (SELECT DISTINCT * FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)),
         q AS (SELECT a.collection_id AS src, c.collection_id AS dst FROM collections a JOIN collections c ON c.library_id = a.library_id AND a.collection_id != c.collection_id)
    SELECT q.src, q.dst, b.src IS NOT NULL AS exists FROM q LEFT JOIN b ON b.src = q.src AND b.dst = q.dst
""")
def relation_exists(spark: SparkSession, d: str) -> DataFrame:
    """Which collections of one library are parent and child, either way."""
    collections = table(spark, d, "collections")
    edges = collections.where("parent_collection_id is not null").select(F.col("collection_id").alias("src"), F.col("parent_collection_id").alias("dst"))
    asked = collections.select("library_id", F.col("collection_id").alias("src")).join(collections.select("library_id", F.col("collection_id").alias("dst")), "library_id").where("src != dst").select("src", "dst")
    return records.existing_edges(edges, asked)


@query(f"""
    WITH {_ALIASES_SQL}
    SELECT attachment_key, coalesce(a.own, 'date') AS field, coalesce(trim(pub_date, ' '), '') AS shown FROM embedded_metadata m LEFT JOIN zotero_items i ON i.item_id = m.parent_item_id LEFT JOIN aliases a ON a.t = i.item_type AND a.g = 'date'
""")
def display_dates(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "zotero_items").select(F.col("item_id").alias("parent_item_id"), "item_type")
    rows = table(spark, d, "embedded_metadata").join(items, "parent_item_id", "left")
    return rows.select("attachment_key", F.coalesce(schema.typed_field(F.col("item_type"), F.lit("date")), F.lit("date")).alias("field"), F.coalesce(F.trim("pub_date"), F.lit("")).alias("shown"))


@query(r"SELECT item_id, lower(regexp_replace(translate(replace(replace(replace(replace(replace(regexp_replace(title, '(\p{L})[-\x{ad}]\r?\n\s*(\p{Ll})', '\1\2', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '‘’“”‐‑‒–—―−', repeat(chr(39), 2) || repeat(chr(34), 2) || '-------'), '\s+', '', 'g')) AS folded FROM zotero_items WHERE title IS NOT NULL")
def space_free_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "zotero_items").where("title is not null").select("item_id", coercion.space_free(F.col("title")).alias("folded"))


@query(r"SELECT attachment_key, trim(regexp_replace(lower(title), '\s+', ' ', 'g'), ' ') AS folded FROM embedded_metadata")
def attachment_title_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embedded_metadata").select("attachment_key", text.collapse(F.lower("title")).alias("folded"))


@query("WITH " + _LIBRARIES_SQL + "SELECT item_id, CASE WHEN library_type = 'group' THEN 'https://library.example/groups/' || library_id || '/items/' || item_key ELSE 'https://library.example/items/' || item_key END AS url FROM zotero_items JOIN l USING (library_id)")
def item_addresses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "zotero_items").join(_libraries(spark, d).select("library_id", "library_type"), "library_id")
    return rows.select("item_id", records.item_address(F.col("library_type"), F.col("library_id"), F.col("item_key")).alias("url"))


@query("""
    SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' WHEN s >= 0 THEN s || 's' END AS shown
    FROM (SELECT event_id, (event_id * 37 % 9000 - 10)::BIGINT AS s FROM events)
""")
def eta_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", coercion.duration_text(F.col("event_id") * 37 % 9000 - 10).alias("shown"))


_HITS_SQL = """
    h AS (SELECT doc_id, item_key, n_chars, (length(lower(text)) - length(replace(lower(text), 'harbour', ''))) // 7 AS hits FROM documents WHERE contains(lower(text), 'harbour')),
    f AS (SELECT * FROM h ORDER BY hits DESC, doc_id LIMIT 200)
"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    n = F.floor((F.length(low) - F.length(F.replace(low, F.lit("harbour"), F.lit("")))) / 7)
    return table(spark, d, "documents").where(F.contains(low, F.lit("harbour"))).select("doc_id", "item_key", "n_chars", n.cast("bigint").alias("hits"))


@query("WITH " + _HITS_SQL + "SELECT doc_id, hits, round(hits / (1 + n_chars / 1000.0), 9) AS second_score FROM f ORDER BY second_score DESC, doc_id LIMIT 20")
def rerank_hits(spark: SparkSession, d: str) -> DataFrame:
    """The 200 texts with most hits of a word, the 20 densest of them on top."""
    return vectors.rerank(_hits(spark, d), F.round(F.col("hits") / (1 + F.col("n_chars") / 1000.0), 9), 200, 20, "hits", "doc_id").select("doc_id", "hits", "second_score")


@query("WITH " + _HITS_SQL + "SELECT f.doc_id, f.hits, z.item_id, z.title, z.creators FROM f LEFT JOIN zotero_items z ON z.item_key = f.item_key")
def hit_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Ranked hits joined with their items at query time; a hit without one is kept."""
    items = table(spark, d, "zotero_items").select("item_key", "item_id", "title", "creators")
    return vectors.top_k(_hits(spark, d), 200, "hits", "doc_id").join(items, "item_key", "left").select("doc_id", "hits", "item_id", "title", "creators")


@query("""
    WITH m AS (SELECT attachment_key, nullif(publication, '') AS venue, nullif(substr(pub_date, 1, 4), '') AS y FROM embedded_metadata),
    e AS (SELECT a.attachment_key AS src, b.attachment_key AS dst FROM m a JOIN m b ON a.venue = b.venue AND a.y < b.y AND a.y::INT + 1 = b.y::INT WHERE regexp_full_match(a.y, '[0-9]{4}') AND regexp_full_match(b.y, '[0-9]{4}'))
    SELECT k.attachment_key, coalesce(o, 0) AS references_made, coalesce(i, 0) AS cited_by FROM embedded_metadata k LEFT JOIN (SELECT src, count(*) AS o FROM e GROUP BY src) x ON x.src = k.attachment_key LEFT JOIN (SELECT dst, count(*) AS i FROM e GROUP BY dst) y ON y.dst = k.attachment_key
""")
def citation_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Out- and in-edges of every work; a work stands for a reference of the next year's works in its journal."""
    works = table(spark, d, "embedded_metadata").select("attachment_key", F.nullif("publication", F.lit("")).alias("venue"), F.substring("pub_date", 1, 4).alias("y")).where(F.col("y").rlike("^[0-9]{4}$"))
    # counted by journal and year, so no pair of works is ever enumerated
    size = works.groupBy("venue", F.col("y").cast("int").alias("y")).agg(F.count("*").alias("n"))
    step = lambda by, name: size.select("venue", (F.col("y") + by).alias("y"), F.col("n").alias(name))
    own = works.select("attachment_key", "venue", F.col("y").cast("int").alias("y")).join(step(-1, "after"), ["venue", "y"], "left").join(step(1, "before"), ["venue", "y"], "left")
    rows = table(spark, d, "embedded_metadata").select("attachment_key").join(own, "attachment_key", "left")
    return rows.select("attachment_key", F.coalesce("after", F.lit(0)).alias("references_made"), F.coalesce("before", F.lit(0)).alias("cited_by"))
