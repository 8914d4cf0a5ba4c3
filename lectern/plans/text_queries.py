"""Text folds, identifiers, dates, citations, geometry; and windowed counts as an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import identifiers, text
from lectern.operators import geometry, library
from lectern.plans.library_queries import _TITLE_KEY_SQL
from lectern.plans.registry import query
from lectern.plans.search_queries import _fold_sql
from lectern.sources import citations
from lectern.sources.tables import table


@query(f"SELECT item_id, {_fold_sql('title')} AS folded FROM zotero_items WHERE title IS NOT NULL")
def native_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "zotero_items").where("title is not null").select("item_id", text.fold(F.col("title")).alias("folded"))


@query("""
    SELECT creator_id, replace(replace(replace(replace(replace(replace(replace(strip_accents(last_name), 'ß', 'ss'), 'ø', 'o'), 'Ø', 'O'), 'ł', 'l'), 'Ł', 'L'), 'æ', 'ae'), 'Æ', 'AE') AS folded FROM creators
""")
def ascii_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "creators").select("creator_id", text.ascii_fold("last_name").alias("folded"))


@query(f"SELECT item_id, {_TITLE_KEY_SQL} AS key FROM zotero_items WHERE title IS NOT NULL")
def title_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "zotero_items").where("title is not null").select("item_id", text.title_key(F.col("title")).alias("key"))


@query("SELECT item_id, trim(regexp_replace(regexp_replace(notes, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'), ' ') AS plain FROM zotero_items WHERE notes IS NOT NULL")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "zotero_items").where("notes is not null").select("item_id", text.strip_tags(F.col("notes"), squeeze=True).alias("plain"))


_TEXT_SQL = r"""
    regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace({c}, '(?i)</(p|div|h[1-6]|blockquote|ul|ol|table|tr)\s*>', chr(10) || chr(10), 'g'), '(?i)<br\s*/?>|</li\s*>', chr(10), 'g'), '<[^>]*>', '', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')
"""


@query(f"SELECT item_id, {_TEXT_SQL.format(c='notes')} AS plain FROM zotero_items WHERE notes IS NOT NULL")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "zotero_items").where("notes is not null").select("item_id", text.html_to_text(F.col("notes")).alias("plain"))


@query("""
    SELECT item_id, CASE WHEN length(l) > 80 THEN substr(l, 1, 80) || '…' ELSE l END AS line
    FROM (SELECT item_id, trim(list_filter(string_split(abstract, chr(10)), lambda x: trim(x, ' ') != '')[1], ' ') AS l FROM zotero_items)
""")
def note_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "zotero_items").select("item_id", text.first_line(F.col("abstract")).alias("line"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("digest"))


@query("SELECT item_id, TRY_CAST(nullif(regexp_extract(date_added, '(?:^|[^0-9])(1[0-9]{3}|2[01][0-9]{2})(?:[^0-9]|$)', 1), '') AS INT) AS year FROM zotero_items")
def year_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "zotero_items").select("item_id", text.publication_year(F.col("date_added")).alias("year"))


@query("""
    SELECT attachment_key, CASE WHEN regexp_matches(pub_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}(\\s|$)') THEN substr(pub_date, 1, 10) ELSE pub_date END AS iso,
           CASE WHEN regexp_matches(pub_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}\\s+.') THEN regexp_extract(pub_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}\\s+(.+)$', 1) ELSE pub_date END AS display
    FROM embedded_metadata
""")
def multipart_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embedded_metadata").select("attachment_key", text.iso_part(F.col("pub_date")).alias("iso"), text.display_part(F.col("pub_date")).alias("display"))


@query("""
    SELECT item_id, nullif(regexp_extract(lower(regexp_replace(replace(doi, '%2F', '/'), '\\s', '', 'g')), '(10\\.[0-9]{4,9}/.*?)[.,;:]*$', 1), '') AS doi_key FROM zotero_items
""")
def identifier_doi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "zotero_items").select("item_id", identifiers.doi_key("doi").alias("doi_key"))


def _digit(i: int) -> str:
    return f"(CASE WHEN s[{i}] = 'X' THEN 10 ELSE coalesce(TRY_CAST(s[{i}] AS INT), 0) END)"


_TEN = " + ".join(f"{11 - i} * {_digit(i)}" for i in range(1, 11))
_THIRTEEN = " + ".join(f"{1 if i % 2 else 3} * {_digit(i)}" for i in range(1, 14))
_CHECK = " + ".join(f"{3 if i % 2 else 1} * {_digit(i)}" for i in range(1, 10))


@query(f"""
    SELECT attachment_key, CASE WHEN regexp_full_match(s, '97[89][0-9]{{10}}') AND ({_THIRTEEN}) % 10 = 0 THEN s
        WHEN regexp_full_match(s, '[0-9]{{9}}[0-9X]') AND ({_TEN}) % 11 = 0 THEN '978' || substr(s, 1, 9) || ((10 - (38 + {_CHECK}) % 10) % 10)::VARCHAR END AS isbn
    FROM (SELECT attachment_key, upper(regexp_replace(isbn, '(?i)isbn(?:-1[03])?:?|[\\s-]', '', 'g')) AS s FROM embedded_metadata)
""")
def identifier_isbn(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embedded_metadata").select("attachment_key", text.isbn13(F.col("isbn")).alias("isbn"))


@query("""
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN '2401.' || n || 'v2' WHEN 1 THEN '2401.' || n WHEN 2 THEN 'math.GT/03' || n WHEN 3 THEN '2401.' || n END AS arxiv
    FROM (SELECT event_id, lpad((event_id % 100000)::VARCHAR, 5, '0') AS n FROM events)
""")
def identifier_arxiv(spark: SparkSession, d: str) -> DataFrame:
    """Addresses, labels and both schemes of identifiers, and texts that only look like one."""
    n = F.lpad((F.col("event_id") % 100000).cast("string"), 5, "0")
    form = F.col("event_id") % 6
    raw = (
        F.when(form == 0, F.concat(F.lit("https://arxiv.org/abs/2401."), n, F.lit("v2"))).when(form == 1, F.concat(F.lit("arXiv:2401."), n))
        .when(form == 2, F.concat(F.lit("arXiv:math.GT/03"), n)).when(form == 3, F.concat(F.lit("https://arxiv.org/pdf/2401."), n, F.lit(".pdf")))
        .when(form == 4, F.concat(F.lit("version 12401."), n)).otherwise(F.concat(F.lit("2401-"), n))
    )
    return table(spark, d, "events").select("event_id", text.arxiv_id(raw).alias("arxiv"))


@query("SELECT creator_id, CASE WHEN trim(coalesce(first_name, '')) != '' AND trim(coalesce(last_name, '')) != '' THEN trim(last_name) || ', ' || trim(first_name) ELSE trim(coalesce(last_name, '')) || trim(coalesce(first_name, '')) END AS name FROM creators")
def creator_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "creators").select("creator_id", library.creator_name(F.col("first_name"), F.col("last_name")).alias("name"))


@query("SELECT creator_id, coalesce(list_bool_or([contains(lower(' ' || last_name || ' '), ' ' || m) FOR m IN [" + ", ".join(f"'{m}'" for m in text.CORPORATE) + "]]), false) AS corporate FROM creators")
def corporate_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "creators").select("creator_id", text.corporate(F.col("last_name")).alias("corporate"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::INT AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT doc_id, floor(length(text) / 4)::BIGINT AS tokens, length(text) // 4 >= 5000 AS large FROM documents")
def size_warning(spark: SparkSession, d: str) -> DataFrame:
    n = text.token_estimate(F.col("text"))
    return table(spark, d, "documents").select("doc_id", n.alias("tokens"), (n >= 5000).alias("large"))


@query("""
    SELECT item_id, title, CASE WHEN abstract IS NULL THEN '' WHEN length(abstract) > 200 THEN substr(abstract, 1, 200) || '...' ELSE abstract END AS abstract,
           coalesce(creators, 'No authors listed') AS creators FROM zotero_items
""")
def item_summary(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("abstract")
    cut = F.when(a.isNull(), "").when(F.length(a) > 200, F.concat(F.substring(a, 1, 200), F.lit("..."))).otherwise(a)
    return table(spark, d, "zotero_items").select("item_id", "title", cut.alias("abstract"), F.coalesce("creators", F.lit("No authors listed")).alias("creators"))


@query("SELECT item_id, concat_ws(chr(10) || chr(10), nullif(trim(title, ' '), ''), nullif(trim(abstract, ' '), '')) AS document FROM zotero_items")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(spark, d, "zotero_items").select("item_id", F.concat_ws("\n\n", part("title"), part("abstract")).alias("document"))


@query(r"""
    SELECT item_id, '@' || CASE item_type WHEN 'journalArticle' THEN 'article' WHEN 'book' THEN 'book' WHEN 'bookSection' THEN 'incollection' WHEN 'conferencePaper' THEN 'inproceedings'
      WHEN 'thesis' THEN 'phdthesis' WHEN 'report' THEN 'techreport' WHEN 'manuscript' THEN 'unpublished' WHEN 'webpage' THEN 'online' ELSE 'misc' END || '{' || item_key || ',' || chr(10)
      || array_to_string(list_filter([CASE WHEN coalesce(title, '') != '' THEN '  title = {' || title || '}' END, CASE WHEN coalesce(doi, '') != '' THEN '  doi = {' || doi || '}' END], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}' AS entry
    FROM zotero_items
""")
def bibtex_render(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    items = table(spark, d, "zotero_items")
    return items.select("item_id", citations.bibtex_of(F.col("item_type"), F.col("item_key"), F.col("title"), none, F.lit(None).cast("string"), F.col("doi")).alias("entry"))


_KEPT_TYPES = {"journalArticle": "journalArticle", "book": "book", "bookSection": "bookSection", "conferencePaper": "conferencePaper", "thesis": "thesis", "report": "report", "manuscript": "manuscript", "webpage": "webpage"}
_SPACES = r"CASE WHEN {c} != '' THEN trim(regexp_replace({c}, '\s+', ' ', 'g')) END"


@query(f"""
    SELECT item_id AS source_id, CASE """ + " ".join(f"WHEN item_type = '{a}' THEN '{b}'" for a, b in _KEPT_TYPES.items()) + f""" ELSE 'document' END AS item_type, item_key AS cite_key, {_SPACES.format(c='title')} AS title,
           nullif(regexp_extract(date_added, '(?:^|[^0-9])(1[0-9]{{3}}|2[01][0-9]{{2}})(?:[^0-9]|$)', 1), '') AS year, {_SPACES.format(c='doi')} AS doi, CASE WHEN coalesce(creators, '') = '' THEN 0 ELSE len(string_split(creators, '; ')) END::INT AS n_creators
    FROM zotero_items WHERE item_key IS NOT NULL
""")
def bibtex_import(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: every item rendered as BibTeX and read back."""
    items = table(spark, d, "zotero_items")
    names = F.split("creators", "; ")
    entry = citations.bibtex_of(F.col("item_type"), F.col("item_key"), F.col("title"), names, text.publication_year(F.col("date_added")), F.col("doi"))
    return citations.read_bibtex(items.select("item_id", entry.alias("entry")), "item_id", "entry").select("source_id", "item_type", "cite_key", "title", "year", "doi", F.size("creators").alias("n_creators"))


# one CSL type for each item type that has one
_CSL_OF = {v: k for k, v in reversed(citations.CSL_TYPES.items())}


@query("SELECT item_id AS source_id, item_key AS csl_id, CASE WHEN item_type IN (" + ", ".join(f"'{t}'" for t in _CSL_OF) + """) THEN item_type ELSE 'document' END AS item_type, title, doi, 'Journal of ' || item_key AS container,
           coalesce(array_to_string([regexp_replace(trim(x, ' '), ' *, *', ', ') FOR x IN string_split(creators, ';')], '|'), '') AS creators,
           nullif(regexp_extract(date_added, '(?:^|[^0-9])(1[0-9]{3}|2[01][0-9]{2})(?:[^0-9]|$)', 1), '') AS date FROM zotero_items
""")
def csl_import(spark: SparkSession, d: str) -> DataFrame:
    """Items of all types written as CSL JSON, with names, dates and containers, and read back."""
    items = table(spark, d, "zotero_items")
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in _CSL_OF.items() for x in kv])[F.col("item_type")], F.lit("other"))
    names = F.transform(F.split("creators", ";"), lambda x: F.when(F.contains(x, F.lit(",")), F.struct(F.trim(F.split(x, ",", 2)[0]).alias("family"), F.trim(F.split(x, ",", 2)[1]).alias("given"), F.lit(None).cast("string").alias("literal"))).otherwise(F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("given"), F.trim(x).alias("literal"))))
    year = text.publication_year(F.col("date_added"))
    issued = F.when(year.isNotNull(), F.struct(F.array(F.array(year)).alias("date-parts")))
    doc = F.to_json(F.struct(F.col("item_key").alias("id"), kind.alias("type"), "title", F.col("doi").alias("DOI"), F.concat(F.lit("Journal of "), "item_key").alias("container-title"), names.alias("author"), issued.alias("issued")))
    back = citations.read_csl(items.select("item_id", doc.alias("csl")), "item_id", "csl")
    return back.select("source_id", "csl_id", "item_type", "title", "doi", "container", F.coalesce(F.array_join("creators", "|"), F.lit("")).alias("creators"), "date")


@query(r"""
    SELECT parent_item_id AS source_id, nullif(title, '') AS title, nullif(pub_date, '') AS date, nullif(rtrim(regexp_extract(doi, '10\.\d{4,9}/\S+'), '.,;)'), '') AS doi,
           array_to_string(list_distinct([trim(concat_ws(' ', nullif(a.first_name, ''), a.last_name)) FOR a IN authors]).list_sort(), '|') AS authors FROM embedded_metadata
""")
def html_meta(spark: SparkSession, d: str) -> DataFrame:
    """Pages built from the embedded metadata, authors included, and read back through their meta tags."""
    pages = table(spark, d, "embedded_metadata")
    safe = lambda c: F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), '"', "&quot;")
    tag = lambda n, c: F.concat(F.lit(f'<meta name="{n}" content="'), safe(c), F.lit('">'))
    names = F.transform("authors", lambda a: tag("citation_author", F.trim(F.concat_ws(" ", F.nullif(a["first_name"], F.lit("")), a["last_name"]))))
    html = F.concat(F.lit("<html><head>"), tag("citation_title", F.col("title")), tag("citation_doi", F.col("doi")), tag("citation_date", F.col("pub_date")), F.array_join(names, ""), F.lit("</head></html>"))
    back = citations.embedded_metadata(pages.select("parent_item_id", html.alias("html")), "parent_item_id", "html")
    return back.select("source_id", "title", F.nullif("date", F.lit("")).alias("date"), "doi", F.array_join(F.array_sort("authors"), "|").alias("authors"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes on pages from the order lines: page = order, place and size from the amounts."""
    lines = table(spark, d, "lineitem")
    return lines.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("int").alias("region"), (F.col("l_quantity") / 100).cast("double").alias("x"), F.col("l_tax").cast("double").alias("y"), (F.lit(0.2) + F.col("l_discount")).cast("double").alias("w"), F.lit(0.25).alias("h"))


@query("""
    WITH b AS (SELECT l_orderkey AS page_id, l_linenumber AS n, (l_quantity / 100)::DOUBLE AS x, l_tax::DOUBLE AS y, (0.2::DOUBLE + l_discount)::DOUBLE AS w, 0.25::DOUBLE AS h FROM lineitem),
         p AS (SELECT a.page_id, a.n AS region_a, b.n AS region_b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS c, a.w * a.h + b.w * b.h AS s
               FROM b a JOIN b ON a.page_id = b.page_id AND a.n < b.n)
    SELECT page_id, region_a::INT AS region_a, region_b::INT AS region_b, round(c / (s - c), 6) AS iou FROM p
""")
def box_iou(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).select("page_id", "region", F.array("x", "y", "w", "h").alias("box"))
    pairs = b.select("page_id", F.col("region").alias("region_a"), F.col("box").alias("a")).join(b.select("page_id", F.col("region").alias("region_b"), F.col("box").alias("b")), "page_id").where("region_a < region_b")
    return pairs.select("page_id", "region_a", "region_b", F.round(geometry.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query()
def region_merge(spark: SparkSession, d: str) -> DataFrame:
    source = F.when(F.col("region") % 3 == 0, "table").when(F.col("region") % 3 == 1, "image").otherwise("drawing")
    return geometry.merge_regions(_boxes(spark, d).withColumn("source", source), 0.001, 0.9, 0.01, 0.8)


@query()
def caption_match(spark: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(spark, d)
    captions = boxes.select("page_id", F.col("region").alias("caption"), F.when(F.col("region") % 3 == 0, "table").otherwise("figure").alias("kind"), "x", (F.col("y") + F.col("h") + 0.02).alias("y"), "w", F.lit(0.03).alias("h"))
    return geometry.match_captions(boxes, captions)


@query("""
    SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'figure' WHEN 1 THEN 'figure' WHEN 2 THEN 'table' WHEN 3 THEN 'figure' END AS kind,
           CASE doc_id % 6 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN 'S' || doc_id WHEN 2 THEN doc_id || 'b' WHEN 3 THEN doc_id::VARCHAR END AS number FROM documents WHERE text IS NOT NULL
""")
def caption_parse(spark: SparkSession, d: str) -> DataFrame:
    """Captions in their usual forms ahead of each text, and sentences that only mention a figure."""
    n, form = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    head = (
        F.when(form == 0, F.concat(F.lit("Figure "), n, F.lit(". "))).when(form == 1, F.concat(F.lit("Fig. S"), n, F.lit(": "))).when(form == 2, F.concat(F.lit("TABLE "), n, F.lit("b. ")))
        .when(form == 3, F.concat(F.lit("Extended Data Fig "), n, F.lit(" : "))).when(form == 4, F.concat(F.lit("Figure "), n, F.lit(" shows "))).otherwise(F.lit("See Table 2. "))
    )
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", geometry.caption(F.concat(head, "text")).alias("c")).select("doc_id", "c.kind", "c.number")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_events(spark: SparkSession, d: str) -> DataFrame:
    """Extension: tumbling windows; the streaming form is in lectern.streaming."""
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("day"), "event_type", "n", "total")
