"""Structured, keyword, tag and vector search over library tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.identifiers import instant_micros
from lectern.functions.text import fold, search_variants, strip_tags
from lectern.operators import library, predicates, vectors
from lectern.operators.predicates import Condition, advanced_search, matches_values
from lectern.plans.registry import query
from lectern.sources.tables import table


def _fold_sql(c: str) -> str:
    """The native fold in DuckDB."""
    for a, b in (("‐", "-"), ("‑", "-"), ("‒", "-"), ("–", "-"), ("—", "-"), ("―", "-"), ("−", "-"), ("ß", "ss"), ("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("æ", "ae"), ("œ", "oe")):
        c = f"replace({c}, '{a}', '{b}')"
    return f"lower(strip_accents({c}))"


def _newest() -> list:
    """The latest in time first: times are written in several notations, so their text has no order."""
    return [instant_micros("date_modified").desc_nulls_last(), F.col("item_id").desc()]


@query("""
    SELECT doc_id, lang, n_chars FROM documents
    WHERE coalesce(lang, '') = 'en' AND n_chars > 1000 AND contains(lower(strip_accents(text)), 'harbour')
    ORDER BY n_chars DESC, doc_id LIMIT 50
""")
def adv_all(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    wanted = [Condition("lang", "is", "en"), Condition("n_chars", "isGreaterThan", "1000"), Condition("text", "contains", "harbour")]
    return advanced_search(docs, wanted, sort_by="n_chars", descending=True, tiebreak=[F.col("doc_id")], limit=50).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id FROM documents WHERE coalesce(lang, '') = 'ru' OR n_chars < 50 OR coalesce(source, '') = 'transcripts'")
def adv_any(spark: SparkSession, d: str) -> DataFrame:
    wanted = [Condition("lang", "is", "ru"), Condition("n_chars", "isLessThan", "50"), Condition("source", "is", "transcripts")]
    return advanced_search(table(spark, d, "documents"), wanted, "any").select("doc_id")


def _one(operation: str, field: str, value: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return advanced_search(table(spark, d, "zotero_items"), [Condition(field, operation, value)]).select("item_id")

    return run


def _register_one(name: str, operation: str, field: str, value: str, test: str) -> None:
    f = _one(operation, field, value)
    f.__name__ = name
    query(f"SELECT item_id FROM zotero_items WHERE {test}")(f)


_title = _fold_sql("coalesce(title, '')")
_register_one("op_is", "is", "item_type", "BOOK", "lower(coalesce(item_type, '')) = 'book'")
_register_one("op_is_not", "isNot", "item_type", "book", "lower(coalesce(item_type, '')) != 'book'")
_register_one("op_contains", "contains", "title", "Métaphor", f"contains({_title}, 'metaphor')")
_register_one("op_not_contains", "doesNotContain", "title", "the", f"NOT contains({_title}, 'the')")
_register_one("op_begins", "beginsWith", "title", "towards a", f"starts_with({_title}, 'towards a')")
_register_one("op_ends", "endsWith", "title", "ology", f"suffix({_title}, 'ology')")
_register_one("op_gt_numeric", "isGreaterThan", "item_version", "50000", "item_version > 50000")
_register_one("op_lt_numeric", "isLessThan", "library_id", "9", "library_id < 9")
_register_one("op_before", "isBefore", "date_added", "2018-06", "lower(coalesce(date_added, '')) < '2018-06'")
_register_one("op_after", "isAfter", "date_added", "2024", "CASE WHEN TRY_CAST(CASE WHEN regexp_full_match(trim(coalesce(date_added, '')), '[0-9]+') THEN trim(date_added) END AS DOUBLE) IS NOT NULL THEN TRY_CAST(trim(date_added) AS DOUBLE) > 2024 ELSE lower(coalesce(date_added, '')) > '2024' END")


def _names(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "zotero_items").select("item_id")
    names = library.creators_of_items(table(spark, d, "item_creators"), table(spark, d, "creators"))
    return items.join(names, "item_id", "left").withColumn("creator_names", F.coalesce("creator_names", F.array().cast("array<string>")))


_NAMES_SQL = """
    WITH named AS (
        SELECT DISTINCT ic.item_id, ic.order_index, ic.creator_id,
               CASE WHEN trim(coalesce(first_name, '')) != '' AND trim(coalesce(last_name, '')) != '' THEN trim(last_name) || ', ' || trim(first_name)
                    ELSE trim(coalesce(last_name, '')) || trim(coalesce(first_name, '')) END AS name
        FROM item_creators ic JOIN creators c USING (creator_id))
"""


@query(_NAMES_SQL + f"SELECT DISTINCT item_id FROM named JOIN zotero_items USING (item_id) WHERE contains({_fold_sql('name')}, 'berg')")
def multi_any(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).where(matches_values(F.col("creator_names"), Condition("creator", "contains", "berg"))).select("item_id")


@query(_NAMES_SQL + f"SELECT item_id FROM named JOIN zotero_items USING (item_id) GROUP BY item_id HAVING bool_and(NOT contains({_fold_sql('name')}, 'berg'))")
def multi_all_negated(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).where(matches_values(F.col("creator_names"), Condition("creator", "doesNotContain", "berg"))).select("item_id")


@query(_NAMES_SQL + "SELECT count(*) AS n_matching FROM (SELECT item_id FROM named JOIN zotero_items USING (item_id) GROUP BY item_id)")
def multi_missing(spark: SparkSession, d: str) -> DataFrame:
    """Items without creators match nothing, not even a negation."""
    met = _names(spark, d).where(matches_values(F.col("creator_names"), Condition("creator", "isNot", "nobody at all")))
    return met.agg(F.count("*").alias("n_matching"))


@query(f"""
    SELECT item_id FROM zotero_items
    WHERE contains({_fold_sql("concat_ws(' ', title, creators, date_added, abstract, extra, notes)")}, 'hand-written')
      AND item_id NOT IN (SELECT item_id FROM deleted_items)
    ORDER BY TRY_CAST(date_modified AS TIMESTAMP) DESC NULLS LAST, item_id DESC LIMIT 100
""")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    items = library.outside_trash(table(spark, d, "zotero_items"), table(spark, d, "deleted_items"))
    everything = [F.col(c) for c in ("title", "creators", "date_added", "abstract", "extra", "notes")]
    return items.where(predicates.keyword_match(everything, ["hand-written"])).orderBy(*_newest()).limit(100).select("item_id")


@query(f"""
    SELECT item_id FROM zotero_items
    WHERE contains({_fold_sql("concat_ws(' ', title, abstract)")}, 'hand-written reservoir')
       OR contains({_fold_sql("concat_ws(' ', title, abstract)")}, 'hand written reservoir')
       OR contains({_fold_sql("concat_ws(' ', title, abstract)")}, 'hand-written-reservoir')
""")
def keyword_variants(spark: SparkSession, d: str) -> DataFrame:
    match = predicates.keyword_match([F.col("title"), F.col("abstract")], search_variants("hand-written reservoir"))
    return table(spark, d, "zotero_items").where(match).select("item_id")


@query(f"""
    WITH stage0 AS (SELECT item_id FROM zotero_items WHERE contains({_title}, 'no such words at all')),
         stage1 AS (SELECT item_id FROM zotero_items WHERE contains({_fold_sql("coalesce(creators, '')")}, 'zzzz')),
         stage2 AS (SELECT item_id FROM zotero_items WHERE contains({_fold_sql("coalesce(abstract, '')")}, 'quarry'))
    SELECT item_id FROM stage0
    UNION ALL SELECT item_id FROM stage1 WHERE NOT EXISTS (SELECT 1 FROM stage0)
    UNION ALL SELECT item_id FROM stage2 WHERE NOT EXISTS (SELECT 1 FROM stage0) AND NOT EXISTS (SELECT 1 FROM stage1)
""")
def keyword_cascade(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "zotero_items")
    stage = lambda c, q: items.where(predicates.keyword_match([F.col(c)], [q])).select("item_id")
    return predicates.cascade([stage("title", "no such words at all"), stage("creators", "zzzz"), stage("abstract", "quarry")])


def _tags(spark: SparkSession, d: str) -> DataFrame:
    """Items with their collections' adjectives as tags."""
    bridge = library.collections_of_items(table(spark, d, "collection_items"), table(spark, d, "collections"))
    return bridge.select("item_id", F.transform("collection_names", lambda n: F.split(n, " ")[0]).alias("tags"))


_TAGS_SQL = """
    WITH t AS (SELECT DISTINCT item_id, collection_id, lower(split_part(collection_name, ' ', 1)) AS tag
               FROM (SELECT DISTINCT item_id, collection_id FROM collection_items) JOIN collections USING (collection_id)),
         s AS (SELECT item_id, list(tag) AS tags FROM t GROUP BY item_id)
    SELECT item_id FROM s WHERE
"""


@query(_TAGS_SQL + " list_contains(tags, 'annotated') AND list_contains(tags, 'rural')")
def tag_and(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).where(predicates.tag_filter(F.col("tags"), ["Annotated", "Rural"])).select("item_id")


@query(_TAGS_SQL + " list_contains(tags, 'annotated') OR list_contains(tags, 'granular')")
def tag_or(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).where(predicates.tag_filter(F.col("tags"), ["annotated OR granular"])).select("item_id")


@query(_TAGS_SQL + " (list_contains(tags, 'rural') OR list_contains(tags, 'layered')) AND NOT list_contains(tags, 'annotated')")
def tag_not(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).where(predicates.tag_filter(F.col("tags"), ["rural || layered", "-annotated"])).select("item_id")


@query("""
    SELECT item_id, regexp_replace(notes, '<[^>]*>', '', 'g') AS note FROM zotero_items
    WHERE contains(lower(regexp_replace(notes, '<[^>]*>', '', 'g')), 'reading') AND item_id NOT IN (SELECT item_id FROM deleted_items)
""")
def note_search(spark: SparkSession, d: str) -> DataFrame:
    """Notes whose text (mark-up aside) holds the words; the filter comes before any limit."""
    live = library.outside_trash(table(spark, d, "zotero_items").where("notes is not null"), table(spark, d, "deleted_items"))
    note = strip_tags(F.col("notes"))
    return live.select("item_id", note.alias("note")).where(F.contains(F.lower("note"), F.lit("reading")))


@query("""
    SELECT 'note' AS kind, item_id, substr(n, greatest(1, strpos(lower(n), 'harbour') - 100), 300) AS context
    FROM (SELECT item_id, regexp_replace(notes, '<[^>]*>', '', 'g') AS n FROM zotero_items) WHERE strpos(lower(n), 'harbour') > 0
    UNION ALL
    SELECT 'abstract', item_id, substr(abstract, greatest(1, strpos(lower(abstract), 'harbour') - 100), 300)
    FROM zotero_items WHERE strpos(lower(abstract), 'harbour') > 0
""")
def note_and_abstract_search(spark: SparkSession, d: str) -> DataFrame:
    """Hits in notes and abstracts with a window of text around the first one."""
    items = table(spark, d, "zotero_items")

    def hits(kind: str, text) -> DataFrame:
        found = items.select(F.lit(kind).alias("kind"), "item_id", text.alias("t")).withColumn("at", F.locate("harbour", F.lower("t"))).where("at > 0")
        return found.select("kind", "item_id", F.expr("substring(t, greatest(1, at - 100), 300)").alias("context"))

    return hits("note", strip_tags(F.col("notes"))).unionByName(hits("abstract", F.col("abstract")))


@query("""
    SELECT item_id, trim(regexp_extract(extra, '(?m)^Citation Key: *(.*)$', 1)) AS cite_key FROM zotero_items
    WHERE lower(trim(regexp_extract(extra, '(?m)^Citation Key: *(.*)$', 1))) IN ('ck8478', 'ck4457', 'ck2449', 'nosuchkey')
""")
def citation_key_search(spark: SparkSession, d: str) -> DataFrame:
    from lectern.functions.text import extra_value

    items = table(spark, d, "zotero_items").select("item_id", extra_value(F.col("extra"), "Citation Key", "citationkey").alias("cite_key"))
    return items.where(F.lower("cite_key").isin("ck8478", "ck4457", "ck2449", "nosuchkey"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def advanced_sort_desc(spark: SparkSession, d: str) -> DataFrame:
    return advanced_search(table(spark, d, "customer"), [], sort_by="c_acctbal", descending=True, tiebreak=[F.col("c_custkey")], limit=100).select("c_custkey", "c_acctbal")


@query("""
    SELECT collection_id, collection_name FROM collections
    WHERE contains(lower(collection_name), 'r') AND contains(lower(collection_name), 'al')
""")
def collection_name_search(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower("collection_name")
    return table(spark, d, "collections").where(F.contains(name, F.lit("r")) & F.contains(name, F.lit("al"))).select("collection_id", "collection_name")


# --- vectors ---------------------------------------------------------------------------------------------------

_COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _query_vector(spark: SparkSession, d: str, vec_id: int = 1) -> list[float]:
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


def _scored(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.withColumn("similarity", vectors.cosine_to(_query_vector(spark, d), F.col("embedding")))


@query(f"""
    SELECT e.vec_id, round({_COSINE}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q
    ORDER BY {_COSINE} DESC, e.vec_id LIMIT 10
""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_k(_scored(spark, d), 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"""
    SELECT e.vec_id, e.label, round({_COSINE}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q
    WHERE e.label IN (2, 3) ORDER BY {_COSINE} DESC, e.vec_id LIMIT 10
""")
def cosine_filtered(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_k(_scored(spark, d).where("label in (2, 3)"), 10).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"""
    SELECT vec_id, label, rank::INT AS rank FROM (
        SELECT e.vec_id, e.label, row_number() OVER (PARTITION BY e.label ORDER BY {_COSINE} DESC, e.vec_id) AS rank
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q) WHERE rank <= 5
""")
def cosine_per_library(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_k_per(_scored(spark, d), 5, "label").select("vec_id", "label", "rank")


@query(f"""
    WITH s AS (SELECT e.vec_id, e.label, {_COSINE} AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q),
         r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id) AS rk FROM s),
         f AS (SELECT label, min(rk) AS first FROM r GROUP BY label),
         b AS (SELECT first FROM f ORDER BY first LIMIT 1 OFFSET 3)
    SELECT vec_id, label FROM r WHERE rk < coalesce((SELECT first FROM b), 1000000000)
""")
def parent_prefix(spark: SparkSession, d: str) -> DataFrame:
    return vectors.parent_prefix(_scored(spark, d), 3).select("vec_id", "label")


@query(f"""
    WITH c AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx FROM embeddings),
         h AS (SELECT e.vec_id FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q ORDER BY {_COSINE} DESC, e.vec_id LIMIT 5)
    SELECT h.vec_id AS hit_id, n.vec_id, n.label FROM h JOIN c ON c.vec_id = h.vec_id JOIN c n ON n.label = c.label AND abs(n.idx - c.idx) <= 2
""")
def chunk_context(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    chunks = table(spark, d, "embeddings").select("vec_id", "label", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("idx"))
    hits = vectors.top_k(_scored(spark, d), 5).select("vec_id").join(chunks, "vec_id")
    return vectors.neighbours(chunks, hits, 2).select("hit_id", "vec_id", "label")


@query()
def grouped_support(spark: SparkSession, d: str) -> DataFrame:
    """Bounded scoring per parent: the best passage and up to two more near it that don't overlap it."""
    hits = _scored(spark, d).where("similarity is not null").withColumns({"start": (F.col("vec_id") * 120).cast("int"), "end": (F.col("vec_id") * 120 + 200).cast("int"), "label": F.col("label").cast("int")})
    return vectors.grouped_support(hits)


# The set of searches: every vector whose id is divisible by 50, against all vectors.

_PAIRS = f"SELECT q.vec_id AS query_id, e.vec_id, e.label, {_COSINE} AS sim FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q"


def _searches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return e.where("vec_id % 50 = 0").select("vec_id", "embedding"), e


@query(f"""
    SELECT query_id, vec_id, round(sim, 6) AS similarity FROM ({_PAIRS})
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 10
""")
def cosine_topk_each(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_k_each(*_searches(spark, d), 10).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"""
    SELECT query_id, vec_id, label, round(sim, 6) AS similarity FROM ({_PAIRS}) WHERE label IN (2, 3)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 10
""")
def cosine_filtered_each(spark: SparkSession, d: str) -> DataFrame:
    searches, e = _searches(spark, d)
    labels = e.where("label in (2, 3)").select("vec_id", "label")
    return vectors.top_k_each(searches, e.where("label in (2, 3)"), 10).join(labels, "vec_id").select("query_id", "vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"""
    SELECT query_id, vec_id, label, row_number() OVER (PARTITION BY query_id, label ORDER BY sim DESC, vec_id)::INT AS rank FROM ({_PAIRS})
    QUALIFY rank <= 5
""")
def cosine_per_library_each(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_k_each(*_searches(spark, d), 5, "label").select("query_id", "vec_id", "label", "rank")


@query(f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rk FROM ({_PAIRS})),
         f AS (SELECT query_id, label, min(rk) AS first FROM r GROUP BY query_id, label),
         b AS (SELECT query_id, first FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY first) = 4)
    SELECT query_id, vec_id, label FROM r LEFT JOIN b USING (query_id) WHERE rk < coalesce(first, 1000000000)
""")
def parent_prefix_each(spark: SparkSession, d: str) -> DataFrame:
    return vectors.parent_prefix_each(*_searches(spark, d), 3).select("query_id", "vec_id", "label")


@query(f"""
    WITH c AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx FROM embeddings),
         h AS (SELECT query_id, vec_id FROM ({_PAIRS}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 5)
    SELECT h.query_id, h.vec_id AS hit_id, n.vec_id, n.label FROM h JOIN c ON c.vec_id = h.vec_id JOIN c n ON n.label = c.label AND abs(n.idx - c.idx) <= 2
""")
def chunk_context_each(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    searches, e = _searches(spark, d)
    chunks = e.select("vec_id", "label", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("idx"))
    hits = vectors.top_k_each(searches, e, 5).select("query_id", "vec_id")
    near = vectors.neighbours(chunks, hits.select("vec_id").distinct().join(chunks, "vec_id"), 2)
    return hits.withColumnRenamed("vec_id", "hit_id").join(near, "hit_id").select("query_id", "hit_id", "vec_id", "label")


@query()
def grouped_support_each(spark: SparkSession, d: str) -> DataFrame:
    searches, e = _searches(spark, d)
    spans = e.withColumns({"start": (F.col("vec_id") * 120).cast("int"), "end": (F.col("vec_id") * 120 + 200).cast("int"), "label": F.col("label").cast("int")})
    return vectors.grouped_support_each(searches, spans)


@query("""
    WITH t AS (SELECT doc_id, strip_accents(lower(text)) AS f FROM documents)
    SELECT t.doc_id FROM t WHERE contains(f, 'archive') AND contains(f, 'estuar')
""")
def simple_text_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(predicates.keyword_match([F.col("text")], ["archive"]) & predicates.keyword_match([F.col("text")], ["estuar"]))
    return docs.select("doc_id")
