"""The driver's queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import lookalikes, mixture, names, neardup, packing, scans, splitting, survivors
from lectern.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.damaged_lines(table(spark, d, "zotero_items"), table(spark, d, "lexicon"))


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired_texts(table(spark, d, "zotero_items"), table(spark, d, "lexicon"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    cut = splitting.split_records(_oversized(spark, d))
    return cut.select("field_name", "record_key").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(_oversized(spark, d))


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of every cut record keep: the whole text, within the limit, with the exact overlap."""
    limits = table(spark, d, "size_limits")
    rows = splitting.pieces(_oversized(spark, d)).join(F.broadcast(limits), "field_name")  # two settings
    size, fresh = F.col("end_char") - F.col("start_char"), F.col("end_char") - F.col("start_char") - F.col("overlap_chars")
    return rows.groupBy("field_name", "record_key").agg(
        (F.max("end_char") - F.min("start_char")).cast("bigint").alias("covered"), (F.sum(fresh) + F.max("overlap_chars")).cast("bigint").alias("fresh"),
        F.bool_and((size <= F.col("max_chars")) & (F.length("piece") == size)).alias("fits"), (F.max("piece_no") == F.count("*")).alias("numbered"),
    )


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_records(table(spark, d, "zotero_items"), table(spark, d, "prepared_batches"), table(spark, d, "size_limits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(table(spark, d, "creators"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return names.name_classes(table(spark, d, "creators"))


def _similar(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, d, "zotero_items").select(F.col("item_id").alias("id"), "title", "abstract")
    return neardup.similar_pairs(items, threshold=0.6, words=3, least_words=30)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = _similar(spark, d)
    return neardup.expand(pairs, members).select(F.col("a").alias("item_id_a"), F.col("b").alias("item_id_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row an item at the library's usual setting: five words, similarity 0.8."""
    items = table(spark, d, "zotero_items").select(F.col("item_id").alias("id"), "title", "abstract")
    return neardup.classes(*neardup.similar_pairs(items, threshold=0.8, words=5, least_words=30)).select(F.col("id").alias("item_id"), "class_id", "links")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    best = survivors.survivors(table(spark, d, "zotero_items"), table(spark, d, "deleted_items"))
    return best.select("group_item_id", "field_name", "item_id")


def p5_currency(spark: SparkSession, d: str) -> DataFrame:
    """As p5_found, but entries without a time are placed by the learned precedence."""
    best = survivors.survivors(table(spark, d, "zotero_items"), table(spark, d, "deleted_items"), undated="placed")
    return best.select("group_item_id", "field_name", "item_id")


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return survivors.merged_records(table(spark, d, "zotero_items"), table(spark, d, "deleted_items"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.assign_containers(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Fill by capacity, for differencing alone and with the refill."""
    docs, capacities = table(spark, d, "documents"), table(spark, d, "pack_capacities")
    of = lambda refill, name: packing.container_report(packing.assign_containers(docs, capacities, refill=refill), capacities).withColumn("method", F.lit(name))
    return of(False, "differencing").unionByName(of(True, "with refill"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.draw_mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture_report(p7_mixture(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_looking_pairs(table(spark, d, "documents"))


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.canonical_text(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.col("canonical").alias("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


_TEXTS_SQL = r"""
            WITH limits AS (SELECT field_name, min(max_chars) AS m FROM size_limits GROUP BY field_name),
            entries AS (
                SELECT unnest(ids) AS record_key, unnest(documents) AS text, unnest(range(len(ids))) AS pos, batch_id, prepared_at
                FROM prepared_batches),
            latest AS (
                SELECT record_key, text FROM entries
                QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY prepared_at DESC NULLS LAST, batch_id DESC, pos DESC) = 1),
            texts AS (
                SELECT 'fulltext' AS field_name, item_key AS record_key, fulltext AS text FROM zotero_items
                UNION ALL SELECT 'documents', record_key, text FROM latest)
"""
_LENGTH_SQL = r"""length(regexp_replace(regexp_replace(text,
                '^[\s\v\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ''),
                '[\s\v\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', ''))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_coverage": _TEXTS_SQL + f"SELECT field_name, record_key, max(n) AS covered, max(n) AS fresh, true AS fits, true AS numbered FROM (SELECT field_name, record_key, m, {_LENGTH_SQL} AS n FROM texts JOIN limits USING (field_name)) WHERE n > m GROUP BY ALL",
        "p4_classes": r"""
            WITH RECURSIVE t AS (SELECT item_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || abstract), '[\p{L}\p{N}]+') AS w
                       FROM zotero_items WHERE abstract IS NOT NULL AND regexp_matches(abstract, '\S')),
                 s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS run FROM t WHERE len(w) >= 30),
                 n AS (SELECT item_id, count(*) AS n, md5(string_agg(run, '|' ORDER BY run)) AS h FROM s GROUP BY item_id),
                 c AS (SELECT a.item_id AS x, b.item_id AS y, count(*) AS c FROM s a JOIN s b ON a.run = b.run AND a.item_id != b.item_id GROUP BY 1, 2),
                 e AS (SELECT x, y, nb.h AS hy, na.h AS hx FROM c JOIN n na ON na.item_id = x JOIN n nb ON nb.item_id = y WHERE c >= 0.8 * (na.n + nb.n - c) - 1e-9),
                 r AS (SELECT item_id AS id, item_id AS root FROM n UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.root),
                 k AS (SELECT id, min(root) AS class_id FROM r GROUP BY id),
                 l AS (SELECT x, count(DISTINCT hy) AS links FROM e WHERE hx != hy GROUP BY x)
            SELECT id AS item_id, class_id, coalesce(links, 0) AS links FROM k LEFT JOIN l ON l.x = k.id
        """,
        "p2_found": r"""
            WITH limits AS (SELECT field_name, min(max_chars) AS m FROM size_limits GROUP BY field_name),
            entries AS (
                SELECT unnest(ids) AS record_key, unnest(documents) AS text, unnest(range(len(ids))) AS pos, batch_id, prepared_at
                FROM prepared_batches),
            latest AS (
                SELECT record_key, text FROM entries
                QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY prepared_at DESC NULLS LAST, batch_id DESC, pos DESC) = 1),
            texts AS (
                SELECT 'fulltext' AS field_name, item_key AS record_key, fulltext AS text FROM zotero_items
                UNION ALL SELECT 'documents', record_key, text FROM latest)
            SELECT DISTINCT field_name, record_key FROM texts JOIN limits USING (field_name)
            WHERE length(regexp_replace(regexp_replace(text,
                '^[\s\v\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ''),
                '[\s\v\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '')) > m
        """,
        "p4_found": r"""
            WITH t AS (SELECT item_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || abstract), '[\p{L}\p{N}]+') AS w
                       FROM zotero_items WHERE abstract IS NOT NULL AND regexp_matches(abstract, '\S')),
                 s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM t WHERE len(w) >= 30),
                 n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id),
                 c AS (SELECT a.item_id AS x, b.item_id AS y, count(*) AS c FROM s a JOIN s b ON a.run = b.run AND a.item_id < b.item_id GROUP BY 1, 2)
            SELECT x AS item_id_a, y AS item_id_b FROM c JOIN n na ON na.item_id = x JOIN n nb ON nb.item_id = y WHERE c >= 0.6 * (na.n + nb.n - c) - 1e-9
        """,
    }
