"""Index maintenance, incremental synchronisation and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import record_hash
from lectern.operators import indexing, passages
from lectern.plans.registry import query
from lectern.sources.tables import table


def _entries(spark: SparkSession, d: str) -> DataFrame:
    batches = table(spark, d, "prepared_batches")
    rows = batches.select("batch_id", "prepared_at", F.posexplode(F.arrays_zip("ids", "documents")).alias("pos", "e"))
    key = F.split("e.ids", "#")
    return rows.select("batch_id", "prepared_at", "pos", F.col("e.ids").alias("record_id"), key[0].alias("item_key"), key[1].cast("int").alias("idx"), F.col("e.documents").alias("text"))


_ENTRIES_SQL = """
    WITH e AS (SELECT batch_id, prepared_at, unnest(range(len(ids))) AS pos, unnest(ids) AS record_id, unnest(documents) AS text FROM prepared_batches),
         l AS (SELECT *, split_part(record_id, '#', 1) AS item_key, split_part(record_id, '#', 2)::INT AS idx FROM e
               QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY prepared_at DESC, batch_id DESC, pos DESC) = 1)
"""


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two states of an index: what all batches now give, trashed items left out, and what stood there at the start of 2022."""
    entries = _entries(spark, d)
    state = lambda rows: indexing.replay_log(rows, "record_id", ["prepared_at", "batch_id", "pos"], F.lit(False), ["item_key", "batch_id", "text"]).select("record_id", "item_key", record_hash(F.col("text"), F.col("batch_id")).alias("digest"))
    trash = table(spark, d, "zotero_items").join(table(spark, d, "deleted_items"), "item_id", "left_semi").select("item_key")
    return state(entries).join(trash, "item_key", "left_anti"), state(entries.where("prepared_at < timestamp '2022-01-01'"))


_STATE = "record_id, split_part(record_id, '#', 1) AS item_key, sha256(concat_ws(chr(31), CASE WHEN text IS NULL THEN '~' ELSE '=' || text END, '=' || batch_id)) AS digest"
_VERSIONS_SQL = f"""
    WITH e AS (SELECT batch_id, prepared_at, unnest(range(len(ids))) AS pos, unnest(ids) AS record_id, unnest(documents) AS text FROM prepared_batches),
         o AS (SELECT {_STATE} FROM e WHERE prepared_at < TIMESTAMP '2022-01-01' QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY prepared_at DESC, batch_id DESC, pos DESC) = 1),
         n AS (SELECT * FROM (SELECT {_STATE} FROM e QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY prepared_at DESC, batch_id DESC, pos DESC) = 1)
               WHERE item_key NOT IN (SELECT item_key FROM zotero_items JOIN deleted_items USING (item_id)))
"""


@query(_VERSIONS_SQL + """
    SELECT record_id, CASE WHEN o.digest IS NULL THEN 'insert' WHEN n.digest IS NULL THEN 'delete' WHEN n.digest = o.digest THEN 'same' ELSE 'update' END AS action
    FROM n FULL JOIN o USING (record_id)
""")
def change_set(spark: SparkSession, d: str) -> DataFrame:
    now, old = _versions(spark, d)
    return indexing.change_set(now, old, "record_id", "digest")


@query(_VERSIONS_SQL + "SELECT record_id, digest FROM n UNION ALL SELECT record_id, digest FROM o WHERE record_id NOT IN (SELECT record_id FROM n)")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    now, old = _versions(spark, d)
    return indexing.upsert(old, now, "record_id").select("record_id", "digest")


@query(_VERSIONS_SQL + "SELECT n.record_id, coalesce(n.digest = o.digest, false) AS reuse FROM n LEFT JOIN o USING (record_id)")
def reuse_split(spark: SparkSession, d: str) -> DataFrame:
    now, old = _versions(spark, d)
    return indexing.reuse_split(now, old, "record_id", "digest").select("record_id", "reuse")


@query(_VERSIONS_SQL + "SELECT record_id FROM o WHERE record_id IN (SELECT record_id FROM n)")
def prune_missing(spark: SparkSession, d: str) -> DataFrame:
    now, old = _versions(spark, d)
    return indexing.prune(old, now, "record_id").select("record_id")


@query(_VERSIONS_SQL + """
    SELECT count(*) FILTER (WHERE o.record_id IS NULL) AS only_a, count(*) FILTER (WHERE n.record_id IS NULL) AS only_b,
           count(*) FILTER (WHERE n.digest != o.digest) AS changed, count(*) FILTER (WHERE n.digest = o.digest) AS equal FROM n FULL JOIN o ON n.record_id = o.record_id
""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    now, old = _versions(spark, d)
    return indexing.table_difference(now, old, "record_id", ["digest"])


@query("""
    WITH x AS (SELECT item_key, item_version FROM zotero_items WHERE item_id NOT IN (SELECT item_id FROM deleted_items)), p AS (SELECT DISTINCT split_part(unnest(ids), '#', 1) AS item_key FROM prepared_batches)
    SELECT (SELECT max(item_version) FROM x) AS version, (SELECT count(*) FROM x WHERE item_key NOT IN (SELECT item_key FROM p)) AS missing, (SELECT count(*) FROM x WHERE item_key NOT IN (SELECT item_key FROM p)) = 0 AS may_advance
""")
def watermark_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether the library's version may become the watermark: only once every item outside the trash has been prepared."""
    items = table(spark, d, "zotero_items").join(table(spark, d, "deleted_items").select("item_id").distinct(), "item_id", "left_anti")
    return indexing.watermark(items.select("item_key", "item_version"), _entries(spark, d).select("item_key"), "item_key", "item_version")


@query(_ENTRIES_SQL + "SELECT record_id, batch_id, sha256(coalesce(text, '')) AS digest FROM l")
def prepared_state(spark: SparkSession, d: str) -> DataFrame:
    """The index after all prepared batches: of a record prepared again the latest counts."""
    live = indexing.replay_log(_entries(spark, d), "record_id", ["prepared_at", "batch_id", "pos"], F.lit(False), ["batch_id", "text"])
    return live.select("record_id", "batch_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query(_ENTRIES_SQL + """
    , live AS (SELECT DISTINCT record_id, item_key, idx FROM l), x AS (SELECT record_id, item_key FROM live WHERE idx < 2 AND item_key IN (SELECT item_key FROM zotero_items))
    SELECT record_id FROM live WHERE item_key IN (SELECT item_key FROM x) AND record_id NOT IN (SELECT record_id FROM x)
""")
def stale_records(spark: SparkSession, d: str) -> DataFrame:
    """Records beyond the expected ones of items that were indexed anew."""
    live = _entries(spark, d).select("record_id", "item_key", "idx").distinct()
    expected = live.where("idx < 2").join(table(spark, d, "zotero_items").select("item_key"), "item_key", "left_semi")
    return indexing.stale_records(live, expected, "item_key", "record_id").select("record_id")


@query(_ENTRIES_SQL + """
    SELECT 'duplicate_record' AS finding, (SELECT count(*) FROM (SELECT record_id FROM e GROUP BY record_id HAVING count(*) > 1)) AS n
    UNION ALL SELECT 'blank_text', (SELECT count(*) FROM e WHERE trim(coalesce(text, ''), ' ') = '')
    UNION ALL SELECT 'wrong_hash', 0
    UNION ALL SELECT 'gap_in_parent', (SELECT count(*) FROM (SELECT split_part(record_id, '#', 1) AS k FROM e GROUP BY k HAVING max(split_part(record_id, '#', 2)::INT) - min(split_part(record_id, '#', 2)::INT) + 1 != count(DISTINCT record_id)))
    UNION ALL SELECT 'no_first_record', (SELECT count(*) FROM (SELECT split_part(record_id, '#', 1) AS k FROM e GROUP BY k HAVING min(split_part(record_id, '#', 2)::INT) != 0))
    UNION ALL SELECT 'orphan_parent', (SELECT count(*) FROM (SELECT DISTINCT split_part(record_id, '#', 1) AS k FROM e) WHERE k NOT IN (SELECT item_key FROM zotero_items))
    UNION ALL SELECT 'item_without_record', (SELECT count(*) FROM zotero_items WHERE item_key NOT IN (SELECT split_part(record_id, '#', 1) FROM e))
""")
def index_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = _entries(spark, d).withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    return indexing.audit(rows, table(spark, d, "zotero_items"), "record_id", "item_key", "idx", "text", "digest")


@query("""
    SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type != 'error'
""")
def log_replay(spark: SparkSession, d: str) -> DataFrame:
    """The last operation of each key, removals left out."""
    return indexing.replay_log(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", ["event_id", "event_type"])


@query("""
    SELECT item_id, item_version FROM zotero_items WHERE item_version > 90000 OR item_id IN (SELECT item_id FROM collection_items WHERE synced_at >= TIMESTAMP '2025-06-01')
""")
def changed_since(spark: SparkSession, d: str) -> DataFrame:
    """Items changed since a version, themselves or through a child."""
    items, bridge = table(spark, d, "zotero_items"), table(spark, d, "collection_items")
    dirty = bridge.where("synced_at >= timestamp '2025-06-01'").select("item_id")
    keys = items.where("item_version > 90000").select("item_id").unionByName(dirty).distinct()
    return items.join(keys, "item_id", "left_semi").select("item_id", "item_version")


@query("""
    SELECT item_id, sha256(concat_ws(chr(31), CASE WHEN title IS NULL THEN '~' ELSE '=' || title END, CASE WHEN abstract IS NULL THEN '~' ELSE '=' || abstract END, CASE WHEN doi IS NULL THEN '~' ELSE '=' || doi END)) AS digest FROM zotero_items
""")
def record_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "zotero_items").select("item_id", record_hash(F.col("title"), F.col("abstract"), F.col("doi")).alias("digest"))


@query("""
    SELECT doc_id, CASE WHEN lang IS NULL THEN 'unlabelled' ELSE source END AS source FROM documents
""")
def patch_metadata(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    updates = docs.where("lang is null").select("doc_id", F.lit("unlabelled").alias("source"))
    return indexing.patch(docs.select("doc_id", "source"), updates, "doc_id", ["source"])


@query()
def index_records(spark: SparkSession, d: str) -> DataFrame:
    """The passage index of all items: a metadata record each, then the balanced passages of the full text."""
    items = table(spark, d, "zotero_items")
    heading = F.concat_ws("\n\n", F.trim("title"), F.trim("abstract"))
    return passages.index_records(items, "item_key", heading, F.col("fulltext")).drop("text")


_STRIPPED = r"regexp_replace(regexp_replace({c}, '^[\s\v\x1c-\x1f\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ''), '[\s\v\x1c-\x1f\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '')"


@query(f"""
    WITH t AS (SELECT doc_id, coalesce(length({_STRIPPED.format(c='text')}), 0) AS n FROM documents)
    SELECT doc_id, (CASE WHEN n = 0 THEN 0 WHEN n <= 600 THEN 1 ELSE ceil((n - 80) / 520.0) END)::BIGINT AS n, (n + CASE WHEN n > 600 THEN (ceil((n - 80) / 520.0) - 1) * 80 ELSE 0 END)::BIGINT AS chars, n::BIGINT AS covered, true AS fits FROM t
""")
def passage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Windows of every document: as few as the size allows, none too large, each but the first sharing exactly the overlap, all covering the whole text."""
    docs = table(spark, d, "documents").select("doc_id", passages.passages_of(F.col("text"), 600, 80).alias("p"))
    total = F.aggregate("p", F.lit(0), lambda s, x: s + x["end"] - x["start"])
    return docs.select(
        "doc_id", F.size("p").cast("bigint").alias("n"), total.cast("bigint").alias("chars"),
        F.coalesce(F.array_max(F.transform("p", lambda x: x["end"])) - F.array_min(F.transform("p", lambda x: x["start"])), F.lit(0)).cast("bigint").alias("covered"),
        F.forall("p", lambda x: x["end"] - x["start"] <= 600).alias("fits"),
    )


@query(f"""
    WITH t AS (SELECT item_key, length({_STRIPPED.format(c='fulltext')}) AS n, concat_ws(chr(10) || chr(10), trim(title, ' '), trim(abstract, ' ')) AS h FROM zotero_items)
    SELECT item_key, (CASE WHEN trim(h, ' ') != '' THEN 1 ELSE 0 END + CASE WHEN coalesce(n, 0) = 0 THEN 0 WHEN n <= 1500 THEN 1 ELSE ceil((n - 200) / 1300.0) END)::BIGINT AS records, coalesce(n, 0)::BIGINT AS covered FROM t
    WHERE trim(h, ' ') != '' OR coalesce(n, 0) > 0
""")
def index_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many records each item has in the passage index, and how much of its text they cover."""
    rows = index_records(spark, d)
    return rows.groupBy("item_key").agg(F.count("*").alias("records"), F.coalesce(F.max("end_char") - F.min("start_char"), F.lit(0)).cast("bigint").alias("covered"))


@query("""
    SELECT item_id, CASE WHEN contains(fulltext, chr(12)) THEN length(substr(fulltext, 1, 2000)) - length(replace(substr(fulltext, 1, 2000), chr(12), '')) + 1 END AS page
    FROM zotero_items WHERE fulltext IS NOT NULL
""")
def page_of_offset(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "zotero_items").where("fulltext is not null")
    return items.select("item_id", passages.page_of_offset(F.col("fulltext"), F.lit(2000)).alias("page"))


@query()
def snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", passages.snippet_of("archives of the harbour", F.col("text"), 200).alias("s")).select("doc_id", "s.*")


@query()
def bounded_batches(spark: SparkSession, d: str) -> DataFrame:
    """Embedding requests in files of at most 500 rows and 200,000 bytes."""
    docs = table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("bytes"))
    return indexing.bounded_batches(docs, "bytes", 500, 200_000, "doc_id")
