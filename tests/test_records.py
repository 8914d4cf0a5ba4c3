"""Records, coercions, returned batches, trees and versions on small inputs."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import coercion, schema
from lectern.operators import batches, geometry, hierarchy, indexing, passages, records
from lectern.streaming.sync import VersionedTable


def one(spark, column, **values):
    ddl = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], ddl).select(column.alias("v")).first()["v"]


def test_lists_and_tags_in_every_shape():
    assert coercion.as_list(None) == [] and coercion.as_list("a, b,, c ") == ["a", "b", "c"] and coercion.as_list('["x", " y "]') == ["x", "y"] and coercion.as_list(["p", None, ""]) == ["p"]
    assert coercion.as_tags("a, b") == ["a, b"] and coercion.as_tags('[{"tag": "x"}, "y", "x"]') == ["x", "y"] and coercion.as_tags({"tag": "z"}) == ["z"] and coercion.as_tags("") == []
    with pytest.raises(TypeError):
        coercion.as_list({"a": 1})


def test_strings(spark):
    c = F.col("s")
    name = lambda s: tuple(one(spark, coercion.split_name(c), s=s))
    assert name("Doe, Jane Q.") == ("Jane Q.", "Doe") and name("Jane Q. Doe") == ("Jane Q.", "Doe") and name("Plato") == ("", "Plato")
    urls = {s: one(spark, coercion.looks_like_url(c), s=s) for s in ("https://a.b/c", "a.org", "localhost:80/x", "no url", "ftp://a.b", "word", "10.1/x y", None, "http://u@h.de:8?q")}
    assert urls == {"https://a.b/c": True, "a.org": True, "localhost:80/x": True, "no url": False, "ftp://a.b": False, "word": False, "10.1/x y": False, None: False, "http://u@h.de:8?q": True}
    dates = {s: one(spark, coercion.as_iso_date(c), s=s) for s in ("2008/03", "1999-8-5", "March 2001", "5 Dec 1977", "n.d.", "2001-13", "in press 2020", None)}
    assert dates == {"2008/03": "2008-03", "1999-8-5": "1999-08-05", "March 2001": "2001-03", "5 Dec 1977": "1977-12", "n.d.": None, "2001-13": "2001", "in press 2020": "2020", None: None}
    assert one(spark, coercion.add_citekey(c, F.lit("k1")), s="@article{,\n  title = {x}}") == "@article{k1,\n  title = {x}}"
    assert one(spark, coercion.add_citekey(c, F.lit("k1")), s="@book{old,\n}") == "@book{old,\n}" and one(spark, coercion.colour_name(c), s="#FFD400") == "Yellow"
    assert one(spark, coercion.split_keywords(c), s="a, b; c;; a, b") == ["a, b", "c"] and one(spark, coercion.split_keywords(c), s="a, b,a") == ["a", "b"]


def test_schema_round_trip(spark):
    rows = [(t, g, own) for t, fields in schema.TYPE_FIELDS.items() for g, own in fields.items()]
    df = spark.createDataFrame(rows, "t string, g string, own string")
    got = df.select("t", "g", "own", schema.typed_field(F.col("t"), F.col("g")).alias("a"), schema.generic_field(F.col("t"), F.col("own")).alias("b")).collect()
    assert all(r["a"] == r["own"] and r["b"] == r["g"] for r in got)
    assert one(spark, schema.typed_field(F.col("t"), F.lit("title")), t=None) == "title"


def test_page_of_an_annotation(spark):
    rows = [(3, None), (0, None), (None, '{"pageIndex": 7}'), (None, '{"pageIndex": true}'), (None, "broken"), (None, None), (None, '{"pageIndex": "4x"}')]
    df = spark.createDataFrame(rows, "p int, j string").select(records.page_index(F.col("p"), F.col("j")).alias("v"))
    assert [r["v"] for r in df.collect()] == [2, 0, 7, None, None, None, None]


def test_result_lines_of_a_service(spark):
    lines = [
        '{"custom_id": "a#0", "response": {"status_code": 200, "body": {"data": [{"embedding": [0.5, 1]}]}}, "error": null}', '{"custom_id": "b#0", "response": {"status_code": 500, "body": null}, "error": null}',
        '{"custom_id": "c#0", "response": null, "error": {"code": "expired"}}', '{"custom_id": "d#0", "response": {"status_code": 200, "body": {"data": []}}}', "", "  ",
    ]
    got = {r["custom_id"]: (r["embedding"], r["failure"]) for r in batches.parse_results(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got["a#0"] == ([0.5, 1.0], None) and got["b#0"] == (None, "status 500") and "expired" in got["c#0"][1] and got["d#0"] == (None, "no embedding") and len(got) == 4


def test_conflicts_and_whole_batches(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "5")], "k string, digest string")
    sent = spark.createDataFrame([("a", "1", "2"), ("b", "1", "2"), ("c", "4", "5"), ("d", "1", "2"), ("e", None, "2")], "k string, baseline string, submitted string")
    assert {tuple(r) for r in batches.conflicts(now, sent, "k").collect()} == {("b", "changed"), ("d", "missing")}
    rows = spark.createDataFrame([(1, "x", "t", 1), (1, "y", None, 1), (2, "x", "u", 2), (2, "z", "v", 2)], "b int, k string, t string, s int")
    got = batches.import_batches(rows, "b", "k", F.col("t").isNull(), F.col("s"))
    assert {(r["k"], r["t"]) for r in got.collect()} == {("x", "u"), ("z", "v")}


def test_relations_and_scopes(spark):
    items = spark.createDataFrame([(1, "AAAA", 5, "one"), (2, "BBBB", 5, "two"), (3, "BBBB", 6, "other")], "item_id bigint, item_key string, library_id bigint, title string")
    uris = spark.createDataFrame([(1, "http://x/groups/5/items/BBBB"), (1, "http://x/groups/5/items/BBBB"), (1, "http://x/groups/6/items/BBBB"), (1, "http://x/groups/5/items/AAAA"), (1, "junk")], "item_id bigint, uri string")
    assert [tuple(r) for r in records.related_items(uris, items).collect()] == [(1, 2, "two")]
    libraries = spark.createDataFrame([("user", 1, 1), ("group", 7, 2), ("group", 7, 3), ("feed", 8, 4)], "library_type string, external_id bigint, library_id bigint")
    asked = spark.createDataFrame([("users", 1), ("group", 7), ("group", 9)], "library_type string, external_id bigint")
    assert {r["state"] for r in records.resolve_libraries(asked, libraries).collect()} == {"found", "ambiguous", "unknown"}
    assert records.search_scope(libraries).count() == 3 and records.search_scope(libraries, 0).count() == 1 and records.search_scope(libraries, 7).count() == 2


def test_a_tree_of_two_hundred_levels(spark):
    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(200)] + [(500, 501, "x"), (501, 500, "y"), (600, 999, "orphan"), (601, 601, "self")]
    tree = spark.createDataFrame(rows, "collection_id bigint, parent_collection_id bigint, collection_name string")
    below = {r["collection_id"]: r["depth"] for r in hierarchy.descendants(tree, tree.where("collection_id = 0")).collect()}
    assert below == {i: i for i in range(200)}
    got = {r["collection_id"]: (r["path"], r["n_levels"]) for r in hierarchy.paths(tree).collect()}
    assert got[199][1] == 200 and got[3][0] == "n0 / n1 / n2 / n3" and got[500] == ("y / x", 2) and got[600] == ("orphan", 1) and got[601] == ("self", 1)


def test_a_version_survives_a_crash(spark, tmp_path):
    target = VersionedTable(spark, str(tmp_path / "t"))
    assert target.read() is None
    target.write(spark.range(3), 1)
    spark.range(9).write.parquet(str(tmp_path / "t" / "v2"))  # the state of a batch that died before its marker
    assert target.version() == 1 and target.read().count() == 3
    target.write(spark.range(5), 2)
    target.write(spark.range(6), 3)
    assert target.read().count() == 6 and target.versions() == [2, 3]
    target.write(spark.range(6), 3)  # run again
    assert target.read().count() == 6


def test_files_don_t_depend_on_partitions(spark):
    rows = spark.range(500).select("id", (F.col("id") % 7 * 10).alias("b"))
    cut = lambda df: {r["id"]: r["batch"] for r in indexing.bounded_batches(df, "b", 20, 300, "id", files=4).collect()}
    one_way = cut(rows.coalesce(1))
    assert one_way == cut(rows.repartition(5))
    sizes = {}
    for i, b in one_way.items():
        n, v = sizes.get(b, (0, 0))
        sizes[b] = (n + 1, v + i % 7 * 10)
    assert all(n <= 20 and v <= 300 for n, v in sizes.values()) and len({b.split("-")[0] for b in one_way.values()}) > 1


def test_locating_text():
    body = "Some words before. The   river\nwas mapped\tbefore the harbour. And after."
    a, b = passages.squeezed_locate(body, "the river was MAPPED")
    assert body[a:b].split() == ["The", "river", "was", "mapped"] and passages.squeezed_locate(body, "absent") is None and passages.squeezed_locate(None, "x") is None
    assert passages.page_order(3, 5) == [3, 2, 4, 1] and passages.page_order(0, 1) == [0]
    long = "alpha beta gamma delta epsilon zeta eta theta iota"
    assert passages.anchor(long) == "alpha beta gamma delta epsilon zeta eta" and long.endswith(passages.anchor(long, at_start=False)) and passages.anchor("short") == "short"
    pages = ["nothing here", "x " * 50 + long * 4, long.replace("gamma", "gamna")]
    assert passages.locate_on_pages(pages, 0, long * 4)[0] == 1 and passages.locate_on_pages(pages, 0, long * 4)[3] == "anchors"
    assert passages.locate_on_pages(pages[::2], 0, long)[3] == "alike" and passages.locate_on_pages(["", ""], 0, "zzz") is None


def test_fuzzy_location_is_the_same_in_long_texts():
    pattern = "the survey of the harbour was mapped before the archives could be dated"
    near = pattern.replace("harbour", "harbuor").replace("dated", "date")
    short, long = "q" * 37 + near + "q" * 50, "q" * 9037 + near + "q" * 9000
    assert passages.fuzzy_locate(long, pattern)[0] - 9000 == passages.fuzzy_locate(short, pattern)[0]
    assert passages.fuzzy_locate(long, pattern)[1] == passages.fuzzy_locate(short, pattern)[1]


def test_tables_stay_apart_and_captions_have_their_place(spark):
    boxes = [(1, "table", 0.1, 0.1, 0.3, 0.1), (1, "image", 0.1, 0.21, 0.3, 0.1), (1, "drawing", 0.1, 0.315, 0.3, 0.1), (1, "image", 0.1, 0.1, 0.3, 0.1)]
    df = spark.createDataFrame(boxes, "page_id bigint, source string, x double, y double, w double, h double")
    got = [(r["source"], round(r["h"], 3)) for r in geometry.merge_regions(df, 0.001, 0.9, 0.02, 0.8).orderBy("region").collect()]
    assert got == [("table", 0.1), ("merged", 0.205)]
    regions = spark.createDataFrame([(1, 1, 0.1, 0.2, 0.4, 0.2), (1, 2, 0.1, 0.5, 0.4, 0.2)], "page_id bigint, region int, x double, y double, w double, h double")
    captions = spark.createDataFrame([(1, 1, "figure", 0.1, 0.43, 0.4, 0.03)], "page_id bigint, caption int, kind string, x double, y double, w double, h double")
    row = geometry.match_captions(regions, captions).first()
    assert row["region"] == 1 and row["confidence"] == "high"
    assert geometry.match_captions(regions, captions.withColumn("kind", F.lit("table"))).first()["region"] == 2
