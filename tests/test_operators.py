import pytest
from pyspark.sql import functions as F

from lectern.functions import identifiers, text
from lectern.operators import duplicates, edits, geometry, hierarchy, indexing, library, passages, vectors
from lectern.sources import citations


def test_passages_have_the_expected_bounds():
    assert passages.passage_spans("x" * 6575, 6000, 750) == [(0, 3662), (2912, 6575)]
    assert passages.passage_spans("a" * 3400 + "\n\n" + "b" * 3173, 6000, 750) == [(0, 3402), (2652, 6575)]
    assert len(passages.passage_spans("word " * 5000, 100, 10, 7)) == 7
    assert passages.passage_spans("", 10, 2) == [] and passages.passage_spans("abc", 10, 20) == [(0, 3)]
    assert passages.passage_spans("x" * 1000, 100, 500, 20)[-1][1] <= 1000


def test_index_records_number_and_page(spark):
    df = spark.createDataFrame([("K1", "Title", "one. " * 500 + "\f" + "two. " * 500), ("K2", None, None), ("K3", " ", "short")], "k string, h string, b string")
    rows = passages.index_records(df, "k", F.col("h"), F.col("b"), 1500, 200).orderBy("k", "idx").collect()
    k1 = [r for r in rows if r["k"] == "K1"]
    assert k1[0]["kind"] == "metadata" and k1[0]["record_id"] == "K1#0" and {r["n_records"] for r in k1} == {len(k1)}
    assert k1[1]["page"] == 1 and k1[-1]["page"] == 2
    assert not [r for r in rows if r["k"] == "K2"] and [r["kind"] for r in rows if r["k"] == "K3"] == ["body"]


def test_snippet_and_fuzzy_location():
    body = "filler words " * 60 + "the hidden harbour archive of harbour" + " more filler" * 60
    window, at = passages.snippet("harbour archive", body, 120)
    assert "harbour archive" in window and body[at:].startswith(window[:10])
    assert passages.snippet("zz", body, 50) == (body[:50].strip(), 0) and passages.snippet("a", None) == ("", 0)
    assert passages.fuzzy_locate("abc the quick brown fox jumps", "quick brown fox")[1] == 1.0
    assert passages.fuzzy_locate("abc the qu1ck brovvn fox jumps over it", "the quick brown fox jumps over")[0] in range(0, 9)
    assert passages.fuzzy_locate("nothing here", "something completely different") is None


def test_identifiers(spark):
    rows = [
        ("https://doi.example/10.99001%2FReg.1990.A ", "10.99001/reg.1990.a"), ("DOI: 10.1234/ab(c)d).", "10.1234/ab(c)d"), ("10.1234/x(1)", "10.1234/x(1)"),
        ("no identifier", None), ("", None), (None, None), ("100%", None), (" “10.5555/Q7;” ", "10.5555/q7"),
    ]
    df = spark.createDataFrame(rows, "d string, want string").select(identifiers.doi_key("d").alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())
    times = spark.createDataFrame([("2024-08-23T00:58:16+10:00",), ("2024-08-22 14:58:16",), ("2024-08-22T14:58:16.000Z",), ("junk",), (None,)], "t string")
    got = [r["m"] for r in times.select(identifiers.instant_micros("t").alias("m")).collect()]
    assert got[0] == got[1] == got[2] and got[3:] == [None, None]
    isbn = spark.createDataFrame([("0-306-40615-2",), ("978-0-306-40615-7",), ("978-0-306-40615-8",), ("",), (None,)], "s string")
    assert [r["x"] for r in isbn.select(text.isbn13(F.col("s")).alias("x")).collect()] == ["9780306406157", "9780306406157", None, None, None]
    arx = spark.createDataFrame([("arXiv:2401.01234v2",), ("https://arxiv.org/abs/hep-th/9901001",), ("12345",)], "s string")
    assert [r["x"] for r in arx.select(text.arxiv_id(F.col("s")).alias("x")).collect()] == ["2401.01234v2", "hep-th/9901001", None]


def test_text_functions(spark):
    df = spark.createDataFrame([("<p>One</p><ul><li>a</li><li>b &amp; c</li></ul>",)], "h string")
    assert df.select(text.html_to_text(F.col("h")).alias("x")).first()["x"] == "One\n\na\nb & c"
    t = spark.createDataFrame([("The  Métaphor, Revisited!",), ("metaphor revisited",), ("A An the X",)], "t string")
    assert [r["x"] for r in t.select(text.title_key(F.col("t")).alias("x")).collect()] == ["métaphor revisited", "metaphor revisited", "x"]
    y = spark.createDataFrame([("2025-00-00 2025",), ("c. 1899",), ("12345",), (None,)], "d string")
    assert [r["x"] for r in y.select(text.publication_year(F.col("d")).alias("x")).collect()] == [2025, 1899, None, None]
    assert "hand written" in text.search_variants("hand-written") and "Mueller" in text.search_variants("Müller")
    n = spark.createDataFrame([("1_000",), ("1d",), (" 2.5 ",), ("1__0",)], "s string")
    assert [r["x"] for r in n.select(text.number_or_null(F.col("s")).alias("x")).collect()] == [1000.0, None, 2.5, None]


def test_hierarchy_survives_cycles_and_missing_parents(spark):
    rows = [(1, None, "root", "K1"), (2, 1, "mid", "K2"), (3, 2, "leaf", "K3"), (4, 5, "x", "K4"), (5, 4, "y", "K5"), (6, 99, "lost", "K6"), (3, 2, "leaf", "K3")]
    c = spark.createDataFrame(rows, "collection_id bigint, parent_collection_id bigint, collection_name string, collection_key string")
    closure = {(r["root_id"], r["collection_id"]) for r in hierarchy.descendants(c, c).collect()}
    assert {(1, 3), (1, 1), (4, 5), (5, 4)} <= closure and (6, 99) not in closure
    path = {r["collection_id"]: r["path"] for r in hierarchy.paths(c).collect()}
    assert path[3] == "root / mid / leaf" and path[6] == "lost"
    found = {r["spec"]: (r["collection_id"], r["n_matches"]) for r in hierarchy.resolve_specs(c.distinct(), ["K2", "mid / LEAF", "none"]).collect()}
    assert found == {"K2": (2, 1), "mid / LEAF": (3, 1), "none": (None, 0)}


def test_vectors_and_parent_prefix(spark):
    names = [("A", s) for s in (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)] + [("B", 0.55)]
    df = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(names)], "vec_id int, label string, similarity double")
    assert [r["vec_id"] for r in vectors.parent_prefix(df, 1).orderBy("vec_id").collect()] == [0, 1, 2, 3]
    assert vectors.parent_prefix(df, 2).count() == 9 and vectors.parent_prefix(df.limit(0), 2).count() == 0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "vec_id int, e array<float>")
    one = {r["vec_id"]: r["s"] for r in v.select("vec_id", vectors.cosine_to([1.0, 0.0], F.col("e")).alias("s")).collect()}
    two = {r["vec_id"]: r["s"] for r in v.select("vec_id", vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.col("e")).alias("s")).collect()}
    assert one == two == {1: 1.0, 2: 0.0, 3: None, 4: None, 5: None}


def test_supports_don_t_overlap_and_are_capped(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, 0, 100), (1, 2, 0.85, 10, 110), (1, 3, 0.8, 200, 300), (1, 4, 0.2, 400, 500), (2, 5, 0.95, 0, 10)], "label int, vec_id int, similarity double, start int, end int")
    got = {r["label"]: (r["score"], r["n_support"]) for r in vectors.grouped_support(hits).collect()}
    assert got == {1: (0.98, 2), 2: (0.95, 1)}


def test_index_maintenance_is_idempotent(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "k string, h string")
    acts = {r["k"]: r["action"] for r in indexing.change_set(new, old, "k", "h").collect()}
    assert acts == {"a": "same", "b": "update", "c": "delete", "d": "insert"}
    assert {r["action"] for r in indexing.change_set(new, new, "k", "h").collect()} == {"same"}
    log = spark.createDataFrame([("x", 1, "add"), ("x", 2, "del"), ("y", 3, "add"), ("x", 2, "del")], "k string, s int, op string")
    assert [r["k"] for r in indexing.replay_log(log, "k", ["s"], F.col("op") == "del", ["op"]).collect()] == ["y"]
    with pytest.raises(Exception, match="exceeds"):
        indexing.bounded_batches(spark.createDataFrame([(1, 99)], "i int, n int"), "n", 5, 10, "i").collect()


def test_duplicates_keeper_and_fill(spark):
    df = spark.createDataFrame([(1, "book", "k", None, "2020"), (2, "book", "k", "abs", None), (3, "book", "z", "q", None)], "item_id bigint, item_type string, key string, abstract string, date_added string")
    keep = duplicates.keepers(df, F.col("key"), F.lit(0), F.col("abstract").isNotNull(), F.col("date_added")).collect()
    assert [(r["key"], r["keeper"]) for r in keep] == [("k", 2)]
    filled = duplicates.merge_fill(df.where("key = 'k'").withColumn("keeper", F.lit(1)), "key", "keeper", ["abstract"], [F.col("item_id")]).first()
    assert filled["abstract"] == "abs"


def test_edits(spark):
    df = spark.createDataFrame([("Shelf: A\nfree line\nSHELF: B",), ("",), (None,)], "e string")
    assert [r["x"] for r in df.select(edits.set_extra(F.col("e"), "Shelf", "Z").alias("x")).collect()] == ["Shelf: Z\nfree line", "Shelf: Z", "Shelf: Z"]
    assert [r["x"] for r in df.select(edits.set_extra(F.col("e"), "shelf", None).alias("x")).collect()] == ["free line", "", ""]
    t = spark.createDataFrame([(["b", "a"],), (None,)], "t array<string>")
    assert [r["x"] for r in t.select(edits.edit_tags(F.col("t"), ["a", "n"], ["a"]).alias("x")).collect()] == [["b", "a", "n"], ["a", "n"]]
    assert [r["x"] for r in t.select(edits.edit_annotation_tags(F.col("t"), ["n"], ["n", "b"]).alias("x")).collect()] == [["a"], []]


def test_geometry_and_limits(spark):
    df = spark.createDataFrame([([0.0, 0.0, 1.0, 1.0], [0.5, 0.0, 1.0, 1.0]), ([0.0, 0.0, 1.0, 1.0], [3.0, 0.0, 1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(F.round(geometry.iou(F.col("a"), F.col("b")), 6).alias("i"), geometry.near(F.col("a"), F.col("b"), 0.1).alias("n")).collect()
    assert [(r["i"], r["n"]) for r in got] == [(0.333333, True), (0.0, False)]
    assert [library.normalize_limit(x, 10, 50) for x in (None, 0, -3, "7", 99, "x")] == [10, 10, 10, 7, 50, 10]


def test_citation_parsers(spark):
    text_ = "@article{k1, title = {The {Great} \"Day\"}, author={Doe, Jane and {World Org} and John Smith}, year = 2001, journal = \"J\" # { X}}\n@comment{x}\n@book{,title={T}}"
    first, second = citations.parse_bibtex(text_)
    assert first["fields"]["title"] == 'The Great "Day"' and first["fields"]["journal"] == "J X" and second["cite_key"] == ""
    assert citations.split_authors(first["fields"]["author"]) == [("Jane", "Doe"), ("", "World Org"), ("John", "Smith")]
    assert citations.parse_bibtex(None) == [] and citations.parse_bibtex("@article{k, title={open") != []
    assert citations.meta_tags('<meta name="DC.title" content="T"><meta property="og:title" content="O">') == {"dc.title": ["T"], "og:title": ["O"]}
