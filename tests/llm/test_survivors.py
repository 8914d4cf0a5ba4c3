from pathlib import Path

import pytest

from lectern.llm.survivors import latest_values, levels, merged_records, survivors

DATA = Path("/root/testdata/sf0.01")

LONG = "The survey of the harbour was mapped before the archives could be dated in full."
ROWS = [
    (1, "10.1234/a", "The whole title", LONG, "2020-01-01 00:00:00"), (2, "doi:10.1234/A.", "THE WHOLE TITLE", "n/a", "2021-01-01T00:00:00+05:00"), (3, "https://doi.example/10.1234%2Fa", "The whole ti", LONG[:40], "2024-01-01 00:00:00"),
    (4, " 10.1234/a ", "Untitled", LONG + " (truncated)", "2025-01-01 00:00:00"), (5, "10.9/b", "x", "y", None), (6, "10.77777/c", "<i>One</i>", None, None), (7, "10.77777/C", "one", "", None),
    (8, "10.77777/c", None, " ", None), (9, None, "t", "a", "2020-01-01 00:00:00"), (10, "10.1234/a", "scan0042.pdf", "[…]", "2026-01-01 00:00:00"), (11, "10.1234/a", "Newest but trashed", LONG, "2027-01-01 00:00:00"),
    (12, "10.5555/d", "Tie one", "same words here", "2020-01-01 00:00:00"), (13, "10.5555/d", "Tie two", "same words here.", "2020-01-01 00:00:00"), (12, "10.5555/d", "Tie one", "same words here", "2020-01-01 00:00:00"),
]
DDL = "item_id bigint, doi string, title string, abstract string, date_modified string, value string"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], DDL)


def test_best_values(spark):
    trash = spark.createDataFrame([(11,), (11,)], "item_id bigint")
    got = {(r["group_item_id"], r["field_name"]): r["item_id"] for r in survivors(frame(spark), trash).collect()}
    assert got[1, "title"] == 2  # the latest usable: stand-ins, file names and beginnings are passed over
    assert got[1, "abstract"] == 1
    assert got[6, "title"] in (6, 7) and (6, "abstract") not in got
    assert got[12, "title"] == 12 and got[12, "abstract"] in (12, 13)
    assert not any(g in (5, 9) for g, _ in got)


def test_merged_records_and_empty_tables(spark):
    trash = spark.createDataFrame([(11,)], "item_id bigint")
    rows = {r["group_item_id"]: r for r in merged_records(frame(spark), trash).collect()}
    assert rows[1]["title"] == "THE WHOLE TITLE" and rows[1]["abstract_item_id"] == 1 and rows[1]["n_entries"] == 5
    assert rows[6]["abstract"] is None
    assert survivors(frame(spark).limit(0), trash).count() == 0 and survivors(frame(spark), trash.limit(0)).count() > 0


def test_a_group_of_many_copies(spark):
    rows = [(i, "10.1234/hot", "A title of its own" if i % 2 else "A title", LONG, f"2020-01-{1 + i % 28:02d} 00:00:00") for i in range(600)]
    got = {r["field_name"]: r["item_id"] for r in survivors(frame(spark, rows)).collect()}
    assert got == {"title": 27, "abstract": 27}


def test_stand_ins_are_learned(spark):
    """A remark no list has, in works whose other entries differ; a true title of several works is none."""
    rows = [(10 * g + k, f"10.1234/{g}", t, None, f"202{k}-01-01 00:00:00") for g in range(5) for k, t in enumerate([f"The history of harbour number {g}", "siehe unten"])]
    rows += [(100 + 10 * g + k, f"10.9999/{g}", t, None, f"202{k}-01-01 00:00:00") for g in range(5) for k, t in enumerate(["A lasting title", "A lasting title"])]
    got = {r["group_item_id"]: r["item_id"] for r in survivors(frame(spark, rows)).collect()}
    assert got == {10 * g: 10 * g for g in range(5)} | {100 + 10 * g: 101 + 10 * g for g in range(5)}


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_recall_without_any_given_word(spark):
    items, trash = (spark.read.parquet(str(DATA / f"{t}.parquet")) for t in ("zotero_items", "deleted_items"))
    row = lambda given: {tuple(r) for r in survivors(items, trash, given=given).select("group_item_id", "field_name", "item_id").collect()}
    whole, learned = row(("untitled", "no title", "title missing", "untitled document", "ohne titel", "tba", "snapshot", "full text pdf", "n/a", "n.a", "none", "null", "tbd", "abstract", "see pdf", "keine angabe", "no abstract available", "résumé non disponible", "abstract not provided", "abstract unavailable for this entry")), row(())
    assert len(whole & learned) >= 0.9 * len(whole)


def test_levels_of_a_relation_with_a_cycle():
    got = levels({("capitals", "plain"), ("plain", "markup"), ("markup", "plain"), ("markup", "stopped")})
    assert got["capitals"] == (0, ["markup", "plain", "stopped"]) and got["stopped"][1] == [] and got["plain"] == (1, ["stopped"]) and got["stopped"][0] == 2


def test_precedence_places_undated_entries(spark):
    """Mark-up is always taken out later: an undated plain value follows a dated one with mark-up, and precedes nothing."""
    rows = [(g, "title", i, 10 + i, v, shape) for g in range(20) for i, v, shape in ((2 * g, "<i>x</i>", "markup"), (2 * g + 1, "x", "plain"))]
    rows += [(900, "title", 900, 50, "<i>y</i>", "markup"), (900, "title", 901, None, "y", "plain"), (901, "title", 910, 50, "z", "plain"), (901, "title", 911, None, "<i>z</i>", "markup")]
    rows += [(902, "title", 920, None, "<i>w</i>", "markup"), (902, "title", 921, None, "w", "plain")]
    values = spark.createDataFrame(rows, "group_item_id bigint, field_name string, item_id bigint, micros bigint, value string, shape string")
    best = lambda undated: {r["group_item_id"]: r["item_id"] for r in latest_values(values, undated).collect() if r["group_item_id"] >= 900}
    assert best("placed") == {900: 901, 901: 910, 902: 921}
    assert best("earliest") == {900: 900, 901: 910, 902: 921}
