"""A value of one character is no beginning of itself."""

from lectern.llm.survivors import survivors


def test_one_character_survives_unless_something_fuller_is_there(spark):
    rows = [
        (1, "10.1234/a", "X.", None, "2020-01-01 00:00:00"), (2, "10.1234/a", "X", None, "2021-01-01 00:00:00"),
        (3, "10.1234/b", "X", None, "2021-01-01 00:00:00"), (4, "10.1234/b", "Xylem", None, "2020-01-01 00:00:00"),
        (5, "10.1234/c", ";", None, "2021-01-01 00:00:00"), (6, "10.1234/c", "Y", None, "2020-01-01 00:00:00"),
    ]
    df = spark.createDataFrame(rows, "item_id bigint, doi string, title string, abstract string, date_modified string")
    assert {r["group_item_id"]: r["item_id"] for r in survivors(df).collect()} == {1: 2, 3: 4, 5: 6}
