import itertools

import pytest
from pyspark.sql import functions as F

from lectern.operators.predicates import NEGATED, OPERATIONS, Condition, advanced_search, cascade, compare, keyword_match, matches_scalar, matches_values, tag_filter

VALUES = ["", "10", "9", "1_000", "1d", "inf", "Über–Maß", "Zebra", "2024-01-01", " 7 "]
WANTED = ["", "10", "2024", "uber", "zebra", "9.5"]


def naive_number(s):
    import re

    s = s.strip(" ")
    return float(s.replace("_", "")) if re.fullmatch(r"[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+)?", s) else None


def naive_fold(s):
    import unicodedata

    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return s.replace("–", "-").replace("ß", "ss").lower()


def naive(value, wanted, op):
    a, b = naive_fold(value), naive_fold(wanted)
    if op in ("is", "isNot"):
        return (a == b) == (op == "is")
    if op in ("contains", "doesNotContain"):
        return (b in a) == (op == "contains")
    if op == "beginsWith":
        return a.startswith(b)
    if op == "endsWith":
        return a.endswith(b)
    x, y = naive_number(value), naive_number(wanted)
    if x is not None and y is not None:
        a, b = x, y
    return a > b if op in ("isGreaterThan", "isAfter") else a < b


def test_every_operation_against_the_naive_twin(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string")
    cases = list(itertools.product(sorted(OPERATIONS), WANTED))
    row = df.select("v", *[compare(F.col("v"), w, op).alias(f"c{k}") for k, (op, w) in enumerate(cases)]).collect()
    for r in row:
        for k, (op, w) in enumerate(cases):
            assert r[f"c{k}"] == naive(r["v"], w, op), (r["v"], op, w)


def test_missing_scalar_is_the_empty_text_and_missing_values_match_nothing(spark):
    df = spark.createDataFrame([(1, None, []), (2, "x", ["a", "b"])], "i int, s string, m array<string>")
    for op in sorted(OPERATIONS):
        c = Condition("s", op, "q")
        r = df.select("i", matches_scalar(F.col("s"), c).alias("s"), matches_values(F.col("m"), Condition("m", op, "a")).alias("m")).orderBy("i").collect()
        assert r[0]["m"] is False
        assert r[0]["s"] == naive("", "q", op)
        quantifier = all if op in NEGATED else any
        assert r[1]["m"] == quantifier(naive(v, "a", op) for v in ("a", "b"))


def test_unknown_operation_and_mode_are_refused(spark):
    with pytest.raises(ValueError):
        Condition("a", "like", "x")
    with pytest.raises(ValueError):
        advanced_search(spark.range(1), [], "some")


def test_sort_ties_keep_the_tiebreak_in_both_directions(spark):
    df = spark.createDataFrame([(1, "a"), (3, "a"), (2, "b")], "i int, k string")
    down = advanced_search(df, [], sort_by="k", descending=True, tiebreak=[F.col("i").desc()])
    up = advanced_search(df, [], sort_by="k", tiebreak=[F.col("i").desc()])
    assert [r["i"] for r in down.collect()] == [2, 3, 1]
    assert [r["i"] for r in up.collect()] == [3, 1, 2]


def test_tags_keywords_and_cascade(spark):
    df = spark.createDataFrame([(1, ["A", "b"]), (2, ["c"]), (3, None)], "i int, t array<string>")
    ids = lambda w: {r["i"] for r in df.where(tag_filter(F.col("t"), w)).collect()}
    assert ids(["a", "B"]) == {1} and ids(["a OR c"]) == {1, 2} and ids(["-a"]) == {2, 3} and ids([]) == {1, 2, 3}
    assert df.where(keyword_match([F.col("i").cast("string")], [])).count() == 3
    first = cascade([df.where("i > 9"), df.where("i = 2"), df])
    assert [r["i"] for r in first.collect()] == [2]
