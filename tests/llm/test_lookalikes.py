from lectern.llm.lookalikes import canonical_text, repair_text, same_looking_pairs, unify_forms

KNOWN = {"hello", "сосна", "paper"}


def test_forms():
    assert unify_forms("Ｆｕｌｌ　ﬁn​al é ⅿ") == "Full final é m"
    assert unify_forms("x² – — ‐ ‑ “q”") == "x² – — - - “q”"
    woman = "\U0001f469‍\U0001f52c"
    assert unify_forms(woman) == woman and unify_forms("a‍b") == "ab" and unify_forms("") == ""


def test_only_mixed_tokens_that_the_vocabulary_knows_are_repaired():
    assert repair_text("h\u0435llo", KNOWN) == "hello" and repair_text("h\u0435llo", set()) == "h\u0435llo" and repair_text("h\u0435llo", {"paper"}) == "h\u0435llo"
    assert repair_text("c\u043e\u0441\u043da", KNOWN) == "\u0441\u043e\u0441\u043d\u0430"  # Latin letters in a Cyrillic word
    assert repair_text("\u0410", {"a"}) == "\u0410"  # of one script
    assert repair_text("\u0440\u0430\u0440\u0435r", {"paper", "\u0440\u0430\u0440\u0435r"}) == "paper"


def test_the_vocabulary_decides(spark):
    """One word with and without a text that has it in one script: only then is it repaired beyond its class."""
    def of(rows):
        return {r["doc_id"]: r["canonical"] for r in canonical_text(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}

    mixed = "the h\u0435llo there"
    assert of([(1, mixed), (2, "other words")])[1] == mixed
    assert of([(1, mixed), (2, "hello again")])[1] == "the hello there"
    # without the vocabulary the class still has one form: the one free of other alphabets, else the most frequent
    assert set(of([(1, "x\u0435rb"), (2, "xerb")]).values()) == {"xerb"}
    got = of([(1, "x\u0435\u0436b"), (2, "x\u0435\u0436b"), (3, "xe\u0436b")])
    assert set(got.values()) == {"x\u0435\u0436b"}


def test_pairs(spark):
    rows = [
        (1, "hello paper"), (2, "hеllo paper"), (3, "hellо paper"), (4, "hello paper"), (5, "Hello paper"), (6, "hello paper"), (7, "hello  paper"), (8, None), (9, ""), (10, "A"), (11, "А"),
        (12, "Α"), (13, "x²"), (14, "x2"), (15, "é"), (16, "é"), (17, "è"), (2, "hеllo paper"), (20, "x" * 50_000), (21, "x" * 49_999 + "х"),
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, canonical string")
    got = {tuple(r) for r in same_looking_pairs(df).collect()}
    same = [1, 2, 3, 4, 6]
    want = {(a, b) for a in same for b in same if a < b} - {(1, 4)} | {(10, 11), (10, 12), (11, 12), (15, 16), (20, 21)}
    assert got == want
    assert same_looking_pairs(df.limit(0)).count() == 0
    out = {r["doc_id"]: r["canonical"] for r in canonical_text(df.drop("canonical")).collect()}
    assert out[8] is None and out[9] == "" and out[3] == "hello paper"
