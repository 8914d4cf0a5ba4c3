from pyspark.sql import functions as F

from lectern.llm.scans import Lexicon, LineReader, broken_word, damaged_lines, examine, rebuild, repaired_texts

WORDS = "the river was mapped before harbour could be dated with well-known archives in long-term survey of results showed that reading room copy and methods next line page goes on".split()
LEX = Lexicon({w: 10 for w in WORDS}, {("the", "river"): 5})
READER = LineReader(LEX)


def defects(text, title=None, creators=None):
    return set(examine(text, title, creators, READER))


def test_candidates_and_confusions():
    assert LEX.best("nver") == "river" and LEX.best("r1ver") == "river" and LEX.best("harb0ur") == "harbour"
    assert LEX.best("zzzzzz") is None and LEX.candidates("q" * 5000) == ()
    assert LEX.cost("surn", "sum") < 1 < LEX.cost("abcd", "dcba")


def test_a_damaged_page():
    text = "- 12 -\nThe rivcr was mapped before the har-\nbour could be da ted with well-\nknown archives.\n23.1   40   1871\n44.0   12   1802\n1850\nAnnals of Results\n\f- 13 -\nThe survey showed results.\n"
    got = defects(text)
    assert {(1, "page_number"), (10, "page_number"), (2, "hyphen"), (3, "hyphen"), (2, "misread"), (3, "misread")} <= got
    assert not any(n in (5, 6, 7) for n, _ in got)
    out = rebuild(text, None, None, READER)
    assert "The river was mapped before the harbour could be dated with well-known archives." in out and "12" not in out.split("\n")[0]


def test_heads_by_title_and_creators():
    body = "the river was mapped before the harbour could be dated with the survey of the archives\n" * 6
    text = f"{body}\n7\fTHE LONG RIVER\n{body}\n8\fDoe et al.\n{body}9"
    got = defects(text, "The long river", "Doe, Jane")
    assert {d for _, d in got} == {"page_number", "header"} and sum(d == "header" for _, d in got) == 2


def test_broken_words_and_noise_marks():
    assert broken_word("before the har-", "bour could", LEX)[2] == "harbour"
    assert broken_word("in long-", "term survey", LEX)[2] == "long-term"
    assert broken_word("the harbour–", "could be", LEX) is None and broken_word("the har-", "", LEX) is None
    assert broken_word("the har­", "bour", LEX)[2] == "harbour" and broken_word("the har¬", "bour.", LEX)[2] == "harbour"


def test_clean_and_strange_texts_stay():
    clean = "The river was mapped before the harbour could be dated."
    assert not defects(clean) and rebuild(clean, None, None, READER) == clean
    for text in ("", "\n\n\f", " ", "ACGT" * 40_000, "な" * 3000, "\r\n\r\n"):
        defects(text)
        rebuild(text, None, None, READER)
    assert not defects("Vugaholm and Zipemere showed results in Drukovik.")


def test_operator_takes_nulls_repeats_and_clashing_columns(spark):
    lexicon = spark.createDataFrame([(w, 10) for w in WORDS] + [(None, 1), ("river", None)], "word string, weight bigint")
    rows = [(1, "t", None, "the rivcr was mapped", "x"), (1, "t", None, "the rivcr was mapped", "x"), (2, None, None, None, "x"), (3, None, None, "", "x"), (None, "t", "c", "the rivcr", "x")]
    items = spark.createDataFrame(rows, "item_id bigint, title string, creators string, fulltext string, line_no string")
    assert [tuple(r) for r in damaged_lines(items, lexicon).collect()] == [(1, 1, "misread")]
    assert {r["text"] for r in repaired_texts(items, lexicon).collect()} == {"the river was mapped"}
    assert damaged_lines(items.limit(0), lexicon).count() == 0 and damaged_lines(items, lexicon.limit(0)).count() == 0
    assert repaired_texts(items.where(F.lit(False)), lexicon).columns == ["item_id", "text"]


def test_heads_are_found_at_any_width():
    """The same page set narrow and with lines of 250 characters and more."""
    line = "the river was mapped before the harbour could be dated with the survey of the archives"
    for width in (1, 3, 5):
        body = " ".join([line] * width) + "\n"
        text = f"{body * 6}\n7\fTHE LONG RIVER\n{body * 6}\n8\fDoe et al.\n{body * 6}9"
        got = defects(text, "The long river", "Doe, Jane")
        assert {d for _, d in got} == {"page_number", "header"} and sum(d == "header" for _, d in got) == 2, width
        assert "RIVER" not in rebuild(text, "The long river", "Doe, Jane", READER)


def test_lines_and_paragraphs_agree():
    """What is reported as misread is what the rebuilt text repairs."""
    text = "The rivcr was mapped.\n\nHarb0ur could be dated with the arch-\nives in the surv3y of results.\n"
    assert {n for n, d in defects(text) if d == "misread"} == {1, 3, 4}
    out = rebuild(text, None, None, READER)
    assert out == "The river was mapped.\n\nHarbour could be dated with the archives in the survey of results."
