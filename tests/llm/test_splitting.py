import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.splitting import oversized_records, pieces, split_records, split_spans


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n\f́な", max_size=300), st.integers(1, 40), st.integers(0, 45))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    spans = split_spans(text, limit, overlap)
    body = text.strip()
    if not body:
        assert spans == []
        return
    over = min(overlap, limit - 1)
    assert text[spans[0][0] : spans[-1][1]] == body
    assert all(0 < b - a <= limit for a, b in spans)
    assert all(nxt[0] == cur[1] - over and nxt[1] > cur[1] for cur, nxt in zip(spans, spans[1:]))
    rebuilt = text[spans[0][0] : spans[0][1]] + "".join(text[a + over : b] for a, b in spans[1:])
    assert rebuilt == body


def test_the_highest_boundary_in_reach_decides():
    text = "aaa bbb. ccc\n\nddd eee. fff ggg hhh"
    assert text[: split_spans(text, 25, 0)[0][1]] == "aaa bbb. ccc\n\n"
    assert split_spans("x" * 10, 4, 1) == [(0, 4), (3, 7), (6, 10)]
    with pytest.raises(ValueError):
        split_spans("x", 0, 0)
    assert len(split_spans("word " * 200_000, 4000, 300)) > 200


def test_pieces_are_filled_before_a_coarse_boundary_counts():
    """A section that ends just past the overlap doesn't make a tiny piece, and headings begin one."""
    text = ("\f" + "word " * 30).join(["ab " * 4] * 20)
    spans = split_spans(text, 100, 10)
    assert len(spans) <= 1.6 * len(text) / 90 and all(b - a > 50 for a, b in spans[:-1])
    text = "one two three.\n\n" + "four five six. " * 4 + "\n\nMethods\nseven eight. nine ten. " + "more " * 10
    assert text[split_spans(text, 100, 0)[0][1] :].startswith("Methods")


def test_records_of_both_fields(spark):
    items = spark.createDataFrame([("A", "x " * 30), ("B", None), ("C", "  " + "y" * 20 + " 　\f"), ("A", "x " * 30)], "item_key string, fulltext string")
    batches = spark.createDataFrame(
        [(1, ["A#0", "D#0", "E#0"], ["z" * 50, "w" * 50, None], "2020-01-01"), (2, ["D#0"], ["short"], "2021-01-01"), (3, None, None, None)],
        "batch_id bigint, ids array<string>, documents array<string>, prepared_at string",
    )
    limits = spark.createDataFrame([("fulltext", 20, 5), ("documents", 20, 5), ("documents", None, None)], "field_name string, max_chars int, overlap_chars int")
    records = oversized_records(items, batches, limits)
    assert {tuple(r) for r in split_records(records).select("field_name", "record_key").distinct().collect()} == {("fulltext", "A"), ("documents", "A#0")}
    rows = pieces(records.where("field_name = 'documents'")).orderBy("piece_no").collect()
    assert [r["piece_no"] for r in rows] == list(range(1, len(rows) + 1)) and all(len(r["piece"]) <= 20 for r in rows)
    assert split_records(oversized_records(items.limit(0), batches.limit(0), limits)).count() == 0
    assert split_records(oversized_records(items, batches, limits.limit(0))).count() == 0
