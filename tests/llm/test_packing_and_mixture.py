import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.mixture import balanced_size, draw_mixture, mixture_report, pivotal, target_copies
from lectern.llm.packing import assign_containers, container_report, differencing, pack
from lectern.llm.tokens import DEFAULT_VOCABULARY, count_tokens, encoding


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(100, 300))
def test_packing_never_exceeds_the_capacity(sizes, capacity):
    sizes = np.array(sizes, dtype=np.int64)
    window = pack(sizes, capacity)
    load = np.bincount(window, weights=sizes) if len(sizes) else np.zeros(0)
    assert (load <= capacity).all()
    assert len(set(window.tolist())) <= max(1, 2 * -(-int(sizes.sum()) // capacity) + 1)


def test_differencing_balances():
    sizes = np.array([8, 7, 6, 5, 4])
    load = np.bincount(differencing(sizes, 2), weights=sizes)
    assert sorted(load) == [14, 16]  # the known result of the method
    assert np.ptp(np.bincount(differencing(np.arange(1, 200), 10), weights=np.arange(1, 200))) <= 3
    assert set(differencing(np.array([5]), 1)) == {0} and len(differencing(np.zeros(0, np.int64), 3)) == 0


def docs(spark, rows):
    return spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, source string, tokens string")


def test_containers(spark):
    rows = [(i, "word " * (1 + i % 37), "s") for i in range(300)] + [(900, "long " * 1000, "s"), (901, None, "s"), (902, "", "s"), (1, "word again", "s")]
    caps = spark.createDataFrame([(1, 64), (2, 500), (3, None), (4, 0)], "capacity_id int, capacity_tokens int")
    out = assign_containers(docs(spark, rows), caps).toPandas()
    assert set(out["capacity_id"]) == {1, 2}
    for cap_id, cap in ((1, 64), (2, 500)):
        own = out[out["capacity_id"] == cap_id]
        assert own.groupby("container_id")["tokens"].sum().max() <= cap
        total = own.groupby(["doc_id", "copy_no"])["tokens"].sum()
        want = {(r[0]): count_tokens(r[1]) for r in rows if r[1]}
        assert total[900, 1] == want[900] and len(total) == 302
        assert (own[own["doc_id"] != 900].groupby(["doc_id", "copy_no"]).size() == 1).all() or cap == 64
    filled = {r["capacity_id"]: r["filled"] for r in container_report(assign_containers(docs(spark, rows), caps), caps).collect()}
    assert filled[1] > 0.9 and filled[2] > 0.9
    assert assign_containers(docs(spark, rows[:0]), caps).count() == 0


def test_tokens_round_trip():
    e = encoding(DEFAULT_VOCABULARY)
    for t in ("", "plain words", "<|endoftext|>", "µ なに ́", " \n\n  x"):
        assert e.decode(e.encode_ordinary(t)) == t


def test_pivotal_keeps_the_weighted_sum():
    rng = np.random.default_rng(0)
    p, w = rng.random(200), rng.integers(1, 50, 200).astype(float)
    mean = np.zeros(200)
    for _ in range(300):
        q = pivotal(p, w, rng.random(200))
        assert ((q == 0) | (q == 1)).sum() >= 199 and abs((q * w).sum() - (p * w).sum()) < 1e-6
        mean += q
    assert abs(mean / 300 - p).mean() < 0.05


def test_water_filling():
    t = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 3)}
    got = target_copies(t, {"a": 1000, "b": 100, "c": 1000}, 1000)
    assert got["b"] == 2 and got["a"] * 1000 + 200 + got["c"] * 1000 == pytest.approx(1000) and got["a"] / got["c"] == pytest.approx(2.5)
    assert target_copies({"a": (1, 0)}, {"a": 5}, 10) == {} and balanced_size({}, {}) == 0


def test_mixture_meets_the_shares(spark):
    rows = [(i, "word " * (1 + i % 17), "big") for i in range(2000)] + [(5000 + i, "word " * 9, "small") for i in range(40)] + [(9000, "x", None), (9001, None, "big"), (9002, "x", "other")]
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("none", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    drawn = draw_mixture(docs(spark, rows), targets, leaf=64)
    report = {r["source"]: r for r in mixture_report(drawn, targets).collect()}
    assert report["small"]["most_repeats"] == 3 and report["none"]["actual_share"] == 0
    assert report["big"]["actual_share"] / report["small"]["actual_share"] == pytest.approx(3.5, rel=0.02)
    again = draw_mixture(docs(spark, rows).repartition(7), targets, leaf=64)
    key = lambda d: sorted((r["doc_id"], r["copies"]) for r in d.collect())
    assert key(drawn) == key(again)
    assert draw_mixture(docs(spark, rows[:0]), targets).count() == 0 and draw_mixture(docs(spark, rows), targets.limit(0)).count() == 0


def test_equal_weights_settle_in_pairs(spark):
    """Equal weights at one half: both entries of every meeting settle at once, thousands of times."""
    n = 4096
    q = pivotal(np.full(n, 0.5), np.full(n, 7.0), np.random.default_rng(1).random(n))
    assert set(q) == {0.0, 1.0} and q.sum() == n / 2
    rows = [(i, "same words in each", "big") for i in range(3000)]
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    each = count_tokens("same words in each")
    drawn = draw_mixture(docs(spark, rows), targets, size=1500 * each)
    assert drawn.agg({"copies": "sum"}).first()[0] == 1500


def test_an_id_under_two_sources_stays_two_documents(spark):
    rows = [(1, "some words", "a"), (1, "other words here", "b"), (2, "more", "b")]
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    drawn = draw_mixture(docs(spark, rows), targets, size=20).collect()
    assert sorted((r["doc_id"], r["source"]) for r in drawn) == [(1, "a"), (1, "b"), (2, "b")]
