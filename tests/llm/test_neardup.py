import itertools
import random

import pytest

from lectern.llm import neardup


def brute(rows, words, least, threshold):
    sets = {}
    for i, title, abstract in rows:
        if abstract and abstract.strip():
            s = neardup.word_runs((title or "") + " " + abstract, words, least)
            if s is not None:
                sets[i] = set(s.tolist())
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    while len(rows) < n:
        base = [rng.choice(words) for _ in range(rng.choice([31, 60, 140, 400]))]
        for _ in range(rng.randint(1, 5)):
            text = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.05, 0.12]) else w for w in base]
            rows.append((i, rng.choice([None, "A title"]), " ".join(text)))
            i += 1
    return rows + [(9001, "t", None), (9002, "t", "  "), (9003, None, "too short"), (rows[0][0], rows[0][1], rows[0][2])]


@pytest.mark.parametrize("unit_bytes", [1 << 20, 1 << 12])
@pytest.mark.parametrize(("threshold", "words"), [(0.6, 3), (0.8, 5)])
def test_no_pair_is_lost(spark, unit_bytes, threshold, words):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, title string, abstract string, key string")
    pairs, members = neardup.similar_pairs(df, threshold, words, 30, unit_bytes=unit_bytes)
    got = {tuple(r) for r in neardup.expand(pairs, members).collect()}
    assert got == brute({r[0]: r for r in rows}.values(), words, 30, threshold) and got
    links = {r["id"]: r["links"] for r in neardup.classes(pairs, members).collect()}
    assert set(links) == {r[0] for r in rows if r[2] and len(r[2].split()) >= 30 - 2}


def test_copies_and_empty_input(spark):
    text = " ".join(f"c{i}" for i in range(50))
    df = spark.createDataFrame([(i, None, text) for i in range(40)], "id bigint, title string, abstract string")
    pairs, members = neardup.similar_pairs(df)
    assert pairs.count() == 0 and members.select("key").distinct().count() == 1
    assert neardup.expand(pairs, members).count() == 40 * 39 // 2
    pairs, members = neardup.similar_pairs(df.limit(0))
    assert neardup.expand(pairs, members).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(1)
    base = [f"v{rng.randrange(5000)}" for _ in range(20_000)]
    other = [w if rng.random() > 0.02 else "zz" for w in base]
    df = spark.createDataFrame([(1, "a", " ".join(base)), (2, "a", " ".join(other))], "id bigint, title string, abstract string")
    pairs, members = neardup.similar_pairs(df, 0.8, 5, 30)
    assert [tuple(r) for r in neardup.expand(pairs, members).collect()] == [(1, 2)]


def test_large_buckets_in_blocks(spark):
    """Many different texts around one common sentence: every signature of it is a bucket beyond the block size."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    common = [rng.choice(words) for _ in range(40)]
    rows = [(i, None, " ".join(common + [rng.choice(words) for _ in range(rng.choice([8, 12, 30]))])) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, title string, abstract string")
    pairs, members = neardup.similar_pairs(df, 0.6, 3, 30, block=7)
    got = {tuple(r) for r in neardup.expand(pairs, members).collect()}
    assert got == brute(rows, 3, 30, 0.6) and got


def test_shuffle_partitions_change_nothing(spark):
    rows = corpus(seed=8, n=60)
    df = spark.createDataFrame(rows, "id bigint, title string, abstract string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("3", "960"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append({tuple(r) for r in neardup.similar_pairs(df, 0.6, 3, 30)[0].collect()})
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0] == got[1] and got[0]


def test_classes_are_components(spark):
    """A chain of texts, each near the next only, is one class; copies share it; others stand alone."""
    w = [f"w{i}" for i in range(90)]
    rows = [(10 + k, None, " ".join([*w[10 * k :], *[f"x{i}" for i in range(10 * k)]])) for k in range(3)] + [(5, None, " ".join(w)), (99, None, " ".join(f"y{i}" for i in range(60)))]
    pairs, members = neardup.similar_pairs(spark.createDataFrame(rows, "id bigint, title string, abstract string"), 0.6, 3, 30)
    got = {r["id"]: (r["class_id"], r["links"]) for r in neardup.classes(pairs, members).collect()}
    assert {got[i][0] for i in (5, 10, 11, 12)} == {5} and got[99] == (99, 0) and got[11][1] == 2 and got[5] == got[10]
