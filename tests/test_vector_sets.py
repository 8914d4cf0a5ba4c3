"""Searches with a set of query vectors, over several blocks, against one search at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import vectors


@pytest.fixture(scope="module")
def both(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(240, 8)).round(2)
    m[100:140] = m[20]  # equal vectors: the smaller id comes first
    rows = [(i, i % 6, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(240, 1, None), (241, 1, [0.0] * 8), (242, 1, [1.0, 2.0]), (250, None, [float(x) for x in m[3]])]
    e = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").cache()
    return e.where("vec_id % 50 in (0, 20)").select("vec_id", "embedding"), e


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 50)


def test_every_query_gets_what_it_gets_alone(both):
    queries, e = both
    asked = {r["vec_id"]: r["embedding"] for r in queries.where("embedding is not null").collect()}
    top = {(r["query_id"], r["rank"]): r["vec_id"] for r in vectors.top_k_each(queries, e, 10).collect()}
    per = {(r["query_id"], r["label"], r["rank"]): r["vec_id"] for r in vectors.top_k_each(queries, e, 2, "label").collect()}
    ahead = {(r["query_id"], r["vec_id"]) for r in vectors.parent_prefix_each(queries, e, 3).collect()}
    assert len(asked) == 11 and len(top) == 110
    for q in (0, 20, 100, 250):
        scored = e.withColumn("similarity", F.round(vectors.cosine_to(asked[q], F.col("embedding")), 12))
        assert [top[q, i] for i in range(1, 11)] == [r["vec_id"] for r in vectors.top_k(scored, 10).collect()]
        assert {k[1:]: v for k, v in per.items() if k[0] == q} == {(r["label"], r["rank"]): r["vec_id"] for r in vectors.top_k_per(scored, 2, "label").collect()}
        assert {v for k, v in ahead if k == q} == {r["vec_id"] for r in vectors.parent_prefix(scored, 3).collect()}


def test_fewer_parents_than_asked_for_gives_all(both):
    queries, e = both
    rows = vectors.parent_prefix_each(queries, e.where("label in (1, 2)"), 3)
    assert rows.count() == 11 * 80 and vectors.top_k_each(queries.limit(0), e, 3).count() == 0


def test_supports_of_every_query(both):
    queries, e = both
    spans = e.where("label is not null").withColumns({"start": (F.col("vec_id") * 120).cast("int"), "end": (F.col("vec_id") * 120 + 200).cast("int")})
    got = {(r["query_id"], r["label"]): (r["score"], r["n_support"]) for r in vectors.grouped_support_each(queries, spans).collect()}
    assert len(got) == 11 * 6
    one = spans.withColumn("similarity", vectors.cosine_to(queries.where("vec_id = 50").first()["embedding"], F.col("embedding"))).where("similarity is not null")
    for r in vectors.grouped_support(one).collect():
        assert got[50, r["label"]] == (pytest.approx(r["score"], abs=1e-6), r["n_support"])
