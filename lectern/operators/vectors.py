"""Exact vector retrieval: cosine top-k, filters, parent boundaries, supports, neighbours.

For one query, similarities are computed in one pass over the vectors (no shuffle) and
reduced by top-k, so only k rows a task travel. A set of queries (``..._each``) is cut into
blocks like the vectors; every pair of blocks is scored by one matrix product, keeps what can
still matter for each of its queries, and the rest is merged per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.session import materialize


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, clamped to [-1, 1]; null if either has no length or the sizes differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    value = F.when(F.size(a) == F.size(b), F.try_divide(dot, norm(a) * norm(b)))
    return F.when(value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def distance_to_similarity(distance: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance))


def cosine_to(query: list[float], vectors: Column) -> Column:
    """Similarity of every vector to one query, by numpy on Arrow batches: no row is interpreted."""
    q = np.asarray(query, dtype=np.float64)
    q_norm = float(np.linalg.norm(q))

    def of(batch: pd.Series) -> pd.Series:
        out = np.full(len(batch), np.nan)
        ok = np.array([v is not None and len(v) == len(q) for v in batch], dtype=bool)
        if ok.any() and q_norm:
            m = np.vstack([np.asarray(v, dtype=np.float64) for v in batch[ok]])
            norms = np.linalg.norm(m, axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[ok] = np.clip(m @ q / (norms * q_norm), -1, 1)
        return pd.Series(out)

    value = F.pandas_udf(of, T.DoubleType())(vectors)
    return F.when(~F.isnan(value), value)


def top_k(scored: DataFrame, k: int, score: str = "similarity", tiebreak: str = "vec_id") -> DataFrame:
    return scored.where(F.col(score).isNotNull()).orderBy(F.col(score).desc(), F.col(tiebreak)).limit(k)


def top_k_per(scored: DataFrame, k: int, part: str, score: str = "similarity", tiebreak: str = "vec_id") -> DataFrame:
    w = Window.partitionBy(part).orderBy(F.col(score).desc(), F.col(tiebreak))
    return scored.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def parent_prefix(scored: DataFrame, limit: int, parent: str = "label", score: str = "similarity", tiebreak: str = "vec_id") -> DataFrame:
    """The ranked rows ahead of the first row of the (limit + 1)-th distinct parent; all rows if there are fewer parents.

    The best row of each parent is found by aggregation and the boundary by a
    top-k of those: no global ranking of all rows.
    """
    live = scored.where(F.col(score).isNotNull())
    rank = F.struct((-F.col(score)).alias("s"), F.col(tiebreak).alias("t"))
    best = live.groupBy(parent).agg(F.min(rank).alias("best")).orderBy("best").offset(limit).limit(1).select(F.col("best").alias("bound"))
    joined = live.join(F.broadcast(best), F.lit(True), "left")  # at most one row
    return joined.where(F.col("bound").isNull() | (rank < F.col("bound"))).drop("bound")


def neighbours(chunks: DataFrame, hits: DataFrame, k: int = 1, parent: str = "label", idx: str = "idx") -> DataFrame:
    """(hit_id, chunks...) of the same parent at most k places from a hit; an equi-join on (parent, place)."""
    near = hits.select(F.col("vec_id").alias("hit_id"), parent, F.explode(F.sequence(F.col(idx) - k, F.col(idx) + k)).alias(idx))
    return near.join(chunks, [parent, idx])


def _supports(within: float, weights: tuple[float, ...], cap: float):
    def of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["similarity", "vec_id"], ascending=[False, True], kind="stable")
        best = float(group["similarity"].iloc[0])
        floor = max(0.0, best - within)
        chosen = [group.iloc[0].to_dict()]
        if best > 0:
            for hit in group.iloc[1:].to_dict("records"):
                if len(chosen) > len(weights) or hit["similarity"] < floor:
                    break
                if not any(_repeats(hit, c) for c in chosen):
                    chosen.append(hit)
        extra = sum(w * min(1.0, max(0.0, float(c["similarity"])) / best) for w, c in zip(weights, chosen[1:], strict=False)) if best > 0 else 0.0
        score = round(min(1.0, best * (1 + min(cap, extra))), 9)
        return pd.DataFrame({"label": [group["label"].iloc[0]], "score": [score], "n_support": [len(chosen)]})

    return of


def _repeats(a: dict, b: dict) -> bool:
    """Whether two hits say the same: of one kind, and equal in words or sharing half of the shorter one."""
    kinds = a.get("kind"), b.get("kind")
    if all(isinstance(k, str) and k for k in kinds) and kinds[0] != kinds[1]:
        return False
    texts = [" ".join(t.lower().split()) for t in (a.get("text"), b.get("text")) if isinstance(t, str)]
    if len(texts) == 2 and texts[0] and texts[0] == texts[1]:
        return True
    shorter = min(a["end"] - a["start"], b["end"] - b["start"])
    return shorter > 0 and max(0, min(a["end"], b["end"]) - max(a["start"], b["start"])) >= 0.5 * shorter


def grouped_support(hits: DataFrame, within: float = 0.15, weights: tuple[float, ...] = (0.10, 0.05), cap: float = 0.15) -> DataFrame:
    """(label, score, n_support): each parent's best hit, raised by further passages that are near it and don't repeat it.

    ``hits`` has label, vec_id, similarity, start and end; ``kind`` and ``text`` count where they are given.
    """
    columns = ["label", "vec_id", "similarity", "start", "end", *[c for c in ("kind", "text") if c in hits.columns]]
    return hits.select(*columns).groupBy("label").applyInPandas(_supports(within, weights, cap), "label int, score double, n_support int")


def rerank(hits: DataFrame, score: Column, k: int, keep: int, first: str = "similarity", tiebreak: str = "vec_id") -> DataFrame:
    """The ``keep`` best of the first ``k`` hits by a second score: any Column, a ``pandas_udf`` of a model included.

    Only the rows that the first stage leaves are scored again, so a dear scorer runs on ``k`` rows and no more.
    """
    stage = top_k(hits, k, first, tiebreak).withColumn("second_score", score)
    return top_k(stage, keep, "second_score", tiebreak)


# --- sets of queries -------------------------------------------------------------------------------------------

QUERY_BLOCK, VECTOR_BLOCK = 4096, 8192  # rows
CELLS = 1 << 21  # similarities held at once
SLACK = 1e-9  # more than a matrix product is off by


def _matrix(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The rows that have a direction, their vectors and lengths."""
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in rows["embedding"]])
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    ok = np.isfinite(norms) & (norms > 0)
    return rows[ok].reset_index(drop=True), m[ok], norms[ok]


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Similarities of pairs, summed in the same order wherever they stand: equal vectors get equal values."""
    dots = [np.einsum("ij,ij->i", a[i[at : at + 65536]], b[j[at : at + 65536]]) for at in range(0, len(i), 65536)]
    return np.clip(np.concatenate([*dots, np.empty(0)]) / lengths, -1, 1)


def _pairs(part: str | None, k: int | None, within: float | None, columns: list[str]):
    """Of a block of queries and one of vectors: the best ``k`` of each query (and part), those ``within`` of its best, or those before its bound."""

    def of(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({c: [] for c in columns})]
        sizes = vectors["embedding"].map(len)
        for size, qs in queries.groupby(queries["embedding"].map(len)):
            if not size or not (sizes == size).any():
                continue
            qs, qm, qn = _matrix(qs)
            vs, vm, vn = _matrix(vectors[sizes == size])
            if not len(qs) or not len(vs):
                continue
            codes = pd.factorize(vs[part], use_na_sentinel=False)[0] if part else np.zeros(len(vs), dtype=int)
            places = [np.flatnonzero(codes == c) for c in np.unique(codes)]
            unit, step = (vm / vn[:, None]).T, max(1, CELLS // len(vs))
            for at in range(0, len(qs), step):
                s = (qm[at : at + step] / qn[at : at + step, None]) @ unit
                for own in places:
                    t = s[:, own]
                    if k is not None:
                        floor = np.partition(t, -k, axis=1)[:, -k] if k < t.shape[1] else np.full(len(t), -2.0)
                    elif within is not None:
                        floor = t.max(axis=1) - within
                    else:
                        floor = qs["bound"].to_numpy(dtype=float, na_value=np.nan)[at : at + step]
                        floor = np.where(np.isnan(floor), -2.0, floor)
                    i, j = np.nonzero(t >= floor[:, None] - SLACK)
                    i, j = i + at, own[j]
                    rows = pd.DataFrame({"query_id": qs["query_id"].to_numpy()[i], "vec_id": vs["vec_id"].to_numpy()[j], "similarity": _exact(qm, vm, i, j, qn[i] * vn[j])})
                    if part:
                        rows[part] = vs[part].to_numpy()[j]
                    if k is not None:
                        rows = rows.sort_values(["query_id", "similarity", "vec_id"], ascending=[True, False, True])
                        rows = rows[rows.groupby("query_id").cumcount() < k]
                    found.append(rows)
        found = found[1:] or found
        return pd.concat(found)[columns]

    return of


def _each(queries: DataFrame, vectors: DataFrame, part: str | None = None, k: int | None = None, within: float | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, part) of all pairs of blocks; rows that a merge per query still has to cut."""
    names = {c: "query_id" if c == "vec_id" else c for c in queries.columns}
    queries = queries.where("embedding is not null").select(*[F.col(c).alias(n) for c, n in names.items()])
    vectors = vectors.where("embedding is not null").select("vec_id", "embedding", *([part] if part else []))
    n_q, n_v = (max(1, -(-x.count() // most)) for x, most in ((queries, QUERY_BLOCK), (vectors, VECTOR_BLOCK)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = queries.withColumn("q", own("query_id", n_q)).withColumn("v", every(n_v))
    right = vectors.withColumn("v", own("vec_id", n_v)).withColumn("q", every(n_q))
    types = {"query_id": queries.schema["query_id"].dataType, "vec_id": vectors.schema["vec_id"].dataType, "similarity": T.DoubleType()} | ({part: vectors.schema[part].dataType} if part else {})
    schema = T.StructType([T.StructField(c, kind) for c, kind in types.items()])
    return left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInPandas(_pairs(part, k, within, list(types)), schema)


def top_k_each(queries: DataFrame, vectors: DataFrame, k: int, part: str | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, part, rank): the best ``k`` vectors of every query, or of every query and part."""
    w = Window.partitionBy("query_id", *([part] if part else [])).orderBy(F.col("similarity").desc(), F.col("vec_id"))
    return _each(queries, vectors, part, k=k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def parent_prefix_each(queries: DataFrame, vectors: DataFrame, limit: int, parent: str = "label") -> DataFrame:
    """``parent_prefix`` of every query: the best of each parent gives the query's boundary, a second pass the rows ahead of it."""
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("vec_id"))
    bounds = top_k_each(queries, vectors, 1, parent).withColumn("rank", F.row_number().over(w)).where(F.col("rank") == limit + 1)
    bounds = materialize(bounds.select(F.col("query_id").alias("vec_id"), F.col("similarity").alias("bound"), F.col("vec_id").alias("bound_id")))
    rows = _each(queries.join(bounds.select("vec_id", "bound"), "vec_id", "left"), vectors, parent)
    rows = rows.join(bounds.withColumnRenamed("vec_id", "query_id"), "query_id", "left")
    ahead = (F.col("similarity") > F.col("bound")) | ((F.col("similarity") == F.col("bound")) & (F.col("vec_id") < F.col("bound_id")))
    return rows.where(F.col("bound").isNull() | ahead).drop("bound", "bound_id")


def grouped_support_each(queries: DataFrame, vectors: DataFrame, within: float = 0.15, weights: tuple[float, ...] = (0.10, 0.05), cap: float = 0.15) -> DataFrame:
    """(query_id, label, score, n_support): ``grouped_support`` of every query; vectors with ``start`` and ``end``."""
    hits = _each(queries, vectors, "label", within=within).join(vectors.select("vec_id", "start", "end"), "vec_id")
    supports = _supports(within, weights, cap)

    def of(group: pd.DataFrame) -> pd.DataFrame:
        return supports(group).assign(query_id=group["query_id"].iloc[0])[["query_id", "label", "score", "n_support"]]

    return hits.groupBy("query_id", "label").applyInPandas(of, "query_id bigint, label int, score double, n_support int")
