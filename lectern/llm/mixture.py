"""Mixing sources to target shares by pivotal dependent rounding.

The size of the mixture is given in tokens. Left out, it is the largest at which
every source of weight reaches its share: sources that even with all repeats could
supply less than a twentieth of their share of a mixture as large as the corpus
are used up and don't limit the others. A source reaches its share unless even ``max_repeats`` copies of all its documents
fall short; what it leaves is spread over the other sources in proportion to
their targets, until nothing is left or all are exhausted (water filling over a
handful of sources). That fixes the expected number of copies of each document
of a source: a whole number and a fraction, the same for all of the source.

The fractions are rounded by the pivotal method with token weights: two
documents with open fractions move token mass between each other, at random, so
that one becomes 0 or 1 while the sum of tokens and all expectations stay as they
are. It runs as a reduction tree: each leaf (a bounded block of documents of one
source) ends with at most one open fraction; the open ones of all leaves meet
again in blocks, level by level, until at most one a source is left, which is
rounded by a coin. So the tokens drawn of a source differ from the aim by less
than one document. All draws come from hashes of the keys and the seed: the same
input gives the same mixture, on whichever executor, also after a lost task.

Defined results: documents without a text or token, or of a source without a
target, are not drawn; a target without documents has an actual share of 0 and is
reported; null, zero and negative targets and repeats count as 0; a source listed
twice takes the sum of its shares and the largest cap; null sources match nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.packing import sized_documents
from lectern.llm.tokens import DEFAULT_VOCABULARY

LEAF = 4096


def target_copies(targets: dict[str, tuple[float, int]], tokens: dict[str, int], size: float) -> dict[str, float]:
    """Expected copies of each document, by source, for a mixture of ``size`` tokens."""
    want = {s: t for s, (t, cap) in targets.items() if t > 0 and cap > 0 and tokens.get(s, 0) > 0}
    room = {s: float(tokens[s]) * targets[s][1] for s in want}
    drawn = dict.fromkeys(want, 0.0)
    left, open_ = float(size), set(want)
    while open_ and left > 1e-9:
        weight = sum(want[s] for s in open_)
        short = [s for s in sorted(open_) if drawn[s] + left * want[s] / weight >= room[s]]
        if not short:
            for s in open_:
                drawn[s] += left * want[s] / weight
            break
        for s in short:
            drawn[s] = room[s]
            open_.discard(s)
        # start over with what the exhausted ones leave, so that the others keep their proportions
        left = size - sum(drawn[s] for s in want if s not in open_)
        for s in open_:
            drawn[s] = 0.0
    return {s: drawn[s] / tokens[s] for s in want}


def balanced_size(targets: dict[str, tuple[float, int]], tokens: dict[str, int], negligible: float = 0.05) -> float:
    """The largest mixture in which all sources but the negligible ones reach their (relative) share."""
    total = sum(tokens.values())
    want = {s: t for s, (t, cap) in targets.items() if t > 0}
    room = {s: float(tokens.get(s, 0)) * max(0, targets[s][1]) for s in want}
    heavy = [s for s in want if room[s] > 0 and room[s] >= negligible * want[s] * total]
    if not heavy:
        return sum(room.values())
    weight = sum(want[s] for s in heavy)
    return min(room[s] * weight / want[s] for s in heavy) + sum(room[s] for s in want if s not in heavy)


def _draw(seed: int, *key: object) -> float:
    return xxhash.xxh3_64_intdigest(repr(key), seed=seed) / 2.0**64


def pivotal(fraction: np.ndarray, weight: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Round fractions so that sum(fraction * weight) stays; at most one entry is left open."""
    p = fraction.astype(float).copy()
    eps = 1e-12
    open_ = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    p[p <= eps], p[p >= 1 - eps] = 0.0, 1.0
    i = None  # the entry whose fraction is carried on
    for at, j in enumerate(open_):
        if i is None:
            i = j
            continue
        # mass to j, at most what i has or j takes; or to i
        up = min(p[i] * weight[i], (1 - p[j]) * weight[j])
        down = min((1 - p[i]) * weight[i], p[j] * weight[j])
        if draws[at] * (up + down) < down:
            p[i], p[j] = p[i] - up / weight[i], p[j] + up / weight[j]
        else:
            p[i], p[j] = p[i] + down / weight[i], p[j] - down / weight[j]
        for x in (i, j):
            p[x] = 0.0 if p[x] <= eps else 1.0 if p[x] >= 1 - eps else p[x]
        i = next((x for x in (i, j) if 0 < p[x] < 1), None)  # both can settle at once
    return p


def _round_block(seed: int, level: int):
    def of(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["tokens", "doc_id", "copy_no"], kind="stable")
        source, leaf = block["source"].iloc[0], int(block["leaf"].iloc[0])
        draws = np.array([_draw(seed, level, source, leaf, n) for n in range(len(block))])
        return block.assign(fraction=pivotal(block["fraction"].to_numpy(), block["tokens"].to_numpy(dtype=float), draws))

    return of


def draw_mixture(
    docs: DataFrame, targets: DataFrame, size: int | None = None, seed: int = 0, vocabulary: str = DEFAULT_VOCABULARY, leaf: int = LEAF, negligible: float = 0.05
) -> DataFrame:
    """(doc_id, copy_no, source, tokens, copies) of every document of a targeted source; ``copies`` may be 0.

    ``negligible`` (only where ``size`` is left out): a source that can't supply this part of its share of a mixture of
    the corpus's size doesn't limit the size; at 0 every source with a document does, so all meet their relative shares.
    """
    from lectern.session import materialize

    sized = sized_documents(docs.where("source is not null"), vocabulary, "source")
    sized = materialize(sized.select("doc_id", "copy_no", "source", "tokens"))
    plan = _plan(sized, targets, size, negligible)
    spark = docs.sparkSession
    rows = [(s, float(np.floor(c + 1e-9)), float(max(0.0, c - np.floor(c + 1e-9))), int(max(1, -(-n // leaf)))) for s, (c, n) in plan.items()]
    expected = spark.createDataFrame(rows, "source string, whole double, fraction double, leaves bigint")
    state = sized.join(F.broadcast(expected), "source")  # one row a targeted source
    state = state.withColumn("fraction", F.when(F.col("fraction") < 1e-9, 0.0).otherwise(F.col("fraction")))
    settled = state.where("fraction = 0").select("doc_id", "copy_no", "source", "tokens", "whole", F.lit(0.0).alias("fraction"))
    pending = state.where("fraction > 0").withColumn("leaf", F.pmod(F.xxhash64("doc_id", "copy_no", F.lit(seed)), "leaves"))
    most = max([r[3] for r in rows], default=1)
    schema = "doc_id bigint, copy_no int, source string, tokens bigint, whole double, fraction double, leaf bigint, leaves bigint"
    level = 0
    columns = ["doc_id", "copy_no", "source", "tokens", "whole", "fraction"]
    while True:
        rounded = pending.select(*columns, "leaf", "leaves").groupBy("source", "leaf").applyInPandas(_round_block(seed, level), schema)
        if most == 1:
            break
        # the open fractions of the leaves, at most one each, meet in blocks of the next level
        rounded = materialize(rounded)
        settled = settled.unionByName(rounded.where("fraction in (0, 1)").select(*columns))
        pending = rounded.where("fraction not in (0, 1)").withColumns({
            "leaf": F.floor(F.col("leaf") / leaf), "leaves": F.greatest(F.lit(1), F.ceil(F.col("leaves") / leaf)).cast("bigint"),
        })
        most = -(-most // leaf)
        level += 1
    coin = F.pmod(F.xxhash64("doc_id", "copy_no", F.lit(f"coin {seed}")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    last = rounded.withColumn("fraction", (coin < F.col("fraction")).cast("double")).select(*columns)
    done = settled.unionByName(last)
    return done.select("doc_id", "copy_no", "source", "tokens", (F.col("whole") + F.col("fraction")).cast("int").alias("copies"))


def _plan(sized: DataFrame, targets: DataFrame, size: int | None, negligible: float) -> dict[str, tuple[float, int]]:
    """Expected copies and number of documents by source; the driver sees one row a source that has a target."""
    wanted = targets.where("source is not null").groupBy("source").agg(
        F.sum(F.greatest(F.lit(0.0), F.coalesce("target_share", F.lit(0.0)))).alias("t"),
        F.max(F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(0)))).alias("cap"),
    )
    per = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    rows = wanted.join(per, "source", "left").collect()
    share = sum(r["t"] for r in rows) or 1.0
    shares, tokens = {r["source"]: (r["t"] / share, r["cap"]) for r in rows}, {r["source"]: r["tokens"] or 0 for r in rows}
    copies = target_copies(shares, tokens, size if size is not None else balanced_size(shares, tokens, negligible))
    return {r["source"]: (copies[r["source"]], r["n"]) for r in rows if r["source"] in copies}


def mixture_report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: documents drawn, copies, tokens, the share reached, the share asked for, the gap."""
    per = drawn.groupBy("source").agg(
        F.sum((F.col("copies") > 0).cast("long")).alias("documents"), F.sum("copies").alias("copies"),
        F.max("copies").alias("most_repeats"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"),
    )
    wanted = targets.where("source is not null").groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    total = per.agg(F.sum("tokens").alias("all_tokens"))
    joined = wanted.join(per, "source", "left").join(F.broadcast(total), F.lit(True), "left")  # one row
    share = F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0))
    return joined.select(
        "source", "target_share", "max_repeats",
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.round(share, 6).alias("actual_share"), F.round(share - F.col("target_share"), 6).alias("gap"),
    )
