"""Filling containers of fixed capacity by multiway differencing.

Items (texts, in tokens) go to containers none of which may exceed its capacity.
An item larger than the capacity is divided into full containers and a rest; no
other is ever divided. The rests and the smaller items are dealt, by a hash, into
blocks of a bounded token volume. In each block the number of windows starts at
the least that could hold it; Karmarkar-Karp multiway differencing merges partial
partitions with opposing imbalances into that many near-equal windows; while some
window exceeds the capacity and refilling it together with the roomiest others
doesn't mend it, the number rises. Unit of work: a block.

A block wastes at most about one window, so with ``windows`` windows a block the
loss to blocking is of the order of 1 / windows, whatever the size of the data.

Defined results: null and empty texts have no tokens and are assigned to no
container; capacities that are null or below one are ignored; a capacity listed twice
under one id counts once (the smallest); repeated rows of one ``doc_id`` are
items of their own, told apart by ``copy_no``.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.tokens import DEFAULT_VOCABULARY, n_tokens

MOST_CAPACITIES = 1000
#: Share of the windows of a block that a refill may touch.
REFILL = 0.5
SCHEMA = "capacity_id int, container_id string, doc_id bigint, copy_no int, part_no int, token_start bigint, tokens bigint"


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 .. k-1) of each item, by Karmarkar-Karp differencing into k windows.

    A partial partition is k sums, sorted from large to small. The two with the
    largest spread are merged, the largest sums of one with the smallest of the
    other. Members are kept as linked trees and read out once at the end; sums
    that equal the smallest one are kept implicit, so that merging costs the
    number of distinct windows in use, not k.
    """
    n = len(sizes)
    if k <= 1 or not n:
        return np.zeros(n, dtype=np.int64)
    # a partition: (-spread, tie, sums above the base descending, their members); the other windows are empty of excess
    heap: list[tuple[float, int, list[int], list[object]]] = []
    for i in np.argsort(-sizes, kind="stable"):
        heap.append((-int(sizes[i]), len(heap), [int(sizes[i])], [int(i)]))
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, ma = heapq.heappop(heap)
        _, _, b, mb = heapq.heappop(heap)
        free = k - len(a)
        if len(b) <= free:  # b's windows fall on windows of a that hold nothing
            sums, members = a + b, ma + mb
        else:
            # the smallest `over` of a's windows meet the smallest of b's, opposed
            over = len(b) - free
            keep = len(a) - over
            head, tail, mtail = a[:keep], a[keep:], ma[keep:]
            sums = head + b[:free] + [x + y for x, y in zip(tail, reversed(b[free:]), strict=True)]
            members = ma[:keep] + mb[:free] + [(x, y) for x, y in zip(mtail, reversed(mb[free:]), strict=True)]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, members = [sums[i] for i in order], [members[i] for i in order]
        if len(sums) == k and sums[-1]:
            low = sums[-1]
            # only differences matter from here on: take the common level off
            sums = [x - low for x in sums]
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == k else 0)), tie, sums, members))
        tie += 1
    out = np.zeros(n, dtype=np.int64)
    for window, member in enumerate(heap[0][3]):
        stack = [member]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                out[x] = window
    return out


def repair(sizes: np.ndarray, window: np.ndarray, k: int, capacity: int, share: float = REFILL) -> bool:
    """Refill the windows above the capacity together with the roomiest others, in place; True if all then fit.

    The items of a growing set of windows (those above the capacity, then the
    ones with the most room; at most ``share`` of all windows) are placed anew, from large to small, each
    where it leaves the least room. Windows outside the set stay as differencing made them.
    """
    load = np.bincount(window, weights=sizes, minlength=k).astype(np.int64)
    over = int((load > capacity).sum())
    if not over:
        return True
    if not share:
        return False
    fullest = np.argsort(-load, kind="stable")
    take, most = 2 * over, max(2, int(share * k))
    while take <= most or take == 2:
        chosen = np.concatenate([fullest[:over], fullest[over:][::-1][: take - over]])
        inside = np.zeros(k, dtype=bool)
        inside[chosen] = True
        pool = np.flatnonzero(inside[window])
        rooms = [(capacity, int(w)) for w in sorted(chosen)]
        placed: list[tuple[int, int]] = []
        for i in pool[np.argsort(-sizes[pool], kind="stable")]:
            at = bisect_left(rooms, (int(sizes[i]), -1))
            if at == len(rooms):
                break
            room, w = rooms.pop(at)
            placed.append((int(i), w))
            insort(rooms, (room - int(sizes[i]), w))
        else:
            for i, w in placed:
                window[i] = w
            return True
        if take == most:
            break
        take = min(most, 2 * take)
    return False


def pack(sizes: np.ndarray, capacity: int, refill: bool = True) -> np.ndarray:
    """The window of each item (none above the capacity); as few windows as differencing, and the refill if asked for, reaches."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    k = max(1, ceil(int(sizes.sum()) / capacity), int((sizes * 2 > capacity).sum()))
    while True:
        window = differencing(sizes, k)
        if repair(sizes, window, k, capacity, REFILL if refill else 0):
            return window
        k = min(len(sizes), k + 1)


def _pack_block(refill: bool):
    def of(block: pd.DataFrame) -> pd.DataFrame:
        return _packed(block, refill)

    return of


def _packed(block: pd.DataFrame, refill: bool) -> pd.DataFrame:
    block = block.sort_values(["tokens", "doc_id", "copy_no", "part_no"], ascending=[False, True, True, True], kind="stable")
    window = pack(block["tokens"].to_numpy(dtype=np.int64), int(block["capacity_tokens"].iloc[0]), refill)
    name = f"{int(block['capacity_id'].iloc[0])}-{int(block['block'].iloc[0])}-"
    return pd.DataFrame({
        "capacity_id": block["capacity_id"], "container_id": [name + str(w) for w in window], "doc_id": block["doc_id"],
        "copy_no": block["copy_no"], "part_no": block["part_no"], "token_start": block["token_start"], "tokens": block["tokens"],
    })


def sized_documents(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, *carry: str) -> DataFrame:
    """(doc_id, *carry, copy_no, tokens) of the documents that have a token; text is read once and left behind."""
    sized = docs.where("text is not null and doc_id is not null").select("doc_id", *carry, n_tokens(F.col("text"), vocabulary).alias("tokens"))
    sized = sized.where("tokens > 0")
    return sized.withColumn("copy_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("tokens", *carry)).cast("int"))


def assign_containers(docs: DataFrame, capacities: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, windows: int = 192, refill: bool = True) -> DataFrame:
    """One row per document (or part of a divided one) and capacity: its container and the tokens it takes there.

    ``windows``: about how many windows a block is to have. The number of blocks
    follows from the token volume; capacities are settings, at most ``MOST_CAPACITIES``.
    """
    from lectern.session import materialize

    sized = materialize(sized_documents(docs, vocabulary))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    limits = (
        capacities.where("capacity_id is not null and capacity_tokens >= 1")
        .groupBy(F.col("capacity_id").cast("int").alias("capacity_id"))
        .agg(F.min("capacity_tokens").cast("bigint").alias("capacity_tokens"))
    )
    asked = [(r["capacity_id"], r["capacity_tokens"], max(1, ceil(total / (r["capacity_tokens"] * windows)))) for r in limits.take(MOST_CAPACITIES + 1)]
    if len(asked) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    columns = ("capacity_id int", "capacity_tokens bigint", "blocks bigint")
    each = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, map(str.split, columns), strict=True)]) for row in asked]
    every = F.array(*each) if each else F.array().cast(f"array<struct<{','.join(c.replace(' ', ':') for c in columns)}>>")
    items = sized.select("*", F.explode(every).alias("limit")).select("doc_id", "copy_no", "tokens", "limit.*")
    full = F.floor(F.col("tokens") / F.col("capacity_tokens"))
    items = items.withColumn("full", F.when(F.col("tokens") > F.col("capacity_tokens"), full).otherwise(0).cast("int"))
    whole = items.where("full > 0").select(
        "*", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("part_no")
    ).select(
        "capacity_id",
        F.concat_ws("-", "capacity_id", F.lit("full"), "doc_id", "copy_no", "part_no").alias("container_id"),
        "doc_id", "copy_no", "part_no", ((F.col("part_no") - 1) * F.col("capacity_tokens")).alias("token_start"), F.col("capacity_tokens").alias("tokens"),
    )
    rests = items.select(
        "capacity_id", "capacity_tokens", "blocks", "doc_id", "copy_no",
        (F.col("full") + 1).alias("part_no"),
        (F.col("full") * F.col("capacity_tokens")).cast("bigint").alias("token_start"),
        (F.col("tokens") - F.col("full") * F.col("capacity_tokens")).cast("bigint").alias("tokens"),
    ).where("tokens > 0")
    rests = rests.withColumn("block", F.pmod(F.xxhash64("doc_id", "copy_no", "capacity_id"), F.col("blocks")))
    packed = rests.groupBy("capacity_id", "block").applyInPandas(_pack_block(refill), SCHEMA)
    return packed.unionByName(whole)


def container_report(assigned: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, share of the room filled, documents, divided documents."""
    limits = capacities.where("capacity_id is not null").groupBy("capacity_id").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    loads = assigned.groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("load"), F.count("*").alias("n"))
    per = loads.groupBy("capacity_id").agg(
        F.count("*").alias("containers"), F.sum("load").alias("tokens"), F.max("load").alias("largest_load"), F.sum("n").alias("items")
    )
    return per.join(limits, "capacity_id").select(
        "capacity_id", "capacity_tokens", "containers", "items", "tokens", "largest_load",
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("filled"),
    )
