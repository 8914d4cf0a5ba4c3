"""Per-group Python for many small groups, without a pandas frame per group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, key: str, fn: Callable[[object, list[tuple]], Iterable[tuple]], schema: str, columns: list[str]) -> DataFrame:
    """``fn(key, rows)`` for every group of ``df``, rows as tuples of ``columns`` (key first).

    Rows are shuffled on the key and sorted, then read in Arrow batches that hold many
    groups each; a group that crosses a batch border is carried over. Use for groups of
    bounded size (a page, a record).
    """
    names = [p.strip().split(" ")[0] for p in schema.split(",")]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            rows = held + list(batch.itertuples(index=False, name=None))
            if not rows:
                continue
            last = rows[-1][0]
            done = [r for r in rows if r[0] != last] if rows[0][0] != last else []
            held = rows[len(done) :]
            if done:
                yield pd.DataFrame([x for k, g in groupby(done, key=itemgetter(0)) for x in fn(k, list(g))], columns=names)
        if held:
            yield pd.DataFrame(list(fn(held[0][0], held)), columns=names)

    return df.select(*columns).where(df[key].isNotNull()).repartition(key).sortWithinPartitions(key).mapInPandas(of, schema)
