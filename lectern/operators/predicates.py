"""Structured search conditions as Column expressions.

A field is a *scalar* (missing counts as the empty text) or *multi-valued* (an
array; no value matches nothing, whatever the operator). Affirming operators need
one matching value, negating ones all. Ordering operators compare as numbers when
both sides are numbers, else by folded text.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import fold, number_or_null

NEGATED = frozenset({"isNot", "doesNotContain"})
ORDERING = {"isGreaterThan": "__gt__", "isAfter": "__gt__", "isLessThan": "__lt__", "isBefore": "__lt__"}
OPERATIONS = frozenset({"is", "contains", "beginsWith", "endsWith", *NEGATED, *ORDERING})
#: Names under which fields may be asked for.
ALIASES = {"author": "creator", "authors": "creator", "creators": "creator", "tags": "tag", "itemtype": "item_type", "type": "item_type"}


@dataclass(frozen=True)
class Condition:
    field: str
    operation: str
    value: str

    def __post_init__(self) -> None:
        if self.operation not in OPERATIONS:
            raise ValueError(f"unknown operation {self.operation!r}")


def canonical_field(field: str) -> str:
    return ALIASES.get(field.strip().lower(), field.strip())


def compare(value: Column, expected: str, operation: str) -> Column:
    """One value (not null) against the expected text."""
    left, right = fold(value), fold(F.lit(expected))
    if operation in ("is", "isNot"):
        return left == right if operation == "is" else left != right
    if operation == "contains":
        return F.contains(left, right)
    if operation == "doesNotContain":
        return ~F.contains(left, right)
    if operation == "beginsWith":
        return left.startswith(right)
    if operation == "endsWith":
        return left.endswith(right)
    test = ORDERING[operation]
    a, b = number_or_null(value), number_or_null(F.lit(expected))
    return F.when(a.isNotNull() & b.isNotNull(), getattr(a, test)(b)).otherwise(getattr(left, test)(right))


def matches_scalar(value: Column, condition: Condition) -> Column:
    return compare(F.coalesce(value.cast("string"), F.lit("")), condition.value, condition.operation)


def matches_values(values: Column, condition: Condition) -> Column:
    quantifier: Callable = F.forall if condition.operation in NEGATED else F.exists
    test = quantifier(values, lambda v: compare(F.coalesce(v, F.lit("")), condition.value, condition.operation))
    return F.coalesce((F.size(values) > 0) & test, F.lit(False))


def condition_column(df: DataFrame, condition: Condition, fields: Mapping[str, Column] | None = None) -> Column:
    name = canonical_field(condition.field)
    value = (fields or {}).get(name, F.col(name))
    kind = df.select(value.alias("v")).schema["v"].dataType.typeName()
    return matches_values(value, condition) if kind == "array" else matches_scalar(value, condition)


def advanced_search(
    df: DataFrame,
    conditions: Sequence[Condition],
    join_mode: str = "all",
    sort_by: str | None = None,
    descending: bool = False,
    tiebreak: Sequence[Column] = (),
    limit: int | None = None,
    fields: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rows that meet all (or any) of the conditions, in order, at most ``limit``.

    Ties of the sort key keep the order of ``tiebreak``, in either direction.
    """
    if join_mode not in ("all", "any"):
        raise ValueError(f"unknown join mode {join_mode!r}")
    if conditions:
        tests = [condition_column(df, c, fields) for c in conditions]
        df = df.where(reduce(and_ if join_mode == "all" else or_, tests))
    order = list(tiebreak)
    if sort_by:
        key = (fields or {}).get(canonical_field(sort_by), F.col(canonical_field(sort_by)))
        order = [key.desc_nulls_last() if descending else key.asc_nulls_last(), *order]
    if order:
        df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def keyword_match(columns: Sequence[Column], variants: Sequence[str]) -> Column:
    """Whether any spelling of the query is part of the folded columns; an empty query matches everything."""
    if not variants:
        return F.lit(True)
    haystack = fold(F.concat_ws(" ", *columns))
    return reduce(or_, [F.contains(haystack, fold(F.lit(v))) for v in variants])


def tag_filter(tags: Column, wanted: Sequence[str]) -> Column:
    """All entries must hold; an entry is a tag, ``-tag`` (must be absent) or alternatives joined by OR or ``||``."""
    folded = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t))

    def entry(text: str) -> Column:
        if text.startswith("-"):
            return ~F.array_contains(folded, text[1:].strip().lower())
        parts = [p.strip().lower() for alt in text.split("||") for p in alt.split(" OR ")]
        return reduce(or_, [F.array_contains(folded, p) for p in parts if p] or [F.lit(True)])

    return reduce(and_, [entry(w.strip()) for w in wanted if w.strip()] or [F.lit(True)])


def cascade(stages: Sequence[DataFrame]) -> DataFrame:
    """The rows of the first stage that has any; stages share one schema. One plan, no driver-side probing."""
    tagged = reduce(DataFrame.unionByName, [s.withColumn("_stage", F.lit(i)) for i, s in enumerate(stages)])
    first = tagged.agg(F.min("_stage").alias("_first"))
    return tagged.join(F.broadcast(first), F.col("_stage") == F.col("_first")).drop("_stage", "_first")  # one row
