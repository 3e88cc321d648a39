"""Places in an ordering, found without sorting a table in one task.

Nulls count as the least values: first in rising order, last in falling order. A place is one row's keys, at most one row that
is broadcast; what lies before and behind it is a filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key and whether it falls.
Key = tuple[Column, bool]


def sort_columns(keys: list[Key]) -> list[Column]:
    return [c.desc_nulls_last() if d else c.asc_nulls_first() for c, d in keys]


def _marks(keys: list[Key]) -> list[Column]:
    return [c.alias(f"__mark_{i}") for i, (c, _) in enumerate(keys)]


def _compared(keys: list[Key]) -> tuple[Column, Column]:
    """Whether a row lies before its mark, and whether it is equal to it in all keys."""
    before, equal = F.lit(False), F.lit(True)
    for i, (c, falls) in enumerate(keys):
        low, high = (F.col(f"__mark_{i}"), c) if falls else (c, F.col(f"__mark_{i}"))
        less = (low.isNull() & high.isNotNull()) | F.coalesce(low < high, F.lit(False))
        before, equal = before | (equal & less), equal & c.eqNullSafe(F.col(f"__mark_{i}"))
    return before, equal


def _beside(df: DataFrame, place: DataFrame, how: str) -> DataFrame:
    """Every row with the marks of a place, which has one row or, with how="left", maybe none."""
    return df.join(F.broadcast(place), F.lit(True), how)


def without_first(df: DataFrame, keys: list[Key], n: int) -> DataFrame:
    """All rows but the first n. Only these n are sorted; the rows behind the last of them are a filter."""
    if n <= 0:
        return df
    columns = df.columns
    if not keys:
        return df.offset(n)
    first = df.orderBy(*sort_columns(keys)).limit(n).select(*_marks(keys))
    marks = [(F.col(f"__mark_{i}"), d) for i, (_, d) in enumerate(keys)]
    last = first.orderBy(*[m.asc_nulls_first() if d else m.desc_nulls_last() for m, d in marks]).limit(1)
    before, equal = _compared(keys)
    behind = _beside(df, last, "inner").where(~before & ~equal).select(*columns)
    # Rows that no key tells apart are one as good as the other: as many go as the first n have.
    same = reduce(Column.__and__, [m.eqNullSafe(F.col(f"__last_{i}")) for i, (m, _) in enumerate(marks)])
    gone = first.join(F.broadcast(last.select(*[m.alias(f"__last_{i}") for i, (m, _) in enumerate(marks)])), same, "left_semi").count()
    return behind.unionByName(_beside(df, last, "inner").where(equal).select(*columns).offset(gone))


def split_at_first(df: DataFrame, keys: list[Key], fails: Column, before: bool) -> DataFrame:
    """The rows before the first that fails, or that one and all behind it. Rows that no key tells from it count as behind."""
    columns = df.columns
    place = df.where(fails).orderBy(*sort_columns(keys)).limit(1).select(F.lit(True).alias("__found"), *_marks(keys))
    first, _ = _compared(keys)
    if before:
        return _beside(df, place, "left").where(F.col("__found").isNull() | first).select(*columns)
    return _beside(df, place, "inner").where(~first).select(*columns)
