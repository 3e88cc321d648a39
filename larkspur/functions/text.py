"""String predicates as built-in column functions: ordinal by default, without regard to case on request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _both(text: Column, part, ignore_case: bool) -> tuple[Column, Column]:
    part = part if isinstance(part, Column) else F.lit(part)
    return (F.lower(text), F.lower(part)) if ignore_case else (text, part)


def starts_with(text: Column, part, ignore_case: bool = False) -> Column:
    return F.startswith(*_both(text, part, ignore_case))


def ends_with(text: Column, part, ignore_case: bool = False) -> Column:
    return F.endswith(*_both(text, part, ignore_case))


def contains(text: Column, part, ignore_case: bool = False) -> Column:
    return F.contains(*_both(text, part, ignore_case))


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(text.rlike(r"^\s*$"), F.lit(True))


def hex_of(data: Column) -> Column:
    return F.hex(data)
