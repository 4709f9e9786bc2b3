"""Column expressions whose semantics differ between engines or recur across the models."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, functions as F


def as_of_date(as_of: date | str | Column | None) -> Column:
    """The reporting date; the query's current date when none is given."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("date")


def year_boundaries(start: Column, end: Column) -> Column:
    """Calendar-year boundaries crossed: 31 December to 1 January counts 1."""
    return F.year(end) - F.year(start)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that gives NULL, not an error, for a zero denominator."""
    return numerator.cast("double") / F.nullif(denominator, F.lit(0)).cast("double")


def round_to(value: Column, digits: int) -> Column:
    """Round the scaled double, so 1.005 at two digits gives 1.0 and not 1.01."""
    scale = 10.0**digits
    return F.round(value * scale) / scale


def ladder(steps: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """First matching condition wins; a NULL condition does not match."""
    (condition, label), *rest = steps
    out = F.when(condition, F.lit(label))
    for condition, label in rest:
        out = out.when(condition, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_name(column: str) -> str:
    """A column name quoted for SQL."""
    return "`" + column.replace("`", "``") + "`"


def total(value: Column | str) -> Column:
    """Sum that is 0, not NULL, when every value is NULL."""
    return F.coalesce(F.sum(value), F.lit(0))
