"""Declared data checks as Spark jobs.

A table is evaluated once for all its checks. Each of its rows becomes one cell per checked key column,
and one cell whose key is the pattern of row checks that it fails. All cells of all
tables are counted by key in one aggregation: a key has its count in each place it came from, and a
check compares two counts of a key or sums those of the patterns that hold it. A parent table is
read once, however many tables refer to it. Row checks alone need no shuffle and are counted in place.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from quaestor.functions.expressions import sql_name, sql_text
from quaestor.functions.frames import stacked

NOT_NULL, RANGE, EXPRESSION = "not_null", "accepted_range", "expression_is_true"
UNIQUE, RELATIONSHIP, VALUES = "unique", "relationships", "accepted_values"
ROW_KINDS = (NOT_NULL, RANGE, EXPRESSION)
# Row checks whose failing pattern fits into one number.
PATTERN_BITS = 60


@dataclass(frozen=True)
class Check:
    """One check on one column; which of the other fields apply depends on the kind."""

    kind: str
    table: str
    column: str
    expression: str | None = None  # SQL text that follows the column name
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()
    parent: str | None = None
    parent_column: str | None = None
    severity: str = "error"

    @property
    def detail(self) -> str:
        if self.kind == EXPRESSION:
            return self.expression
        if self.kind == RANGE:
            return f"{self.low}..{self.high}"
        if self.kind == VALUES:
            return ", ".join(self.values)
        if self.kind == RELATIONSHIP:
            return f"{self.parent}.{self.parent_column}"
        return ""

    def fails(self) -> str:
        """SQL for whether a row fails a row check; a NULL fails only `not_null`."""
        column = sql_name(self.column)
        if self.kind == NOT_NULL:
            return f"{column} IS NULL"
        if self.kind == EXPRESSION:
            return f"NOT ({column} {self.expression})"
        bounds = (("<", self.low), (">", self.high))
        return " OR ".join(f"{column} {sign} {b}" for sign, b in bounds if b is not None)


def _lines(counted: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One line per check from one row that holds the failures of check i as `f{i}`."""
    lines = ", ".join(
        f"""struct({sql_text(c.kind)} AS check_kind, {sql_text(c.table)} AS table_name,
            {sql_text(c.column)} AS column_name, {sql_text(c.detail)} AS detail,
            {sql_text(c.severity)} AS severity, coalesce(f{i}, 0L) AS failures)"""
        for i, c in enumerate(checks)
    )
    return counted.selectExpr(f"inline(array({lines}))")


def _result(parts: list[DataFrame]) -> DataFrame:
    """All lines with their status: a failing check warns or fails by its severity."""
    return stacked(parts).selectExpr(
        "*",
        "CASE WHEN failures = 0 THEN 'pass' WHEN severity = 'warn' THEN 'warn' ELSE 'fail' END"
        " AS status",
    )


def _of_kind(checks: Iterable[Check], *kinds: str) -> list[Check]:
    return [c for c in checks if c.kind in kinds]


def row_checks(tables: Mapping[str, DataFrame], checks: Iterable[Check]) -> DataFrame:
    """Failing rows of the `not_null`, range and expression checks."""
    return _result(_row_lines(tables, checks))


def unique_checks(tables: Mapping[str, DataFrame], checks: Iterable[Check]) -> DataFrame:
    """Known keys that occur more than once."""
    return _result(_cell_lines(tables, _of_kind(checks, UNIQUE)))


def relationship_checks(tables: Mapping[str, DataFrame], checks: Iterable[Check]) -> DataFrame:
    """Rows whose known key the parent table does not have."""
    return _result(_cell_lines(tables, _of_kind(checks, RELATIONSHIP)))


def value_checks(tables: Mapping[str, DataFrame], checks: Iterable[Check]) -> DataFrame:
    """Distinct known values outside the accepted list."""
    return _result(_cell_lines(tables, _of_kind(checks, VALUES)))


def check_report(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """One line per check: what was checked, how many failures, and pass, warn or fail."""
    return _result(_cell_lines(tables, checks))


def _row_lines(tables: Mapping[str, DataFrame], checks: Iterable[Check]) -> list[DataFrame]:
    per_table: dict[str, list[Check]] = {}
    for check in _of_kind(checks, *ROW_KINDS):
        per_table.setdefault(check.table, []).append(check)
    return [
        _lines(
            tables[table].selectExpr(
                *[f"count_if({c.fails()}) AS f{i}" for i, c in enumerate(own)]
            ),
            own,
        )
        for table, own in per_table.items()
    ]


@dataclass(frozen=True)
class _Place:
    """Where a key comes from: a column, the values of a column that a check doesn't accept, or the
    failing patterns of some row checks."""

    table: str
    column: str | None = None
    values: Check | None = None
    row_checks: tuple[Check, ...] = ()

    def key(self) -> str:
        """SQL for a row's key as text, NULL for none."""
        if self.row_checks:
            bits = " + ".join(
                f"CASE WHEN {c.fails()} THEN {1 << i}L ELSE 0L END" for i, c in enumerate(self.row_checks)
            )
            return f"CAST({bits} AS string)"
        text = f"CAST({sql_name(self.column)} AS string)"
        if self.values is None:
            return text
        accepted = ", ".join(sql_text(v) for v in self.values.values)
        return f"CASE WHEN {sql_name(self.column)} NOT IN ({accepted}) THEN {text} END"


def _cell_lines(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> list[DataFrame]:
    if not checks:
        return []
    places: dict[_Place, int] = {}

    def count_of(place: _Place) -> str:
        return f"n{places.setdefault(place, len(places))}"

    patterns: dict[Check, tuple[_Place, int]] = {}
    for table in dict.fromkeys(c.table for c in checks):
        own = [c for c in checks if c.table == table and c.kind in ROW_KINDS]
        for start in range(0, len(own), PATTERN_BITS):
            place = _Place(table, row_checks=tuple(own[start : start + PATTERN_BITS]))
            patterns |= {c: (place, 1 << i) for i, c in enumerate(place.row_checks)}
    failures = []
    for i, c in enumerate(checks):
        if c.kind in ROW_KINDS:
            place, bit = patterns[c]
            n = count_of(place)
            # a customer's key may read like a pattern, so only a key from this place is one
            failing = f"sum(if({n} > 0 AND pattern & {bit}L <> 0, {n}, 0L))"
        elif c.kind == UNIQUE:
            failing = f"count_if({count_of(_Place(c.table, c.column))} > 1)"
        elif c.kind == VALUES:
            failing = f"count_if({count_of(_Place(c.table, c.column, c))} > 0)"
        else:
            own, parent = count_of(_Place(c.table, c.column)), count_of(_Place(c.parent, c.parent_column))
            failing = f"sum(CASE WHEN {parent} = 0 THEN {own} ELSE 0 END)"
        failures.append(f"{failing} AS f{i}")
    rows = []
    for table in dict.fromkeys(place.table for place in places):
        cells = ", ".join(
            f"struct({i} AS place, {place.key()} AS key)" for place, i in places.items() if place.table == table
        )
        rows.append(tables[table].selectExpr(f"inline(array({cells}))").filter("key IS NOT NULL"))
    counts = [F.count_if(F.col("place") == i).alias(f"n{i}") for i in places.values()]
    keys = stacked(rows).groupBy("key").agg(*counts)
    keyed = keys.selectExpr("*", "try_cast(key AS bigint) AS pattern")
    return [_lines(keyed.selectExpr(*failures), checks)]
