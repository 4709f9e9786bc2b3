"""Exact quantiles of groups of any size, by linear interpolation.

No task sees a whole group. Every requested rank lies between two values; these bounds are cut into
a fixed number of cells of equal width, rows are counted per cell, and the cell that holds the rank
gives the next bounds. Counts are exact, so it does not matter how well the first bounds fit: a
mergeable sketch gives close ones, the extremes of the group always valid ones. After few rounds
what is left between the bounds is counted value by value. What a task ranks is a group's cells,
never its values: their number does not depend on the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quaestor.operators.skew import known_values, weighted_values, with_group_facts

# Relative rank error of the sketch, and how far beyond it the first bounds reach on either side.
SKETCH_ACCURACY = 1_000
REACH = 2 / SKETCH_ACCURACY
# Cells between two bounds, and rounds of counting after the first; the last counts each value.
CELLS = 1_024
ROUNDS = 2


def scale_of(low: Column, high: Column, cells: int) -> Column:
    """Cells per unit between two bounds; NULL for equal ones."""
    return F.try_divide(F.lit(float(cells)), high - low)


def cell_of(v: Column, low: Column, scale: Column, cells: int) -> Column:
    """Number of the cell of equal width that a value between two bounds falls into.

    It never falls as the value rises, whatever is rounded, so cells are disjoint stretches of
    values. Equal and infinitely distant bounds have one cell.
    """
    return F.coalesce(F.least(F.floor((v - low) * scale), F.lit(cells - 1)).cast("int"), F.lit(0))


def _compressed(v: Column, least: Column) -> Column:
    """Grows as the logarithm does on either side of zero, from `least` on."""
    return F.signum(v) * F.log1p(F.try_divide(F.abs(v), least))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Mapping[str, float],
    groups: Sequence[str] = (),
    moments: Mapping[str, Column] | None = None,
    weighted: DataFrame | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """`groups`, the number of known values `n`, and one column per named probability.

    `moments` are further aggregates of the value, there as `v`, taken in the first pass.
    `weighted` are the frame's `weighted_values`, if at hand. NULL groups are left out.

    `few_groups` promises that the number of groups is bounded by something small, such as the
    columns of a table. Bounds are then broadcast, and a value leaves the task that reads it only
    as part of a count; otherwise the distinct values are shuffled to the bounds of their group.
    Only groups with ranks that the first counts leave open are read again.
    """
    groups, moments = list(groups), dict(moments or {})
    if not groups:
        everything = df.withColumn("_all", F.lit(0))
        return exact_quantiles(
            everything, value, probabilities, ["_all"], moments, few_groups=True
        ).drop("_all")
    names = sorted(probabilities, key=probabilities.get)
    known = known_values(df, value, groups)
    carried = ["n", *moments]
    v, low, high, scale = (F.col(c) for c in ("v", "low_", "high_", "scale_"))
    if few_groups:
        reach = [
            min(max(probabilities[name] + side, 0.0), 1.0)
            for name in names
            for side in (-REACH, REACH)
        ]
        ends = F.percentile_approx("v", reach, F.lit(SKETCH_ACCURACY))
        rows = known.withColumn("w", F.lit(1))
    else:
        # Exact ones, so that a part which runs again after a lost executor sees the same.
        ends = F.array(F.min("v"), F.max("v"))
        rows = weighted_values(df, value, groups) if weighted is None else weighted
    facts = known.groupBy(*groups).agg(
        ends.alias("ends_"), F.count(F.lit(1)).alias("n"),
        *[moment.alias(name) for name, moment in moments.items()],
    )
    ends = F.col("ends_")

    def beside(facts: DataFrame) -> DataFrame:
        if few_groups:
            return rows.join(F.broadcast(facts), groups)
        return with_group_facts(rows, facts, groups, spread_by="v")

    if few_groups:
        pairs = [(ends[2 * i], ends[2 * i + 1]) for i in range(len(names))]
        bounds = {
            f"{side}_{i}": x
            for i, (a, b) in enumerate(pairs)
            for side, x in (("low", a), ("high", b), ("scale", scale_of(a, b, CELLS)))
        }
        piece = _piece(v, len(names))
    else:
        # Extremes may be many powers of ten apart.
        least = F.greatest(F.abs(ends[0]), F.abs(ends[1])) / 2.0**60
        first, last = _compressed(ends[0], least), _compressed(ends[1], least)
        bounds = {"least_": least, "low_": first, "scale_": scale_of(first, last, CELLS)}
        piece = cell_of(_compressed(v, F.col("least_")), low, scale, CELLS)
    facts = facts.select(*groups, *carried, *[x.alias(name) for name, x in bounds.items()])
    pieces = beside(facts).groupBy(*groups, piece.alias("piece_")).agg(
        F.sum("w").alias("w"), F.min("v").alias("low"), F.max("v").alias("high"),
        *[F.first(c).alias(c) for c in carried],
    )
    by_value = Window.partitionBy(*groups).orderBy("low")
    ranked = _with_ranks(pieces, by_value, F.lit(0))
    position = {name: (F.col("n") - 1) * F.lit(float(probabilities[name])) for name in names}
    ranks = [side(position[name]) for name in names for side in (F.floor, F.ceil)]
    found = ranked.groupBy(*groups).agg(
        *[F.first(c).alias(c) for c in carried],
        *[F.max(F.when(_covers(rank), F.struct("low", "high", "start", "stop"))).alias(f"piece_{i}")
          for i, rank in enumerate(ranks)],
    )
    wanted = F.explode(F.array(*[
        F.struct(F.lit(i).alias("target"), rank.alias("rank"), F.col(f"piece_{i}").alias("piece"))
        for i, rank in enumerate(ranks)
    ]))
    first = found.select(*groups, *carried, wanted.alias("t")).select(
        *groups, *carried, "t.target", "t.rank", "t.piece.*"
    )
    # The rank of a piece's first or last row, or in a piece of equal values, is known.
    settled = (
        F.when((F.col("rank") == F.col("start")) | (F.col("low") == F.col("high")), F.col("low"))
        .when(F.col("rank") == F.col("stop") - 1, F.col("high"))
    )
    left = first.filter(settled.isNull())
    for turn in range(ROUNDS if few_groups else ROUNDS + 1, 0, -1):
        own = left.select(
            *groups, *carried, "target", "rank", "start", F.col("low").alias("low_"), F.col("high").alias("high_"),
            scale_of(F.col("low"), F.col("high"), CELLS).alias("scale_"),
        )
        inside = beside(own).filter(v.between(low, high))
        part = v if turn == 1 else cell_of(v, low, scale, CELLS)
        counted = inside.groupBy(*groups, "target", part.alias("part_")).agg(
            F.sum("w").alias("w"), F.min("v").alias("low"), F.max("v").alias("high"),
            *[F.first(c).alias(c) for c in (*carried, "rank", "start")],
        )
        by_value = Window.partitionBy(*groups, "target").orderBy("low")
        left = _with_ranks(counted, by_value, F.col("start")).filter(_covers(F.col("rank"))).select(*first.columns)
    values = first.unionByName(left).withColumn("value", settled)
    picked = values.groupBy(*groups).agg(
        *[F.first(c).alias(c) for c in carried],
        *[F.max(F.when(F.col("target") == i, F.col("value"))).alias(f"value_{i}") for i in range(len(ranks))],
    )

    def interpolated(i: int, name: str) -> Column:
        below, above = F.col(f"value_{2 * i}"), F.col(f"value_{2 * i + 1}")
        share = position[name] - F.floor(position[name])
        return F.when(below == above, below).otherwise(below + (above - below) * share)

    quantiles = {name: interpolated(i, name) for i, name in enumerate(names)}
    return picked.select(*groups, "n", *moments, *[quantiles[name].alias(name) for name in probabilities])


def _piece(v: Column, pairs: int) -> Column:
    """A number for the cell a value falls into, if it is between a pair of bounds, or for the gap.

    Pairs ascend and may overlap; a value belongs to the first that holds it.
    """
    piece = F.lit(2 * pairs * CELLS)
    for i in reversed(range(pairs)):
        low, high, scale = (F.col(f"{c}_{i}") for c in ("low", "high", "scale"))
        inside = (2 * i + 1) * CELLS + cell_of(v, low, scale, CELLS)
        piece = F.when(v < low, 2 * i * CELLS).when(v <= high, inside).otherwise(piece)
    return piece


def _with_ranks(pieces: DataFrame, by_value: Window, first: Column) -> DataFrame:
    """The ranks [start, stop) that each piece covers, counted from `first` on."""
    so_far = by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pieces.withColumn("stop", first + F.sum("w").over(so_far)).withColumn(
        "start", F.col("stop") - F.col("w")
    )


def _covers(rank: Column) -> Column:
    return (rank >= F.col("start")) & (rank < F.col("stop"))
