"""Histograms, box summaries and density curves as small frames of numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quaestor.operators.quantiles import exact_quantiles
from quaestor.operators.skew import known_values, weighted_values, with_group_facts

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
KERNEL_REACH = 39.0
WHISKER_REACH = 1.5  # fixed value: whiskers reach this many interquartile ranges


def bin_edge(low: Column, high: Column, bins: int, index: Column) -> Column:
    """Lower edge of a bin; the last bin's upper edge is the maximum itself."""
    return F.when(index == bins, high).otherwise(low + index * ((high - low) / F.lit(float(bins))))


def binned(
    rows: DataFrame, low: Column, high: Column, bins: int, groups: Sequence[str] = ()
) -> DataFrame:
    """`groups`, `bin` and the number `n` of values `v` of each bin that has any.

    Of bins without width the last one, which also holds its upper edge, has all values.
    """
    width = (high - low) / F.lit(float(bins))
    place = F.floor(F.try_divide(F.col("v") - low, width))
    first_guess = F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(bins - 1)).cast("long")
    guess = F.col("guess")
    settled = (
        F.when(F.col("v") < low + guess * width, guess - 1)
        .when((guess < bins - 1) & (F.col("v") >= low + (guess + 1) * width), guess + 1)
        .otherwise(guess)
    )
    return (
        rows.withColumn("guess", first_guess)
        .groupBy(*groups, settled.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in `bins` bins of equal width from minimum to maximum, empty bins included.

    A bin holds its lower edge and the last bin also the maximum. Equal values all lie in the
    middle of a range of width 1.
    """
    known = known_values(df, value)
    extent = known.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    spread = F.when(F.col("low") == F.col("high"), 0.5).otherwise(0.0)
    bounds = extent.select(
        F.struct((F.col("low") - spread).alias("low"), (F.col("high") + spread).alias("high"))
    ).scalar()
    low, high = bounds.getField("low"), bounds.getField("high")
    # Grouped by bin number, so there are at most `bins` rows to broadcast.
    return (
        df.sparkSession.range(bins).withColumnRenamed("id", "bin")
        .join(F.broadcast(binned(known, low, high, bins)), "bin", "left")
        .select(
            "bin",
            bin_edge(low, high, bins, F.col("bin")).alias("bin_start"),
            bin_edge(low, high, bins, F.col("bin") + 1).alias("bin_end"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def log_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """`histogram` of the decimal logarithm; values that have none are left out."""
    positive = df.filter(F.col(value) > 0)
    return histogram(positive.select(F.log10(F.col(value)).alias("v")), "v", bins)


def box_summary(df: DataFrame, value: str, group: str, few_groups: bool = False) -> DataFrame:
    """Quartiles, whiskers and outliers per group.

    A whisker ends at the furthest value within 1.5 interquartile ranges of the box, at the
    latest on the box itself. `few_groups` promises a small vocabulary of groups, such as need
    areas or life-cycle stages: quartiles are then broadcast, and no value is shuffled but those
    near a quartile.
    """
    if few_groups:
        rows = known_values(df, value, [group]).withColumn("w", F.lit(1))
        quartiles = exact_quantiles(df, value, QUARTILES, [group], few_groups=True)
    else:
        rows = weighted_values(df, value, [group])
        quartiles = exact_quantiles(df, value, QUARTILES, [group], weighted=rows)
    q1, q3 = F.col("q1"), F.col("q3")
    boxes = quartiles.withColumns({
        "floor": q1 - WHISKER_REACH * (q3 - q1), "ceiling": q3 + WHISKER_REACH * (q3 - q1)
    })
    if few_groups:
        boxed = rows.join(F.broadcast(boxes), group)
    else:
        boxed = with_group_facts(rows, boxes, [group], spread_by="v")
    v = F.col("v")
    below, above = v < F.col("floor"), v > F.col("ceiling")
    inside = F.when(~below & ~above, v)
    return (
        boxed
        .groupBy(group)
        .agg(
            *[F.first(fact).alias(fact) for fact in ("n", "q1", "median", "q3")],
            F.min(inside).alias("lowest"),
            F.max(inside).alias("highest"),
            F.sum(F.when(below | above, F.col("w")).otherwise(0)).alias("outliers"),
        )
        .select(
            group, "n", "q1", "median", "q3",
            F.least("lowest", "q1").alias("whisker_low"),
            F.greatest("highest", "q3").alias("whisker_high"),
            "outliers",
        )
    )


def density_curve(
    df: DataFrame,
    value: str,
    groups: Sequence[str] = (),
    points: int = 200,
    reach: float = 0.0,
) -> DataFrame:
    """Gaussian kernel density per group at `points` evenly spaced places.

    The bandwidth is the sample deviation times n ** (-1/5); the places span the values plus
    `reach` bandwidths on either side. Groups without spread have no curve. Values are reduced
    to distinct ones first, and kernels are summed on the map side per place.
    """
    groups = list(groups)
    weighted = weighted_values(df, value, groups)
    known = known_values(df, value, groups)
    bandwidth = F.stddev_samp("v") * F.pow(F.count("v").cast("double"), F.lit(-0.2))
    shape = (
        known.groupBy(*groups)
        .agg(
            F.count("v").alias("n"),
            bandwidth.alias("bandwidth"),
            F.min("v").alias("low"),
            F.max("v").alias("high"),
        )
        .filter(F.col("bandwidth") > 0)
        .withColumn("low", F.col("low") - reach * F.col("bandwidth"))
        .withColumn("high", F.col("high") + reach * F.col("bandwidth"))
    )
    step = (F.col("high") - F.col("low")) / F.lit(float(points - 1))
    place = F.col("low") + F.col("point") * step
    distance = (F.col("x") - F.col("v")) / F.col("bandwidth")
    peak = F.col("n") * F.col("bandwidth") * F.lit(math.sqrt(2 * math.pi))
    # Points a value can reach: KERNEL_REACH bandwidths away, a kernel is 0 in double precision.
    away = KERNEL_REACH * F.col("bandwidth")
    first = F.greatest(F.floor((F.col("v") - away - F.col("low")) / step), F.lit(0)).cast("int")
    last = F.least(
        F.ceil((F.col("v") + away - F.col("low")) / step), F.lit(points - 1)
    ).cast("int")
    sums = (
        with_group_facts(weighted, shape, groups, spread_by="v")
        .withColumn("point", F.explode(F.sequence(first, last)))
        .withColumn("x", place)
        .groupBy(*groups, "point")
        .agg(F.sum(F.col("w") * F.exp(-0.5 * distance * distance)).alias("kernels"))
    )
    grid = shape.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return grid.join(sums, [*groups, "point"], "left").select(
        *groups, F.col("point").cast("long").alias("point"), place.alias("x"),
        (F.coalesce("kernels", F.lit(0.0)) / peak).alias("density"),
    )
