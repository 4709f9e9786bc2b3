"""Helpers on whole frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def with_known(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where none of the columns is NULL, as a filter that scans can take over."""
    for column in columns:
        df = df.filter(F.col(column).isNotNull())
    return df


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name of many frames, pairwise: a chain would analyse its first frames again and
    again."""
    frames = list(frames)
    while len(frames) > 1:
        pairs = [frames[i : i + 2] for i in range(0, len(frames), 2)]
        frames = [p[0].unionByName(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return frames[0]
