"""Ranking with explicit ties, thresholds and back-fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(scored: DataFrame, by: list[str], k: int, ties: list[str | Column], score: str = "score", threshold: float | None = None, backfill: bool = True) -> DataFrame:
    """K1 to K5: the ``k`` best rows of each group with their rank.

    Scores are rounded to six places before they are compared, and ``ties`` decide after that. As the list is
    ordered by score, padding with the best below the threshold is the same as not asking for it; without
    ``backfill`` rows below it are left out.
    """
    rounded = scored.withColumn(score, F.round(score, 6))
    if threshold is not None and not backfill:
        rounded = rounded.where(F.col(score) >= threshold)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *ties))
    return rounded.withColumn("rank", rank).where(F.col("rank") <= k)


def best_fragment(scored: DataFrame, owner: list[str], place: str, score: str = "score") -> DataFrame:
    """Best score of each owner and the first fragment that attains it."""
    rounded = scored.withColumn(score, F.round(score, 6))
    return rounded.groupBy(*owner).agg(F.max(score).alias(score), F.max_by(place, F.struct(F.col(score), (-F.col(place)).alias("_first"))).alias(place))
