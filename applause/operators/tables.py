"""Relational building blocks shared by the analyses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import values

GROUP_LIMIT = 1000  # Spark trims groups before the shuffle for limits below this


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows; each task keeps its own ``k`` before they meet."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, in ``rank`` order.

    Up to ``GROUP_LIMIT`` Spark trims every group inside each task before the shuffle. A longer list
    is first cut inside salted parts of the group, so a hot group is never sorted by one task alone.
    """
    if k >= GROUP_LIMIT:
        salted = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
        inner = Window.partitionBy(*group, "_part").orderBy(*order)
        df = salted.withColumn("_rank", F.row_number().over(inner)).filter(F.col("_rank") <= k)
        df = df.drop("_part", "_rank")
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def pick_movies(df: DataFrame, movies: Sequence[str], column: str = "movie", empty_means_all: bool = True) -> DataFrame:
    """Rows of the chosen movies; no choice means all rows or none, as the caller says."""
    if not movies:
        return df if empty_means_all else df.filter(F.lit(False))
    return df.filter(F.col(column).isin(list(movies)))


def with_share(df: DataFrame, value: str, name: str = "share", scale: float = 1.0) -> DataFrame:
    """Each row's part of the column total, which is a one-row aggregate."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(name, values.safe_ratio(F.col(value).cast("double"), total) * scale)


def by_maximum(df: DataFrame, value: str, name: str) -> DataFrame:
    """Divide by the column maximum; 0 where that is 0."""
    return df.withColumn(name, values.safe_ratio(F.col(value).cast("double"), df.agg(F.max(value)).scalar()))


def fill_statistics(df: DataFrame, counts: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """NULL counts become 0 as whole numbers, NULL measures become 0."""
    present = set(df.columns)
    fills = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in counts if c in present}
    fills |= {c: F.coalesce(F.col(c), F.lit(0.0)) for c in measures if c in present}
    return df.withColumns(fills) if fills else df


def replace_columns(movies: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``; a column both sides have is taken from ``incoming``."""
    clash = [c for c in incoming.columns if c != key and c in movies.columns]
    return movies.drop(*clash).join(incoming, key, "left")


def comments_per_movie(comments: DataFrame, by: str = "movie", title: str = "title") -> DataFrame:
    """Count by movie; partial counts leave each task, so a hot movie costs one row per task."""
    known = comments.filter(F.col(by).isNotNull())
    return known.groupBy(F.col(by).alias(title)).agg(F.count("*").alias("comment_count"))


def known_movies_only(comments: DataFrame, movies: DataFrame, by: str = "movie", title: str = "title") -> DataFrame:
    """Semi join: comments whose movie is in ``movies``."""
    keys = movies.select(F.col(title).alias(by))
    return comments.join(keys, by, "left_semi")


def unknown_movies_only(comments: DataFrame, movies: DataFrame, by: str = "movie", title: str = "title") -> DataFrame:
    """Anti join: comments that name no movie of ``movies``."""
    keys = movies.select(F.col(title).alias(by))
    return comments.join(keys, by, "left_anti")


def movie_list(comments: DataFrame, by: str = "movie") -> DataFrame:
    return comments.select(by).filter(F.col(by).isNotNull()).distinct().orderBy(by)


def count_values(df: DataFrame, column: Column, name: str) -> DataFrame:
    """Occurrences of each non-NULL value."""
    picked = df.select(column.alias(name)).filter(F.col(name).isNotNull())
    return picked.groupBy(name).agg(F.count("*").alias("n"))


def list_value_counts(df: DataFrame, column: str, name: str = "item") -> DataFrame:
    """Occurrences of each entry of a comma-joined list."""
    return count_values(df, F.explode(values.split_list(F.col(column))), name)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; a column one frame lacks is NULL there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
