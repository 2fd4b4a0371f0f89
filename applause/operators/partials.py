"""Statistics that are stored in parts, one row per movie and batch, and merged when they are read.

An appended batch is read once; earlier comments are never read again. A batch that is repeated replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import values
from ..schemas import require_columns
from ..session import cut_lineage, release
from ..sources import writers
from . import movie_stats, tables

MERGED = "comment_count positive_count negative_count known_count likes_count".split()


def partials(comments: DataFrame, keys: Sequence[str] = ("movie", "batch_id")) -> DataFrame:
    """Counts, likes, and the mean and squared deviations of polarity, one row per key.

    ``known_count`` counts the polarities that are neither NULL nor NaN; ``mean`` and ``deviations`` are NULL where it
    is 0. Rows whose first key is NULL belong to no movie and are left out. Columns that the comments lack count as NULL.
    """
    require_columns(comments, keys, "comments")
    has = set(comments.columns)

    def column(name: str, kind: str):
        return (F.col(name) if name in has else F.lit(None)).cast(kind)

    polarity = F.nanvl(column("polarity", "double"), F.lit(None).cast("double"))
    read = comments.filter(F.col(keys[0]).isNotNull()).select(
        *keys, column("sentiment", "string").alias("_s"), polarity.alias("_p"), column("likes", "bigint").alias("_l")
    )
    return read.groupBy(*keys).agg(
        F.count("*").alias("comment_count"),
        F.count_if(F.col("_s") == values.POSITIVE).alias("positive_count"),
        F.count_if(F.col("_s") == values.NEGATIVE).alias("negative_count"),
        F.count("_p").alias("known_count"),
        F.coalesce(F.sum("_l"), F.lit(0)).alias("likes_count"),
        F.avg("_p").alias("mean"),
        (F.var_pop("_p") * F.count("_p")).alias("deviations"),
    )


def merge(parts: DataFrame, keys: Sequence[str] = ("movie",)) -> DataFrame:
    """Rows of :func:`partials` for coarser keys, so the result can be merged again.

    The deviations of a part move by the distance of its mean from the common mean, which a first aggregate gives;
    the difference of two large sums is never taken.
    """
    whole = parts.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in MERGED],
        (F.sum(F.col("mean") * F.col("known_count")) / F.nullif(F.sum("known_count"), F.lit(0))).alias("mean"),
    )
    own = parts.select(*keys, F.col("known_count").alias("_n"), F.col("mean").alias("_mean"), F.col("deviations").alias("_d"))
    on = [own[k].eqNullSafe(whole[k]) for k in keys]
    joined = own.join(whole.select(*keys, "mean"), on) if keys else own.withColumn("mean", whole.select("mean").scalar())
    picked = joined.select(*[own[k] for k in keys], "_n", "_mean", "_d", "mean")
    apart = F.col("_mean") - F.col("mean")
    moved = picked.groupBy(*keys).agg(F.sum(F.col("_d") + F.col("_n") * apart * apart).alias("deviations"))
    if not keys:
        return whole.withColumn("deviations", moved.scalar())
    moved = moved.select(*[F.col(k).alias(f"_{k}") for k in keys], "deviations")
    return whole.join(moved, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").select(*whole.columns, "deviations")


def append(comments: DataFrame, path: str, by: str = "movie", batch: str = "batch_id") -> None:
    """Add the batches in ``comments`` to the partials below ``path``, each whole; a repeated batch replaces itself."""
    writers.write_snapshots(partials(comments, [by, batch]), path, batch)


def read(spark: SparkSession, path: str, upto: int | None = None, batch: str = "batch_id") -> DataFrame:
    """Partials of all batches, or of those up to and including ``upto``."""
    return spark.read.parquet(path) if upto is None else writers.read_snapshot(spark, path, upto, batch)


def compact(spark: SparkSession, path: str, target: str, upto: int, by: str = "movie", batch: str = "batch_id") -> None:
    """A copy in which all batches up to ``upto`` are one, under that number, and later ones stay as they are.

    The store that is read is left alone, so a run that stops half-way loses nothing.
    """
    kept, early = read(spark, path), F.coalesce(F.col(batch) <= upto, F.lit(False))
    old = cut_lineage(kept.filter(early))
    one = merge(old, [by]).withColumn(batch, F.lit(upto).cast(dict(kept.dtypes)[batch]))
    writers.write_snapshots(one.unionByName(kept.filter(~early)), target, batch)
    release(old)


def statistics(parts: DataFrame, by: str = "movie") -> DataFrame:
    """Counts, shares, mean and deviation of polarity per movie, from partials of any batches.

    ``polarity_std`` is the sample deviation, NULL below two known polarities; ``avg_polarity`` is NULL without any.
    """
    merged = merge(parts, [by])
    n, known = F.col("comment_count"), F.col("known_count")
    neutral = n - F.col("positive_count") - F.col("negative_count")
    return merged.select(
        by, "comment_count", "positive_count", "negative_count", neutral.alias("neutral_count"),
        (F.col("positive_count") / n * 100).alias("positive_pct"),
        (F.col("negative_count") / n * 100).alias("negative_pct"),
        (neutral / n * 100).alias("neutral_pct"),
        F.col("mean").alias("avg_polarity"),
        F.when(known > 1, F.sqrt(F.col("deviations") / (known - 1))).alias("polarity_std"),
        "likes_count",
    )


def movie_statistics(parts: DataFrame, movies: DataFrame, by: str = "movie", key: str = "title") -> DataFrame:
    """As :func:`movie_stats.movie_sentiment_stats`, from partials."""
    stats = statistics(parts, by).drop("polarity_std", "likes_count").withColumnRenamed(by, key)
    joined = tables.replace_columns(movies, stats, key)
    return tables.fill_statistics(movie_stats.repair_revenue(joined), movie_stats.COUNTS, [*movie_stats.SHARES, "avg_polarity"])


def totals(parts: DataFrame) -> DataFrame:
    """One row over all movies: counts, mean and sample deviation of polarity."""
    known = F.col("known_count")
    return merge(parts, []).select(
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in MERGED], F.col("mean").alias("avg_polarity"),
        F.when(known > 1, F.sqrt(F.col("deviations") / (known - 1))).alias("polarity_std"),
    )
