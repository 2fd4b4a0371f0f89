"""Per-movie, per-cluster and whole-table aggregates of scored comments."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values
from ..schemas import require_columns
from ..session import cut_lineage
from . import tables

COUNTS = ["comment_count", "positive_count", "negative_count", "neutral_count"]
SHARES = ["positive_pct", "negative_pct", "neutral_pct"]


def _counts_and_shares(comments: DataFrame, by: str, positive: Column, negative: Column, mean: Column) -> DataFrame:
    """One pass: counts, mean, then the remainder and the shares."""
    grouped = comments.filter(F.col(by).isNotNull()).groupBy(by).agg(
        F.count("*").alias("comment_count"),
        F.count_if(positive).alias("positive_count"),
        F.count_if(negative).alias("negative_count"),
        mean.alias("_mean"),
    )
    n = F.col("comment_count")
    neutral = n - F.col("positive_count") - F.col("negative_count")
    return grouped.select(
        by,
        *COUNTS[:3],
        neutral.alias("neutral_count"),
        (F.col("positive_count") / n * 100).alias("positive_pct"),
        (F.col("negative_count") / n * 100).alias("negative_pct"),
        (neutral / n * 100).alias("neutral_pct"),
        "_mean",
    )


def mean_polarity(comments: DataFrame, sentiment: str = "sentiment") -> Column:
    """Mean polarity, or the balance of categories where there is no polarity column."""
    if "polarity" in comments.columns:
        return F.avg("polarity")
    s = F.col(sentiment)
    return (F.count_if(s == values.POSITIVE) - F.count_if(s == values.NEGATIVE)) / F.count("*")


def repair_revenue(movies: DataFrame) -> DataFrame:
    """Numeric revenue, filled from the currency string where it is unknown or 0."""
    if "revenue" not in movies.columns:
        return movies
    revenue = F.col("revenue")
    if dict(movies.dtypes)["revenue"] == "string":
        revenue = values.to_number(revenue, "double")
    if "box_office" in movies.columns:
        revenue = values.currency_fallback(revenue, F.col("box_office"))
    return movies.withColumn("revenue", revenue)


def movie_sentiment_stats(comments: DataFrame, movies: DataFrame, by: str = "movie", key: str = "title") -> DataFrame:
    """Movies with comment counts, sentiment shares and mean polarity; 0 where a movie has no comments."""
    s = F.col("sentiment")
    stats = _counts_and_shares(
        comments, by, s == values.POSITIVE, s == values.NEGATIVE, mean_polarity(comments)
    ).withColumnsRenamed({by: key, "_mean": "avg_polarity"})
    joined = tables.replace_columns(movies, stats, key)
    return tables.fill_statistics(repair_revenue(joined), COUNTS, [*SHARES, "avg_polarity"])


def score_columns(comments: DataFrame) -> tuple[Column, Column, Column] | None:
    """(positive, negative, mean) by what the comments hold.

    A category column comes first, then a numeric ``sentiment``, then ``polarity``. ``None`` where
    nothing can be counted.
    """
    kinds = dict(comments.dtypes)
    numeric = re.match("double|float|decimal|(big|small|tiny)?int$", kinds.get("sentiment", "")) is not None
    if "sentiment_category" in kinds:
        c = F.col("sentiment_category")
        positive, negative = c == values.POSITIVE, c == values.NEGATIVE
    elif numeric or "polarity" in kinds:
        c = F.col("sentiment" if numeric else "polarity")
        positive, negative = c > 0, c < 0
    else:
        return None
    if numeric or "polarity" in kinds:
        mean = F.avg("sentiment" if numeric else "polarity")
    else:
        mean = (F.count_if(positive) - F.count_if(negative)) / F.count("*")
    return positive, negative, mean


def _numeric_stats(comments: DataFrame, by: str, key: str) -> DataFrame | None:
    if by not in comments.columns or not {"sentiment", "polarity"} & set(comments.columns):
        return None
    picked = score_columns(comments)
    if picked is None:
        return None
    return _counts_and_shares(comments, by, *picked).withColumnsRenamed({by: key, "_mean": "avg_sentiment"})


def numeric_sentiment_stats(comments: DataFrame, movies: DataFrame, by: str = "movie", key: str = "title") -> DataFrame:
    """As :func:`movie_sentiment_stats` on scores; movies come back unchanged where nothing can be counted."""
    stats = _numeric_stats(comments, by, key)
    if stats is None:
        return movies
    joined = tables.replace_columns(movies, stats, key)
    return tables.fill_statistics(joined, COUNTS, [*SHARES, "avg_sentiment"])


def movie_sentiment(comments: DataFrame, by: str = "movie", key: str = "title") -> DataFrame:
    """Shares of positive and negative comments, mean polarity and count per movie."""
    s = F.col("sentiment")
    n = F.count("*")
    positive = F.count_if(s == values.POSITIVE) / n * 100
    negative = F.count_if(s == values.NEGATIVE) / n * 100
    mean = F.avg("polarity") if "polarity" in comments.columns else (positive - negative) / 100
    return comments.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias(key)).agg(
        positive.alias("positive_pct"), negative.alias("negative_pct"), mean.alias("avg_polarity"),
        n.alias("comment_count"),
    )


def with_movie_sentiment(movies: DataFrame, sentiment: DataFrame, key: str = "title") -> DataFrame:
    """Movies with their sentiment shares; NULL where a movie has no comments."""
    return tables.replace_columns(movies, sentiment.drop("comment_count"), key)


def sentiment_distribution(comments: DataFrame, column: str = "sentiment", by: str | None = None) -> DataFrame | None:
    """Counts per category, or per group one column per category; ``None`` where a column is missing."""
    if column not in comments.columns or (by is not None and by not in comments.columns):
        return None
    known = comments.filter(F.col(column).isNotNull())
    if by is None:
        return known.groupBy(column).agg(F.count("*").alias("count"))
    counts = [F.count_if(F.col(column) == c).alias(c) for c in values.CATEGORIES]
    return known.filter(F.col(by).isNotNull()).groupBy(by).agg(*counts)


def row_shares(pivot: DataFrame, scale: float = 1.0) -> DataFrame:
    """Each category as its part of the row sum."""
    total = sum((F.col(c) for c in values.CATEGORIES), F.lit(0))
    return pivot.withColumns({c: values.safe_ratio(F.col(c).cast("double"), total) * scale for c in values.CATEGORIES})


def sentiment_by_cluster(comments: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Row-normalised cross table of cluster and sentiment."""
    return row_shares(sentiment_distribution(comments, by=cluster))


def long_counts(pivot: DataFrame, by: str) -> DataFrame:
    """Category columns as (Movie, Sentiment, Count) rows."""
    return pivot.withColumnRenamed(by, "Movie").unpivot("Movie", values.CATEGORIES, "Sentiment", "Count")


def dashboard_metrics(movies: DataFrame, comments: DataFrame, r_squared: Column | None = None) -> DataFrame:
    """One row of headline numbers; both tables are reduced to one row before they meet."""
    s = F.col("sentiment")
    m = movies.agg(F.struct(F.count("*").alias("n"), F.avg("revenue").alias("revenue"))).scalar()
    one = comments.agg(
        F.count("*").alias("total_comments"),
        F.count_if(s == values.POSITIVE).alias("_pos"),
        F.count_if(s == values.NEGATIVE).alias("_neg"),
        F.count("sentiment").alias("_known"),
    )
    columns = [
        m["n"].alias("total_movies"),
        m["revenue"].alias("avg_revenue"),
        "total_comments",
        values.safe_ratio(F.col("total_comments"), m["n"]).alias("avg_comments_per_movie"),
        (values.safe_ratio(F.col("_pos"), F.col("_known")) * 100).alias("positive_pct"),
        (values.safe_ratio(F.col("_neg"), F.col("_known")) * 100).alias("negative_pct"),
    ]
    if r_squared is not None:
        columns.append(r_squared.alias("sentiment_correlation"))
    return one.select(*columns)


def dataset_status(movies: DataFrame, comments: DataFrame) -> DataFrame:
    """Movies, comments, comments per movie, and movies with revenue and their part."""
    m = movies.agg(F.struct(F.count("*").alias("n"), F.count_if(F.col("revenue") > 0).alias("paid"))).scalar()
    one = comments.agg(F.count("*").alias("comments"))
    return one.select(
        m["n"].alias("movies"),
        "comments",
        values.safe_ratio(F.col("comments"), m["n"]).alias("comments_per_movie"),
        m["paid"].alias("movies_with_revenue"),
        values.safe_ratio(m["paid"], m["n"]).alias("revenue_share"),
    )


def engagement(comments: DataFrame, by: str = "movie", key: str = "title") -> DataFrame:
    """Likes, comments per like, positive share and sentiment consistency per movie."""
    n = F.count("*")
    s = F.col("sentiment")
    has = set(comments.columns)
    likes = F.coalesce(F.sum("likes"), F.lit(0)) if "likes" in has else F.lit(0)

    def share(c: str) -> Column:
        return F.count_if(s == c) / n * 100

    if "sentiment" not in has:
        positive, consistency = F.lit(0.0), F.lit(0.0)
    elif "polarity" in has:
        positive, consistency = share(values.POSITIVE), 1 - F.stddev_samp("polarity")
    else:
        positive = share(values.POSITIVE)
        consistency = consistency_from_shares(positive, share(values.NEGATIVE), share(values.NEUTRAL))
    return comments.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias(key)).agg(
        likes.cast("bigint").alias("like_count"),
        positive.alias("positive_pct"),
        (values.safe_ratio(n, likes) if "likes" in has else F.lit(0.0)).alias("comment_like_ratio"),
        consistency.alias("sentiment_consistency"),
    )


def consistency_from_shares(positive: Column, negative: Column, neutral: Column) -> Column:
    """Distance of the category shares from a 50/25/25 split, turned into a score."""
    return 1 - (F.abs(positive - 50) + F.abs(negative - 25) + F.abs(neutral - 25)) / 100


def cluster_sizes(comments: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Comments per cluster and their part of all comments, in percent."""
    counts = comments.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("count"))
    return tables.with_share(counts, "count", "percentage", 100.0)


def dominant_sentiment(comments: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Most frequent category per cluster; the alphabetically first wins a tie."""
    counts = comments.filter(F.col(cluster).isNotNull() & F.col("sentiment").isNotNull()).groupBy(
        cluster, "sentiment"
    ).agg(F.count("*").alias("n"))
    best = F.min_by("sentiment", F.struct(-F.col("n"), F.col("sentiment")))
    return counts.groupBy(cluster).agg(best.alias("dominant_sentiment"), F.max("n").alias("n"))


def dominant_cluster(comments: DataFrame, cluster: str = "cluster") -> DataFrame:
    """The largest cluster with its part of all comments; the smaller id wins a tie."""
    return tables.top_k(cluster_sizes(comments, cluster), [F.desc("count"), F.asc(cluster)], 1)


def sentiment_stats_map(comments: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per cluster a map category -> (count, percentage)."""
    counts = sentiment_distribution(comments, by=cluster)
    total = sum((F.col(c) for c in values.CATEGORIES), F.lit(0))
    entries = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("key"),
                    F.struct(
                        F.col(c).alias("count"), (values.safe_ratio(F.col(c), total) * 100).alias("percentage")
                    ).alias("value"),
                )
                for c in sorted(values.CATEGORIES)
            ]
        ),
        lambda e: e["value"]["count"] > 0,
    )
    return counts.select(cluster, F.map_from_entries(entries).alias("sentiment_stats"))


def integration_gate(comments: DataFrame, movies: DataFrame, min_comments: int = 50) -> DataFrame:
    """Movies with their comment count, kept if there are enough comments and a positive revenue."""
    counted = tables.replace_columns(movies, tables.comments_per_movie(comments), "title")
    counted = tables.fill_statistics(counted, ["comment_count"], [])
    return counted.filter((F.col("comment_count") >= min_comments) & (F.col("revenue") > 0))


def integrate(comments: DataFrame, movies: DataFrame, min_comments: int = 50) -> tuple[DataFrame, DataFrame]:
    """Valid movies with sentiment statistics, and their comments.

    Both inputs come back unchanged if no movie is valid; that one test reads a single row.
    """
    require_columns(comments, ["movie"], "comments")
    require_columns(movies, ["title", "revenue"], "movies")
    stats = _numeric_stats(comments, "movie", "title")
    counted = tables.comments_per_movie(comments) if stats is None else stats
    # one row per movie: the gate and the statistics are both taken from it
    joined = cut_lineage(tables.replace_columns(movies, counted, "title"))
    enough = F.coalesce(F.col("comment_count") >= min_comments, F.lit(min_comments <= 0))
    valid = joined.filter(enough & (F.col("revenue") > 0))
    if valid.isEmpty():
        return movies, comments
    shares = [] if stats is None else [*SHARES, "avg_sentiment"]
    valid = tables.fill_statistics(valid, ["comment_count"] if stats is None else COUNTS, shares)
    return valid, tables.known_movies_only(comments, valid)


def integration_summary(comments: DataFrame, movies: DataFrame, min_comments: int = 50) -> DataFrame:
    """Total and valid movies, and the valid part in percent."""
    counted = tables.replace_columns(movies, tables.comments_per_movie(comments), "title")
    counted = tables.fill_statistics(counted, ["comment_count"], [])
    ok = (F.col("comment_count") >= min_comments) & (F.col("revenue") > 0)
    one = counted.agg(F.count("*").alias("total_movies"), F.count_if(ok).alias("valid_movies"))
    return one.withColumn(
        "retention_rate", values.safe_ratio(F.col("valid_movies"), F.col("total_movies")) * 100
    )


def integration_checks(movies: DataFrame, comments: DataFrame) -> DataFrame:
    """One row per check: how many rows break it and whether it passes."""
    wanted = ["avg_sentiment", "positive_pct", "negative_pct"]
    missing = len([c for c in wanted if c not in movies.columns])
    on_movies = movies.agg(
        F.count_if(F.col("revenue").isNull() | (F.col("revenue") <= 0)).alias("revenue"),
        F.count_if(F.col("comment_count") <= 0).alias("comments"),
        F.lit(missing).cast("bigint").alias("sentiment_columns"),
    )
    orphans = tables.unknown_movies_only(comments, movies) if "movie" in comments.columns else comments.limit(0)
    per_check = on_movies.withColumn("known_movies", orphans.agg(F.count("*")).scalar())
    names = ["revenue", "comments", "known_movies", "sentiment_columns"]
    rows = per_check.unpivot([], names, "check", "violations")
    return rows.withColumn("passed", F.col("violations") == 0)
