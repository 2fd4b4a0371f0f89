"""Correlation with revenue, outliers and the composite scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import distributions, values
from ..session import cut_lineage
from . import movie_stats, tables

METRICS = {
    "positive_pct": "Positive Sentiment %",
    "comment_like_ratio": "Comment-to-Like Ratio",
    "sentiment_consistency": "Sentiment Consistency",
    "prediction_score": "Prediction Score",
}


def with_revenue(movies: DataFrame) -> DataFrame:
    return movies.filter(F.col("revenue") > 0)


def correlation(x: str, y: str = "revenue") -> Column:
    """Pearson correlation over the rows where both are known; NULL for a constant column."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a = F.when(both, F.col(x).cast("double"))
    b = F.when(both, F.col(y).cast("double"))
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    covariance = F.covar_samp(a, b)
    return F.when(varies, covariance / F.stddev_samp(a) / F.stddev_samp(b))


def revenue_correlations(movies: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row: the correlation of each metric with revenue."""
    return movies.agg(*[correlation(m).alias(m) for m in metrics])


def metric_ranking(movies: DataFrame, metrics: dict[str, str] = METRICS) -> DataFrame:
    """Metrics by strength of correlation; the first row is the best predictor."""
    one = movies.agg(*[correlation(c).alias(name) for c, name in metrics.items()])
    ranked = one.unpivot([], list(metrics.values()), "metric", "correlation")
    return ranked.orderBy(F.abs("correlation").desc_nulls_last(), "metric")


def regression_line(movies: DataFrame, x: str = "avg_polarity", y: str = "revenue", by: Sequence[str] = ()) -> DataFrame:
    """One row (per group): n, slope, intercept, r, r squared, range of x, standard error and p value of the slope.

    All but n are NULL below three movies or for constant x. A line that meets every point has error 0 and p value 0; for
    constant y the slope is 0, its error 0, and there is no p value.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = with_revenue(movies).filter(a.isNotNull())
    fit = both.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        correlation(x, y).alias("r"),
        F.min(a).alias("x_min"),
        F.max(a).alias("x_max"),
        F.stddev_samp(a).alias("_sx"),
        F.stddev_samp(b).alias("_sy"),
    )
    enough = F.col("n") >= 3
    columns = {c: F.when(enough, F.col(c)) for c in ["slope", "intercept", "r", "x_min", "x_max"]}
    line = fit.withColumns(columns).withColumn("r_squared", F.pow("r", F.lit(2.0)))
    freedom = (F.col("n") - 2).cast("double")
    left = F.greatest(1 - F.coalesce("r_squared", F.lit(0.0)), F.lit(0.0))  # share of the variance beside the line
    error = F.when(enough & (F.col("_sx") > 0), F.sqrt(left / F.when(freedom > 0, freedom)) * F.col("_sy") / F.col("_sx"))
    t = F.col("r") * F.sqrt(freedom / F.when(left > 0, left))
    p_value = F.when(F.col("r").isNotNull() & (left <= 0), F.lit(0.0)).otherwise(distributions.t_p_value(t, freedom))
    return line.withColumns({"standard_error": error, "p_value": F.when(enough, p_value)}).drop("_sx", "_sy")


def sentiment_revenue_correlation(movies: DataFrame) -> DataFrame:
    """One row: correlations, regression line with the slope's error and p value and, below three movies, an error text."""
    movies = cut_lineage(movies)
    metrics = ["avg_polarity", "positive_pct", "negative_pct"]
    line = regression_line(movies)
    rho = with_revenue(movies).agg(F.struct(*[correlation(m).alias(m) for m in metrics])).scalar()
    enough = F.col("n") >= 3
    error = F.when(~enough, F.lit("Not enough movies with revenue data for correlation analysis"))
    return line.select(
        "n",
        *[F.when(enough, rho[m]).alias(f"corr_{m}") for m in metrics],
        "slope", "intercept", "r", "r_squared", "standard_error", "p_value",
        error.alias("error"),
    )


def sampled_line(line: DataFrame, points: int = 100) -> DataFrame:
    """The regression line at evenly spaced x."""
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    step = (F.col("x_max") - F.col("x_min")) / (points - 1)
    x = F.col("x_min") + F.col("i") * step
    return line.select("slope", "intercept", "x_min", "x_max", i).select(
        "i", x.alias("x"), (F.col("slope") * x + F.col("intercept")).alias("y")
    )


def trend_ends(scores: DataFrame, x: str = "prediction_score", y: str = "revenue") -> DataFrame:
    """Both ends of the least-squares line; no row for a single or constant x."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    fit = scores.agg(
        F.count("*").alias("n"), F.min(a).alias("x_min"), F.max(a).alias("x_max"),
        F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"),
    )
    at = lambda c: F.col("slope") * F.col(c) + F.col("intercept")
    return fit.filter((F.col("n") > 1) & (F.col("x_min") < F.col("x_max"))).select(
        "x_min", at("x_min").alias("y_min"), "x_max", at("x_max").alias("y_max")
    )


def threshold_ladder(start: float, stop: float = 5.0, step: float = 0.5) -> list[float]:
    """Thresholds tried in turn: widened while below ``stop``."""
    ladder = [start]
    while ladder[-1] < stop:
        ladder.append(ladder[-1] + step)
    return ladder


def _with_z(movies: DataFrame, revenue: str) -> DataFrame:
    paid = movies.filter(F.col(revenue) > 0)
    value = F.col(revenue).cast("double")
    base = paid.agg(
        F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))
    ).scalar()
    z = F.when(base["std"] > 0, F.abs((value - base["mean"]) / base["std"])).otherwise(0.0)
    return paid.withColumns({"_z": z, "_n": base["n"]})


def _chosen_threshold(scored: DataFrame, ladder: list[float], min_movies: int) -> Column:
    """First threshold that keeps enough movies, else the widest; all are counted in one pass."""
    kept = scored.agg(F.struct(*[F.count_if(F.col("_z") <= t).alias(f"t{i}") for i, t in enumerate(ladder)])).scalar()
    pick = F.lit(ladder[-1])
    for i, t in reversed(list(enumerate(ladder))):
        pick = F.when(kept[f"t{i}"] >= min_movies, F.lit(t)).otherwise(pick)
    return pick


def without_outliers(
    movies: DataFrame, revenue: str = "revenue", threshold: float = 2.5, min_movies: int = 10
) -> DataFrame:
    """Paid movies within ``threshold`` deviations of the mean; all of them if they are few."""
    scored = _with_z(cut_lineage(movies), revenue)  # the rows per movie are read for the mean, the ladder and the result
    limit = _chosen_threshold(scored, threshold_ladder(threshold), min_movies)
    return scored.filter((F.col("_n") <= min_movies) | (F.col("_z") <= limit)).drop("_z", "_n")


def outlier_summary(
    movies: DataFrame, revenue: str = "revenue", threshold: float = 2.5, min_movies: int = 10
) -> DataFrame:
    """One row: paid movies, kept, left out, the part left out and the starting threshold."""
    scored = _with_z(cut_lineage(movies), revenue)
    limit = _chosen_threshold(scored, threshold_ladder(threshold), min_movies)
    kept = (F.col("_n") <= min_movies) | (F.col("_z") <= limit)
    one = scored.withColumn("_kept", kept).agg(
        F.count("*").alias("total_box_office_movies"), F.count_if("_kept").alias("normal_range_count")
    )
    out = F.col("total_box_office_movies") - F.col("normal_range_count")
    return one.select(
        "total_box_office_movies",
        "normal_range_count",
        out.alias("outlier_count"),
        (values.safe_ratio(out, F.col("total_box_office_movies")) * 100).alias("outlier_pct"),
        F.lit(threshold).alias("z_score_threshold"),
    )


def composite_scores(comments: DataFrame, movies: DataFrame, by: str = "movie") -> DataFrame:
    """Positive part, relative comment count and mean polarity, weighted 0.5 / 0.3 / 0.2.

    The rows per movie are written once, so the maximum does not read the comments again.
    """
    n = F.count("*")
    s = F.col("sentiment")
    has = set(comments.columns)
    aggregates = {
        "positive_ratio": F.count_if(s == values.POSITIVE) / n if "sentiment" in has else F.lit(0.0),
        "comment_count": n.cast("double"),
        "avg_polarity": F.avg("polarity") if "polarity" in has else F.lit(0.0),
    }
    per_movie = comments.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("title")).agg(
        *[c.alias(name) for name, c in aggregates.items()]
    )
    joined = cut_lineage(movies.select("title", "revenue").join(per_movie, "title", "left").na.fill(0))
    scaled = tables.by_maximum(joined, "comment_count", "normalized_count")
    score = 0.5 * F.col("positive_ratio") + 0.3 * F.col("normalized_count") + 0.2 * F.col("avg_polarity")
    return scaled.withColumn("composite_score", score)


def composite_correlations(scores: DataFrame) -> DataFrame:
    return revenue_correlations(scores, ["positive_ratio", "normalized_count", "avg_polarity", "composite_score"])


def prediction_scores(comments: DataFrame, movies: DataFrame, by: str = "movie") -> DataFrame:
    """Engagement of paid movies with the weighted prediction score.

    Without any likes every score is 0; where the largest ratio is 0 its term is 0. The rows per movie are
    written once, so neither the maxima nor later steps read the comments again.
    """
    paid = with_revenue(movies).select("title", "revenue")
    metrics = cut_lineage(paid.join(movie_stats.engagement(comments, by), "title"))
    top = metrics.agg(
        F.struct(F.max("comment_like_ratio").alias("ratio"), F.max("like_count").alias("likes"))
    ).scalar()
    calm = F.when(top["ratio"] > 0, 0.3 * (1 - F.col("comment_like_ratio") / top["ratio"])).otherwise(0.0)
    score = (
        0.3 * F.col("positive_pct") / 100
        + calm
        + 0.2 * F.col("sentiment_consistency")
        + 0.2 * F.col("like_count") / top["likes"]
    )
    return metrics.withColumn("prediction_score", F.when(top["likes"] > 0, score).otherwise(0.0))


def relative_to_mean(scores: DataFrame, column: str = "prediction_score") -> DataFrame:
    """How far each score lies from the mean score, in percent."""
    mean = scores.agg(F.avg(column)).scalar()
    return scores.withColumn("vs_average_pct", (F.try_divide(F.col(column), mean) - 1) * 100)


def prediction_table(scores: DataFrame) -> DataFrame:
    """The score table as displayed, by revenue."""
    return scores.select(
        F.col("title").alias("Movie"),
        F.bround(F.col("revenue") / 1e6, 1).alias("Revenue ($M)"),
        F.bround("prediction_score", 2).alias("Prediction Score"),
        F.bround("positive_pct", 1).alias("Positive Sentiment (%)"),
        F.col("like_count").alias("Likes"),
        F.bround("comment_like_ratio", 4).alias("Comment-to-Like Ratio"),
        F.bround("sentiment_consistency", 2).alias("Sentiment Consistency"),
    ).orderBy(F.col("Revenue ($M)").desc_nulls_last(), "Movie")


def top_revenue(movies: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best-earning movies."""
    return tables.top_k(with_revenue(movies).select("title", "revenue"), [F.desc("revenue"), F.asc("title")], k)


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / sample deviation for each column; 0 where the deviation is 0."""
    base = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]
        )
    ).scalar()
    z = {
        f"{c}_z": F.when(base[f"s_{c}"] > 0, (F.col(c) - base[f"m_{c}"]) / base[f"s_{c}"]).otherwise(0.0)
        for c in columns
    }
    return df.withColumns(z)
