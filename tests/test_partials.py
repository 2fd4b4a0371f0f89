import math
import statistics

import pytest

from applause.operators import movie_stats, partials
from applause.session import scratch_path

SCHEMA = "movie string, batch_id int, sentiment string, polarity double, likes bigint, mean string"
ROWS = [
    ("a", 0, "positive", 0.5, 1, "x"), ("a", 0, "negative", -0.5, 2, "x"), ("a", 1, "neutral", None, None, "x"),
    ("a", 2, "positive", float("nan"), 3, "x"), ("b", 1, "positive", 0.25, None, "x"), (None, 1, "positive", 0.1, 9, "x"),
    ("a", 1, None, 0.75, 4, "x"), ("a", 1, None, 0.75, 4, "x"), ("", 2, "positive", 0.1, 1, "x"),
]


@pytest.fixture
def comments(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


def stored(spark, *frames):
    path = scratch_path(spark, "partials")
    for df in frames:
        partials.append(df, path)
    return path


def test_appended_batches_equal_one_pass(spark, comments):
    one = stored(spark, comments)
    many = stored(spark, *[comments.filter(f"batch_id = {i}") for i in (2, 0, 1)])
    got = partials.statistics(partials.read(spark, many))
    assert rows(got) == rows(partials.statistics(partials.read(spark, one)))
    known = [0.5, -0.5, 0.75, 0.75]
    a = {x.movie: x for x in got.collect()}["a"]
    assert (a.comment_count, a.positive_count, a.negative_count, a.neutral_count, a.likes_count) == (6, 2, 1, 3, 14)
    assert math.isclose(a.avg_polarity, statistics.fmean(known)) and math.isclose(a.polarity_std, statistics.stdev(known))


def test_movies_without_enough_polarities(spark, comments):
    got = {x.movie: x for x in partials.statistics(partials.partials(comments)).collect()}
    assert set(got) == {"a", "b", ""}  # a comment without a movie counts nowhere
    assert got["b"].polarity_std is None and got["b"].avg_polarity == 0.25 and got["b"].likes_count == 0
    silent = partials.partials(comments.drop("polarity", "likes", "sentiment"))
    a = {x.movie: x for x in partials.statistics(silent).collect()}["a"]
    assert (a.comment_count, a.positive_count, a.avg_polarity, a.polarity_std) == (6, 0, None, None)


def test_a_repeated_batch_counts_once(spark, comments):
    second = comments.filter("batch_id = 1")
    path = stored(spark, comments, second, second)
    assert rows(partials.statistics(partials.read(spark, path))) == rows(partials.statistics(partials.partials(comments)))
    assert partials.read(spark, path, 0).agg({"comment_count": "sum"}).first()[0] == 2


def test_compaction_changes_no_statistic(spark, comments):
    path, target = stored(spark, comments), scratch_path(spark, "compact")
    partials.compact(spark, path, target, 1)
    kept = partials.read(spark, target)
    assert {x.batch_id for x in kept.collect()} == {1, 2}
    want = rows(partials.statistics(partials.read(spark, path)))
    assert rows(partials.statistics(kept)) == want
    partials.append(comments.filter("batch_id = 2"), target)  # batches after the compacted ones still replace themselves
    assert rows(partials.statistics(partials.read(spark, target))) == want


def test_merging_in_steps_equals_merging_at_once(spark, comments):
    fine = partials.partials(comments)
    halves = partials.merge(fine.selectExpr("*", "batch_id > 0 AS late"), ["movie", "late"])
    assert rows(partials.statistics(halves)) == rows(partials.statistics(fine))


def test_large_means_lose_no_digits(spark):
    df = spark.range(1000).selectExpr("'m' AS movie", "CAST(id % 10 AS INT) AS batch_id", "1e9 + id % 7 AS polarity")
    exact = statistics.stdev(float(i % 7) for i in range(1000))
    assert math.isclose(partials.statistics(partials.partials(df)).first().polarity_std, exact, rel_tol=1e-9)


def test_no_comments(spark, comments):
    none = partials.partials(comments.filter("false"))
    assert partials.statistics(none).isEmpty()
    assert tuple(partials.totals(none).first()) == (0, 0, 0, 0, 0, None, None)
    movies = spark.sql("SELECT 'a' AS title, 3 AS comment_count")
    row = partials.movie_statistics(none, movies).first()
    assert (row.comment_count, row.positive_pct, row.avg_polarity) == (0, 0.0, 0.0)


def test_movie_statistics_equal_the_full_recompute(spark, comments):
    movies = spark.sql("SELECT 'a' AS title, 7 AS revenue UNION ALL SELECT 'b', 0 UNION ALL SELECT 'z', NULL")
    known = comments.filter("NOT isnan(polarity) OR polarity IS NULL")
    got = partials.movie_statistics(partials.partials(known), movies)
    want = movie_stats.movie_sentiment_stats(known, movies).select(*got.columns)
    assert rows(got) == rows(want)


def test_missing_keys_are_named(spark, comments):
    with pytest.raises(ValueError, match="batch_id"):
        partials.partials(comments.drop("batch_id"))
