import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from applause.operators import collection, movie_stats, scoring, tables, themes
from applause.functions import distributions, lexicon
from applause.schemas import require_columns


def movies(spark, revenues):
    return spark.createDataFrame([(i, f"m{i}", float(x)) for i, x in enumerate(revenues)], "id int, title string, revenue double")


def comments(spark, rows):
    return spark.createDataFrame(rows, "movie string, sentiment string, polarity double, likes bigint")


def test_few_movies_are_all_kept(spark):
    assert scoring.without_outliers(movies(spark, [1] * 9 + [1000])).count() == 10


def test_one_outlier_leaves(spark):
    assert scoring.without_outliers(movies(spark, [1, 2] * 6 + [1000])).count() == 12


def test_equal_revenues_are_kept(spark):
    assert scoring.without_outliers(movies(spark, [5] * 12)).count() == 12


def test_threshold_widens(spark):
    assert scoring.threshold_ladder(2.5) == [2.5, 3.0, 3.5, 4.0, 4.5, 5.0]
    df = movies(spark, range(1, 21))
    assert scoring.without_outliers(df, threshold=0.1, min_movies=15).count() >= 15


def test_constant_column_has_no_correlation(spark):
    df = movies(spark, [1, 2, 3]).withColumn("x", F.lit(2.0))
    assert scoring.revenue_correlations(df, ["x"]).first()["x"] is None


def test_regression_needs_three_movies(spark):
    df = movies(spark, [1, 2]).withColumns({"avg_polarity": F.col("id") * 1.0, "positive_pct": F.lit(1.0), "negative_pct": F.lit(1.0)})
    row = scoring.sentiment_revenue_correlation(df).first()
    assert row["slope"] is None and row["error"].startswith("Not enough")
    assert row["p_value"] is None and row["standard_error"] is None


def test_regression_values(spark):
    rows = [(0.0, 1.0), (1.0, 3.0), (2.0, 4.0), (3.0, 8.0)]
    df = spark.createDataFrame(rows, "avg_polarity double, revenue double").withColumns(
        {"positive_pct": F.lit(1.0), "negative_pct": F.lit(1.0)}
    )
    row = scoring.sentiment_revenue_correlation(df).first()
    assert row["slope"] == pytest.approx(2.2) and row["intercept"] == pytest.approx(0.7)
    p, se = row["p_value"], row["standard_error"]
    squared_error = 0.3**2 + 0.1**2 + 1.1**2 + 0.7**2  # around 0.7 + 2.2 x
    expected_se = (squared_error / 2 / 5) ** 0.5
    t = 2.2 / expected_se
    assert se == pytest.approx(expected_se)
    assert p == pytest.approx(1 - t / (2 + t * t) ** 0.5)  # Student's distribution with two degrees of freedom
    points = scoring.sampled_line(scoring.regression_line(df)).orderBy("i").collect()
    assert len(points) == 100 and points[-1]["y"] == pytest.approx(0.7 + 2.2 * 3)


def test_no_likes_give_zero_scores(spark):
    c = comments(spark, [("m0", "positive", 0.5, 0), ("m0", "positive", 0.7, 0), ("m1", "negative", -0.5, 0)])
    got = scoring.prediction_scores(c, movies(spark, [5, 6])).collect()
    assert [x.prediction_score for x in got] == [0.0, 0.0]


def test_single_comment_has_no_consistency(spark):
    got = movie_stats.engagement(comments(spark, [("m0", "positive", 0.5, 3)])).first()
    assert got.sentiment_consistency is None and got.comment_like_ratio == pytest.approx(1 / 3)


def test_stats_invariants_and_null_sentiment(spark):
    c = comments(spark, [("m0", "positive", 0.5, 1), ("m0", None, None, 1), ("m0", "negative", -0.1, 1), (None, "positive", 1.0, 1)])
    got = {x.title: x for x in movie_stats.movie_sentiment_stats(c, movies(spark, [1, 2])).collect()}
    m0, m1 = got["m0"], got["m1"]
    assert (m0.comment_count, m0.positive_count, m0.negative_count, m0.neutral_count) == (3, 1, 1, 1)
    assert m0.positive_pct + m0.negative_pct + m0.neutral_pct == pytest.approx(100)
    assert m0.avg_polarity == pytest.approx(0.2)
    assert (m1.comment_count, m1.avg_polarity) == (0, 0.0)


def test_integration_without_valid_movies_returns_the_inputs(spark):
    c, m = comments(spark, [("m0", "positive", 0.5, 1)]), movies(spark, [1, 2])
    out_movies, out_comments = movie_stats.integrate(c, m, 50)
    assert out_movies is m and out_comments is c
    with pytest.raises(ValueError):
        movie_stats.integrate(c.drop("movie"), m)
    with pytest.raises(ValueError):
        require_columns(m, ["nope"], "movies")


def test_missing_columns(spark):
    c = comments(spark, [("m0", "positive", 0.5, 1)])
    assert movie_stats.sentiment_distribution(c, "nope") is None
    m = movies(spark, [1])
    assert movie_stats.numeric_sentiment_stats(c.drop("sentiment", "polarity"), m) is m


def test_long_group_lists_are_exact(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id"))
    got = tables.top_k_per_group(df, ["g"], [F.desc("id")], 1500)
    assert got.count() == 3000
    assert got.filter("g = 0").agg(F.min("id")).first()[0] == 4998 - 2 * 1499


def test_empty_choice(spark):
    df = movies(spark, [1, 2])
    assert tables.pick_movies(df, [], "title").count() == 2
    assert tables.pick_movies(df, [], "title", empty_means_all=False).count() == 0


@pytest.mark.parametrize(
    "shares, text",
    [
        ({"emotion": 0.5, "criticism": 0.4}, "Negative Reactions & Criticism"),
        ({"emotion": 0.5, "anticipation": 0.4}, "Excited Anticipation"),
        ({"story": 0.5, "criticism": 0.4}, "Story & Plot Criticism"),
        ({"visuals": 0.5, "emotion": 0.4}, "Visual Appreciation"),
        ({"visuals": 0.1}, "Anticipation & Expectations"),
        ({"sound": 0.5, "marketing": 0.4}, "Music & Sound Design & Marketing & Promotion"),
        ({"sound": 0.9, "marketing": 0.4}, "Music & Sound Design"),
    ],
)
def test_theme_texts(spark, shares, text):
    rows = [(0, *[1 if i < round(shares.get(t, 0) * 20) else 0 for t in lexicon.THEMES]) for i in range(20)]
    df = spark.createDataFrame(rows, "cluster int, " + ", ".join(f"{t} int" for t in lexicon.THEMES))
    got = {x.cluster: x.theme for x in themes.cluster_themes(df, 2).collect()}
    if text == "Anticipation & Expectations":
        assert got[0] == "Visual Effects & Cinematography & Anticipation & Expectations"
    else:
        assert got[0] == text
    assert got[1] == themes.MISC


def test_box_office_gate(spark):
    df = spark.createDataFrame([("a", 5, None), ("b", 0, "$1,000"), ("c", None, "N/A"), ("d", 0, None)],
                               "title string, revenue bigint, box_office string")
    fixed = movie_stats.repair_revenue(df)
    assert {x.title: x.revenue for x in fixed.collect()} == {"a": 5, "b": 1000, "c": None, "d": 0}
    assert {x.title for x in collection.box_office_gate(df).collect()} == {"a", "b"}
    assert collection.box_office_gate(df, False).count() == 4


def test_regression_test_by_group_equals_the_fitted_model(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(4)
    rows = [(g, float(x), float(50 + w * x + rng.normal())) for g, w, n in (("a", 0.1, 40), ("b", 0, 5), ("c", 2, 900)) for x in rng.normal(size=n)]
    rows += [("exact", float(i), 5.0 + 2 * i) for i in range(4)] + [("flat", float(i), 7.0) for i in range(5)] + [("one x", 1.0, float(i + 1)) for i in range(5)]
    rows += [("few", 1.0, 1.0), ("few", 2.0, 3.0), ("a", None, 3.0), (None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, avg_polarity double, revenue double")
    found = {r["g"]: r for r in scoring.regression_line(df, by=["g"]).collect()}
    for g in "abc":
        points = VectorAssembler(inputCols=["avg_polarity"], outputCol="f").transform(df.filter(F.col("g") == g).na.drop())
        summary = LinearRegression(featuresCol="f", labelCol="revenue", solver="normal").fit(points).summary
        assert found[g]["p_value"] == pytest.approx(summary.pValues[0], abs=1e-9)
        assert found[g]["standard_error"] == pytest.approx(summary.coefficientStandardErrors[0], rel=1e-9)
    assert found["exact"]["p_value"] == pytest.approx(0, abs=1e-9) and found["exact"]["standard_error"] == pytest.approx(0, abs=1e-6)
    assert found["flat"]["p_value"] is None and found["flat"]["standard_error"] == 0
    assert all(found[g][c] is None for g in ("one x", "few", None) for c in ("p_value", "standard_error"))


@pytest.mark.parametrize("z", [0.5, 1.0, 2.5, 10.0, 1e6])
def test_log_gamma(spark, z):
    assert spark.range(1).select(distributions.log_gamma(F.lit(z))).first()[0] == pytest.approx(math.lgamma(z), rel=1e-13, abs=1e-12)


def test_student_with_few_degrees_of_freedom(spark):
    t = [0.0, 0.3, 1.0, 5.0, 300.0]
    df = spark.createDataFrame([(x,) for x in t], "t double")
    one = [r[0] for r in df.select(distributions.t_p_value(F.col("t"), F.lit(1))).collect()]
    assert one == pytest.approx([1 - 2 / math.pi * math.atan(x) for x in t], abs=1e-12)
    two = [r[0] for r in df.select(distributions.t_p_value(F.col("t"), F.lit(2))).collect()]
    assert two == pytest.approx([1 - x / math.sqrt(2 + x * x) for x in t], abs=1e-12)
    assert df.select(distributions.t_p_value(F.lit(None).cast("double"), F.lit(2))).first()[0] is None
    assert df.select(distributions.t_p_value(F.col("t"), F.lit(0))).first()[0] is None
