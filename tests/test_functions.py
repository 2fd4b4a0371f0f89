import pytest
from pyspark.sql import functions as F

from applause.functions import text as tx, values


def one(spark, column, **cells):
    """Value of a column expression on one literal row."""
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "p, expected", [(0.05, "neutral"), (0.0501, "positive"), (-0.15, "neutral"), (-0.1501, "negative"), (0.0, "neutral")]
)
def test_category_bounds_are_exclusive(spark, p, expected):
    assert one(spark, values.category(F.col("p")), p=p) == expected


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://youtu.be/abc?t=4", "abc"),
        ("https://www.youtube.com/watch?v=abc&t=1", "abc"),
        ("https://www.youtube.com/watch?t=1&v=abc", "abc"),
        ("https://www.youtube.com/watch?t=1", ""),
        ("https://www.youtube.com/embed/abc?rel=0", "abc"),
        ("abc", "abc"),
        ("", None),
        (None, None),
    ],
)
def test_video_id(spark, url, expected):
    assert one(spark, values.video_id(F.col("u")), u=url) == expected


@pytest.mark.parametrize("raw, expected", [("$1,870,305", 1870305), ("N/A", None), (None, None), ("$1.5", None), ("", None)])
def test_currency(spark, raw, expected):
    assert one(spark, values.currency(F.col("c")), c=raw) == expected


@pytest.mark.parametrize("raw, expected", [("2024-05-06", "2024-05-06"), ("05/06/2024", None), ("", None), (None, None)])
def test_to_day(spark, raw, expected):
    got = one(spark, values.to_day(F.col("d")), d=raw)
    assert (got.isoformat() if got else None) == expected


def test_cleaning_variants(spark):
    raw = "I CAN'T wait!!  See 1:23 at https://x.example/a?b — it's GREAT :)"
    assert one(spark, tx.clean_text(F.col("t")), t=raw) == "i cannot wait!! see at it is great"
    assert one(spark, tx.clean_for_sentiment(F.col("t")), t=raw) == "i cannot wait!! see 123 at it is great"
    assert one(spark, tx.clean_for_clustering(F.col("t"), ["i", "can", "not", "at", "it", "is"]), t=raw) == "wait see 123 great"
    for clean in (tx.clean_text, tx.clean_for_sentiment, tx.clean_for_clustering):
        assert one(spark, clean(F.col("t")), t=None) == ""


def test_cleaning_keeps_letters_of_every_script(spark):
    assert one(spark, tx.clean_for_sentiment(F.col("t")), t="Ünï итс 映画 🔥x") == "ünï итс 映画 x"


@pytest.mark.parametrize(
    "raw, expected",
    [("don’t", "do not"), ("won't they've", "will not they have"), ("gonna", "going to"), ("movie's", "movie's"), ("cat", "cat")],
)
def test_contractions(spark, raw, expected):
    assert one(spark, tx.expand_contractions(F.col("t")), t=raw) == expected


def test_sentence_marks(spark):
    assert one(spark, tx.mark_sentence_ends(F.col("t")), t="Wow...Great.Next upDown") == "Wow. Great. Next up. Down"
    assert one(spark, tx.end_with_stop(F.col("t")), t="so good  ") == "so good  ."
    assert one(spark, tx.end_with_stop(F.col("t")), t="so good! ") == "so good! "
    assert one(spark, tx.tidy_summary(F.col("t")), t="a , b .. c !") == "a, b. c!"


def test_labels(spark):
    d = F.col("d")
    assert one(spark, tx.short_label(d, F.lit(3)), d="Emotion & Production: a, b") == "Emotion (3)"
    assert one(spark, tx.short_label(d, F.lit(3)), d="Cluster 3") == "Cluster 3 (3)"
    assert one(spark, tx.full_label(d, F.lit(3)), d="X: a") == "X: a (Cluster 3)"


def test_unknown_time_keeps_the_comment(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('2024-01-01T00:00:00Z'), ('2024-01-01T00:00:01Z'), ('never'), (NULL) AS t(raw)"
    )
    kept = df.filter(values.until(values.iso_time(F.col("raw")), F.lit("2024-01-01").cast("timestamp")))
    assert {x.raw for x in kept.collect()} == {"2024-01-01T00:00:00Z", "never", None}
