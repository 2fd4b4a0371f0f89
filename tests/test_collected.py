import pytest
from pyspark.sql import functions as F

from applause.operators import collection
from applause.schemas import THREAD_PAGE
from applause.session import scratch_path
from applause.streaming import collected, snapshots


@pytest.fixture
def candidates(spark):
    return spark.sql(
        "SELECT 1 AS page, 1 AS pos, 'One' AS title, 11L AS tmdb_id, DATE '2024-05-01' AS release_date, 'v1' AS trailer_id "
        "UNION ALL SELECT 1, 2, 'Two', 22L, DATE '2024-05-01', 'v2' UNION ALL SELECT 1, 3, 'None', 33L, NULL, 'v3'"
    )


def pages(spark, listed, when="2024-01-01T00:00:00Z"):
    """(video, page, ids) as thread pages."""
    item = "named_struct('id', x, 'snippet', named_struct('topLevelComment', named_struct('snippet', named_struct(" \
        f"'textDisplay', 'nice', 'authorDisplayName', 'a', 'likeCount', 1L, 'publishedAt', '{when}'))))"
    flat = spark.createDataFrame(listed, "video_id string, page int, ids array<string>")
    return flat.select("video_id", "page", F.expr(f"transform(ids, x -> {item})").alias("items"), F.lit(None).cast("string").alias("nextPageToken"))


def ids(spark, store):
    return sorted(((x.movie_id, x.comment_id) for x in collected.taken(spark, store).collect()), key=repr)


def test_the_cap_holds_over_deliveries(spark, candidates):
    wanted, store = collection.wanted_trailers(candidates), scratch_path(spark, "taken")
    collected.take(pages(spark, [("v1", 2, ["c", "d"]), ("v1", 1, ["a", "b"])]), 0, wanted, store, 3)
    assert ids(spark, store) == [(11, "a"), (11, "b"), (11, "c")]
    collected.take(pages(spark, [("v1", 3, ["e"]), ("v2", 1, ["f"]), ("other", 1, ["g"])]), 1, wanted, store, 3)
    assert ids(spark, store) == [(11, "a"), (11, "b"), (11, "c"), (22, "f")]


def test_a_repeated_trigger_takes_the_same(spark, candidates):
    wanted, store = collection.wanted_trailers(candidates), scratch_path(spark, "taken")
    collected.take(pages(spark, [("v1", 1, ["a", "b"])]), 0, wanted, store, 3)
    for _ in range(2):
        collected.take(pages(spark, [("v1", 2, ["c", "d", "e"])]), 1, wanted, store, 3)
    assert ids(spark, store) == [(11, "a"), (11, "b"), (11, "c")]


def test_pages_delivered_again_count_once(spark, candidates):
    wanted, store = collection.wanted_trailers(candidates), scratch_path(spark, "taken")
    for batch in range(3):
        collected.take(pages(spark, [("v1", 1, ["a", "b"]), ("v2", 1, [None, "c"])]), batch, wanted, store, 10)
    named = [x for x in ids(spark, store) if x[1] is not None]
    assert named == [(11, "a"), (11, "b"), (22, "c")]


def test_late_comments_and_empty_pages(spark, candidates):
    wanted, store = collection.wanted_trailers(candidates), scratch_path(spark, "taken")
    assert collected.taken(spark, store).isEmpty()
    collected.take(pages(spark, [("v1", 1, ["late"])], "2024-05-01T00:00:01Z"), 0, wanted, store)
    collected.take(pages(spark, [("v2", 1, []), ("v2", 2, None), (None, None, ["x"])]), 1, wanted, store)
    assert collected.taken(spark, store).isEmpty()
    comments, movies = collected.collected(candidates, store, min_comments=1)
    assert comments.isEmpty() and movies.isEmpty()


def test_a_stream_started_again_equals_one_run(spark, candidates):
    deliveries = [
        [("v1", 1, ["a", "b"]), ("v2", 1, ["k"])], [("v1", 2, ["c", "d"])], [("v1", 3, ["e"]), ("v2", 2, ["l", "m"]), ("v3", 1, ["z"])],
    ]
    land, store, state = (scratch_path(spark, x) for x in ("land", "taken", "state"))
    for listed in deliveries:
        pages(spark, listed).write.mode("append").json(land)
        stream = snapshots.landing_stream(spark, land, THREAD_PAGE, "json")
        collected.stream_comments(stream, candidates, store, state, 3).awaitTermination()
    collected.stream_comments(stream, candidates, store, state, 3).awaitTermination()  # nothing new
    comments, movies = collected.collected(candidates, store, min_comments=3)

    threads = spark.read.schema(THREAD_PAGE).json(land)
    early = collection.early_comments(threads, collection.wanted_trailers(candidates))
    want, want_movies = collection.accept(candidates, collection.cap_comments(early, 3, "movie_id"), min_comments=3)
    assert sorted(map(tuple, comments.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, movies.collect())) == sorted(map(tuple, want_movies.select(*movies.columns).collect()))
    assert {x.tmdb_id: x.comment_count for x in movies.collect()} == {11: 3, 22: 3}
