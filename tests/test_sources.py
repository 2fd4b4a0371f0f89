import pytest
from pyspark.sql import functions as F

from applause.operators import collection
from applause.session import cut_lineage, run_folder, scratch_path
from applause.sources import readers, writers


def test_csv_keeps_quotes_lines_and_blanks(spark):
    rows = [("1", ' a, "quoted"\nsecond line '), ("2", "plain"), ("3", None)]
    df = spark.createDataFrame(rows, "id string, text string")
    path = scratch_path(spark, "csv")
    writers.export_csv(df, path)
    back = readers.read_csv(spark, path, "id string, text string")
    assert sorted(map(tuple, back.collect())) == rows


def test_absent_and_preferred_sources(spark):
    folder = scratch_path(spark, "folder")
    assert readers.best_movies_path(spark, folder) is None
    assert writers.export_movies(spark, folder, scratch_path(spark, "out")) is False
    writers.write_table(spark.range(3), f"{folder}/movies")
    assert readers.best_movies_path(spark, folder).endswith("/movies")
    writers.write_table(spark.range(4), f"{folder}/movies_with_stats")
    assert spark.read.parquet(readers.best_movies_path(spark, folder)).count() == 4


def test_a_repeated_batch_replaces_itself(spark):
    path = scratch_path(spark, "snap")
    writers.write_snapshots(spark.sql("SELECT 0 AS batch_id, 1 AS x UNION ALL SELECT 1, 2"), path)
    writers.write_snapshots(spark.sql("SELECT 1 AS batch_id, 3 AS x"), path)
    assert {tuple(x) for x in readers.read_comments(spark, path).select("batch_id", "x").collect()} == {(0, 1), (1, 3)}
    assert writers.read_snapshot(spark, path, 0).count() == 1


def test_in_memory_rows(spark):
    rows = [{"comment_id": "a", "published_at": "2024-01-02T03:04:05Z"}]
    df = readers.rows_to_comments(spark, rows, "comment_id string, published_at string")
    assert dict(df.dtypes)["published_at"] == "timestamp" and df.first()["published_at"].hour == 3


def test_in_memory_rows_go_by_name(spark):
    rows = [{"text": "b", "comment_id": "a"}, {"comment_id": "c"}]
    df = readers.rows_to_comments(spark, rows, "comment_id string, text string")
    assert sorted(map(tuple, df.collect())) == [("a", "b"), ("c", None)]


def test_rows_of_a_table_go_by_name(spark):
    rows = spark.sql("SELECT 'b' AS text, '2024-01-02T03:04:05Z' AS published_at, 7 AS comment_id, 1 AS other")
    df = readers.rows_to_comments(spark, rows, "comment_id string, text string, published_at string, author string")
    assert df.columns == ["comment_id", "text", "published_at", "author"] and dict(df.dtypes)["published_at"] == "timestamp"
    assert tuple(df.select("comment_id", "text", "author").first()) == ("7", "b", None) and df.first()["published_at"].hour == 3


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_cutoff_is_midnight_utc(spark, zone):
    kept = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        comments = readers.with_timestamp(spark.createDataFrame(
            [(1, 7, "2024-01-01T02:00:00Z"), (2, 7, "2023-12-31T23:59:59Z"), (3, 7, "2024-01-01T00:00:00Z")],
            "comment_id int, movie_id int, published_at string"))
        movies = spark.sql("SELECT 7 AS tmdb_id, DATE '2024-01-01' AS release_date")
        got = {x.comment_id for x in collection.comments_until_release(comments, movies).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)
    assert got == {2, 3}


def test_namesakes_do_not_multiply_movies(spark):
    movies = spark.sql("SELECT 1 AS tmdb_id, 'x' AS title, CAST(NULL AS BIGINT) AS revenue, true AS known")
    record = spark.createDataFrame([("x", "True", "$5"), ("x", "True", "$7")], "Title string, Response string, BoxOffice string")
    for c in ("imdbRating", "imdbVotes", "imdbID", "Metascore", "Rated", "Awards", "Director", "Actors"):
        record = record.withColumn(c, F.lit(None).cast("string"))
    rows = collection.with_box_office(movies, record, details="known").collect()
    assert [x.revenue for x in rows] == [5]
    plain = collection.with_box_office(movies, record, include_box_office=False).collect()
    assert [x.revenue for x in plain] == [None]
    unknown = collection.with_box_office(movies.withColumn("known", F.lit(None).cast("boolean")), record, details="known")
    assert collection.box_office_gate(unknown, details="known").isEmpty()


def test_run_folders_are_removed(spark):
    import os

    with run_folder(spark) as path:
        assert cut_lineage(spark.range(3)).count() == 3 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_cut_lineage_keeps_rows(spark):
    df = spark.range(10).selectExpr("id", "array(id) AS l")
    assert sorted(map(tuple, cut_lineage(df).collect())) == sorted(map(tuple, df.collect()))


def test_later_snapshots_are_not_listed(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    rows = spark.createDataFrame([(i, i % 6 if i < 18 else None) for i in range(20)], "k int, batch_id int")
    writers.write_snapshots(rows.filter("batch_id IS NOT NULL"), path)
    early = writers.read_snapshot(spark, path, 1)
    assert sorted(map(tuple, early.collect())) == sorted((i, i % 6) for i in range(18) if i % 6 <= 1)
    assert len(early.inputFiles()) == len({f for f in early.inputFiles() if "batch_id=0/" in f or "batch_id=1/" in f})
    assert spark.read.parquet(path).schema == early.schema
    assert writers.read_snapshot(spark, path, -1).count() == 0
    writers.write_snapshots(rows.filter("batch_id IS NULL"), path)  # a folder whose name is no number
    assert writers.read_snapshot(spark, path, 2).count() == 9
