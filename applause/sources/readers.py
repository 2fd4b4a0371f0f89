"""Scans of CSV, Parquet and nested JSON landing files."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions import values


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Header CSV with a fixed schema and doubled quotes.

    Free text holds line breaks inside quotes, which keeps a file in one split; land many files, or
    pass ``multi_line=False`` for tables without line breaks.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_comments(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_csv(spark, path, schemas.COMMENTS) if fmt == "csv" else spark.read.format(fmt).load(path)


def read_movies(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = schemas.MOVIES) -> DataFrame:
    return read_csv(spark, path, schema) if fmt == "csv" else spark.read.format(fmt).load(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system that owns ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first path that exists, else ``None``."""
    return next((p for p in paths if path_exists(spark, p)), None)


def best_movies_path(spark: SparkSession, folder: str, suffix: str = "") -> str | None:
    """Prefer the movies with statistics over the plain movies."""
    return first_existing(spark, [f"{folder}/movies_with_stats{suffix}", f"{folder}/movies{suffix}"])


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def flatten_threads(pages: DataFrame) -> DataFrame:
    """Comment-thread pages -> one row per top-level comment, with its place in the page."""
    s = "item.snippet.topLevelComment.snippet"
    return pages.select("video_id", "page", F.posexplode("items").alias("pos", "item")).select(
        "video_id",
        "page",
        "pos",
        F.col("item.id").alias("comment_id"),
        F.col(f"{s}.textDisplay").alias("text"),
        F.col(f"{s}.authorDisplayName").alias("author"),
        F.col(f"{s}.likeCount").alias("likes"),
        F.col(f"{s}.publishedAt").alias("published_at"),
    )


def flatten_video_search(pages: DataFrame, max_results: int = 10) -> DataFrame:
    """Video-search pages -> the first ``max_results`` hits (never more than 50) of each page."""
    n = min(50, max_results)
    hits = pages.select("query", F.posexplode(F.slice("items", 1, n)).alias("pos", "item"))
    return hits.select(
        "query",
        "pos",
        F.col("item.id.videoId").alias("video_id"),
        F.col("item.snippet.title").alias("title"),
        F.col("item.snippet.description").alias("description"),
        F.col("item.snippet.publishedAt").alias("published_at"),
        F.col("item.snippet.channelTitle").alias("channel_title"),
        F.col("item.snippet.thumbnails.high.url").alias("thumbnail_url"),
    )


def likely_trailers(hits: DataFrame, movie_title: str = "movie_title") -> DataFrame:
    """Search hits that look like a trailer of the movie searched for."""
    return hits.filter(values.is_likely_trailer(F.col("title"), F.col("description"), F.col(movie_title)))


def first_item(pages: DataFrame) -> DataFrame:
    """Video details: the first item of each page, NULL where the page is empty."""
    return pages.select("video_id", F.get("items", F.lit(0)).alias("item"))


def page_results(pages: DataFrame, max_results: int = 10) -> DataFrame:
    """Popular or upcoming pages -> the first ``max_results`` movies of each page, in page order."""
    hits = pages.select("page", F.posexplode(F.slice("results", 1, max_results)).alias("pos", "hit"))
    return hits.select("page", "pos", "hit.*")


def search_results(pages: DataFrame, max_results: int = 10) -> DataFrame:
    """Search pages -> the ``max_results`` most popular movies of each query.

    One page holds one query's hits, so the order is made inside the row and nothing is shuffled.
    """
    by_popularity = F.array_sort(
        F.transform(
            "results",
            lambda h, i: F.struct(
                (-F.coalesce(h["popularity"], F.lit(0.0))).alias("key"), i.alias("place"), h.alias("hit")
            ),
        )
    )
    hits = pages.select("query", F.posexplode(F.slice(by_popularity, 1, max_results)).alias("pos", "h"))
    return hits.select("query", "pos", "h.hit.*")


def details_by_title(search_pages: DataFrame, details: DataFrame) -> DataFrame:
    """Details of the first hit of each search, in the order the search returned."""
    first = search_pages.select("query", F.get("results", F.lit(0))["id"].alias("id"))
    return first.filter("id IS NOT NULL").join(details, "id")


def flatten_details(details: DataFrame) -> DataFrame:
    """Detail records with their name lists joined to strings."""
    return details.select(
        F.col("id").alias("tmdb_id"),
        "runtime",
        values.joined_names(F.col("genres")).alias("genres"),
        values.joined_names(F.col("production_companies")).alias("production_companies"),
        F.col("vote_average").alias("tmdb_vote_average"),
        F.col("vote_count").alias("tmdb_vote_count"),
        "budget",
        "revenue",
        "popularity",
    )


def flatten_supplement(records: DataFrame) -> DataFrame:
    """Supplementary records that were found, under the names of the movies table."""
    return records.filter(F.col("Response") == "True").select(
        F.col("Title").alias("title"),
        F.col("BoxOffice").alias("box_office"),
        F.col("imdbRating").alias("imdb_rating"),
        F.col("imdbVotes").alias("imdb_votes"),
        F.col("imdbID").alias("imdb_id"),
        F.col("Metascore").alias("metacritic"),
        F.col("Rated").alias("rated"),
        F.col("Awards").alias("awards"),
        F.col("Director").alias("director"),
        F.col("Actors").alias("actors"),
    )


def rows_to_comments(spark: SparkSession, rows: DataFrame | Sequence[dict[str, Any]], schema: str) -> DataFrame:
    """Comments, in memory or a table of structs -> table, by field name; absent fields are NULL.

    A ``published_at`` string becomes a timestamp.
    """
    fields = StructType.fromDDL(schema)
    if isinstance(rows, DataFrame):
        return with_timestamp(rows.select(*(
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
        )))
    names = fields.names
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
    return with_timestamp(df)


def with_timestamp(df: DataFrame) -> DataFrame:
    if "published_at" not in df.columns or dict(df.dtypes)["published_at"] != "string":
        return df
    return df.withColumn("published_at", values.iso_time(F.col("published_at")))
