"""From landing scans to the comments and movies tables: gates, caps and enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text, values
from ..session import cut_lineage
from ..sources import readers, writers
from . import sentiment, tables

PAGE_SIZE = 20
MAX_PAGES = 20
BATCH_SIZE = 10


def feed_order(popular: DataFrame, max_pages: int = MAX_PAGES, page_size: int = PAGE_SIZE) -> DataFrame:
    """Movies of the popular feed in page order: at most ``max_pages`` pages of ``page_size`` movies."""
    hits = readers.page_results(popular.filter(F.col("page") <= max_pages), page_size)
    first = one_per_key(hits, ["id"], ["page", "pos"])  # a movie may move to the next page between two calls
    return first.orderBy("page", "pos").limit(max_pages * page_size)


def one_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One record per key: the first by ``order``, else the smallest by all its fields."""
    rest = [c for c in df.columns if c not in key]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")
    return df.groupBy(*key).agg(first).select(*key, "_r.*").select(*df.columns)


def with_box_office(
    movies: DataFrame, supplement: DataFrame, title: str = "title", include_box_office: bool = True,
    details: str | None = None,
) -> DataFrame:
    """Movies with the supplement's fields; a revenue that is unknown is taken from its currency string.

    Only movies whose flag ``details`` is set get a revenue that way, and none if no box office is asked for.
    """
    joined = movies.join(one_per_key(readers.flatten_supplement(supplement), [title]), title, "left")
    if not include_box_office:
        return joined
    repaired = values.currency_fallback(F.col("revenue"), F.col("box_office"))
    if details is not None:
        repaired = F.when(F.col(details), repaired).otherwise(F.col("revenue"))
    return joined.withColumn("revenue", repaired)


def box_office_gate(movies: DataFrame, include_box_office: bool = True, details: str | None = None) -> DataFrame:
    """Drop movies without box-office figures, if they are asked for.

    A positive primary revenue passes; so does any figure the supplement's currency string holds. Movies whose flag
    ``details`` is not set have no primary record and do not pass.
    """
    if not include_box_office:
        return movies
    passes = (F.col("revenue") > 0) | values.currency(F.col("box_office")).isNotNull()
    if details is not None:
        passes = passes & F.col(details)
    return movies.filter(F.coalesce(passes, F.lit(False)))


def with_trailer(movies: DataFrame, videos: DataFrame, movie_id: str = "tmdb_id") -> DataFrame:
    """Movies that have a trailer or teaser, with its key."""
    picked = one_per_key(videos, ["id"]).select(F.col("id").alias(movie_id), values.pick_trailer(F.col("results")).alias("trailer_id"))
    return movies.join(picked.filter("trailer_id IS NOT NULL"), movie_id)


def comments_until_release(
    comments: DataFrame, movies: DataFrame, movie_id: str = "movie_id", key: str = "tmdb_id"
) -> DataFrame:
    """Comments written up to the midnight (UTC) that starts the movie's release day."""
    dates = movies.select(F.col(key).alias(movie_id), F.col("release_date"))
    kind = dict(comments.dtypes)["published_at"]
    joined = comments.join(dates, movie_id)
    return joined.filter(values.until(F.col("published_at"), values.day_start(F.col("release_date"), kind))).drop("release_date")


def cap_comments(comments: DataFrame, cap: int = 100, video: str = "video_id") -> DataFrame:
    """The first ``cap`` comments of each video in the order they were delivered."""
    return tables.top_k_per_group(comments, [video], [F.asc("page"), F.asc("pos")], cap).drop("rank")


def enough_comments(movies: DataFrame, comments: DataFrame, min_comments: int = 100) -> DataFrame:
    """Movies with at least ``min_comments`` comments, and the count."""
    counts = tables.comments_per_movie(comments, "movie_id", "tmdb_id").filter(F.col("comment_count") >= min_comments)
    return movies.join(counts, "tmdb_id")


def enrich(movies: DataFrame, details: DataFrame, supplement: DataFrame) -> DataFrame:
    """Detail attributes by id and supplementary attributes by title."""
    base = movies.join(one_per_key(readers.flatten_details(details), ["tmdb_id"]), "tmdb_id", "left")
    return base.join(one_per_key(readers.flatten_supplement(supplement), ["title"]), "title", "left")


def with_batches(movies: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Adds ``batch_id``: accepted movies in feed order, ``size`` to a batch, from 1. The feed is at most 400 rows."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("page", "pos"))
    return movies.withColumn("batch_id", F.ceil(place / size).cast("int"))


def save_dataset(comments: DataFrame, movies: DataFrame, folder: str, clear: bool = True) -> None:
    """Write the snapshots by batch and the final tables; ``clear=False`` keeps what earlier runs left in the tables."""
    of_movie = movies.select(F.col("tmdb_id").alias("movie_id"), "batch_id")
    writers.write_snapshots(movies, f"{folder}/movies_partial")
    writers.write_snapshots(comments.join(of_movie, "movie_id"), f"{folder}/comments_partial")
    writers.write_table(movies.drop("batch_id"), f"{folder}/movies", clear=clear)
    writers.write_table(comments, f"{folder}/comments_processed", clear=clear)


def candidate_movies(
    popular: DataFrame, details: DataFrame, supplement: DataFrame, videos: DataFrame, include_box_office: bool = True
) -> DataFrame:
    """Movies of the feed that pass the box-office gate and have a trailer: at most 400 rows, worked out once."""
    feed = feed_order(popular).select(
        "page", "pos", "title", F.col("id").alias("tmdb_id"), values.to_day(F.col("release_date")).alias("release_date"),
        "poster_path", "overview",
    )
    primary = one_per_key(readers.flatten_details(details), ["tmdb_id"]).withColumn("_details", F.lit(True))
    known = with_box_office(
        feed.join(primary, "tmdb_id", "left"), supplement, include_box_office=include_box_office, details="_details"
    )
    candidates = with_trailer(box_office_gate(known, include_box_office, "_details"), videos)
    return cut_lineage(candidates.drop("_details"))


def wanted_trailers(candidates: DataFrame) -> DataFrame:
    """What a comment takes from its movie, by trailer."""
    return candidates.select(
        F.col("trailer_id").alias("video_id"), F.col("tmdb_id").alias("movie_id"), F.col("title").alias("movie"),
        "release_date",
    )


def early_comments(threads: DataFrame, wanted: DataFrame) -> DataFrame:
    """Comments of the wanted trailers up to the release; ``wanted`` is at most 400 rows, so it is broadcast."""
    flat = readers.with_timestamp(readers.flatten_threads(threads)).join(F.broadcast(wanted), "video_id")
    return flat.filter(values.until(F.col("published_at"), values.day_start(F.col("release_date")))).drop("release_date")


def accept(
    candidates: DataFrame,
    capped: DataFrame,
    min_movies: int = 50,
    min_comments: int = 100,
    folder: str | None = None,
    clear: bool = True,
    **scoring,
) -> tuple[DataFrame, DataFrame]:
    """The first ``min_movies`` movies with enough comments, and their comments, scored."""
    accepted = enough_comments(candidates, capped, min_comments)
    movies = cut_lineage(accepted.orderBy("page", "pos").limit(min_movies))
    kept = capped.join(F.broadcast(movies.select(F.col("tmdb_id").alias("movie_id"))), "movie_id", "left_semi")
    cleaned = kept.withColumn("clean_text", text.clean_for_sentiment(F.col("text")))
    scored = sentiment.score_comments(cleaned, key="comment_id", text="clean_text", movie="movie", **scoring)
    comments = scored.drop("video_id", "page", "pos", "subjectivity")
    if folder is not None:
        comments = cut_lineage(comments)
        save_dataset(comments, with_batches(movies).drop("page", "pos"), folder, clear)
    return comments, movies.drop("page", "pos")


def collect_dataset(
    popular: DataFrame,
    details: DataFrame,
    supplement: DataFrame,
    videos: DataFrame,
    threads: DataFrame,
    min_movies: int = 50,
    min_comments: int = 100,
    include_box_office: bool = True,
    comment_cap: int = 300,
    folder: str | None = None,
    clear: bool = True,
    **scoring,
) -> tuple[DataFrame, DataFrame]:
    """Comments and movies from the landing scans; with a ``folder``, snapshots and final tables are written there.

    Every source gives one record per key, so the feed's at most 400 movies bound the movies side of the thread join,
    which is broadcast: the threads are read once and only the capped comments are shuffled and written.
    ``scoring`` goes to ``score_comments``.
    """
    candidates = candidate_movies(popular, details, supplement, videos, include_box_office)
    early = early_comments(threads, wanted_trailers(candidates))
    capped = cut_lineage(cap_comments(early, comment_cap, "movie_id"))
    return accept(candidates, capped, min_movies, min_comments, folder, clear, **scoring)
