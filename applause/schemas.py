"""Explicit schemas; nothing is inferred on read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

COMMENTS = (
    "comment_id string, text string, author string, likes bigint, published_at timestamp, "
    "movie string, movie_id bigint, clean_text string, sentiment string, polarity double"
)

MOVIES = (
    "title string, tmdb_id bigint, release_date date, trailer_id string, poster_path string, "
    "overview string, comment_count int, runtime int, genres string, production_companies string, "
    "tmdb_vote_average double, tmdb_vote_count int, budget bigint, revenue bigint, popularity double, "
    "box_office string, imdb_rating string, imdb_votes string, imdb_id string, metacritic string, "
    "rated string, awards string, director string, actors string"
)

STATS = (
    "comment_count bigint, positive_count bigint, negative_count bigint, neutral_count bigint, "
    "positive_pct double, negative_pct double, neutral_pct double, avg_polarity double"
)
MOVIES_WITH_STATS = MOVIES.replace("comment_count int, ", "") + ", " + STATS

THREAD_PAGE = (
    "video_id string, page int, items array<struct<id: string, snippet: struct<topLevelComment: struct<snippet: struct<"
    "textDisplay: string, authorDisplayName: string, likeCount: bigint, publishedAt: string>>>>>, "
    "nextPageToken string"
)

VIDEO_SEARCH = (
    "query string, items array<struct<id: struct<videoId: string>, snippet: struct<title: string, "
    "description: string, publishedAt: string, channelTitle: string, "
    "thumbnails: struct<high: struct<url: string>>>>>"
)

VIDEO_DETAILS = (
    "video_id string, items array<struct<id: string, snippet: struct<title: string, channelTitle: string, "
    "publishedAt: string>, statistics: struct<viewCount: string, likeCount: string, commentCount: string>, "
    "contentDetails: struct<duration: string>>>"
)

HIT = (
    "struct<id: bigint, title: string, release_date: string, poster_path: string, overview: string, "
    "popularity: double>"
)
MOVIE_PAGE = f"page int, results array<{HIT}>"
MOVIE_SEARCH = f"query string, results array<{HIT}>"

MOVIE_DETAIL = (
    "id bigint, title string, runtime int, genres array<struct<name: string>>, "
    "production_companies array<struct<name: string>>, vote_average double, vote_count int, "
    "budget bigint, revenue bigint, popularity double"
)

MOVIE_VIDEOS = "id bigint, results array<struct<type: string, site: string, key: string>>"

SUPPLEMENT = (
    "Title string, Response string, BoxOffice string, imdbRating string, imdbVotes string, "
    "imdbID string, Metascore string, Rated string, Awards string, Director string, Actors string"
)


def require_columns(df: DataFrame, columns: Iterable[str], table: str) -> None:
    """Raise ``ValueError`` naming the columns ``table`` lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks the column(s) {', '.join(missing)}")
