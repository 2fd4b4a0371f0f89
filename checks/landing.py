"""Sources and sinks: each query writes a view to a fresh folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from applause.operators import collection, movie_stats, tables
from applause.schemas import (
    MOVIE_DETAIL, MOVIE_PAGE, MOVIE_SEARCH, SUPPLEMENT, THREAD_PAGE, VIDEO_DETAILS, VIDEO_SEARCH,
)
from applause.session import scratch_path
from applause.sources import readers, writers
from applause.streaming import collected, snapshots

from .base import c_event, c_text, check, m_event, r, table
from .movies import STAT_COLUMNS, STATS_SQL


def landed(spark, df, schema):
    """Land rows as JSON lines and scan them with the fixed schema."""
    path = scratch_path(spark, "landing")
    df.write.json(path)
    return readers.read_json(spark, path, schema)


@check("s01_csv_scan", "SELECT comment_id::VARCHAR AS comment_id, text, likes, movie, polarity FROM c_text")
def s01(spark, sf):
    comments = c_text(spark, sf).select(
        F.col("comment_id").cast("string").alias("comment_id"), "text", "likes", "movie", "polarity"
    )
    path = scratch_path(spark, "comments_csv")
    writers.export_csv(comments, path)
    return readers.read_csv(spark, path, "comment_id string, text string, likes bigint, movie string, polarity double")


@check("s02_best_source", "SELECT tmdb_id, title, revenue FROM m_event")
def s02(spark, sf):
    folder = scratch_path(spark, "store")
    writers.write_table(m_event(spark, sf).select("tmdb_id", "title", "revenue"), f"{folder}/movies")
    return spark.read.parquet(readers.best_movies_path(spark, folder))


@check("s03_table_sink", "SELECT comment_id, movie, polarity, likes FROM c_event")
def s03(spark, sf):
    path = scratch_path(spark, "comments")
    writers.write_table(c_event(spark, sf).select("comment_id", "movie", "polarity", "likes"), path)
    return readers.read_comments(spark, path)


@check("s04_snapshots", "SELECT tmdb_id, title, cast(tmdb_id // 10 AS INT) AS batch_id FROM m_event WHERE tmdb_id // 10 <= 50")
def s04(spark, sf):
    path = scratch_path(spark, "snapshots")
    batches = m_event(spark, sf).select("tmdb_id", "title", F.floor(F.col("tmdb_id") / 10).cast("int").alias("batch_id"))
    writers.write_snapshots(batches.repartition("batch_id"), path)
    return writers.read_snapshot(spark, path, 50)


@check(
    "s04_stream_snapshots",
    "SELECT event_id AS comment_id, user_id AS movie_id, round(greatest(-1, least(1, value / 50 - 1)), 9) AS polarity, "
    "0::INT AS batch_id FROM events",
)
def s04_stream(spark, sf):
    path = scratch_path(spark, "stream")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = snapshots.landing_stream(spark, sf, schema, glob="events.parquet")

    def scored(df):
        polarity = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 50 - 1))
        return df.select(F.col("event_id").alias("comment_id"), F.col("user_id").alias("movie_id"), r(polarity).alias("polarity"))

    query = snapshots.stream_snapshots(stream, path, scratch_path(spark, "stream_state"), scored)
    query.awaitTermination()
    return spark.read.parquet(path)


@check("s05_append_or_clear", "SELECT movie, 2 * count(*) AS n FROM c_event GROUP BY 1")
def s05(spark, sf):
    path = scratch_path(spark, "runs")
    comments = c_event(spark, sf).select("movie", "comment_id")
    writers.write_table(comments, path)
    writers.write_table(comments, path, clear=True)
    writers.write_table(comments, path, clear=False)
    return spark.read.parquet(path).groupBy("movie").agg(F.count("*").alias("n"))


@check(
    "s06_export_movies",
    f"WITH {STATS_SQL} SELECT title, revenue, {', '.join(STAT_COLUMNS)} FROM joined",
)
def s06(spark, sf):
    folder, target = scratch_path(spark, "store"), scratch_path(spark, "export")
    movies = m_event(spark, sf).select("title", "revenue")
    stats = movie_stats.movie_sentiment_stats(c_event(spark, sf), movies)
    stats = stats.withColumns({c: F.round(c, 9) for c, t in stats.dtypes if t == "double"})
    writers.write_table(movies, f"{folder}/movies")
    writers.write_table(stats, f"{folder}/movies_with_stats")
    writers.export_movies(spark, folder, target)
    return readers.read_csv(spark, target, stats.schema.simpleString()[7:-1].replace(":", " "), multi_line=False)


@check(
    "s07_comment_threads",
    """SELECT conv_id::VARCHAR AS video_id, turn::INT AS page, (i - 1)::INT AS pos, conv_id || '-' || turn || '-' || (i - 1) AS comment_id,
              line AS text, role AS author, length(line) AS likes, timestamp '2024-01-01 10:00:00' + to_minutes(turn) AS published_at
       FROM (SELECT conv_id, turn, role, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
             FROM (SELECT *, string_split(text, chr(10)) AS parts FROM conversations))""",
)
def s07(spark, sf):
    t = table(spark, sf, "conversations")
    when = F.date_format(F.timestamp_add("MINUTE", "turn", F.lit("2024-01-01 10:00:00").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def item(line, i):
        inner = F.struct(
            line.alias("textDisplay"), F.col("role").alias("authorDisplayName"),
            F.length(line).cast("bigint").alias("likeCount"), when.alias("publishedAt"),
        )
        wrapped = F.struct(F.struct(inner.alias("snippet")).alias("topLevelComment"))
        return F.struct(F.concat_ws("-", "conv_id", "turn", i.cast("string")).alias("id"), wrapped.alias("snippet"))

    pages = t.select(
        F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("int").alias("page"),
        F.transform(F.split("text", "\n"), item).alias("items"),
    )
    flat = readers.flatten_threads(landed(spark, pages, THREAD_PAGE))
    return readers.with_timestamp(flat).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


def search_pages(spark, sf):
    """One search per page of the crawl, with three hits each."""
    p = table(spark, sf, "pages")

    def hit(n):
        snippet = F.struct(
            F.concat(F.lit(f"title {n} of "), "url").alias("title"), F.lit("about").alias("description"),
            F.lit("2024-01-01T00:00:00Z").alias("publishedAt"), F.lit(f"channel {n}").alias("channelTitle"),
            F.struct(F.struct(F.concat("url", F.lit("#img")).alias("url")).alias("high")).alias("thumbnails"),
        )
        video = F.struct(F.concat(F.lit(f"v{n}-"), F.col("page_id").cast("string")).alias("videoId"))
        return F.struct(video.alias("id"), snippet.alias("snippet"))

    return p.select(F.col("page_id").cast("string").alias("query"), F.array(hit(0), hit(1), hit(2)).alias("items"))


@check(
    "s08_video_search",
    """SELECT page_id::VARCHAR AS query, n::INT AS pos, 'v' || n || '-' || page_id AS video_id, 'title ' || n || ' of ' || url AS title,
              'about' AS description, '2024-01-01T00:00:00Z' AS published_at, 'channel ' || n AS channel_title, url || '#img' AS thumbnail_url
       FROM pages, (SELECT unnest(range(2)) AS n)""",
)
def s08(spark, sf):
    return readers.flatten_video_search(landed(spark, search_pages(spark, sf), VIDEO_SEARCH), 2)


@check(
    "s09_video_details",
    "SELECT page_id::VARCHAR AS video_id, CASE WHEN page_id % 4 > 0 THEN url END AS title FROM pages",
)
def s09(spark, sf):
    p = table(spark, sf, "pages")
    item = F.struct(F.col("page_id").cast("string").alias("id"), F.struct(F.col("url").alias("title")).alias("snippet"))
    items = F.when(F.col("page_id") % 4 > 0, F.array(item, item)).otherwise(F.array_remove(F.array(item), item))
    pages = p.select(F.col("page_id").cast("string").alias("video_id"), items.alias("items"))
    return readers.first_item(landed(spark, pages, VIDEO_DETAILS)).select("video_id", F.col("item.snippet.title").alias("title"))


def line_pages(spark, sf, key, kind):
    """The lines of one order as the movies of one result page."""
    li = table(spark, sf, "lineitem")
    popularity = F.when(F.col("l_linenumber") != 2, F.col("l_extendedprice"))
    hit = F.struct(
        F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("id"), popularity.alias("popularity"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title"),
    )
    grouped = li.groupBy(F.col("l_orderkey").cast(kind).alias(key)).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    result = lambda h: F.struct(h["id"].alias("id"), h["title"].alias("title"), h["popularity"].alias("popularity"))
    return grouped.select(key, F.transform("hits", result).alias("results"))


HITS_SQL = """hits AS (SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS popularity,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS place FROM lineitem)"""


@check(
    "s10_popular_pages",
    f"""WITH {HITS_SQL} SELECT l_orderkey::INT AS page, (place - 1)::INT AS pos, l_partkey AS id, 'part ' || l_partkey AS title, popularity
        FROM hits WHERE place <= 3""",
)
def s10(spark, sf):
    pages = landed(spark, line_pages(spark, sf, "page", "int"), MOVIE_PAGE)
    return readers.page_results(pages, 3).select("page", "pos", "id", "title", "popularity")


@check(
    "s11_search_results",
    f"""WITH {HITS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(popularity, 0) DESC, place) AS rn FROM hits)
        SELECT l_orderkey::VARCHAR AS query, (rn - 1)::INT AS pos, l_partkey AS id, popularity FROM o WHERE rn <= 3""",
)
def s11(spark, sf):
    pages = landed(spark, line_pages(spark, sf, "query", "string"), MOVIE_SEARCH)
    return readers.search_results(pages, 3).select("query", "pos", "id", "popularity")


def part_details(spark, sf):
    p = table(spark, sf, "part")
    names = F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.col("p_brand").alias("name")))
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("runtime"),
        names.alias("genres"), names.alias("production_companies"), F.col("p_retailprice").alias("vote_average"),
        F.lit(1).alias("vote_count"), F.lit(2).cast("bigint").alias("budget"), F.col("p_partkey").alias("revenue"),
        F.lit(0.5).alias("popularity"),
    )


@check(
    "s12_movie_details",
    """SELECT p_partkey AS tmdb_id, p_size AS runtime, p_type || ', ' || p_brand AS genres, p_retailprice AS tmdb_vote_average,
              p_partkey AS revenue FROM part""",
)
def s12(spark, sf):
    details = readers.flatten_details(landed(spark, part_details(spark, sf), MOVIE_DETAIL))
    return details.select("tmdb_id", "runtime", "genres", "tmdb_vote_average", "revenue")


@check(
    "s12_details_by_title",
    f"""WITH {HITS_SQL} SELECT l_orderkey::VARCHAR AS query, p_partkey AS id, p_name AS title, p_size AS runtime
        FROM hits JOIN part ON p_partkey = l_partkey WHERE place = 1""",
)
def s12_by_title(spark, sf):
    pages = landed(spark, line_pages(spark, sf, "query", "string"), MOVIE_SEARCH)
    details = landed(spark, part_details(spark, sf), MOVIE_DETAIL)
    return readers.details_by_title(pages, details).select("query", "id", "title", "runtime")


@check(
    "s13_supplement",
    """SELECT c_name AS title, '$' || format('{:,}', c_custkey * 1000) AS box_office, c_mktsegment AS rated FROM customer
       WHERE c_custkey % 3 > 0""",
)
def s13(spark, sf):
    c = table(spark, sf, "customer")
    records = c.select(
        F.col("c_name").alias("Title"), F.when(F.col("c_custkey") % 3 > 0, "True").otherwise("False").alias("Response"),
        F.concat(F.lit("$"), F.format_number(F.col("c_custkey") * 1000, 0)).alias("BoxOffice"), F.col("c_mktsegment").alias("Rated"),
    )
    return readers.flatten_supplement(landed(spark, records, SUPPLEMENT)).select("title", "box_office", "rated")


@check("s14_rows_to_table", "SELECT event_id AS comment_id, event_type AS text, date_trunc('second', ts) AS published_at FROM events")
def s14(spark, sf):
    """Rows with their fields in any order."""
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("text"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        F.col("event_id").alias("comment_id"),
    )
    typed = readers.rows_to_comments(spark, rows, "comment_id bigint, text string, published_at string")
    return typed.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@check("s14_timestamps", "SELECT event_id AS comment_id, date_trunc('second', ts) AS published_at FROM events")
def s14_times(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.col("event_id").alias("comment_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"))
    typed = readers.with_timestamp(rows)
    return typed.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@check(
    "s08_likely_trailers",
    """SELECT page_id, 'official trailer' AS title FROM pages WHERE page_id % 2 = 0""",
)
def s08_trailers(spark, sf):
    p = table(spark, sf, "pages")
    named = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("something else")
    hits = p.select(
        "page_id", F.lit("official trailer").alias("title"), F.concat(F.lit("about "), named).alias("description"),
        F.upper("url").alias("movie_title"),
    )
    return readers.likely_trailers(hits).select("page_id", "title")


COLLECT_SQL = """
    feed AS (SELECT c_nationkey + 1 AS page, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos
                     FROM customer),
            known AS (SELECT f.page, f.pos, m.tmdb_id, m.title, m.release_date,
                             CASE WHEN regexp_matches(replace(replace(box_office, '$', ''), ',', ''), '^[0-9]+$')
                                  THEN try_cast(replace(replace(box_office, '$', ''), ',', '') AS BIGINT) END AS box, m.revenue
                      FROM feed f JOIN m_event m ON m.tmdb_id = f.c_custkey WHERE f.page <= 20 AND f.pos <= 20),
            gated AS (SELECT * FROM known WHERE (revenue > 0 OR box IS NOT NULL) AND tmdb_id % 3 < 2),
            early AS (SELECT comment_id, movie_id, row_number() OVER (PARTITION BY movie_id ORDER BY comment_id) AS rn
                      FROM c_event JOIN gated ON tmdb_id = movie_id WHERE published_at <= release_date),
            n AS (SELECT movie_id, count(*) AS comment_count FROM early WHERE rn <= 30 GROUP BY 1 HAVING count(*) >= 10),
       accepted AS (SELECT *, row_number() OVER (ORDER BY page, pos) AS place FROM gated JOIN n ON movie_id = tmdb_id
                    QUALIFY place <= 40)"""


def collection_sources(spark, sf):
    """Popular pages, detail records, supplement, videos and thread pages from the given tables."""
    c, m, e = table(spark, sf, "customer"), m_event(spark, sf), table(spark, sf, "events")
    nothing = {k: F.lit(None).cast("string").alias(k) for k in ("poster_path", "overview")}
    listed = tables.top_k_per_group(c, ["c_nationkey"], [F.asc("c_custkey")], 20).join(
        m.select(F.col("tmdb_id").alias("c_custkey"), F.col("release_date").cast("string").alias("release_date")), "c_custkey"
    )
    hit = F.struct("rank", F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), "release_date", *nothing.values())
    popular = listed.groupBy((F.col("c_nationkey") + 1).alias("page")).agg(F.array_sort(F.collect_list(hit)).alias("results"))
    names = F.array(F.struct(F.col("segment").alias("name")))
    other = {"runtime": "int", "vote_average": "double", "vote_count": "int", "budget": "bigint", "popularity": "double"}
    details = m.select(
        F.col("tmdb_id").alias("id"), names.alias("genres"), names.alias("production_companies"), "revenue",
        *[F.lit(None).cast(t).alias(k) for k, t in other.items()],
    )
    empty = ["imdbRating", "imdbVotes", "imdbID", "Metascore", "Rated", "Awards", "Director", "Actors"]
    supplement = m.select(
        F.col("title").alias("Title"), F.lit("True").alias("Response"), F.col("box_office").alias("BoxOffice"),
        *[F.lit(None).cast("string").alias(k) for k in empty],
    )
    kind = F.when(F.col("tmdb_id") % 3 == 0, "Trailer").when(F.col("tmdb_id") % 3 == 1, "Teaser").otherwise("Clip")
    video = F.struct(kind.alias("type"), F.lit("YouTube").alias("site"), F.concat(F.lit("v"), F.col("tmdb_id").cast("string")).alias("key"))
    videos = m.select(F.col("tmdb_id").alias("id"), F.array(video).alias("results"))
    inner = F.struct(
        F.col("event_type").alias("textDisplay"), F.lit("a").alias("authorDisplayName"), F.lit(1).cast("bigint").alias("likeCount"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("publishedAt"),
    )
    wrapped = F.struct(F.struct(inner.alias("snippet")).alias("topLevelComment"))
    item = F.struct(F.col("event_id").cast("string").alias("id"), wrapped.alias("snippet"))
    threads = e.select(
        F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("video_id"), F.col("event_id").cast("int").alias("page"),
        F.array(item).alias("items"),
    )
    twice = [x.unionByName(x) for x in (details, supplement, videos)]  # repeated records change nothing
    return landed(spark, popular, MOVIE_PAGE), *twice, threads


LIMITS = {"min_movies": 40, "min_comments": 10}


def collect(spark, sf, folder=None):
    *sources, threads = collection_sources(spark, sf)
    return collection.collect_dataset(
        *sources, landed(spark, threads, THREAD_PAGE), comment_cap=30, folder=folder, **LIMITS
    )


def collect_stream(spark, sf, folder=None):
    """The pages land in three parts, each taken by a stream that is started again; the second part lands twice."""
    *sources, threads = collection_sources(spark, sf)
    candidates = collection.candidate_movies(*sources)
    store, state, pages = (scratch_path(spark, x) for x in ("taken", "taken_state", "pages"))
    part = F.floor(F.col("page") / (threads.agg(F.max("page") + 1).scalar() / 3))
    for number in (0, 1, 1, 2):
        threads.filter(part == number).write.mode("append").json(pages)
        stream = snapshots.landing_stream(spark, pages, THREAD_PAGE, "json")
        collected.stream_comments(stream, candidates, store, state, cap=30).awaitTermination()
    return collected.collected(candidates, store, folder=folder, **LIMITS)


COLLECTED_MOVIES = f"""WITH {COLLECT_SQL}
    SELECT tmdb_id, title, comment_count, CASE WHEN coalesce(revenue, 0) = 0 THEN coalesce(box, revenue) ELSE revenue END AS revenue,
           'v' || tmdb_id AS trailer_id
    FROM accepted"""
COLLECTED_COMMENTS = f"""WITH {COLLECT_SQL}
    SELECT c.comment_id::VARCHAR AS comment_id, c.movie_id, title AS movie, event_type AS clean_text, 0.0::DOUBLE AS polarity,
           'neutral' AS sentiment
    FROM early JOIN accepted USING (movie_id) JOIN c_event c USING (comment_id) WHERE rn <= 30"""
COLLECTED_BATCHES = f"""WITH {COLLECT_SQL}
    SELECT ceil(place / 10)::INT AS batch_id, movie_id, comment_count AS comments FROM accepted"""


@check("j07_collect_dataset", COLLECTED_MOVIES)
def collected_movies(spark, sf):
    _, movies = collect(spark, sf)
    return movies.select("tmdb_id", "title", "comment_count", "revenue", "trailer_id")


@check("j07_collect_comments", COLLECTED_COMMENTS)
def collected_comments(spark, sf):
    comments, _ = collect(spark, sf)
    return comments.select("comment_id", "movie_id", "movie", "clean_text", "polarity", "sentiment")


@check("s04_collection_snapshots", COLLECTED_BATCHES)
def collection_snapshots(spark, sf):
    folder = scratch_path(spark, "dataset")
    collect(spark, sf, folder)
    rows = writers.read_snapshot(spark, f"{folder}/comments_partial", 100)
    return rows.groupBy("batch_id", "movie_id").agg(F.count("*").alias("comments"))


@check("j07_stream_dataset", COLLECTED_MOVIES)
def streamed_movies(spark, sf):
    _, movies = collect_stream(spark, sf)
    return movies.select("tmdb_id", "title", "comment_count", "revenue", "trailer_id")


@check("j07_stream_comments", COLLECTED_COMMENTS)
def streamed_comments(spark, sf):
    comments, _ = collect_stream(spark, sf)
    return comments.select("comment_id", "movie_id", "movie", "clean_text", "polarity", "sentiment")


@check("s04_stream_collection", COLLECTED_BATCHES)
def streamed_batches(spark, sf):
    folder = scratch_path(spark, "dataset")
    collect_stream(spark, sf, folder)
    rows = writers.read_snapshot(spark, f"{folder}/comments_partial", 100)
    return rows.groupBy("batch_id", "movie_id").agg(F.count("*").alias("comments"))
