"""Projections, joins, aggregates and scores over the numeric stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from applause.functions import text as tx, values
from applause.operators import collection, movie_stats, partials, scoring, tables
from applause.schemas import require_columns
from applause.session import scratch_path
from applause.sources import readers

from .base import c_event, c_text, check, m_event, m_text, r, table

# --- projections and filters ------------------------------------------------------------------------


@check("p01_projection", "SELECT comment_id, movie, sentiment FROM c_event")
def p01(spark, sf):
    return c_event(spark, sf).select("comment_id", "movie", "sentiment")


@check("p02_constant_columns", "SELECT comment_id, 'one title' AS movie, cast(7 AS BIGINT) AS movie_id FROM c_event")
def p02(spark, sf):
    df = c_event(spark, sf).select("comment_id")
    return df.withColumns({"movie": F.lit("one title"), "movie_id": F.lit(7).cast("bigint")})


@check("p03_rename", "SELECT movie AS title, count(*) AS comment_count FROM c_event GROUP BY 1")
def p03(spark, sf):
    counted = c_event(spark, sf).groupBy("movie").count()
    return counted.withColumnsRenamed({"movie": "title", "count": "comment_count"})


@check("p04_drop_column", "SELECT tmdb_id, title, revenue FROM m_event")
def p04(spark, sf):
    return m_event(spark, sf).drop("release_date", "box_office", "segment", "nation")


@check(
    "p05_membership_filter",
    "SELECT comment_id, movie, polarity FROM c_event WHERE movie IN "
    "('Customer#000000003', 'Customer#000000014', 'Customer#000000015', 'nobody')",
)
def p05(spark, sf):
    chosen = ["Customer#000000003", "Customer#000000014", "Customer#000000015", "nobody"]
    return tables.pick_movies(c_event(spark, sf), chosen).select("comment_id", "movie", "polarity")


@check("p06_single_movie", "SELECT comment_id, likes FROM c_event WHERE movie = 'Customer#000000007'")
def p06(spark, sf):
    return tables.pick_movies(c_event(spark, sf), ["Customer#000000007"]).select("comment_id", "likes")


@check("p07_positive_revenue", "SELECT title, revenue FROM m_event WHERE revenue > 0")
def p07(spark, sf):
    return scoring.with_revenue(m_event(spark, sf)).select("title", "revenue")


GATE_SQL = """
    WITH n AS (SELECT movie, count(*) AS comment_count FROM c_event GROUP BY 1)
    SELECT title, comment_count, revenue FROM m_event JOIN n ON title = movie
    WHERE comment_count >= 60 AND revenue > 0"""


@check("p08_minimum_comments", GATE_SQL)
def p08(spark, sf):
    gated = movie_stats.integration_gate(c_event(spark, sf), m_event(spark, sf), 60)
    return gated.select("title", "comment_count", "revenue")


@check(
    "p09_date_cutoff",
    "SELECT comment_id FROM c_event WHERE coalesce(published_at <= "
    "CASE WHEN comment_id % 7 = 0 THEN NULL ELSE timestamp '2024-01-10' END, true)",
)
def p09(spark, sf):
    day = F.lit("2024-01-10").cast("timestamp_ntz")
    cutoff = F.when(F.col("comment_id") % 7 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(day)
    return c_event(spark, sf).filter(values.until(F.col("published_at"), cutoff)).select("comment_id")


BOX_SQL = r"""
    parsed AS (
        SELECT *, try_cast(replace(replace(box_office, '$', ''), ',', '') AS DOUBLE) AS d,
               CASE WHEN regexp_matches(replace(replace(box_office, '$', ''), ',', ''), '^[0-9]+$')
                    THEN try_cast(replace(replace(box_office, '$', ''), ',', '') AS BIGINT) END AS box FROM m_event),
    filled AS (
        SELECT *, CASE WHEN revenue IS NULL OR revenue = 0 THEN coalesce(box, revenue) ELSE revenue END AS full_revenue
        FROM parsed)"""


@check(
    "p10_box_office_gate",
    f"""WITH {BOX_SQL} SELECT 'gate' AS mode, title, full_revenue AS revenue FROM filled
        WHERE (revenue > 0 OR box IS NOT NULL) AND tmdb_id % 5 <> 0
        UNION ALL SELECT 'all', title, revenue FROM m_event""",
)
def p10(spark, sf):
    m = m_event(spark, sf).withColumn("known", F.col("tmdb_id") % 5 != 0)
    nothing = [F.lit(None).cast("string").alias(x) for x in ("imdbRating", "imdbVotes", "imdbID", "Metascore", "Rated", "Awards", "Director", "Actors")]
    once = m.select(F.col("title").alias("Title"), F.lit("True").alias("Response"), F.col("box_office").alias("BoxOffice"), *nothing)
    base, twice = m.drop("box_office"), once.unionByName(once)
    gated = collection.box_office_gate(collection.with_box_office(base, twice, details="known"), details="known")
    every = collection.box_office_gate(collection.with_box_office(base, twice, include_box_office=False), False)
    out = [x.select(F.lit(mode).alias("mode"), "title", "revenue") for mode, x in (("gate", gated), ("all", every))]
    return out[0].unionByName(out[1])


def picked_videos(spark, sf):
    """Each order's lines as the videos of one movie."""
    li = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "Trailer").when(F.col("l_returnflag") == "A", "Teaser")
    site = F.when(F.col("l_linestatus") == "F", "YouTube").otherwise("Elsewhere")
    video = F.struct(
        "l_linenumber", "l_partkey", kind.otherwise("Clip").alias("type"), site.alias("site"),
        F.concat(F.lit("v"), "l_partkey").alias("key"),
    )
    grouped = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(video)).alias("v"))
    results = F.transform("v", lambda x: F.struct(x["type"].alias("type"), x["site"].alias("site"), x["key"].alias("key")))
    return grouped.select("id", results.alias("results"))


TRAILER_SQL = """
    v AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS p, 'v' || l_partkey AS key,
                 CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS kind
          FROM lineitem WHERE l_linestatus = 'F'),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind, n, p) AS rn FROM v WHERE kind < 3),
    picked AS (SELECT o.id, r.key AS trailer_id
               FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem) o
               LEFT JOIN ranked r ON o.id = r.id AND r.rn = 1)"""


@check("p11_has_trailer", f"WITH {TRAILER_SQL} SELECT o_orderkey AS tmdb_id, trailer_id FROM orders "
       "JOIN picked ON id = o_orderkey WHERE trailer_id IS NOT NULL")
def p11(spark, sf):
    movies = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tmdb_id"))
    return collection.with_trailer(movies, picked_videos(spark, sf))


@check("p12_trailer_pick", f"WITH {TRAILER_SQL} SELECT id, trailer_id FROM picked")
def p12(spark, sf):
    return picked_videos(spark, sf).select("id", values.pick_trailer(F.col("results")).alias("trailer_id"))


@check(
    "p13_likely_trailer",
    """SELECT p_partkey AS id, p_name || ' official trailer 2024' AS query FROM part
       WHERE p_partkey % 3 < 2 AND p_partkey % 5 <> 4""",
)
def p13(spark, sf):
    key = F.col("p_partkey")
    kind = F.when(key % 3 == 0, "Teaser").when(key % 3 == 1, "TRAILER").otherwise("Interview")
    named = F.when(key % 5 != 4, F.col("p_type")).otherwise("something else")
    hits = table(spark, sf, "part").select(
        key.alias("id"), "p_name", F.concat_ws(" ", F.lit("A"), F.when(key % 2 == 0, named), kind).alias("title"),
        F.concat_ws(" ", F.lit("From"), F.when(key % 2 == 1, named)).alias("description"), F.col("p_type").alias("movie_title"),
    )
    return readers.likely_trailers(hits).select("id", values.trailer_query(F.col("p_name"), F.lit(2024)).alias("query"))


@check("p14_minimum_length", "SELECT comment_id FROM c_text WHERE length(text) >= 500")
def p14(spark, sf):
    return c_text(spark, sf).filter(tx.long_enough(F.col("text"), 500)).select("comment_id")


@check(
    "p15_sentence_noise",
    r"""WITH s AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations)
        SELECT conv_id, turn, line FROM s
        WHERE len(regexp_extract_all(line, '[^\s]+')) >= 3 AND length(line) >= 15
          AND NOT contains(line, '@') AND NOT contains(line, 'http')""",
)
def p15(spark, sf):
    lines = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(tx.is_sentence(F.col("line")))


@check(
    "p16_blank_handling",
    """WITH b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '  ' ELSE text END AS t
                  FROM documents)
       SELECT doc_id, coalesce(t, '') AS text, coalesce(trim(t), '') = '' AS blank FROM b""",
)
def p16(spark, sf):
    d = table(spark, sf, "documents")
    t = F.when(F.col("doc_id") % 3 == 2, F.col("text")).when(F.col("doc_id") % 3 == 1, "  ")
    return d.select("doc_id", F.coalesce(t, F.lit("")).alias("text"), tx.is_blank(t).alias("blank"))


@check("p17_polarity_category", "SELECT comment_id, sentiment FROM c_event")
def p17(spark, sf):
    return c_event(spark, sf).select("comment_id", values.category(F.col("polarity")).alias("sentiment"))


@check(
    "p18_sign_category",
    "SELECT comment_id, CASE WHEN polarity > 0 THEN 'positive' WHEN polarity < 0 THEN 'negative' ELSE 'neutral' END "
    "AS sign FROM c_event",
)
def p18(spark, sf):
    return c_event(spark, sf).select("comment_id", values.sign_category(F.col("polarity")).alias("sign"))


@check(
    "p19_required_columns",
    "SELECT count(*) AS n, count(DISTINCT movie) AS movies, true AS refused FROM c_event",
)
def p19(spark, sf):
    df = c_event(spark, sf)
    require_columns(df, ["movie", "polarity"], "comments")
    try:
        require_columns(df.drop("polarity"), ["movie", "polarity"], "comments")
        refused = False
    except ValueError:
        refused = True
    return df.agg(F.count("*").alias("n"), F.count_distinct("movie").alias("movies"), F.lit(refused).alias("refused"))


STATS_SQL = """
    s AS (SELECT movie, count(*) AS comment_count,
                 count(*) FILTER (sentiment = 'positive') AS positive_count,
                 count(*) FILTER (sentiment = 'negative') AS negative_count,
                 avg(polarity) AS avg_polarity FROM c_event GROUP BY 1),
    joined AS (
        SELECT tmdb_id, title, revenue, box_office,
               coalesce(comment_count, 0) AS comment_count, coalesce(positive_count, 0) AS positive_count,
               coalesce(negative_count, 0) AS negative_count,
               coalesce(comment_count - positive_count - negative_count, 0) AS neutral_count,
               round(coalesce(positive_count / comment_count * 100, 0), 9) AS positive_pct,
               round(coalesce(negative_count / comment_count * 100, 0), 9) AS negative_pct,
               round(coalesce((comment_count - positive_count - negative_count) / comment_count * 100, 0), 9) AS neutral_pct,
               round(coalesce(avg_polarity, 0), 9) AS avg_polarity
        FROM m_event LEFT JOIN s ON title = movie)"""
STAT_COLUMNS = [
    "comment_count", "positive_count", "negative_count", "neutral_count", "positive_pct", "negative_pct",
    "neutral_pct", "avg_polarity",
]


@check(
    "p20_null_fill",
    f"WITH {STATS_SQL} SELECT title, comment_count, positive_pct, avg_polarity FROM joined",
)
def p20(spark, sf):
    per = movie_stats.movie_sentiment(c_event(spark, sf))
    joined = m_event(spark, sf).select("title").join(per, "title", "left")
    filled = tables.fill_statistics(joined, ["comment_count"], ["positive_pct", "avg_polarity"])
    return filled.select("title", "comment_count", r("positive_pct").alias("positive_pct"), r("avg_polarity").alias("avg_polarity"))


@check(
    "p21_numeric_coercion",
    "SELECT title, try_cast(replace(box_office, '$', '') AS DOUBLE) AS as_number, "
    "try_cast(box_office AS DOUBLE) AS raw_number FROM m_event",
)
def p21(spark, sf):
    box = F.col("box_office")
    return m_event(spark, sf).select(
        "title", values.to_number(F.replace(box, F.lit("$"), F.lit("")), "double").alias("as_number"),
        values.to_number(box, "double").alias("raw_number"),
    )


# --- joins ------------------------------------------------------------------------------------------


@check("j01_left_join_stats", f"WITH {STATS_SQL} SELECT title, revenue, {', '.join(STAT_COLUMNS)} FROM joined")
def j01(spark, sf):
    stats = movie_stats.movie_sentiment_stats(c_event(spark, sf), m_event(spark, sf).select("title", "revenue"))
    return _rounded(stats.select("title", "revenue", *STAT_COLUMNS))


def _rounded(df, digits=9):
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


ENGAGE_SQL = """
    e AS (SELECT movie, cast(sum(likes) AS BIGINT) AS like_count,
                 count(*) FILTER (sentiment = 'positive') / count(*) * 100 AS positive_pct,
                 CASE WHEN sum(likes) > 0 THEN count(*) / sum(likes) ELSE 0 END AS comment_like_ratio,
                 1 - stddev_samp(polarity) AS sentiment_consistency FROM c_event GROUP BY 1),
    p0 AS (SELECT title, revenue, like_count, positive_pct, comment_like_ratio, sentiment_consistency
           FROM m_event JOIN e ON title = movie WHERE revenue > 0),
    p AS (SELECT *, CASE WHEN (SELECT max(like_count) FROM p0) > 0 THEN
            0.3 * positive_pct / 100
            + CASE WHEN (SELECT max(comment_like_ratio) FROM p0) > 0
                   THEN 0.3 * (1 - comment_like_ratio / (SELECT max(comment_like_ratio) FROM p0)) ELSE 0 END
            + 0.2 * sentiment_consistency + 0.2 * like_count / (SELECT max(like_count) FROM p0)
          ELSE 0 END AS prediction_score FROM p0)"""


@check(
    "j02_inner_join_metrics",
    f"WITH {ENGAGE_SQL} SELECT title, revenue, like_count, round(positive_pct, 9) AS positive_pct FROM p",
)
def j02(spark, sf):
    paid = scoring.with_revenue(m_event(spark, sf)).select("title", "revenue")
    out = paid.join(movie_stats.engagement(c_event(spark, sf)), "title")
    return _rounded(out.select("title", "revenue", "like_count", "positive_pct"))


@check(
    "j03_keyed_update",
    """WITH s AS (SELECT movie, avg(polarity) AS a, count(*) FILTER (sentiment = 'positive') / count(*) * 100 AS p
                  FROM c_event GROUP BY 1)
       SELECT title, round(p, 9) AS positive_pct, round(a, 9) AS avg_polarity FROM m_event LEFT JOIN s ON title = movie""",
)
def j03(spark, sf):
    updated = movie_stats.with_movie_sentiment(m_event(spark, sf), movie_stats.movie_sentiment(c_event(spark, sf)))
    return _rounded(updated.select("title", "positive_pct", "avg_polarity"))


def successful(spark, sf):
    """Movies that earned more than the mean."""
    movies = m_text(spark, sf)
    return movies.filter(F.col("revenue") > movies.agg(F.avg("revenue")).scalar())


@check(
    "j04_semi_join",
    "SELECT comment_id, movie FROM c_text WHERE movie IN "
    "(SELECT title FROM m_text WHERE revenue > (SELECT avg(revenue) FROM m_text))",
)
def j04(spark, sf):
    return tables.known_movies_only(c_text(spark, sf), successful(spark, sf)).select("comment_id", "movie")


@check(
    "j05_anti_join",
    "SELECT comment_id, movie FROM c_text c WHERE NOT EXISTS "
    "(SELECT 1 FROM m_text m WHERE m.title = c.movie AND m.revenue > (SELECT avg(revenue) FROM m_text))",
)
def j05(spark, sf):
    return tables.unknown_movies_only(c_text(spark, sf), successful(spark, sf)).select("comment_id", "movie")


@check("j06_revenue_fallback", f"WITH {BOX_SQL} SELECT title, full_revenue AS revenue FROM filled")
def j06(spark, sf):
    return movie_stats.repair_revenue(m_event(spark, sf)).select("title", "revenue")


@check(
    "j07_attribute_enrichment",
    """SELECT c_custkey AS tmdb_id, c_name AS title, 'a, ' || n_name AS genres, n_regionkey AS runtime,
              CASE WHEN s.revenue > 0 THEN c_mktsegment END AS rated
       FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
       LEFT JOIN m_event s ON s.title = c_name""",
)
def j07(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    base = c.select(F.col("c_custkey").alias("tmdb_id"), F.col("c_name").alias("title"))
    named = F.array(F.struct(F.lit("a").alias("name")), F.struct(F.col("n_name").alias("name")))
    nothing = {k: F.lit(None).cast(t) for k, t in [("vote_average", "double"), ("vote_count", "int"), ("budget", "bigint"),
                                                   ("revenue", "bigint"), ("popularity", "double")]}
    details = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("id"), F.col("n_regionkey").alias("runtime"), named.alias("genres"),
        named.alias("production_companies"), *[v.alias(k) for k, v in nothing.items()],
    )
    m = m_event(spark, sf)
    found = F.when(F.col("revenue") > 0, "True").otherwise("False")
    empty = ["BoxOffice", "imdbRating", "imdbVotes", "imdbID", "Metascore", "Awards", "Director", "Actors"]
    supplement = m.select(
        F.col("title").alias("Title"), found.alias("Response"), F.col("segment").alias("Rated"),
        *[F.lit(None).cast("string").alias(x) for x in empty],
    )
    return collection.enrich(base, details, supplement).select("tmdb_id", "title", "genres", "runtime", "rated")


@check(
    "j08_join_until_release",
    """SELECT comment_id, movie_id FROM c_event JOIN m_event ON movie_id = tmdb_id
       WHERE published_at <= release_date""",
)
def j08(spark, sf):
    return collection.comments_until_release(c_event(spark, sf), m_event(spark, sf)).select("comment_id", "movie_id")


@check(
    "j11_cluster_lookup",
    """WITH d(cluster, description) AS (VALUES (0, 'Music: beat'), (1, 'Story & Plot: arc'), (3, 'Cast: star'))
       SELECT comment_id, c.cluster, coalesce(description, 'Cluster ' || c.cluster) AS description
       FROM c_text c LEFT JOIN d ON c.cluster = d.cluster""",
)
def j11(spark, sf):
    from applause.operators import themes

    return themes.with_description(c_text(spark, sf).select("comment_id", "cluster"), small_descriptions(spark))


def small_descriptions(spark):
    rows = [(0, "Music: beat"), (1, "Story & Plot: arc"), (3, "Cast: star")]
    return spark.createDataFrame(rows, "cluster int, description string")


# --- set operations ---------------------------------------------------------------------------------


@check(
    "u01_bag_union",
    """SELECT movie, count(*) AS n, count(lang) AS with_lang FROM (
         SELECT movie, lang FROM c_text UNION ALL SELECT movie, lang FROM c_text WHERE lang <> 'en'
         UNION ALL SELECT movie, NULL FROM c_event) GROUP BY 1""",
)
def u01(spark, sf):
    texts = c_text(spark, sf).select("movie", "lang")
    frames = [texts, texts.filter("lang <> 'en'"), c_event(spark, sf).select("movie")]
    return tables.union_all(frames).groupBy("movie").agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"))


@check("u02_distinct_titles", "SELECT DISTINCT movie FROM c_event")
def u02(spark, sf):
    return c_event(spark, sf).select("movie").distinct()


@check(
    "u03_feature_columns",
    """WITH b AS (SELECT avg(polarity) AS m, stddev_samp(polarity) AS s, avg((sentiment = 'positive')::INT) AS pm,
                         stddev_samp((sentiment = 'positive')::INT) AS ps FROM c_event)
       SELECT comment_id, round((polarity - m) / s, 9) AS polarity_z,
              round(((sentiment = 'positive')::INT - pm) / ps, 9) AS positive_z FROM c_event, b""",
)
def u03(spark, sf):
    from applause.operators import themes
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    df, columns = themes.sentiment_features(c_event(spark, sf).select("comment_id", "polarity", "sentiment"))
    vec = VectorAssembler(inputCols=columns, outputCol="v").transform(df).select("comment_id", vector_to_array("v").alias("v"))
    return vec.select("comment_id", r(F.col("v")[0]).alias("polarity_z"), r(F.col("v")[1]).alias("positive_z"))


# --- windows, limits and samples --------------------------------------------------------------------


@check(
    "w01_share_of_total",
    "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 9) AS share FROM events GROUP BY 1",
)
def w01(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return _rounded(tables.with_share(counts, "n"))


@check(
    "w02_by_maximum",
    "SELECT movie, count(*) AS n, round(count(*) / (SELECT max(k) FROM (SELECT count(*) AS k FROM c_event GROUP BY movie)), 9) "
    "AS scaled FROM c_event GROUP BY 1",
)
def w02(spark, sf):
    counts = c_event(spark, sf).groupBy("movie").agg(F.count("*").alias("n"))
    return _rounded(tables.by_maximum(counts, "n", "scaled"))


@check(
    "w03_top_k_per_group",
    """SELECT movie, comment_id, likes, rank FROM (
         SELECT movie, comment_id, likes, row_number() OVER (PARTITION BY movie ORDER BY likes DESC, comment_id) AS rank
         FROM c_event) WHERE rank <= 3""",
)
def w03(spark, sf):
    df = c_event(spark, sf).select("movie", "comment_id", "likes")
    return tables.top_k_per_group(df, ["movie"], [F.desc("likes"), F.asc("comment_id")], 3)


@check(
    "w04_group_argmax",
    """SELECT movie, first(sentiment ORDER BY n DESC, sentiment) AS sentiment FROM (
         SELECT movie, sentiment, count(*) AS n FROM c_event GROUP BY 1, 2) GROUP BY 1""",
)
def w04(spark, sf):
    best = movie_stats.dominant_sentiment(c_event(spark, sf), "movie")
    return best.select("movie", F.col("dominant_sentiment").alias("sentiment"))


@check("l01_preview", "SELECT comment_id, movie, likes FROM c_event ORDER BY comment_id LIMIT 10")
def l01(spark, sf):
    return tables.top_k(c_event(spark, sf).select("comment_id", "movie", "likes"), [F.asc("comment_id")], 10)


@check("l03_top_likes", "SELECT comment_id, likes, sentiment FROM c_event ORDER BY likes DESC, comment_id LIMIT 5")
def l03(spark, sf):
    df = c_event(spark, sf).select("comment_id", "likes", "sentiment")
    return tables.top_k(df, [F.desc("likes"), F.asc("comment_id")], 5)


@check("l04_top_revenue", "SELECT title, revenue FROM m_event WHERE revenue > 0 ORDER BY revenue DESC, title LIMIT 10")
def l04(spark, sf):
    return scoring.top_revenue(m_event(spark, sf))


@check("l05_sort_by_revenue", "SELECT title, revenue FROM m_event WHERE revenue > 0 ORDER BY revenue DESC, title")
def l05(spark, sf):
    return scoring.with_revenue(m_event(spark, sf)).select("title", "revenue").orderBy(F.desc("revenue"), "title")


@check(
    "l06_cluster_sample",
    """SELECT cluster, comment_id FROM (SELECT cluster, comment_id, row_number() OVER (
         PARTITION BY cluster ORDER BY md5(comment_id || '42'), comment_id) AS rn FROM c_text) WHERE rn <= 3""",
)
def l06(spark, sf):
    from applause.operators import themes

    return themes.sample_comments(c_text(spark, sf).select("comment_id", "cluster")).select("cluster", "comment_id")


@check(
    "l08_first_accepted",
    """WITH feed AS (SELECT c_nationkey + 1 AS page, c_custkey,
                            row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos FROM customer)
       SELECT page, tmdb_id, revenue FROM (
         SELECT f.page, m.tmdb_id, m.revenue, f.pos FROM feed f JOIN m_event m ON m.tmdb_id = f.c_custkey
         WHERE f.page <= 20 AND f.pos <= 20 AND m.revenue > 0) ORDER BY page, pos LIMIT 50""",
)
def l08(spark, sf):
    c = table(spark, sf, "customer").select((F.col("c_nationkey") + 1).alias("page"), "c_custkey")
    first = tables.top_k_per_group(c, ["page"], [F.asc("c_custkey")], 20)
    hit = F.struct(F.col("rank"), F.col("c_custkey").alias("id"))
    pages = first.groupBy("page").agg(F.array_sort(F.collect_list(hit)).alias("results"))
    feed = collection.feed_order(pages).select("page", "pos", F.col("id").alias("tmdb_id"))
    accepted = scoring.with_revenue(feed.join(m_event(spark, sf), "tmdb_id"))
    return tables.top_k(accepted.select("page", "pos", "tmdb_id", "revenue"), [F.asc("page"), F.asc("pos")], 50).drop("pos")


@check(
    "l09_comment_cap",
    """SELECT movie_id, comment_id FROM (SELECT movie_id, comment_id,
         row_number() OVER (PARTITION BY movie_id ORDER BY published_at, comment_id) AS rn FROM c_event
         WHERE published_at <= timestamp '2024-01-20') WHERE rn <= 30""",
)
def l09(spark, sf):
    early = c_event(spark, sf).filter("published_at <= timestamp_ntz '2024-01-20'")
    placed = early.select("movie_id", "comment_id", F.col("published_at").alias("page"), F.col("comment_id").alias("pos"))
    return collection.cap_comments(placed, 30, "movie_id").select("movie_id", "comment_id")


# --- aggregates -------------------------------------------------------------------------------------


@check("a01_comments_per_movie", "SELECT movie AS title, count(*) AS comment_count FROM c_event GROUP BY 1")
def a01(spark, sf):
    return tables.comments_per_movie(c_event(spark, sf))


@check(
    "a02_movie_sentiment_stats",
    f"WITH {STATS_SQL}, {BOX_SQL} SELECT tmdb_id, j.title, f.full_revenue AS revenue, {', '.join(STAT_COLUMNS)} "
    "FROM joined j JOIN filled f USING (tmdb_id)",
)
def a02(spark, sf):
    movies = m_event(spark, sf).withColumn("comment_count", F.lit(-1))
    out = movie_stats.movie_sentiment_stats(c_event(spark, sf), movies)
    return _rounded(out.select("tmdb_id", "title", "revenue", *STAT_COLUMNS))


NUMERIC_SQL = """
    WITH s AS (SELECT movie, count(*) AS n, count(*) FILTER (polarity > 0) AS p, count(*) FILTER (polarity < 0) AS g,
                      avg(polarity) AS a FROM {source} GROUP BY 1)
    SELECT title, coalesce(n, 0) AS comment_count, coalesce(p, 0) AS positive_count, coalesce(g, 0) AS negative_count,
           coalesce(n - p - g, 0) AS neutral_count, round(coalesce(p / n * 100, 0), 9) AS positive_pct,
           round(coalesce(a, 0), 9) AS avg_sentiment
    FROM m_event LEFT JOIN s ON title = movie"""


def appended(spark, sf):
    """Seven batches appended one part at a time, the fourth twice, the first three then made one."""
    comments = c_event(spark, sf).withColumn("batch_id", (F.col("comment_id") % 7).cast("int"))
    path, target = scratch_path(spark, "partials"), scratch_path(spark, "compacted")
    for batches in ([0, 1, 2], [3], [3, 4], [5, 6]):
        partials.append(comments.filter(F.col("batch_id").isin(batches)), path)
    partials.compact(spark, path, target, 2)
    return partials.read(spark, target)


@check("a02_appended_stats", f"WITH {STATS_SQL} SELECT title, revenue, {', '.join(STAT_COLUMNS)} FROM joined")
def a02_appended(spark, sf):
    stats = partials.movie_statistics(appended(spark, sf), m_event(spark, sf).select("title", "revenue"))
    return _rounded(stats.select("title", "revenue", *STAT_COLUMNS))


@check(
    "a04_appended_deviation",
    """SELECT movie, count(*) AS comment_count, round(avg(polarity), 9) AS avg_polarity,
              round(stddev_samp(polarity), 9) AS polarity_std, coalesce(sum(likes), 0)::BIGINT AS likes_count
       FROM c_event GROUP BY 1""",
)
def a04_appended(spark, sf):
    stats = partials.statistics(appended(spark, sf))
    return _rounded(stats.select("movie", "comment_count", "avg_polarity", "polarity_std", "likes_count"))


@check(
    "a12_appended_totals",
    """SELECT count(*) AS comment_count, count(*) FILTER (sentiment = 'positive') AS positive_count,
              count(*) FILTER (sentiment = 'negative') AS negative_count, count(polarity) AS known_count,
              coalesce(sum(likes), 0)::BIGINT AS likes_count, round(avg(polarity), 9) AS avg_polarity,
              round(stddev_samp(polarity), 9) AS polarity_std FROM c_event""",
)
def a12_appended(spark, sf):
    return _rounded(partials.totals(appended(spark, sf)))


@check("a03_numeric_sentiment_stats", NUMERIC_SQL.format(source="c_event"))
def a03(spark, sf):
    numeric = c_event(spark, sf).drop("sentiment").withColumnRenamed("polarity", "sentiment")
    out = movie_stats.numeric_sentiment_stats(numeric, m_event(spark, sf))
    return _rounded(out.select("title", "comment_count", "positive_count", "negative_count", "neutral_count",
                               "positive_pct", "avg_sentiment"))


@check(
    "a04_movie_sentiment",
    """SELECT movie AS title, count(*) AS comment_count, round(avg(polarity), 9) AS avg_polarity,
              round(count(*) FILTER (sentiment = 'positive') / count(*) * 100, 9) AS positive_pct,
              round(count(*) FILTER (sentiment = 'negative') / count(*) * 100, 9) AS negative_pct
       FROM c_event GROUP BY 1""",
)
def a04(spark, sf):
    return _rounded(movie_stats.movie_sentiment(c_event(spark, sf)))


@check(
    "a05_polarity_fallback",
    """SELECT movie AS title, round((count(*) FILTER (sentiment = 'positive') - count(*) FILTER (sentiment = 'negative'))
              / count(*), 9) AS avg_polarity FROM c_event GROUP BY 1""",
)
def a05(spark, sf):
    return _rounded(movie_stats.movie_sentiment(c_event(spark, sf).drop("polarity")).select("title", "avg_polarity"))


@check(
    "a06_sentiment_distribution",
    """SELECT sentiment, count(*) AS count, round(count(*) / (SELECT count(*) FROM c_event) * 100, 9) AS pct
       FROM c_event GROUP BY 1""",
)
def a06(spark, sf):
    return _rounded(tables.with_share(movie_stats.sentiment_distribution(c_event(spark, sf)), "count", "pct", 100.0))


PIVOT_SQL = """SELECT movie, count(*) FILTER (sentiment = 'positive') AS positive,
    count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral
    FROM c_event GROUP BY 1"""


@check("a07_distribution_by_movie", PIVOT_SQL)
def a07(spark, sf):
    return movie_stats.sentiment_distribution(c_event(spark, sf), by="movie")


@check(
    "a08_cluster_cross_table",
    """SELECT cluster, round(avg((sentiment = 'negative')::INT), 9) AS negative,
              round(avg((sentiment = 'neutral')::INT), 9) AS neutral,
              round(avg((sentiment = 'positive')::INT), 9) AS positive FROM c_text GROUP BY 1""",
)
def a08(spark, sf):
    return _rounded(movie_stats.sentiment_by_cluster(c_text(spark, sf)))


@check(
    "a09_row_percent",
    f"""SELECT movie, round(positive * 100 / (positive + negative + neutral), 9) AS positive,
               round(negative * 100 / (positive + negative + neutral), 9) AS negative,
               round(neutral * 100 / (positive + negative + neutral), 9) AS neutral FROM ({PIVOT_SQL})""",
)
def a09(spark, sf):
    pivot = movie_stats.sentiment_distribution(c_event(spark, sf), by="movie")
    return _rounded(movie_stats.row_shares(pivot, 100.0))


@check(
    "a10_dashboard_metrics",
    """WITH s AS (SELECT movie, avg(polarity) AS a FROM c_event GROUP BY 1),
            c AS (SELECT corr(a, revenue) AS r FROM m_event JOIN s ON title = movie WHERE revenue > 0)
       SELECT (SELECT count(*) FROM m_event) AS total_movies, round((SELECT avg(revenue) FROM m_event), 2) AS avg_revenue,
              count(*) AS total_comments, round(count(*) / (SELECT count(*) FROM m_event), 9) AS avg_comments_per_movie,
              round(avg((sentiment = 'positive')::INT) * 100, 9) AS positive_pct,
              round(avg((sentiment = 'negative')::INT) * 100, 9) AS negative_pct,
              round((SELECT r * r FROM c), 9) AS sentiment_correlation FROM c_event""",
)
def a10(spark, sf):
    comments, movies = c_event(spark, sf), m_event(spark, sf)
    scored = movie_stats.with_movie_sentiment(movies, movie_stats.movie_sentiment(comments))
    r2 = scoring.regression_line(scored).select("r_squared").scalar()
    out = movie_stats.dashboard_metrics(movies, comments, r2)
    return _rounded(out.withColumn("avg_revenue", F.round("avg_revenue", 2)))


@check(
    "a11_dataset_status",
    """SELECT m.n AS movies, c.n AS comments, round(c.n / m.n, 9) AS comments_per_movie, paid AS movies_with_revenue,
              round(paid / m.n, 9) AS revenue_share
       FROM (SELECT count(*) AS n, count(*) FILTER (revenue > 0) AS paid FROM m_event) m, (SELECT count(*) AS n FROM c_event) c""",
)
def a11(spark, sf):
    return _rounded(movie_stats.dataset_status(m_event(spark, sf), c_event(spark, sf)))


@check(
    "a12_engagement",
    f"""WITH {ENGAGE_SQL} SELECT movie AS title, like_count, round(positive_pct, 9) AS positive_pct,
        round(comment_like_ratio, 9) AS comment_like_ratio, round(sentiment_consistency, 9) AS sentiment_consistency FROM e""",
)
def a12(spark, sf):
    return _rounded(movie_stats.engagement(c_event(spark, sf)))


@check(
    "a13_consistency_fallback",
    f"""SELECT movie AS title, round(1 - (abs(positive / t * 100 - 50) + abs(negative / t * 100 - 25)
          + abs(neutral / t * 100 - 25)) / 100, 9) AS sentiment_consistency
        FROM (SELECT *, positive + negative + neutral AS t FROM ({PIVOT_SQL}))""",
)
def a13(spark, sf):
    return _rounded(movie_stats.engagement(c_event(spark, sf).drop("polarity")).select("title", "sentiment_consistency"))


@check(
    "a14_list_value_counts",
    """SELECT trim(g) AS genre, count(*) AS n FROM (
         SELECT unnest(string_split(replace(p_name, ' ', ' , ') || ',' || p_type, ',')) AS g FROM part) GROUP BY 1""",
)
def a14(spark, sf):
    parts = table(spark, sf, "part").select(
        F.concat(F.replace("p_name", F.lit(" "), F.lit(" , ")), F.lit(","), "p_type").alias("genres")
    )
    return tables.list_value_counts(parts, "genres", "genre")


OUTLIER_SQL = """
    v AS (SELECT *, revenue::DOUBLE AS x FROM m_event WHERE revenue > 0),
    b AS (SELECT avg(x) AS m, stddev_samp(x) AS s, count(*) AS n FROM v),
    z AS (SELECT v.*, CASE WHEN s > 0 THEN abs((x - m) / s) ELSE 0 END AS z, n FROM v, b),
    t AS (SELECT coalesce(min(t) FILTER (kept >= {least}), 5.0) AS t FROM (
            SELECT t, (SELECT count(*) FROM z WHERE z.z <= g.t) AS kept
            FROM (SELECT unnest([{ladder}]) AS t) g)),
    kept AS (SELECT z.* FROM z, t WHERE n <= {least} OR z.z <= t.t)"""
LADDER = "0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0"


@check(
    "a15_outlier_summary",
    f"""WITH {OUTLIER_SQL.format(least=10, ladder="1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0")}
        SELECT n AS total_box_office_movies, k AS normal_range_count, n - k AS outlier_count,
               round((n - k) / n * 100, 9) AS outlier_pct, 1.5::DOUBLE AS z_score_threshold
        FROM (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM kept) AS k)""",
)
def a15(spark, sf):
    return _rounded(scoring.outlier_summary(m_event(spark, sf), threshold=1.5))


@check(
    "a16_integrate",
    """WITH n AS (SELECT movie, count(*) AS n, count(*) FILTER (polarity > 0) AS p, avg(polarity) AS a FROM c_event GROUP BY 1)
       SELECT title, n AS comment_count, round(p / n * 100, 9) AS positive_pct, round(a, 9) AS avg_sentiment, revenue
       FROM m_event JOIN n ON title = movie WHERE n >= 60 AND revenue > 0""",
)
def a16(spark, sf):
    movies, _ = movie_stats.integrate(c_event(spark, sf), m_event(spark, sf), 60)
    return _rounded(movies.select("title", "comment_count", "positive_pct", "avg_sentiment", "revenue"))


@check(
    "a16_integration_summary",
    """WITH n AS (SELECT movie, count(*) AS n FROM c_event GROUP BY 1)
       SELECT count(*) AS total_movies, count(*) FILTER (n >= 60 AND revenue > 0) AS valid_movies,
              round(count(*) FILTER (n >= 60 AND revenue > 0) / count(*) * 100, 9) AS retention_rate
       FROM m_event LEFT JOIN n ON title = movie""",
)
def a16_summary(spark, sf):
    return _rounded(movie_stats.integration_summary(c_event(spark, sf), m_event(spark, sf), 60))


@check(
    "a17_cluster_sizes",
    "SELECT cluster, count(*) AS count, round(count(*) / (SELECT count(*) FROM c_text) * 100, 9) AS percentage FROM c_text GROUP BY 1",
)
def a17(spark, sf):
    return _rounded(movie_stats.cluster_sizes(c_text(spark, sf)))


@check(
    "a18_dominant_sentiment",
    """SELECT cluster, first(sentiment ORDER BY n DESC, sentiment) AS dominant_sentiment, max(n) AS n FROM (
         SELECT cluster, sentiment, count(*) AS n FROM c_text GROUP BY 1, 2) GROUP BY 1""",
)
def a18(spark, sf):
    return movie_stats.dominant_sentiment(c_text(spark, sf))


@check(
    "a19_dominant_cluster",
    """SELECT event_type AS cluster, count(*) AS count, round(count(*) / (SELECT count(*) FROM events) * 100, 9) AS percentage
       FROM events GROUP BY 1 ORDER BY count DESC, cluster LIMIT 1""",
)
def a19(spark, sf):
    typed = table(spark, sf, "events").withColumnRenamed("event_type", "cluster")
    return _rounded(movie_stats.dominant_cluster(typed))


@check(
    "a21_sentiment_stats_map",
    """SELECT cluster, string_agg(sentiment || ':' || n || ':' || p, ' ' ORDER BY sentiment) AS stats FROM (
         SELECT cluster, sentiment, count(*) AS n,
                cast(round(count(*) / sum(count(*)) OVER (PARTITION BY cluster) * 100) AS INT) AS p
         FROM c_text GROUP BY 1, 2) GROUP BY 1""",
)
def a21(spark, sf):
    stats = movie_stats.sentiment_stats_map(c_text(spark, sf))
    entry = lambda e: F.concat_ws(
        ":", e["key"], e["value"]["count"].cast("string"), F.round(e["value"]["percentage"]).cast("int").cast("string")
    )
    listed = F.transform(F.array_sort(F.map_entries("sentiment_stats")), entry)
    return stats.select("cluster", F.array_join(listed, " ").alias("stats"))


@check("a24_movie_list", "SELECT DISTINCT movie FROM c_text ORDER BY 1")
def a24(spark, sf):
    return tables.movie_list(c_text(spark, sf))


@check(
    "a25_integration_checks",
    """WITH n AS (SELECT movie, count(*) AS n FROM c_text GROUP BY 1),
            m AS (SELECT title, revenue, coalesce(n, 0) AS comment_count FROM m_text LEFT JOIN n ON title = movie)
       SELECT *, violations = 0 AS passed FROM (
         SELECT 'revenue' AS "check", count(*) FILTER (revenue IS NULL OR revenue <= 0) AS violations FROM m
         UNION ALL SELECT 'comments', count(*) FILTER (comment_count <= 0) FROM m
         UNION ALL SELECT 'known_movies', count(*) FROM c_event WHERE movie NOT IN (SELECT title FROM m)
         UNION ALL SELECT 'sentiment_columns', 1)""",
)
def a25(spark, sf):
    counted = tables.replace_columns(m_text(spark, sf), tables.comments_per_movie(c_text(spark, sf)), "title")
    movies = tables.fill_statistics(counted, ["comment_count"], [])
    movies = movies.withColumns({"positive_pct": F.lit(0.0), "negative_pct": F.lit(0.0)})
    return movie_stats.integration_checks(movies, c_event(spark, sf))


# --- statistics and scores --------------------------------------------------------------------------

WITH_POLARITY_SQL = """
    s AS (SELECT movie, avg(polarity) AS avg_polarity,
                 count(*) FILTER (sentiment = 'positive') / count(*) * 100 AS positive_pct,
                 count(*) FILTER (sentiment = 'negative') / count(*) * 100 AS negative_pct FROM c_event GROUP BY 1),
    ms AS (SELECT m.*, avg_polarity, positive_pct, negative_pct FROM m_event m JOIN s ON title = movie WHERE revenue > 0)"""


def scored_movies(spark, sf):
    per_movie = movie_stats.movie_sentiment(c_event(spark, sf)).drop("comment_count")
    return scoring.with_revenue(m_event(spark, sf)).join(per_movie, "title")


@check(
    "m01_revenue_correlations",
    f"""WITH {WITH_POLARITY_SQL} SELECT round(corr(avg_polarity, revenue), 9) AS avg_polarity,
        round(corr(positive_pct, revenue), 9) AS positive_pct, round(corr(negative_pct, revenue), 9) AS negative_pct FROM ms""",
)
def m01(spark, sf):
    return _rounded(scoring.revenue_correlations(scored_movies(spark, sf), ["avg_polarity", "positive_pct", "negative_pct"]))


LINE_SQL = f"""{WITH_POLARITY_SQL},
    line AS (SELECT count(*) AS n, regr_slope(revenue, avg_polarity) AS slope, regr_intercept(revenue, avg_polarity) AS intercept,
                    corr(avg_polarity, revenue) AS r, min(avg_polarity) AS lo, max(avg_polarity) AS hi,
                    regr_syy(revenue, avg_polarity) AS syy, regr_sxx(revenue, avg_polarity) AS sxx FROM ms)"""

# Student's distribution for whole degrees of freedom as a finite sum over powers of cos(atan(t / sqrt(df))).
STUDENT_SQL = """student AS (SELECT df, atan(abs(r) * sqrt(df / (1 - r * r)) / sqrt(df)) AS a FROM (SELECT (n - 2)::DOUBLE AS df, r FROM line)),
    powers AS (SELECT j, a, df, CASE WHEN df % 2 = 0 THEN (2 * j - 1) / (2.0 * j) ELSE 2 * j / (2.0 * j + 1) END * cos(a) * cos(a) AS f
               FROM student, range(1, greatest(CASE WHEN df % 2 = 0 THEN df / 2 ELSE (df - 1) / 2 END, 1)::BIGINT) t(j)),
    series AS (SELECT 1 + coalesce(sum(p), 0) AS total FROM (SELECT exp(sum(ln(f)) OVER (ORDER BY j)) AS p FROM powers)),
    tail AS (SELECT 1 - CASE WHEN df % 2 = 0 THEN sin(a) * total
                        ELSE 2 / pi() * (a + CASE WHEN df > 1 THEN sin(a) * cos(a) * total ELSE 0 END) END AS p FROM student, series)"""


@check(
    "m02_sentiment_regression",
    f"""WITH {LINE_SQL}, {STUDENT_SQL} SELECT n, round(slope, 2) AS slope, round(intercept, 2) AS intercept, round(r, 9) AS r,
        round(r * r, 9) AS r_squared, round((SELECT p FROM tail), 9) AS p_value,
        round(sqrt((1 - r * r) * syy / (n - 2) / sxx), 2) AS standard_error, round((SELECT corr(positive_pct, revenue) FROM ms), 9) AS corr_positive_pct,
        NULL::VARCHAR AS error FROM line""",
)
def m02(spark, sf):
    out = scoring.sentiment_revenue_correlation(scored_movies(spark, sf))
    money = {c: F.round(c, 2) for c in ["slope", "intercept", "standard_error"]}
    rest = {c: F.round(c, 9) for c in ["r", "r_squared", "corr_positive_pct", "p_value"]}
    return out.withColumns(money | rest).select(
        "n", "slope", "intercept", "r", "r_squared", "p_value", "standard_error", "corr_positive_pct", "error"
    )


@check(
    "m03_outlier_filter",
    f"WITH {OUTLIER_SQL.format(least=900, ladder=LADDER)} SELECT tmdb_id, title, revenue FROM kept",
)
def m03(spark, sf):
    return scoring.without_outliers(m_event(spark, sf), threshold=0.5, min_movies=900).select("tmdb_id", "title", "revenue")


@check(
    "m04_trend_ends",
    f"""WITH {ENGAGE_SQL}, t AS (SELECT regr_slope(revenue, prediction_score) AS b, regr_intercept(revenue, prediction_score) AS a,
               min(prediction_score) AS lo, max(prediction_score) AS hi FROM p)
        SELECT round(lo, 9) AS x_min, round(a + b * lo, 1) AS y_min, round(hi, 9) AS x_max, round(a + b * hi, 1) AS y_max FROM t""",
)
def m04(spark, sf):
    ends = scoring.trend_ends(scoring.prediction_scores(c_event(spark, sf), m_event(spark, sf)))
    return ends.withColumns({c: F.round(c, 9 if c[0] == "x" else 1) for c in ends.columns})


@check(
    "m05_sampled_line",
    f"""WITH {LINE_SQL} SELECT i::INT AS i, round(lo + i * (hi - lo) / 99, 9) AS x,
        round(intercept + slope * (lo + i * (hi - lo) / 99), 1) AS y FROM line, (SELECT unnest(range(100)) AS i)""",
)
def m05(spark, sf):
    line = scoring.sampled_line(scoring.regression_line(scored_movies(spark, sf)))
    return line.select("i", r("x").alias("x"), r("y", 1).alias("y"))


@check(
    "m06_score_r_squared",
    f"WITH {ENGAGE_SQL} SELECT round(pow(corr(prediction_score, revenue), 2), 9) AS r_squared FROM p",
)
def m06(spark, sf):
    scores = scoring.prediction_scores(c_event(spark, sf), m_event(spark, sf))
    return scores.agg(r(F.pow(scoring.correlation("prediction_score"), F.lit(2.0))).alias("r_squared"))


@check(
    "m07_metric_ranking",
    f"""WITH {ENGAGE_SQL} SELECT * FROM (
          SELECT 'Positive Sentiment %' AS metric, round(corr(positive_pct, revenue), 9) AS correlation FROM p
          UNION ALL SELECT 'Comment-to-Like Ratio', round(corr(comment_like_ratio, revenue), 9) FROM p
          UNION ALL SELECT 'Sentiment Consistency', round(corr(sentiment_consistency, revenue), 9) FROM p
          UNION ALL SELECT 'Prediction Score', round(corr(prediction_score, revenue), 9) FROM p)""",
)
def m07(spark, sf):
    ranked = scoring.metric_ranking(scoring.prediction_scores(c_event(spark, sf), m_event(spark, sf)))
    return ranked.select("metric", r("correlation").alias("correlation"))


COMPOSITE_SQL = """
    s AS (SELECT movie, count(*) FILTER (sentiment = 'positive') / count(*) AS positive_ratio,
                 count(*) AS comment_count, avg(polarity) AS avg_polarity FROM c_event GROUP BY 1),
    j AS (SELECT title, coalesce(revenue, 0) AS revenue, coalesce(positive_ratio, 0) AS positive_ratio,
                 coalesce(comment_count, 0)::DOUBLE AS comment_count, coalesce(avg_polarity, 0) AS avg_polarity
          FROM m_event LEFT JOIN s ON title = movie),
    k AS (SELECT *, comment_count / (SELECT max(comment_count) FROM j) AS normalized_count FROM j),
    scores AS (SELECT *, 0.5 * positive_ratio + 0.3 * normalized_count + 0.2 * avg_polarity AS composite_score FROM k)"""


@check(
    "m08_composite_score",
    f"""WITH {COMPOSITE_SQL} SELECT title, revenue, comment_count, round(positive_ratio, 9) AS positive_ratio,
        round(normalized_count, 9) AS normalized_count, round(composite_score, 9) AS composite_score FROM scores""",
)
def m08(spark, sf):
    out = scoring.composite_scores(c_event(spark, sf), m_event(spark, sf))
    return _rounded(out.drop("avg_polarity"))


@check(
    "m08_composite_correlations",
    f"""WITH {COMPOSITE_SQL} SELECT round(corr(positive_ratio, revenue), 9) AS positive_ratio,
        round(corr(normalized_count, revenue), 9) AS normalized_count, round(corr(avg_polarity, revenue), 9) AS avg_polarity,
        round(corr(composite_score, revenue), 9) AS composite_score FROM scores""",
)
def m08_correlations(spark, sf):
    return _rounded(scoring.composite_correlations(scoring.composite_scores(c_event(spark, sf), m_event(spark, sf))))


@check(
    "m09_prediction_score",
    f"""WITH {ENGAGE_SQL} SELECT title, revenue, like_count, round(comment_like_ratio, 9) AS comment_like_ratio,
        round(prediction_score, 9) AS prediction_score FROM p""",
)
def m09(spark, sf):
    out = scoring.prediction_scores(c_event(spark, sf), m_event(spark, sf))
    return _rounded(out.select("title", "revenue", "like_count", "comment_like_ratio", "prediction_score"))


@check(
    "m10_relative_score",
    f"""WITH {ENGAGE_SQL} SELECT title, round((prediction_score / (SELECT avg(prediction_score) FROM p) - 1) * 100, 8)
        AS vs_average_pct FROM p""",
)
def m10(spark, sf):
    scores = scoring.prediction_scores(c_event(spark, sf), m_event(spark, sf))
    return _rounded(scoring.relative_to_mean(scores).select("title", "vs_average_pct"), 8)


@check(
    "m11_standardise",
    """SELECT comment_id, round((likes - (SELECT avg(likes) FROM c_event)) / (SELECT stddev_samp(likes) FROM c_event), 9) AS likes_z,
              0.0::DOUBLE AS same_z FROM c_event""",
)
def m11(spark, sf):
    df = c_event(spark, sf).select("comment_id", "likes", F.lit(3.0).alias("same"))
    return _rounded(scoring.standardise(df, ["likes", "same"]).select("comment_id", "likes_z", "same_z"))


@check(
    "m12_long_counts",
    f"""SELECT movie AS "Movie", s AS "Sentiment", n AS "Count" FROM ({PIVOT_SQL}) UNPIVOT (n FOR s IN (positive, negative, neutral))""",
)
def m12(spark, sf):
    return movie_stats.long_counts(movie_stats.sentiment_distribution(c_event(spark, sf), by="movie"), "movie")


@check(
    "p22_presentation",
    f"""WITH {ENGAGE_SQL} SELECT title AS "Movie", round_even(revenue / 1e6, 1) AS "Revenue ($M)",
        round_even(prediction_score, 2) AS "Prediction Score", round_even(positive_pct, 1) AS "Positive Sentiment (%)",
        like_count AS "Likes", round_even(comment_like_ratio, 4) AS "Comment-to-Like Ratio",
        round_even(sentiment_consistency, 2) AS "Sentiment Consistency" FROM p""",
)
def p22(spark, sf):
    return scoring.prediction_table(scoring.prediction_scores(c_event(spark, sf), m_event(spark, sf)))
