"""Registry and the stand-in views over the given tables, in Spark and in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from applause.functions import lexicon, text as tx, values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query and, where there is one, its SQL form."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 9) -> Column:
    return F.round(c, digits)


# --- stand-in views ---------------------------------------------------------------------------------

CATEGORY_SQL = "CASE WHEN {0} > 0.05 THEN 'positive' WHEN {0} < -0.15 THEN 'negative' ELSE 'neutral' END"

VIEWS = {
    "c_event0": """
        SELECT event_id AS comment_id, user_id AS movie_id, printf('Customer#%09d', user_id) AS movie,
               ts AS published_at, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, value / 50 - 1)) AS polarity,
               cast(regexp_extract(props, '[0-9]+') AS BIGINT) AS likes, event_type
        FROM events""",
    "c_event": f"SELECT *, {CATEGORY_SQL.format('polarity')} AS sentiment FROM c_event0",
    "m_event": """
        SELECT c.c_custkey AS tmdb_id, c.c_name AS title,
               CASE c.c_custkey % 10 WHEN 3 THEN NULL WHEN 4 THEN 0 ELSE s.revenue END AS revenue,
               date '2024-01-01' + cast(c.c_custkey % 31 AS INT) AS release_date,
               CASE c.c_custkey % 4 WHEN 0 THEN '$' || format('{:,}', c.c_custkey * 1000 + 7) WHEN 1 THEN 'N/A'
                    WHEN 2 THEN '$12.5' END AS box_office,
               c.c_mktsegment AS segment, c.c_nationkey AS nation
        FROM customer c LEFT JOIN (
            SELECT o_custkey, sum(cast(round(o_totalprice * 100) AS BIGINT))::BIGINT AS revenue
            FROM orders GROUP BY 1) s ON c.c_custkey = s.o_custkey""",
    "c_text0": """
        SELECT doc_id AS comment_id, source AS movie, n_chars AS likes, lang,
               ((doc_id * 37) % 201 - 100) / 100.0::DOUBLE AS polarity, cast(doc_id % 5 AS INT) AS cluster,
               text || CASE doc_id % 6
                 WHEN 0 THEN ' This looks amazing, can''t wait! 🔥🔥'
                 WHEN 1 THEN ' The ending scene at 2:15 is "what we came to see" https://clips.example/w?v=9 bad'
                 WHEN 2 THEN ' Don''t bother, it''s a boring cash grab...Really bad.'
                 WHEN 3 THEN ' I really love the music and it''s not very good'
                 WHEN 4 THEN ' The trailer has a sick villain and terrible, scary character moments'
                 ELSE '' END AS text
        FROM documents""",
    "c_text": f"SELECT *, {CATEGORY_SQL.format('polarity')} AS sentiment FROM c_text0",
    "m_text": """
        SELECT s_suppkey AS tmdb_id, 'src' || s_suppkey AS title, l.revenue
        FROM supplier LEFT JOIN (
            SELECT l_suppkey, sum(cast(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS revenue
            FROM lineitem GROUP BY 1) l ON s_suppkey = l_suppkey""",
    "c_talk": """
        SELECT conv_id * 1000 + turn AS comment_id, role, text, conv_id,
               CASE role WHEN 'user' THEN 'positive' WHEN 'system' THEN 'negative' ELSE 'neutral' END AS sentiment,
               cast(conv_id % 4 AS INT) AS cluster, cast(length(text) AS BIGINT) AS likes
        FROM conversations""",
}

# Stop words the SQL forms can name too.
STOPS = (
    "a an and are as at be by can for from had has have he her his i in is it not of on or she so that the their they "
    "this to was we were will with you de la le les des et en un une que el los der die das und ist zu"
).split()

SPACE_SQL = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NOT_SPACE_SQL = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(items) -> str:
    return ", ".join(quoted(x) for x in items)


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE_SQL}+', ' ', 'g'))"


def links_sql(x: str) -> str:
    return f"regexp_replace({x}, '(http|www){NOT_SPACE_SQL}+', '', 'g')"


def expand_sql(x: str) -> str:
    for pattern, replacement in lexicon.CONTRACTIONS:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
    return x


def prose_sql(x: str) -> str:
    return rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}.,!?]', '', 'g')"


def sentiment_clean_sql(x: str) -> str:
    return squeeze_sql(prose_sql(links_sql(expand_sql(f"lower(coalesce({x}, ''))"))))


VIEWS["c_clean"] = f"SELECT *, {sentiment_clean_sql('text')} AS clean_text FROM c_text"


def with_views(sql: str) -> str:
    """Put the views a query names in front of it."""
    wanted: list[str] = []

    def need(body: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b{name}\b", body):
                need(VIEWS[name])
                if name not in wanted:
                    wanted.append(name)

    need(sql)
    if not wanted:
        return sql.strip()
    views = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in wanted)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {views}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {views}, {body[5:]}"
    return f"WITH {views} {body}"


def c_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    polarity = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 50 - 1))
    return e.select(
        F.col("event_id").alias("comment_id"),
        F.col("user_id").alias("movie_id"),
        F.format_string("Customer#%09d", "user_id").alias("movie"),
        F.col("ts").alias("published_at"),
        polarity.alias("polarity"),
        F.get_json_object("props", "$.k").cast("bigint").alias("likes"),
        "event_type",
        values.category(polarity).alias("sentiment"),
    )


def m_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    sums = o.groupBy(F.col("o_custkey").alias("tmdb_id")).agg(F.sum(cents).alias("revenue"))
    key = F.col("c_custkey")
    box = (
        F.when(key % 4 == 0, F.concat(F.lit("$"), F.format_number(key * 1000 + 7, 0)))
        .when(key % 4 == 1, "N/A")
        .when(key % 4 == 2, "$12.5")
    )
    movies = c.select(
        key.alias("tmdb_id"), F.col("c_name").alias("title"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 31).cast("int")).alias("release_date"),
        box.alias("box_office"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"),
    )
    unit = F.col("tmdb_id") % 10
    revenue = F.when(unit == 4, 0).when(unit != 3, F.col("revenue")).cast("bigint")
    return movies.join(sums, "tmdb_id", "left").withColumn("revenue", revenue)


def c_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 6
    tail = (
        F.when(kind == 0, " This looks amazing, can't wait! 🔥🔥")
        .when(kind == 1, ' The ending scene at 2:15 is "what we came to see" https://clips.example/w?v=9 bad')
        .when(kind == 2, " Don't bother, it's a boring cash grab...Really bad.")
        .when(kind == 3, " I really love the music and it's not very good")
        .when(kind == 4, " The trailer has a sick villain and terrible, scary character moments")
        .otherwise("")
    )
    polarity = ((F.col("doc_id") * 37) % 201 - 100) / 100.0
    return d.select(
        F.col("doc_id").alias("comment_id"),
        F.col("source").alias("movie"),
        F.col("n_chars").alias("likes"),
        "lang",
        polarity.alias("polarity"),
        (F.col("doc_id") % 5).cast("int").alias("cluster"),
        F.concat("text", tail).alias("text"),
        values.category(polarity).alias("sentiment"),
    )


def c_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c_text(spark, sf_dir).withColumn("clean_text", tx.clean_for_sentiment(F.col("text")))


def m_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    sums = li.groupBy(F.col("l_suppkey").alias("tmdb_id")).agg(F.sum(cents).alias("revenue"))
    movies = s.select(F.col("s_suppkey").alias("tmdb_id"), F.concat(F.lit("src"), "s_suppkey").alias("title"))
    return movies.join(sums, "tmdb_id", "left")


def c_talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    sentiment = F.when(F.col("role") == "user", "positive").when(F.col("role") == "system", "negative")
    return t.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("comment_id"), "role", "text", "conv_id",
        sentiment.otherwise("neutral").alias("sentiment"),
        (F.col("conv_id") % 4).cast("int").alias("cluster"),
        F.length("text").cast("bigint").alias("likes"),
    )
