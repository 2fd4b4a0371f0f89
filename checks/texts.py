"""Scalar functions, cleaning, sentiment, frequent terms and top comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from applause.functions import lexicon, text as tx, values
from applause.operators import sentiment, term_tables
from applause.session import cut_lineage

from .base import (
    SPACE_SQL, STOPS, c_clean, c_event, c_text, check, expand_sql, links_sql, listed, prose_sql, quoted, r,
    sentiment_clean_sql, squeeze_sql, table,
)

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def doc(spark, sf, column):
    return c_text(spark, sf).select("comment_id", column)


# --- cleaning ---------------------------------------------------------------------------------------


@check(
    "f01_clean_text",
    f"""SELECT comment_id, {squeeze_sql(prose_sql(
        "regexp_replace(" + expand_sql(links_sql("lower(text)")) + r", '[0-9]+:[0-9]+', '', 'g')"))} AS clean FROM c_text""",
)
def f01(spark, sf):
    return doc(spark, sf, tx.clean_text(F.col("text")).alias("clean"))


@check("f02_clean_for_sentiment", f"SELECT comment_id, {sentiment_clean_sql('text')} AS clean FROM c_text")
def f02(spark, sf):
    return doc(spark, sf, tx.clean_for_sentiment(F.col("text")).alias("clean"))


CLUSTER_CLEAN = squeeze_sql(
    rf"""regexp_replace(regexp_replace({links_sql(expand_sql("lower(text)"))},
        '[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]', '', 'g'), '\bcannot\b', 'can not', 'g')"""
)


@check(
    "f03_clean_for_clustering",
    f"""SELECT comment_id, array_to_string(list_filter(string_split({CLUSTER_CLEAN}, ' '),
        lambda w: w <> '' AND w NOT IN ({listed(STOPS)})), ' ') AS clean FROM c_text""",
)
def f03(spark, sf):
    return doc(spark, sf, tx.clean_for_clustering(F.col("text"), STOPS).alias("clean"))


@check("f04_expand_contractions", f"SELECT comment_id, {expand_sql('lower(text)')} AS expanded FROM c_text")
def f04(spark, sf):
    return doc(spark, sf, tx.expand_contractions(F.lower("text")).alias("expanded"))


def marked_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '([.!?])([A-Z])', '\1 \2', 'g')"
    x = rf"regexp_replace({x}, '\.{{2,}}', '.', 'g')"
    return rf"regexp_replace({x}, '([a-z])([A-Z])', '\1. \2', 'g')"


def closed_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[.!?]{SPACE_SQL}*$') THEN {x} ELSE {x} || '.' END"


def split_sql(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?]){SPACE_SQL}+', '\1' || chr(1), 'g'), chr(1))"


@check("f05_mark_sentence_ends", f"SELECT comment_id, {marked_sql('text')} AS marked FROM c_text")
def f05(spark, sf):
    return doc(spark, sf, tx.mark_sentence_ends(F.col("text")).alias("marked"))


@check("f06_end_with_stop", f"SELECT comment_id, {closed_sql('text')} AS closed FROM c_text")
def f06(spark, sf):
    return doc(spark, sf, tx.end_with_stop(F.col("text")).alias("closed"))


@check(
    "f07_tidy_summary",
    rf"""SELECT comment_id, regexp_replace(regexp_replace(replace(text, 'e,', 'e  ,..'), '{SPACE_SQL}+([.,!?])', '\1', 'g'),
         '\.{{2,}}', '.', 'g') AS tidy FROM c_text""",
)
def f07(spark, sf):
    loose = F.replace("text", F.lit("e,"), F.lit("e  ,.."))
    return doc(spark, sf, tx.tidy_summary(loose).alias("tidy"))


# --- numbers, dates, lists, addresses ---------------------------------------------------------------


@check(
    "f08_currency",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE cast(p_partkey * 1234567 AS BIGINT) END AS amount FROM part""",
)
def f08(spark, sf):
    k = F.col("p_partkey")
    money = F.concat(F.lit("$"), F.format_number(k * 1234567, 0))
    money = F.when(k % 3 == 1, F.lit("N/A")).otherwise(money)
    return table(spark, sf, "part").select("p_partkey", values.currency(money).alias("amount"))


@check(
    "f09_date_parse",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate::DATE END AS day,
              CASE WHEN o_orderkey % 5 = 0 THEN 'unkn' ELSE year(o_orderdate)::VARCHAR END AS year FROM orders""",
)
def f09(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit("unknown")).otherwise(day)
    return table(spark, sf, "orders").select("o_orderkey", values.to_day(raw).alias("day"), values.year_text(raw).alias("year"))


@check(
    "f10_iso_time",
    "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events",
)
def f10(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = F.when(F.col("event_id") % 9 == 0, F.lit("not a time")).otherwise(iso)
    return table(spark, sf, "events").select("event_id", values.iso_time(raw).cast("timestamp_ntz").alias("at"))


@check("f11_joined_names", "SELECT p_partkey, p_type || ', ' || p_brand || ', ' || p_name AS names FROM part")
def f11(spark, sf):
    people = F.array(*[F.struct(F.col(c).alias("name")) for c in ("p_type", "p_brand", "p_name")])
    return table(spark, sf, "part").select("p_partkey", values.joined_names(people).alias("names"))


@check(
    "f12_split_list",
    "SELECT p_partkey, unnest([p_type, p_brand, p_name]) AS item FROM part",
)
def f12(spark, sf):
    joined = F.concat(F.lit(" "), F.concat_ws(" , ", "p_type", "p_brand", "p_name"))
    return table(spark, sf, "part").select("p_partkey", F.explode(values.split_list(joined)).alias("item"))


@check(
    "f13_video_id",
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'k' || page_id WHEN 1 THEN 'k' || page_id || ' x'
         WHEN 2 THEN 'e' || page_id WHEN 3 THEN url WHEN 4 THEN NULL ELSE '' END AS video_id FROM pages""",
)
def f13(spark, sf):
    k = F.col("page_id")
    kid = k.cast("string")
    url = (
        F.when(k % 6 == 0, F.concat(F.lit("https://youtu.be/k"), kid, F.lit("?t=3")))
        .when(k % 6 == 1, F.concat(F.lit("https://www.youtube.com/watch?list=a&v=k"), kid, F.lit("%20x&v=2#t")))
        .when(k % 6 == 2, F.concat(F.lit("https://www.youtube.com/embed/e"), kid, F.lit("?rel=0")))
        .when(k % 6 == 3, F.col("url"))
        .when(k % 6 == 4, "")
        .otherwise("https://www.youtube.com/watch?w=1")
    )
    return table(spark, sf, "pages").select("page_id", values.video_id(url).alias("video_id"))


@check(
    "f14_cluster_labels",
    """SELECT p_partkey, p_brand || ' & ' || p_type || ': ' || p_name || ' (Cluster ' || p_size || ')' AS full_label,
              p_brand || ' (' || p_size || ')' AS short_label FROM part""",
)
def f14(spark, sf):
    d = F.concat("p_brand", F.lit(" & "), "p_type", F.lit(": "), "p_name")
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey", tx.full_label(d, size).alias("full_label"), tx.short_label(d, size).alias("short_label")
    )


@check("f15_theme_name", "SELECT p_partkey, p_brand || ' ' || p_type AS theme FROM part")
def f15(spark, sf):
    d = F.concat("p_brand", F.lit(" "), "p_type", F.lit(": "), "p_name", F.lit(": x"))
    return table(spark, sf, "part").select("p_partkey", tx.before_colon(d).alias("theme"))


@check(
    "f16_title_case",
    """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '),
         lambda w: upper(w[1]) || lower(w[2:])), ' ') AS shown FROM part""",
)
def f16(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.title_case(F.col("p_name")).alias("shown"))


@check("f17_poster_url", "SELECT page_id, 'https://image.tmdb.org/t/p/w500' || '/' || page_id || '.jpg' AS poster FROM pages")
def f17(spark, sf):
    path = F.concat(F.lit("/"), F.col("page_id").cast("string"), F.lit(".jpg"))
    return table(spark, sf, "pages").select("page_id", values.poster_url(path).alias("poster"))


@check(
    "f18_safe_ratio",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount > 0 THEN l_extendedprice / l_discount ELSE 0 END, 3)
       AS ratio FROM lineitem""",
)
def f18(spark, sf):
    ratio = values.safe_ratio(F.col("l_extendedprice"), F.col("l_discount"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(ratio, 3).alias("ratio"))


def contains_sql(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(t)})" for t in terms) + ")"


def matches_sql(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {quoted(p)})" for p in patterns) + ")"


@check(
    "f19_any_of_a_list",
    f"""SELECT comment_id, {contains_sql("lower(text)", ["trash", "best", "die", "scene"])} AS has_term,
        {matches_sql("lower(text)", ["can'?t wait", "th(a|e)t+ was"])} AS has_pattern FROM c_text""",
)
def f19(spark, sf):
    low = F.lower("text")
    return c_text(spark, sf).select(
        "comment_id", tx.contains_any(low, ["trash", "best", "die", "scene"]).alias("has_term"),
        tx.matches_any(low, ["can'?t wait", "th(a|e)t+ was"]).alias("has_pattern"),
    )


@check(
    "f20_clamp_and_power",
    """SELECT comment_id, round(abs(polarity), 9) AS strength, round(least(polarity + 0.5, 0.3), 9) AS capped,
              round(greatest(0.1, polarity), 9) AS floored, round(pow(polarity, 2), 9) AS squared FROM c_event""",
)
def f20(spark, sf):
    p = F.col("polarity")
    return c_event(spark, sf).select(
        "comment_id", r(F.abs(p)).alias("strength"), r(F.least(p + 0.5, F.lit(0.3))).alias("capped"),
        r(F.greatest(F.lit(0.1), p)).alias("floored"), r(F.pow(p, F.lit(2.0))).alias("squared"),
    )


@check(
    "f21_display_formats",
    """SELECT o_orderkey, format('{:,}', cast(floor(o_totalprice) AS BIGINT)) AS thousands,
              '$' || printf('%.1f', round_even(o_totalprice / 1e4, 1)) || 'M' AS millions,
              printf('%.2f', round_even(o_totalprice / 1e4, 2)) || '%' AS pct FROM orders""",
)
def f21(spark, sf):
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", values.thousands(F.floor(p)).alias("thousands"), values.millions(p * 100).alias("millions"),
        values.percent_text(p / 1e4, 2).alias("pct"),
    )


# --- sentiment --------------------------------------------------------------------------------------

LEXICON_SQL = "opinions(word, p, s) AS (VALUES " + ", ".join(
    f"({quoted(w)}, {p}::DOUBLE, {s}::DOUBLE)" for w, (p, s) in lexicon.OPINIONS.items()
) + "), boosts(word, f) AS (VALUES " + ", ".join(
    f"({quoted(w)}, {f}::DOUBLE)" for w, f in lexicon.INTENSIFIERS.items()
) + ")"


def base_sql(text: str, source: str) -> str:
    return rf"""{LEXICON_SQL},
    tok AS (SELECT comment_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (
              SELECT comment_id, regexp_extract_all(lower({text}), '{WORD}{{2,}}') AS t FROM {source})),
    seq AS (SELECT *, lag(w) OVER q AS p1, lag(w, 2) OVER q AS p2 FROM tok WINDOW q AS (PARTITION BY comment_id ORDER BY i)),
    hit AS (SELECT comment_id, o.p, o.s, coalesce(b.f, 1) AS f,
                   coalesce(CASE WHEN b.f IS NULL THEN p1 ELSE p2 END IN ({listed(lexicon.NEGATORS)}), false) AS neg
            FROM seq JOIN opinions o ON o.word = w LEFT JOIN boosts b ON b.word = p1),
    val AS (SELECT comment_id, greatest(-1, least(1, p * CASE WHEN neg THEN 1 / f ELSE f END))
                   * CASE WHEN neg THEN -0.5 ELSE 1 END AS v, least(1, s * f) AS s FROM hit),
    base AS (SELECT c.comment_id, coalesce(avg(v), 0) AS bp, coalesce(avg(s), 0) AS bs
             FROM {source} c LEFT JOIN val USING (comment_id) GROUP BY 1)"""


@check(
    "t01_base_polarity",
    f"""WITH {base_sql('clean_text', 'c_clean')}
        SELECT comment_id, round(bp, 9) AS polarity, round(bs, 9) AS subjectivity FROM base""",
)
def t01(spark, sf):
    scored = sentiment.with_base_scores(c_clean(spark, sf).select("comment_id", "clean_text"), "clean_text")
    return scored.select("comment_id", r("polarity").alias("polarity"), r("subjectivity").alias("subjectivity"))


@check(
    "t01_base_polarity_by_table",
    f"""WITH {base_sql('clean_text', 'c_clean')}
        SELECT comment_id, round(bp, 9) AS polarity, round(bs, 9) AS subjectivity FROM base""",
)
def t01_table(spark, sf):
    opinions = spark.createDataFrame(
        [(w, p, s) for w, (p, s) in lexicon.OPINIONS.items()], "word string, polarity double, subjectivity double"
    )
    boosts = spark.createDataFrame(list(lexicon.INTENSIFIERS.items()), "word string, intensity double")
    texts = c_clean(spark, sf).select("comment_id", "clean_text")
    scored = sentiment.base_scores_by_table(texts, "comment_id", "clean_text", opinions, boosts, lexicon.NEGATORS)
    return scored.select("comment_id", r("polarity").alias("polarity"), r("subjectivity").alias("subjectivity"))


FLAGS_SQL = {
    "has_positive_term": contains_sql("low", lexicon.DOMAIN_POSITIVE),
    "has_context": contains_sql("low", lexicon.CONTEXT),
    "has_negative_indicator": contains_sql("low", lexicon.NEGATIVE),
    "has_excitement": matches_sql("low", lexicon.EXCITEMENT),
}
FLAG_COLUMNS_SQL = ", ".join(f"{v} AS {k}" for k, v in FLAGS_SQL.items())


@check("t02_domain_flags", f"SELECT comment_id, {FLAG_COLUMNS_SQL} FROM (SELECT comment_id, lower(text) AS low FROM c_text)")
def t02(spark, sf):
    flags = sentiment.domain_flags(F.col("low"))
    texts = c_text(spark, sf).select("comment_id", F.lower("text").alias("low"))
    return texts.select("comment_id", *[c.alias(n) for n, c in flags.items()])


SLANG_SQL = (
    f"""(regexp_matches(low, '(^|{NOT_WORD})({"|".join(lexicon.SLANG_WORDS)})($|{NOT_WORD})')"""
    f""" OR regexp_matches(low, '(^|{WORD}){lexicon.SLANG_EMOJI}'))"""
)
REFERS_SQL = (
    "(contains({0}, '\"') OR contains({0}, '''') OR regexp_matches({0}, '[0-9]+:[0-9]+') "
    "OR regexp_matches({0}, '[0-9]+[\\s]*min'))"
)


def terms_sql(text: str, source: str, least: int = 3) -> str:
    """Frequent words and quoted phrases per movie."""
    return rf"""
    occ AS (SELECT movie, unnest(regexp_extract_all(lower({text}), '{WORD}+')) AS term FROM {source}
            UNION ALL
            SELECT movie, lower(q) FROM (SELECT movie, unnest(regexp_extract_all({text}, '"([^"]+)"', 1)) AS q FROM {source})
            WHERE len(regexp_extract_all(q, '[^\s]+')) BETWEEN 3 AND 5),
    freq AS (SELECT movie, term, count(*) AS n FROM occ WHERE length(term) > 2 GROUP BY 1, 2 HAVING count(*) >= {least})"""


@check("a23_frequent_terms", f"WITH {terms_sql('text', 'c_text')} SELECT movie, term, n FROM freq")
def a23(spark, sf):
    return sentiment.frequent_terms(c_text(spark, sf))


@check(
    "t03_term_references",
    f"""WITH {terms_sql('text', 'c_text')}
        SELECT comment_id FROM c_text c WHERE EXISTS (
          SELECT 1 FROM freq f WHERE f.movie = c.movie AND contains(lower(c.text), f.term))""",
)
def t03_terms(spark, sf):
    comments = c_text(spark, sf)
    return sentiment.comments_with_terms(comments, sentiment.frequent_terms(comments), "comment_id")


@check(
    "t03_rare_terms",
    f"""WITH {terms_sql('text', 'c_text')}, picked AS (SELECT * FROM freq WHERE n <= 9 AND length(term) >= 10)
        SELECT comment_id FROM c_text c WHERE EXISTS (
          SELECT 1 FROM picked f WHERE f.movie = c.movie AND contains(lower(c.text), f.term))""",
)
def t03_rare(spark, sf):
    comments = c_text(spark, sf)  # given terms: some short word is in nearly every text
    terms = sentiment.frequent_terms(comments).filter((F.col("n") <= 9) & (F.length("term") >= 10))
    return sentiment.comments_with_terms(comments, terms, "comment_id")


@check(
    "t03_neutral_reference",
    f"""WITH c AS (SELECT comment_id, text, lower(text) AS low FROM c_text)
        SELECT comment_id, {REFERS_SQL.format("text")} AND NOT {FLAGS_SQL["has_negative_indicator"]} AS neutral_reference,
               {SLANG_SQL} AS slang FROM c""",
)
def t03(spark, sf):
    texts = c_text(spark, sf).select("comment_id", "text", F.lower("text").alias("low"))
    neutral = sentiment.refers_to_content(F.col("text")) & ~tx.contains_any(F.col("low"), lexicon.NEGATIVE)
    return texts.select("comment_id", neutral.alias("neutral_reference"), sentiment.has_slang(F.col("low")).alias("slang"))


def adjusted_sql(neutral: str, text: str) -> str:
    return f"""CASE
      WHEN regexp_matches({text}, '{lexicon.CHEERING_EMOJI}') AND bp < 0.3 THEN 0.7
      WHEN (contains({text}, '"') OR (contains({text}, '''') AND bp < 0)) AND has_context THEN greatest(0.1, bp)
      WHEN has_negative_indicator AND bp > -0.2 THEN -0.4
      WHEN has_positive_term AND bp < 0 AND NOT has_negative_indicator THEN least(bp + 0.5, 0.3)
      WHEN has_positive_term AND has_context AND bp < 0 THEN 0.1
      WHEN {neutral} AND NOT has_negative_indicator AND bp < 0 THEN 0.1
      WHEN slang AND bp < 0.3 THEN 0.7
      WHEN has_excitement AND bp < 0.3 THEN 0.5
      ELSE bp END"""


def scored_sql(text: str, source: str, with_terms: bool) -> str:
    terms = f", {terms_sql(text, source)}" if with_terms else ""
    hit = (
        f"EXISTS (SELECT 1 FROM freq f WHERE f.movie = c.movie AND contains(lower(c.{text}), f.term))" if with_terms else "false"
    )
    return f"""{base_sql(text, source)}{terms},
    flagged AS (SELECT comment_id, movie, txt, bp, bs, term_hit, {REFERS_SQL.format("txt")} AS refers, {SLANG_SQL} AS slang,
                       {FLAG_COLUMNS_SQL}
                FROM (SELECT c.comment_id, c.movie, c.{text} AS txt, lower(c.{text}) AS low, bp, bs, {hit} AS term_hit
                      FROM {source} c JOIN base USING (comment_id))),
    adj AS (SELECT comment_id, movie, txt, {adjusted_sql("(refers OR term_hit)", "txt")}::DOUBLE AS polarity, bs AS subjectivity
            FROM flagged),
    scored AS (SELECT *, CASE WHEN polarity > 0.05 THEN 'positive' WHEN polarity < -0.15 THEN 'negative' ELSE 'neutral' END
               AS sentiment FROM adj)"""


@check(
    "t04_adjusted_polarity",
    f"WITH {scored_sql('text', 'c_text', False)} SELECT comment_id, round(polarity, 9) AS polarity, sentiment FROM scored",
)
def t04(spark, sf):
    scored = sentiment.score_comments(c_text(spark, sf).select("comment_id", "movie", "text"), text="text")
    return scored.select("comment_id", r("polarity").alias("polarity"), "sentiment")


PHRASES_SQL = rf"""
    words AS (SELECT comment_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (
              SELECT comment_id, regexp_extract_all(lower(clean_text), '{WORD}{{2,}}') AS t FROM c_clean)),
    ahead AS (SELECT *, lead(w) OVER q AS w2, lead(w, 2) OVER q AS w3, lag(w) OVER q AS p1, lag(w, 2) OVER q AS p2
              FROM words WINDOW q AS (PARTITION BY comment_id ORDER BY i)),
    spelt AS (SELECT comment_id, i, p1, p2, unnest([1, 2, 3]) AS n, unnest([w, w || ' ' || w2, w || ' ' || w2 || ' ' || w3]) AS entry FROM ahead),
    phrase AS (SELECT entry, ((length(entry) * 7) % 21 - 10) / 10.0::DOUBLE AS p, (length(entry) % 11) / 10.0::DOUBLE AS s
               FROM spelt WHERE entry IS NOT NULL AND n > 1 GROUP BY 1 HAVING count(*) >= 4),
    boosts(word, f) AS (VALUES """ + ", ".join(f"({quoted(w)}, {f}::DOUBLE)" for w, f in lexicon.INTENSIFIERS.items()) + rf"""),
    place AS (SELECT comment_id, i, p1, p2, n, p, s FROM spelt JOIN phrase USING (entry)
              QUALIFY row_number() OVER (PARTITION BY comment_id, i ORDER BY n DESC) = 1),
    after AS (SELECT a.*, b.i AS next FROM place a ASOF LEFT JOIN place b ON a.comment_id = b.comment_id AND a.i + a.n <= b.i),
    taken AS (SELECT comment_id, min(i) AS i FROM place GROUP BY 1
              UNION ALL SELECT a.comment_id, a.next FROM taken t JOIN after a ON a.comment_id = t.comment_id AND a.i = t.i
              WHERE a.next IS NOT NULL),
    hit AS (SELECT a.comment_id, a.p, a.s, coalesce(b.f, 1) AS f,
                   coalesce(CASE WHEN b.f IS NULL THEN p1 ELSE p2 END IN ({listed(lexicon.NEGATORS)}), false) AS neg
            FROM taken JOIN after a USING (comment_id, i) LEFT JOIN boosts b ON b.word = p1),
    val AS (SELECT comment_id, greatest(-1, least(1, p * CASE WHEN neg THEN 1 / f ELSE f END))
                   * CASE WHEN neg THEN -0.5 ELSE 1 END AS v, least(1, s * f) AS s FROM hit)"""


@check(
    "t01_phrase_lexicon",
    f"""WITH RECURSIVE {PHRASES_SQL}
        SELECT comment_id, round(coalesce(avg(v), 0), 9) AS polarity, round(coalesce(avg(s), 0), 9) AS subjectivity
        FROM c_clean LEFT JOIN val USING (comment_id) GROUP BY 1""",
)
def t01_phrases(spark, sf):
    """A lexicon of the corpus' own phrases of two and three words, which grows with it."""
    texts = cut_lineage(c_clean(spark, sf).select("comment_id", "clean_text", tx.words(F.col("clean_text"), 2).alias("tokens")))
    tokens = F.col("tokens")

    def grams_of(n):
        starts = F.sequence(F.lit(1), F.size(tokens) - n + 1)
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))

    grams = F.concat(grams_of(2), grams_of(3))
    found = texts.filter(F.size(tokens) >= 3).select(F.explode(grams).alias("word")).unionByName(
        texts.filter(F.size(tokens) == 2).select(F.array_join(tokens, " ").alias("word"))
    )
    n = F.length("word")
    opinions = found.groupBy("word").count().filter("count >= 4").select(
        "word", ((n * 7 % 21 - 10) / 10).alias("polarity"), (n % 11 / 10).alias("subjectivity")
    )
    scored = sentiment.with_base_scores(texts, "clean_text", cut_lineage(opinions), key="comment_id")
    return scored.select("comment_id", r("polarity").alias("polarity"), r("subjectivity").alias("subjectivity"))


TABLE_FLAGS = {"has_positive_term": lexicon.DOMAIN_POSITIVE, "has_context": lexicon.CONTEXT, "has_negative_indicator": lexicon.NEGATIVE}


@check(
    "t02_flags_by_table",
    f"SELECT comment_id, {', '.join(f'{contains_sql("low", terms)} AS {name}' for name, terms in TABLE_FLAGS.items())} "
    "FROM (SELECT comment_id, lower(text) AS low FROM c_text)",
)
def t02_tables(spark, sf):
    lists = {name: spark.createDataFrame([(t,) for t in terms], "term string") for name, terms in TABLE_FLAGS.items()}
    texts = c_text(spark, sf).select("comment_id", "text")
    return term_tables.with_flags(texts, "comment_id", "text", lists).drop("text")


@check(
    "f19_term_table",
    rf"""WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD}{{6,}}')) AS term FROM conversations),
        low AS MATERIALIZED (SELECT comment_id, lower(text) AS low FROM c_text)
        SELECT comment_id, length(term) AS length FROM low JOIN terms ON contains(low, term) GROUP BY 1, 2""",
)
def f19_table(spark, sf):
    """Texts that hold a long word of the conversations anywhere, by the word's length."""
    words = table(spark, sf, "conversations").select(F.explode(tx.words(F.col("text"), 6)).alias("term"))
    terms = words.distinct().select("term", F.length("term").alias("length"))
    texts = c_text(spark, sf).select("comment_id", F.lower("text").alias("low"))
    return term_tables.texts_holding(texts, "comment_id", "low", terms, "length").select(
        "comment_id", F.col("length").cast("bigint").alias("length")
    )


@check(
    "t04_adjusted_by_table",
    f"WITH {scored_sql('text', 'c_text', False)} SELECT comment_id, round(polarity, 9) AS polarity, sentiment FROM scored",
)
def t04_tables(spark, sf):
    opinions = spark.createDataFrame(
        [(w, p, s) for w, (p, s) in lexicon.OPINIONS.items()], "word string, polarity double, subjectivity double"
    )
    lists = {"positive": lexicon.DOMAIN_POSITIVE, "context": lexicon.CONTEXT, "negative": lexicon.NEGATIVE}
    flags = {name: spark.createDataFrame([(t,) for t in terms], "term string") for name, terms in lists.items()}
    comments = c_text(spark, sf).select("comment_id", "movie", "text")
    scored = sentiment.score_comments(comments, text="text", opinions=opinions, flags=flags)
    return scored.select("comment_id", r("polarity").alias("polarity"), "sentiment")


@check(
    "t05_score_comments",
    f"""WITH {scored_sql('clean_text', 'c_clean', True)}
        SELECT comment_id, movie, round(polarity, 9) AS polarity, round(subjectivity, 9) AS subjectivity, sentiment FROM scored""",
)
def t05(spark, sf):
    comments = c_clean(spark, sf).select("comment_id", "movie", "clean_text")
    scored = sentiment.score_comments(comments, movie="movie")
    return scored.select(
        "comment_id", "movie", r("polarity").alias("polarity"), r("subjectivity").alias("subjectivity"), "sentiment"
    )


@check(
    "p23_compute_if_missing",
    f"""WITH {scored_sql('clean_text', 'c_clean', True)}
        SELECT comment_id, txt AS clean_text, sentiment FROM scored""",
)
def p23(spark, sf):
    raw = c_text(spark, sf).select("comment_id", "movie", "text")
    once = sentiment.ensure_scored(raw)
    return sentiment.ensure_scored(once).select("comment_id", "clean_text", "sentiment")


@check("j09_column_in_place", f"SELECT comment_id, movie, {sentiment_clean_sql('text')} AS clean_text FROM c_text")
def j09(spark, sf):
    return c_text(spark, sf).withColumn("clean_text", tx.clean_for_sentiment(F.col("text"))).select("comment_id", "movie", "clean_text")


@check(
    "l02_top_negative",
    f"""WITH n AS (SELECT *, {contains_sql("lower(text)", lexicon.NEGATIVE)} AS marked FROM c_text WHERE sentiment = 'negative')
        SELECT comment_id, text, sentiment, polarity FROM n WHERE marked OR (SELECT count(*) FILTER (marked) FROM n) < 5
        ORDER BY polarity, comment_id LIMIT 5""",
)
def l02_negative(spark, sf):
    return sentiment.top_comments(c_text(spark, sf), "negative")


@check(
    "l02_top_positive",
    "SELECT comment_id, text, sentiment, polarity FROM c_text WHERE sentiment = 'positive' ORDER BY polarity DESC, comment_id LIMIT 5",
)
def l02_positive(spark, sf):
    return sentiment.top_comments(c_text(spark, sf), "positive")


@check(
    "j10_polarity_of_top_comments",
    "SELECT text, polarity FROM c_text WHERE sentiment = 'neutral' ORDER BY polarity DESC, comment_id LIMIT 5",
)
def j10(spark, sf):
    return sentiment.top_comments(c_text(spark, sf), "neutral").select("text", "polarity")

