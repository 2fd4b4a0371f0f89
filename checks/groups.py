"""TF-IDF, clusters, themes and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from applause.functions import lexicon
from applause.operators import movie_stats, sentences as trained, similarity, summaries, themes
from applause.plans import integrated

from .base import STOPS, c_clean, c_talk, c_text, check, listed, m_text, quoted, r
from .movies import small_descriptions
from .texts import closed_sql, marked_sql, split_sql

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


# --- features ---------------------------------------------------------------------------------------


def tfidf_sql(source: str, text: str) -> str:
    return rf"""
    kept AS (SELECT comment_id, list_filter(regexp_extract_all(lower({text}), '{WORD}{{2,}}'),
                    lambda w: w NOT IN ({listed(STOPS)})) AS t FROM {source}),
    one AS (SELECT comment_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM kept),
    two AS (SELECT comment_id, w || ' ' || lead(w) OVER (PARTITION BY comment_id ORDER BY i) AS w FROM one),
    tf AS (SELECT comment_id, w AS term, count(*) AS tf FROM (SELECT comment_id, w FROM one UNION ALL SELECT comment_id, w FROM two)
           WHERE w IS NOT NULL GROUP BY 1, 2),
    size AS (SELECT count(*) AS n FROM {source}),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    raw AS (SELECT comment_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), size
            WHERE df >= 2 AND df <= 0.9 * n),
    weights AS (SELECT comment_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY comment_id)) AS weight FROM raw)"""


TALK_WEIGHTS = tfidf_sql("c_talk", "text")


@check("t06_tfidf", f"WITH {TALK_WEIGHTS} SELECT comment_id, term, round(weight, 9) AS weight FROM weights")
def t06(spark, sf):
    weights = themes.tfidf(c_talk(spark, sf), "comment_id", "text", stops=STOPS)
    return weights.select("comment_id", "term", r("weight").alias("weight"))


CENTRES = f"""{TALK_WEIGHTS},
    centres AS (SELECT cluster, term, sum(weight) / (SELECT count(*) FROM c_talk s WHERE s.cluster = c.cluster) AS weight
                FROM weights JOIN c_talk c USING (comment_id) GROUP BY 1, 2)"""


@check(
    "l10_top_terms",
    f"""WITH {CENTRES} SELECT cluster, rank::INT AS rank, term, round(weight, 9) AS weight FROM (
          SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(weight, 12) DESC, term) AS rank FROM centres)
        WHERE rank <= 10""",
)
def l10(spark, sf):
    talk = c_talk(spark, sf)
    weights = themes.tfidf(talk, "comment_id", "text", stops=STOPS)
    top = themes.top_terms(weights, talk.select("comment_id", "cluster"), "comment_id")
    return top.withColumn("weight", r("weight"))


@check(
    "t07_assign_to_centres",
    f"""WITH {CENTRES}, sq AS (SELECT cluster, sum(weight * weight) AS sq FROM centres GROUP BY 1),
        dots AS (SELECT w.comment_id, c.cluster, sum(w.weight * c.weight) AS dot FROM weights w JOIN centres c USING (term) GROUP BY 1, 2)
        SELECT t.comment_id, first(sq.cluster ORDER BY round(sq - 2 * coalesce(dot, 0), 9), sq.cluster) AS cluster
        FROM c_talk t CROSS JOIN sq LEFT JOIN dots d ON d.comment_id = t.comment_id AND d.cluster = sq.cluster GROUP BY 1""",
)
def t07_assign(spark, sf):
    talk = c_talk(spark, sf)
    weights = themes.tfidf(talk, "comment_id", "text", stops=STOPS)
    centres = themes.mean_centres(weights, talk.select("comment_id", "cluster"), "comment_id")
    return themes.nearest_centre(weights, centres, talk.select("comment_id"), "comment_id")


# More steps than any run takes here: further ones change nothing.
KMEANS_STEPS = 30


def kmeans_sql(docs: str, k: int, starts: int = 10, seed: int = 42) -> str:
    """From ``feat(comment_id, term, weight)`` to ``best(comment_id, cluster)``, steps one after the other."""
    ctes = [f"""
    len AS MATERIALIZED (SELECT d.comment_id, coalesce(sum(weight * weight), 0) AS sq FROM {docs} d LEFT JOIN feat USING (comment_id) GROUP BY 1),
    p0 AS MATERIALIZED (SELECT comment_id, s FROM {docs}, range({starts}) t(s)
           QUALIFY row_number() OVER (PARTITION BY s ORDER BY md5(comment_id::VARCHAR || '/' || ({seed} + s)), comment_id) = 1)"""]
    for j in range(1, k):
        before = f", (SELECT d FROM n{j - 1} o WHERE o.comment_id = x.comment_id AND o.s = p.s)" if j > 1 else ""
        ctes.append(f"""
    m{j} AS (SELECT f.comment_id, p.s, sum(f.weight * c.weight) AS dot
             FROM p{j - 1} p JOIN feat c ON c.comment_id = p.comment_id JOIN feat f ON f.term = c.term GROUP BY ALL),
    n{j} AS MATERIALIZED (SELECT x.comment_id, p.s, least(round(greatest(x.sq + y.sq - 2 * coalesce(dot, 0), 0), 9){before}) AS d
             FROM len x CROSS JOIN p{j - 1} p JOIN len y ON y.comment_id = p.comment_id
             LEFT JOIN m{j} m ON m.comment_id = x.comment_id AND m.s = p.s),
    p{j} AS MATERIALIZED (SELECT comment_id, s FROM n{j} WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY s ORDER BY
             -ln((('0x' || substr(md5(comment_id::VARCHAR || '/' || ({seed} + s) || '/{j}'), 1, 12))::BIGINT + 1) / 281474976710656.0) / d, comment_id) = 1)""")
    ctes.append(f"""
    st AS MATERIALIZED ({' UNION ALL '.join(f'SELECT comment_id, s, {j} AS c FROM p{j}' for j in range(k))}),
    k0 AS MATERIALIZED (SELECT s, c, term, weight AS w FROM st JOIN feat USING (comment_id))""")
    for j in range(KMEANS_STEPS):
        ctes.append(f"""
    q{j} AS (SELECT s, c, sum(w * w) AS sq FROM k{j} GROUP BY ALL),
    e{j} AS (SELECT comment_id, s, c, sum(weight * w) AS dot FROM feat JOIN k{j} USING (term) GROUP BY ALL),
    g{j} AS (SELECT d.comment_id, st.s, st.c, round(coalesce(sq, 0) - 2 * coalesce(dot, 0), 9) AS gap
             FROM {docs} d CROSS JOIN st LEFT JOIN q{j} q ON q.s = st.s AND q.c = st.c
             LEFT JOIN e{j} e ON e.comment_id = d.comment_id AND e.s = st.s AND e.c = st.c),
    l{j} AS MATERIALIZED (SELECT comment_id, s, first(c ORDER BY gap, c) AS c, min(gap) AS gap FROM g{j} GROUP BY ALL),
    z{j} AS (SELECT s, c, count(*) AS n FROM l{j} GROUP BY ALL),
    k{j + 1} AS MATERIALIZED (
        SELECT s, c, term, sum(weight) / any_value(n) AS w FROM l{j} JOIN z{j} USING (s, c) JOIN feat USING (comment_id) GROUP BY s, c, term
        UNION ALL SELECT k.s, k.c, term, w FROM k{j} k ANTI JOIN z{j} z ON z.s = k.s AND z.c = k.c)""")
    last = KMEANS_STEPS - 1
    ctes.append(f"""
    win AS (SELECT s FROM l{last} GROUP BY s ORDER BY round(sum(gap), 6), s LIMIT 1),
    mine AS (SELECT comment_id, c FROM l{last} JOIN win USING (s)),
    numbers AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, min(comment_id)) - 1 AS cluster FROM mine GROUP BY c),
    best AS MATERIALIZED (SELECT comment_id, cluster::INT AS cluster FROM mine JOIN numbers USING (c))""")
    return ",".join(ctes)


@check("t07_kmeans", f"WITH {TALK_WEIGHTS}, feat AS MATERIALIZED (SELECT * FROM weights), {kmeans_sql('c_talk', 5)} SELECT comment_id, cluster FROM best")
def t07(spark, sf):
    found = themes.cluster_comments(c_talk(spark, sf).select("comment_id", "text"), text="text", k=5, stops=STOPS)
    return found.comments.select("comment_id", "cluster")


# --- themes -----------------------------------------------------------------------------------------


def theme_sql(x: str, terms) -> str:
    def pattern(t):
        return quoted(f"(^|{NOT_WORD}){t}($|{NOT_WORD})")

    return "(" + " OR ".join(f"regexp_matches({x}, {pattern(t)})" for t in terms) + ")::INT"


INDICATORS = ", ".join(f"{theme_sql('low', terms)} AS {t}" for t, terms in lexicon.THEMES.items())


def indicator_sql(source: str, text: str = "text") -> str:
    return f"ind AS (SELECT comment_id, cluster, {INDICATORS} FROM (SELECT *, lower({text}) AS low FROM {source}))"


INDICATOR_SQL = indicator_sql("c_text")


@check("t08_theme_indicators", f"WITH {INDICATOR_SQL} SELECT * EXCLUDE (cluster) FROM ind")
def t08(spark, sf):
    return themes.theme_indicators(c_text(spark, sf), "text").select("comment_id", *lexicon.THEMES)


@check(
    "a22_theme_prevalence",
    f"WITH {INDICATOR_SQL} SELECT cluster, {', '.join(f'round(avg({t}), 9) AS {t}' for t in lexicon.THEMES)} FROM ind GROUP BY 1",
)
def a22(spark, sf):
    prevalence = themes.theme_prevalence(themes.theme_indicators(c_text(spark, sf), "text"), list(lexicon.THEMES))
    return prevalence.select("cluster", *[r(t).alias(t) for t in lexicon.THEMES])


THEME_ROWS = ", ".join(
    f"({i}, {quoted(t)}, {quoted(lexicon.THEME_NAMES[t])})" for i, t in enumerate(lexicon.THEMES)
)
THEMED_SQL = f"""
    names(ord, theme, shown) AS (VALUES {THEME_ROWS}),
    prev AS (SELECT cluster, {', '.join(f'avg({t}) AS {t}' for t in lexicon.THEMES)} FROM ind GROUP BY 1),
    long AS (SELECT * FROM prev UNPIVOT (p FOR theme IN ({', '.join(lexicon.THEMES)}))),
    ranked AS (SELECT cluster, theme, shown, p, row_number() OVER (PARTITION BY cluster ORDER BY round(p, 12) DESC, ord) AS rn,
                      max(p) OVER (PARTITION BY cluster) AS top FROM long JOIN names USING (theme)),
    above AS (SELECT * FROM ranked WHERE round(p, 12) >= greatest(0.15, 0.7 * round(top, 12))),
    chosen AS (SELECT * FROM above UNION ALL
               SELECT * FROM ranked WHERE rn <= 2 AND cluster NOT IN (SELECT cluster FROM above)),
    lists AS (SELECT cluster, list(theme ORDER BY rn) AS t, array_to_string((list(shown ORDER BY rn))[1:2], ' & ') AS two
              FROM chosen GROUP BY 1),
    themed AS (SELECT cluster, CASE
        WHEN list_contains(t, 'emotion') AND list_contains(t, 'criticism') THEN 'Negative Reactions & Criticism'
        WHEN list_contains(t, 'emotion') AND list_contains(t, 'anticipation') THEN 'Excited Anticipation'
        WHEN list_contains(t, 'story') AND list_contains(t, 'criticism') THEN 'Story & Plot Criticism'
        WHEN list_contains(t, 'visuals') AND list_contains(t, 'emotion') THEN
             CASE WHEN emotion > 0 THEN 'Visual Appreciation' ELSE 'Visual Criticism' END
        ELSE two END AS theme FROM lists JOIN prev USING (cluster))"""
THEME_SQL = f"{INDICATOR_SQL}, {THEMED_SQL}"


@check("t09_cluster_themes", f"WITH {THEME_SQL} SELECT cluster, theme FROM themed UNION ALL SELECT 5, 'Miscellaneous Comments'")
def t09(spark, sf):
    return themes.cluster_themes(themes.theme_indicators(c_text(spark, sf), "text"), 6)


def z_sql(name: str, value: str) -> str:
    return f"SELECT comment_id, '{name}' AS term, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS weight FROM (SELECT comment_id, {value} AS v FROM docs)"


FEATURES = f"""feat AS MATERIALIZED (SELECT * FROM weights UNION ALL {z_sql('#p', 'polarity')}
          UNION ALL {z_sql('#positive', "(sentiment = 'positive')::INT::DOUBLE")} UNION ALL {z_sql('#neutral', "(sentiment = 'neutral')::INT::DOUBLE")}
          UNION ALL {z_sql('#negative', "(sentiment = 'negative')::INT::DOUBLE")})"""


@check(
    "t10_cluster_comments",
    f"""WITH docs AS MATERIALIZED (SELECT * FROM c_clean), {tfidf_sql('docs', 'clean_text')},
        {FEATURES},
        {kmeans_sql('docs', 5)},
        labelled AS (SELECT docs.* EXCLUDE (cluster), best.cluster FROM docs JOIN best USING (comment_id)),
        {indicator_sql('labelled', 'clean_text')}, {THEMED_SQL},
        tops AS (SELECT cluster, string_agg(term, ', ' ORDER BY rn) AS five FROM (
            SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY round(sum(weight) / any_value(n), 12) DESC, term) AS rn
            FROM best JOIN weights USING (comment_id) JOIN (SELECT cluster, count(*) AS n FROM best GROUP BY 1) USING (cluster)
            GROUP BY cluster, term) WHERE rn <= 5 GROUP BY 1),
        cross_table AS (SELECT cluster, avg((sentiment = 'positive')::INT) AS positive, avg((sentiment = 'negative')::INT) AS negative,
            avg((sentiment = 'neutral')::INT) AS neutral FROM labelled GROUP BY 1)
        SELECT cluster, theme || ': ' || coalesce(five, '') AS description, round(positive, 9) AS positive, round(negative, 9) AS negative,
               round(neutral, 9) AS neutral
        FROM themed LEFT JOIN tops USING (cluster) LEFT JOIN cross_table USING (cluster)""",
)
def t10(spark, sf):
    talk = c_clean(spark, sf).select("comment_id", "clean_text", "polarity", "sentiment")
    found = themes.cluster_comments(talk, k=5, stops=STOPS)
    shares = found.sentiment.select("cluster", *[r(c).alias(c) for c in ("positive", "negative", "neutral")])
    return found.descriptions.join(shares, "cluster", "left")


SMALL = "d(cluster, description) AS (VALUES (0, 'Music: beat'), (1, 'Story & Plot: arc'), (3, 'Cast: star'))"
NAMED = f"""{SMALL},
    n AS (SELECT c.cluster, count(*) AS count, coalesce(any_value(description), 'Cluster ' || c.cluster) AS description,
                 count(*) / (SELECT count(*) FROM c_text) * 100 AS percentage,
                 avg((sentiment = 'positive')::INT) AS positive, avg((sentiment = 'negative')::INT) AS negative,
                 avg((sentiment = 'neutral')::INT) AS neutral
          FROM c_text c LEFT JOIN d ON d.cluster = c.cluster GROUP BY c.cluster)"""


@check(
    "t11_cluster_chart",
    f"""WITH {NAMED} SELECT cluster, count, description || ' (Cluster ' || cluster || ')' AS label,
          trim(split_part(split_part(description, ':', 1), '&', 1)) || ' (' || cluster || ')' AS short_label,
          round(positive, 9) AS positive, round(negative, 9) AS negative, round(neutral, 9) AS neutral FROM n""",
)
def t11(spark, sf):
    chart = themes.cluster_chart(c_text(spark, sf), small_descriptions(spark))
    return chart.withColumns({c: r(c) for c in ("positive", "negative", "neutral")})


@check("t12_labelled_counts", f"WITH {NAMED} SELECT cluster, count, description FROM n")
def t12(spark, sf):
    return themes.labelled_counts(c_text(spark, sf), small_descriptions(spark))


DOMINANT = """best AS (SELECT cluster, first(sentiment ORDER BY k DESC, sentiment) AS s FROM (
    SELECT cluster, sentiment, count(*) AS k FROM c_text GROUP BY 1, 2) GROUP BY 1)"""


@check(
    "t20_theme_overview",
    f"""WITH {NAMED}, {DOMINANT} SELECT cluster, split_part(description, ':', 1) AS theme,
          count || ' (' || printf('%.1f', round_even(percentage, 1)) || '%)' AS comments,
          upper(s[1]) || s[2:] AS sentiment FROM n JOIN best USING (cluster)""",
)
def t20(spark, sf):
    return themes.theme_overview(c_text(spark, sf), small_descriptions(spark))


@check(
    "a20_strong_themes",
    """WITH s AS (SELECT event_type, CASE WHEN value / 50 - 1 > -0.7 THEN 'positive' ELSE 'negative' END AS sentiment FROM events),
       x AS (SELECT event_type, sentiment, count(*) / sum(count(*)) OVER (PARTITION BY event_type) AS share FROM s GROUP BY 1, 2)
       SELECT event_type AS cluster, sentiment, CASE event_type WHEN 'click' THEN 'Clicks' ELSE 'Cluster ' || event_type END AS theme,
              round(share, 9) AS share FROM x WHERE share > 0.6""",
)
def a20(spark, sf):
    from .base import table

    e = table(spark, sf, "events")
    sentiment = F.when(F.col("value") / 50 - 1 > -0.7, "positive").otherwise("negative")
    cross = movie_stats.sentiment_by_cluster(e.select(F.col("event_type").alias("cluster"), sentiment.alias("sentiment")))
    names = spark.createDataFrame([("click", "Clicks: a, b"), ("nowhere", "No: c")], "cluster string, description string")
    return themes.strong_themes(cross, names).withColumn("share", r("share"))


@check(
    "t19_insights",
    f"""WITH {SMALL}, n AS (SELECT c.cluster, count(*) AS k, coalesce(any_value(description), 'Cluster ' || c.cluster) AS dd,
              avg((s = 'positive')::INT) AS p, avg((s = 'negative')::INT) AS g
            FROM (SELECT cluster, CASE WHEN polarity > CASE WHEN cluster < 2 THEN -0.8 ELSE 0.9 END THEN 'positive' ELSE 'negative' END AS s
                  FROM c_text) c LEFT JOIN d ON d.cluster = c.cluster GROUP BY c.cluster)
        SELECT 1 AS ord, '**' || split_part(dd, ':', 1) || '** is the most common theme, representing '
               || printf('%.1f', round_even(k / (SELECT count(*) FROM c_text) * 100, 1)) || '% of all comments.' AS insight
        FROM (SELECT * FROM n ORDER BY k DESC, cluster LIMIT 1)
        UNION ALL SELECT 2, '**Positive sentiment** is strongest in themes related to '
               || string_agg(split_part(dd, ':', 1), ', ' ORDER BY cluster) || '.' FROM n WHERE p > 0.6 HAVING count(*) > 0
        UNION ALL SELECT 3, '**Negative sentiment** is strongest in themes related to '
               || string_agg(split_part(dd, ':', 1), ', ' ORDER BY cluster) || '.' FROM n WHERE g > 0.6 HAVING count(*) > 0""",
)
def t19(spark, sf):
    bar = F.when(F.col("cluster") < 2, -0.8).otherwise(0.9)
    split = c_text(spark, sf).withColumn("sentiment", F.when(F.col("polarity") > bar, "positive").otherwise("negative"))
    return themes.insights(split, small_descriptions(spark))


def label_part(c: str) -> str:
    return f"CASE WHEN {c} > 0 THEN '{c.title()}: ' || printf('%.1f', round_even({c} * 100, 1)) || '%' END"


@check(
    "t21_sentiment_label",
    f"""WITH {NAMED} SELECT cluster, concat_ws(', ', {label_part('negative')}, {label_part('neutral')}, {label_part('positive')})
        AS label FROM n""",
)
def t21(spark, sf):
    return themes.sentiment_label(movie_stats.sentiment_by_cluster(c_text(spark, sf)))


# --- summaries --------------------------------------------------------------------------------------


def sentences_sql(source: str, group: str, keep: str = "length(text) >= 20") -> str:
    cut = split_sql(marked_sql(closed_sql("text")))
    return f"""
    cut AS MATERIALIZED (SELECT {group} AS g, comment_id, {cut} AS parts FROM {source} WHERE {keep}),
    every AS (SELECT g, comment_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS pos FROM cut),
    sents AS MATERIALIZED (SELECT * FROM every WHERE len(regexp_extract_all(sentence, '[^\\s]+')) >= 3 AND length(sentence) >= 15
              AND NOT contains(sentence, '@') AND NOT contains(sentence, 'http'))"""


def sentence_weights_sql() -> str:
    return rf"""
    stok AS (SELECT g, comment_id, pos, unnest(regexp_extract_all(lower(sentence), '{WORD}{{2,}}')) AS term FROM sents),
    stf AS (SELECT g, comment_id, pos, term, count(*) AS tf FROM stok WHERE term NOT IN ({listed(STOPS)}) GROUP BY ALL),
    sdf AS (SELECT g, term, count(*) AS df FROM stf GROUP BY ALL),
    sn AS (SELECT g, count(*) AS n FROM sents GROUP BY ALL),
    sraw AS (SELECT g, comment_id, pos, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM stf JOIN sdf USING (g, term) JOIN sn USING (g)),
    sw AS MATERIALIZED (SELECT g, comment_id, pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY g, comment_id, pos)) AS w FROM sraw),
    deg AS MATERIALIZED (SELECT g, comment_id, pos, sum(w * s) AS d FROM sw
            JOIN (SELECT g, term, sum(w) AS s FROM sw GROUP BY ALL) USING (g, term) GROUP BY ALL)"""


def rank_sql(steps: int) -> str:
    ctes = [
        "r0 AS MATERIALIZED (SELECT g, comment_id, pos, n, d, 1 / n AS r FROM sents JOIN sn USING (g) LEFT JOIN deg USING (g, comment_id, pos))"
    ]
    for k in range(steps):
        ctes.append(f"""s{k} AS (SELECT g, term, sum(w * r / d) AS s FROM sw JOIN r{k} USING (g, comment_id, pos) GROUP BY ALL),
    i{k} AS (SELECT g, comment_id, pos, sum(w * s) AS inflow FROM sw JOIN s{k} USING (g, term) GROUP BY ALL),
    l{k} AS (SELECT g, sum(r) AS loose FROM r{k} WHERE d IS NULL GROUP BY ALL),
    r{k + 1} AS MATERIALIZED (SELECT r.g, r.comment_id, r.pos, n, d,
        0.15 / n + 0.85 * (coalesce(inflow, 0) + coalesce(loose, 0) / n) AS r
        FROM r{k} r LEFT JOIN i{k} i ON r.g = i.g AND r.comment_id = i.comment_id AND r.pos = i.pos LEFT JOIN l{k} l ON l.g = r.g)""")
    return ",\n".join(ctes)


STEPS = 30


def summary_sql(source: str, group: str, n: int = 3) -> str:
    return rf"""{sentences_sql(source, group)}, {sentence_weights_sql()}, {rank_sql(STEPS)},
    best AS (SELECT r.g, r.comment_id, r.pos, sentence, n, row_number() OVER (
               PARTITION BY r.g ORDER BY round(r, 10) DESC, r.comment_id DESC, r.pos DESC) AS rn
             FROM r{STEPS} r JOIN sents s ON r.g = s.g AND r.comment_id = s.comment_id AND r.pos = s.pos),
    joined AS (SELECT g, max(n) AS n, string_agg(sentence, ' ' ORDER BY comment_id, pos) AS x FROM best WHERE rn <= {n} GROUP BY 1),
    summ AS (SELECT g, CASE WHEN n <= {n} THEN x ELSE regexp_replace(regexp_replace(x, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+([.,!?])', '\1', 'g'),
             '\.{{2,}}', '.', 'g') END AS summary FROM joined),
    done AS (SELECT {group} AS g, count(*) AS count, CASE WHEN count(*) FILTER (length(text) >= 20) = 0
                    THEN 'No significant comments to summarize.' ELSE coalesce(any_value(summary), '') END AS summary
             FROM {source} LEFT JOIN summ ON summ.g = {group} GROUP BY 1)"""


OPTIONS = {"stops": STOPS, "max_steps": STEPS, "tolerance": None}


@check("t13_sentences", f"WITH {sentences_sql('c_text', 'movie')} SELECT g AS movie, comment_id, pos::INT AS pos, sentence FROM sents")
def t13(spark, sf):
    return summaries.comment_sentences(c_text(spark, sf), ["movie"], "comment_id", "text")


CLOSE = """["'')\\]}»”’]*$"""


def core_sql(token: str) -> str:
    return rf"regexp_replace(lower({token}), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')"


def likelihood_sql(k: str, n: str, p: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {n} > {k} THEN ({n} - {k}) * ln(1 - {p}) ELSE 0 END)"


LEARNED = rf"""
    tokens AS MATERIALIZED (SELECT comment_id, i, t[i + 1] AS token, t[i + 2] AS nxt FROM (
        SELECT comment_id, t, unnest(range(len(t))) AS i FROM (
            SELECT comment_id, regexp_extract_all(text, '[^ \t\n\f\r]+') AS t FROM c_talk WHERE length(text) >= 20))),
    typed AS MATERIALIZED (SELECT *, {core_sql('token')} AS word, {core_sql('nxt')} AS next_word,
        regexp_matches(token, '\p{{L}}\.{CLOSE}') AS stop, regexp_matches(token, '[.!?]{CLOSE}') AS closing,
        regexp_matches(token, '\.\.') AS dots FROM tokens),
    per_type AS (SELECT word, count(*)::DOUBLE AS n, count(*) FILTER (stop)::DOUBLE AS k FROM typed
                 WHERE regexp_matches(word, '^\p{{L}}[\p{{L}}.]*$') GROUP BY 1),
    stops AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (stop)::DOUBLE AS stops FROM typed),
    short AS MATERIALIZED (SELECT word, round(-2 * ({likelihood_sql('k', 'c.n', '(stops / s.n)')} - {likelihood_sql('k', 'c.n', '0.99::DOUBLE')})
        * exp(-letters) * (length(word) - letters + 1) * pow(letters, -(c.n - k)), 9) AS score
        FROM (SELECT *, length(replace(word, '.', ''))::DOUBLE AS letters FROM per_type) c, stops s WHERE k > 0 AND stops < s.n AND round(-2 * ({likelihood_sql('k', 'c.n', '(stops / s.n)')} - {likelihood_sql('k', 'c.n', '0.99::DOUBLE')})
        * exp(-letters) * (length(word) - letters + 1) * pow(letters, -(c.n - k)), 9) >= 0.3),
    follow AS (SELECT next_word AS word, closing AND NOT dots AND word NOT IN (SELECT word FROM short) AS ended FROM typed WHERE nxt IS NOT NULL),
    fsum AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (ended)::DOUBLE AS e FROM follow),
    fword AS (SELECT word, count(*)::DOUBLE AS n, count(*) FILTER (ended)::DOUBLE AS k FROM follow WHERE word <> '' GROUP BY 1),
    starter AS MATERIALIZED (SELECT * FROM (SELECT word, round(2 * ({likelihood_sql('k', 'e', '(k / e)')} + {likelihood_sql('(w.n - k)', '(s.n - e)', '((w.n - k) / (s.n - e))')}
        - {likelihood_sql('k', 'e', '(w.n / s.n)')} - {likelihood_sql('(w.n - k)', '(s.n - e)', '(w.n / s.n)')}), 6) AS score
        FROM fword w, fsum s WHERE k > 0 AND e < s.n AND k / e > w.n / s.n) WHERE score >= 30)"""


@check(
    "t13_learned_words",
    f"WITH {LEARNED} SELECT 'abbreviation' AS kind, word, round(score, 6) AS score FROM short UNION ALL SELECT 'starter', word, round(score, 3) FROM starter",
)
def t13_learned(spark, sf):
    long_ones = c_talk(spark, sf).filter("length(text) >= 20")
    short, starters = trained.learn(long_ones, "text")
    kinds = (short.withColumn("score", r("score", 6)), "abbreviation"), (starters.withColumn("score", r("score", 3)), "starter")
    a, b = (df.select(F.lit(kind).alias("kind"), "word", "score") for df, kind in kinds)
    return a.unionByName(b)


@check(
    "t13_trained_sentences",
    rf"""WITH {LEARNED},
        ending AS (SELECT comment_id, i, token, closing AND NOT (nxt IS NOT NULL AND regexp_matches(token, '\.{CLOSE}') AND CASE
              WHEN regexp_matches(token, '\.\.[.]*{CLOSE}') THEN NOT capital
              WHEN regexp_matches(token, '^[^\p{{L}}\p{{N}}]*\p{{Lu}}\.{CLOSE}') AND capital THEN true
              ELSE word IN (SELECT word FROM short) AND next_word NOT IN (SELECT word FROM starter) END) AS closes
            FROM (SELECT *, regexp_matches(regexp_replace(nxt, '^[^\p{{L}}\p{{N}}]+', ''), '^\p{{Lu}}') AS capital FROM typed)),
        numbered AS (SELECT *, coalesce(count(*) FILTER (closes) OVER (PARTITION BY comment_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
                     FROM ending),
        spoken AS (SELECT comment_id, pos, string_agg(token, ' ' ORDER BY i) AS sentence FROM numbered GROUP BY ALL)
        SELECT comment_id, pos::INT AS pos, sentence FROM spoken WHERE len(regexp_extract_all(sentence, '[^\s]+')) >= 3 AND length(sentence) >= 15
          AND NOT contains(sentence, '@') AND NOT contains(sentence, 'http')""",
)
def t13_trained(spark, sf):
    return trained.trained_sentences(c_talk(spark, sf), [], "comment_id", "text")


@check(
    "j12_similarity_sums",
    f"""WITH {sentences_sql('c_talk', 'conv_id')}, {sentence_weights_sql()}
        SELECT a.g AS conv_id, a.comment_id, a.pos::INT AS pos, round(sum(a.w * b.w), 8) AS degree
        FROM sw a JOIN sw b ON a.g = b.g AND a.term = b.term GROUP BY ALL""",
)
def j12(spark, sf):
    sentences = summaries.comment_sentences(c_talk(spark, sf), ["conv_id"], "comment_id", "text")
    weights = summaries.sentence_weights(sentences, ["conv_id"], "comment_id", STOPS)
    sums = summaries.similarity_sums(weights.persist(), ["conv_id"], "comment_id")
    return sums.withColumn("degree", r("degree", 8))


SIMILAR = f"""
    bag AS (SELECT g, comment_id, pos, list(term ORDER BY term) AS words FROM stok WHERE term NOT IN ({listed(STOPS)}) GROUP BY ALL),
    class AS MATERIALIZED (SELECT g, comment_id, pos, first(comment_id) OVER same AS head, first(pos) OVER same AS head_pos,
              count(*) OVER (PARTITION BY g, words) AS copies
              FROM bag WINDOW same AS (PARTITION BY g, words ORDER BY comment_id, pos)),
    head AS (SELECT * FROM class WHERE comment_id = head AND pos = head_pos),
    hw AS MATERIALIZED (SELECT sw.* FROM sw JOIN head USING (g, comment_id, pos)),
    dots AS (SELECT a.g, a.comment_id AS a_key, a.pos AS a_pos, b.comment_id AS b_key, b.pos AS b_pos, round(sum(a.w * b.w), 9) AS cosine
             FROM hw a JOIN hw b ON a.g = b.g AND a.term = b.term AND (a.comment_id, a.pos) < (b.comment_id, b.pos)
             GROUP BY ALL HAVING round(sum(a.w * b.w), 9) >= 0.5),
    pairs AS MATERIALIZED (SELECT dots.*, x.copies AS a_copies, y.copies AS b_copies FROM dots
              JOIN head x ON x.g = dots.g AND x.comment_id = a_key AND x.pos = a_pos
              JOIN head y ON y.g = dots.g AND y.comment_id = b_key AND y.pos = b_pos)"""


@check(
    "j12_similar_pairs",
    f"""WITH {sentences_sql('c_talk', 'role')}, {sentence_weights_sql()}, {SIMILAR}
        SELECT g AS role, a_key, a_pos::INT AS a_pos, b_key, b_pos::INT AS b_pos, round(cosine, 8) AS cosine, a_copies, b_copies FROM pairs""",
)
def j12_pairs(spark, sf):
    sentences = summaries.comment_sentences(c_talk(spark, sf), ["role"], "comment_id", "text")
    pairs, _ = similarity.similar_pairs(sentences, ["role"], "comment_id", 0.5, STOPS)
    return pairs.withColumn("cosine", r("cosine", 8))


@check(
    "j12_similar_counts",
    f"""WITH {sentences_sql('c_text', 'movie')}, {sentence_weights_sql()}, {SIMILAR},
        near AS (SELECT g, a_key AS head, a_pos AS head_pos, b_copies AS n FROM pairs
                 UNION ALL SELECT g, b_key, b_pos, a_copies FROM pairs)
        SELECT g AS movie, comment_id, pos::INT AS pos, head AS class_key, head_pos::INT AS class_pos,
               copies - 1 + coalesce((SELECT sum(n) FROM near WHERE near.g = class.g AND near.head = class.head
                                      AND near.head_pos = class.head_pos), 0)::BIGINT AS links
        FROM class""",
)
def j12_counts(spark, sf):
    sentences = summaries.comment_sentences(c_text(spark, sf), ["movie"], "comment_id", "text")
    return similarity.similar_counts(sentences, ["movie"], "comment_id", 0.5, STOPS)


@check(
    "t14_textrank",
    f"""WITH {sentences_sql('c_talk', 'role')}, {sentence_weights_sql()}, {rank_sql(STEPS)}
        SELECT g AS role, comment_id, pos::INT AS pos, n, round(r, 9) AS rank FROM r{STEPS}""",
)
def t14(spark, sf):
    sentences = summaries.comment_sentences(c_talk(spark, sf), ["role"], "comment_id", "text")
    ranked = summaries.rank_sentences(sentences, ["role"], "comment_id", **OPTIONS)
    return ranked.select("role", "comment_id", "pos", "n", r("rank").alias("rank"))


def settled_sql(steps: int, every: int = 5, tolerance: float = 1e-6) -> str:
    """As ``rank_sql``, but groups that hardly move at a test keep their ranks from there on."""
    ctes = ["""
    r0 AS MATERIALIZED (SELECT g, comment_id, pos, n, d, 1 / n AS r, true AS moving, 0 AS steps
                        FROM sents JOIN sn USING (g) LEFT JOIN deg USING (g, comment_id, pos))"""]
    for k in range(steps):
        ctes.append(f"""
    s{k} AS (SELECT g, term, sum(w * r / d) AS s FROM sw JOIN r{k} USING (g, comment_id, pos) WHERE moving GROUP BY ALL),
    i{k} AS (SELECT g, comment_id, pos, sum(w * s) AS inflow FROM sw JOIN s{k} USING (g, term) GROUP BY ALL),
    l{k} AS (SELECT g, sum(r) AS loose FROM r{k} WHERE d IS NULL GROUP BY ALL),
    a{k} AS MATERIALIZED (SELECT r.* REPLACE (CASE WHEN moving THEN 0.15 / n + 0.85 * (coalesce(inflow, 0) + coalesce(loose, 0) / n) ELSE r END AS r,
                          CASE WHEN moving THEN steps + 1 ELSE steps END AS steps), r AS old
        FROM r{k} r LEFT JOIN i{k} i ON r.g = i.g AND r.comment_id = i.comment_id AND r.pos = i.pos LEFT JOIN l{k} l ON l.g = r.g)""")
        test = f"moving AND g IN (SELECT g FROM a{k} WHERE d IS NOT NULL GROUP BY g HAVING sum(abs(r - old)) >= max(n) * {tolerance})"
        ctes.append(f"r{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (old) REPLACE ({test if (k + 1) % every == 0 else 'moving'} AS moving) FROM a{k})")
    return ",\n".join(ctes)


@check(
    "t14_textrank_to_tolerance",
    f"""WITH {sentences_sql('c_talk', 'cluster')}, {sentence_weights_sql()}, {settled_sql(STEPS, tolerance=1e-7)}
        SELECT g AS cluster, comment_id, pos::INT AS pos, round(r, 9) AS rank, steps::INT AS steps FROM r{STEPS}""",
)
def t14_tolerance(spark, sf):
    sentences = summaries.comment_sentences(c_talk(spark, sf), ["cluster"], "comment_id", "text")
    ranked = summaries.rank_sentences(sentences, ["cluster"], "comment_id", STOPS, max_steps=STEPS, tolerance=1e-7)
    return ranked.select("cluster", "comment_id", "pos", r("rank").alias("rank"), "steps")


@check(
    "t15_ends_and_middle",
    f"""WITH {sentences_sql('c_text', 'movie')},
        o AS (SELECT g, sentence, row_number() OVER (PARTITION BY g ORDER BY comment_id, pos) - 1 AS i, count(*) OVER (PARTITION BY g) AS n
              FROM sents)
        SELECT g AS movie, sentence FROM o WHERE i IN (0, n // 2, n - 1)""",
)
def t15(spark, sf):
    sentences = summaries.comment_sentences(c_text(spark, sf), ["movie"], "comment_id", "text")
    return summaries.ends_and_middle(sentences, ["movie"], "comment_id").select("movie", "sentence")


@check("t16_summarise_comments", f"WITH {summary_sql('c_talk', 'role')} SELECT g AS role, count, summary FROM done")
def t16(spark, sf):
    return summaries.summarise_comments(c_talk(spark, sf), ["role"], "comment_id", "text", **OPTIONS)


@check(
    "t17_summarise_by_sentiment",
    f"""WITH {summary_sql('c_talk', 'sentiment')}
        SELECT g AS sentiment, count, summary, upper(g[1]) || g[2:] AS display_name FROM done""",
)
def t17(spark, sf):
    return summaries.summarise_by_sentiment(c_talk(spark, sf), "comment_id", "text", **OPTIONS)


@check(
    "t18_summarise_by_cluster",
    f"""WITH {SMALL}, {summary_sql('c_talk', 'cluster')},
        top AS (SELECT cluster, text, row_number() OVER (PARTITION BY cluster ORDER BY likes DESC, comment_id) AS rn FROM c_talk)
        SELECT g AS cluster, count, coalesce(description, 'Cluster ' || g) AS description, summary,
               (SELECT string_agg(text, '|' ORDER BY rn) FROM top t WHERE t.cluster = g AND rn <= 3) AS samples,
               (SELECT count(*) FROM c_talk t WHERE t.cluster = g AND sentiment = 'positive') AS positive_count
        FROM done LEFT JOIN d ON d.cluster = g""",
)
def t18(spark, sf):
    out = summaries.summarise_by_cluster(
        c_talk(spark, sf), small_descriptions(spark), "comment_id", "text", **OPTIONS
    )
    return out.select(
        "cluster", "count", "description", "summary", F.array_join("sample_comments", "|").alias("samples"),
        F.col("sentiment_stats")["positive"]["count"].alias("positive_count"),
    )


@check(
    "l07_representatives",
    """SELECT cluster, string_agg(comment_id::VARCHAR, ',' ORDER BY rn) AS ids FROM (
         SELECT cluster, comment_id, row_number() OVER (PARTITION BY cluster ORDER BY likes DESC, comment_id) AS rn FROM c_text)
       WHERE rn <= 3 GROUP BY 1""",
)
def l07(spark, sf):
    texts = c_text(spark, sf).select("cluster", "comment_id", "likes", F.col("comment_id").cast("string").alias("id"))
    picked = summaries.representatives(texts, "comment_id", "id")
    return picked.select("cluster", F.array_join("sample_comments", ",").alias("ids"))


# --- the whole analysis -----------------------------------------------------------------------------


@check(
    "m13_integrated_analysis",
    f"""WITH docs AS MATERIALIZED (SELECT * FROM c_clean), {tfidf_sql('docs', 'clean_text')}, {FEATURES}, {kmeans_sql('docs', 5)},
            s AS (SELECT movie, avg(polarity) AS a FROM c_text GROUP BY 1),
            paid AS (SELECT title, revenue::DOUBLE AS x, a FROM m_text LEFT JOIN s ON title = movie WHERE revenue > 0),
            b AS (SELECT avg(x) AS m, stddev_samp(x) AS sd, count(*) AS n FROM paid),
            usual AS (SELECT paid.* FROM paid, b WHERE abs((x - m) / sd) <= 2.5)
       SELECT (SELECT count(*) FROM c_text) || '_' || (SELECT count(*) FROM m_text) AS run_key,
              (SELECT n FROM b) AS total_box_office_movies, (SELECT count(*) FROM usual) AS normal_range_count,
              (SELECT count(*) FROM c_text) AS total_comments,
              round((SELECT corr(a, x) FROM usual), 9) AS r, round((SELECT corr(a, x) FROM paid), 9) AS r_all,
              (SELECT string_agg(n, ',' ORDER BY cluster) FROM (SELECT cluster, count(*) AS n FROM best GROUP BY 1)) AS cluster_sizes""",
)
def m13(spark, sf):
    comments = c_clean(spark, sf).select("comment_id", "movie", "clean_text", "polarity", "sentiment")
    out = integrated.analyse(comments, m_text(spark, sf), k=5, stops=STOPS)
    counts = out.clusters.comments.groupBy("cluster").agg(F.count("*").alias("n"))
    sizes = counts.agg(F.array_sort(F.collect_list(F.struct("cluster", "n"))).alias("sizes"))  # one entry per cluster
    found = out.outliers.select(
        F.lit(out.run_key).alias("run_key"), "total_box_office_movies", "normal_range_count",
        out.dashboard.select("total_comments").scalar().alias("total_comments"),
        r(out.normal_correlation.select("r").scalar()).alias("r"),
        r(out.all_correlation.select("r").scalar()).alias("r_all"),
        sizes.select(F.array_join(F.transform("sizes", lambda x: x["n"].cast("string")), ",")).scalar().alias("cluster_sizes"),
    )
    out.release()
    return found
