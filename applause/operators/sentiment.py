"""Lexicon scoring with context rules, frequent terms and the strongest comments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon, text as tx, values
from ..session import cut_lineage
from . import tables, term_tables


def _literal_map(entries: Mapping[str, float]) -> Column:
    pairs: list[Column] = []
    for word, number in entries.items():
        pairs += [F.lit(word), F.lit(float(number))]
    return F.create_map(*pairs)


def _modified(polarity: Column, boost: Column, negated: Column) -> Column:
    """Polarity after an intensifier and a negator, kept within [-1, 1]."""
    factor = F.when(negated, 1 / boost).otherwise(boost)
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), polarity * factor))
    return F.when(negated, clipped * -0.5).otherwise(clipped)


def base_score(
    text: Column,
    opinions: Mapping[str, tuple[float, float]] = lexicon.OPINIONS,
    intensifiers: Mapping[str, float] = lexicon.INTENSIFIERS,
    negators: Sequence[str] = lexicon.NEGATORS,
) -> Column:
    """Mean polarity and subjectivity of the known words of a text, as a struct.

    A word after an intensifier is scaled; a negator in front of either multiplies by -0.5. One-letter
    words are skipped. The lexicon travels as literals, so nothing is shuffled or joined.
    """
    polarity = _literal_map({w: p for w, (p, _) in opinions.items()})
    subjectivity = _literal_map({w: s for w, (_, s) in opinions.items()})
    boosts = _literal_map(intensifiers)

    def scored(tokens: Column, word: Column, i: Column) -> Column:
        previous, earlier = F.get(tokens, i - 1), F.get(tokens, i - 2)
        boosted = F.coalesce(previous.isin(list(intensifiers)), F.lit(False))
        negated = F.coalesce(F.when(boosted, earlier).otherwise(previous).isin(list(negators)), F.lit(False))
        boost = F.when(boosted, F.try_element_at(boosts, previous)).otherwise(1.0)
        p = _modified(F.try_element_at(polarity, word), boost, negated)
        s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_element_at(subjectivity, word) * boost))
        return F.when(word.isin(list(opinions)), F.struct(p.alias("p"), s.alias("s")))

    def known(tokens: Column) -> Column:
        return F.filter(F.transform(tokens, lambda w, i: scored(tokens, w, i)), lambda h: h.isNotNull())

    def mean(hits: Column, field: str) -> Column:
        total = F.aggregate(hits, F.lit(0.0), lambda acc, h: acc + h[field])
        return F.when(F.size(hits) > 0, total / F.size(hits)).otherwise(0.0)

    def means(hits: Column) -> Column:
        return F.struct(mean(hits, "p").alias("polarity"), mean(hits, "s").alias("subjectivity"))

    return tx.bind(tx.words(F.coalesce(text, F.lit("")), 2), lambda tokens: tx.bind(known(tokens), means))


def with_base_scores(
    df: DataFrame, text: str, opinions: Mapping[str, tuple[float, float]] | DataFrame = lexicon.OPINIONS, key: str | None = None,
    intensifiers: Mapping[str, float] | DataFrame = lexicon.INTENSIFIERS, negators: Sequence[str] = lexicon.NEGATORS,
) -> DataFrame:
    """Adds the base polarity and subjectivity of a text column; lexicons given as tables need the ``key`` of a row."""
    if isinstance(opinions, DataFrame):
        return base_scores_by_table(df, key, text, opinions, intensifiers, negators)
    scored = df.withColumn("_score", base_score(F.col(text), opinions, intensifiers, negators))
    return scored.withColumns({c: F.col("_score")[c] for c in ("polarity", "subjectivity")}).drop("_score")


def base_scores_by_table(
    df: DataFrame, key: str, text: str, opinions: DataFrame, intensifiers: Mapping[str, float] | DataFrame, negators: Sequence[str]
) -> DataFrame:
    """The same scores from lexicon tables of any size: ``(word, polarity, subjectivity)`` and ``(word, intensity)``.

    An entry of ``opinions`` may have several words: the longest entry at a place counts, left to right, and none of
    its words counts again; the words before it are its intensifier and negator. Keys are unique; rows without a key,
    and texts without a known word, score 0.
    """
    if not isinstance(intensifiers, DataFrame):
        intensifiers = df.sparkSession.createDataFrame(list(intensifiers.items()), "word string, intensity double")
    entries = cut_lineage(term_tables.normalised(opinions.select("word", "polarity", "subjectivity")))  # its size is known, so a small one is broadcast
    places = term_tables.phrase_places(df.filter(F.col(key).isNotNull()), key, text, entries)
    boosts = intensifiers.groupBy(F.lower("word").alias("prev")).agg(F.avg("intensity").alias("_boost"))
    boost = F.coalesce("_boost", F.lit(1.0))
    before = F.when(F.col("_boost").isNotNull(), F.col("prev2")).otherwise(F.col("prev"))
    negated = F.coalesce(before.isin(list(negators)), F.lit(False))
    valued = places.join(boosts, "prev", "left").select(
        key, "i", "n", _modified(F.col("polarity"), boost, negated).alias("p"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("subjectivity") * boost)).alias("s"),
    )
    sums = term_tables.sums_without_overlap(valued, key, ["p", "s"])
    means = sums.select(key, (F.col("p") / F.col("hits")).alias("polarity"), (F.col("s") / F.col("hits")).alias("subjectivity"))
    return df.drop("polarity", "subjectivity").join(means, key, "left").na.fill(0.0, ["polarity", "subjectivity"])


FLAG_NAMES = {"positive": "has_positive_term", "context": "has_context", "negative": "has_negative_indicator"}


def domain_flags(
    lowered: Column,
    positive: Sequence[str] = lexicon.DOMAIN_POSITIVE,
    context: Sequence[str] = lexicon.CONTEXT,
    negative: Sequence[str] = lexicon.NEGATIVE,
    excitement: Sequence[str] = lexicon.EXCITEMENT,
) -> dict[str, Column]:
    """Four flags on lower-cased text."""
    return {
        "has_positive_term": tx.contains_any(lowered, positive),
        "has_context": tx.contains_any(lowered, context),
        "has_negative_indicator": tx.contains_any(lowered, negative),
        "has_excitement": tx.matches_any(lowered, excitement),
    }


def has_slang(
    lowered: Column, slang: Sequence[str] = lexicon.SLANG_WORDS, emoji: str = lexicon.SLANG_EMOJI
) -> Column:
    """A slang word on its own, or the emoji right after a word or at the start."""
    return tx.finds(lowered, f"{tx.whole_word(slang)}|(^|[{tx.WORD}]){emoji}", [*slang, emoji])


def refers_to_content(text: Column) -> Column:
    """Quote marks or a moment of the clip (``2:15``, ``3 min``)."""
    moment = rf"(\p{{Nd}}+:\p{{Nd}}+)|(\p{{Nd}}+[{tx.SPACE}]*min)"
    return text.contains('"') | text.contains("'") | text.rlike(moment)


def adjusted_polarity(p: Column, text: Column, flags: Mapping[str, Column], slang: Column, neutral: Column) -> Column:
    """The eight context rules on the base polarity ``p``.

    No rule reads another rule's result, so the last rule that applies decides: the chain tests the
    rules from last to first. Within a rule the number is tested first, so text is searched only where it can matter.
    """
    positive, context = flags["has_positive_term"], flags["has_context"]
    negative, excited = flags["has_negative_indicator"], flags["has_excitement"]
    quoted = text.contains('"') | ((p < 0) & text.contains("'"))
    rules = [
        ((p < 0.3) & excited, F.lit(0.5)),
        ((p < 0.3) & slang, F.lit(0.7)),
        ((p < 0) & neutral & ~negative, F.lit(0.1)),
        ((p < 0) & positive & context, F.lit(0.1)),
        ((p < 0) & positive & ~negative, F.least(p + 0.5, F.lit(0.3))),
        ((p > -0.2) & negative, F.lit(-0.4)),
        (quoted & context, F.greatest(F.lit(0.1), p)),
        ((p < 0.3) & tx.finds(text, lexicon.CHEERING_EMOJI, [lexicon.CHEERING_EMOJI]), F.lit(0.7)),
    ]
    result = p
    for condition, value in rules:
        result = F.when(condition, value).otherwise(result)
    return result


def quoted_phrases(text: Column, least: int = 3, most: int = 5) -> Column:
    """Lower-cased double-quoted phrases of three to five words."""
    quotes = F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))
    short = F.filter(quotes, lambda q: tx.word_count(q).between(least, most))
    lowered = F.transform(short, lambda q: F.lower(q))
    return F.when(~text.contains('"'), F.array().cast("array<string>")).otherwise(lowered)


def frequent_terms(
    comments: DataFrame, text: str = "text", by: str = "movie", min_count: int = 3, stops: Sequence[str] = ()
) -> DataFrame:
    """Words and short quoted phrases used at least ``min_count`` times within a movie, longer than two letters.

    Counts are summed within each task first, so a hot movie or word sends one row per task.
    """
    content = F.col(text)
    terms = F.concat(tx.words(content, 3), quoted_phrases(content))
    counted = (
        comments.filter(F.col(by).isNotNull() & content.isNotNull())
        .select(by, F.explode(terms).alias("term"))
        .filter(F.length("term") > 2)
        .groupBy(by, "term")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_count)
    )
    return counted.filter(~F.col("term").isin(list(stops))) if stops else counted


def _parts(word: Column, lengths: Column) -> Column:
    """All distinct parts of a word that have one of the lengths."""
    fitting = F.filter(lengths, lambda n: n <= F.length(word))
    parts = F.transform(
        fitting, lambda n: F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, n))
    )
    return F.array_distinct(F.flatten(parts))


def comments_with_terms(
    comments: DataFrame, terms: DataFrame, key: str, text: str = "text", by: str = "movie"
) -> DataFrame:
    """Keys of comments that hold any frequent term of their movie as a substring.

    Most comments use a frequent term as a word of their own; only the others are searched further. A
    one-word term lies inside one word of the text, so each distinct word of a movie is tested once: its
    parts, of the lengths that the movie's terms have, are compared with the terms by equality.
    """
    lowered = comments.select(key, by, F.lower(F.col(text)).alias("_t")).filter(F.col("_t").isNotNull())
    single = terms.filter(~F.col("term").rlike(f"[{tx.SPACE}]")).select(by, "term")
    phrases = terms.filter(F.col("term").rlike(f"[{tx.SPACE}]")).select(by, "term")

    used = _distinct_words(lowered, key, by).join(single.withColumnRenamed("term", "word"), [by, "word"], "left_semi")
    direct = used.select(key).distinct()
    rest = cut_lineage(lowered.join(direct, key, "left_anti"))

    own = _distinct_words(rest, key, by)
    lengths = single.groupBy(by).agg(F.collect_set(F.length("term")).alias("_lengths"))  # a few dozen at most
    vocabulary = own.select(by, "word").distinct().join(lengths, by)
    by_parts = vocabulary.select(by, "word", F.explode(_parts(F.col("word"), F.col("_lengths"))).alias("term"))
    word_hits = by_parts.join(single, [by, "term"], "left_semi").select(by, "word").distinct()
    by_word = own.join(word_hits, [by, "word"], "left_semi").select(key)
    return direct.unionByName(by_word).unionByName(_comments_with_phrases(rest, phrases, key, by)).distinct()


def _comments_with_phrases(rest: DataFrame, phrases: DataFrame, key: str, by: str) -> DataFrame:
    """Keys of texts ``_t`` that hold a phrase of their movie.

    A phrase in a text ends the word before its inner words and begins the word after them. Places with the inner
    words of a phrase are found by equality; only there the ends of the word before and the beginnings of the word
    after are spelt out and compared, so a text meets a phrase only where it holds it, up to the kind of white space.
    """
    words = F.split("_t", f"[{tx.SPACE}]")
    cut = phrases.select(by, "term", F.split("term", f"[{tx.SPACE}]").alias("_p"))
    keyed = cut.select(
        by, "term", (F.size("_p") - 2).alias("_n"), F.element_at("_p", 1).alias("_first"), F.element_at("_p", -1).alias("_last"),
        F.array_join(F.slice("_p", F.lit(2), F.size("_p") - 2), " ").alias("_inner"),
    )
    sizes = keyed.groupBy(by).agg(
        F.collect_set("_n").alias("_sizes"),  # a few at most, as phrases are short
        F.max(F.length("_first")).alias("_most_before"), F.max(F.length("_last")).alias("_most_after"),
    )
    split = rest.join(sizes, by).select(
        key, by, words.alias("_w"), F.explode("_sizes").alias("_n"), "_most_before", "_most_after"
    ).filter(F.size("_w") >= F.col("_n") + 2)
    places = F.transform(
        F.sequence(F.lit(2), F.size("_w") - F.col("_n")),
        lambda i: F.struct(
            F.array_join(F.slice("_w", i, F.col("_n")), " ").alias("_inner"),
            F.element_at("_w", i - 1).alias("_before"), F.element_at("_w", i + F.col("_n")).alias("_after"),
        ),
    )
    around = split.select(key, by, "_n", "_most_before", "_most_after", F.explode(places).alias("_x"))
    around = around.select(key, by, "_n", "_most_before", "_most_after", "_x.*")
    near = around.join(keyed.select(by, "_n", "_inner").distinct(), [by, "_n", "_inner"], "left_semi")
    ends = F.transform(
        F.sequence(F.lit(0), F.least(F.length("_before"), F.col("_most_before"))),
        lambda n: F.substring("_before", F.length("_before") - n + 1, n),
    )
    near = near.select(key, by, "_n", "_inner", F.explode(ends).alias("_first"), "_after", "_most_after")
    near = near.join(keyed.select(by, "_n", "_inner", "_first").distinct(), [by, "_n", "_inner", "_first"], "left_semi")
    starts = F.transform(
        F.sequence(F.lit(0), F.least(F.length("_after"), F.col("_most_after"))), lambda n: F.substring("_after", F.lit(1), n)
    )
    near = near.select(key, by, "_n", "_inner", "_first", F.explode(starts).alias("_last")).distinct()
    pairs = near.join(keyed, [by, "_n", "_inner", "_first", "_last"]).select(key, "term")
    return pairs.join(rest.select(key, "_t"), key).filter(F.col("_t").contains(F.col("term"))).select(key)


def _distinct_words(lowered: DataFrame, key: str, by: str) -> DataFrame:
    """The distinct words of three or more letters of each text."""
    return lowered.select(key, by, F.explode(F.array_distinct(tx.words(F.col("_t"), 3))).alias("word"))


def score_comments(
    comments: DataFrame,
    key: str = "comment_id",
    text: str = "clean_text",
    movie: str | None = None,
    opinions: Mapping[str, tuple[float, float]] | DataFrame = lexicon.OPINIONS,
    min_count: int = 3,
    stops: Sequence[str] = (),
    flags: Mapping[str, Sequence[str] | DataFrame] | None = None,
    intensifiers: Mapping[str, float] | DataFrame = lexicon.INTENSIFIERS,
    negators: Sequence[str] = lexicon.NEGATORS,
) -> DataFrame:
    """Adds polarity, subjectivity and sentiment; blank text is neutral.

    The lexicon may be a table (see ``base_scores_by_table``), and so may the term lists in ``flags`` (``positive``,
    ``context``, ``negative``; column ``term``); ``excitement`` holds patterns and stays a list.

    With ``movie`` the frequent terms of each movie count as references to its content. They can only
    matter for a negative base score without other marks, so only those comments are searched and joined; all others
    pass through. The scored comments are written once, since the term counts, the search and the result read them.

    Before that only the marks are searched that tell which comments to search; the others follow at the end, each only
    where the base score and the later rules leave it open.
    """
    c = F.col(text)
    lowered = F.lower(F.coalesce(c, F.lit("")))
    listed = {name: terms for name, terms in (flags or {}).items() if not isinstance(terms, DataFrame)}
    by_table = {FLAG_NAMES[name]: terms for name, terms in (flags or {}).items() if name not in listed}
    marks = domain_flags(F.col("_lower"), **listed)
    scored = with_base_scores(comments, text, opinions, key, intensifiers, negators)
    if by_table:
        scored = term_tables.with_flags(scored, key, text, by_table, "_")
    early = {"_refers": F.coalesce(refers_to_content(c), F.lit(False))}
    if "has_negative_indicator" not in by_table:
        early["_has_negative_indicator"] = marks["has_negative_indicator"]
    scored = scored.withColumn("_lower", lowered).withColumns(early).drop("_lower")
    named = {name: F.col(f"_{name}") for name in marks}
    refers = F.col("_refers")
    if movie is not None:
        scored = cut_lineage(scored)  # read four times below, and far cheaper to read than to score
        terms = cut_lineage(frequent_terms(scored, text, movie, min_count, stops))
        undecided = F.coalesce((F.col("polarity") < 0) & ~named["has_negative_indicator"] & ~refers, F.lit(False))
        open_cases = scored.filter(undecided)
        hits = comments_with_terms(open_cases, terms, key, text, movie).withColumn("_term", F.lit(True))
        closed = scored.filter(~undecided).withColumn("_term", F.lit(None).cast("boolean"))
        scored = closed.unionByName(open_cases.join(hits, key, "left"))
        refers = refers | F.coalesce("_term", F.lit(False))
    neutral = refers & ~named["has_negative_indicator"]
    below = F.col("polarity") < 0
    late = {
        "_has_positive_term": F.when(below, marks["has_positive_term"]),
        "_has_context": F.when(below | c.contains('"'), marks["has_context"]),
    }
    scored = scored.withColumn("_lower", lowered).withColumns({name: mark for name, mark in late.items() if name[1:] not in by_table})
    named["has_excitement"] = marks["has_excitement"]
    adjusted = adjusted_polarity(F.col("polarity"), c, named, has_slang(F.col("_lower")), neutral)
    done = scored.withColumns(
        {
            "polarity": F.when(tx.is_blank(c), 0.0).otherwise(adjusted),
            "subjectivity": F.when(tx.is_blank(c), 0.0).otherwise(F.col("subjectivity")),
        }
    )
    kept = [x for x in comments.columns if x not in ("polarity", "subjectivity", "sentiment")]
    return done.select(*kept, "polarity", "subjectivity", values.category(F.col("polarity")).alias("sentiment"))


def ensure_scored(comments: DataFrame, key: str = "comment_id", movie: str | None = "movie", **scoring) -> DataFrame:
    """Add the clean text and the sentiment only where the columns are absent; ``scoring`` goes to ``score_comments``."""
    if "clean_text" not in comments.columns:
        comments = comments.withColumn("clean_text", tx.clean_for_sentiment(F.col("text")))
    if "sentiment" not in comments.columns:
        comments = score_comments(comments, key, "clean_text", movie, **scoring).drop("subjectivity")
    return comments


def top_comments(
    comments: DataFrame,
    sentiment: str,
    n: int = 5,
    text: str = "text",
    key: str = "comment_id",
    indicators: Sequence[str] = lexicon.NEGATIVE,
) -> DataFrame:
    """The ``n`` strongest comments of one category.

    Negative comments are narrowed to those with a negative indicator if there are at least ``n`` of them.
    """
    chosen = comments.filter(F.col("sentiment") == sentiment)
    if sentiment == values.NEGATIVE:
        marked = tx.contains_any(F.lower(F.col(text)), indicators)
        enough = chosen.agg(F.count_if(marked) >= n).scalar()
        chosen = chosen.filter(~enough | marked)
    order = [F.asc(key)]
    if "polarity" in comments.columns:
        strongest = F.asc_nulls_last if sentiment == values.NEGATIVE else F.desc_nulls_last
        order = [strongest("polarity"), *order]
    columns = [key, text, "sentiment"] + (["polarity"] if "polarity" in comments.columns else [])
    return tables.top_k(chosen.select(*columns), order, n)
