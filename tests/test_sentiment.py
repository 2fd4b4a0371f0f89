import random

import pytest
from pyspark.sql import functions as F

from applause.functions import lexicon, text
from applause.operators import sentiment

BLANK = {"has_positive_term": False, "has_context": False, "has_negative_indicator": False, "has_excitement": False}


def adjusted(spark, p, text="x", slang=False, neutral=False, **flags):
    marks = {k: F.lit(v) for k, v in (BLANK | flags).items()}
    df = spark.createDataFrame([(float(p), text)], "p double, t string")
    out = sentiment.adjusted_polarity(F.col("p"), F.col("t"), marks, F.lit(slang), F.lit(neutral))
    return df.select(out.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "expected, kwargs",
    [
        (0.5, dict(p=0.1, has_excitement=True)),
        (0.3, dict(p=0.3, has_excitement=True)),
        (0.7, dict(p=0.1, slang=True)),
        (0.1, dict(p=-0.5, neutral=True)),
        (-0.5, dict(p=-0.5, neutral=True, has_negative_indicator=True)),
        (0.3, dict(p=-0.1, has_positive_term=True, has_context=True)),
        (0.1, dict(p=-0.5, has_positive_term=True, has_context=True, has_negative_indicator=True)),
        (-0.3, dict(p=-0.8, has_positive_term=True)),
        (-0.4, dict(p=-0.1, has_negative_indicator=True)),
        (-0.2, dict(p=-0.2, has_negative_indicator=True)),
        (0.1, dict(p=-0.2, text='the "line"', has_context=True)),
        (0.6, dict(p=0.6, text='the "line"', has_context=True)),
        (0.1, dict(p=-0.2, text="the 'line'", has_context=True)),
        (0.2, dict(p=0.2, text="the 'line'", has_context=True)),
        (0.7, dict(p=-0.9, text="🔥🔥", has_negative_indicator=True)),
        (-0.9, dict(p=-0.9, text="🔥 🔥", has_negative_indicator=True)),
        (-0.4, dict(p=0.1, has_excitement=True, has_negative_indicator=True)),
        (0.7, dict(p=0.1, has_excitement=True, slang=True)),
    ],
)
def test_rules_and_overwrites(spark, expected, kwargs):
    assert adjusted(spark, **kwargs) == pytest.approx(expected)


@pytest.mark.parametrize(
    "text, polarity",
    [
        ("good", 0.6), ("very good", 0.78), ("not good", -0.3), ("not very good", -0.5 * 0.6 / 1.3),
        ("not a good", -0.3), ("good bad", 0.0), ("nothing here", 0.0), ("", 0.0), (None, 0.0), ("really awesome", 1.0),
    ],
)
def test_base_score(spark, text, polarity):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert sentiment.with_base_scores(df, "t").first()["polarity"] == pytest.approx(polarity)


def test_literal_and_table_lexicon_agree(spark):
    rng = random.Random(3)
    words = [*lexicon.OPINIONS, *lexicon.INTENSIFIERS, *lexicon.NEGATORS, "a", "film", "it"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, t string")
    opinions = spark.createDataFrame([(w, p, s) for w, (p, s) in lexicon.OPINIONS.items()],
                                     "word string, polarity double, subjectivity double")
    boosts = spark.createDataFrame(list(lexicon.INTENSIFIERS.items()), "word string, intensity double")
    a = {r.id: r for r in sentiment.with_base_scores(df, "t").collect()}
    b = {r.id: r for r in sentiment.base_scores_by_table(df, "id", "t", opinions, boosts, lexicon.NEGATORS).collect()}
    for i in a:
        assert a[i].polarity == pytest.approx(b[i].polarity)
        assert a[i].subjectivity == pytest.approx(b[i].subjectivity)


def test_term_search_equals_brute_force(spark):
    rng = random.Random(5)

    def word():
        return "".join(rng.choices("abc", k=rng.choice([1, 2, 3, 4, 5, 60])))

    rows = []
    for i in range(300):
        text = " ".join(word() for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.3:
            text += ' "' + rng.choice(["ab c ba", "a  b c", "cab ab\nc b a"]) + '"'
        elif rng.random() < 0.3:
            text = "zz" + rng.choice(["ab c ba", "a  b c", "cab ab\nc b a"]) + "zz " + text
        rows.append((i, rng.choice("mn"), text))
    df = spark.createDataFrame(rows, "id int, movie string, t string")
    terms = sentiment.frequent_terms(df, "t", min_count=3)
    known = {}
    for x in terms.collect():
        known.setdefault(x.movie, []).append(x.term)
    assert any(" " in t for ts in known.values() for t in ts)
    expected = {i for i, m, t in rows if any(term in t.lower() for term in known.get(m, []))}
    got = {x.id for x in sentiment.comments_with_terms(df, terms, "id", "t").collect()}
    assert got == expected
    assert 0 < len(expected) < len(rows)


def test_phrases_are_found_without_a_common_word(spark):
    rows = [(i, "m", f'"ab c ba" {i}x{i}') for i in range(3)] + [(9, "m", "zzab c bazz")]
    df = spark.createDataFrame(rows, "id int, movie string, t string")
    terms = sentiment.frequent_terms(df, "t")
    assert {x.term for x in terms.collect()} == {"ab c ba"}
    assert {x.id for x in sentiment.comments_with_terms(df, terms, "id", "t").collect()} == {0, 1, 2, 9}


def test_blank_comments_are_neutral(spark):
    df = spark.createDataFrame([(1, "m", None), (2, "m", "  "), (3, "m", "awful")], "comment_id int, movie string, clean_text string")
    got = {x.comment_id: x for x in sentiment.score_comments(df, movie="movie").collect()}
    assert (got[1].polarity, got[1].sentiment, got[2].polarity) == (0.0, "neutral", 0.0)
    assert got[3].sentiment == "negative"


def test_top_negative_needs_enough_marked(spark):
    rows = [(i, t, "negative", p) for i, (t, p) in enumerate([("trash", -0.2), ("meh", -0.9), ("so boring", -0.3)])]
    df = spark.createDataFrame(rows, "comment_id int, text string, sentiment string, polarity double")
    assert [x.text for x in sentiment.top_comments(df, "negative", 2).collect()] == ["so boring", "trash"]
    assert [x.text for x in sentiment.top_comments(df, "negative", 3).collect()] == ["meh", "so boring", "trash"]


def test_scoring_searches_texts_only_where_a_mark_can_matter(spark):
    """What is written for the term search holds two marks; no regular expression runs on texts without its literals."""
    assert text.literals_of("can'?t wait") == ["t wait"] and text.literals_of("(gonna|going to) (be|watch)") == ["gonna", "going to"]
    assert text.literals_of("go(es|ing)? hard") == [" hard"] and text.literals_of("(🔥|👍){2,}") == ["🔥", "👍"]
    assert all(text.literals_of(p) is None for p in ("a.b", "x*", "a|b", "(a|)", r"\bx", "ab+?", "(a(b))", "x{0,3}"))
    patterns = ["ab{2,}c", "(x|yy)+ z", "q{0,2}r?s", "t.?u"]
    rows = ["abbc", "abc", "x z", "yy  z", "yyx z", "s", "qs", "tu", "täu", "", None, "S"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    for chosen in ([p] for p in patterns):
        got = df.select(text.matches_any(F.col("t"), chosen).alias("x"), F.col("t").rlike(chosen[0]).alias("y")).collect()
        assert all(r.x is r.y for r in got)


def test_only_marks_for_the_term_search_are_searched_before_it(spark, monkeypatch):
    """Slang, excitement and the like are searched at the end, where the base score and the later rules leave them open."""
    written = []
    monkeypatch.setattr(sentiment, "cut_lineage", lambda df, cut=sentiment.cut_lineage: written.append(df.columns) or cut(df))
    df = spark.createDataFrame([(1, "m", "not good fire"), (2, "m", "so excited"), (3, "m", "a sad scene of evil"), (4, "m", "it is lit"), (5, "m", "hyped")], "comment_id int, movie string, clean_text string")
    got = {x.comment_id: x.polarity for x in sentiment.score_comments(df, movie="movie").collect()}
    assert got == pytest.approx({1: 0.2, 2: 0.78, 3: -0.25, 4: 0.7, 5: 0.5})
    assert {c for c in written[0] if c.startswith("_")} == {"_has_negative_indicator", "_refers"}


def test_blank_texts(spark):
    df = spark.createDataFrame([(t, b) for t, b in [(None, True), ("", True), (" \t\n\x0b\x1f\x85\u00a0\u3000", True), (" \u200b", False), ("\na", False)]], "t string, b boolean")
    assert df.filter(text.is_blank(F.col("t")) != F.col("b")).count() == 0
    squeezed = F.coalesce(text.squeeze(F.col("t")), F.lit("")) == ""
    assert df.filter(text.is_blank(F.col("t")) != squeezed).count() == 0
