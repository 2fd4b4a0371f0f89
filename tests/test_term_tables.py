import random

import pytest
from pyspark.sql import functions as F

from applause.functions import lexicon
from applause.operators import sentiment, term_tables

OPINION = "word string, polarity double, subjectivity double"


def scores(spark, rows, entries, negators=("not",)):
    df = spark.createDataFrame(rows, "id int, t string")
    boosts = spark.createDataFrame([("very", 1.5)], "word string, intensity double")
    out = sentiment.base_scores_by_table(df, "id", "t", spark.createDataFrame(entries, OPINION), boosts, negators)
    return {x.id: (x.polarity, x.subjectivity) for x in out.collect()}


def test_longest_entry_left_to_right(spark):
    entries = [("good", 0.4, 0.2), ("not bad", 0.2, 0.4), ("bad", -0.6, 0.6), ("bad good film", 0.1, 0.5), ("Good  a film!", 0.3, 0.1)]
    got = scores(
        spark,
        [(1, "not bad"), (2, "bad good film"), (3, "not bad good film"), (4, "very good"), (5, "not good"), (6, "good film"),
         (7, None), (8, ""), (9, "nothing"), (10, "bad bad good film bad")],
        entries,
    )
    assert got[1] == pytest.approx((0.2, 0.4))
    assert got[2] == pytest.approx((0.1, 0.5))
    assert got[3] == pytest.approx(((0.2 + 0.3) / 2, (0.4 + 0.1) / 2))  # "not bad" comes first, then "good film"
    assert got[4] == pytest.approx((0.6, 0.3))
    assert got[5] == pytest.approx((-0.2, 0.2))
    assert got[6] == pytest.approx((0.3, 0.1))
    assert got[7] == got[8] == got[9] == (0.0, 0.0)
    assert got[10] == pytest.approx(((-0.6 + 0.1 - 0.6) / 3, (0.6 + 0.5 + 0.6) / 3))


def test_empty_lexicon_and_repeated_entries(spark):
    assert scores(spark, [(1, "good")], []) == {1: (0.0, 0.0)}
    assert scores(spark, [(1, "good")], [("good", 0.2, 0.0), ("GOOD", 0.4, 1.0), (None, 1.0, 1.0), ("!", 1.0, 1.0)])[1] == pytest.approx((0.3, 0.5))
    assert scores(spark, [], [("good", 0.2, 0.0)]) == {}


def test_phrases_equal_brute_force(spark):
    rng = random.Random(11)
    words = ["aa", "bb", "cc", "dd", "ee", "very", "not"]
    entries = {" ".join(rng.choices(words[:5], k=rng.randint(1, 4))): rng.randint(-9, 9) / 10 for _ in range(60)}
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(150)]

    def plain(text):
        tokens, i, hits = text.split(), 0, []
        while i < len(tokens):
            n = next((n for n in (4, 3, 2, 1) if i + n <= len(tokens) and " ".join(tokens[i:i + n]) in entries), 0)
            if n:
                prev = tokens[i - 1] if i else None
                boosted = prev == "very"
                before = (tokens[i - 2] if i > 1 else None) if boosted else prev
                f, negated = 1.5 if boosted else 1.0, before == "not"
                p = max(-1, min(1, entries[" ".join(tokens[i:i + n])] * (1 / f if negated else f)))
                hits.append(p * -0.5 if negated else p)
            i += n or 1
        return sum(hits) / len(hits) if hits else 0.0

    got = scores(spark, rows, [(w, p, 0.5) for w, p in entries.items()])
    for i, text in rows:
        assert got[i][0] == pytest.approx(plain(text)), text


def test_terms_equal_brute_force(spark):
    rng = random.Random(4)

    def some(least, most):
        return "".join(rng.choices("abcé🔥 \n", k=rng.randint(least, most)))

    rows = [(i, some(0, 60)) for i in range(200)] + [(500, some(5000, 5000)), (501, None), (502, ""), (503, "ab" * 300 + "zzz")]
    terms = [(rng.choice("xyz"), some(0, 9)) for _ in range(150)] + [("y", None), ("x", "zzz"), ("x", "abz"), ("z", "a" * 200), ("z", "ba" * 120)]
    got = term_tables.texts_holding(
        spark.createDataFrame(rows, "id int, t string"), "id", "t", spark.createDataFrame(terms, "label string, term string")
    )
    want = {(i, label) for i, t in rows if t for label, term in terms if term and term in t}
    found = [tuple(x) for x in got.collect()]
    assert set(found) == want and len(found) == len(want)
    assert (503, "z") in want and len(want) < 3 * len(rows)


def test_no_terms_and_no_texts(spark):
    none = spark.createDataFrame([], "label string, term string")
    texts = spark.createDataFrame([(1, "abc")], "id int, t string")
    assert term_tables.texts_holding(texts, "id", "t", none).count() == 0
    some = spark.createDataFrame([("x", "abc")], "label string, term string")
    assert term_tables.texts_holding(texts.limit(0), "id", "t", some).count() == 0


def test_scores_by_tables_equal_literals_with_100_000_entries(spark):
    rng = random.Random(9)
    words = [*lexicon.OPINIONS, *lexicon.INTENSIFIERS, *lexicon.NEGATORS, *lexicon.NEGATIVE, *lexicon.CONTEXT, *lexicon.DOMAIN_POSITIVE, "film"]
    rows = [(i, "m", " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(120)] + [(900, "m", None)]
    df = spark.createDataFrame(rows, "comment_id int, movie string, clean_text string")
    small = spark.createDataFrame([(w, p, s) for w, (p, s) in lexicon.OPINIONS.items()], OPINION)
    strange = spark.range(100_000).select(F.concat(F.lit("qz"), "id", F.lit(" qx")).alias("word"), F.lit(1.0).alias("polarity"), F.lit(1.0).alias("subjectivity"))
    lists = {"positive": lexicon.DOMAIN_POSITIVE, "context": lexicon.CONTEXT, "negative": lexicon.NEGATIVE}
    rare = spark.range(50_000).select(F.concat(F.lit("qz"), "id").alias("term"))
    flags = {name: spark.createDataFrame([(t,) for t in terms], "term string").unionByName(rare) for name, terms in lists.items()}
    a = {x.comment_id: x for x in sentiment.score_comments(df, movie="movie").collect()}
    b = sentiment.score_comments(df, movie="movie", opinions=small.unionByName(strange), flags=flags)
    assert b.columns == ["comment_id", "movie", "clean_text", "polarity", "subjectivity", "sentiment"]
    b = {x.comment_id: x for x in b.collect()}
    assert a.keys() == b.keys()
    for i in a:
        assert (a[i].polarity, a[i].subjectivity) == pytest.approx((b[i].polarity, b[i].subjectivity))
        assert a[i].sentiment == b[i].sentiment


def test_terms_are_searched_in_distinct_words(spark, monkeypatch):
    searched = []
    plain = term_tables._words_holding
    monkeypatch.setattr(term_tables, "_words_holding", lambda words, parts: searched.append(words.count()) or plain(words, parts))
    long = "x" * 300 + "needle" + "y" * 300
    rows = [(i, "the cash grab  trailer " * 50) for i in range(40)] + [
        (40, long), (41, "a grab cash"), (41, "needles"), (None, "smash grabbed"), (None, "nothing"), (42, None), (43, ""), (44, "  "),
    ]
    terms = [("L", "needle"), ("P", "ash grab"), ("P", "sh grabbed"), ("S", "  "), ("B", " "), ("N", "grab  "), ("N", "cash trailer"), ("E", ""), ("E", None)]
    texts = spark.createDataFrame(rows, "id int, t string")
    got = term_tables.texts_holding(texts, "id", "t", spark.createDataFrame(terms, "label string, term string"))
    want = {(i, name) for i, t in rows for name, x in terms if t and x and x in t}
    assert {tuple(x) for x in got.collect()} == want
    assert searched == [10]  # each distinct word once, however often texts use it


def flat(found):
    return {(i, n): x for i, pair in found.items() for n, x in enumerate(pair)}


def test_large_lexicon_is_met_by_hash(spark, monkeypatch):
    """The same scores, repeated keys included; no row of a place carries the words around it through a shuffle."""
    rng = random.Random(12)
    words = ["aa", "bb", "cc", "dd", "very", "not", "a"]
    entries = [(" ".join(rng.choices(words[:4], k=rng.randint(1, 3))), rng.randint(-9, 9) / 10, rng.random()) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "aa"), (None, "aa bb"), (3, rows[3][1]), (4, rows[5][1])]
    plain = scores(spark, rows, entries)
    monkeypatch.setattr(term_tables, "SMALL", 0, raising=False)
    assert flat(scores(spark, rows, entries)) == pytest.approx(flat(plain))
    df = spark.createDataFrame(rows, "id int, t string")
    known = term_tables.normalised(spark.createDataFrame(entries, OPINION))
    places = term_tables.phrase_places(df, "id", "t", known)
    assert "ahead" not in places._jdf.queryExecution().toString()
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))  # all hashes are equal
    some = scores(spark, rows[6:30], entries)
    assert flat(some) == pytest.approx(flat({i: plain[i] for i in some}))
