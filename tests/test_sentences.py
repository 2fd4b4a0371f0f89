import random

import pytest

from applause.operators import sentences

SCHEMA = "id int, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    names = ["Jones", "Brown", "Smith", "Adams", "Miller", "Clark"]
    nouns = ["trailer", "music", "plot", "ending", "cast", "camera", "story", "scene", "voice"]
    rows = []
    for i in range(400):
        said = [f"The {rng.choice(nouns)} by Dr. {rng.choice(names)} was {rng.choice(nouns)} and {rng.choice(nouns)}."
                for _ in range(2)] + [f"We saw the {rng.choice(nouns)} vs. the {rng.choice(nouns)} of {rng.choice(names)}."]
        rng.shuffle(said)
        rows.append((i, " ".join(said)))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def tables(corpus):
    return sentences.learn(corpus, "text")


def split(spark, tables, text):
    found = sentences.split_sentences(spark.createDataFrame([(1, text)], SCHEMA), ["id"], "text", *tables)
    return [r["sentence"] for r in found.orderBy("pos").collect()]


def test_tables(tables):
    short, starters = ({r["word"] for r in t.collect()} for t in tables)
    assert short == {"dr", "vs"}
    assert {"the", "we"} <= starters and not starters & {"trailer", "jones", "and"}


@pytest.mark.parametrize("text, want", [
    ("It was Dr. Jones who came. We left!", ["It was Dr. Jones who came.", "We left!"]),
    ("Ask the Dr. The plot was thin.", ["Ask the Dr.", "The plot was thin."]),
    ("J. R. Adams wrote it. I liked it", ["J. R. Adams wrote it.", "I liked it"]),
    ("Well... maybe. Well... Maybe", ["Well... maybe.", "Well...", "Maybe"]),
    ('He said "no." Why? Because!', ['He said "no."', "Why?", "Because!"]),
    ("no marks at all", ["no marks at all"]),
    ("", []), ("   ", []), (None, []), (".", ["."]),
])
def test_split(spark, tables, text, want):
    assert split(spark, tables, text) == want


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert [t.count() for t in sentences.learn(empty, "text")] == [0, 0]
    only = spark.createDataFrame([(1, "no stop here"), (2, None)], SCHEMA)
    assert [t.count() for t in sentences.learn(only, "text")] == [0, 0]
    assert sentences.trained_sentences(empty, [], "id", "text").count() == 0


def test_rows_with_null_groups_keep_their_places(spark, tables):
    rows = spark.createDataFrame([(None, 1, "Dr. Jones came. We left."), ("a", 1, "Dr. Brown came.")], "g string, id int, text string")
    found = sentences.split_sentences(rows, ["g", "id"], "text", *tables)
    assert sorted((r["g"] or "", r["pos"], r["sentence"]) for r in found.collect()) == [
        ("", 0, "Dr. Jones came."), ("", 1, "We left."), ("a", 0, "Dr. Brown came.")]
