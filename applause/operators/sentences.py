"""Sentences told apart by what the corpus itself says about full stops.

Two aggregates over all tokens give, for every word type, how often it stands before a full stop and how often it follows
the end of a sentence. Log-likelihood ratios turn the counts into two tables: abbreviations, which nearly always carry a
full stop and are short, and sentence starters, which follow ends far more often than their frequency explains. A full
stop after an abbreviation ends a sentence only before a starter; initials never do, dots in a row only before a capital.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..session import cut_lineage

ABBREVIATION, STARTER = 0.3, 30.0  # least scores
KEEPS_STOP = 0.99  # an abbreviation's chance of a full stop
TOKEN = r"([^ \t\n\f\r]+)"
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
CLOSE = r"[\"')\]}»”’]*$"


def core(token: Column) -> Column:
    """The lower-case word inside a token."""
    return F.regexp_replace(F.lower(token), EDGES, "")


def has_stop(token: Column) -> Column:
    return token.rlike(r"\p{L}\." + CLOSE)


def ends(token: Column) -> Column:
    """The token closes with an end mark."""
    return token.rlike(r"[.!?]" + CLOSE)


def token_pairs(comments: DataFrame, text: str, *keep: str) -> DataFrame:
    """Rows ``(keep, i, token, next)``: the tokens of each text with the one that follows; null texts have none."""
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN))
    split = comments.select(*keep, tokens.alias("_t"))
    pairs = F.transform("_t", lambda t, i: F.struct(t.alias("token"), F.get(F.col("_t"), i + 1).alias("next")))
    return split.select(*keep, F.posexplode(pairs).alias("i", "_p")).select(*keep, "i", "_p.*")


def likelihood(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of ``k`` hits in ``n`` trials of chance ``p``."""
    return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)


def learn(comments: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """``(word, score)`` of abbreviations and of sentence starters in a corpus.

    Words of letters and inner stops alone can be abbreviations. A corpus without full stops teaches nothing, and the tables
    are empty.
    """
    words = cut_lineage(token_pairs(comments, text).select("token", "next").groupBy("token", "next").agg(F.count("*").alias("n")))
    typed = words.select(core(F.col("token")).alias("word"), has_stop(F.col("token")).alias("stop"), "n")
    totals = typed.agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("stop"), F.col("n"))).cast("double").alias("stops"))
    counts = typed.filter(F.col("word").rlike(r"^\p{L}[\p{L}.]*$")).groupBy("word").agg(
        F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).cast("double").alias("k")
    )
    chance = F.col("_t.stops") / F.col("_t.n")
    ratio = -2 * (likelihood(F.col("k"), F.col("n"), chance) - likelihood(F.col("k"), F.col("n"), F.lit(KEEPS_STOP)))
    inner = F.length(F.regexp_replace("word", r"[^.]", ""))
    letters = F.length("word") - inner
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -(F.col("n") - F.col("k")))
    scored = counts.withColumn("_t", totals.select(F.struct("n", "stops")).scalar()).filter("k > 0 and _t.stops < _t.n")
    short = cut_lineage(scored.select("word", F.round(score, 9).alias("score")).filter(F.col("score") >= ABBREVIATION))

    # what follows an end that no abbreviation explains
    after = words.filter("next is not null").select(
        core(F.col("token")).alias("before"), (ends(F.col("token")) & ~F.col("token").rlike(r"\.\.")).alias("end"),
        core(F.col("next")).alias("word"), "n",
    ).join(short.select(F.col("word").alias("before"), F.lit(True).alias("short")), "before", "left")
    met = after.select("word", "n", F.when(F.col("end") & F.col("short").isNull(), F.col("n")).otherwise(0).alias("k"))
    sums = met.agg(F.sum("n").cast("double").alias("n"), F.sum("k").cast("double").alias("ends"))
    per_word = met.filter("word <> ''").groupBy("word").agg(F.sum("n").cast("double").alias("n"), F.sum("k").cast("double").alias("k"))
    n, k, total, stops = F.col("n"), F.col("k"), F.col("_s.n"), F.col("_s.ends")
    apart = likelihood(k, stops, k / stops) + likelihood(n - k, total - stops, (n - k) / (total - stops))
    together = likelihood(k, stops, n / total) + likelihood(n - k, total - stops, n / total)
    known = per_word.withColumn("_s", sums.select(F.struct("n", "ends")).scalar()).filter("k > 0 and _s.ends < _s.n and k / _s.ends > n / _s.n")
    starters = known.select("word", F.round(2 * (apart - together), 6).alias("score")).filter(F.col("score") >= STARTER)
    return short, cut_lineage(starters)


def split_sentences(comments: DataFrame, key: Sequence[str], text: str, abbreviations: DataFrame, starters: DataFrame) -> DataFrame:
    """Rows ``(key, pos, sentence)`` by the learned tables, of any size; ``key`` must tell the rows of ``comments`` apart.

    The tokens before a full stop in question are joined with the tables; texts stay where they are and get back the few
    places that do not end a sentence. Tokens of a sentence are joined by one space. Texts without a token have no rows.
    """
    pairs = token_pairs(comments, text, *key).filter(F.col("next").isNotNull() & F.col("token").rlike(r"\." + CLOSE))
    asked = pairs.select(*key, "i", "token", "next", core(F.col("token")).alias("_word"), core(F.col("next")).alias("_next"))
    first = F.regexp_replace("next", r"^[^\p{L}\p{N}]+", "")
    capital = first.rlike(r"^\p{Lu}")
    initial = F.col("token").rlike(r"^[^\p{L}\p{N}]*\p{Lu}\." + CLOSE) & capital
    dots = F.col("token").rlike(r"\.\." + "[.]*" + CLOSE)
    known = asked.join(abbreviations.select(F.col("word").alias("_word"), F.lit(True).alias("_short")), "_word", "left").join(
        starters.select(F.col("word").alias("_next"), F.lit(True).alias("_starts")), "_next", "left"
    )
    inside = F.when(dots, ~capital).when(initial, True).otherwise(F.col("_short").isNotNull() & F.col("_starts").isNull())
    open_places = known.filter(inside).groupBy(*key).agg(F.collect_list("i").alias("_open"))  # places in one text
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN))
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"o.{c}"))
    joined = comments.select(*key, tokens.alias("_t")).alias("x").join(open_places.alias("o"), same, "left").select(*[f"x.{c}" for c in key], "_t", "_open")
    marked = F.transform("_t", lambda t, i: F.when(
        ends(t) & ~F.coalesce(F.array_contains("_open", i), F.lit(False)), F.concat(t, F.lit("\n"))
    ).otherwise(F.concat(t, F.lit(" "))))
    parts = F.split(F.regexp_replace(F.array_join(marked, ""), r"[ \n]$", ""), "\n")
    return joined.filter(F.size("_t") > 0).select(*key, F.posexplode(parts).alias("pos", "sentence"))


def trained_sentences(comments: DataFrame, group: Sequence[str], key: str, text: str, min_length: int = 20) -> DataFrame:
    """``summaries.comment_sentences`` with sentences split by tables that are learned from the same comments."""
    enough = comments.filter(tx.long_enough(F.col(text), min_length))
    found = split_sentences(enough, [*group, key], text, *learn(enough, text))
    return found.filter(tx.is_sentence(F.col("sentence")))
