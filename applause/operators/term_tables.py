"""Lexicons and term lists as tables of any size: longest phrases among the words, terms anywhere in a text."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..session import cut_lineage

GRAM = 3  # letters of an index key
LEAST_STRIDE = 64  # letters between the starts of two pieces of a text
SMALL = 1 << 16  # entries of a lexicon that is rather broadcast than shuffled
FEW_SIZES = 4  # numbers of words that are spelt out at every place of a text


def normalised(entries: DataFrame, word: str = "word") -> DataFrame:
    """Entries spelt as their words with one blank between; numbers of repeated entries are averaged.

    One-letter words do not count, as in the texts; entries without any word are left out.
    """
    spelt = entries.withColumn(word, F.array_join(tx.words(F.col(word), 2), " ")).filter(F.col(word) != "")
    return spelt.groupBy(word).agg(*[F.avg(c).alias(c) for c in entries.columns if c != word])


def phrase_places(texts: DataFrame, key: str, text: str, entries: DataFrame, word: str = "word") -> DataFrame:
    """Every place of a text where an entry begins: ``key, i, n`` (first word, words), ``prev, prev2`` and the entry.

    Places are found by the first word of the entries, and only there the entries' lengths are spelt out, so a text
    costs one row per word before the join and one per possible entry behind it. Entries must be ``normalised``.
    A lexicon too large to be broadcast, of few lengths, is met by hash instead.
    """
    parts = F.split(word, " ")
    sizes = [x[0] for x in entries.select(F.size(parts)).distinct().limit(FEW_SIZES + 1).collect()]
    if 0 < len(sizes) <= FEW_SIZES and entries.count() > SMALL:
        return _places_by_hash(texts, key, text, entries, word, sizes)
    starts = entries.groupBy(F.get(parts, F.lit(0)).alias("first")).agg(F.collect_set(F.size(parts)).alias("sizes"))
    cut = texts.select(F.col(key), tx.words(F.col(text), 2).alias("tokens"), entries.agg(F.max(F.size(parts))).scalar().alias("most"))
    tokens = F.col("tokens")
    places = F.transform(
        tokens,
        lambda w, i: F.struct(
            i.alias("i"), w.alias("first"), F.slice(tokens, i + 1, F.col("most")).alias("ahead"),
            F.get(tokens, i - 1).alias("prev"), F.get(tokens, i - 2).alias("prev2"),
        ),
    )
    rows = cut.filter(F.col("most").isNotNull()).select(key, F.explode(places).alias("x")).select(key, "x.*")
    sized = rows.join(starts, "first").select(key, "i", "prev", "prev2", "ahead", F.explode("sizes").alias("n"))
    spelt = sized.filter(F.col("n") <= F.size("ahead")).withColumn(word, F.array_join(F.slice("ahead", F.lit(1), F.col("n")), " "))
    return spelt.drop("ahead").join(entries, word)


def _places_by_hash(texts: DataFrame, key: str, text: str, entries: DataFrame, word: str, sizes: list[int]) -> DataFrame:
    """The same places. What is shuffled for every place is its number and the hash of the words from there on.

    Texts are read again where an entry has the hash: there the words themselves are compared, so equal hashes of
    different words do no harm, and the words before the place are found.
    """
    cut = texts.select(F.col(key), tx.words(F.col(text), 2).alias("tokens"))
    tokens = F.col("tokens")

    def spelt(i: Column, n: Column) -> Column:
        return F.array_join(F.slice(tokens, i + 1, n), " ")

    def of(n: int) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.struct(i.alias("i"), F.xxhash64(spelt(i, F.lit(n))).alias("hash")))
        return F.when(F.size(tokens) >= n, hashes).otherwise(F.array().cast("array<struct<i:int,hash:bigint>>"))

    rows = cut.select(key, F.explode(F.concat(*[of(n) for n in sizes])).alias("x")).select(key, "x.*")
    met = rows.join(entries.withColumn("hash", F.xxhash64(word)), "hash").drop("hash")
    size = F.size(F.split(word, " "))
    found = met.join(cut, key).withColumn("n", size).filter(spelt(F.col("i"), F.col("n")) == F.col(word))
    before = {"prev": F.get(tokens, F.col("i") - 1), "prev2": F.get(tokens, F.col("i") - 2)}
    return found.withColumns(before).drop("tokens")


def sums_without_overlap(places: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Per text, the number of entries and the sums of ``values``: longest entry first, left to right, no word twice.

    The places of one text are one value, as its words are.
    """
    zero = F.struct(F.lit(0).alias("free"), F.lit(0).alias("hits"), *[F.lit(0.0).alias(v) for v in values])

    def step(acc: Column, x: Column) -> Column:
        taken = F.struct(
            (x["i"] + x["n"]).alias("free"), (acc["hits"] + 1).alias("hits"), *[(acc[v] + x[v]).alias(v) for v in values]
        )
        return F.when(x["i"] >= acc["free"], taken).otherwise(acc)

    row = F.struct("i", (-F.col("n")).alias("order"), "n", *values)
    listed = places.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("x"))
    return listed.select(key, F.aggregate("x", zero, step).alias("x")).select(key, "x.hits", *[f"x.{v}" for v in values])


def _grams(c: Column, sizes: list[int]) -> Column:
    """The distinct parts of ``c`` that have one of the lengths."""

    def of(n: int) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))
        return F.when(F.length(c) >= n, parts).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def texts_holding(texts: DataFrame, key: str, text: str, terms: DataFrame, label: str = "label", term: str = "term") -> DataFrame:
    """Distinct ``key, label`` of the texts that hold a term of the label as a substring.

    A term without a blank lies inside one word of a text (what blanks part), so terms are searched in the distinct words
    of all texts, and a text sends one row per word of its own. A term with blanks is looked for only in texts whose words
    hold that part of it which fewest texts hold, and is verified there. Null and empty terms count for nothing.
    """
    listed = cut_lineage(terms.select(F.col(label).alias("label"), F.col(term).alias("term")).filter(F.length("term") > 0).distinct())
    named = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    words = named.select("key", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).filter("word <> ''")
    vocabulary = cut_lineage(words.groupBy("word").agg(F.count("*").alias("held")))
    parts = listed.select("term", F.explode(F.split("term", " ")).alias("part")).filter("part <> ''").distinct()
    inside = cut_lineage(_words_holding(vocabulary.select("word"), parts.select("part").distinct()))

    single = inside.join(listed.withColumnRenamed("term", "part"), "part").select("word", "label").distinct()
    found = words.join(single, "word").select("key", "label")
    phrases = listed.filter(F.col("term").contains(" "))
    if not phrases.isEmpty():
        held = inside.join(vocabulary, "word").groupBy("part").agg(F.sum("held").alias("held"))
        rarest = parts.filter(F.col("term").contains(" ")).join(held, "part", "left").groupBy("term").agg(
            F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "part")).alias("x")
        )
        index = rarest.filter("x.held > 0").select("term", "x.part").join(inside, "part").select("term", "word")
        likely = words.join(index, "word").select("key", "term").distinct()
        met = named.alias("a").join(likely.alias("b"), F.col("a.key").eqNullSafe(F.col("b.key"))).select("a.key", "text", "term")
        blank = phrases.filter("trim(term) = ''").select("term").distinct()  # they have no part; one for each length at most
        met = met.unionByName(named.crossJoin(F.broadcast(blank)))
        proven = met.filter(F.col("text").contains(F.col("term"))).select("key", "term").distinct()
        found = found.unionByName(proven.join(phrases, "term").select("key", "label"))
    return found.select(F.col("key").alias(key), F.col("label").alias(label)).distinct()


def _words_holding(words: DataFrame, parts: DataFrame) -> DataFrame:
    """Distinct ``part, word``: the words that hold a part.

    Each part is indexed once, under the one of its three-letter parts that fewest pieces of the words hold (shorter
    parts under themselves); pieces meet only the parts of their own letters, and these are verified. A long word is cut
    into pieces that overlap by the longest part, so it is many short rows.
    """
    size = F.least(F.length("part"), F.lit(GRAM))
    longest, sizes = parts.agg(F.max(F.length("part")), F.collect_set(size)).first()
    stride = max(LEAST_STRIDE, longest or 0)
    most = stride + (longest or 1) - 1
    cuts = F.regexp_extract_all("word", F.lit(f"(?s)(?=(.{{1,{most}}})).{{1,{stride}}}"), F.lit(1))
    pieces = words.select("word", F.explode(F.when(F.length("word") > most, cuts).otherwise(F.array("word"))).alias("piece"))
    grams = cut_lineage(pieces.select("word", "piece", F.explode(_grams(F.col("piece"), sorted(sizes) or [GRAM])).alias("gram")))

    of_size = reduce(lambda rest, n: F.when(size == n, _grams(F.col("part"), [n])).otherwise(rest), range(1, GRAM), _grams(F.col("part"), [GRAM]))
    of_part = cut_lineage(parts.select("part", F.explode(of_size).alias("gram")))
    held = grams.groupBy("gram").agg(F.count("*").alias("held"))
    rarest = of_part.join(held, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("x"))
    index = cut_lineage(rarest.filter("x.held > 0").select("part", "x.gram"))
    hits = grams.join(index, "gram").filter(F.col("piece").contains(F.col("part")))
    return hits.select("part", "word").distinct()


def with_flags(df: DataFrame, key: str, text: str, lists: Mapping[str, DataFrame], prefix: str = "") -> DataFrame:
    """Adds a flag per list: whether the lower-cased text holds any of its terms (column ``term``, any case).

    Keys are unique; rows without a key or a text have no flag set.
    """
    tables = [t.select(F.lit(name).alias("label"), F.lower("term").alias("term")) for name, t in lists.items()]
    terms = reduce(DataFrame.unionByName, tables)
    lowered = df.select(key, F.lower(F.col(text)).alias("_t")).filter(F.col(key).isNotNull() & F.col("_t").isNotNull())
    held = texts_holding(lowered, key, "_t", terms)
    flags = held.groupBy(key).agg(*[F.bool_or(F.col("label") == name).alias(f"{prefix}{name}") for name in lists])
    names = [f"{prefix}{name}" for name in lists]
    return df.drop(*names).join(flags, key, "left").na.fill(False, names)
