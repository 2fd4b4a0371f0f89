"""Registered queries of the subpackage, each over its whole table, and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from applause.session import scratch_path

from . import (
    bpe, decontaminate, exact_dedup, language_id, lm_score, periodic_runs, prefix_trie, quality, shards, simhash, substrings,
    token_counts, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The tables have neither fetch times nor lists. A page's time comes from its id; the lists are drawn from the hosts
# and paths of the pages themselves, with dates from the pattern's checksum.
def drawn(pattern: str = "pattern") -> F.Column:
    return F.conv(F.substring(F.md5(F.col(pattern)), 1, 4), 16, 10).cast("int")


def entries(found: DataFrame, one_in: int) -> DataFrame:
    """Dated entries for one in so many patterns: added, for some removed later, for some of those added again."""
    h = F.col("h")
    day = F.expr("date'2024-01-01'")
    start = F.date_add(day, h % 300)
    moves = F.filter(
        F.array(
            F.struct(F.lit("add").alias("action"), start.alias("at")),
            F.when(h % 2 == 0, F.struct(F.lit("remove").alias("action"), F.date_add(start, 60).alias("at"))),
            F.when(h % 4 == 0, F.struct(F.lit("add").alias("action"), F.date_add(start, 120).alias("at"))),
        ),
        lambda x: x.isNotNull(),
    )
    chosen = found.distinct().withColumn("h", drawn()).filter(h % one_in == 0)
    dated = chosen.select("pattern", F.explode(moves).alias("move"))
    return dated.select("pattern", "move.action", F.col("move.at").cast("timestamp_ntz").alias("at"))


@query("op1_url_filter", """
WITH cap AS (
  SELECT page_id, TIMESTAMP '2024-01-01' + to_days(CAST(page_id * 7919 % 480 AS INT)) + to_hours(CAST(page_id % 24 AS INT)) AS t,
         regexp_replace(lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.|\\.$', '') AS host,
         list_filter(string_split(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
names AS (
  SELECT page_id, unnest(list_distinct(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'))
    || list_transform(range(1, least(len(parts), 2) + 1), lambda i: host || '/' || array_to_string(list_slice(parts, 1, i), '/')))) AS pattern
  FROM cap WHERE host <> ''),
domains AS (SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 2, 1), len(string_split(host, '.'))), '.') AS pattern FROM cap WHERE host <> ''),
firsts AS (SELECT DISTINCT host || '/' || parts[1] AS pattern FROM cap WHERE host <> '' AND len(parts) > 0),
chosen AS (
  SELECT *, ('0x' || substr(md5(pattern), 1, 4))::INT AS h, k FROM (
    SELECT pattern, 3 AS k, true AS block FROM domains UNION ALL SELECT pattern, 5, true FROM firsts
    UNION ALL SELECT pattern, 7, false FROM firsts)),
spans AS (
  SELECT pattern, block, DATE '2024-01-01' + h % 300 AS a, CASE WHEN h % 2 = 0 THEN DATE '2024-01-01' + h % 300 + 60 END AS z
  FROM chosen WHERE h % k = 0
  UNION ALL SELECT pattern, block, DATE '2024-01-01' + h % 300 + 120, NULL FROM chosen WHERE h % k = 0 AND h % 4 = 0),
hits AS (
  SELECT page_id, pattern, block FROM names JOIN cap USING (page_id) JOIN spans USING (pattern)
  WHERE t >= a AND (z IS NULL OR t < z)),
best AS (
  SELECT page_id, count(*) FILTER (block) AS n, min(struct_pack(n := -length(pattern), p := pattern)) FILTER (block) AS b,
         min(struct_pack(n := -length(pattern), p := pattern)) FILTER (NOT block) AS a
  FROM hits GROUP BY 1)
SELECT page_id, nullif(host, '') AS host, t AS fetched_at, coalesce(n, 0) AS n_blocking, b.p AS blocked_by, a.p AS allowed_by,
       b IS NULL OR coalesce(a.n <= b.n, false) AS keep
FROM cap LEFT JOIN best USING (page_id)
""")
def op1(spark, sf_dir):
    """Every page against a blocking list of domains and path prefixes and an allowing list of path prefixes."""
    captures = table(spark, sf_dir, "pages").select(
        "page_id", "url",
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(int(page_id * 7919 % 480), int(page_id % 24))").alias("fetched_at"),
    )
    host = url_filter.host_of(F.col("url"))
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3)), ".")
    first = F.filter(url_filter.patterns(F.col("url"), 1), lambda x: x.contains("/"))
    domains = captures.filter(host.isNotNull()).select(domain.alias("pattern"))
    firsts = captures.select(F.explode(first).alias("pattern"))
    blocked = entries(domains, 3).unionByName(entries(firsts, 5))
    return url_filter.evaluate(captures, blocked, entries(firsts, 7), path_parts=2)


@query("op2_simhash")
def op2(spark, sf_dir):
    """Fingerprint and component of all documents: three-word shingles, at most three bits."""
    return simhash.cluster(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op3_byte_bpe")
def op3(spark, sf_dir):
    """All documents encoded and decoded again; digests of the ids and of the bytes."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.encode_and_decode(table(spark, sf_dir, "documents"), ranks, pattern)
    spelt = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(spelt.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op4_lm_score")
def op4(spark, sf_dir):
    """Pseudo-likelihood of all documents under a network trained on them."""
    docs = table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.fit(docs))


@query("op5_sharding")
def op5(spark, sf_dir):
    """All documents on 16 shards, where a 17th would take rows, and where all 17 hold near equal bytes."""
    path = scratch_path(spark, "slot_map")
    shards.store_map(shards.first_map(spark, 16), path)
    shards.store_map(shards.grow(shards.load_map(spark, path, 1), 16), path)
    docs = table(spark, sf_dir, "documents")
    shards.store_map(shards.rebalance(shards.load_map(spark, path, 2), shards.slot_sizes(docs), 17), path)
    first, grown, balanced = (shards.load_map(spark, path, version) for version in (1, 2, 3))
    return shards.assign(docs, first, grown, balanced=balanced)


@query("op6_language_id")
def op6(spark, sf_dir):
    """Language of all documents; a third of the documents is held out of training."""
    docs = table(spark, sf_dir, "documents")
    texts = language_id.training_rows(docs.filter(~language_id.held_out()))
    rows = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    return language_id.predict(rows, texts).select("doc_id", "held_out", "lang_pred", "score")


@query("op7_decontamination")
def op7(spark, sf_dir):
    """Every benchmark item found in any document."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_suffix_dedup")
def op8(spark, sf_dir):
    """All documents without the 50-byte strings of earlier ones."""
    rows = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return rows.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op9_token_counts")
def op9(spark, sf_dir):
    """Tokens of all documents under the lower-casing word vocabulary."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_exact_dedup", r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""")
def op10(spark, sf_dir):
    """Exact duplicates of all documents."""
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


THRESHOLD = 0.3  # from this score on a document is predicted to have label 1


@query("op11_quality")
def op11(spark, sf_dir):
    """Quality score of all documents; a fifth of the documents is held out of training."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    meta = ["n_chars"]
    rows = quality.training_rows(docs.filter(~quality.held_out()), labels.filter(~quality.held_out()), metadata=meta)
    scored = quality.score(docs, quality.fit(rows), metadata=meta)
    return scored.select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def periodic(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in one of ten documents, by checksum, the words from one place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.col("words")
    n = F.size(words).cast("bigint")
    a = F.col("a")
    p = 1 + F.floor((n - a) / (3 + g % 8))
    again = F.transform(
        F.sequence(F.lit(0).cast("bigint"), n - 1),
        lambda i: F.element_at(words, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int")),
    )
    split = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"))).alias("words"))
    placed = split.withColumn("a", F.when(n > 0, g % n))
    return placed.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    """Periodic runs of words of all documents, and the texts without what repeats."""
    rows = periodic_runs.find_runs(periodic(table(spark, sf_dir, "documents")))
    runs = F.col("runs")
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(order)
    spelt = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size(runs) > 0, F.concat(spelt, F.lit("\n"))).otherwise("")
    return rows.withColumn("best", best).select(
        "doc_id", F.size(runs).cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"), F.floor(-1000 * F.col("best.n") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def rebuilt(sequences: DataFrame) -> DataFrame:
    """``conv_id, turns``: the first turns of every twentieth conversation stand before the rest of those after it."""
    c, own = F.col("conv_id"), F.col("turns")
    h = (F.crc32(c.cast("string")) % 4).cast("int")
    heads = sequences.filter(c % 20 == 0).select(c.alias("base"), F.slice(own, 1, 3).alias("head"))
    joined = sequences.withColumn("base", c - c % 20).join(heads, "base", "left")
    none = F.array().cast(sequences.schema["turns"].dataType)
    lead = F.when(h > 0, F.slice(F.coalesce("head", none), F.lit(1), h)).otherwise(none)
    rest = F.slice(own, h + 1, F.greatest(F.size(own) - h, F.lit(0)))
    return joined.select("conv_id", F.concat(lead, rest).alias("turns"))


@query("op13_prefix_trie")
def op13(spark, sf_dir):
    """The trie of the prefixes of all rebuilt conversations."""
    return prefix_trie.build(rebuilt(prefix_trie.turns(table(spark, sf_dir, "conversations"))))
