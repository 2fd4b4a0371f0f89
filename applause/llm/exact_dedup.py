"""Exact duplicates with the frequent digests split off.

A Misra-Gries pass over the digests names every digest that may hold more than ``support`` of the rows. Their exact
sizes are counted with map-side partial sums, and the few winners (at most ``1 / support`` short rows, whatever the
input) are broadcast, so the rows of hot groups are decided where they lie. All other digests take an ordinary
shuffle, in which no group holds more than ``support`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from applause.session import cut_lineage

SUPPORT = 0.001
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``digest``: lowercase hex SHA-256 of each normalised text. Other columns are not read."""
    return docs.select(F.col(key).alias("doc_id"), F.sha2(normalised(F.col(text)), 256).alias("digest"))


def frequent_digests(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``digest``: a superset of the digests with more than ``support`` of the rows, at most ``1 / support`` of them."""
    found = rows.stat.freqItems(["digest"], support)
    return found.select(F.explode("digest_freqItems").alias("digest")).distinct()


def winners(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``digest, keep_id, group_size`` of the candidates that an exact count finds in more than ``support`` of the rows."""
    least = rows.count() * support
    sizes = rows.join(F.broadcast(frequent_digests(rows, support)), "digest").groupBy("digest")
    counted = sizes.agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return counted.filter(F.col("group_size") > least)


def decide(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after each run of ASCII white space became one space. Of equal texts the
    smallest ``doc_id`` stays. A null text is the empty text. Rows without ``doc_id`` count in their group but stay
    only where the whole group has none (``keep_id`` is null then). Repeated rows of one ``doc_id`` share the
    decision; ``drop_duplicates`` keeps one of them. No rows give no rows.
    """
    rows = cut_lineage(digests(docs, key, text))  # a text is read and hashed once; these rows are short
    heavy = F.broadcast(cut_lineage(winners(rows, support)))
    same = Window.partitionBy("digest")
    rest = rows.join(heavy, "digest", "left_anti").select(
        "digest", "doc_id", F.min("doc_id").over(same).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"),
    )
    decided = rows.join(heavy, "digest").select("digest", "doc_id", "keep_id", "group_size").unionByName(rest)
    return decided.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Edge cases as in ``decide``."""
    kept = decide(docs, key, text, support).filter("kept").select("doc_id", F.col("text_sha256").alias("digest"))
    kept = kept.distinct().withColumn("id_hash", F.xxhash64("doc_id")).alias("kept")
    own = F.sha2(normalised(F.col(text)), 256).alias("digest")
    rows = docs.select(F.struct(*docs.columns).alias("row"), own, F.xxhash64(F.col(key)).alias("id_hash")).alias("rows")
    same = F.expr(f"rows.id_hash = kept.id_hash and rows.digest = kept.digest and rows.row.`{key}` <=> kept.doc_id")
    found = rows.join(kept, same, "left_semi")
    first = Window.partitionBy("id_hash", "digest").orderBy(F.lit(0))  # lies as the join left it
    return found.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("row.*")
