"""Comments collected from thread pages as they are delivered, under the cap of each movie.

The state of the stream is the table of the comments taken so far, one folder per trigger. A trigger reads the folders
before its own and replaces its own, so one that is repeated or restarted takes the same comments again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import collection, tables
from ..sources import readers, writers

TAKEN = (
    "video_id string, page int, pos int, comment_id string, text string, author string, likes bigint, "
    "published_at timestamp, movie_id bigint, movie string, batch_id bigint"
)


def taken(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """Comments taken so far, or by the triggers before one; empty where nothing has been delivered yet."""
    if not readers.path_exists(spark, store):
        return spark.createDataFrame([], TAKEN)
    rows = spark.read.schema(TAKEN).parquet(store)
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def take(pages: DataFrame, batch_id: int, wanted: DataFrame, store: str, cap: int = 300) -> None:
    """Add one delivery: each movie's next comments by page and place, as far as its cap has room.

    A comment that an earlier trigger took is not taken again. Movies without room leave before their comments are
    ranked. ``wanted`` is at most 400 rows; what was taken before is at most ``cap`` rows for each of them.
    """
    old = taken(pages.sparkSession, store, batch_id)
    full = old.groupBy("movie_id").agg(F.count("*").alias("_taken"))
    open_ = wanted.join(full, "movie_id", "left").withColumn("_room", cap - F.coalesce("_taken", F.lit(0))).filter("_room > 0")
    early = collection.early_comments(pages, open_.drop("_taken"))
    fresh = early.join(old.select("movie_id", "comment_id"), ["movie_id", "comment_id"], "left_anti")
    order = [F.asc("page"), F.asc("pos"), F.asc("comment_id")]
    first = tables.top_k_per_group(fresh, ["movie_id"], order, cap).filter(F.col("rank") <= F.col("_room"))
    writers.write_snapshots(first.drop("rank", "_room").withColumn("batch_id", F.lit(batch_id).cast("bigint")), store)


def stream_comments(
    pages: DataFrame, candidates: DataFrame, store: str, checkpoint: str, cap: int = 300
) -> StreamingQuery:
    """Take comments from a stream of thread pages until nothing new is there; started again, it goes on from there.

    ``candidates`` are those of :func:`collection.candidate_movies`, the same for every start.
    """
    wanted = collection.wanted_trailers(candidates)
    return (
        pages.writeStream.foreachBatch(lambda batch, batch_id: take(batch, batch_id, wanted, store, cap))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def collected(candidates: DataFrame, store: str, **options) -> tuple[DataFrame, DataFrame]:
    """Comments and movies from what was taken so far; ``options`` are those of :func:`collection.accept`."""
    return collection.accept(candidates, taken(candidates.sparkSession, store).drop("batch_id"), **options)
