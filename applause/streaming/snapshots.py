"""The snapshot sink fed by a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.writers import write_snapshots


def stream_snapshots(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    key: str | None = None,
) -> StreamingQuery:
    """Append each micro-batch as one snapshot folder.

    The folder is named by the batch id and overwritten on a retry, so each input file counts once.
    ``key`` spreads the writer over tasks by a column; by default the scan's own split is kept.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch)
        if key is not None:
            rows = rows.repartition(key)
        write_snapshots(rows.withColumn("batch_id", F.lit(batch_id)), path)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def landing_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", glob: str = "*") -> DataFrame:
    """New files of a landing folder as a stream."""
    return (
        spark.readStream.schema(schema).format(fmt)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", 1000)
        .load(folder)
    )
