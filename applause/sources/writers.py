"""Table sinks: final tables, exports and incremental snapshots."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .readers import best_movies_path


def write_table(df: DataFrame, path: str, fmt: str = "parquet", clear: bool = True) -> None:
    """Write a table; ``clear=False`` keeps what earlier runs left and appends."""
    writer = df.write.mode("overwrite" if clear else "append")
    if fmt == "csv":
        options = {"header": True, "quote": '"', "escape": '"'}
        keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer = writer.options(**options, **keep)
    writer.format(fmt).save(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV download: one header file per task, so no single task holds the whole table."""
    write_table(df, path, "csv")


def export_movies(spark: SparkSession, folder: str, target: str) -> bool:
    """Export the movies with statistics, or the plain movies where there are none."""
    source = best_movies_path(spark, folder)
    if source is None:
        return False
    export_csv(spark.read.parquet(source), target)
    return True


def write_snapshots(df: DataFrame, path: str, batch: str = "batch_id") -> None:
    """Write rows below one folder per batch; a repeated batch replaces only its own folder."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(batch)
        .parquet(path)
    )


def read_snapshot(spark: SparkSession, path: str, upto: int, batch: str = "batch_id") -> DataFrame:
    """All rows collected up to and including batch ``upto``; later folders are neither listed nor read."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(root, f"{batch}=*")) or []
    names = [x.getName().split("=", 1)[1] for x in jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found)] if found else []
    numbers = [int(n) for n in names if re.fullmatch(r"0|-?[1-9][0-9]{0,8}", n)]
    wanted = [f"{path}/{batch}={n}" for n in numbers if n <= upto]
    if not wanted or len(numbers) != len(names):  # without one the schema is read from the rest; other names are Spark's to read
        return spark.read.parquet(path).filter(F.col(batch) <= upto)
    return spark.read.option("basePath", path).parquet(*wanted).filter(F.col(batch) <= upto)
