"""Micro-batches into tables: file streams, idempotent batch folders, and the latest row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 4) -> DataFrame:
    """Rows of Parquet files as they come; a path may be a folder or one file."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # the file source takes single files only through a pattern
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def run_into(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off what there is, each micro-batch into a folder of its own. A batch that is run again after a failure
    overwrites its folder, so every row counts once."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def latest(spark: SparkSession, path: str, keys: Sequence[str], schema: str) -> DataFrame:
    """The row of the last batch that touched each key; schema names the columns as written."""
    rows = spark.read.schema(f"{schema}, batch int").parquet(path)
    columns = [c for c in rows.columns if c not in keys and c != "batch"]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("_row"))
    return picked.select(*keys, "_row.*")


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(batch, rows) of every micro-batch that run_into() wrote to path, however many: a query's own reports are only
    the last hundred by default."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "batch int, rows long")
    return spark.read.schema("batch int").parquet(path).groupBy("batch").agg(F.count(F.lit(1)).alias("rows"))
