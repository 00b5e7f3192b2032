"""Incremental runs: new files only, rows already done left out, results appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def open_rows(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among the done ones; null keys are never done."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def append_new(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, keys: list[str]):
    """Take the files that came since the last run, once; append rows whose key the target lacks.

    A batch that is tried again after a loss finds its own rows in the target
    and adds none twice.  Returns the finished query.
    """

    def add(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(keys)
        try:
            new = open_rows(new, batch.sparkSession.read.parquet(target), keys)
        except Exception as e:  # no target yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).json(source)
    q = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def distinct_stream(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """First row of each key within the watermark; the state of older keys is given up."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
