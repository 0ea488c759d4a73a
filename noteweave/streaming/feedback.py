"""The feedback log as a stream: latest state of each key, windowed adoption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_log(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """New JSON-lines files of a folder; malformed lines are dropped."""
    reader = spark.readStream.schema(schema).option("mode", "DROPMALFORMED")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)


def latest(stream: DataFrame, key: list[str], sequence: list[str], values: list[str]) -> DataFrame:
    """The last row of each key so far, as a streaming aggregation (complete or update mode)."""
    last = stream.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*sequence)).alias("r"))
    return last.select(*key, *(F.col(f"r.{v}").alias(v) for v in values))


def windowed_adoption(stream: DataFrame, time: str, adopted: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and adoptions in tumbling windows, under a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length)).agg(F.count("*").alias("n"), F.count_if(F.col(adopted)).alias("adopted"))


def drain(result: DataFrame, checkpoint: str, target: str) -> DataFrame:
    """Process all that is there and return the result, written as Parquet to `target` batch by batch.

    Complete mode hands over the whole state each time, so the last batch is the result; nothing is gathered.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    query = result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(target)
