"""Monthly rain from daily drops of files.

State is one row per cell and open month. A month stays open until the
watermark, the latest month seen less the delay, has passed it; rows for closed
months are left out. Each batch appends the months that it changed, so a reader
takes the last batch of each; a restarted stream goes on from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_drops(spark: SparkSession, path: str, schema: str, files_per_batch: int = 4) -> DataFrame:
    """A stream of the Parquet files that arrive below a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).parquet(path)


def monthly_rain(daily: DataFrame, delay: str = "60 days", cell: str = "qid") -> DataFrame:
    """(cell, month_start, rsum, days) of a stream of (cell, date, pre)."""
    d = daily.withColumn("month_start", F.date_trunc("month", F.col("date").cast("timestamp"))).withWatermark("month_start", delay)
    return d.groupBy(cell, "month_start").agg(F.sum("pre").alias("rsum"), F.count("pre").alias("days"))


def append_changes(months: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream of months over all that is there, appending each batch's changes below `path`."""

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that is run again replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return months.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, cell: str = "qid") -> DataFrame:
    """The last state of each month that `append_changes` wrote."""
    d = spark.read.parquet(path)
    return d.groupBy(cell, "month_start").agg(F.max_by(F.struct("rsum", "days"), "batch").alias("x")).select(cell, "month_start", "x.rsum", "x.days")
