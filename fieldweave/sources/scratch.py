"""A folder for intermediate files that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the session's checkpoint folder; where none is set, under a temporary one, which only a session on one machine may have."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bucketed(spark: SparkSession, df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """`df` stored in the shared folder in buckets of `columns`, a file each: joins and groups by them need no exchange of what is stored.

    The files stay, as results read them lazily; the catalog forgets the table at once.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, name)
    held = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(n, *columns).write.bucketBy(n, *columns).option("path", path).saveAsTable(held)
    out = spark.table(held)
    spark.sql(f"DROP TABLE {held}")
    return out


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
