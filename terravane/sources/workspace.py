"""Where the library writes tables of its own: the folder that the cluster shares, so that any executor can read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for this application's tables, which goes when the application ends: in spark.checkpoint.dir, which driver and
    executors share, or on a local master, where that may be unset (tests), in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{found.rstrip('/')}/terravane-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def cut(df: DataFrame) -> DataFrame:
    """Write a table and read it back: its lineage ends there and lost executors don't take it along."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """cut(), in buckets of a key, as many as a shuffle has partitions: joins on the key don't deal the table out again."""
    spark, name = df.sparkSession, f"terravane_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
