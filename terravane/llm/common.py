"""What the operators of this subpackage share: table access, a place for written tables, and row hygiene."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that bound words in every contract, as they stand in a regular expression.
WS = r"[ \t\n\x0B\f\r]"
#: The same characters, for translate().
WS_CHARS = " \t\n\x0b\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


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


def give_back() -> None:
    """Memory that a worker has freed goes back to the system, so that it isn't counted against the next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What a worker keeps from task to task, by operator.
_kept: dict[str, dict] = {}


def kept_by(operator: str) -> dict:
    """What this operator keeps in this worker; what others kept goes, so that a later stage doesn't carry it along."""
    for name in [k for k in _kept if k != operator]:
        del _kept[name]
        give_back()
    return _kept.setdefault(operator, {})


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and the rows survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; null gives an empty array."""
    return F.coalesce(F.array_remove(F.split(text, WS + "+", -1), ""), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """How many words a text has: 0 for null."""
    return F.size(words(text)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for rows kept from training: crc32 of doc_id's text is divisible by 5; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
