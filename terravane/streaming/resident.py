"""The resident query loop as a stream: address queries arrive as rows, each batch is answered against static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import address_search as A


def parse_lines(lines: DataFrame) -> DataFrame:
    """FROM<TAB>TO lines (value) as from and to; other lines are left out."""
    parts = F.split("value", "\t", -1)
    return lines.where(F.size(parts) == 2).select(F.trim(parts[0]).alias("from"), F.trim(parts[1]).alias("to")).where("`from` <> '' and `to` <> ''")


def resolve_stream(queries: DataFrame, addresses: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Answers of a stream of (query_id, query) in a table with one folder a batch; each batch is one equi join against the addresses.

    A batch that is replayed after a failure overwrites its own folder, so every answer is there once.
    """

    def answer(batch: DataFrame, number: int) -> None:
        A.resolve_exact(batch, addresses).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()
