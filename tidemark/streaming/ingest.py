"""Append a stream's micro-batches to a table, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.table import Table


def ingest(stream: DataFrame, table: Table, checkpoint: str, source: str = "stream", **trigger) -> StreamingQuery:
    """Start a query that appends (key columns, op, value, optional seq) to ``table``.

    The last epoch is part of the table's manifest, committed together with its data, so a
    batch that Spark delivers again after a failure is skipped.  ``trigger`` is Spark's, such
    as ``availableNow=True``.
    """

    def append(batch: DataFrame, epoch: int) -> None:
        table.append(batch, source, epoch)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
