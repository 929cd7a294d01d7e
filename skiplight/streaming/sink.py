"""Appending a stream to a managed table, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def append_stream(engine: Engine, stream: DataFrame, table: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Insert each micro-batch; cached groups of the table's tail are invalidated as by any insert.

    The table's snapshot names the last batch of each stream (by its checkpoint) and moves together with the rows, so a
    batch that Spark repeats after a failure or a restart isn't inserted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        engine.insert(table, batch, batch=(checkpoint, number))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
