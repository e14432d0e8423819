"""Continuous ingestion: each micro-batch of (id, title, body) becomes one segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fathomdex.operators.store import Engine


def ingest(engine: Engine, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that seals every micro-batch; ids already live are skipped, so a
    batch that is run again after a failure adds nothing twice."""

    def seal(batch: DataFrame, _: int) -> None:
        engine.put_all(batch)

    writer = stream.writeStream.foreachBatch(seal).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
