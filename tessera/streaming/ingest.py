"""Streams into tables: every micro-batch is one committed insert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.engine import Engine


def append_stream(engine: Engine, stream: DataFrame, table: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Append a stream's rows, column by position. A batch that is replayed after a failure between the commit and
    Spark's own record of it is inserted again."""
    return stream.writeStream.foreachBatch(lambda df, _: engine.insert_from(table, df)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
