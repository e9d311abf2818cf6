"""Incremental ingest by Structured Streaming: each micro-batch is one segment, visible when it is written.

The segment's name and place come from the batch's number, so a batch that is
run again after a failure replaces what it had written; the manifest's
``applied`` is the last batch that is in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern.engine import Engine


def ingest(engine: Engine, name: str, stream: DataFrame, checkpoint: str, compact: bool = False, **trigger: object) -> StreamingQuery:
    """Start the query; ``trigger`` is that of ``writeStream`` (by default, all there is, then stop)."""

    def batch(docs: DataFrame, batch_id: int) -> None:
        if engine.segments(name).manifest()["applied"] >= batch_id:
            return
        engine.index_documents(name, docs, segment_id=f"batch-{batch_id:06d}", applied=batch_id)
        if compact and not engine.merger:
            engine.compact_if_due(name)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
