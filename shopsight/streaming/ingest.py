"""Micro-batch ingest with Structured Streaming (L1-L3).

``readStream`` delivers source rows in micro-batches; ``foreachBatch`` reads each
batch once (key resolution, classification and counters in the same pass) and
writes its rows to the star store.  A batch is known by (source, epoch):
the epoch is stable across restarts of the query (the checkpoint records it), so a
batch that is delivered again after a failure replaces its own rows - exactly-once
tables on an at-least-once sink - and the source is named after the checkpoint, so
a query with a new checkpoint starts its epochs at 0 without touching older batches
or loads.
"""

from __future__ import annotations

import hashlib
from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shopsight.sources.store import StarStore
from shopsight.sources.views import CustomerViews


def ingest_stream(stream: DataFrame, store: StarStore, checkpoint: str, seq_cols: Sequence[str],
                  to_feed: Callable[[DataFrame], DataFrame] | None = None,
                  keep: Sequence[str] = (), available_now: bool = True,
                  processing_time: str | None = None, tenants: DataFrame | None = None,
                  source: str | None = None, views: CustomerViews | None = None) -> StreamingQuery:
    """Start the ingest query; ``to_feed`` turns a raw batch into feed columns.

    A feed without ``tenant_id`` is resolved by its integration key against ``tenants``;
    the counters of every batch are in ``store.batches``.  ``views`` follow every batch."""
    name = source or f"stream-{hashlib.md5(checkpoint.encode()).hexdigest()[:12]}"

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        feed = to_feed(batch) if to_feed else batch
        store.write_feed(feed, epoch_id, seq_cols, source=name, keep=keep, tenants=tenants)
        if views:
            views.refresh(batch.sparkSession, store, epoch_id, name)

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
