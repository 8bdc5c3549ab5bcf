"""Streaming ingest: each micro-batch lands in the hot tier, and older rows trickle to the cold one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidewell.plans.schema import Table
from tidewell.sources.tiers import TieredStore


def trickle(store: TieredStore, table: type[Table], stream: DataFrame, checkpoint: str, flush_every: int = 10) -> StreamingQuery:
    """Insert micro-batches and migrate the hot tier after every `flush_every` of them."""

    def land(batch: DataFrame, number: int) -> None:
        store.insert(table, batch)
        if number % flush_every == flush_every - 1:
            store.move(table)

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
